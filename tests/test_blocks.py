"""Blocks of Markdown, the compact notation, phrases, sections and extracts."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import blocks as B

DOC = """# Title

Some text
over lines.

- one
- [x] two
  1. inner a
  2. inner b
- three

1. first

2. second

| a | b |
| --- | --- |
| 1, 2 | x "q" |
| 3 | |

```py
# no heading
- no item
```

> quoted
> - item

---

Under
=====

<!-- note -->
:1 colon
"""


def test_kinds_and_rendering():
    tree = B.parse(DOC)
    assert [b["kind"] for b in tree] == ["heading", "paragraph", "list", "list", "table", "code", "quote", "break", "heading", "html", "paragraph"]
    assert tree[2]["items"][1] == {"checked": True, "blocks": [{"kind": "paragraph", "text": "two"}, {"kind": "list", "ordered": True, "start": 1, "spread": False, "items": [{"checked": None, "blocks": [{"kind": "paragraph", "text": t}]} for t in ("inner a", "inner b")]}]}
    assert tree[3]["spread"] and tree[4]["rows"] == [["a", "b"], ["1, 2", 'x "q"'], ["3", ""]]
    assert B.render(B.parse(B.render(tree))) == B.render(tree)


def test_compact_and_back():
    short = B.compact(B.parse(DOC))
    assert "|: a, b\n| \"1, 2\", \"x \"\"q\"\"\"" in short and "..+ inner a" in short and "[x] two" in short and "\\:1 colon" in short and "note" not in short
    assert B.round_trip(DOC) == (True, None, None, None) and B.round_trip(DOC, dedup=True)[0]
    assert B.compact(B.parse("# A\n\n## B\n\ntext"), version=True) == "%ctx:1\n\n# A\n## B\n\ntext"
    assert B.render(B.expand("%ctx:1\n\n:2 Head\n~\n|: x; y\n| 1; 2", delimiter=";")) == "## Head\n\n---\n\n| x | y |\n| --- | --- |\n| 1 | 2 |"
    assert B.parse("") == [] and B.compact([]) == "" and B.compact([], version=True) == "%ctx:1"
    assert B.parse("```\nnever closed") == [{"kind": "code", "lang": "", "text": "never closed"}]


def test_values_of_rows():
    for row in (["a", "b c"], ['say "x"', "1, 2"], ["", "x"]):
        assert B.parse_csv_row(B.csv_row(row)) == row
    assert B.parse_csv_row(' a ;"b;c" ; d', ";") == ["a", "b;c", "d"] and B.parse_csv_row('a""b,"",x"y"z') == ["ab", "", "xyz"] and B.parse_csv_row('"a""') == ['a"']


def test_phrases():
    text = "\n\n".join(["Several considerable improvements regarding documentation."] * 6 + ["internationalization. matters"] * 5)
    tree = B.parse(text)
    entries = B.dictionary_of(tree)
    assert entries and all(mark.startswith("§") for mark, _ in entries)
    short = B.compact(B.replaced(tree, entries), dictionary=entries)
    assert len(short) < len(text) and B.render(B.expand(short)) == B.render(tree)
    held = B.parse("§1 " + text)
    assert all(mark != "§1" for mark, _ in B.dictionary_of(held))
    assert B.dictionary_of(B.parse("short words only here")) == [] and B.estimate("a internationalization") == 5


def test_sections_and_extracts():
    text = "intro\n\n# A\n\none\n\n## A1\n\ntwo\n\n# B\n\nthree"
    tree = B.parse(text)
    assert [(d, a, b, t) for d, a, b, t in B.ranges(tree)] == [(1, 1, 5, "A"), (2, 3, 5, "A1"), (1, 5, 7, "B")]
    assert B.render(B.elide(tree, only=[" a1 "])) == "## A1\n\ntwo" and B.render(B.elide(tree, strip=["a"])) == "intro\n\n# B\n\nthree"
    assert B.elide(tree, only=["zzz"]) == [] and B.elide(B.parse("plain"), only=["x"]) == B.parse("plain")
    with pytest.raises(ValueError):
        B.elide(tree, only=["a"], strip=["b"])
    long_ = B.parse("x" * 300 + "\n\n" + "\n".join(f"- i{k}" for k in range(9)) + "\n\n| h | k |\n|---|---|\n" + "\n".join(f"| {k} | v |" for k in range(5)))
    cut = B.render(B.extract(long_))
    assert "x" * 200 + " ..." in cut and "- ... 6 more items" in cut and "| ... 3 more rows |  |" in cut and "i3" not in cut
    assert B.render(B.extract(B.parse("text"), chars=0)) == "..." and B.limit(float("nan"), 7) == 7 and B.limit(-2.5, 7) == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["# a b", "- x", "  - y z", "1. q", "```", "text here", "", "  code", "| t | u |", "| --- | --- |", "2) odd", "..dots", "`tick`", "~", "-", "+ plus", "> q", "====", "---", "[x] box", "|: t", "§1 mark", "    deep"]), max_size=14))
def test_any_lines(lines):
    """Rendering what was parsed settles at once, whatever the lines."""
    once = B.render(B.parse("\n".join(lines)))
    assert B.render(B.parse(once)) == B.render(B.parse(B.render(B.parse(once))))


def test_random_documents_come_back():
    import random

    words = "alpha beta gamma delta epsilon zeta".split()
    for seed in range(200):
        random.seed(seed)
        say = lambda n: " ".join(random.choice(words) for _ in range(n))
        parts = []
        for _ in range(random.randint(1, 10)):
            parts.append(
                random.choice([
                    lambda: "#" * random.randint(1, 4) + " " + say(2), lambda: say(6), lambda: "\n".join(f"- [{random.choice(' x')}] {say(2)}" for _ in range(3)), lambda: "\n".join(f"{k}. {say(2)}" for k in range(1, 4)),
                    lambda: f"| {say(1)} | {say(1)} |\n| --- | --- |\n| {say(1)}, x | {say(1)} |", lambda: "```js\n" + say(3) + "\n```", lambda: "- " + say(2) + "\n  - " + say(1) + "\n- " + say(1),
                ])()
            )
        text = "\n\n".join(p + ("\n\nend of it." if p[0] in "-0123456789" else "") for p in parts)
        for dedup in (False, True):
            assert B.round_trip(text, dedup=dedup) == (True, None, None, None), text


def test_documents(spark):
    docs = spark.createDataFrame([(1, DOC, 1), (2, None, 1), (3, "", 1)], "md_id long, content string, pos int")
    assert B.document_blocks(docs).count() == 11
    assert {r.md_id: r.same for r in B.compact_documents(docs).collect()} == {1: True, 3: True}
    assert {r.md_id for r in B.extract_documents(docs, only=["title"]).collect()} == {1, 3}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/md_docs.parquet"), reason="needs the test tables")
def test_most_documents_of_the_tables_come_back():
    import pyarrow.parquet as pq

    texts = [x for x in pq.read_table("/root/testdata/sf0.01/md_docs.parquet", columns=["content"]).column(0).to_pylist() if x]
    assert sum(B.round_trip(x)[0] for x in texts) / len(texts) > 0.5
