"""Elements of each markup and of mixtures."""

from tessera.llm.markup import Walker, elements, extract_elements


def of(text, kind):
    return [p for k, _, p in elements(text) if k == kind]


MD = """---
title: no
---
# A *b* `c_d` {#id}

Text with $x_1$ and \\$5, `$no$`.

Under
-----

- [x] one **two**
  - inner [l](u "t")
+ 3 \\* 4 tok_count
  wrapped

1) first

> # quoted
> - no

````py
# not a heading
```
````

| a | b |
| --- | --- |
| 1 | 2 |

$$
y = 2
$$

<!-- - no -->
"""


def test_markdown():
    assert of(MD, "heading") == ["A b c_d", "Under"]
    assert of(MD, "list_item") == ["one two", "inner l", "3 * 4 tok_count wrapped", "first"]
    assert of(MD, "code") == ["# not a heading ```"]
    assert of(MD, "formula") == ["x_1", "y = 2"]


def test_html():
    text = """<!DOCTYPE html><html><head><title>no</title></head><body>
<h1 id="a">A &amp; <b>b</b></h1><p>x \\(a &lt; b\\) $5</p>
<ul class="x"><li>one<ul><li>in</li></ul></li><li>two<br>lines
</ul><table><tr><td><h2>no</h2></td></tr></table><blockquote><ul><li>no</li></ul></blockquote>
<pre><code class="l">&lt;b&gt;</code></pre><script>var x = "<h2>no</h2>";</script></body></html>"""
    assert of(text, "heading") == ["A & b"] and of(text, "list_item") == ["one", "in", "two lines"]
    assert of(text, "formula") == ["a < b"] and of(text, "code") == ["<b>"]


def test_wiki():
    text = "== '''A''' [[P|b]] ==\n\n* one [http://x y]\n** <nowiki>''z''</nowiki>\n# num {{c|d}}\n# two\n\n{|\n| no\n|}\n\n{{Box|a=1}}\n\nt <math>a_1</math><ref>no</ref>\n\n<source lang=\"x\">\n== no ==\n</source>\n"
    assert of(text, "heading") == ["A b"] and of(text, "list_item") == ["one y", "''z''", "num", "two"]
    assert of(text, "formula") == ["a_1"] and of(text, "code") == ["== no =="]


def test_latex():
    text = "\\section{A \\textbf{b} \\& \\href{u}{c}}\\label{x}\n\n% \\section{no}\n\\begin{itemize}\n  \\item one {\\em two}\n\\begin{enumerate}\n \\item in~x\n\\end{enumerate}\n\\end{itemize}\n\\begin{equation}\na = b\n\\end{equation}\n\nT \\(z\\).\\footnote{no}\n\n\\begin{verbatim}\n\\section{raw}\n\\end{verbatim}\n\\begin{tabular}{l}\nno\n\\end{tabular}\n"
    assert of(text, "heading") == ["A b & c"] and of(text, "list_item") == ["one two", "in x"]
    assert of(text, "formula") == ["a = b", "z"] and of(text, "code") == ["\\section{raw}"]


def test_mixtures_and_line_ends():
    text = "# A\r\n\r\n<p>open paragraph\r\n\r\n+ item\r\n\r\n\\section{B}\r\n\r\n==C==\r\n"
    assert of(text, "heading") == ["A", "B", "C"] and of(text, "list_item") == ["item"]
    assert elements(None) == [] == elements("") == elements(" \n ") and elements("# ") == []
    assert of("```\nnever closed", "code") == ["never closed"]
    assert len(of("- x\n" * 30_000, "list_item")) == 30_000


def test_containers_vote_by_their_links(spark):
    """Navigation that differs from content by its class only loses its repository's vote; a container with links in a text doesn't."""
    nav = '<div class="menu{}"><ul><li><a href="/a">home page</a></li><li><a href="/b">all news</a></li></ul></div>'
    body = '<div class="page"><h2>Title {}</h2><ul><li>text with <a href="/c">a link</a> in it</li></ul></div>'
    assert Walker(nav.format(7)).walk().votes == {"div.menu#": -4} and Walker('<div id="a"><section>b c</section></div>').walk().votes == {"div.a/section": 2, "div.a": 2}
    rows = [(k, "r", f"<body>{nav.format(k)}{body.format(k)}</body>", "") for k in range(5)]
    rows += [(7, "r", '<div class="menu9"><h2>not here</h2>some plain words</div>\n\n# H', ""), (8, "s", '<div class="menu9"><h2>here</h2>some plain words</div>', "")]
    rows += [rows[0], (10, None, "- a", ""), (None, "r", None, None), (11, "r", '<div class="menu3"><a href="/x">x y</a><div class="page"><h3>inner</h3></div></div>', "")]
    documents = spark.createDataFrame(rows, "md_id long, repo string, content string, lost string")
    want = sorted([(k, *x) for k in range(5) for x in (("heading", 1, f"Title {k}"), ("list_item", 1, "text with a link in it"))] + [(7, "heading", 1, "H"), (8, "heading", 1, "here"), (10, "list_item", 1, "a"), (11, "heading", 1, "inner")])
    for bound in (200_000, 0):  # lost paths by broadcast and by the join
        assert sorted((r.md_id, r.kind, r.seq, r.plain) for r in extract_elements(documents, bound).collect()) == want
    assert extract_elements(spark.createDataFrame([], "md_id long, repo string, content string")).count() == 0


def test_text_after_a_block_on_its_line():
    """Blocks one after the other on one line cost no copy of the text each."""
    assert len(of("<h2>a</h2>- b\n" * 20_000, "heading")) == 20_000
