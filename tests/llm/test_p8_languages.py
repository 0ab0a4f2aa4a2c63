"""Labels, prose, exact code lengths and held-out documents."""

import os
import random
from collections import Counter

import pytest

from tessera.llm import languages as L


def test_labels():
    assert [L.label_code(x) for x in ("en-US", " English ", "deu", "pt_PT", "日本語", "xx", "", None, "sv", "n/a")] == ["en", "en", "de", "pt", "ja", None, None, None, None, None]


def test_code_lengths_are_a_code():
    """Over all next bytes the probabilities add up to at most 1, and words the tree knows are cheap."""
    tree = L.ContextTree({"house": 5, "mouse": 3, "horse": 1})
    assert tree.bits("house") < tree.bits("hxuse") and tree.bits("zzz") > 20
    total = sum(2 ** -tree.bits(w) for w in ("house", "mouse", "horse", "hous", "h", "m", "ouse", "moose"))
    assert 0 < total <= 1.0


def test_prose_only():
    text = "# Eine Überschrift\n\nDas ist ein ganzer Satz hier. (\"Offene Fragen\")\n\n```\nthis is code in here\n```\n\n$ run it now please\n- ein Eintrag der Liste\n\nWhy we changed it\n"
    assert [s.strip() for s in L.sentences(text)] == ["Das ist ein ganzer Satz hier.", "ein Eintrag der Liste"]
    assert L.sentences("") == [] == L.sentences("```\nx\n```")


SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_held_out_documents():
    import pyarrow.parquet as pq

    rows = [r for r in pq.read_table(SF, columns=["lang", "text"]).to_pylist() if r["text"] and L.label_code(r["lang"])]
    random.seed(3)
    random.shuffle(rows)
    half = len(rows) // 2
    scorer = L.Scorer(L.fit([(r["lang"], r["text"]) for r in rows[:half]]))
    right = n = 0
    for r in rows[half:]:
        lists = [w for s in L.sentences(r["text"]) if len(w := L.words_of(s)) >= L.MIN_WORDS]
        if lists:
            found = L.passages(lists, scorer.score(lists))
            n += 1
            right += L.label_code(r["lang"]) in {L.LANGS[p[0]] for p in found}
    assert n > 200 and right / n > 0.9  # the labels themselves are wrong now and then


def test_short_sentences_and_quotations():
    """Two words can be a sentence; a quotation that ends like one is read, a quoted title isn't."""
    assert ["Das ist gut."] == [x for x in L.sentences('He said \u201eDas ist gut.\u201c twice and left the room.') if x.startswith("Das")] or "Das ist gut" in " ".join(L.sentences('He said \u201eDas ist gut.\u201c twice and left the room.'))
    assert "Haus" not in " ".join(L.sentences("He read \u201eDas Haus am See\u201c twice and left the room."))
    german = {"das": 50, "ist": 50, "gut": 20, "nicht": 30, "schlecht": 10, "und": 60, "wir": 30, "gehen": 20, "jetzt": 20}
    english = {"this": 50, "is": 50, "good": 20, "the": 90, "and": 60, "we": 30, "leave": 20, "room": 20, "now": 20, "walk": 10, "into": 10, "old": 10}
    scorer = L.Scorer({"de": german, "en": english})
    lists = [L.words_of(s) for s in ("We walk into the old room and leave the room now", "Wir gehen jetzt", "This is good and we leave")]
    assert [L.LANGS[p[0]] for p in L.passages(lists, scorer.score(lists))] == ["en", "de", "en"]


def test_tables(spark):
    german, english = "Das ist ein kurzer Satz und er wird gelesen. Die Sprache ist nicht wie die anderen.", "This is a short sentence and somebody reads it. The language will not be taken for one of the others."
    rows = [(1, english, "en"), (2, german, "en"), (3, english + " " + german, "English"), (4, None, None), (5, "", "de"), (6, german, None), (6, german, None), (7, "```\nx = 1\n```", "")]
    rows += [(100 + k, (german if k % 2 else english), "de" if k % 2 else "en") for k in range(20)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, segment int")
    got = Counter((r.doc_id, r.lang) for r in L.unlabelled(df).collect())
    assert got == Counter({(2, "de"): 1, (3, "de"): 1, (6, "de"): 1})
    assert all(0 < r.confidence <= 1 for r in L.identify(df).collect())
    assert L.unlabelled(df.limit(0)).count() == 0
