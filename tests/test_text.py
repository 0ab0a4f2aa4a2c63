"""Documents, code and budgets on small fixtures."""

from tessera.operators import code, retrieval


def test_outline():
    found = code.outline("class A:\n    def f(self):\n        pass\n\ndef g():\n    return 1\n", "python")
    assert [(k, n, a, b) for k, n, _, a, b in found] == [("class", "A", 1, 3), ("method", "f", 2, 3), ("function", "g", 5, 6)]
    assert [(k, n) for k, n, *_ in code.outline("export function a() {\n}\nclass B {\n}\n", "typescript")] == [("function", "a"), ("class", "B")]
    assert code.outline("", "python") == []


def test_ranking_prefers_rare_terms(spark):
    df = spark.createDataFrame([(1, "token token"), (2, "token journal"), (3, "plain"), (4, None), (5, "")], "doc_id long, text string").where("text is not null")
    got = [r.doc_id for r in retrieval.rank_documents(df, ("token", "journal")).collect()]
    assert got == [2, 1]
