"""Imports, selection and contexts on small fixtures."""

import pytest

from tessera.operators import graph as G
from tessera.operators import retrieval as R

PATHS = {1: "src/a.ts", 2: "src/b.ts", 3: "src/deep/c.tsx", 4: "lib/d.js", 5: "tests/a.test.ts", 6: "src/e.ts", 7: "top.ts"}
TEXTS = {
    1: "import { x } from './b';\nimport y from '../lib/d.js';\nexport function needle() {}\n// needle needle",
    2: "const z = require('./deep/c');\nimport type { q } from './deep/../e';",
    3: "import * as up from '../../../out';\nimport n from 'package';\nconst l = import('../../top');",
    4: "export { x } from '../src/e';",
    5: "import { x } from '../src/a';\nneedle",
    6: "",
    7: "import self from './top';",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(k, "r", ("./" if k == 4 else "") + PATHS[k], TEXTS[k], ["needle"] if k == 1 else [], []) for k in PATHS]
    return spark.createDataFrame(rows, "file_id long, repo string, path string, content string, names array<string>, heads array<string>")


@pytest.fixture(scope="module")
def edges(files):
    return G.resolve(G.import_edges(files), files)


def test_resolution(edges):
    got = {(r.file_id, r.specifier): r.resolved for r in edges.collect()}
    assert got == {(1, "./b"): 2, (1, "../lib/d.js"): 4, (2, "./deep/c"): 3, (2, "./deep/../e"): 6, (3, "../../../out"): None, (3, "package"): None, (3, "../../top"): 7, (4, "../src/e"): 6, (5, "../src/a"): 1, (7, "./top"): 7}


def test_importers_and_tests(files, edges):
    assert {tuple(r) for r in G.incoming(edges).collect()} == {(2, 1), (4, 1), (3, 2), (6, 2), (7, 3), (6, 4), (1, 5)}
    assert {tuple(r) for r in G.tests_of(edges, files).collect()} == {(1, 5), (5, 5)}


def test_boost_and_expansion(spark, edges):
    candidates = spark.createDataFrame([(1, 100.0, "high"), (2, 3.0, "normal"), (4, 1.0, "low")], "node long, score double, priority string")
    assert [tuple(r) for r in G.shared_boost(candidates, edges).collect()] == [(6, 2.0)]
    one = {r.node: (r.score, r.priority) for r in G.expand_candidates(candidates, edges, 1).collect()}
    assert one == {1: (100.0, "high"), 2: (3.0, "normal"), 4: (50.0, "low")}
    three = {r.node: (r.score, r.priority) for r in G.expand_candidates(candidates, edges, 3).collect()}
    assert three == {1: (100.0, "high"), 2: (3.0, "normal"), 4: (50.0, "low"), 3: (25.0, "low"), 6: (25.0, "low"), 7: (12.0, "low")}


def test_selection(files, edges):
    got = {r.file_id: (r.score, r.priority) for r in R.select_files(files, edges, ("needle",), seeds=("src/e.ts",)).collect()}
    assert got[6] == (100.0, "high") and got[5][1] == "normal" and got[1][0] > 2
    none = R.select_files(files, edges, ("needle",), depth=0).collect()
    assert {r.file_id for r in none} == {1, 5}
    high = {r.file_id: r.score for r in R.select_files(files, edges, ("needle",), folders=("src",)).collect()}
    assert high[1] >= 5 and high[2] >= 2 and high[4] >= 2


def test_whole_words_of_names(spark):
    from pyspark.sql import functions as F

    rows = [("get_user.ts", ["getUser"], ["The User"]), ("getter.ts", ["getter"], []), ("user/user/user/x.ts", ["userOne", "userTwo", "userTwo", "userX"], ["User a", "user b", "user c"])]
    df = spark.createDataFrame(rows, "path string, names array<string>, heads array<string>")
    assert [r[0] for r in df.select(R.metadata_score(("user", "get"), F.col("path"), F.col("names"), F.col("heads"))).collect()] == [3 + 2 + 2, 0, 2 + 6 + 4]


def test_surplus_goes_to_the_same_or_a_higher_priority():
    assert R.redistribute([(50, 20, "normal"), (30, 100, "high"), (20, 100, "low")]) == [20, 60, 20]
    assert R.redistribute([(50, 20, "high"), (30, 100, "low")]) == [20, 30]
    assert R.redistribute([(50, 20, "normal"), (30, 35, "normal"), (20, 200, "normal")]) == [20, 35, 45]


def test_contexts(spark):
    words = lambda n: "\n".join(" ".join(["w"] * 5) for _ in range(n // 5))
    rows = [(1, 1, "a", words(20), "normal"), (1, 2, "b", words(30), "high"), (2, 1, "c", words(100), "high"), (2, 2, "d", words(20), "low"), (2, 3, "e", words(100), "low")]
    df = spark.createDataFrame(rows, "request int, position int, name string, text string, priority string")
    got = {r.request: r for r in R.assemble(df, 60).collect()}
    assert got[1].tokens == 50 and got[1].context.startswith("## a (full, 20t)\n\nw w") and "\n\n---\n\n## b (full, 30t)" in got[1].context
    assert got[2].tokens <= 60 + 8 and "## c (truncate, " in got[2].context and "[...truncated, ~" in got[2].context
    parts = got[2].context.split("\n\n---\n\n")
    assert len(parts) == 3


def test_reading_within_a_budget(spark):
    from pyspark.sql import functions as F

    text = "a b c\n" + "x" * 600 + " y\nd e\nf"
    df = spark.createDataFrame([(1, text), (2, "a b"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (r.total, r.lines, r.tokens) for r in R.truncate_to_budget(df, 7).collect()}
    assert got == {1: (8, 0, 4), 2: (2, 1, 2), 3: (0, 1, 0)}
    wide = df.select(R.read_text(F.col("text"), F.lit(100))).first()[0]
    assert wide == text
    read = spark.createDataFrame([("\n".join(["one two"] * 9),)], "text string").select(R.read_text(F.col("text"), F.lit(12))).first()[0]
    assert read == "one two\none two\none two\n[...truncated, ~12 more tokens]"
