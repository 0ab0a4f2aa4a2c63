"""Edits, renames, outlines, conventions and what surrounds a symbol, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import code as C
from tessera.operators import edits as E
from tessera.operators import focus as FO

TEXT = 'import { a } from "./a";\n\nexport function one(x: Foo): Promise<Bar> {\n  // a brace } in a comment\n  const s = "{";\n  return two(x, `}`);\n}\n\nfunction two() {\n  return 2;\n}\nfunction one() { return 3; }\n'


def test_outlines_skip_literals_and_comments():
    assert [(k, n, a, b) for k, n, _, a, b in C.outline(TEXT, "typescript")] == [("function", "one", 3, 7), ("function", "two", 9, 11), ("function", "one", 12, 12)]
    assert [(n, a, b) for _, n, _, a, b in C.outline("fn f<'a>(x: &'a str) -> char {\n  let c = '{';\n  c\n}\nfn g() {}\n", "rust")] == [("f", 1, 4), ("g", 5, 5)]
    assert len(C.outline("function f() {\n}\n" * 20_000, "javascript")) == 20_000


def test_line_edits():
    text = "a\nb\nc\n"
    h = E.line_hash
    assert E.edit_lines(text, [{"hash": h(2, "b"), "replace": "B", "after": "b2", "before": "b0"}]) == "a\nb0\nB\nb2\nc\n"
    assert E.edit_lines(text, [{"hash": h(1, "a"), "delete": True}, {"hash": h(1, "b"), "replace": "x"}]) == "x\nc\n"
    assert E.edit_lines(text, [{"hash": h(2, "b"), "delete": True, "after": "n"}]) == "a\nn\nc\n"
    assert E.edit_lines("a", [{"hash": h(1, "a"), "after": "b"}]) == "a\nb"
    with pytest.raises(E.Refused):
        E.edit_lines(text, [{"hash": "zzzz", "delete": True}])


def test_patches_and_inserts():
    own = "\n".join(TEXT.split("\n")[2:7])
    assert E.patch(TEXT, "typescript", "one", E.short(own), "// new").startswith('import { a } from "./a";\n\n// new\n\nfunction two')
    assert "{ return 4; }" in E.patch(TEXT, "typescript", "one", E.short("function one() { return 3; }"), "function one() { return 4; }")
    made = E.patch(TEXT, "typescript", "two", None, edits=[{"hash": E.line_hash(2, "  return 2;"), "replace": "  return 5;"}], imports=["{ b } from './b'", 'import { a } from "./a";'])
    assert "return 5" in made and made.split("\n")[1] == "import { b } from './b'" and made.count("import { a }") == 1
    for args, code in ((("nope", None), "SYMBOL_NOT_FOUND"), (("one", "0000"), "STALE_READ")):
        with pytest.raises(E.Refused) as e:
            E.patch(TEXT, "typescript", *args, "x")
        assert e.value.args[0] == code
    both = E.patch_all(TEXT, "typescript", [("one", None, "A"), ("two", None, "B")])
    assert both == 'import { a } from "./a";\n\nA\n\nB\nfunction one() { return 3; }\n'
    assert E.insert("x\n", "typescript", "start-of-file", "n") == "n\nx\n" and E.insert("x", "typescript", "end-of-file", "n") == "x\nn\n"
    assert E.insert(TEXT, "typescript", "after-imports", "n").split("\n")[:3] == ['import { a } from "./a";', "", "n"]
    assert "}\nn\n\n\nfunction two" in E.insert(TEXT, "typescript", "after:one", "n") and "\nn\nfunction two" in E.insert(TEXT, "typescript", "before:two", "n")
    with pytest.raises(E.Refused):
        E.insert(TEXT, "typescript", "somewhere", "n")
    assert E.summary("a\nb", "a\nc\nd") == ("-b\n+c\n+d", 2)


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, "r", "src/a.ts", TEXT), (2, "r", "src/b.ts", "import { one } from './a';\none(1);\nconst q = one;\n"), (3, "r", "tests/a.test.ts", "import { one } from '../src/a';\nexpect(one(2));\n"), (4, "r", "src/foo.ts", "export class Foo {\n}\nexport interface Bar {\n}\n"), (5, "s", "x.py", ""), (6, "s", "y.py", None)]
    return spark.createDataFrame(rows, "file_id long, repo string, path string, content string")


def test_requests_on_tables(spark, files):
    edit = "array<struct<hash:string,replace:string,after:string,before:string,delete:boolean>>"
    rows = [(1, 1, "patch", "two", None, None, "function two() { return 9; }", None), (1, 2, "patch", "two", "0000", None, "x", None), (1, 3, "insert", None, None, "end-of-file", "// end", None), (9, 1, "insert", None, None, "end-of-file", "x", None), (6, 1, "lines", None, None, None, None, [(E.line_hash(1, ""), "z = 1", None, None, None)]), (5, 1, "fold", None, None, None, None, None)]
    requests = spark.createDataFrame(rows, f"file_id long, request int, op string, symbol string, expected string, position string, body string, edits {edit}").withColumn("imports", F.lit(None).cast("array<string>"))
    got = {(r.file_id, r.request): (r.ok, r.code, r.n_changed) for r in E.apply(files, requests).collect()}
    assert got == {(1, 1): (True, None, 5), (1, 2): (False, "STALE_READ", 0), (1, 3): (True, None, 2), (9, 1): (False, "FILE_NOT_FOUND", 0), (6, 1): (True, None, 1), (5, 1): (False, "PARSE_ERROR", 0)}
    last = E.apply(files, requests).where("file_id = 1 AND request = 3").first().content
    assert "return 9" in last and last.endswith("// end\n")


def test_renames(files):
    got = {r.file_id: (r.n_references, r.n_lines, r.defines) for r in E.rename(files, "one", "uno", definition=1).collect()}
    assert got == {1: (2, 2, True), 2: (3, 3, False), 3: (2, 2, False)}
    assert {r.file_id for r in E.rename(files, "one", "uno", 1, ["tests/**"]).collect()} == {1, 3} and E.rename(files, "one", "not a name").count() == 0
    assert "uno(1)" in E.rename(files, "one", "uno").where("file_id = 2").first().content


def test_focus(spark, files):
    requests = spark.createDataFrame([(1, 1, "one", None), (2, 1, "nope", None)], "request int, file_id long, symbol string, hash string")
    got: dict = {}
    for r in sorted(FO.focus(files.where("content IS NOT NULL"), requests).collect(), key=lambda r: (r.request, r.part, r.n)):
        got.setdefault((r.request, r.part), []).append(r.text)
    assert got[1, "head"][0].startswith("one (function, src/a.ts:3-7, hash:") and got[1, "body"][0].startswith("export function one")
    assert got[1, "caller"] == ["src/a.ts:12 function one() { return 3; }", "src/b.ts:1 import { one } from './a';", "src/b.ts:2 one(1);", "src/b.ts:3 const q = one;", "tests/a.test.ts:1 import { one } from '../src/a';", "tests/a.test.ts:2 expect(one(2));"]
    assert got[1, "dependency"] == ["two src/a.ts:9"] and got[1, "type"] == ["Foo src/foo.ts:1", "Promise", "Bar src/foo.ts:3"]
    assert got[1, "test"] == ["tests/a.test.ts", "tests/a.test.ts:1 import { one } from '../src/a';", "tests/a.test.ts:2 expect(one(2));"] and got[2, "missing"] == ["symbol not found: nope"]
    assert spark.createDataFrame([("a b\nc d\ne",)], "t string").select(FO.cut_tokens(F.col("t"), F.lit(4))).first()[0] == "a b\nc d\n..."


def test_verification(files):
    whole = files.where("content IS NOT NULL")
    after = whole.withColumn("content", F.when(F.col("file_id") == 1, F.replace("content", F.lit("const s"), F.lit("let s"))).otherwise(F.col("content")))
    assert [tuple(r) for r in FO.verify(whole, after).collect()] == [(1, "one", "changed", 5, ["src/b.ts:1", "src/b.ts:2", "src/b.ts:3", "tests/a.test.ts:1", "tests/a.test.ts:2"], 1)]


def test_conventions(spark):
    text = "import type { A } from './a.js';\nimport { b } from './b.js';\nexport function f(x: A): Promise<void> {\n  try {\n    return b();\n  } catch (e) { }\n}\nexport function gOne(): Promise<A> {\n  try { } finally { }\n}\nexport function hTwo(): Promise<B> {\n}\nfunction iThree() {\n}\n"
    rows = [(k, "r", f"src/f{k}.ts", text, ) for k in range(4)] + [(9, "few", "a.ts", text)]
    got = {(r.repo, r.key, r.detail): r.confidence for r in C.conventions(spark.createDataFrame(rows, "file_id long, repo string, path string, content string")).collect()}
    assert set(got) == {("r", k, d) for k, d in (("errors", "try/catch style dominant, limited bare throws"), ("returns", "Promise-returning public functions are dominant"), ("naming", "camelCase identifiers dominate"), ("imports", "relative imports are dominant"), ("imports", ".js import extensions are consistently used"), ("style", "avg 3 lines/function"), ("exports", "named exports dominate"))}
    assert set(got.values()) == {1.0}
