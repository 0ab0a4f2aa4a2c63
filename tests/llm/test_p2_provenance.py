"""Weak labels, features and the classifier on made files."""

import random

from tessera.llm import provenance as P


def hand(k):
    random.seed(k)
    return "\n".join([f"// Reads the {k} part.", "import { a } from './a';", *[f"function {random.choice('abcdef') * 3}{random.choice('xyz')}(p) {{\n  return p + {random.randint(1, 99)};\n}}" for _ in range(6)]])


MADE = {
    "generated": lambda k: "// Code generated by tool. DO NOT EDIT.\n" + "\n".join(f"exports.Msg{k}_F{i} = {{ no: {i}, kind: 1 }};" for i in range(12)),
    "minified": lambda k: "var a=function(b,c){return b%2?c:b[1]};" * 30,
    "data": lambda k: "const T = [\n" + "\n".join("  " + ", ".join(hex((i * 37 + j * k) % 256) for j in range(12)) + "," for i in range(20)) + "\n];\n",
    "vendored": lambda k: f"// somelib v1.{k}.0 | (c) the somelib authors | MIT\n" + hand(k),
}


def test_marks():
    for kind, make in MADE.items():
        assert P.weak_label("src/a.js", make(3)) == kind
    assert P.weak_label("src/generators/a.js", hand(1)) is None and P.weak_label("src/vendors/a.js", hand(1)) is None
    assert P.weak_label("node_modules/x/a.js", hand(1)) == "vendored" and P.weak_label("./vendor/x/a.js", hand(1)) == "vendored"
    assert P.weak_label("a.js", hand(1) + "\nconst H = '// Code generated by x. DO NOT EDIT.';") is None
    assert P.weak_label("a.c", "static const int p[] = { 1, 2, 4, 8, 16, 32 };\nint f(void) { return p[0]; }\n" + hand(2)) is None


def test_held_out_repositories():
    rows = [(f"r{k % 7}", f"src/f{k}.js", hand(k)) for k in range(140)] + [(f"r{k % 7}", f"src/g{k}.js", make(k)) for kind, make in MADE.items() if kind != "vendored" for k in range(30)]
    figures = P.validate(rows, {}, folds=3, masked=True)
    right, wrong = sum(f["tp"] + f["tn"] for f in figures), sum(f["fp"] + f["fn"] for f in figures)
    assert right / (right + wrong) >= 0.95


def test_table_with_nulls_and_repeats(spark):
    rows = [(k, f"r{k % 3}", f"src/f{k}.js", hand(k), 0.5) for k in range(60)] + [(100 + k, f"r{k % 3}", f"lib/g{k}.js", MADE["generated"](k), None) for k in range(30)]
    rows += [rows[65], (500, None, None, MADE["minified"](1), 1.0), (501, "r1", "a.js", None, 1.0), (502, "r1", "a.js", "", 1.0), (503, "r1", "vendor/a.js", "<!DOCTYPE html>\n<html></html>", 1.0)]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, content string, score double")
    profiles = spark.createDataFrame([("r1", ["**/*.min.js", None, "", "[bad"], None), (None, None, ["dist"])], "repo string, extra_ignore array<string>, tree_ignore array<string>")
    got = [r.file_id for r in P.not_handwritten(files, profiles).collect()]
    assert len(got) == len(set(got)) and set(range(100, 130)) <= set(got) and not set(got) & ({501, 502, 503} | set(range(60)))
    assert P.not_handwritten(files.limit(0), profiles.limit(0)).count() == 0
