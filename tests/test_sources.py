"""Files, journals, rules and learnings on a temporary folder."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as S
from tessera.sources import journal as J


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in {"src/a.ts": "one two\nthree", "src/deep/b.ts": "four", "docs/c.md": "# C\n", "node_modules/x/d.js": "no", ".hidden/e.ts": "no", "f.ts": "x\r\ny", "package.json": "{}", "bun.lock": "x"}.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_text(text, newline="")
    return str(root)


def test_discovery_and_texts(spark, tree):
    found = S.discover(spark, tree, "**/*.{ts,md}")
    assert {(r.path, r.bytes) for r in found.collect()} == {("src/a.ts", 13), ("src/deep/b.ts", 4), ("docs/c.md", 4), ("f.ts", 4)}
    texts = {r.path: r.content for r in S.read_texts(spark, tree, "src/**").collect()}
    assert texts == {"src/a.ts": "one two\nthree", "src/deep/b.ts": "four"}
    asked = spark.createDataFrame([("f.ts",), ("gone.ts",), ("",)], "path string")
    assert [r.path for r in S.existing(asked, found).collect()] == ["f.ts"]
    assert [r.path for r in S.changed(asked, asked).collect()] == ["f.ts", "gone.ts"]
    keys = [spark.range(1).select(S.discovery_key(tree, "*", x)).first()[0] for x in (("b", "a"), ("a", "b"))]
    assert keys[0] == keys[1]


def test_globs(spark):
    paths = ["a.ts", "x/a.ts", "x/y/a.tsx", "docs/z.md", "bench/q.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    take = lambda g: [r.path for r in df.where(S.matches(F.col("path"), [g])).collect()]
    assert take("**/*.{ts,tsx}") == paths[:3] and take("*.ts") == ["a.ts"] and take("x/*.ts") == ["x/a.ts"] and take("docs/**") == ["docs/z.md"] and take("?.ts") == ["a.ts"]
    glob, ignored = S.PROFILES["code"]
    assert [r.path for r in df.where(S.matches(F.col("path"), [glob]) & ~S.matches(F.col("path"), ignored)).collect()] == paths[:3]


def test_trees_and_tools(spark, tree):
    files = S.read_texts(spark, tree, ignore=()).withColumn("repo", F.lit("r"))
    got = {r.path: (r.is_folder, r.level, r.tokens) for r in S.tree_entries(files).collect()}
    assert got == {"src": (True, 0, 4), "src/deep": (True, 1, 1), "src/deep/b.ts": (False, 2, 1), "src/a.ts": (False, 1, 3), "docs": (True, 0, 2), "docs/c.md": (False, 1, 2), "f.ts": (False, 0, 2), "package.json": (False, 0, 1), "bun.lock": (False, 0, 1)}
    assert {r.path for r in S.tree_entries(files, depth=0, extension="ts").collect()} == {"f.ts"}
    assert S.render_tree(S.tree_entries(files, ignore=("docs", "package.json", "bun.lock"))).first().tree == "f.ts (2t)\nsrc/ (4t)\n  a.ts (3t)\n  deep/ (1t)\n    b.ts (1t)"
    assert tuple(S.tree_totals(S.tree_entries(files)).first()) == ("r", 6, 10)
    assert tuple(S.detect_tools(files).first()) == ("r", "bun", None)


def test_kept_tables(spark):
    now = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("c", 1, 5)], "path string, modified_at int, bytes int")
    kept = spark.createDataFrame([("a", 1, 10, "A"), ("b", 1, 10, "old"), ("gone", 1, 1, "G")], "path string, modified_at int, bytes int, f string")
    due = S.stale(now, kept)
    assert {r.path for r in due.collect()} == {"b", "c"}
    assert {(r.path, r.f) for r in S.refreshed(now, kept, due.withColumn("f", F.lit("new"))).collect()} == {("a", "A"), ("b", "new"), ("c", "new")}
    sections = spark.createDataFrame([("s", "h1"), ("t", "h2")], "section_key string, content_hash string")
    summaries = spark.createDataFrame([("s", "h1", "sum"), ("t", "h0", "stale")], "section_key string, content_hash string, summary string")
    assert {(r.section_key, r.summary) for r in S.looked_up(sections, summaries).collect()} == {("s", "sum"), ("t", None)}


def test_journal_and_snapshot(spark, tmp_path):
    log, snap = str(tmp_path / "log"), str(tmp_path / "snap")
    schema = "ts long, user string, n int"
    assert J.read_records(spark, log, schema).count() == 0
    for k in range(3):
        J.append_records(spark.createDataFrame([(k, "u", 1), (k, "v", 2)], schema), log)
    with open(os.path.join(log, "part-bad.json"), "w") as f:
        f.write("{broken\n")
    assert J.read_records(spark, log, schema).count() == 6
    empty = spark.createDataFrame([], "user string, total long")
    assert J.load_snapshot(spark, snap, empty).count() == 0
    fold = lambda x: x.groupBy("user").agg(F.sum("n").alias("total"))
    for _ in range(2):
        J.compact(J.read_records(spark, log, schema) if J.exists(spark, log) else spark.createDataFrame([(9, "w", 7)], schema), fold, log, snap)
        state = {r.user: r.total for r in J.load_snapshot(spark, snap, empty).collect()}
    assert state == {"w": 7} and not J.exists(spark, log)
    J.reset(spark, snap)
    assert not J.exists(spark, snap)


def test_written_texts(spark, tmp_path):
    J.write_texts(spark.createDataFrame([("a.cmd", "x\r\n"), ("d/b.cmd", "é"), ("c.cmd", None)], "name string, content string"), str(tmp_path))
    assert (tmp_path / "a.cmd").read_bytes() == b"x\r\n" and (tmp_path / "d/b.cmd").read_text(encoding="utf-8") == "é" and not (tmp_path / "c.cmd").exists()
    assert [tuple(r) for r in J.as_json(spark.createDataFrame([(1, "a")], "id int, t string"), "id").collect()] == [(1, '{"id":1,"t":"a"}')]


def test_rules(spark, tmp_path):
    rules = [
        {"on": "PreToolUse", "when": {"tool": "Edit|Write", "path": "src/**"}, "inject": {"block": "frozen"}},
        {"on": "PreToolUse", "when": {"tool": "Edit"}, "inject": {"text": "look first"}},
        {"on": "PreToolUse", "inject": {"hint": "docs/a.md"}},
        {"on": "PreToolUse", "when": {"command": "rm "}, "inject": {"allow": "fine"}},
        {"on": "PreToolUse", "when": {"path": ""}, "inject": {"text": "never"}},
        {"on": "Stop", "inject": {"block": "no", "allow": "no"}},
        {"on": "Nope", "when": {"tool": "(a"}, "inject": {"shell": "x"}},
        {"on": "Stop"},
    ]
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(rules))
    read = J.read_rules(spark, str(tmp_path / "none.json"), str(path))
    assert read.count() == 8 and J.read_rules(spark, "/nowhere.json").count() == 0
    assert {(r.rule, r.issue) for r in J.health(read).collect()} == {(6, "unknown event Nope"), (6, "inject.shell is removed"), (6, "when.tool is no pattern"), (7, "missing inject")}
    events = spark.createDataFrame([(1, "PreToolUse", "Edit", "src/a/b.ts", None), (2, "PreToolUse", "MultiEdit", "src/a.ts", "rm -r x"), (3, "Stop", None, None, None)], "id int, event string, tool string, path string, command string")
    matched = J.match_rules(events, read, ["id"])
    assert {(r.id, r.rule, r.kind) for r in matched.collect()} == {(1, 0, "block"), (1, 1, "context"), (1, 2, "context"), (2, 2, "context"), (2, 3, "allow")}
    assert {tuple(r) for r in J.respond(matched, ["id"]).collect()} == {(1, "deny", "frozen", "look first\nRelated: docs/a.md"), (2, "allow", "fine", "Related: docs/a.md")}


def test_learnings(spark):
    known = spark.createDataFrame([(["src/**"], "A"), (["docs/*.md", "f.ts"], "B"), (["gone/**"], "C"), ([], "D")], "files array<string>, learning string")
    paths = spark.createDataFrame([("src/a/b.ts",), ("docs/x.md",), ("f.ts",)], "path string")
    assert {tuple(r) for r in J.learnings_for(paths, known).collect()} == {("src/a/b.ts", "A"), ("docs/x.md", "B"), ("f.ts", "B")}
    assert {r.learning for r in J.orphans(known, paths).collect()} == {"C", "D"}
    assert {r.learning for r in J.overlapping(known, ["src/a.ts", "docs/**"]).collect()} == {"A", "B"}
