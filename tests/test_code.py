"""Graphs and symbols of source files on small fixtures."""

import pytest

from tessera.operators import code as C
from tessera.queries import QUERIES

FILES = [
    (1, "r", "./src/main.ts", 'import { a } from "./a";\nimport { x } from "outside";\n'),
    (2001, "r", "src/a.ts", 'import { b } from "./b";\n'),
    (2998, "r", "src/b.ts", 'import { c } from "./c";\n'),
    (3995, "r", "src/c.ts", ""),
    (5, "q", "main.js", 'require("./lib/d");\n'),
    (1002, "q", "lib/d.js", 'require("../main");\n'),
]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(FILES, "file_id long, repo string, path string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    return str(tmp_path)


def test_imports_are_followed_from_every_file(spark, folder):
    """Numbers of 200 and more, and numbers that are equal in the remainder by 997, are nodes of their own."""
    got = {r.node: r.score for r in QUERIES["expand_imports"](spark, folder).collect()}
    assert got == {1: 100, 2001: 50, 2998: 25, 5: 100, 1002: 50}


CODE = """def walk(n):
    # budget
    return walk(n - 1)


class A:
    def run(self):
        return 1


class B:
    def run(self):
        return budget
"""
OTHER = "from a import walk\n\nwalk(2)\nwalk(3)\n"


def source(spark, *texts):
    return spark.createDataFrame([(i, "r", f"{i}.py", t) for i, t in enumerate(texts, 1)], "file_id long, repo string, path string, content string")


def test_changed_bodies(spark):
    got = C.changed_outlines(source(spark, CODE, OTHER), source(spark, CODE.replace("budget", "allowance") + "\n\ndef new():\n    pass\n", OTHER)).collect()
    assert sorted(map(tuple, got)) == [(1, "B", 1, "changed"), (1, "new", 1, "added"), (1, "run", 2, "changed"), (1, "walk", 1, "changed")]


def test_callers_leave_out_the_body(spark):
    got = {(r.file_id, r.name, r.ordinal): (r.n_lines, r.n_files) for r in C.callers(source(spark, CODE, OTHER)).collect()}
    assert got == {(1, "walk", 0): (3, 1), (1, "A", 1): (0, 0), (1, "run", 2): (1, 1), (1, "B", 3): (0, 0), (1, "run", 4): (1, 1)}
