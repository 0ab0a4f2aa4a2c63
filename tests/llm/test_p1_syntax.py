"""Lexers and verdicts; Python against its own grammar."""

import ast

import pytest

from tessera.llm import syntax as S

GOOD = {
    "a.py": "x = f'{1 + 2}'\n# <<<<<<< HEAD\ns = '''\n<<<<<<< HEAD\n=======\n'''\ndef f(a, /, *, b=1) -> int:\n    return a if b else [k for k in a]\n",
    "a.js": "const re = /[{(]\\d{2}/g;\n'use strict';\nlet s = `a ${b ? `{${c}` : '}'} z`;\nfunction* g(x, { y = 1 } = {}) { return x / 2 / y }\n/* ( */ // }\n",
    "a.ts": "interface A { x?: number }\nconst f = (a: readonly string[], b = 1): number => { const q: '{' | '}' = '{'; return a!.length as unknown as number };\n",
    "a.tsx": "export function C(props: { a: string }) {\n  if (1 < 2) { return <b/>; }\n  return <p title=\"{\">don't {props.a}</p>;\n}\n",
    "a.go": "package a\nimport \"fmt\"\nvar s = `{ \" `\nfunc (r *T) F(x int) (int, error) { r := '{'; for k := range m { fmt.Println(k, r) }; return 1, nil }\n",
    "a.rs": "use a::b;\n/* outer /* inner { */ ( */\npub fn f<'a>(x: &'a str) -> &'a str { let q = '{'; let w = r#\"a \" {\"#; println!(\"{} {{\", x); return; }\n",
    "A.java": "package a.b;\nimport java.util.Map;\npublic class A { String s = \"\"\"\n <<<<<<< HEAD {\n \"\"\"; char c = '{'; @Override public String f(final int... x) { return null; } }\n",
    "a.h": "#include <stdio.h>\n#define M(x) ((x) * 2)\nstruct s { int a; };\nstatic int f(int a, const char *b) { char q = '{'; return a; }\n",
    "a.rb": "# frozen_string_literal: true\nmodule A\n=begin\n=======\ndef {\n=end\n  def self.f(a:, b: 1)\n    q = '(end'\n    w = %w[a if do]\n    puts \"x #{a} {\"\n    return if a.nil?\n    a.each do |k|\n      b = k if k > 1\n    end\n    begin\n      x = <<~T\n        end {\n      T\n    rescue StandardError\n      nil\n    end\n  end\nend\n",
    "only.ts": "// nothing here {\n/* ( */\n",
    "bom.py": "\ufeffx = 1\r\ny = (2,\r\n     3)\r\n",
}
VALID = [
    ("a.py", "def f(x):\n    match x:\n        case 1:\n            return 2\n        case [a, *_] if a:\n            return 3\n        case _:\n            pass\n"),
    ("a.py", "x = 1;\n"),
    ("a.py", "import os; os.getcwd()\n"),
    ("a.py", "a, = b[::-1] if c not in d else .5\nfrom .. import e as f\nif (g := 1): h = lambda *i, j=2: {**i}\n"),
    ("a.ts", "const a = {\n  start,\n  end\n};\n"),
    ("a.ts", "const o = {\n  private: true,\n  except: [1],\n  default: 2,\n};\nexport const enum E { A = 1 }\n"),
    ("a.ts", "export abstract class A<T extends B> implements C {\n  private readonly x?: string;\n  abstract do(): void;\n  get y(): number { return this.x!.length }\n}\ndeclare module 'm' { export type Q = keyof T }\n"),
    ("a.js", "#!/usr/bin/env node\nimport a, { b as c } from 'd'\nexport default async () => { for await (const x of a) { yield_(`${x} ${`n${c}`}`) } }\nclass K extends L { #p = 1; static m() { return K.#p } }\n"),
    ("a.go", "package a\n\nfunc run(\n\tname string,\n\tfn func() error,\n) error {\n\tx := <-c\n\treturn nil\n}\n"),
    ("A.java", "class A { void f() { list.map(x->x); int y = (int) z; } }\n"),
    ("a.rs", "fn f() { let function = 1; let y = function + 1; }\n#[derive(Debug)]\npub struct S<'a> { x: &'a str }\nmacro_rules! m { ($x:expr) => { $x y z }; }\n"),
    ("a.c", "void f(struct impl *x, char **y) { x->y = 1; }\n#if A\nint g(void) {\n#else\nint h(void) {\n#endif\n  return 1; }\n"),
]
BAD = {
    "a.py": ["x = (1,\n", "x = 'abc\n", "def f():\n", "def f():\n<<<<<<< HEAD\n    pass\n", "x = 1 +\n", "if (x := 1) is not None\n", "<!DOCTYPE html>\n<html></html>\n", "func f() {\n}\n", "x = lambda k\n", "x = y z\n", "for x in y\n    pass\n"],
    "a.js": ["<<<<<<< HEAD\nlet x = 1;\n", "export const x\n", "import { a }\n", "class A extends B\n", "let x = 5 5\n", "This text says what the module does and why.\n", "function f() {\n", "let s = `a ${b\n", "/* x\n", "import type { A } from './a';\n", "def f(x):\n    return x\n", "{\n  \"a\": 1\n}\n"],
    "a.ts": ["function C() {\n  return (\n    <b className=\"x\">\n      <i>text</i>\n    </b>\n  );\n}\n", "f(]\n", "=======\nconst x = 1;\n>>>>>>> b\n", "def f(x):\n    pass\n", "package a\nfunc f() int {\n}\n"],
    "a.go": ["package a\nfunc f() {\n", "use a::b;\nfn f() { }\n", "package a.b;\npublic class C { }\n"],
    "a.rs": ["fn f() { let s = r#\"abc\n", "package a\nfunc f() {\n}\n", "#include <a.h>\nint f(void) { return 1; }\n"],
    "A.java": ["public class A {\n", "fn f() { let mut x = 1; }\n", "public class\n"],
    "a.c": ["int f(void) { char *s = \"abc\n}\n", "package a\n", "int x\n"],
    "a.rb": ["def f\n  1\n", "x = \"a\n", "end\n", "x = <<~T\n  abc\n", "def f(x):\n    return x\n"],
}


@pytest.mark.parametrize("path", GOOD)
def test_valid(path):
    assert S.judge(path, GOOD[path])[1] is None
    if path.endswith(".py"):
        ast.parse(GOOD[path].lstrip("\ufeff").replace("\r\n", "\n"))


@pytest.mark.parametrize("path,text", [(p, t) for p, texts in BAD.items() for t in texts])
def test_invalid(path, text):
    assert S.judge(path, text)[1] is not None


@pytest.mark.parametrize("path,text", VALID)
def test_valid_statements(path, text):
    assert S.judge(path, text)[1] is None


def test_agrees_with_the_grammar_on_python_files_and_their_cuts():
    import json.decoder
    import textwrap

    for module in (json.decoder, textwrap, S):
        text = open(module.__file__, encoding="utf-8").read()
        assert S.judge("a.py", text)[1] is None
        lines = text.split("\n")
        for n in range(1, len(lines), 7):
            piece = "\n".join(lines[:n]) + "\n"
            try:
                ast.parse(piece)
                fine = True
            except SyntaxError:
                fine = False
            assert (S.judge("a.py", piece)[1] is None) == fine, lines[n - 1]


def test_top_levels_are_read_in_one_way():
    """Many calls and items with a broken end take no longer than many right ones."""
    import time

    began = time.time()
    for path, unit in (("a.c", "A(1) B(2) int x(void);\n"), ("a.c", "A(1) B(2) int f(void) { }\n"), ("a.rs", "pub(crate) fn f() { }\n"), ("a.rs", "a::b::c!(1);\n"), ("A.java", "@A(1) @B public class C { }\n"), ("a.go", "func f() { }\n")):
        head = "package a\n" if path == "a.go" else ""
        assert S.judge(path, head + unit * 2_000)[1] is None, unit
        assert S.judge(path, head + unit * 2_000 + "return = x")[1] is not None, unit
    assert time.time() - began < 20


def test_no_cases():
    for content in (None, "", "  \n\t", "# only a comment\n"):
        assert S.judge("a.py", content)[1] is None
    assert S.judge("a.unknown", "((((")[1] is None and S.judge(None, "((")[1] is None


def test_every_cut_of_a_python_file_agrees_with_the_grammar():
    text = GOOD["a.py"].replace("# <<<<<<< HEAD\n", "")
    for i in range(1, len(text)):
        piece = text[:i]
        try:
            ast.parse(piece)
            fine = True
        except SyntaxError:
            fine = False
        if fine:
            assert S.judge("a.py", piece)[1] is None or piece.rstrip()[-1:] in "=+,.:(" or not piece.endswith("\n"), piece


def test_very_long_files_and_tables(spark):
    assert S.judge("a.js", "x = [" + "1," * 200_000 + "];")[1] is None
    rows = [(1, "r", "a.py", "x = (", "python", 9), (1, "r", "a.py", "x = (", "python", 9), (2, None, "b.py", "x = 1\n", None, 9), (3, "r", None, None, None, 9)]
    df = spark.createDataFrame(rows, "file_id long, repo string, path string, content string, language string, failure int")  # names the operator makes itself
    assert [r.file_id for r in S.unparsable(df).collect()] == [1]
    rates = {(r.repo, r.language): (r.n_files, r.n_failed) for r in S.failure_rates(df).collect()}
    assert rates == {("r", "python"): (1, 1), (None, "python"): (1, 0)}
    assert S.unparsable(df.limit(0)).count() == 0
