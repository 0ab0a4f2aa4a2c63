"""Problem 1: source files that don't parse in the language their path names.

Method: a lexer a language with a pushdown stack. The lexer knows the language's comments, literals (raw, multi-line, nested, with
embedded expressions, here-documents) and delimiters; the stack holds what is open: brackets, embedded expressions, JSX elements
and, in Ruby, blocks that words open and close. It reports the first of: an unterminated literal or comment, a delimiter that
closes nothing or the wrong thing, an end of file with something open, and a merge-conflict marker where code stands. What it lets
through goes as tokens to `grammar`, which reduces it with a stack to statements and rejects those the language hasn't: a
statement begun but not ended, or another language, a page, a note, a patch or settings under the wrong extension.

Defined results: null, empty, blank and comment-only contents parse; paths without one of the known extensions are not judged;
byte order marks and any line ends are fine; the recorded language is not used; repeated rows count once; very long files are
read whole, token by token; null repositories form a group of their own; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import grammar

LANGUAGE_OF = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python",
    "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "rb": "ruby",
}
CLOSES = {")": "(", "]": "[", "}": "{"}
CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?:[ \t][^\n]*)?$|={7}[ \t]*$", re.M)

REGEX_BEFORE = re.compile(r"(?:^|[=(\[{},;:!&|?+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|yield|await|=>))\s*$")
RUBY_REGEX_BEFORE = re.compile(r"(?:^|[=(\[{},;:!&|?+\-*%<>~^]|\b(?:if|unless|while|until|when|and|or|not|return|puts|in))\s*$")
JSX_BEFORE = re.compile(r"(?:^|[=(\[{},;:?&|>]|\b(?:return|default|yield|case))\s*$")


class Failure(Exception):
    """The first place where a file isn't valid: kind and offset."""


def lex(text: str, language: str) -> tuple[str, list]:
    """(code without comments, with literals blanked; what is open at the end). Raises Failure."""
    return LEXERS[language](text)


def skip_string(text: str, i: int, quote: str, multiline: bool) -> int:
    """The offset after a literal whose opening quote is before i."""
    pattern = STRING_END[quote, multiline]
    m = pattern.match(text, i)
    if not m:
        raise Failure("unterminated literal", i)
    return m.end()


STRING_END = {(q, m): re.compile(rf"(?:[^\\{q}{'' if m else chr(92) + 'n'}]|\\(?:\r\n|.))*{q}", re.S) for q in "\"'`" for m in (True, False)}
BRACE_TOKEN = {
    "c": re.compile(r"//|/\*|\"|'|[()\[\]{}]|^[ \t]*\#[ \t]*(?:error|warning|pragma)[^\n]*|^(?=[<>|=]{7})", re.M),
    "java": re.compile(r"//|/\*|\"\"\"|\"|'|[()\[\]{}]|^(?=[<>|=]{7})", re.M),
    "go": re.compile(r"//|/\*|\"|'|`|[()\[\]{}]|^(?=[<>|=]{7})", re.M),
    "rust": re.compile(r"//|/\*|\b(?:b|c)?r\#*\"|\"|'|[()\[\]{}]|^(?=[<>|=]{7})", re.M),
    "javascript": re.compile(r"^(?=[<>|=]{7})|//|/\*|\"|'|`|[()\[\]{}]|/|<", re.M),
}
BRACE_TOKEN["typescript"] = BRACE_TOKEN["tsx"] = BRACE_TOKEN["javascript"]
NESTED = re.compile(r"/\*|\*/")
TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
SLASH_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\\\]\n]|\\.)*\])+/[a-z]*")
TAG = re.compile(r"<(/?)([A-Za-z][\w.:-]*)?((?:\s+[\w:-]+(?:=(?:\"[^\"]*\"|'[^']*'|(?=\{)))?)*)\s*(/?)>?")
CHAR = re.compile(r"'(?:[^'\\\n]|\\(?:x[0-9A-Fa-f]{1,2}|u\{[0-9A-Fa-f_]+\}|u+[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[0-7]{1,3}|.))'")
LIFETIME = re.compile(r"'[A-Za-z_]\w*")


def lex_braces(text: str, language: str) -> tuple[str, list]:
    token, out, stack, i, last = BRACE_TOKEN[language], [], [], 0, 0
    script = language in ("javascript", "typescript", "tsx")

    def before() -> str:
        tail = text[max(last, i - 60) : i]
        if not tail.strip():
            for piece in reversed(out):
                tail = piece + tail
                if tail.strip():
                    break
        return tail[-60:].rstrip()

    def in_template(at: int, opened: int) -> int:
        """Continue a template from `at`; returns the offset after its end or after an opening ${."""
        while m := TEMPLATE.search(text, at):
            if m[0] == "`":
                return m.end()
            if m[0] == "${":
                stack.append(("${", m.start()))
                return m.end()
            at = m.end()
        raise Failure("unterminated literal", opened)

    def in_element(at: int) -> int:
        """Continue the children of a JSX element from `at`, up to an embedded expression or the outermost end."""
        while True:
            m = re.compile(r"[<{]").search(text, at)
            if not m:
                raise Failure("premature end", len(text))
            if m[0] == "{":
                stack.append(("{jsx", m.start()))
                return m.end()
            at = tag(m.start())
            if not stack or stack[-1][0] not in ("<",):
                return at

    def tag(at: int) -> int:
        """One tag; pushes an element it opens and pops the one it closes."""
        m = re.compile(r"<(/?)([A-Za-z][\w.:-]*)?").match(text, at)
        at = m.end()
        while True:  # attributes
            m2 = re.compile(r"\s*(?:[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'))?|\{|/?>|[\w:-]+\s*=\s*(?=\{))").match(text, at)
            if not m2:
                raise Failure("premature end" if not text[at:].strip() else "unbalanced delimiter", at)
            what = m2[0].strip()
            at = m2.end()
            if what == "{":
                depth, j = 1, at
                while depth:  # an attribute's expression: its own brackets and literals only
                    k = re.compile(r"[{}\"'`]").search(text, j)
                    if not k:
                        raise Failure("premature end", at)
                    if k[0] in "\"'`":
                        j = skip_string(text, k.end(), k[0], k[0] == "`")
                    else:
                        depth += 1 if k[0] == "{" else -1
                        j = k.end()
                at = j
            elif what == "/>":
                return at
            elif what == ">":
                break
        if m[1]:
            if not stack or stack[-1][0] != "<" or stack[-1][2] != m[2]:
                raise Failure("unbalanced delimiter", at)
            stack.pop()
        else:
            stack.append(("<", at, m[2]))
        return at

    while m := token.search(text, i):
        k, what = m.start(), m[0]
        out.append(text[last:k])
        i = last = k
        if what == "":
            c = CONFLICT.match(text, k)
            if c:
                raise Failure("conflict marker", k)
            i, last = k + 1, k
            continue
        if what == "//":
            e = text.find("\n", k)
            i = len(text) if e < 0 else e
        elif what == "/*":
            if language == "rust":
                depth, e = 1, k + 2
                while depth:
                    n = NESTED.search(text, e)
                    if not n:
                        raise Failure("unterminated comment", k)
                    depth += 1 if n[0] == "/*" else -1
                    e = n.end()
                i = e
            else:
                e = text.find("*/", k + 2)
                if e < 0:
                    raise Failure("unterminated comment", k)
                i = e + 2
            out.append("\n" * text.count("\n", k, i) or " ")
        elif what[0] in "#" or what.lstrip()[:1] == "#":
            i = m.end()
        elif what == '"""':
            e = re.compile(r'(?:[^\\"]|\\.|"(?!""))*"""', re.S).match(text, k + 3)
            if not e:
                raise Failure("unterminated literal", k)
            i = e.end()
            out.append('""')
        elif what == '"':
            i = skip_string(text, k + 1, '"', language == "rust")
            out.append('""')
        elif what == "'":
            if script:
                i = skip_string(text, k + 1, "'", False)
                out.append('""')
            elif c := CHAR.match(text, k):
                i = c.end()
                out.append("0")
            elif language == "rust" and (c := LIFETIME.match(text, k)):
                i = c.end()
                out.append(c[0])
            elif language == "c" and (c := re.compile(r"'[^'\n]+'").match(text, k)):
                i = c.end()
                out.append("0")
            else:
                raise Failure("unterminated literal", k)
        elif what == "`":
            if language == "go":
                e = text.find("`", k + 1)
                if e < 0:
                    raise Failure("unterminated literal", k)
                i = e + 1
            else:
                open_before = len(stack)
                i = in_template(k + 1, k)
                out.append("``+(" if len(stack) > open_before else "``")
                last = i
                continue
            out.append("``")
        elif what[-1] == '"' and "r" in what[:3]:
            close = '"' + "#" * what.count("#")
            e = text.find(close, m.end())
            if e < 0:
                raise Failure("unterminated literal", k)
            i = e + len(close)
            out.append('""')
        elif what in "([{":
            stack.append((what, k))
            out.append(what)
            i = k + 1
        elif what in ")]}":
            i = k + 1
            if not stack:
                raise Failure("unbalanced delimiter", k)
            top = stack.pop()[0]
            if what == "}" and top in ("${", "{jsx"):
                open_before = len(stack)
                i = in_template(k + 1, k) if top == "${" else in_element(k + 1)
                out.append(")+(" if stack and stack[-1][0] in ("${", "{jsx") and stack[-1][1] > k else ")")
            elif top != CLOSES[what]:
                raise Failure("unbalanced delimiter", k)
            else:
                out.append(what)
        elif what == "/":
            r = SLASH_REGEX.match(text, k)
            if r and REGEX_BEFORE.search(before()):
                i = r.end()
                out.append('""')
            else:
                i = k + 1
                out.append("/")
        else:  # <
            if language != "typescript" and re.compile(r"</?[A-Za-z>]").match(text, k) and JSX_BEFORE.search(before()) and not re.compile(r"<[A-Za-z]\w*(?:\s+extends\b[^<>]*|\s*,[^<>]*)>\s*\(").match(text, k):
                open_before = len(stack)
                i = tag(k)
                if len(stack) > open_before:
                    i = in_element(i)
                out.append("JSX+(" if stack and stack[-1][0] == "{jsx" and stack[-1][1] > k else "JSX")
            else:
                i = k + 1
                out.append("<")
        last = i
    out.append(text[last:])
    return "".join(out), stack


PY_TOKEN = re.compile(r"\#[^\n]*|(?:\b[A-Za-z]{1,2})?(?:\"\"\"|'''|\"|')|[()\[\]{}]|^(?=[<>|=]{7})", re.M)
PY_LONG = {q: re.compile(rf"(?:[^\\{q[0]}]|\\.|{q[0]}(?!{q[:2]}))*{q}", re.S) for q in ('"""', "'''")}


def lex_python(text: str) -> tuple[str, list]:
    out, stack, i, last = [], [], 0, 0
    while m := PY_TOKEN.search(text, i):
        k, what = m.start(), m[0]
        out.append(text[last:k])
        if what == "":
            if CONFLICT.match(text, k):
                raise Failure("conflict marker", k)
            i, last = k + 1, k
            continue
        quote = what.lstrip("rRbBuUfFtT")
        if what[0] == "#":
            i = m.end()
        elif quote in ('"""', "'''"):
            e = PY_LONG[quote].match(text, m.end())
            if not e:
                raise Failure("unterminated literal", k)
            i = e.end()
            out.append('""')
        elif quote in ('"', "'"):
            i = skip_string(text, m.end(), quote, False)
            out.append('""')
        elif what in "([{":
            stack.append((what, k))
            out.append(what)
            i = m.end()
        elif what in ")]}":
            if not stack or stack.pop()[0] != CLOSES[what]:
                raise Failure("unbalanced delimiter", k)
            out.append(what)
            i = m.end()
        else:  # letters before a quote that form no prefix: the quote opens a plain literal
            i = skip_string(text, m.end(), what[-1], False)
            out.append(what[:-1] + ' ""')
        last = i
    out.append(text[last:])
    return "".join(out), stack


RB_TOKEN = re.compile(
    r"^=begin\b|^__END__$|\#(?!\{)[^\n]*|<<[~-]?(?:\"(?P<h1>[A-Z_a-z]\w*)\"|'(?P<h2>[A-Z_a-z]\w*)'|(?P<h3>[A-Z_][A-Z_0-9]*))|%[wWiIqQrx]?[\[({<|!](?=\S|\s)|\"|'|`|/|[()\[\]{}]|\?[^\w\s](?!\w)|:\"|"
    r"(?<![\w.:@$?!])(?:class|module|def|begin|do|case|if|unless|while|until|for|end)(?![\w?!:])|^(?=[<>|=]{7})|\}",
    re.M,
)
RB_STATEMENT = re.compile(r"(?:^|[\n;=(\[{|&,>!]|\b(?:do|then|else|begin|and|or|not|=>|->))[ \t]*$")
RB_PAIR = {"(": ")", "[": "]", "{": "}", "<": ">"}


def lex_ruby(text: str) -> tuple[str, list]:
    out, stack, i, last = [], [], 0, 0
    waiting: list[str] = []  # here-documents that begin after this line
    loops = 0

    def interpolated(at: int, quote: str, opened: int) -> int:
        """A double-quoted literal, with #{...} inside."""
        depth = 0
        pattern = re.compile(rf"\\.|\#\{{|{re.escape(quote)}|[{{}}]", re.S)
        while m := pattern.search(text, at):
            at = m.end()
            if m[0] == "#{":
                depth += 1
            elif m[0] == "}" and depth:
                depth -= 1
            elif m[0] == "{" and depth:
                depth += 1
            elif m[0] == quote and not depth:
                return at
        raise Failure("unterminated literal", opened)

    def delimited(at: int, opener: str, opened: int) -> int:
        closer = RB_PAIR.get(opener, opener)
        depth = 1
        pattern = re.compile(rf"\\.|{re.escape(opener)}|{re.escape(closer)}", re.S)
        while m := pattern.search(text, at):
            at = m.end()
            if m[0] == closer:
                depth -= 1
                if not depth:
                    return at
            elif m[0] == opener:
                depth += 1
        raise Failure("unterminated literal", opened)

    while m := RB_TOKEN.search(text, i):
        k, what = m.start(), m[0]
        if waiting and "\n" in text[i:k]:
            at = text.index("\n", i) + 1
            out.append(text[last:at])
            for name in waiting:
                e = re.compile(rf"^[ \t]*{name}[ \t\r]*$", re.M).search(text, at)
                if not e:
                    raise Failure("unterminated literal", at)
                at = e.end()
            waiting = []
            i = last = at
            continue
        out.append(text[last:k])
        i = m.end()
        if what == "":
            if CONFLICT.match(text, k):
                raise Failure("conflict marker", k)
            i, last = k + 1, k
            continue
        if what == "=begin":
            e = re.compile(r"^=end\b[^\n]*", re.M).search(text, i)
            if not e:
                raise Failure("unterminated comment", k)
            i = e.end()
        elif what == "__END__":
            last = i = len(text)
            break
        elif what[0] == "#":
            pass
        elif what[:2] == "<<":
            name = m["h1"] or m["h2"] or m["h3"]
            waiting.append(name)
            out.append('""')
        elif what[0] == "%" and len(what) > 1 and (what[1].isalpha() or RB_STATEMENT.search("".join(out[-2:])[-40:])):
            i = delimited(i, what[-1], k)
            out.append('""')
        elif what[0] == "%":
            i = k + 1
            out.append("%")
        elif what in ('"', "`", ':"'):
            i = interpolated(i, what[-1], k)
            out.append('""')
        elif what == "'":
            i = skip_string(text, i, "'", True)
            out.append('""')
        elif what[0] == "?":
            out.append("0" if len(what) == 2 and RB_STATEMENT.search("".join(out[-2:])[-40:]) else what)
            if out[-1] == what:
                i = k + 1
                out[-1] = "?"
        elif what == "/":
            r = SLASH_REGEX.match(text, k)
            if r and RUBY_REGEX_BEFORE.search("".join(out[-3:])[-60:]):
                i = r.end()
                out.append('""')
            else:
                out.append("/")
        elif what in "([{":
            stack.append((what, k))
            out.append(what)
        elif what in ")]}":
            if not stack or stack.pop()[0] != CLOSES[what]:
                raise Failure("unbalanced delimiter", k)
            out.append(what)
        else:
            before = "".join(out[-3:])[-80:]
            out.append(what)
            if what in ("class", "module", "def", "begin", "case"):
                line = text[k : (text.find("\n", k) + 1 or len(text) + 1) - 1]
                if what == "def" and re.match(r"def\s+[\w.]+[?!]?(?:\([^)]*\))?\s*=(?!=)", line):
                    pass  # a method without an end
                elif what == "class" and re.search(r"\.\s*$", before):
                    pass
                else:
                    stack.append((what, k))
            elif what in ("if", "unless", "while", "until", "for"):
                if RB_STATEMENT.search(before) or not before.strip():
                    stack.append((what, k))
                    loops += what in ("while", "until", "for")
            elif what == "do":
                start = text.rfind("\n", 0, k) + 1
                if re.match(r"\s*(?:while|until|for)\b", text[start:k]) and stack and stack[-1][0] in ("while", "until", "for") and stack[-1][1] >= start:
                    pass  # belongs to the loop
                else:
                    stack.append(("do", k))
            elif what == "end":
                if not stack or stack.pop()[0] in "([{":
                    raise Failure("unbalanced delimiter", k)
        last = i
    if waiting:
        at = text.find("\n", last)
        for name in waiting:
            e = re.compile(rf"^[ \t]*{name}[ \t\r]*$", re.M).search(text, at) if at >= 0 else None
            if not e:
                raise Failure("unterminated literal", last)
            at = e.end()
        last = at
    out.append(text[last:])
    return "".join(out), stack


LEXERS = {k: (lambda text, k=k: lex_braces(text, k)) for k in BRACE_TOKEN} | {"python": lex_python, "ruby": lex_ruby}

OTHERWISE = re.compile(r"^[ \t]*#[ \t]*el(?:se|if)\b.*?(?=^[ \t]*#[ \t]*endif\b)", re.M | re.S)
SETTING = re.compile(r"^[ \t]*[\w-]+: +[^\n{;(,]+$\n^[ \t]*[\w-]+:(?: |$)", re.M)


def judge(path: str | None, content: str | None) -> tuple[str, str | None, int]:
    """(language, kind of failure or None, line from 1)."""
    extension = (path or "").rsplit(".", 1)[-1].lower()
    language = LANGUAGE_OF.get(extension)
    if language is None or not content or not content.strip():
        return language or "", None, 0
    text = content.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    line = lambda at: text.count("\n", 0, at) + 1
    if text.startswith("#!") and language != "rust":
        text = text[text.find("\n") if "\n" in text else len(text) :]
    try:
        code, open_ = lex(text, language)
        if open_ and language == "c" and OTHERWISE.search(text):
            raise Failure("premature end", open_[-1][1])
    except Failure as e:
        if language != "c" or e.args[0] == "conflict marker" or not OTHERWISE.search(text):
            return language, e.args[0], line(e.args[1])
        try:  # brackets may be balanced in each branch of a conditional only: take the first
            code, open_ = lex(OTHERWISE.sub(lambda m: "\n" * m[0].count("\n"), text), language)
        except Failure:
            return language, e.args[0], line(e.args[1])
    if not code.strip():
        return language, None, 0
    if open_:
        return language, "premature end", line(open_[-1][1])
    if language != "python" and not re.search(r"[;{}()]", code) and (m := SETTING.search(code)):
        return language, "foreign construct", code.count("\n", 0, m.start()) + 1
    kind = grammar.failure(code, language)
    return language, kind, text.count("\n") + 1 if kind == "premature end" else 1 if kind else 0


def judge_files(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, language, failure, line): a row per row of files(file_id, repo, path, content). A narrow map."""
    id_type = files.schema["file_id"].dataType.simpleString()
    names = ["file_id", "repo", "language", "failure", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [judge(p, c) for p, c in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int32())], names=names
                )

    return files.select("file_id", "repo", "path", "content").mapInArrow(run, f"file_id {id_type}, repo string, language string, failure string, line int")


def unparsable(files: DataFrame) -> DataFrame:
    """(file_id): files that don't parse. Only ids are shuffled, to make redelivered rows one."""
    return judge_files(files).where("failure is not null").select("file_id").distinct()


def failure_rates(files: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_failed, rate), each file once."""
    once = judge_files(files).where("language <> ''").groupBy("file_id", "repo", "language").agg(F.max(F.col("failure").isNotNull().cast("int")).alias("failed"))
    return once.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.sum("failed").alias("n_failed"), F.avg("failed").alias("rate"))
