"""Edits of source files that check what they were made for: by line hashes, by symbols and their hashes, at positions, and renames.

An edit names what it expects to find; if that isn't there any more, the result says so and the file stays as it is. Edits of one file
are applied in the order of their numbers by the task that holds the file; files are independent.

Defined results: files without requests aren't touched; requests for unknown files give FILE_NOT_FOUND; null contents count as empty;
equal requests under several numbers are applied one after the other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import code as C


class Refused(Exception):
    """An edit that doesn't fit: its code and message."""


def short(text: str, length: int = 4) -> str:
    return hashlib.sha256(text.replace("\r\n", "\n").strip().encode()).hexdigest()[:length]


def line_hash(number: int, line: str) -> str:
    return short(f"{number}:{line}")


def edit_lines(text: str, edits: Sequence[dict]) -> str:
    """Edits {hash, replace | delete, after, before} of lines named by the hash of their number and text; hashes are those after the edits
    before, so later edits see moved lines under new numbers."""
    lines = text.split("\n")
    ends = text.endswith("\n")
    if ends:
        lines.pop()
    for e in edits:
        at = next((k for k, x in enumerate(lines) if line_hash(k + 1, x) == e["hash"]), None)
        if at is None:
            raise Refused("STALE_READ", f"no line has the hash {e['hash']}")
        if e.get("delete"):
            del lines[at]
        elif e.get("replace") is not None:
            lines[at] = e["replace"]
        if e.get("after") is not None:
            lines.insert(at if e.get("delete") else at + 1, e["after"])
        if e.get("before") is not None:
            lines.insert(at, e["before"])
    return "\n".join(lines) + ("\n" if ends else "")


def with_imports(text: str, imports: Sequence[str]) -> str:
    """Import statements that the text hasn't yet, behind its last one."""
    lines = text.split("\n")
    last = max((k for k, x in enumerate(lines) if x.strip().startswith(("import ", "import{"))), default=-1)
    have = {x.strip() for x in lines if x.strip().startswith("import ")}
    new = [x for x in (i if i.startswith("import ") else f"import {i}" for i in imports) if x.strip() not in have]
    return "\n".join([*lines[: last + 1], *new, *lines[last + 1 :]]) if new else text


def summary(old: str, new: str) -> tuple[str, int]:
    """(differing lines, old under - and new under +; how many places differ), line by line."""
    a, b = old.split("\n"), new.split("\n")
    out, n = [], 0
    for k in range(max(len(a), len(b))):
        x, y = (a[k] if k < len(a) else None), (b[k] if k < len(b) else None)
        if x != y:
            n += 1
            out += [f"-{x}"] * (x is not None) + [f"+{y}"] * (y is not None)
    return "\n".join(out), n


def locate(text: str, language: str, name: str, expected: str | None = None) -> tuple[int, int]:
    """Offsets of the first symbol of a name, or of the one with the expected hash: whole lines, without the last line's end."""
    lines = text.split("\n")
    found = [(a, b) for _, n, _, a, b in C.outline(text, language) if n == name]
    if not found:
        raise Refused("SYMBOL_NOT_FOUND", f"no symbol {name}")
    for a, b in found:
        if expected is None or short("\n".join(lines[a - 1 : b])) == expected:
            start = sum(len(x) + 1 for x in lines[: a - 1])
            return start, start + sum(len(x) + 1 for x in lines[a - 1 : b]) - 1
    raise Refused("STALE_READ", f"no symbol {name} has the hash {expected}")


def patch(text: str, language: str, symbol: str, expected: str | None, body: str | None = None, edits: Sequence[dict] = (), imports: Sequence[str] = ()) -> str:
    start, end = locate(text, language, symbol, expected)
    made = body if body is not None else edit_lines(text[start:end], edits)
    return with_imports(text[:start] + made + text[end:], imports)


def patch_all(text: str, language: str, patches: Sequence[tuple[str, str | None, str]], imports: Sequence[str] = ()) -> str:
    """Several symbols at once: all are found in the text as it was, then replaced from the last to the first."""
    places = sorted(((*locate(text, language, name, expected), body) for name, expected, body in patches), reverse=True)
    for start, end, body in places:
        text = text[:start] + body + text[end:]
    return with_imports(text, imports)


def insert(text: str, language: str, position: str, body: str, expected: str | None = None, imports: Sequence[str] = ()) -> str:
    """At start-of-file, end-of-file, after-imports, after:<symbol> or before:<symbol>."""
    kind, _, name = position.partition(":")
    if position == "start-of-file":
        at = 0
    elif position == "end-of-file":
        at = len(text)
    elif position == "after-imports":
        lines = text.split("\n")
        last = max((k for k, x in enumerate(lines) if x.strip().startswith(("import ", "import{"))), default=-1)
        at = sum(len(x) + 1 for x in lines[: last + 1])
    elif kind in ("after", "before") and name:
        at = locate(text, language, name, expected)[kind == "after"]
    else:
        raise Refused("PARSE_ERROR", f"no position {position}")
    made = f"{body}\n{text}" if at == 0 else f"{text}\n{body}\n" if at >= len(text) else f"{text[:at]}\n{body}\n{text[at:]}"
    return with_imports(made, imports)


REQUEST = "request int, op string, symbol string, expected string, position string, body string, edits array<struct<hash:string,replace:string,after:string,before:string,delete:boolean>>, imports array<string>"


def apply(files: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(file_id, columns of REQUEST; op is patch, lines or insert) on files(file_id, path, content), in the order of their numbers:
    (file_id, request, ok, code, message, diff, n_changed, content); content is the file after the request. A request that is refused leaves the
    file to the next one."""
    asked = requests.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*[c.split()[0] for c in REQUEST.split(", ")]))).alias("asked"))
    known = files.select("file_id", F.coalesce(T.language_of(F.col("path")), F.lit("")).alias("language"), F.coalesce("content", F.lit("")).alias("content"), F.lit(True).alias("known"))
    joined = asked.join(known, "file_id", "left")
    names = ["file_id", "request", "ok", "code", "message", "diff", "n_changed", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, todo, language, text, exists in zip(*(c.to_pylist() for c in batch.columns)):
                for r in todo:
                    try:
                        if not exists:
                            raise Refused("FILE_NOT_FOUND", "no such file")
                        more = r["imports"] or ()
                        if r["op"] == "insert":
                            made = insert(text, language, r["position"] or "", r["body"] or "", r["expected"], more)
                        elif r["op"] == "lines":
                            made = with_imports(edit_lines(text, r["edits"] or ()), more)
                        elif r["op"] == "patch":
                            made = patch(text, language, r["symbol"] or "", r["expected"], r["body"], r["edits"] or (), more)
                        else:
                            raise Refused("PARSE_ERROR", f"no operation {r['op']}")
                        diff, n = summary(text, made)
                        rows.append((file_id, r["request"], True, None, None, diff, n, made))
                        text = made
                    except Refused as e:
                        rows.append((file_id, r["request"], False, e.args[0], e.args[1], None, 0, text))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [batch.schema.field(0).type, pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    id_type = requests.schema["file_id"].dataType.simpleString()
    return joined.select("file_id", "asked", "language", "content", "known").mapInArrow(run, f"file_id {id_type}, request int, ok boolean, code string, message string, diff string, n_changed int, content string")


def rename(files: DataFrame, old: str, new: str, definition: int | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """(file_id, path, n_references, n_lines, defines, content): files in which a whole word is another. scope: globs of paths; the file of the
    definition belongs to it in any case. A new name that is no name changes nothing."""
    from tessera.sources.files import matches

    if not re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", new):
        return files.select("file_id", "path", F.lit(0).cast("long").alias("n_references"), F.lit(0).cast("long").alias("n_lines"), F.lit(False).alias("defines"), "content").limit(0)
    word = rf"(?<![A-Za-z0-9_]){re.escape(old)}(?![A-Za-z0-9_])"
    wanted = files.where(F.col("content").contains(old))
    if scope:
        path = F.regexp_replace("path", r"^\./", "")
        wanted = wanted.where(matches(path, scope) | (F.col("file_id") == definition if definition is not None else F.lit(False)))
    counted = wanted.withColumn("n_references", F.regexp_count("content", F.lit(word)).cast("long")).where("n_references > 0")
    lines = F.size(F.filter(F.split("content", "\n", -1), lambda x: x.rlike(word))).cast("long")
    return counted.select("file_id", "path", "n_references", lines.alias("n_lines"), (F.col("file_id") == definition if definition is not None else F.lit(False)).alias("defines"), F.regexp_replace("content", word, new.replace("$", r"\$")).alias("content"))
