"""Markdown as a tree of blocks: parsing, rendering, a compact notation that expands again, phrase dictionaries and extracts.

A document is parsed by one task, many in Arrow batches. A block is a dict with its `kind`: heading (depth, text), paragraph (text),
list (ordered, start, spread, items: dicts with checked and blocks), table (rows of cells), code (lang, text), break, html (text),
quote (blocks). Text keeps its inline marks.

Defined results: null documents give no rows, empty ones an empty tree; unclosed fences end with the document; line ends are made alike;
a table needs its row of dashes; a dictionary mark that a text already holds is never given out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

VERSION = "%ctx:1"  # fixed value: the marker of the compact notation
MAX_CHARS, MAX_ITEMS, MAX_ROWS = 200, 3, 2  # fixed values: what an extract keeps of a paragraph, a list, a table
MARK_COST, LONG_WORD = 2, 10  # fixed values: tokens of a dictionary mark, least length of a word worth one

FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})([^`\n]*)$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"( *)([-*+]|(\d{1,9})[.)])(?:[ \t]+(?=\S)|$)")
CHECK = re.compile(r"\[([ xX])\](?:[ \t]+|$)")
DASHES = re.compile(r" {0,3}\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
HTML = re.compile(r" {0,3}<(?:!--|[A-Za-z/!?])")
UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*$")


def cells(line: str) -> list[str]:
    parts = re.split(r"(?<!\\)\|", line.strip())
    if parts and not parts[0].strip():
        parts = parts[1:]
    if parts and not parts[-1].strip():
        parts = parts[:-1]
    return [p.strip() for p in parts]


def parse(text: str) -> list[dict]:
    return blocks_of(text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n"))


def starts_block(line: str) -> bool:
    return bool(FENCE.match(line) or ATX.match(line) or BREAK.match(line) or line.lstrip().startswith(">"))


def blocks_of(lines: Sequence[str]) -> list[dict]:
    out: list[dict] = []
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := FENCE.match(line):
            close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            j = i + 1
            while j < n and not close.match(lines[j]):
                j += 1
            pad = len(m[1])
            out.append({"kind": "code", "lang": m[3].strip(), "text": "\n".join(x[min(pad, len(x) - len(x.lstrip(" "))) :] for x in lines[i + 1 : j])})
            i = j + 1
        elif m := ATX.match(line):
            out.append({"kind": "heading", "depth": len(m[1]), "text": (m[2] or "").strip()})
            i += 1
        elif BREAK.match(line):
            out.append({"kind": "break"})
            i += 1
        elif line.lstrip().startswith(">") and len(line) - len(line.lstrip()) < 4:
            j = i
            while j < n and lines[j].strip() and (lines[j].lstrip().startswith(">") or not (starts_block(lines[j]) or ITEM.match(lines[j]))):
                j += 1
            out.append({"kind": "quote", "blocks": blocks_of([re.sub(r"^ {0,3}> ?", "", x) for x in lines[i:j]])})
            i = j
        elif (m := ITEM.match(line)) and len(m[1]) < 4:
            made, i = list_of(lines, i)
            out.append(made)
        elif line.startswith("    "):
            j = i
            while j < n and (lines[j].startswith("    ") or not lines[j].strip()):
                j += 1
            while not lines[j - 1].strip():
                j -= 1
            out.append({"kind": "code", "lang": "", "text": "\n".join(x[4:] for x in lines[i:j])})
            i = j
        elif HTML.match(line):
            j = i
            if line.lstrip().startswith("<!--"):
                while j < n - 1 and "-->" not in lines[j]:
                    j += 1
                j += 1
            else:
                while j < n and lines[j].strip():
                    j += 1
            out.append({"kind": "html", "text": "\n".join(lines[i:j])})
            i = j
        elif "|" in line and i + 1 < n and "-" in lines[i + 1] and DASHES.match(lines[i + 1]) and len(cells(lines[i + 1])) == len(cells(line)):
            rows, j = [cells(line)], i + 2
            while j < n and lines[j].strip() and not starts_block(lines[j]):
                row = cells(lines[j])
                rows.append((row + [""] * len(rows[0]))[: len(rows[0])])
                j += 1
            out.append({"kind": "table", "rows": rows})
            i = j
        else:
            j = i + 1
            made = None
            while j < n and lines[j].strip():
                if m := UNDER.match(lines[j]):
                    made = {"kind": "heading", "depth": 1 if m[1][0] == "=" else 2, "text": " ".join(x.strip() for x in lines[i:j])}
                    break
                m = ITEM.match(lines[j])
                if starts_block(lines[j]) or (m and len(m[1]) < 4 and m[3] in (None, "1") and lines[j].strip() not in "-*+") or HTML.match(lines[j]):
                    break
                j += 1
            out.append(made or {"kind": "paragraph", "text": "\n".join(x.strip() for x in lines[i:j])})
            i = j + 1 if made else j
    return out


def list_of(lines: Sequence[str], i: int) -> tuple[dict, int]:
    """The list that begins at line i, and the line after it."""
    m = ITEM.match(lines[i])
    sign = m[2][-1]
    made = {"kind": "list", "ordered": m[3] is not None, "start": int(m[3] or 1), "spread": False, "items": []}
    n = len(lines)
    while i < n and (m := ITEM.match(lines[i])) and m[2][-1] == sign and not BREAK.match(lines[i]):
        width = len(m[0]) if lines[i][len(m[0]) :].strip() else len(m[1]) + len(m[2]) + 1
        if len(m[0]) - len(m[1]) - len(m[2]) > 4:
            width = len(m[1]) + len(m[2]) + 1
        body, j, blank = [lines[i][width:]], i + 1, False
        while j < n:
            x = lines[j]
            if not x.strip():
                blank = True
                body.append("")
            elif len(x) - len(x.lstrip(" ")) >= width:
                body.append(x[width:])
                blank = False
            elif blank or ITEM.match(x) or starts_block(x):
                break
            else:
                body.append(x.strip())
            j += 1
        while body and not body[-1].strip() and len(body) > 1:
            body.pop()
        checked = None
        if c := CHECK.match(body[0]):
            checked, body[0] = c[1] in "xX", body[0][c.end() :]
        made["items"].append({"checked": checked, "blocks": blocks_of(body)})
        gap = j > i + len(body)
        more = j < n and (m2 := ITEM.match(lines[j])) is not None and m2[2][-1] == sign and not BREAK.match(lines[j])
        made["spread"] |= gap and more
        i = j
    return made, i


# --- rendering ---


def render(blocks: Sequence[dict]) -> str:
    parts, before = [], None
    for b in blocks:
        if before and before["kind"] == "list" == b["kind"] and before["ordered"] == b["ordered"]:
            parts.append("<!-- -->")
        parts.append(render_block(b))
        before = b
    return "\n\n".join(p for p in parts if p != "")


def render_block(b: dict) -> str:
    kind = b["kind"]
    if kind == "heading":
        return f"{'#' * b['depth']} {b['text']}".rstrip()
    if kind == "code":
        fence = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", b["text"])), default=0))
        return f"{fence}{b['lang']}\n{b['text']}\n{fence}" if b["text"] else f"{fence}{b['lang']}\n{fence}"
    if kind == "break":
        return "---"
    if kind == "quote":
        return "\n".join(("> " + x).rstrip() for x in render(b["blocks"]).split("\n"))
    if kind == "table":
        head, *rows = b["rows"]
        return "\n".join(["| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |", *("| " + " | ".join(r) + " |" for r in rows)])
    if kind == "list":
        out = []
        for k, item in enumerate(b["items"]):
            mark = f"{b['start'] + k}. " if b["ordered"] else "- "
            body = (("[x] " if item["checked"] else "[ ] ") if item["checked"] is not None else "") + render_item(item["blocks"], b["spread"])
            out.append((mark + body.replace("\n", "\n" + " " * len(mark))).rstrip())
        text = ("\n\n" if b["spread"] else "\n").join(out)
        return re.sub(r"(?m)^ +$", "", text)
    return b["text"]


def render_item(blocks: Sequence[dict], spread: bool) -> str:
    parts = [render_block(x) for x in blocks]
    if spread or any(x["kind"] not in ("paragraph", "list") for x in blocks):
        return "\n\n".join(parts)
    return "\n".join(parts)


# --- the compact notation ---


def needs_quotes(value: str, delimiter: str) -> bool:
    return delimiter in value or "\n" in value or '"' in value


def csv_row(values: Sequence[str], delimiter: str = ",") -> str:
    return f"{delimiter} ".join('"' + v.replace('"', '""') + '"' if needs_quotes(v, delimiter) else v for v in values)


def parse_csv_row(line: str, delimiter: str = ",") -> list[str]:
    """Cells of a line, trimmed. Between its quotes a line lies outside and inside by turns; nothing outside between two insides is a quote."""
    made, parts = [""], line.split('"')
    for k, part in enumerate(parts):
        if k % 2:
            made[-1] += part
        elif not part and 0 < k < len(parts) - 1:
            made[-1] += '"'
        else:
            first, *more = part.split(delimiter)
            made[-1] += first
            made += more
    return [x.strip() for x in made]


def is_comment(b: dict) -> bool:
    return b["kind"] == "html" and bool(re.fullmatch(r"<!--[\s\S]*-->", b["text"].strip()))


def flat_list(b: dict, depth: int = 0) -> list[str] | None:
    """Lines of a list whose items hold paragraphs and lists only; None for any other."""
    out: list[str] = []
    for k, item in enumerate(b["items"]):
        if any(x["kind"] not in ("paragraph", "list") for x in item["blocks"]):
            return None
        if k and b["spread"]:
            out.append("")
        text = " ".join(x["text"].replace("\n", " ").strip() for x in item["blocks"] if x["kind"] == "paragraph").strip()
        mark = f"[{'x' if item['checked'] else ''}]" if item["checked"] is not None else "+" if b["ordered"] else "-"
        out.append(f"{'..' * depth}{mark} {text}".rstrip())
        for x in item["blocks"]:
            if x["kind"] == "list":
                inner = flat_list(x, depth + 1)
                if inner is None:
                    return None
                out += inner
    return out


def compact(blocks: Sequence[dict], delimiter: str = ",", comments: bool = False, dictionary: Sequence[tuple[str, str]] = (), version: bool = False) -> str:
    """Blocks of one line each follow each other without blank lines; list items have dots for their depth, tables are rows of values."""
    chunks: list[tuple[str, bool]] = []
    for b in blocks:
        kind = b["kind"]
        if is_comment(b) and not comments:
            continue
        if kind == "heading":
            chunks.append((f"{'#' * b['depth']} {' '.join(b['text'].split(chr(10)))}".rstrip(), True))
        elif kind == "list":
            lines = flat_list(b)
            text = render_block(b).strip() if lines is None else "\n".join(lines)
            if text:
                chunks.append((text, False))
        elif kind == "table":
            head, *rows = b["rows"]
            chunks.append(("\n".join([f"|: {csv_row(head, delimiter)}", *(f"| {csv_row(r, delimiter)}" for r in rows)]), True))
        elif kind == "code":
            chunks.append((render_block(b), True))
        elif kind == "break":
            chunks.append(("---", True))
        elif text := render_block(b).strip():
            chunks.append(("\n".join("\\" + x if re.match(r":[1-6](?:\s|$)", x) else x for x in text.split("\n")), False))
    out = chunks[0][0] if chunks else ""
    for (_, before), (text, own) in zip(chunks, chunks[1:]):
        out += ("\n" if before and own else "\n\n") + text
    out = out.rstrip()
    if dictionary:
        entries = "\n".join(f"{mark}={value}" for mark, value in dictionary)
        out = f"{entries}\n§§\n{out}" if out else f"{entries}\n§§"
    return (f"{VERSION}\n\n{out}" if out else VERSION) if version else out


LIST_LINE = re.compile(r"((?:\.\.)*)(-|\+|\[[xX]?\])(?:\s+(.*))?$")
ENTRY = re.compile(r"(§\d+)=(.*)$")
DICTIONARY = re.compile(r"(?:§\d+=.*\n)+§§(?:\n|\Z)")
SHORT_HEAD = re.compile(r":([1-6])\s+(.*)$")


def undone(text: str) -> str:
    """The body of a compact text: without its version and dictionary, with phrases in place of their marks, longer marks first."""
    text = text.replace("\r\n", "\n")
    if text == VERSION or text.startswith(VERSION + "\n"):
        text = text[len(VERSION) :].lstrip("\n")
    m = DICTIONARY.match(text)
    if not m:
        return text
    phrases = dict(ENTRY.match(x).groups() for x in m[0].split("\n") if x.startswith("§") and x != "§§")
    return re.sub(r"§\d+", lambda k: phrases.get(k[0]) or next((phrases[k[0][:n]] + k[0][n:] for n in range(len(k[0]) - 1, 1, -1) if k[0][:n] in phrases), k[0]), text[m.end() :])


def nested(rows: Sequence[tuple[int, str, str, bool]]) -> list[dict]:
    """Lists from rows (depth, mark, text, whether a blank line stands before): a row belongs to the list of its depth and kind, deeper rows to
    the item before them."""
    out: list[dict] = []
    k = 0
    while k < len(rows):
        depth, sign, said, gap = rows[k]
        deeper = next((n for n in range(k + 1, len(rows)) if rows[n][0] <= depth), len(rows))
        ordered = sign == "+"
        if not out or out[-1]["ordered"] != ordered:
            out.append({"kind": "list", "ordered": ordered, "start": 1, "spread": False, "items": []})
        elif gap:
            out[-1]["spread"] = True
        own = blocks_of([said]) if said else []
        out[-1]["items"].append({"checked": sign.lower() == "[x]" if sign[0] == "[" else None, "blocks": own + nested(rows[k + 1 : deeper])})
        k = deeper
    return out


def expand(text: str, delimiter: str = ",") -> list[dict]:
    """The blocks of a compact text. Runs of list lines and of table rows become blocks of their own; all else is Markdown already."""
    lines = undone(text).split("\n")
    out: list[dict] = []
    plain: list[str] = []
    fence = None

    def settle(*made: dict) -> None:
        out.extend(blocks_of(plain))
        plain.clear()
        out.extend(made)

    k = 0
    while k < len(lines):
        line = lines[k]
        m = FENCE.match(line)
        if fence or m:  # code is taken as it stands, up to the fence that closes it
            fence = (m[2] if m and not fence else fence) if not (fence and m and m[2].startswith(fence) and not m[3].strip()) else None
            plain.append(line)
        elif line.startswith("|:"):
            end = k + 1
            while end < len(lines) and lines[end].startswith("| "):
                end += 1
            rows = [parse_csv_row(x[2:].strip(), delimiter) for x in lines[k:end]]
            settle({"kind": "table", "rows": rows})
            k = end - 1
        elif LIST_LINE.match(line) and not (plain and plain[-1].strip()):  # a list stands apart from what is before it
            rows, gap, end, own = [], False, k, False
            for n in range(k, len(lines)):
                if m := LIST_LINE.match(lines[n]):
                    rows.append((len(m[1]) // 2, m[2], (m[3] or "").strip(), gap))
                    end, gap = n, False
                elif lines[n].strip():
                    own = lines[n][0] == " "  # a list with blocks in its items stands as Markdown, indented
                    break
                else:
                    gap = True
            if own:
                plain.extend(lines[k : end + 1])
            else:
                settle(*nested(rows))
            k = end
        elif m := SHORT_HEAD.match(line):
            settle({"kind": "heading", "depth": int(m[1]), "text": m[2].strip()})
        elif line.strip() == "~":
            settle({"kind": "break"})
        else:
            plain.append(line[1:] if line.startswith("\\:") else line)
        k += 1
    settle()
    return out


# --- phrases ---


def estimate(value: str) -> int:
    """A word of up to 7 letters is a token, of up to 10 two, a longer one its length over 5 rounded up; 1 at least."""
    return max(1, sum(1 if len(w) <= 7 else 2 if len(w) <= 10 else math.ceil(len(w) / 5) for w in value.split()))


def texts_of(blocks: Sequence[dict]) -> Iterator[str]:
    for b in blocks:
        if b["kind"] in ("heading", "paragraph"):
            yield b["text"]
        elif b["kind"] == "quote":
            yield from texts_of(b["blocks"])
        elif b["kind"] == "list":
            for item in b["items"]:
                yield from texts_of(item["blocks"])
        elif b["kind"] == "table":
            for row in b["rows"]:
                yield from row


def candidates(values: Sequence[str]) -> list[tuple[str, int, int]]:
    """(phrase, occurrences, cost): phrases of 5 to 2 words within sentences and long words that occur twice or more and cost more than a mark,
    none within an accepted one; the largest savings first."""
    sentences = [s.split() for v in ["\n".join(values)] for s in re.split(r"[.!?\n]+", v)]
    found: list[tuple[str, int, int]] = []
    accepted = ""
    for n in (5, 4, 3, 2):
        counts: Counter = Counter(" ".join(words[i : i + n]) for words in sentences for i in range(len(words) - n + 1))
        for phrase, times in counts.items():
            if times >= 2 and (cost := estimate(phrase)) > MARK_COST and phrase not in accepted:
                accepted += "\x00" + phrase
                found.append((phrase, times, cost))
    words = Counter(w for v in values for w in re.findall(r"[A-Za-z0-9@._/-]+", v) if len(w) >= LONG_WORD)
    for word, times in words.items():
        if times >= 2 and (cost := estimate(word)) > MARK_COST and word not in accepted:
            accepted += "\x00" + word
            found.append((word, times, cost))
    return sorted(found, key=lambda x: -(x[2] - MARK_COST) * x[1])


def dictionary_of(blocks: Sequence[dict]) -> list[tuple[str, str]]:
    """(mark, phrase): the phrases whose replacement pays for their line in the dictionary."""
    values = list(texts_of(blocks))
    whole = "\n".join(values) + render(blocks)
    entries: list[tuple[str, str]] = []
    number = 1
    for phrase, times, cost in candidates(values):
        while f"§{number}" in whole:
            number += 1
        mark = f"§{number}"
        if (cost - MARK_COST) * times > estimate(f"{mark}={phrase}\n"):
            entries.append((mark, phrase))
        number += 1
    return entries


def replaced(blocks: Sequence[dict], entries: Sequence[tuple[str, str]]) -> list[dict]:
    """Blocks with phrases replaced by their marks, the longest first."""
    order = sorted(entries, key=lambda e: -len(e[1]))

    def said(text: str) -> str:
        for mark, phrase in order:
            text = text.replace(phrase, mark)
        return text

    out = []
    for b in blocks:
        b = dict(b)
        if "text" in b:
            b["text"] = said(b["text"])
        if b["kind"] == "quote":
            b["blocks"] = replaced(b["blocks"], entries)
        elif b["kind"] == "list":
            b["items"] = [{**item, "blocks": replaced(item["blocks"], entries)} for item in b["items"]]
        elif b["kind"] == "table":
            b["rows"] = [[said(c) for c in row] for row in b["rows"]]
        out.append(b)
    return out


# --- sections and extracts ---


def ranges(blocks: Sequence[dict]) -> list[tuple[int, int, int, str]]:
    """(depth, first block, block after the last, heading) of each section: up to the next heading that isn't deeper."""
    heads = [(k, b["depth"], b["text"]) for k, b in enumerate(blocks) if b["kind"] == "heading"]
    return [(depth, k, next((k2 for k2, d2, _ in heads if k2 > k and d2 <= depth), len(blocks)), text) for k, depth, text in heads]


def elide(blocks: list[dict], only: Sequence[str] = (), strip: Sequence[str] = ()) -> list[dict]:
    """Only the sections whose heading holds a query, or all but those; both at once is an error, a document without headings stays."""
    only, strip = ([q.strip().lower() for q in x if q.strip()] for x in (only, strip))
    if only and strip:
        raise ValueError("sections to keep and sections to strip exclude each other")
    found = ranges(blocks)
    if not found or not (only or strip):
        return blocks
    hit = [(a, b) for _, a, b, text in found if any(q in text.strip().lower() for q in only or strip)]
    inside = [any(a <= k < b for a, b in hit) for k in range(len(blocks))]
    return [b for b, x in zip(blocks, inside) if x == bool(only)]


def limit(value: float | None, default: int) -> int:
    return default if value is None or math.isnan(value) else max(0, math.floor(value))


def shortened(text: str, most: int) -> str:
    if most <= 0:
        return "..."
    if len(text) <= most:
        return text
    head = text[:most].rstrip()
    return f"{head} ..." if head else "..."


def extract(blocks: Sequence[dict], chars: float | None = None, items: float | None = None, rows: float | None = None) -> list[dict]:
    """The first characters of each paragraph, the first items of each list, the first rows of each table, with how many more there are."""
    chars_, items_, rows_ = limit(chars, MAX_CHARS), limit(items, MAX_ITEMS), limit(rows, MAX_ROWS)
    out = []
    for b in blocks:
        b = dict(b)
        if b["kind"] == "paragraph":
            b["text"] = shortened(b["text"], chars_)
        elif b["kind"] == "quote":
            b["blocks"] = extract(b["blocks"], chars, items, rows)
        elif b["kind"] == "list":
            more = len(b["items"]) - items_
            b["items"] = [{**item, "blocks": extract(item["blocks"], chars, items, rows)} for item in b["items"][:items_]]
            if more > 0:
                b["items"].append({"checked": None, "blocks": [{"kind": "paragraph", "text": f"... {more} more items"}]})
        elif b["kind"] == "table" and len(b["rows"]) - 1 > rows_:
            more = len(b["rows"]) - 1 - rows_
            b["rows"] = [*b["rows"][: rows_ + 1], [f"... {more} more rows", *[""] * (len(b["rows"][0]) - 1)]]
        out.append(b)
    return out


def round_trip(text: str, **options) -> tuple[bool, int | None, str | None, str | None]:
    """(whether compacting and expanding gives the document back, the first line that differs, what it should be, what it is)."""
    tree = [b for b in parse(text) if not is_comment(b)]
    entries = dictionary_of(tree) if options.get("dedup") else []
    short = compact(replaced(tree, entries) if entries else tree, dictionary=entries)
    want, got = render(tree).rstrip(), render(expand(short)).rstrip()
    if want == got:
        return True, None, None, None
    a, b = want.split("\n"), got.split("\n")
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return False, k + 1, a[k] if k < len(a) else "(end of file)", b[k] if k < len(b) else "(end of file)"


def mapped(docs: DataFrame, schema: str, work) -> DataFrame:
    """work(text) gives rows for a document; (md_id, columns of schema)."""
    id_type = docs.schema["md_id"].dataType.simpleString()
    names = ["md_id", *(c.split()[0] for c in schema.split(", "))]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [(md_id, *row) for md_id, text in zip(*(c.to_pylist() for c in part.columns)) if text is not None for row in work(text)]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], part.schema.field(0).type), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], names=names)

    return docs.select("md_id", "content").mapInArrow(run, f"md_id {id_type}, {schema}")


def document_blocks(docs: DataFrame) -> DataFrame:
    """(md_id, pos, kind, depth, text): the blocks of each document in order."""
    return mapped(docs, "pos int, kind string, depth int, text string", lambda text: [(k, b["kind"], b.get("depth", 0), render_block(b)) for k, b in enumerate(parse(text))])


def compact_documents(docs: DataFrame, dedup: bool = True, delimiter: str = ",") -> DataFrame:
    """(md_id, compacted, tokens_before, tokens_after, n_phrases, same, line, expected, actual)"""

    def work(text: str) -> list[tuple]:
        tree = parse(text)
        entries = dictionary_of(tree) if dedup else []
        short = compact(replaced(tree, entries) if entries else tree, delimiter, dictionary=entries)
        return [(short, len(text.split()), len(short.split()), len(entries), *round_trip(text, dedup=dedup))]

    return mapped(docs, "compacted string, tokens_before int, tokens_after int, n_phrases int, same boolean, line int, expected string, actual string", work)


def extract_documents(docs: DataFrame, only: Sequence[str] = (), strip: Sequence[str] = (), **limits) -> DataFrame:
    """(md_id, text): documents shortened to what their parts begin with, in chosen sections."""
    return mapped(docs, "text string", lambda text: [(render(extract(elide(parse(text), only, strip), **limits)).rstrip(),)])
