"""Problem 4: documents above a token limit into pieces within it, cut at natural boundaries, with an overlap.

Method: content-defined chunking. A rolling hash over the last WINDOW tokens marks landmarks; a cut is the first landmark
between the least and the greatest size, moved to the nearest natural boundary in that range (a heading counts before a
paragraph, a line, a sentence). What is cut where depends only on the text nearby, so an edit alters the pieces around it and the
cuts meet again at the next landmarks. Tokens are runs of characters other than white space; the text between them belongs to the
piece in front.

Requests are joined through their distinct (document, limit, overlap), so a document that many requests name is cut once for each
limit, and the requests, not the texts, are what is repeated.

Defined results: a null, zero or negative limit is no limit and gives no pieces; so do documents within the limit, null and
empty ones, and requests for documents that don't exist; a null or negative overlap is none, one of the limit or more is the limit
less one; repeated rows of a request or document count once; recorded heading ranges are boundaries only where the line they
name still is their heading; a token longer than anything is one token; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sizes import broadcast_if_small

WINDOW = 6
SPECS_TOGETHER = 64
ROWS_OUT = 2_000  # rows after which a task hands over what it has made
LEAST = 0.4  # of the greatest size of a piece
BASE = np.uint32(2_654_435_761)

TOKEN = re.compile(r"\S+")
SPACE = r"(?U:[\s\x1c-\x1f])"  # the same, in Java
HEADING = re.compile(r"#{1,6}\s|={1,6}[^=].*=\s*$|\\(?:sub)*section\b|<h[1-6]\b", re.I)
FENCE = re.compile(r"[ \t]*(?:`{3,}|~{3,})")
SENTENCE_END = (".", "!", "?", ".)", '."', "。", ":", ";")
NONE, SENTENCE, LINE, PARAGRAPH, SECTION = range(5)
WEIGHT = np.array([0.0, 6.0, 4.0, 1.5, 1.0])  # of a token's distance from the landmark, by kind of boundary
KIND_NAMES = ("token", "sentence", "line", "paragraph", "heading")


def boundaries(text: str, heads: list[tuple[int, str]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of each token; kind is the boundary in front of it. heads: recorded (line from 1, text) of headings."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    starts = np.array([a for a, _ in spans], dtype=np.int64)
    ends = np.array([b for _, b in spans], dtype=np.int64)
    kind = np.zeros(len(spans), dtype=np.int8)
    if not spans:
        return starts, ends, kind
    lines = text.split("\n")
    recorded = {n: (h or "").strip() for n, h in heads or ()}
    at, blank, code, first_token = 0, True, False, 0
    for number, line in enumerate(lines, 1):
        nxt = at + len(line) + 1
        if line.strip():
            first_token = int(np.searchsorted(starts, at))
            fence = bool(FENCE.match(line))
            if code and not fence:
                kind[first_token] = LINE
            else:
                head = bool(HEADING.match(line.lstrip())) or (number in recorded and recorded[number] != "" and recorded[number] in line)
                kind[first_token] = SECTION if head else PARAGRAPH if blank else LINE
                if code and fence:
                    kind[first_token] = NONE  # a fence closes with its code
            if fence:
                code = not code
            blank = False
        else:
            blank = not code
        at = nxt
    plain = np.flatnonzero(kind[1:] == NONE) + 1
    for i in plain.tolist():
        if text[ends[i - 1] - 2 : ends[i - 1]].endswith(SENTENCE_END):
            kind[i] = SENTENCE
    return starts, ends, kind


def token_hashes(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling hash of the WINDOW tokens before each token."""
    own = np.array([zlib.crc32(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.uint32)
    rolled = np.zeros(len(own), dtype=np.uint32)
    factor = np.uint32(1)
    for k in range(1, WINDOW + 1):
        rolled[k:] += own[:-k] * factor if k < len(own) else 0
        factor = np.uint32((int(factor) * int(BASE)) & 0xFFFFFFFF)
    return rolled ^ (rolled >> np.uint32(15))


def cuts(kind: np.ndarray, rolled: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first token, end token, kind of the boundary at its end) of each piece; the first overlap tokens of all but the first repeat."""
    n = len(kind)
    overlap = max(0, min(overlap, limit - 1))
    pieces: list[tuple[int, int, int]] = []
    begin = 0  # of what is new
    while begin < n:
        first = max(0, begin - overlap) if pieces else 0
        most = first + limit
        if most >= n:
            pieces.append((first, n, SECTION))
            break
        new = most - begin
        least = begin + max(1, int(new * LEAST))
        ahead = rolled[least : most + 1]
        divisor = np.uint32(max(2, (most - least) // 2))
        marks = np.flatnonzero(ahead % divisor == 0)
        mark = least + int(marks[0]) if len(marks) else most
        around = kind[least : most + 1]
        cost = np.where(around > NONE, np.abs(np.arange(least, most + 1) - mark) * WEIGHT[around] + (SECTION - around), np.inf)
        best = int(np.argmin(cost))
        cut = least + best if np.isfinite(cost[best]) else mark
        pieces.append((first, cut, int(kind[cut])))
        begin = cut
    return pieces


def split_text(text: str, limit: int, overlap: int = 0, heads: list[tuple[int, str]] | None = None) -> list[str]:
    """The pieces of one text; [text] if it is within the limit."""
    starts, ends, kind = boundaries(text, heads)
    if limit is None or limit <= 0 or len(starts) <= limit:
        return [text]
    found = cuts(kind, token_hashes(text, starts, ends), limit, overlap or 0)
    return [text[starts[a] if i else 0 : starts[b] if b < len(starts) else len(text)] for i, (a, b, _) in enumerate(found)]


def clean_requests(requests: DataFrame) -> DataFrame:
    """One row per request: (request_id, md_id, max_tokens, overlap); only those with a limit."""
    one = requests.groupBy("request_id").agg(F.min_by(F.struct("md_id", "max_tokens", "overlap_tokens"), F.struct("received_at", "md_id", "max_tokens", "overlap_tokens")).alias("r"))
    return one.select("request_id", "r.md_id", "r.max_tokens", F.greatest(F.lit(0), F.least(F.coalesce("r.overlap_tokens", F.lit(0)), F.col("r.max_tokens") - 1)).alias("overlap")).where("request_id is not null and md_id is not null and max_tokens > 0")


def split_documents(documents: DataFrame, specs: DataFrame, ranges: DataFrame | None = None, with_text: bool = True) -> DataFrame:
    """Pieces of `documents`(md_id, content) for `specs`(md_id, max_tokens, overlap), a row per piece of documents above a limit."""
    # distinct limits of one document, in groups of about SPECS_TOGETHER, so that no row holds all of a document that many requests name
    groups = specs.groupBy("md_id").agg(F.ceil(F.count("*") / SPECS_TOGETHER).alias("_groups"))
    wanted = specs.join(groups, "md_id").groupBy("md_id", F.pmod(F.xxhash64("max_tokens", "overlap"), F.col("_groups")).alias("_group")).agg(F.collect_set(F.struct("max_tokens", "overlap")).alias("specs")).drop("_group")
    docs = documents.where(F.col("md_id").isNotNull() & F.col("content").isNotNull()).select("md_id", "content")
    docs = docs.join(broadcast_if_small(wanted), "md_id")
    if ranges is not None:
        heads = ranges.where(F.col("heading_text").isNotNull()).groupBy("md_id").agg(F.collect_set(F.struct(F.col("start_line").alias("line"), F.col("heading_text").alias("head"))).alias("heads"))
        docs = docs.join(broadcast_if_small(heads, 200_000), "md_id", "left")
    else:
        docs = docs.withColumn("heads", F.lit(None).cast("array<struct<line:int,head:string>>"))
    id_type = documents.schema["md_id"].dataType.simpleString()
    names = ["md_id", "max_tokens", "overlap", "piece_no", "start_token", "end_token", "start_char", "end_char", "boundary", "text"]
    schema = f"md_id {id_type}, max_tokens int, overlap int, piece_no int, start_token int, end_token int, start_char bigint, end_char bigint, boundary string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [None, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                kinds[0] = part.schema.field(0).type
                out: list[list] = [[] for _ in names]
                for md_id, text, specs_, heads_ in zip(*(c.to_pylist() for c in part.columns)):
                    made = rolled = None
                    for spec in sorted(specs_, key=lambda s: (s["max_tokens"], s["overlap"])):
                        if made is None:
                            made = boundaries(text, [(h["line"], h["head"]) for h in heads_ or ()])
                        starts, ends, kind = made
                        if len(starts) <= spec["max_tokens"]:
                            continue
                        if rolled is None:
                            rolled = token_hashes(text, starts, ends)
                        for no, (a, b, k) in enumerate(cuts(kind, rolled, spec["max_tokens"], spec["overlap"]), 1):
                            begin, end = (int(starts[a]) if no > 1 else 0), (int(starts[b]) if b < len(starts) else len(text))
                            for column, value in zip(out, (md_id, spec["max_tokens"], spec["overlap"], no, a, b, begin, end, KIND_NAMES[k], text[begin:end] if with_text else None)):
                                column.append(value)
                        if len(out[0]) >= ROWS_OUT:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                            out = [[] for _ in names]
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return docs.select("md_id", "content", "specs", "heads").mapInArrow(run, schema)


def split_requests(requests: DataFrame, documents: DataFrame, ranges: DataFrame | None = None, with_text: bool = True) -> DataFrame:
    """Pieces for every request whose document is above its limit: request_id and the columns of split_documents."""
    asked = clean_requests(requests)
    specs = asked.select("md_id", "max_tokens", "overlap").distinct()
    least = specs.groupBy("md_id").agg(F.min("max_tokens").alias("_least"))
    n_tokens = F.size(F.split(F.regexp_replace("content", SPACE + r"+\z|\A" + SPACE + "+", ""), SPACE + "+"))
    # only the texts that some request splits are moved, to take copies of a document as one
    once = documents.select("md_id", "content").join(broadcast_if_small(least), "md_id").where(n_tokens > F.col("_least")).select("md_id", "content").dropDuplicates(["md_id"])
    pieces = split_documents(once, specs, ranges, with_text)
    return pieces.join(broadcast_if_small(asked), ["md_id", "max_tokens", "overlap"])


def oversized(requests: DataFrame, documents: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """(request_id): the requests that need splitting. No text is shuffled: a document's copies give equal pieces, made distinct after."""
    asked = clean_requests(requests)
    specs = asked.select("md_id", "max_tokens", "overlap").distinct()
    above = split_documents(documents, specs, ranges, with_text=False).where("piece_no = 2").select("md_id", "max_tokens", "overlap").distinct()
    return asked.join(above, ["md_id", "max_tokens", "overlap"], "left_semi").select("request_id")
