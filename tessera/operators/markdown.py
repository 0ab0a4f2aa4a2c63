"""Sections, extraction, compaction and phrase dictionaries of Markdown documents (md_id, content).

A document is a row and is read whole; everything about one document is a map or a window over its own lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t]*$"
Stage = Callable[[DataFrame], DataFrame]


def once(docs: DataFrame) -> DataFrame:
    return docs.where("content is not null").select("md_id", "content").dropDuplicates(["md_id"])


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(md_id, line_no, line, coded, before): lines from 1, whether they stand in a fence, and the tokens in front of them."""
    lines = docs.select("md_id", F.posexplode(F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n", -1)).alias("p", "line"))
    own = Window.partitionBy("md_id").orderBy("p")
    fence = F.col("line").rlike(r"^[ ]{0,3}(```|~~~)").cast("int")
    upto = own.rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("md_id", (F.col("p") + 1).alias("line_no"), "line", ((F.coalesce(F.sum(fence).over(upto), F.lit(0)) % 2) == 1).alias("coded"), F.coalesce(F.sum(T.token_count(F.col("line"))).over(upto), F.lit(0)).alias("before"))


def heading_ranges(docs: DataFrame) -> DataFrame:
    """(md_id, start_line, depth, heading, end_line, tokens): each section ends at the next heading that is not deeper; tokens are those of the
    whole section with what is nested in it."""
    lines = numbered_lines(docs)
    is_head = F.col("line").rlike(HEADING) & ~F.col("coded")
    entry = F.struct("line_no", F.length(F.regexp_extract("line", HEADING, 1)).alias("depth"), F.regexp_extract("line", HEADING, 2).alias("heading"), "before")
    by_doc = lines.groupBy("md_id").agg(F.array_sort(F.collect_list(F.when(is_head, entry))).alias("heads"), F.max("line_no").alias("last"), F.sum(T.token_count(F.col("line"))).alias("total"))
    heads = by_doc.select("md_id", "last", "total", "heads", F.explode("heads").alias("h"))
    following = F.try_element_at(F.filter("heads", lambda x: (x["line_no"] > F.col("h.line_no")) & (x["depth"] <= F.col("h.depth"))), F.lit(1))
    return heads.select(
        "md_id", F.col("h.line_no").cast("long").alias("start_line"), F.col("h.depth").cast("long").alias("depth"), F.col("h.heading").alias("heading"), F.coalesce(following["line_no"], F.col("last") + 1).cast("long").alias("end_line"), (F.coalesce(following["before"], F.col("total")) - F.col("h.before")).cast("long").alias("tokens")
    )


def elide(docs: DataFrame, only: Sequence[str] = (), strip: Sequence[str] = ()) -> DataFrame:
    """(md_id, line_no, line): only the sections whose heading holds a query, or all but those. Both at once is an error; with neither, and for
    documents without headings, all lines stay; nothing is left of a document with headings none of which holds a query to keep."""
    only, strip = ([q.strip().lower() for q in x if q.strip()] for x in (only, strip))
    if only and strip:
        raise ValueError("sections to keep and sections to strip exclude each other")
    lines = numbered_lines(docs)
    if not only and not strip:
        return lines.select("md_id", "line_no", "line")
    hit = reduce(lambda a, b: a | b, [F.lower(F.trim("heading")).contains(q) for q in only or strip])
    spans = heading_ranges(docs).groupBy("md_id").agg(F.collect_list(F.when(hit, F.struct("start_line", "end_line"))).alias("spans"))
    inside = F.exists("spans", lambda s: (F.col("line_no") >= s["start_line"]) & (F.col("line_no") < s["end_line"]))
    kept = F.col("spans").isNull() | (inside if only else ~inside)
    return lines.join(spans, "md_id", "left").where(kept).select("md_id", "line_no", "line")


def frontmatter(docs: DataFrame) -> DataFrame:
    """(md_id, key, kind, value): the scalars and inline arrays of the block at the start. A block with a nested line or a line without a key
    counts as none; of a key's lines the last holds; quotes and their escapes are taken off."""
    block = F.regexp_extract(F.regexp_replace("content", r"\r\n?", "\n"), r"\A---\n([\s\S]*?)\n---(?:\n|\z)", 1)
    bare = lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", "")
    counts = lambda x: (bare(x) != "") & ~bare(x).startswith("#")
    wrong = lambda x: counts(x) & (x.rlike(r"^[ \t]") | ~x.rlike(r"^[^:]*[^:\s][^:]*:"))
    lines = docs.select("md_id", F.split(block, "\n", -1).alias("l")).where(~F.exists("l", wrong)).select("md_id", F.posexplode("l").alias("n", "x")).where(counts(F.col("x")))
    keyed = lines.select("md_id", "n", bare(F.regexp_extract("x", r"^([^:]*):", 1)).alias("key"), bare(F.regexp_extract("x", r"^[^:]*:(.*)$", 1)).alias("value"))
    last = keyed.groupBy("md_id", "key").agg(F.max_by("value", "n").alias("value"))
    v = F.col("value")
    kind = F.when(v.isin("", "null", "~"), "null").when(v.isin("true", "false"), "boolean").when(v.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$"), "number").when(v.startswith("[") & v.endswith("]"), "array").otherwise("string")
    inner = F.substring(v, F.lit(2), F.length(v) - 2)
    double = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    single = F.replace(inner, F.lit("''"), F.lit("'"))
    text = F.when(kind == "null", None).when((kind == "string") & (F.length(v) >= 2) & v.startswith('"') & v.endswith('"'), double).when((kind == "string") & (F.length(v) >= 2) & v.startswith("'") & v.endswith("'"), single).otherwise(v)
    return last.select("md_id", "key", kind.alias("kind"), text.alias("value"))


def array_items(value: Column) -> Column:
    """The items of an inline array's text: commas within quotes don't part them."""
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.filter(F.transform(F.regexp_extract_all(inner, F.lit(r"((?:\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^,\"'])+)"), F.lit(1)), F.trim), lambda x: x != "")


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"<!--[\s\S]*?-->\n?", "")


def drop_empty_links(text: Column) -> Column:
    return F.regexp_replace(text, r"\[([^\]\[]*)\]\([ \t]*\)", "$1")


def stage(name: str, change: Callable[[Column], Column]) -> Stage:
    """A named step on `content`; stages compose with run_pipeline."""

    def apply(docs: DataFrame) -> DataFrame:
        return docs.withColumn("content", change(F.col("content")))

    apply.__name__ = name
    return apply


WHITESPACE = stage("whitespace", lambda c: T.collapse_blank_lines(T.strip_trailing(F.replace(c, F.lit("\r\n"), F.lit("\n")))))
SEMANTIC = stage("semantic", lambda c: drop_empty_links(T.plain_punctuation(strip_comments(c))))
UNWRAP = stage("unwrap", T.unwrap_lines)


def run_pipeline(docs: DataFrame, stages: list[Stage]) -> DataFrame:
    """Left fold of stages; a stage is any DataFrame -> DataFrame."""
    return reduce(lambda d, f: d.transform(f), stages, docs)


def phrase_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = (2, 3, 4, 5), least: int = 2) -> DataFrame:
    """(key, n, gram, occurrences): phrases of some words within sentences that a document holds at least twice. All of a document is in its
    row, so they are counted there and nothing is shuffled."""
    names = [key, "n", "gram", "occurrences"]
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, value in enumerate(batch.column(1).to_pylist()):
                sentences = [w for s in re.split(r"[.!?\n]+", value or "") if len(w := WORD.findall(s)) > 1]
                for n in sizes:
                    counts = Counter(" ".join(words[i : i + n]) for words in sentences for i in range(len(words) - n + 1))
                    out += [(k, n, gram, times) for gram, times in counts.items() if times >= least]
            at, n, gram, times = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(n, pa.int64()), pa.array(gram, pa.string()), pa.array(times, pa.int64())], names=names)

    return docs.select(key, text).mapInArrow(run, f"{key} {id_type}, n long, gram string, occurrences long")


WORD = re.compile(f"[^{''.join(re.sub(r'x{([0-9a-f]+)}', lambda m: 'u' + m[1].zfill(4), T.SPACES))}]+")
