"""Unified diffs that stand in texts: files, hunks, context and changes.

Lines are (doc_id, line_no, block, line); a block is one diff. Windows run inside a document. In a diff a line that begins with
`diff --git ` opens a file and `@@ ` a hunk; what stands before a file's first hunk is its header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff_lines(docs: DataFrame) -> DataFrame:
    """The lines of fenced diffs in documents (doc_id, text)."""
    lines = docs.where(F.lower("text").contains("```diff")).select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n", -1)).alias("p", "line"))
    upto = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    fenced = lines.withColumn("fence", F.col("line").rlike(r"^```")).withColumn("k", F.sum(F.col("fence").cast("int")).over(upto))
    opener = F.first("line").over(Window.partitionBy("doc_id", "k").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    marked = fenced.withColumn("opener", opener)
    return marked.where((F.col("k") % 2 == 1) & ~F.col("fence") & F.lower("opener").startswith("```diff")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.col("k").cast("long").alias("block"), "line")


def with_places(lines: DataFrame) -> DataFrame:
    """Adds the number of the file (from 1; 0 in front of the first `diff --git`), of the hunk in it (0 in its header) and whether a line opens one."""
    upto = Window.partitionBy("doc_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filed = lines.withColumn("file_no", F.sum(F.col("line").startswith("diff --git ").cast("long")).over(upto))
    inside = Window.partitionBy("doc_id", "block", "file_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return filed.withColumn("hunk", F.sum(F.col("line").startswith("@@ ").cast("long")).over(inside)).withColumn("opens", F.col("line").startswith("@@ "))


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^[ab]/", "")


def is_change(line: Column) -> Column:
    return line.startswith("+") | line.startswith("-") | line.startswith("\\ ")


def label(header: Column) -> Column:
    return F.trim(F.regexp_extract(header, r"^@@\s+[-+,0-9\s]+@@\s*(.*)$", 1))


def file_paths(placed: DataFrame) -> DataFrame:
    """(doc_id, block, file_no, path): the new name, else the old one, else that of the `diff --git` line; never /dev/null."""
    head = placed.where("hunk = 0")
    named = lambda mark: F.min_by(F.when(F.col("line").startswith(mark), plain_path(F.substring("line", F.lit(5), F.length("line")))), F.when(F.col("line").startswith(mark), F.col("line_no")))
    git = F.min_by(F.when(F.col("line").startswith("diff --git "), plain_path(F.coalesce(F.try_element_at(F.split(F.trim("line"), r"\s+"), F.lit(4)), F.lit("")))), F.when(F.col("line").startswith("diff --git "), F.col("line_no")))
    real = lambda path: F.when((path != "/dev/null") & (path != ""), path)
    paths = head.groupBy("doc_id", "block", "file_no").agg(named("+++ ").alias("_new"), named("--- ").alias("_old"), git.alias("_git"))
    return paths.select("doc_id", "block", "file_no", F.coalesce(real(F.col("_new")), real(F.col("_old")), F.nullif("_git", F.lit(""))).alias("path"))


def hunks(lines: DataFrame) -> DataFrame:
    """(doc_id, block, file_no, path, hunk, label, added, removed)"""
    placed = with_places(lines)
    line, body = F.col("line"), ~F.col("opens")
    counted = placed.where("hunk > 0").groupBy("doc_id", "block", "file_no", "hunk").agg(
        F.min_by(label(line), "line_no").alias("label"), F.sum((body & line.startswith("+")).cast("long")).alias("added"), F.sum((body & line.startswith("-")).cast("long")).alias("removed")
    )
    keys = ["doc_id", "block", "file_no"]
    return counted.join(file_paths(placed), keys, "left")


def near_changes(placed: DataFrame, around: int) -> DataFrame:
    """Lines of hunks within `around` lines of a change of the same hunk; with 0 all that aren't context."""
    body = placed.where("hunk > 0 AND NOT opens")
    if around <= 0:
        return body.where(~F.col("line").startswith(" "))
    near = Window.partitionBy("doc_id", "block", "file_no", "hunk").orderBy("line_no").rowsBetween(-around, around)
    return body.withColumn("_near", F.max(is_change(F.col("line")).cast("int")).over(near)).where("_near = 1").drop("_near")


def compact(lines: DataFrame, around: int = 1, headers: bool = True, changes_only: bool = False) -> DataFrame:
    """(doc_id, block, line_no, part, line): diffs with less context. headers: a file's path in place of its header, other header lines stay;
    changes_only: the path, the hunks' labels and the changes. part orders what stands at one line; blank lines at a file's edges go."""
    placed = with_places(lines)
    first = placed.groupBy("doc_id", "block", "file_no").agg(F.min("line_no").alias("line_no"))
    named = file_paths(placed).where("path IS NOT NULL").join(first, ["doc_id", "block", "file_no"])
    row = lambda df, part, text: df.select("doc_id", "block", "file_no", "line_no", F.lit(part).alias("part"), text.alias("line"))
    kept = row(near_changes(placed, around), 1, F.col("line"))
    head = placed.where("hunk = 0")
    if changes_only:
        labels = placed.where("opens").withColumn("_label", label(F.col("line"))).where("_label <> ''")
        changes = placed.where("hunk > 0 AND NOT opens").where(is_change(F.col("line")))
        made = row(named, 0, F.concat(F.lit("--- "), "path")).unionByName(row(labels, 1, F.concat(F.lit("@@ "), "_label"))).unionByName(row(changes, 1, F.col("line")))
    else:
        dropped = F.col("line").startswith("diff --git ") | F.col("line").startswith("index ") | F.col("line").startswith("--- ") | F.col("line").startswith("+++ ")
        made = kept.unionByName(row(placed.where("opens"), 1, F.col("line"))).unionByName(row(head.where(~dropped) if headers else head, 1, F.col("line")))
        if headers:
            made = made.unionByName(row(named, 0, F.concat(F.lit("=== "), "path")))
    keys = Window.partitionBy("doc_id", "block", "file_no")
    at = F.struct("line_no", "part")
    text = F.when(F.col("line") != "", at)
    edged = made.withColumns({"_a": F.min(text).over(keys), "_b": F.max(text).over(keys)})
    return edged.where((at >= F.col("_a")) & (at <= F.col("_b"))).select("doc_id", "block", "line_no", "part", "line")
