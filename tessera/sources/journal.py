"""Append-only event journals, snapshots and small rule tables as JSON lines and Parquet folders.

Appending adds files, so nothing is rewritten; a snapshot is the folded state with the number of the last record it holds, and
truncation drops the records up to it. Spark's commit protocol makes each write whole or absent.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import glob_pattern


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a journal of JSON lines; lines that are no JSON are left out, a missing journal has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    parsed = F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).where("value <> ''").select(parsed.alias("r")).where("r._bad IS NULL").select("r.*").drop("_bad")


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def save_snapshot(state: DataFrame, path: str) -> None:
    """Replaces a snapshot: the new one is written beside the old and takes its place when it is whole."""
    spark = state.sparkSession
    jvm = spark.sparkContext._jvm
    fresh, target = jvm.org.apache.hadoop.fs.Path(path + ".next"), jvm.org.apache.hadoop.fs.Path(path)
    state.write.mode("overwrite").parquet(path + ".next")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(target, True)
    fs.rename(fresh, target)


def load_snapshot(spark: SparkSession, path: str, default: DataFrame) -> DataFrame:
    return spark.read.parquet(path) if exists(spark, path) else default


def compact(records: DataFrame, fold, journal: str, snapshot: str) -> None:
    """Saves fold(records) as the snapshot, then drops the journal."""
    save_snapshot(fold(records), snapshot)
    reset(records.sparkSession, journal)


def reset(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_texts(texts: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """One file a row, <folder>/<name>. Rows are written where they are; a name comes once, so tries after a failure write the same."""
    base = folder.removeprefix("file:")

    def save(rows) -> None:
        for row in rows:
            target = os.path.join(base, row[0])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target + ".part", "w", encoding="utf-8", newline="") as f:
                f.write(row[1])
            os.replace(target + ".part", target)

    texts.select(name, content).where(F.col(content).isNotNull()).foreachPartition(save)


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """The keys and the row as one JSON text."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("result"))


# --- rules ---

RULE_SCHEMA = "on string, when map<string,string>, inject map<string,string>"
# Events a rule can name, what it can inject, which clauses match a whole value and which a part of it.
EVENTS = ("PreToolUse", "PostToolUse", "UserPromptSubmit", "SessionStart", "SessionEnd", "SubagentStart", "PostToolUseFailure", "Stop", "PreCompact", "ErrorOccurred")
INJECTS = ("text", "hint", "learnings", "block", "allow")
WHOLE, PART = ("tool", "source", "agent_type"), ("command", "prompt", "error", "content", "response")
PERMISSION = ("PreToolUse",)


def read_rules(spark: SparkSession, *candidates: str) -> DataFrame:
    """(rule, on, when, inject): the rules of the first of the files that exists, numbered in order; a file that holds no array has none."""
    for path in candidates:
        if exists(spark, path):
            text = spark.read.text(path, wholetext=True)
            made = text.select(F.posexplode(F.from_json("value", f"array<struct<{RULE_SCHEMA.replace(' string', ':string').replace(' map', ':map')}>>")).alias("rule", "r"))
            return made.select("rule", "r.on", "r.when", "r.inject")
    return spark.createDataFrame([], "rule int, " + RULE_SCHEMA)


def valid(rules: DataFrame) -> Column:
    """Exactly one thing is injected and a path clause isn't empty."""
    keys = F.filter(F.map_keys("inject"), lambda k: k.isin(*INJECTS, "shell"))
    path = F.try_element_at("when", F.lit("path"))
    return F.col("inject").isNotNull() & (F.size(keys) == 1) & ~F.coalesce(F.map_contains_key("when", "path") & (F.coalesce(path, F.lit("")) == ""), F.lit(False))


def health(rules: DataFrame) -> DataFrame:
    """(rule, issue): unknown events, missing or unknown injections, and clauses that are no patterns."""
    clauses = rules.select("rule", F.explode_outer("when").alias("k", "v")).where(F.col("k").isin(*WHOLE, *PART))
    broken = clauses.where(~is_pattern(F.col("v"))).select("rule", F.concat(F.lit("when."), F.col("k"), F.lit(" is no pattern")).alias("issue"))
    event = rules.where(F.col("on").isNull() | ~F.col("on").isin(*EVENTS)).select("rule", F.concat(F.lit("unknown event "), F.coalesce("on", F.lit("null"))).alias("issue"))
    none = rules.where(F.col("inject").isNull()).select("rule", F.lit("missing inject").alias("issue"))
    keys = rules.select("rule", F.explode(F.map_keys("inject")).alias("k"))
    unknown = keys.where(~F.col("k").isin(*INJECTS)).select("rule", F.when(F.col("k") == "shell", "inject.shell is removed").otherwise(F.concat(F.lit("unknown inject key "), F.col("k"))).alias("issue"))
    return event.unionByName(none).unionByName(unknown).unionByName(broken)


def is_pattern(value: Column) -> Column:
    """Whether a text's round, square and curly brackets are closed outside escapes: what patterns of rules fail by."""
    bare = F.regexp_replace(F.regexp_replace(value, r"\\.", ""), r"\[[^\]]*\]", "")
    count = lambda sign: F.length(bare) - F.length(F.replace(bare, F.lit(sign), F.lit("")))
    return (count("(") == count(")")) & (count("[") == 0) & ~bare.rlike(r"(^|\|)[*+?]|[(][*+]")


def match_rules(events: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """events(keys, event, path, and any of the clauses' columns) with each rule that holds for it: (keys, rule, inject). All clauses of a rule
    must hold. Rules are a small table: each is one filter on the events, and nothing is shuffled or joined."""
    made = None
    for r in rules.where(valid(rules)).collect():
        test = F.col("event") == r["on"]
        for k, v in (r["when"] or {}).items():
            column = "path" if k == "path" else k
            if column not in events.columns:
                test = F.lit(False)
            elif k == "path":
                test &= F.col("path").rlike(glob_pattern(v))
            elif k in WHOLE:
                test &= F.col(k).rlike(f"^({v})$")
            elif k in PART:
                test &= (F.col(k) != "") & F.col(k).rlike(v)
        kind, value = next((k, v) for k, v in r["inject"].items() if k in INJECTS or k == "shell")
        if kind == "shell":
            continue
        said = F.lit(f"Related: {value}" if kind == "hint" else value)
        hit = events.where(test).select(*keys, "event", F.lit(r["rule"]).alias("rule"), F.lit("block" if kind == "block" else "allow" if kind == "allow" else "learnings" if kind == "learnings" else "context").alias("kind"), said.alias("value"))
        made = hit if made is None else made.unionByName(hit)
    return made if made is not None else events.select(*keys, "event", F.lit(0).alias("rule"), F.lit("").alias("kind"), F.lit("").alias("value")).limit(0)


def respond(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, decision, reason, context): a block beats an allow, contexts are joined in the order of the rules; only events that ask for a
    permission can be blocked or allowed."""
    may = F.col("event").isin(*PERMISSION)
    first = lambda kind: F.min_by(F.when((F.col("kind") == kind) & may, F.col("value")), F.when((F.col("kind") == kind) & may, F.col("rule")))
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "context", F.struct("rule", "value")))), lambda x: x["value"]), "\n")
    made = matched.groupBy(*keys).agg(first("block").alias("_block"), first("allow").alias("_allow"), context.alias("context"))
    return made.select(*keys, F.when(F.col("_block").isNotNull(), "deny").when(F.col("_allow").isNotNull(), "allow").alias("decision"), F.coalesce("_block", "_allow").alias("reason"), F.nullif("context", F.lit("")).alias("context"))


# --- learnings: a small table (files array<string>, learning string) with a number a row ---


def learnings_for(paths: DataFrame, learnings: DataFrame) -> DataFrame:
    """(path, learning): what is known for each path; learnings are few, so each glob is a filter."""
    rows = learnings.collect()
    made = [paths.where(F.coalesce(reduce_any([F.col("path").rlike(glob_pattern(g)) for g in r["files"] or []]), F.lit(False))).select("path", F.lit(r["learning"]).alias("learning")) for r in rows]
    out = paths.select("path", F.lit("").alias("learning")).limit(0)
    for m in made:
        out = out.unionByName(m)
    return out


def reduce_any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def overlapping(learnings: DataFrame, globs: Sequence[str]) -> DataFrame:
    """Learnings one of whose globs takes one of the given, or the other way round."""
    rows = [r for r in learnings.collect() if any(re.search(glob_pattern(a), b) or re.search(glob_pattern(b), a) or a == b for a in r["files"] or [] for b in globs)]
    return learnings.sparkSession.createDataFrame(rows, learnings.schema)


def orphans(learnings: DataFrame, paths: DataFrame) -> DataFrame:
    """Learnings none of whose globs takes any path: one pass over the paths, a flag a learning."""
    rows = learnings.collect()
    if not rows:
        return learnings
    found = paths.agg(*[F.max(F.coalesce(reduce_any([F.col("path").rlike(glob_pattern(g)) for g in r["files"] or []]), F.lit(False)).cast("int")).alias(f"f{k}") for k, r in enumerate(rows)]).first()
    return learnings.sparkSession.createDataFrame([r for k, r in enumerate(rows) if not found[k]], learnings.schema)
