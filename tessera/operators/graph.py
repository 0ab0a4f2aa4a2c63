"""Import edges between files, their resolution and traversal; roll-ups over a tree of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# How scripts name what they import, and the endings tried for a relative specifier, the specifier itself last.
IMPORTS = (
    r"(?:import|export)\s+(?:type\s+)?(?:\{[^}]*\}|\*\s+as\s+[A-Za-z0-9_]+|[A-Za-z0-9_]+)\s+from\s+['\"]([^'\"]+)['\"]",
    r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
)
TRIED = (".ts", ".tsx", ".js", ".jsx")
HIGH, MIN_IMPORTERS = 5, 2


def clean_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def import_edges(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, specifier), distinct, of scripts."""
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in IMPORTS])))
    scripts = files.where(T.extension(F.col("path")).isin("ts", "tsx", "js", "jsx", "mjs", "cjs"))
    return scripts.select("file_id", "repo", clean_path(F.col("path")).alias("path"), F.explode(found).alias("specifier"))


def joined_path(folder: Column, relative: Column) -> Column:
    """A relative path from a folder, whatever the number of steps up; what leads out of the root keeps its steps and so names no file."""

    def step(a: Column, x: Column) -> Column:
        climbs = (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != "..")
        return F.when(x.isin("", "."), a).when((x == "..") & climbs, F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))

    return F.array_join(F.aggregate(F.split(F.concat_ws("/", folder, relative), "/"), F.array().cast("array<string>"), step), "/")


def resolve(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the file of the repository that a relative specifier names: the first of the tried endings (in place of .js) that exists."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    base = F.regexp_replace("specifier", r"\.js$", "")
    names = F.array(*[joined_path(folder, F.concat(base, F.lit(e))) for e in TRIED], joined_path(folder, F.col("specifier")))
    tried = edges.where("specifier LIKE '.%'").select("file_id", "repo", "specifier", F.posexplode(names).alias("rank", "candidate"))
    known = files.select("repo", clean_path(F.col("path")).alias("candidate"), F.col("file_id").alias("resolved"))
    hits = tried.join(known, ["repo", "candidate"]).groupBy("file_id", "specifier").agg(F.min_by("resolved", F.struct("rank", "resolved")).alias("resolved"))
    return edges.join(hits, ["file_id", "specifier"], "left")


def incoming(edges: DataFrame) -> DataFrame:
    """(file_id, importer): the files that import each file, itself aside. `edges` are resolved."""
    return edges.where("resolved IS NOT NULL AND resolved <> file_id").select(F.col("resolved").alias("file_id"), F.col("file_id").alias("importer")).distinct()


def tests_of(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, test): the tests of each file: importers whose path is a test's, and the file itself if it is one."""
    test = files.where(T.is_test_path(F.col("path"))).select(F.col("file_id").alias("test"))
    return incoming(edges).withColumnRenamed("importer", "test").join(test, "test", "left_semi").select("file_id", "test").unionByName(test.select(F.col("test").alias("file_id"), "test")).distinct()


def shared_boost(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, score): what at least MIN_IMPORTERS imports of candidates(node, score) lead to and is no candidate itself; its score is their number."""
    counted = edges.where("resolved IS NOT NULL").join(candidates.where("score > 0").select(F.col("node").alias("file_id")), "file_id", "left_semi").groupBy(F.col("resolved").alias("node")).agg(F.count("*").alias("score"))
    return counted.where(F.col("score") >= MIN_IMPORTERS).join(candidates.select("node"), "node", "left_anti").select("node", F.col("score").cast("double").alias("score"))


def expand_candidates(candidates: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """candidates(node, score, priority) and what high ones lead to: half the parent's score, 1 at least; a low one is raised, others stay as
    they are. A node is left once; each level keeps one row a node."""
    links = edges.where("resolved IS NOT NULL").select(F.col("file_id").alias("src"), F.col("resolved").alias("dst")).distinct()
    found, frontier = candidates.select("node", "score", "priority"), candidates.where("priority = 'high'").select("node", "score")
    visited = frontier.select("node")
    for _ in range(depth):
        reached = links.join(frontier, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max(F.greatest(F.lit(1.0), F.floor(F.col("score") * 0.5).cast("double"))).alias("_new"))
        both = found.join(reached, "node", "full")
        raised = F.when(F.col("priority").isNull() | (F.col("priority") == "low"), F.greatest("_new", "score")).otherwise(F.col("score"))
        found = both.select("node", raised.alias("score"), F.coalesce("priority", F.lit("low")).alias("priority"))
        frontier = reached.select("node", F.col("_new").alias("score")).join(visited, "node", "left_anti")
        visited = visited.unionByName(frontier.select("node"))
    return found


def tree_rollup(files: DataFrame, depth: int = 3) -> DataFrame:
    """(repo, prefix, level, n_files, tokens): what stands under each folder down to a depth."""
    parts = F.split(F.regexp_replace("path", r"^\./", ""), "/")
    sized = files.select("repo", parts.alias("parts"), T.token_count(F.col("content")).cast("long").alias("tokens"))
    levels = sized.select("repo", "parts", "tokens", F.explode(F.sequence(F.lit(0), F.least(F.size("parts") - 1, F.lit(depth)))).alias("level"))
    return levels.groupBy("repo", F.array_join(F.slice("parts", 1, F.col("level")), "/").alias("prefix"), F.col("level").cast("long").alias("level")).agg(F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"))


def first_of(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
