"""Trees of text files as tables: discovery with ignore lists, whole texts, folder trees, changed files, and tables kept beside them.

A listing is one scan of file metadata; contents are read by the executors that need them. What is kept between runs (features of
files, summaries) is a table keyed by what makes it stale, so a refresh is an anti join and a union.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

# Folders that discovery and trees leave out, globs and further ignored paths of review profiles.
IGNORED = ("node_modules/**", "dist/**", ".git/**")
TREE_IGNORED = ("node_modules", ".git", "dist", "coverage", ".next", ".cache")
PROFILES = {
    "code": ("**/*.{ts,tsx,js,jsx,py,go,rs,java,c,cpp}", ("docs/**", "bench/**")),
    "full": ("**/*.{ts,tsx,js,jsx,md,mdx,json,yaml,yml}", ()),
    "docs": ("**/*.{md,mdx,markdown}", ()),
}


def glob_pattern(glob: str) -> str:
    """A glob of paths as a pattern: ** any folders, * and ? within a name, {a,b} alternatives."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "{" and (end := glob.find("}", i)) > 0:
            out.append("(?:" + "|".join(map(re.escape, glob[i + 1 : end].split(","))) + ")")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def matches(path: Column, globs: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_pattern(g)) for g in globs], F.lit(False))


def discover(spark: SparkSession, root: str, glob: str = "**/*", ignore: Sequence[str] = IGNORED) -> DataFrame:
    """(path, bytes, modified_at): the files under a folder that a glob takes and no ignore entry does; no contents are read. Hidden and empty files
    aren't listed."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"))
    return relative(listed, root).where(matches(F.col("path"), [glob]) & ~matches(F.col("path"), ignore))


def relative(df: DataFrame, root: str) -> DataFrame:
    base = re.escape(root.removeprefix("file:").rstrip("/"))
    return df.withColumn("path", F.regexp_replace("path", f"^(?:file:/*)?/?{base.lstrip('/')}/", ""))


def read_texts(spark: SparkSession, root: str, glob: str = "**/*", ignore: Sequence[str] = IGNORED) -> DataFrame:
    """(path, content, bytes, modified_at): whole texts of the files that discovery finds. Bytes that are no UTF-8 become replacement marks."""
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = relative(whole, root).where(matches(F.col("path"), [glob]) & ~matches(F.col("path"), ignore))
    return found.select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"))


def discovery_key(root: str, glob: str, ignore: Sequence[str]) -> Column:
    """What a discovery's result depends on, as text."""
    return F.to_json(F.struct(F.lit(root).alias("root"), F.lit(glob).alias("glob"), F.array(*[F.lit(x) for x in sorted(ignore)]).alias("ignore")))


def existing(paths: DataFrame, files: DataFrame) -> DataFrame:
    return paths.join(files.select("path"), "path", "left_semi")


def changed(*listings: DataFrame) -> DataFrame:
    """(path): what any listing of changed files names, once and in order."""
    return reduce(DataFrame.unionByName, [x.select("path") for x in listings]).where("path <> ''").distinct().orderBy("path")


def stale(current: DataFrame, kept: DataFrame, keys: Sequence[str] = ("path", "modified_at", "bytes")) -> DataFrame:
    """Rows of `current` for which nothing is kept under equal keys: these are to be worked out anew."""
    return current.join(kept.select(*keys), list(keys), "left_anti")


def refreshed(current: DataFrame, kept: DataFrame, made: DataFrame, keys: Sequence[str] = ("path", "modified_at", "bytes")) -> DataFrame:
    """The kept table with the rows that still hold and the ones made anew for the rest; what is gone from `current` goes."""
    return kept.join(current.select(*keys), list(keys), "left_semi").unionByName(made)


def looked_up(sections: DataFrame, summaries: DataFrame) -> DataFrame:
    """sections(section_key, content_hash) with the summary that was kept for just that content; null where it is stale or none."""
    return sections.join(summaries.select("section_key", "content_hash", "summary"), ["section_key", "content_hash"], "left")


def tree_entries(files: DataFrame, depth: int = 3, ignore: Sequence[str] = (), extension: str | None = None) -> DataFrame:
    """(repo, path, name, is_folder, level, tokens, bytes, lines): files and folders down to a depth, without hidden ones and ignored names;
    folders have the tokens of all files in them that are shown. Ordered by path for reading."""
    parts = F.split(F.regexp_replace("path", r"^\./", ""), "/")
    hidden = F.exists(parts, lambda x: x.startswith(".") | x.isin(*TREE_IGNORED, *ignore))
    shown = files.withColumn("_parts", parts).where(~hidden & (F.size("_parts") <= depth + 1))
    if extension:
        shown = shown.where(F.col("path").endswith("." + extension))
    sized = shown.select("repo", F.array_join("_parts", "/").alias("path"), "_parts", T.token_count(F.col("content")).cast("long").alias("tokens"), F.octet_length("content").cast("long").alias("bytes"), F.size(F.split("content", "\n", -1)).cast("long").alias("lines"))
    leaves = sized.select("repo", "path", F.element_at("_parts", -1).alias("name"), F.lit(False).alias("is_folder"), (F.size("_parts") - 1).cast("long").alias("level"), "tokens", "bytes", "lines")
    above = sized.where("size(_parts) > 1").select("repo", "tokens", "_parts", F.explode(F.sequence(F.lit(1), F.size("_parts") - 1)).alias("_n"))
    folders = above.groupBy("repo", F.slice("_parts", 1, F.col("_n")).alias("_p")).agg(F.sum("tokens").alias("tokens"))
    named = folders.select("repo", F.array_join("_p", "/").alias("path"), F.element_at("_p", -1).alias("name"), F.lit(True).alias("is_folder"), (F.size("_p") - 1).cast("long").alias("level"), "tokens", F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("long").alias("lines"))
    return leaves.unionByName(named)


def render_tree(entries: DataFrame) -> DataFrame:
    """(repo, tree): a line an entry, indented by its level, folders with a slash, with tokens."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level").cast("int")), F.col("name"), F.when(F.col("is_folder"), "/").otherwise(""), F.lit(" ("), F.col("tokens"), F.lit("t)"))
    return entries.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.split("path", "/").alias("p"), line.alias("l")))), lambda x: x["l"]), "\n").alias("tree"))


def tree_totals(entries: DataFrame) -> DataFrame:
    leaves = entries.where("NOT is_folder")
    return leaves.groupBy("repo").agg(F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"))


def detect_tools(files: DataFrame) -> DataFrame:
    """(repo, test_tool, type_tool): what a repository's root files tell about its tools."""
    has = lambda *names: F.max(F.regexp_replace("path", r"^\./", "").isin(*names).cast("int")) == 1
    test = F.when(has("package.json") & has("bun.lock"), "bun").when(has("package.json"), "npm").when(has("bun.lock"), "bun").when(has("pytest.ini", "pyproject.toml"), "pytest").when(has("Cargo.toml"), "cargo").when(has("go.mod"), "go")
    return files.groupBy("repo").agg(test.alias("test_tool"), F.when(has("tsconfig.json"), "tsc").when(has("pyproject.toml"), "mypy").alias("type_tool"))
