"""What surrounds a symbol, and what a change of files touches: bodies, callers, dependencies, tests.

Requests are few; files are scanned once a part, and only lines that a request asks for leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import code as C
from tessera.operators import graph as G
from tessera.operators.sizes import broadcast_if_small

# What is shown of each part.
CALLERS, DEPENDENCIES, TESTS, USES, SYMBOLS, VERIFIED = 20, 12, 12, 6, 8, 10
BODY_SHARE, LEAST_BODY = 0.6, 40
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "new", "await", "super", "import", "throw", "else", "do", "case")


def cut_tokens(text: Column, most: Column) -> Column:
    """The lines of a text within a number of tokens, with a line of dots if some are left out."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("t"), F.lit(True).alias("open"))

    def step(a: Column, x: Column) -> Column:
        t = a["t"] + T.token_count(x)
        fits = a["open"] & (t <= most)
        return F.struct(F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(fits, t).otherwise(a["t"]).alias("t"), fits.alias("open"))

    lines = F.split(text, "\n", -1)
    kept = F.transform(F.array(F.aggregate(lines, start, step)), lambda a: F.when(a["n"] == F.size(lines), text).otherwise(F.concat(F.array_join(F.slice(lines, 1, a["n"]), "\n"), F.lit("\n..."))))
    return F.element_at(kept, 1)


def type_names(signature: Column) -> Column:
    """Names of types in a signature: behind colons, or alone in angle brackets; capitals first."""
    found = F.flatten(F.array(F.regexp_extract_all(signature, F.lit(r":\s*([A-Z][A-Za-z0-9_]+)"), F.lit(1)), F.regexp_extract_all(signature, F.lit(r"<\s*([A-Z][A-Za-z0-9_]+)\s*>"), F.lit(1))))
    return F.array_distinct(found)


def located(files: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(request, file_id, symbol, hash) with the first symbol of the name in the file, or the one with the hash."""
    wanted = requests.select("request", "file_id", F.col("symbol").alias("name"), F.col("hash").alias("_want"))
    symbols = C.outlines(files.join(broadcast_if_small(wanted.select("file_id").distinct()), "file_id", "left_semi"))
    hit = symbols.join(broadcast_if_small(wanted), ["file_id", "name"]).where(F.col("_want").isNull() | (F.col("_want") == F.col("hash")))
    first = hit.withColumn("_n", F.row_number().over(Window.partitionBy("request").orderBy("ordinal"))).where("_n = 1").drop("_n", "_want")
    source = files.select("file_id", "repo", "path", F.replace("content", F.lit("\r\n"), F.lit("\n")).alias("content"))
    body = F.array_join(F.slice(F.split("content", "\n", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return first.join(source, "file_id").withColumn("body", body).drop("content")


def mentions(files: DataFrame, names: DataFrame) -> DataFrame:
    """names(repo, name, ...) with each line of the repository that has the name as a whole word: (path, line_no, line)."""
    lines = C.source_lines(files.select("file_id", "repo", "path", "content")).join(files.select("file_id", "path"), "file_id")
    words = lines.select("file_id", "repo", "path", "line_no", T.trim_all(F.col("line")).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(C.WORD), F.lit(0)))).alias("name"))
    return words.join(broadcast_if_small(names), ["repo", "name"])


def first_rows(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= most)


def focus(files: DataFrame, requests: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """(request, part, n, text): the symbol's head, its body within its share of the budget, up to 20 lines elsewhere that mention it, the first 12
    names it calls with their first definition, types of its signature with theirs, tests of its file with their mentions. A request whose
    symbol isn't there has one row that says so."""
    at = located(files, requests).persist()  # a row a request, read by every part
    part = lambda df, name, n, text: df.select("request", F.lit(name).alias("part"), n.cast("int").alias("n"), text.alias("text"))
    head = part(at, "head", F.lit(1), F.concat("name", F.lit(" ("), "kind", F.lit(", "), "path", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit(", hash:"), "hash", F.lit(")")))
    body = part(at, "body", F.lit(1), cut_tokens(F.col("body"), F.lit(max(LEAST_BODY, int(max_tokens * BODY_SHARE)))))
    asked = at.select("request", "repo", "name", F.col("file_id").alias("_file"), "start_line", "end_line")
    outside = mentions(files, asked).where(~((F.col("file_id") == F.col("_file")) & F.col("line_no").between(F.col("start_line"), F.col("end_line"))))
    place = F.concat("path", F.lit(":"), "line_no", F.lit(" "), "line")
    callers = part(first_rows(outside, ["request"], ["path", "line_no"], CALLERS), "caller", F.col("n"), place)
    called = F.slice(F.filter(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))), lambda x: ~x.isin(*KEYWORDS) & (x != F.col("name"))), 1, DEPENDENCIES)
    defined = C.definitions(files).join(files.select("file_id", "path"), "file_id")

    def with_definitions(names: Column, label: str) -> DataFrame:
        each = at.select("request", "repo", F.posexplode(names).alias("n", "want"))
        where = defined.join(broadcast_if_small(each.select("repo", F.col("want").alias("name")).distinct()), ["repo", "name"], "left_semi").groupBy("repo", F.col("name").alias("want")).agg(F.min(F.struct("path", "line_no")).alias("d"))
        named = each.join(where, ["repo", "want"], "left")
        return part(named, label, F.col("n") + 1, F.concat("want", F.coalesce(F.concat(F.lit(" "), F.col("d.path"), F.lit(":"), F.col("d.line_no")), F.lit(""))))

    tested = G.tests_of(G.resolve(G.import_edges(files), files), files).join(broadcast_if_small(at.select("request", "file_id", "name")), "file_id")
    few = first_rows(tested.join(files.select(F.col("file_id").alias("test"), "path"), "test"), ["request"], ["path"], TESTS).drop("n")
    uses = C.source_lines(files.select("file_id", "repo", "content").join(broadcast_if_small(few.select(F.col("test").alias("file_id")).distinct()), "file_id", "left_semi"))
    used = few.join(uses.select(F.col("file_id").alias("test"), "line_no", T.trim_all(F.col("line")).alias("line")), "test").where(F.expr("line RLIKE concat('(?<![A-Za-z0-9_])', name, '(?![A-Za-z0-9_])')"))
    shown = first_rows(used, ["request", "test"], ["line_no"], USES).select("request", "path", place.alias("text"))
    listed = few.select("request", "path", F.col("path").alias("text")).unionByName(shown)
    tests = part(first_rows(listed, ["request"], ["path", "text"], TESTS * (USES + 1)), "test", F.col("n"), F.col("text"))
    missing = requests.join(broadcast_if_small(at.select("request")), "request", "left_anti")
    none = part(missing, "missing", F.lit(1), F.concat(F.lit("symbol not found: "), F.col("symbol")))
    return head.unionByName(body).unionByName(callers).unionByName(with_definitions(called, "dependency")).unionByName(with_definitions(type_names(F.col("signature")), "type")).unionByName(tests).unionByName(none)


def verify(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, name, change, n_callers, callers, n_tests): the first changed symbols of each changed file, lines elsewhere in the repository that
    mention them, and how many tests the file has."""
    changed = C.changed_outlines(before, after)
    few = first_rows(changed, ["file_id"], ["name", "nth"], SYMBOLS).drop("n").groupBy("file_id", "name").agg(F.min("change").alias("change"))
    named = few.join(after.select("file_id", "repo"), "file_id").select("repo", "name", F.col("file_id").alias("_file"), "change")
    lines = mentions(after, named.select("repo", "name", "_file")).where(F.col("file_id") != F.col("_file"))
    counted = lines.groupBy("_file", "name").agg(F.count("*").alias("n_callers"))
    shown = first_rows(lines, ["_file", "name"], ["path", "line_no"], VERIFIED).groupBy("_file", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("path", F.lit(":"), "line_no").alias("at")))), lambda x: x["at"]).alias("callers"))
    tests = G.tests_of(G.resolve(G.import_edges(after), after), after).groupBy(F.col("file_id").alias("_file")).agg(F.count("*").alias("n_tests"))
    joined = named.join(counted, ["_file", "name"], "left").join(shown, ["_file", "name"], "left").join(tests, "_file", "left")
    return joined.select(F.col("_file").alias("file_id"), "name", "change", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("callers", F.array().cast("array<string>")).alias("callers"), F.coalesce("n_tests", F.lit(0)).alias("n_tests"))
