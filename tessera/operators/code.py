"""Symbols of source files: outlines, definitions, usages, conventions and edits as projections."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.sizes import broadcast_if_small

DEFINITION = r"\b(?:function|class|interface|type|enum|def|fn|func|struct|trait|module)[ \t*]+([A-Za-z_][A-Za-z0-9_]*)"
WORD = r"[A-Za-z_][A-Za-z0-9_]*"
CALL = r"([A-Za-z_][A-Za-z0-9_]*)\("
NOT_CALLS = ("if", "for", "while", "switch", "return", "catch", "function", "def", "fn", "func", "match", "with", "elif", "super", "typeof", "sizeof", "and", "or", "not")
BRACED = re.compile(r"^([ \t]*)(?:export\s+|pub(?:\([a-z]+\))?\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|default\s+|abstract\s+|final\s+|const\s+)*(function\*?|class|interface|type|enum|fn|func|struct|trait|impl|module|def)\s+(?:\([^)]*\)\s*)?(?:self\.)?([A-Za-z_]\w*)", re.M)


def source_lines(files: DataFrame) -> DataFrame:
    return files.select("file_id", "repo", F.posexplode(F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n", -1)).alias("p", "line")).select("file_id", "repo", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def definitions(files: DataFrame) -> DataFrame:
    """(file_id, repo, line_no, name): the first declaration of each line."""
    return source_lines(files).select("file_id", "repo", "line_no", F.regexp_extract("line", DEFINITION, 1).alias("name")).where("name <> ''")


def word_lines(files: DataFrame) -> DataFrame:
    """(file_id, repo, line_no, name): the distinct words of each line."""
    return source_lines(files).select("file_id", "repo", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(WORD), F.lit(0)))).alias("name"))


def usages(files: DataFrame, outside_definitions: bool = False) -> DataFrame:
    """(repo, name, n_lines, n_files) of names that the repository defines; lines are counted before they meet the definitions."""
    defined = definitions(files)
    words = word_lines(files).join(broadcast_if_small(defined.select("repo", "name").distinct()), ["repo", "name"], "left_semi")  # most words are no symbol
    if outside_definitions:
        words = words.join(defined.select("file_id", "line_no", "name"), ["file_id", "line_no", "name"], "left_anti")
    counted = words.groupBy("repo", "name", "file_id").agg(F.count("*").alias("n")).groupBy("repo", "name").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_files"))
    return counted


def dependencies(files: DataFrame, most: int = 12) -> DataFrame:
    """(file_id, n, name): the first names each file calls."""
    called = F.filter(F.array_distinct(F.regexp_extract_all("content", F.lit(CALL), F.lit(1))), lambda x: ~x.isin(*NOT_CALLS))
    return files.select("file_id", F.posexplode(F.slice(called, 1, most)).alias("n", "name")).select("file_id", F.col("n").cast("long").alias("n"), "name")


def naming_style(name: Column) -> Column:
    return F.when(name.rlike("^[a-z][a-zA-Z0-9]*$"), "camel").when(name.rlike("^[A-Z][a-zA-Z0-9]*$"), "pascal").when(name.rlike("^[a-z][a-z0-9_]*$") & name.contains("_"), "snake").otherwise("other")


def naming(files: DataFrame) -> DataFrame:
    return definitions(files).groupBy("repo", naming_style(F.col("name")).alias("style")).agg(F.count("*").alias("n"))


SAMPLED, LEAST_SAMPLED, THRESHOLD = 10, 3, 0.7  # fixed values: files looked at of a folder, the fewest that tell anything, the share that is a habit


def file_habits(files: DataFrame) -> DataFrame:
    """What each script does: counts of its import and export lines and their forms, of tries and throws, and of its outline's functions, return types
    and naming styles."""
    lines = lambda word: F.filter(F.split("content", "\n", -1), lambda x: x.rlike(rf"^\s*{word}\s+\S"))
    of = lambda values, pattern: F.size(F.filter(values, lambda x: x.rlike(pattern)))
    imports, exports = lines("import"), lines("export")
    counted = files.select(
        "file_id", "repo", F.size(imports).alias("imports"), of(imports, r"from\s+['\"]\.\.?/").alias("relative"), of(imports, r"\.js['\"]").alias("js"), of(imports, r"^\s*import\s+type\s+").alias("types"),
        F.size(exports).alias("exports"), (F.size(exports) - of(exports, r"(?<![A-Za-z0-9_])default(?![A-Za-z0-9_])")).alias("named"), F.regexp_count("content", F.lit(r"(?<![A-Za-z0-9_])try\s*\{")).alias("tries"),
        F.regexp_count("content", F.lit(r"(?<![A-Za-z0-9_])throw\s+new(?![A-Za-z0-9_])")).alias("throws"), T.is_test_path(F.col("path")).alias("test"),
    )
    symbols = outlines(files)
    function = F.col("kind").isin("function", "method")
    named = function | F.col("kind").isin("class", "interface", "type")
    explicit = function & (F.col("signature").rlike(r"\)\s*:\s*[^=]") | F.col("signature").rlike(r"->\s*[^=]"))
    sum_of = lambda c: F.sum(c.cast("long"))
    style = naming_style(F.col("name"))
    shape = symbols.groupBy("file_id").agg(
        sum_of(function).alias("functions"), F.sum(F.when(function, F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)).otherwise(0)).alias("lines"), sum_of(explicit).alias("returns"),
        sum_of(explicit & F.col("signature").rlike(r"(?<![A-Za-z0-9_])void(?![A-Za-z0-9_])")).alias("voids"), sum_of(explicit & F.col("signature").rlike(r"(?<![A-Za-z0-9_])Promise\s*<")).alias("promises"), *[sum_of(named & (style == k)).alias(k) for k in STYLES],
    )
    return counted.join(shape, "file_id", "left").fillna(0)


STYLES = {"camel": "camelCase", "pascal": "PascalCase", "snake": "snake_case", "other": "mixed"}


def conventions(files: DataFrame, sampled: int = SAMPLED, threshold: float = THRESHOLD) -> DataFrame:
    """(repo, n_files, key, detail, confidence): habits of the largest scripts of each repository. A habit needs three files that could show it and
    the share of those that do. Repositories with fewer scripts have none."""
    scripts = files.where(T.extension(F.col("path")).isin("ts", "tsx", "js", "jsx"))
    sized = scripts.withColumn("_size", F.octet_length("content"))
    largest = sized.withColumn("_n", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("_size"), "file_id"))).where(F.col("_n") <= max(LEAST_SAMPLED, sampled)).drop("_n", "_size")
    h = file_habits(largest)
    ratio = lambda part, total: F.when(total > 0, part / total).otherwise(0.0)
    count = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("long"))

    def habit(key: str, detail, able, does):
        share = ratio(count(able & does), count(able))
        return F.when((count(able) >= LEAST_SAMPLED) & (share >= threshold), F.struct(F.lit(key).alias("key"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"), share.alias("confidence")))

    c = F.col
    tries, returns, imports, exports = c("tries") + c("throws") >= 2, c("returns") >= 3, c("imports") >= 2, c("exports") >= 2
    promise = habit("returns", "Promise-returning public functions are dominant", returns, ratio(c("promises"), c("returns")) >= threshold)
    total = c("camel") + c("pascal") + c("snake") + c("other")
    ordered = F.array_sort(F.array(*[F.struct((-c(k)).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(STYLES)]))
    own = F.when((total >= 4) & (ratio(F.greatest(*STYLES), total) >= threshold), ordered[0]["k"])
    styles = [count(own == k) for k in STYLES]
    able = sum(styles[1:], styles[0])
    best = F.array_sort(F.array(*[F.struct((-n).alias("n"), F.lit(i).alias("i"), F.lit(label).alias("label")) for i, (n, label) in enumerate(zip(styles, STYLES.values()))]))[0]
    naming_ = F.when((able >= LEAST_SAMPLED) & (-best["n"] / able >= threshold), F.struct(F.lit("naming").alias("key"), F.concat(best["label"], F.lit(" identifiers dominate")).alias("detail"), (-best["n"] / able).alias("confidence")))
    with_functions = count(c("functions") > 0)
    style = F.when((F.sum("functions") >= 5) & (with_functions >= LEAST_SAMPLED) & (with_functions / F.count("*") >= threshold), F.struct(F.lit("style").alias("key"), F.concat(F.lit("avg "), F.floor(F.sum("lines") / F.sum("functions") + 0.5).cast("string"), F.lit(" lines/function")).alias("detail"), (with_functions / F.count("*")).alias("confidence")))
    found = [
        habit("errors", "try/catch style dominant, limited bare throws", tries, (ratio(c("tries"), c("tries") + c("throws")) >= threshold) & (c("tries") > 0)), F.coalesce(promise, habit("returns", "non-void return signatures dominate", returns, ratio(c("returns") - c("voids"), c("returns")) >= threshold)),
        naming_, habit("imports", "relative imports are dominant", imports, ratio(c("relative"), c("imports")) >= threshold), habit("imports", ".js import extensions are consistently used", imports, ratio(c("js"), c("imports")) >= threshold),
        habit("imports", "`import type` separation is common", imports, ratio(c("types"), c("imports")) >= threshold), style, habit("exports", "named exports dominate", exports, ratio(c("named"), c("exports")) >= threshold), habit("tests", "test/spec file layout is common nearby", F.lit(True), c("test")),
    ]
    grouped = h.groupBy("repo").agg(F.count("*").alias("n_files"), F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found")).where(F.col("n_files") >= LEAST_SAMPLED)
    return grouped.select("repo", "n_files", F.explode("found").alias("f")).select("repo", "n_files", "f.key", "f.detail", F.round("f.confidence", 4).alias("confidence"))


def changed_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, name, change): definitions whose line differs between two versions of the same files."""

    def hashed(files: DataFrame, out: str) -> DataFrame:
        lines = source_lines(files).select("file_id", F.regexp_extract("line", DEFINITION, 1).alias("name"), "line_no", "line").where("name <> ''")
        return lines.groupBy("file_id", "name").agg(T.short_hash(F.min_by("line", "line_no"), 8).alias(out))

    both = hashed(before, "old").join(hashed(after, "new"), ["file_id", "name"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("file_id", "name", change.alias("change"))


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    """(file_id, n_matches, n_lines, hash): what renaming a whole word does to each file that has it; nothing is written."""
    pattern = rf"(?<![A-Za-z0-9_]){old}(?![A-Za-z0-9_])"
    changed = F.regexp_replace("content", pattern, new)
    lines = F.zip_with(F.split("content", "\n", -1), F.split(changed, "\n", -1), lambda a, b: F.when(a != b, 1).otherwise(0))
    return files.where(F.col("content").contains(old)).select("file_id", F.regexp_count("content", F.lit(pattern)).cast("long").alias("n_matches"), F.aggregate(lines, F.lit(0), lambda a, x: a + x).cast("long").alias("n_lines"), F.substring(F.sha2(changed, 256), 1, 8).alias("hash")).where("n_matches > 0")


def insert_after_imports(files: DataFrame, statement: str) -> DataFrame:
    """(file_id, at_line, hash): the file with a line after its last import, unless it has the line; nothing is written."""
    lines = F.split("content", "\n", -1)
    hits = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"^(import|from|use|#include|require)\b"), i + 1).otherwise(0)), lambda x: x > 0)
    at = F.when(F.exists(lines, lambda x: F.trim(x) == statement), -1).otherwise(F.coalesce(F.array_max(hits), F.lit(0)))
    made = files.select("file_id", lines.alias("l"), at.cast("int").alias("at"))
    whole = F.when(F.col("at") < 0, F.array_join("l", "\n")).otherwise(F.array_join(F.concat(F.slice("l", 1, F.greatest("at", F.lit(0))), F.array(F.lit(statement)), F.slice("l", F.greatest("at", F.lit(0)) + 1, F.size("l"))), "\n"))
    return made.select("file_id", F.col("at").cast("long").alias("at_line"), F.substring(F.sha2(whole, 256), 1, 8).alias("hash"))


# --- outlines ---


QUOTED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`?", re.S)
CHARACTER = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"?|'(?:\\.[^'\n]{0,8}|[^'\\\n])'", re.S)


def blanked(text: str, language: str) -> str:
    """A text of equal length in which comments and literals are spaces."""
    if language == "ruby":
        return re.sub(r"#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    return (CHARACTER if language == "rust" else QUOTED).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


class Braces:
    """Which brace closes which, in one pass over a text without literals."""

    def __init__(self, text: str) -> None:
        self.text, self.opens, self.closes, stack = text, [], {}, []
        for m in re.finditer("[{}]", text):
            if m[0] == "{":
                stack.append(m.start())
                self.opens.append(m.start())
            elif stack:
                self.closes[stack.pop()] = m.end()

    def end(self, at: int) -> int:
        """The offset after the block or statement that begins at `at`: its braces, or its line."""
        k = bisect_left(self.opens, at)
        opening = self.opens[k] if k < len(self.opens) else -1
        line_end = self.text.find("\n", at)
        line_end = len(self.text) if line_end < 0 else line_end
        if opening < 0 or ";" in self.text[at : min(opening, line_end)] or (opening > line_end and ";" in self.text[at:opening]):
            return line_end
        return self.closes.get(opening, len(self.text))


def outline(text: str, language: str) -> list[tuple[str, str, int, int, int]]:
    """(kind, name, level, start line, end line) of declarations, in order. Python by its own grammar, other languages by declaration lines
    and braces; a file that doesn't parse falls back to those."""
    if language == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
            found: list[tuple[str, str, int, int, int]] = []

            def walk(body: list, level: int) -> None:
                for node in body:
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        kind = "class" if isinstance(node, ast.ClassDef) else "method" if level else "function"
                        found.append((kind, node.name, level, node.lineno, node.end_lineno or node.lineno))
                        if isinstance(node, ast.ClassDef):
                            walk(node.body, level + 1)

            walk(tree.body, 0)
            return found
        except (SyntaxError, ValueError, RecursionError):
            pass
    kinds = {"def": "function", "fn": "function", "func": "function", "function*": "function", "impl": "class", "struct": "class", "trait": "interface", "module": "module"}
    bare = blanked(text, language)
    braces, breaks = Braces(bare), [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(breaks, at) + 1
    return [(kinds.get(m[2], m[2]), m[3], len(m[1].expandtabs(4)) // 2, line(m.start(2)), line(braces.end(m.end()))) for m in BRACED.finditer(bare)]


def outlines(files: DataFrame, length: int = 4) -> DataFrame:
    """(file_id, ordinal, kind, name, level, start_line, end_line, hash, signature); a signature is a declaration up to its body."""
    names = ["file_id", "ordinal", "kind", "name", "level", "start_line", "end_line", "hash", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, language, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = text.split("\n")
                for k, (kind, name, level, a, b) in enumerate(outline(text, language or "")):
                    own = "\n".join(lines[a - 1 : b]).strip()
                    signature = " ".join(re.split(r"\{|=>|;|:\s*\n" if language != "python" else r":\s*(?:\n|\Z)", own, maxsplit=1)[0].split())
                    rows.append((file_id, k, kind, name, level, a, b, hashlib.sha256(own.encode()).hexdigest()[:length], signature))
            columns = list(zip(*rows)) or [()] * 9
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = f"file_id {files.schema['file_id'].dataType.simpleString()}, ordinal int, kind string, name string, level int, start_line int, end_line int, hash string, signature string"
    return files.select("file_id", T.language_of(F.col("path")).alias("language"), "content").mapInArrow(run, schema)


def changed_outlines(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, name, nth, change): symbols whose text differs between two versions of the same files; `nth` counts the symbols of one name in a
    file, from 1."""

    def hashed(files: DataFrame, out: str) -> DataFrame:
        order = Window.partitionBy("file_id", "name").orderBy("ordinal")
        return outlines(files, 32).select("file_id", "name", F.row_number().over(order).alias("nth"), F.col("hash").alias(out))

    both = hashed(before, "old").join(hashed(after, "new"), ["file_id", "name", "nth"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("file_id", "name", "nth", change.alias("change"))


def callers(files: DataFrame) -> DataFrame:
    """(file_id, ordinal, name, n_lines, n_files): for each symbol the lines of its repository that mention it, without those from its first to its
    last line in its own file."""
    symbols = outlines(files).join(files.select("file_id", "repo"), "file_id").select("file_id", "repo", "ordinal", "name", "start_line", "end_line")
    words = word_lines(files).groupBy("repo", "name", "file_id").agg(F.collect_list("line_no").alias("lines"))
    total = words.groupBy(F.col("repo").alias("_repo"), F.col("name").alias("_name")).agg(F.sum(F.size("lines")).alias("_lines"), F.count("*").alias("_files"))
    own = words.select("file_id", "name", "lines")
    met = symbols.join(own, ["file_id", "name"], "left").join(total, F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("name") == F.col("_name")), "left")
    inside = F.coalesce(F.size(F.filter("lines", lambda n: n.between(F.col("start_line"), F.col("end_line")))), F.lit(0))
    return met.select("file_id", "ordinal", "name", (F.coalesce("_lines", F.lit(0)) - inside).alias("n_lines"), (F.coalesce("_files", F.lit(0)) - F.when(inside == F.size("lines"), 1).otherwise(0)).alias("n_files"))
