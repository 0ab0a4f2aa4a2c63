"""Rules over log lines (log_id, line_no, text).

What depends on neighbours works on blocks of BLOCK consecutive line numbers: windows run inside (log_id, block) and one
row per block carries over what a block needs from those before it. A log of any length so spreads over many tasks; only the
small table of blocks is ever ordered per log.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.tables import ensure_checkpoint_dir

BLOCK = 8192
TOGETHER = 4096  # blocks whose sums one task adds up
WHOLE_LINES = 500_000  # lines of a log that one task folds in memory; longer logs are folded as tables, with the same result

# Patterns of the rules. Word ends are those of ASCII words.
COLOUR = r"\x1B\[[0-9;]*[a-zA-Z]|\x1B\][^\x07]*\x07|\r"  # a carriage return in a line of a table is a lone one or ends the line
PROGRESS = r"(^\s*(Downloading|Uploading|Installing|Building).+[0-9]+%|[█▓░━⣾⠿]|(?<![A-Za-z0-9_])[0-9]+%(?=[A-Za-z0-9_])|^\s*\[[-= >]+\])"
DEBUG = r"(?<![A-Za-z0-9_])(DEBUG|debug)(?![A-Za-z0-9_])"
HEALTH = r"(?i)/(health|healthz|readyz|livez)(?![A-Za-z0-9_])"
AGENT_SIGN = r"(Mozilla/5\.0|AppleWebKit/|Chrome/[0-9]+|Safari/[0-9]+|Firefox/[0-9]+|curl/[0-9]+)"
AGENT = r'"[^"]*(Mozilla/5\.0|AppleWebKit/|Chrome/[0-9]+|Safari/[0-9]+|Firefox/[0-9]+)[^"]*"'
BANNER = r"^\s*[=_\-]{5,}\s*$|^\s*\|.*\|\s*$|(?i:(Starting|Started|Booting|Initializing|Listening on|Migrations? complete|Ready in)(?![A-Za-z0-9_]))"
JSON_OBJECT = r"^\s*\{.*\}\s*$"
PASS = r"^(?:\(pass\)|\s*(?:✓|✔|PASS(?![A-Za-z0-9_])|--- PASS:|test .* \.\.\. ok(?![A-Za-z0-9_])|PASSED(?![A-Za-z0-9_])))"
FAIL = r"^(?:\(fail\)|\s*(?:✗|✘|FAIL(?![A-Za-z0-9_])|FAILED(?![A-Za-z0-9_])|--- FAIL:|test .* \.\.\. FAILED(?![A-Za-z0-9_])|not ok(?![A-Za-z0-9_])))"
SUMMARIES = r"(?i)^(Test Suites:|Tests:|Ran [0-9]+ tests|[0-9]+ passing|[0-9]+ failing|[0-9]+ passed|[0-9]+ failed)"
LINT_FILE = r"^\./.*\s(?:format|lint|organizeImports)\s"
TYPE_ERRORS = (r"^(.+)\([0-9]+,[0-9]+\):\s+error\s+TS[0-9]+:", r"^(.+):[0-9]+:\s+error:")
STAMPS = {
    "iso": r"^\[?[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z?\]?\s*",
    "syslog": r"^[A-Z][a-z]{2}\s+[0-9]+\s+[0-9]{2}:[0-9]{2}:[0-9]{2}\s+",
    "epoch": r"^[0-9]{10,13}\s+",
}
FIRST, LAST = -1, 2_147_483_647  # places in front of and behind all lines of a log


def clean_lines(lines: DataFrame, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each line once, without colours and trailing white space; null is blank; with its block and, if asked for, a `key` of its text. All
    expressions on text run before the one shuffle by block: taking repeated lines as one, the windows and the sums over blocks
    use its partitioning, and branches of a plan read the same exchange again."""
    block = F.floor(F.col("line_no") / BLOCK).cast("int").alias("block")
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), COLOUR, ""), r"[ \t]+$", "")
    made = lines.select("log_id", block, "line_no", text.alias("text"))
    if key is not None:
        made = made.withColumn("key", key(F.col("text")))
    columns = [c for c in ("text", "key") if c in made.columns]
    return made.repartition("log_id", "block").groupBy("log_id", "block", "line_no").agg(*[F.min(c).alias(c) for c in columns])


def runs_in_order(lines: DataFrame) -> DataFrame:
    """(log_id, key, first_line, last_line, n_lines, first_text, last_text): runs of neighbouring lines with equal keys, over blocks. Runs are found
    in each block; one row a block says which of them go on from the block before."""
    own = Window.partitionBy("log_id", "block").orderBy("line_no")
    started = lines.withColumn("_s", F.when(F.lag("key").over(own) == F.col("key"), 0).otherwise(1))
    parts = (
        started.withColumn("_r", F.sum("_s").over(own))
        .groupBy("log_id", "block", "_r")
        .agg(F.min("key").alias("key"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines"), F.min_by("text", "line_no").alias("first_text"), F.max_by("text", "line_no").alias("last_text"))
    )
    edges = started.groupBy("log_id", "block").agg(F.min_by("key", "line_no").alias("_head"), F.max_by("key", "line_no").alias("_tail"), F.sum("_s").alias("_last"))
    order = Window.partitionBy("log_id").orderBy("block")
    edges = edges.withColumn("_goes_on", F.coalesce(F.lag("_tail").over(order) == F.col("_head"), F.lit(False)))
    # the run that the next block's first may continue: this block's last, or what that itself continues
    owner = F.when(~(F.col("_goes_on") & (F.col("_last") == 1)), F.struct("block", "_last"))
    edges = edges.withColumn("_owner", F.last(owner, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    joined = parts.join(edges.select("log_id", "block", "_goes_on", "_owner"), ["log_id", "block"], "left")
    moves = F.col("_goes_on") & (F.col("_r") == 1)
    keyed = joined.withColumns({"_b": F.when(moves, F.col("_owner.block")).otherwise(F.col("block")), "_k": F.when(moves, F.col("_owner._last")).otherwise(F.col("_r"))})
    return keyed.groupBy("log_id", "_b", "_k").agg(F.min("key").alias("key"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.sum("n_lines").alias("n_lines"), F.min_by("first_text", "first_line").alias("first_text"), F.max_by("last_text", "last_line").alias("last_text")).drop("_b", "_k")


def block_sums(lines: DataFrame, **flags: Column) -> DataFrame:
    """`lines` with a column a flag: how many lines of the log up to and with this one have it. Counted in blocks, then over groups of blocks, then over
    the groups, so that no task holds a log's lines or blocks."""
    own = Window.partitionBy("log_id", "block").orderBy("line_no")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumns({f"_f_{k}": v.cast("long") for k, v in flags.items()})
    group = F.floor(F.col("block") / TOGETHER)
    sums = marked.groupBy("log_id", "block").agg(*[F.sum(f"_f_{k}").alias(f"_n_{k}") for k in flags]).withColumn("_group", group)
    groups = sums.groupBy("log_id", "_group").agg(*[F.sum(f"_n_{k}").alias(f"_g_{k}") for k in flags])
    groups = groups.select("log_id", "_group", *[F.coalesce(F.sum(f"_g_{k}").over(before("log_id", "_group")), F.lit(0)).alias(f"_far_{k}") for k in flags])
    near = sums.select("log_id", "block", "_group", *[F.coalesce(F.sum(f"_n_{k}").over(before("log_id", "_group", "block")), F.lit(0)).alias(f"_near_{k}") for k in flags])
    offsets = near.join(groups, ["log_id", "_group"]).select("log_id", "block", *[(F.col(f"_near_{k}") + F.col(f"_far_{k}")).alias(f"_o_{k}") for k in flags])
    counted = marked.join(offsets, ["log_id", "block"]).withColumns({k: F.sum(f"_f_{k}").over(own) + F.col(f"_o_{k}") for k in flags})
    return counted.drop(*[f"{p}_{k}" for k in flags for p in ("_f", "_o")])


def body(lines: DataFrame, part: int = 0) -> DataFrame:
    """Lines as what a rule leaves: (log_id, line_no, part, text); part orders what stands at one place."""
    return lines.select("log_id", "line_no", F.lit(part).alias("part"), "text")


def mark(rows: DataFrame, text: Column, place: Column | int, part: Column | int = 1) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return rows.select("log_id", lit(place).cast("int").alias("line_no"), lit(part).cast("int").alias("part"), text.alias("text"))


def said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def fold_repeats(lines: DataFrame) -> DataFrame:
    """The first line of each run of lines that are equal but for numbers, and how often it was repeated. `lines` as in the table."""
    return fold_repeats_clean(clean_lines(lines))


def fold_repeats_clean(lines: DataFrame) -> DataFrame:
    runs = runs_in_order(lines.withColumn("key", T.normalize_log_line(F.col("text"))))
    first = runs.select("log_id", F.col("first_line").alias("line_no"), F.lit(0).alias("part"), F.col("first_text").alias("text"))
    return first.unionByName(mark(runs.where("n_lines > 1 AND key <> ''"), said("[repeated ", F.col("n_lines") - 1, "x]"), F.col("first_line")))


def fold_progress(lines: DataFrame) -> DataFrame:
    """The last line of each run of progress lines, and how many it stands for; all other lines. `lines` as in the table."""
    return fold_progress_clean(clean_lines(lines))


def fold_progress_clean(lines: DataFrame) -> DataFrame:
    keyed = lines.withColumn("key", F.col("text").rlike(PROGRESS).cast("int"))
    runs = runs_in_order(keyed).where("key = 1")
    last = runs.select("log_id", F.col("last_line").alias("line_no"), F.lit(0).alias("part"), F.col("last_text").alias("text"))
    return body(keyed.where("key = 0")).unionByName(last).unionByName(mark(runs.where("n_lines > 1"), said("[progress: ", F.col("n_lines") - 1, " lines collapsed]"), F.col("last_line")))


def fold_global_repeats(lines: DataFrame, least: int = 3, length: int = 12) -> DataFrame:
    """Of lines that occur often in a log, whatever their place, the first; and how many are folded. `lines` are clean."""
    keyed = lines.withColumn("norm", T.normalize_log_line(F.col("text")))
    often = keyed.where(F.length("norm") >= length).groupBy("log_id", "norm").agg(F.min("line_no").alias("_first"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    kept = keyed.join(often, ["log_id", "norm"], "left").where(F.col("_first").isNull() | (F.col("_first") == F.col("line_no")))
    folded = often.groupBy("log_id").agg(F.sum(F.col("_n") - 1).alias("n"))
    return body(kept).unionByName(mark(folded, said("[global repeats folded: ", F.col("n"), "]"), LAST))


def collapse_blanks(lines: DataFrame) -> DataFrame:
    """Lines with one blank line for each run of them. `lines` as in the table."""
    return collapse_blanks_clean(clean_lines(lines))


def collapse_blanks_clean(lines: DataFrame) -> DataFrame:
    keyed = lines.withColumn("key", (F.col("text") == "").cast("int"))
    runs = runs_in_order(keyed).where("key = 1")
    return body(keyed.where("key = 0")).unionByName(runs.select("log_id", F.col("first_line").alias("line_no"), F.lit(0).alias("part"), F.lit("").alias("text")))


def drop_matching(lines: DataFrame, pattern: str, label: str) -> DataFrame:
    """Lines that don't match, and in front how many did."""
    hit = F.col("text").rlike(pattern)
    gone = lines.where(hit).groupBy("log_id").agg(F.count("*").alias("n"))
    return body(lines.where(~hit)).unionByName(mark(gone, said(f"[{label} stripped: ", F.col("n"), "]"), FIRST))


def json_levels(lines: DataFrame, least: int = 6) -> DataFrame:
    """(log_id, n, error, warn, info, debug, other): levels of the object lines of logs that have enough of them; what can't be parsed is other."""
    parsed = F.try_parse_json("text")
    level = F.coalesce(F.get_json_object("text", "$.level"), F.get_json_object("text", "$.severity"), F.lit(""))
    level = F.when(parsed.isNull() | level.startswith("{"), "").otherwise(F.lower(level))
    kind = F.when(level.contains("error"), "error").when(level.contains("warn"), "warn").when(level.contains("info"), "info").when(level.contains("debug"), "debug").otherwise("other")
    counted = lines.where(F.col("text").rlike(JSON_OBJECT)).groupBy("log_id").agg(F.count("*").alias("n"), *[F.sum((kind == k).cast("long")).alias(k) for k in ("error", "warn", "info", "debug", "other")])
    return counted.where(F.col("n") >= least)


def fold_json(lines: DataFrame) -> DataFrame:
    """Lines without the object lines of logs that have at least six, and in front their levels."""
    levels = json_levels(lines)
    told = said("[json lines folded: ", F.col("n"), " (", F.concat_ws(", ", *[said(f"{k}:", F.col(k)) for k in ("error", "warn", "info", "debug", "other")]), ")]")
    kept = lines.join(levels.select("log_id", "n"), "log_id", "left").where(F.col("n").isNull() | ~F.col("text").rlike(JSON_OBJECT))
    return body(kept).unionByName(mark(levels, told, FIRST))


def fold_startup(lines: DataFrame, least: int = 10, most: int = 3) -> DataFrame:
    """Lines without the banner and startup lines of logs of at least ten lines with more than three of those, and in front their number."""
    hit = F.col("text").rlike(BANNER)
    counted = lines.groupBy("log_id").agg(F.count("*").alias("_all"), F.sum(hit.cast("long")).alias("n")).where((F.col("_all") >= least) & (F.col("n") > most))
    kept = lines.join(counted.select("log_id", "n"), "log_id", "left").where(F.col("n").isNull() | ~hit)
    return body(kept).unionByName(mark(counted, said("[startup lines folded: ", F.col("n"), "]"), FIRST))


def elide_tests(lines: DataFrame) -> DataFrame:
    """Lines without those of passing tests, in logs with five of them or a failing one; in front the numbers, at the end a word if all passed."""
    passed, failed, summary = (F.col("text").rlike(p) for p in (PASS, FAIL, SUMMARIES))
    counts = lines.groupBy("log_id").agg(*[F.sum(c.cast("long")).alias(n) for c, n in ((passed, "p"), (failed, "f"), (summary, "s"))]).where("NOT (p < 5 AND f = 0)")
    kept = lines.join(counts, "log_id", "left").where(F.col("p").isNull() | ~(passed | ((F.col("f") == 0) & ~summary & F.col("text").startswith("tests/"))))
    told = mark(counts, said("[tests pruned: ", F.col("p"), " passing stripped, ", F.col("f"), " failing kept]"), FIRST)
    return body(kept).unionByName(told).unionByName(mark(counts.where("s = 0 AND f = 0"), F.lit("[all tests passed]"), LAST))


def fold_lint(lines: DataFrame) -> DataFrame:
    """Of each block of a linter's diagnostics (a file's line up to a blank one or the next file) the first line, numbered, and its first message."""
    opens = F.col("text").rlike(LINT_FILE)
    parts = block_sums(lines, _part=opens | (F.col("text") == ""), _k=opens)  # _part 0: before the first of them
    first = parts.groupBy("log_id", "_part").agg(F.min("line_no").alias("_from"), F.min_by(opens, "line_no").alias("_lint"), F.min(F.when(F.col("text").contains("×"), F.col("line_no"))).alias("_told"))
    numbered = parts.join(first, ["log_id", "_part"])
    head = F.col("_lint") & (F.col("line_no") == F.col("_from"))
    kept = numbered.where(~F.col("_lint") | head | (F.col("line_no") == F.col("_told")))
    return kept.select("log_id", "line_no", F.lit(0).alias("part"), F.when(head, said("[diagnostic block ", F.col("_k"), "] ", F.col("text"))).otherwise(F.col("text")).alias("text"))


def fold_types(lines: DataFrame, most: int = 3) -> DataFrame:
    """Lines without type errors, and at the end of each log the files with errors, in the order of their first, with their number and the
    first three. Parts number what is added: ten places a file."""
    file = F.coalesce(*[F.when(F.col("text").rlike(p), F.regexp_extract("text", p, 1)) for p in TYPE_ERRORS])
    files = lines.select("log_id", "block", "line_no", "text", file.alias("file")).where("file IS NOT NULL").withColumns({"n": F.lit(1), "_top": F.array(F.struct("line_no", "text"))})
    for level in (F.col("block"), F.floor(F.col("block") / TOGETHER), F.lit(0)):  # the first of each block, of groups of blocks, of the log
        files = files.withColumn("block", level).groupBy("log_id", "file", "block").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("_top"))), 1, most).alias("_top"))
    files = files.withColumn("_first", F.col("_top")[0]["line_no"])
    files = files.withColumn("_at", 10 * F.row_number().over(Window.partitionBy("log_id").orderBy("_first")))
    more = mark(files.where(F.col("n") > most), said("[typecheck] ", F.col("n") - most, " more errors folded"), LAST, F.col("_at") + most + 1)
    shown = files.select("log_id", "_at", F.posexplode("_top").alias("_k", "_e"))
    return body(lines.where(file.isNull())).unionByName(mark(files, said("[typecheck] ", F.col("file"), ": ", F.col("n"), " errors"), LAST, F.col("_at"))).unionByName(mark(shown, F.col("_e.text"), LAST, F.col("_at") + F.col("_k") + 1)).unionByName(more)


def timestamp_vote(lines: DataFrame) -> DataFrame:
    """(log_id, n_lines, counts by form of timestamp, the form that most lines have; null if none has any)"""
    counts = lines.groupBy("log_id").agg(F.count("*").alias("n_lines"), *[F.sum(F.col("text").rlike(p).cast("long")).alias(k) for k, p in STAMPS.items()])
    return counts.withColumn("form", F.coalesce(*[F.when((F.col(k) == F.greatest(*STAMPS)) & (F.col(k) > 0), F.lit(k)) for k in STAMPS]))


def strip_timestamps(lines: DataFrame, logs: DataFrame, share: float = 0.8) -> DataFrame:
    """Lines without the form of timestamp that most of their log's lines have, if the log says `strip`, or at least `share` have it and it
    doesn't say `keep`; in front the form's name."""
    mode = F.lower(F.col("_mode"))
    modes = logs.groupBy("log_id").agg(F.max("strip_timestamps").alias("_mode"))
    chosen = timestamp_vote(lines).join(modes, "log_id", "left").where("form IS NOT NULL")
    stripping = F.coalesce(mode == "strip", F.lit(False)) | (~F.coalesce(mode == "keep", F.lit(False)) & (F.greatest(*STAMPS) >= share * F.col("n_lines")))
    chosen = chosen.where(stripping).select("log_id", "form")
    bare = F.coalesce(*[F.when(F.col("form") == k, F.regexp_replace("text", p, "")) for k, p in STAMPS.items()], F.col("text"))
    return body(lines.join(chosen, "log_id", "left").withColumn("text", bare)).unionByName(mark(chosen, said("[timestamps stripped: ", F.col("form"), "]"), FIRST))


# --- the whole chain -------------------------------------------------------------------------------------------------------

ERROR_START = re.compile(r"^(Error|Caused by|Exception|Traceback|panic:)")
RETRY = re.compile(r"Retry\s+[0-9]+/[0-9]+", re.I)
NUMBERS = [(re.compile(r"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])"), "#"), (re.compile(r"[A-Fa-f0-9]{7,40}"), "<hash>"), (re.compile(r"0[xX][0-9a-fA-F]+"), "0x#")]
COMPILED = {k: re.compile(v) for k, v in {"colour": COLOUR, "progress": PROGRESS, "health": HEALTH, "debug": DEBUG, "banner": BANNER, "agent": AGENT, "agent_sign": AGENT_SIGN}.items()}
JSON_LINE, PASSED, FAILED, SUMMARY, LINTED = (re.compile(p) for p in (JSON_OBJECT, PASS, FAIL, SUMMARIES, LINT_FILE))
TYPED = tuple(re.compile(p) for p in TYPE_ERRORS)
TIMES = {k: re.compile(p) for k, p in STAMPS.items()}
PROFILES = {
    "test": {"progress": False, "startup": False, "rules": [{"type": "fold", "pattern": r"^\(pass\)", "label": "passes"}]},
    "ci": {
        "rules": [
            {"type": "strip", "pattern": r"^npm warn deprecated\b"},
            {"type": "strip", "pattern": r"^[0-9]+ packages are looking for funding"},
            {"type": "strip", "pattern": r"^\s+run `npm fund`"},
            {"type": "fold", "pattern": r"^Run actions/", "label": "ci-setup"},
        ]
    },
    "lint": {
        "startup": False,
        "json": False,
        "rules": [
            {"type": "block", "start": r"^\./", "end": r"^\s*$", "label": "diagnostic"},
            {"type": "strip", "pattern": r"^\s*[0-9]+\s+[0-9]+\s+│"},
            {"type": "strip", "pattern": r"^\s*[0-9]+\s+│"},
        ],
    },
    "runtime": {"stamps": "strip"},
}


def normal(line: str) -> str:
    for pattern, mark in NUMBERS:
        line = pattern.sub(mark, line)
    return line.strip()


Lines = list  # the lines of a log of at most WHOLE_LINES; longer ones go through the rules as tables


def size(lines: Iterable[str]) -> int:
    return sum(len(x.split()) for x in lines)


def clean(line: str) -> str:
    return COMPILED["colour"].sub("", line).rstrip()


def fold_hits(lines: Lines, pattern: re.Pattern, label: str) -> Iterator[str]:
    n = 0
    for x in lines:
        if pattern.search(x):
            n += 1
            continue
        if n:
            yield f"[{label}: {n} lines]"
            n = 0
        yield x
    if n:
        yield f"[{label}: {n} lines]"


def fold_blocks(lines: Lines, start: re.Pattern, end: re.Pattern, label: str) -> Iterator[str]:
    inside = 0
    for x in lines:
        if inside:
            inside += 1
            if end.search(x):
                yield f"[{label}: {inside} lines folded]"
                inside = 0
        elif start.search(x):
            inside = 1
        else:
            yield x
    if inside:
        yield f"[{label}: {inside} lines folded]"


def progress_folded(lines: Lines) -> Iterator[str]:
    n, last = 0, ""

    def folded() -> list[str]:
        return [last] * (n > 0) + [f"[progress: {n - 1} lines collapsed]"] * (n > 1)

    for x in lines:
        if COMPILED["progress"].search(x):
            n, last = n + 1, x
            continue
        yield from folded()
        n = 0
        yield x
    yield from folded()


def json_level(line: str) -> str:
    def refuse(name: str) -> None:
        raise ValueError(name)

    def said(value: object) -> str:
        return ",".join(map(said, value)) if isinstance(value, list) else "" if value is None or isinstance(value, dict) else str(value).lower()

    try:
        made = json.loads(line, parse_constant=refuse)
    except (ValueError, RecursionError):
        return "other"
    level = said(made.get("severity") if made.get("level") is None else made["level"])
    return next((k for k in ("error", "warn", "info", "debug") if k in level), "other")


def fold_tests(lines: Lines, passed: int, failed: int, summaries: int) -> Iterator[str]:
    yield f"[tests pruned: {passed} passing stripped, {failed} failing kept]"
    for x in lines:
        if not (PASSED.search(x) or (not failed and x.startswith("tests/") and not SUMMARY.search(x))):
            yield x
    if not summaries and not failed:
        yield "[all tests passed]"


def fold_linted(lines: Lines) -> Iterator[str]:
    n, inside, told = 0, False, False
    for x in lines:
        if LINTED.search(x):
            n, inside, told = n + 1, True, False
            yield f"[diagnostic block {n}] {x}"
        elif inside and x:
            if not told and "×" in x:
                told = True
                yield x
        else:
            inside = False
            yield x


def typed_file(line: str) -> str | None:
    m = ("error" in line) and (TYPED[0].match(line) or TYPED[1].match(line))
    return m[1] if m else None


def fold_typed(lines: Lines) -> Iterator[str]:
    """The lines without type errors, then the first three errors of each file."""
    found: dict[str, list] = {}
    for x in lines:
        file = typed_file(x)
        if file is None:
            yield x
            continue
        group = found.setdefault(file, [0])
        group[0] += 1
        if len(group) <= 3:
            group.append(x)
    for file, (n, *first) in found.items():
        yield f"[typecheck] {file}: {n} errors"
        yield from first
        if n > 3:
            yield f"[typecheck] {n - 3} more errors folded"


def fold_stacks(lines: Iterable[str]) -> Iterator[str]:
    """A block begins with an error and ends before a blank line or the next error. Blocks like the one before, with blank lines between or not,
    are counted; blank lines behind a block count as between."""
    last, n, block = None, 0, None

    def told() -> Iterator[str]:
        if n:
            yield f"[stack repeated {n}x]"

    def key(block: list[str]) -> tuple[str, ...]:
        return tuple(RETRY.sub("Retry #/#", NUMBERS[0][0].sub("#", x)).strip() for x in block)

    def close() -> Iterator[str]:
        nonlocal last, n, block
        made = key(block)
        if made == last:
            n += 1
        else:
            yield from told()
            yield from block
            last, n = made, 0
        block = None

    for x in lines:
        starts = bool(ERROR_START.match(x))
        if block is not None:
            if x and not starts:
                block.append(x)
                continue
            yield from close()
        if starts:
            block = [x]
        elif x or last is None:  # blank lines behind a block are dropped
            yield from told()
            last, n = None, 0
            yield x
    if block is not None:
        yield from close()
    yield from told()


def fold_equal(lines: Lines, keys: Lines) -> Iterator[str]:
    """Runs of equal lines folded; `keys` gets the normal form of each line that is given back."""
    last, n = None, 0

    def folded() -> Iterator[str]:
        if n > 1 and last:
            keys.append(normal(line := f"[repeated {n - 1}x]"))
            yield line

    for x in lines:
        key = normal(x)
        if key == last:
            n += 1
            continue
        yield from folded()
        keys.append(key)
        yield x
        last, n = key, 1
    yield from folded()


def fold_often(lines: Lines, keys: Lines) -> Iterator[str]:
    counts = Counter(k for k in keys if len(k) >= 12)
    first = {k: True for k, n in counts.items() if n >= 3}
    del counts
    gone = 0
    for x, k in zip(lines, keys):
        fresh = first.get(k)
        if fresh is False:
            gone += 1
            continue
        if fresh:
            first[k] = False
        yield x
    if gone:
        yield f"[global repeats folded: {gone}]"


def one_blank(lines: Lines) -> Iterator[str]:
    before = "x"
    for x in lines:
        if x or before:
            yield x
        before = x


def without_blank_end(lines: Lines) -> Lines:
    last = max((k for k, x in enumerate(lines) if x), default=-1)
    return lines if last == len(lines) - 1 else Lines(islice(iter(lines), last + 1))


def prune_lines(original: Lines, profile: str | None = None, dedupe_stacks: bool = True, rules: list[dict] | None = None, stamps: str | None = None) -> tuple[Lines, list[str]]:
    """Folds one whole log of clean lines: (lines, names of the rules that changed it). Never longer in tokens than what it was given."""
    options = {"progress": True, "startup": True, "json": True, "stamps": "auto", "rules": []} | PROFILES.get((profile or "").strip().lower(), {})
    mode = stamps.strip().lower() if stamps is not None else options["stamps"]
    original = without_blank_end(original)
    out, applied = original, []

    def note(name: str, made: Iterable[str]) -> None:
        nonlocal out
        new, old, same = Lines(), iter(out), True
        for x in made:
            new.append(x)
            same = same and next(old, None) == x
        if not same or next(old, None) is not None:
            out = new
            applied.append(name)

    for rule in [*options["rules"], *(rules or ())]:
        if rule["type"] == "strip":
            pattern = re.compile(rule["pattern"])
            note(f"custom-strip:{rule['pattern']}", (x for x in out if not pattern.search(x)))
        elif rule["type"] == "fold":
            note(f"custom-fold:{rule['pattern']}", fold_hits(out, re.compile(rule["pattern"]), rule.get("label", "folded")))
        elif rule["type"] == "block":
            note(f"custom-block:{rule['start']}..{rule['end']}", fold_blocks(out, re.compile(rule["start"]), re.compile(rule["end"]), rule.get("label", "block")))
    if options["progress"]:
        note("progress-fold", progress_folded(out))
    for name, label, rule in (("debug", "debug lines", "debug-fold"), ("health", "health checks", "health-elision")):
        search = COMPILED[name].search
        kept = Lines(x for x in out if not search(x))
        if gone := len(out) - len(kept):
            note(rule, chain([f"[{label} stripped: {gone}]"], kept))
    if options["json"]:
        levels = Counter(json_level(x) for x in out if JSON_LINE.match(x))
        if (n := levels.total()) >= 6:
            told = ", ".join(f"{k}:{levels[k]}" for k in ("error", "warn", "info", "debug", "other"))
            note("json-line-fold", chain([f"[json lines folded: {n} ({told})]"], (x for x in out if not JSON_LINE.match(x))))
    banner = COMPILED["banner"].search
    banners = sum(bool(banner(x)) for x in out) if options["startup"] else 0
    if len(out) >= 10 and banners > 3:
        note("startup-fold", chain([f"[startup lines folded: {banners}]"], (x for x in out if not banner(x))))
    agent = COMPILED["agent"].sub
    signed = any(COMPILED["agent_sign"].search(x) for x in out)
    note("user-agent-strip", (agent('"<ua>"', x) for x in out))
    if signed and applied[-1:] != ["user-agent-strip"]:
        applied.append("user-agent-strip")
    passed, failed, summaries = (sum(bool(p.search(x)) for x in out) for p in (PASSED, FAILED, SUMMARY))
    if passed >= 5 or failed:
        note("test-runner-elision", fold_tests(out, passed, failed, summaries))
    if any(LINTED.search(x) for x in out):
        note("linter-fold", fold_linted(out))
    note("typecheck-fold", fold_typed(out))
    if mode != "keep" and len(out):
        votes = {k: sum(bool(p.match(x)) for x in out) for k, p in TIMES.items()}
        form = max(votes, key=votes.get)
        if votes[form] and (mode == "strip" or votes[form] / len(out) >= 0.8):
            note(f"timestamp-strip:{form}", chain([f"[timestamps stripped: {form}]"], (TIMES[form].sub("", x) for x in out)))
    if dedupe_stacks:
        note("stack-dedup", fold_stacks(out))
    keys = Lines()
    note("repeat-fold", fold_equal(out, keys))
    note("global-repeat-fold", fold_often(out, keys))
    note("blank-collapse", one_blank(out))
    out = without_blank_end(out)
    return (original, []) if size(out) > size(original) else (out, applied)


def prune(lines: list[str], profile: str | None = None, dedupe_stacks: bool = True, rules: list[dict] | None = None, stamps: str | None = None) -> tuple[list[str], list[str]]:
    """`prune_lines` on a list of lines as they stand in a log."""
    out, applied = prune_lines(Lines(map(clean, lines)), profile, dedupe_stacks, rules, stamps)
    return list(out), applied


# --- the chain on tables ---------------------------------------------------------------------------------------------------


def fold_hits_table(lines: DataFrame, pattern: str, label: str) -> DataFrame:
    """A custom fold: each run of matching lines as one marker."""
    keyed = lines.withColumn("key", F.col("text").rlike(pattern).cast("int"))
    runs = runs_in_order(keyed).where("key = 1")
    return body(keyed.where("key = 0")).unionByName(mark(runs, said(f"[{label}: ", F.col("n_lines"), " lines]"), F.col("first_line"), 0))


def fold_blocks_table(lines: DataFrame, start: str, end: str, label: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A custom block: from a line that opens one to the next that closes it, as one marker. Where a line stands follows from the last line that
    only opens or only closes, and the number of lines since then that do both."""
    opens, closes = F.col("text").rlike(start), F.col("text").rlike(end)
    both, reset = opens & closes, opens != closes
    sums = keep(block_sums(lines, _both=both, _reset=reset))
    begun = sums.where(reset).select("log_id", "_reset", opens.alias("_value"), F.col("_both").alias("_base"))
    state = lambda of, count: F.coalesce(F.col(f"{of}_value"), F.lit(False)).cast("int").bitwiseXOR(((count - F.coalesce(F.col(f"{of}_base"), F.lit(0))) % 2).cast("int")) == 1
    earlier = begun.select("log_id", F.col("_reset").alias("_reset0"), F.col("_value").alias("_was_value"), F.col("_base").alias("_was_base"))
    later = begun.select("log_id", "_reset", F.col("_value").alias("_is_value"), F.col("_base").alias("_is_base"))
    placed = sums.withColumn("_reset0", F.col("_reset") - reset.cast("long")).join(later, ["log_id", "_reset"], "left").join(earlier, ["log_id", "_reset0"], "left")
    known = placed.select("log_id", "block", "line_no", "text", state("_was", F.col("_both") - both.cast("long")).alias("_before"), state("_is", F.col("_both")).alias("_after"))
    numbered = block_sums(keep(known), _block=~F.col("_before") & F.col("_after"))
    inside = F.col("_before") | F.col("_after")
    folded = numbered.where(inside).groupBy("log_id", "_block").agg(F.count("*").alias("n"), F.min("line_no").alias("_first"))
    return body(numbered.where(~inside)).unionByName(mark(folded, said(f"[{label}: ", F.col("n"), " lines folded]"), F.col("_first"), 0))


def fold_stacks_table(lines: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Stacks (from an error to a blank line or the next error) that repeat the one before, blank lines between aside, are counted; blank lines
    behind a stack go. Stacks are compared by their number of lines and a sum of hashes of their normal lines and places."""
    starts, blank = F.col("text").rlike(ERROR_START.pattern), F.col("text") == ""
    parts = keep(block_sums(lines, _part=starts | blank, _full=~blank))
    heads = parts.groupBy("log_id", "_part").agg(F.min("line_no").alias("_first"), F.min_by(starts, "line_no").alias("_stack"))
    plain = ~F.col("_stack") & ~blank
    placed = keep(block_sums(keep(parts.join(heads, ["log_id", "_part"])), _plain=plain))
    normal_line = F.trim(F.regexp_replace("text", r"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])", "#"))
    stacks = placed.where("_stack").groupBy("log_id", "_part").agg(
        F.min("line_no").alias("line_no"), F.max("line_no").alias("_end"), F.min("_plain").alias("_plain"), F.count("*").alias("_n"), F.sum(F.xxhash64(F.col("line_no") - F.col("_first"), normal_line).cast("decimal(38,0)")).alias("_sum")
    )
    keyed = stacks.select("log_id", F.floor(F.col("line_no") / BLOCK).cast("int").alias("block"), "line_no", F.concat_ws("/", "_plain", "_n", "_sum").alias("key"), F.col("_end").cast("string").alias("text"))
    runs = runs_in_order(keyed)
    kept = runs.select("log_id", F.col("first_line").alias("_first"), F.lit(True).alias("_kept"))
    behind = placed.groupBy("log_id", "_full").agg(F.max(F.when(~blank, F.col("_stack")).cast("int")).alias("_of_stack"))
    joined = placed.join(kept, ["log_id", "_first"], "left").join(behind, ["log_id", "_full"], "left")
    stays = F.when(F.col("_stack"), F.coalesce("_kept", F.lit(False))).when(blank, F.coalesce("_of_stack", F.lit(0)) == 0).otherwise(F.lit(True))
    return body(joined.where(stays)).unionByName(mark(runs.where("n_lines > 1"), said("[stack repeated ", F.col("n_lines") - 1, "x]"), F.col("first_text").cast("int")))


def renumber(rows: DataFrame) -> DataFrame:
    """What a rule left as lines numbered from 0, with their blocks."""
    blocked = rows.withColumn("block", F.floor(F.col("line_no") / BLOCK).cast("int"))
    inside = Window.partitionBy("log_id", "block").orderBy("line_no", "part")
    group = F.floor(F.col("block") / TOGETHER)
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy("log_id", "block").agg(F.count("*").alias("_n")).withColumn("_group", group)
    groups = sums.groupBy("log_id", "_group").agg(F.sum("_n").alias("_g")).withColumn("_far", F.coalesce(F.sum("_g").over(before("log_id", "_group")), F.lit(0))).drop("_g")
    offsets = sums.withColumn("_near", F.coalesce(F.sum("_n").over(before("log_id", "_group", "block")), F.lit(0))).join(groups, ["log_id", "_group"]).select("log_id", "block", (F.col("_near") + F.col("_far")).alias("_offset"))
    numbered = blocked.withColumn("_k", F.row_number().over(inside)).join(offsets, ["log_id", "block"])
    made = numbered.select("log_id", (F.col("_k") + F.col("_offset") - 1).cast("int").alias("line_no"), "text")
    return made.withColumn("block", F.floor(F.col("line_no") / BLOCK).cast("int"))


def without_blank_ends(lines: DataFrame) -> DataFrame:
    last = lines.where("text <> ''").groupBy("log_id").agg(F.max("line_no").alias("_last"))
    return lines.join(last, "log_id").where("line_no <= _last").drop("_last")


def prune_tables(lines: DataFrame, options: DataFrame, rules: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """The chain on logs of any length: (lines, (log_id, rule, at)). Each rule is a step on tables, written to the shared checkpoint folder before the
    next, so the plan stays one rule long and a lost executor costs one step. options(log_id, profile, stamps, stacks)."""
    spark = lines.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/prune-{uuid.uuid4().hex}"
    profile = F.lower(F.trim(F.coalesce("profile", F.lit(""))))
    is_ = lambda *names: profile.isin(*names)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def keep(df: DataFrame) -> DataFrame:
        """A part that a rule reads several times."""
        return written(df, f"part-{uuid.uuid4().hex}")

    now = written(without_blank_ends(renumber(body(clean_lines(lines)))), "lines")
    prints = lambda df: df.groupBy("log_id").agg(F.count("*").alias("_n"), F.sum(F.xxhash64("line_no", "text").cast("decimal(38,0)")).alias("_s"))
    applied: list[DataFrame] = []

    def step(name: str, rule, test: Column | None = None) -> None:
        nonlocal now
        on = now if test is None else now.join(options.where(test).select("log_id"), "log_id", "left_semi")
        made = renumber(rule(on)) if test is None else renumber(rule(on)).unionByName(now.join(options.where(test).select("log_id"), "log_id", "left_anti").select("log_id", "line_no", "text", "block"))
        fresh = written(made, f"step-{len(applied)}")
        both = prints(now).join(prints(fresh).select("log_id", F.col("_n").alias("_n2"), F.col("_s").alias("_s2")), "log_id", "left").where(~(F.col("_n").eqNullSafe(F.col("_n2")) & F.col("_s").eqNullSafe(F.col("_s2"))))
        changed = both.select("log_id", F.lit(name).alias("rule"), F.lit(len(applied)).alias("at"))
        applied.append(changed)
        now = fresh

    def custom(rule: dict, test: Column | None) -> None:
        if rule["type"] == "strip":
            step(f"custom-strip:{rule['pattern']}", lambda x: body(x.where(~F.col("text").rlike(rule["pattern"]))), test)
        elif rule["type"] == "fold":
            step(f"custom-fold:{rule['pattern']}", lambda x: fold_hits_table(x, rule["pattern"], rule.get("label", "folded")), test)
        elif rule["type"] == "block":
            step(f"custom-block:{rule['start']}..{rule['end']}", lambda x: fold_blocks_table(x, rule["start"], rule["end"], rule.get("label", "block"), keep), test)

    used = {r[0] for r in options.select(profile).distinct().limit(len(PROFILES) + 50).collect()}
    for name, preset in PROFILES.items():
        for rule in preset.get("rules", ()) if name in used else ():
            custom(rule, is_(name))
    for rule in rules or ():
        custom(rule, None)
    step("progress-fold", fold_progress_clean, ~is_("test"))
    step("debug-fold", lambda x: drop_matching(x, DEBUG, "debug lines"))
    step("health-elision", lambda x: drop_matching(x, HEALTH, "health checks"))
    step("json-line-fold", fold_json, ~is_("lint"))
    step("startup-fold", fold_startup, ~is_("test", "lint"))
    step("user-agent-strip", lambda x: body(x.withColumn("text", F.regexp_replace("text", AGENT, '"<ua>"'))))
    step("test-runner-elision", elide_tests)
    step("linter-fold", fold_lint)
    step("typecheck-fold", fold_types)
    stamps = options.select("log_id", F.coalesce("stamps", F.when(is_("runtime"), "strip").otherwise("auto")).alias("strip_timestamps"))
    forms = timestamp_vote(now).select(F.col("log_id").alias("_log"), "form")
    step("timestamp-strip:", lambda x: strip_timestamps(x, stamps))
    applied[-1] = applied[-1].join(forms, F.col("log_id") == F.col("_log")).select("log_id", F.concat("rule", "form").alias("rule"), "at")
    step("stack-dedup", lambda x: fold_stacks_table(x, keep), F.coalesce("stacks", F.lit(True)))
    step("repeat-fold", fold_repeats_clean)
    step("global-repeat-fold", fold_global_repeats)
    step("blank-collapse", collapse_blanks_clean)
    return without_blank_ends(now), reduce(DataFrame.unionByName, applied)


def prune_logs(lines: DataFrame, logs: DataFrame, piece: int = 5_000, rules: list[dict] | None = None, threshold: int | None = None, whole_lines: int = WHOLE_LINES) -> DataFrame:
    """(log_id, piece, n_lines, n_kept, tokens, tokens_kept, rules, text, savings, pruned, over_threshold): each log folded as a whole; the options
    come from the log's own row, `rules` are custom ones (strip, fold, block) after those of its profile. A log of at most whole_lines is
    folded by one task, a longer one by the same rules as tables. The text comes in pieces of `piece` kept lines, numbered from 0; all other
    columns are of the whole log."""
    long_ = lines.groupBy("log_id").agg(F.max("line_no").alias("_n")).where(F.col("_n") > whole_lines).select("log_id")
    if not long_.limit(1).count():
        return with_savings(prune_short(lines, logs, piece, rules), threshold)
    short = prune_short(lines.join(long_, "log_id", "left_anti"), logs, piece, rules)
    return with_savings(short.unionByName(prune_long(lines.join(long_, "log_id", "left_semi"), logs, piece, rules)), threshold)


def with_savings(made: DataFrame, threshold: int | None) -> DataFrame:
    saved = F.when(F.col("tokens") == 0, 0.0).otherwise((F.col("tokens") - F.col("tokens_kept")) / F.col("tokens") * 100)
    over = F.lit(None).cast("boolean") if threshold is None else F.col("tokens_kept") > max(0, threshold)
    return made.withColumns({"savings": saved, "pruned": F.col("tokens_kept") < F.col("tokens"), "over_threshold": over})


def log_options(logs: DataFrame) -> DataFrame:
    return logs.groupBy("log_id").agg(F.max("profile").alias("profile"), F.max("strip_timestamps").alias("stamps"), F.min(F.coalesce("dedupe_stack_traces", F.lit(True))).alias("stacks"))


def prune_long(lines: DataFrame, logs: DataFrame, piece: int, rules: list[dict] | None) -> DataFrame:
    options = lines.select("log_id").distinct().join(log_options(logs), "log_id", "left")
    pruned, applied = prune_tables(lines, options, rules)
    original = without_blank_ends(renumber(body(clean_lines(lines))))
    tokens = F.sum(T.token_count(F.col("text"))).cast("long")
    raw = lines.dropDuplicates(["log_id", "line_no"]).groupBy("log_id").agg(F.count("*").alias("n_lines"), tokens.alias("tokens"))
    own, left = original.groupBy("log_id").agg(tokens.alias("_own")), pruned.groupBy("log_id").agg(tokens.alias("_left"))
    sizes = raw.join(own, "log_id", "left").join(left, "log_id", "left").fillna(0, ["_own", "_left"])
    grown = sizes.where("_left > _own").select("log_id")
    kept = pruned.join(grown, "log_id", "left_anti").unionByName(original.join(grown, "log_id", "left_semi"))
    named = applied.join(grown, "log_id", "left_anti").groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "rule"))), lambda x: x["rule"]).alias("rules"))
    texts = kept.groupBy("log_id", F.floor(F.col("line_no") / piece).cast("int").alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    counts = kept.groupBy("log_id").agg(F.count("*").alias("n_kept"), tokens.alias("tokens_kept"))
    joined = sizes.join(counts, "log_id", "left").join(named, "log_id", "left").join(texts, "log_id", "left")
    return joined.select("log_id", F.coalesce("piece", F.lit(0)).alias("piece"), "n_lines", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "tokens", F.coalesce("tokens_kept", F.lit(0)).alias("tokens_kept"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), F.coalesce("text", F.lit("")).alias("text"))


def prune_short(lines: DataFrame, logs: DataFrame, piece: int, rules: list[dict] | None) -> DataFrame:
    options = log_options(logs)
    once = lines.select("log_id", "line_no", F.coalesce("text", F.lit("")).alias("text"))
    whole = once.join(options, "log_id", "left").select("log_id", "line_no", "text", "profile", "stamps", "stacks").repartition("log_id").sortWithinPartitions("log_id", "line_no")
    names = ["log_id", "piece", "n_lines", "n_kept", "tokens", "tokens_kept", "rules", "text"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, last, tokens, opts = None, Lines(), None, 0, (None, None, True)

        def done() -> Iterator[pa.RecordBatch]:
            kept, applied = prune_lines(held, opts[0], opts[2] is not False, rules, stamps=opts[1])
            tokens_kept, rest = size(kept), iter(kept)
            for k in range(max(1, -(-len(kept) // piece))):
                row = [key, k, len(held), len(kept), tokens, tokens_kept, applied, "\n".join(islice(rest, piece))]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for batch in batches:
            for log_id, number, text, profile, stamps, stacks in zip(*(c.to_pylist() for c in batch.columns)):
                if log_id != key:
                    if len(held):
                        yield from done()
                    key, held, last, tokens, opts = log_id, Lines(), None, 0, (profile, stamps, stacks)
                if number != last:
                    held.append(clean(text))
                    tokens += len(text.split())
                    last = number
        if len(held):
            yield from done()

    return whole.mapInArrow(run, "log_id string, piece int, n_lines bigint, n_kept bigint, tokens bigint, tokens_kept bigint, rules array<string>, text string")
