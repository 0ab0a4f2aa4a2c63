"""Queries over logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import log_entries
from tessera.operators import log_lines as L
from tessera.sources.tables import table


def lines(spark, d):
    return L.clean_lines(table(spark, d, "log_lines"))


def p5_found(spark, sf_dir):
    return log_entries.parse_entries(table(spark, sf_dir, "log_lines"), table(spark, sf_dir, "logs"))


def p5_templates(spark, sf_dir):
    """The mined layouts with their counts and the patterns of those that open entries."""
    rows = log_entries.mine_templates(table(spark, sf_dir, "log_lines"))
    return spark.createDataFrame([(" ".join(t), n, log_entries.classify(t)) for t, n in rows], "template string, n_lines long, pattern string")


def strip_ansi(spark, d):
    return lines(spark, d).select("log_id", "line_no", "text")


def fold_repeats(spark, d):
    return L.fold_repeats(table(spark, d, "log_lines"))


def fold_progress(spark, d):
    return L.fold_progress(table(spark, d, "log_lines"))


def fold_global_repeats(spark, d):
    return L.fold_global_repeats(lines(spark, d))


def collapse_blanks(spark, d):
    return L.collapse_blanks(table(spark, d, "log_lines"))


def drop_debug(spark, d):
    return L.drop_matching(lines(spark, d), L.DEBUG, "debug lines")


def drop_health(spark, d):
    return L.drop_matching(lines(spark, d), L.HEALTH, "health checks")


def strip_user_agents(spark, d):
    return lines(spark, d).select("log_id", "line_no", F.regexp_replace("text", L.AGENT, '"<ua>"').alias("text"), F.col("text").rlike(L.AGENT_SIGN).alias("signed"))


def json_histogram(spark, d):
    return L.json_levels(lines(spark, d))


def json_fold(spark, d):
    return L.fold_json(lines(spark, d))


def startup_fold(spark, d):
    return L.fold_startup(lines(spark, d))


def timestamp_vote(spark, d):
    return L.timestamp_vote(lines(spark, d))


def timestamp_strip(spark, d):
    return L.strip_timestamps(lines(spark, d), table(spark, d, "logs"))


def test_elision(spark, d):
    return L.elide_tests(lines(spark, d))


def linter_fold(spark, d):
    return L.fold_lint(lines(spark, d))


def diagnostics_fold(spark, d):
    return L.fold_types(lines(spark, d))


# Lines as tools print them, made from the table's own texts: files, places and messages of test runners, linters and type checkers.
TOOL_LINES = {
    "'✓ ' || text": 0, "'  ✗ ' || text": 1, "'PASS ' || text": 2, "'tests/a.test.ts: ' || text": 3, "'Tests: ' || text": 4,
    "'./src/f' || line_no % 7 || '.ts lint ' || text": 5, "'  × ' || text": 6, "''": 7,
    "'src/f' || line_no % 7 || '.ts(' || line_no || ',1): error TS1: ' || text": 8, "'lib/m' || line_no % 3 || '.py:' || line_no || ': error: ' || text": 9, "text": 10,
}
_TOOL = "CASE line_no % 11 " + " ".join(f"WHEN {k} THEN {x}" for x, k in TOOL_LINES.items()) + " END"


def tool_lines(spark, d):
    return lines(spark, d).withColumn("text", F.expr(_TOOL))


def tool_tests(spark, d):
    return L.elide_tests(tool_lines(spark, d))


def tool_lint(spark, d):
    return L.fold_lint(tool_lines(spark, d))


def tool_types(spark, d):
    return L.fold_types(tool_lines(spark, d))


def prune_logs(spark, d):
    return L.prune_logs(table(spark, d, "log_lines"), table(spark, d, "logs"))


def prune_logs_custom(spark, d):
    """With rules of one's own behind those of the profile: a strip, a fold and a block rule; and a threshold."""
    rules = [{"type": "strip", "pattern": "cache (hit|miss)"}, {"type": "fold", "pattern": "worker [0-9]+", "label": "workers"}, {"type": "block", "start": r"^\{$", "end": r"^\}$", "label": "object"}]
    return L.prune_logs(table(spark, d, "log_lines"), table(spark, d, "logs"), rules=rules, threshold=2_000)


QUERIES = {
    f.__name__: f
    for f in (
        p5_found, p5_templates, strip_ansi, fold_repeats, fold_progress, fold_global_repeats, collapse_blanks, drop_debug, drop_health, strip_user_agents, json_histogram, json_fold, startup_fold, timestamp_vote, timestamp_strip,
        test_elision, linter_fold, diagnostics_fold, tool_tests, tool_lint, tool_types, prune_logs, prune_logs_custom,
    )
}

# The rules stated again in SQL, with values of their own.
LINES = r"""l AS (SELECT log_id, line_no, regexp_replace(regexp_replace(coalesce(any_value(text), ''), '\x1B\[[0-9;]*[a-zA-Z]|\x1B\][^\x07]*\x07|\r', '', 'g'), '[ \t]+$', '') AS text FROM log_lines GROUP BY log_id, line_no)"""
TOOLS = rf"{LINES.replace('l AS', 'l0 AS', 1)}, l AS (SELECT log_id, line_no, {_TOOL} AS text FROM l0)"
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '\b[0-9]+\b', '#', 'g'), '(?i)[a-f0-9]{7,40}', '<hash>', 'g'), '(?i)0x[0-9a-f]+', '0x#', 'g'), ' ')"
_LAST = 2_147_483_647
_ISO, _SYSLOG, _EPOCH = r"^\[?\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?\]?\s*", r"^[A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2}\s+", r"^\d{10,13}\s+"
_PASSED, _FAILED = r"^(?:\(pass\)|\s*(?:✓|✔|PASS\b|--- PASS:|test .* \.\.\. ok\b|PASSED\b))", r"^(?:\(fail\)|\s*(?:✗|✘|FAIL\b|FAILED\b|--- FAIL:|test .* \.\.\. FAILED\b|not ok\b))"
_SUMMARY = r"(?i)^(Test Suites:|Tests:|Ran \d+ tests|\d+ passing|\d+ failing|\d+ passed|\d+ failed)"
_STARTED = r"(?i)^\s*[=_\-]{5,}\s*$|^\s*\|.*\|\s*$|(Starting|Started|Booting|Initializing|Listening on|Migrations? complete|Ready in)\b"
_PROGRESS = r"(^\s*(Downloading|Uploading|Installing|Building).+\d+%|[█▓░━⣾⠿]|\b\d+%\b|^\s*\[[-= >]+\])"
_JSON = r"^\s*\{.*\}\s*$"
_LEVELS = ("error", "warn", "info", "debug", "other")


def _drop(pattern: str, label: str) -> str:
    return rf"WITH {LINES} SELECT log_id, line_no, 0 AS part, text FROM l WHERE NOT regexp_matches(text, '{pattern}') UNION ALL SELECT log_id, -1, 1, '[{label} stripped: ' || count(*) || ']' FROM l WHERE regexp_matches(text, '{pattern}') GROUP BY log_id"


def _runs(key: str) -> str:
    return rf"""a AS (SELECT *, {key} AS k FROM l), b AS (SELECT *, (k IS DISTINCT FROM lag(k) OVER (PARTITION BY log_id ORDER BY line_no))::INT AS s FROM a), c AS (SELECT *, sum(s) OVER (PARTITION BY log_id ORDER BY line_no) AS run FROM b),
        r AS (SELECT log_id, run, any_value(k) AS k, min(line_no) AS f, max(line_no) AS t, arg_min(text, line_no) AS ft, arg_max(text, line_no) AS tt, count(*) AS n FROM c GROUP BY 1, 2)"""


def _tests(source: str) -> str:
    return rf"""WITH {source}, n AS (SELECT log_id, count(*) FILTER (regexp_matches(text, '{_PASSED}')) AS p, count(*) FILTER (regexp_matches(text, '{_FAILED}')) AS f, count(*) FILTER (regexp_matches(text, '{_SUMMARY}')) AS s FROM l GROUP BY 1)
        SELECT log_id, line_no, 0 AS part, text FROM l JOIN n USING (log_id) WHERE (p < 5 AND f = 0) OR NOT (regexp_matches(text, '{_PASSED}') OR (f = 0 AND NOT regexp_matches(text, '{_SUMMARY}') AND starts_with(text, 'tests/')))
        UNION ALL SELECT log_id, -1, 1, '[tests pruned: ' || p || ' passing stripped, ' || f || ' failing kept]' FROM n WHERE p >= 5 OR f > 0 UNION ALL SELECT log_id, {_LAST}, 1, '[all tests passed]' FROM n WHERE p >= 5 AND f = 0 AND s = 0"""


def _lint(source: str) -> str:
    file = r"regexp_matches(text, '^\./.*\s(?:format|lint|organizeImports)\s')"
    return rf"""WITH {source}, a AS (SELECT *, {file} AS o FROM l), b AS (SELECT *, sum((o OR text = '')::INT) OVER w AS part_no, sum(o::INT) OVER w AS k FROM a WINDOW w AS (PARTITION BY log_id ORDER BY line_no)),
        c AS (SELECT *, first_value(o) OVER w AS lint, first_value(line_no) OVER w AS f, min(CASE WHEN contains(text, '×') THEN line_no END) OVER (PARTITION BY log_id, part_no) AS told FROM b WINDOW w AS (PARTITION BY log_id, part_no ORDER BY line_no))
        SELECT log_id, line_no, 0 AS part, CASE WHEN lint AND line_no = f THEN '[diagnostic block ' || k || '] ' || text ELSE text END AS text FROM c WHERE NOT lint OR line_no = f OR line_no = told"""


def _types(source: str) -> str:
    tsc, mypy = r"^(.+)\(\d+,\d+\):\s+error\s+TS\d+:", r"^(.+):\d+:\s+error:"
    return rf"""WITH {source}, a AS (SELECT *, CASE WHEN regexp_matches(text, '{tsc}') THEN regexp_extract(text, '{tsc}', 1) WHEN regexp_matches(text, '{mypy}') THEN regexp_extract(text, '{mypy}', 1) END AS file FROM l),
        e AS (SELECT *, row_number() OVER (PARTITION BY log_id, file ORDER BY line_no) AS i FROM a WHERE file IS NOT NULL), g AS (SELECT log_id, file, count(*) AS n, min(line_no) AS f FROM e GROUP BY 1, 2),
        h AS (SELECT *, 10 * row_number() OVER (PARTITION BY log_id ORDER BY f) AS pos FROM g)
        SELECT log_id, line_no, 0 AS part, text FROM a WHERE file IS NULL UNION ALL SELECT log_id, {_LAST}, pos, '[typecheck] ' || file || ': ' || n || ' errors' FROM h
        UNION ALL SELECT log_id, {_LAST}, pos + i, text FROM e JOIN h USING (log_id, file) WHERE i <= 3 UNION ALL SELECT log_id, {_LAST}, pos + 4, '[typecheck] ' || (n - 3) || ' more errors folded' FROM h WHERE n > 3"""


_HISTOGRAM = rf"""j AS (SELECT log_id, CASE WHEN json_valid(text) THEN lower(coalesce(CASE WHEN json_type(text, '$.level') = 'OBJECT' THEN '' WHEN json_type(text, '$.level') <> 'NULL' THEN json_extract_string(text, '$.level') END, json_extract_string(text, '$.severity'), '')) ELSE '' END AS v FROM l WHERE regexp_matches(text, '{_JSON}')),
    k AS (SELECT log_id, CASE WHEN v LIKE '%error%' THEN 'error' WHEN v LIKE '%warn%' THEN 'warn' WHEN v LIKE '%info%' THEN 'info' WHEN v LIKE '%debug%' THEN 'debug' ELSE 'other' END AS k FROM j),
    h AS (SELECT log_id, count(*) AS n, {", ".join(rf"count(*) FILTER (k = '{x}') AS {x}" for x in _LEVELS)} FROM k GROUP BY 1 HAVING count(*) >= 6)"""
_VOTE = rf"""v AS (SELECT *, CASE WHEN iso > 0 AND iso >= syslog AND iso >= epoch THEN 'iso' WHEN syslog > 0 AND syslog >= epoch THEN 'syslog' WHEN epoch > 0 THEN 'epoch' END AS form FROM
    (SELECT log_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(text, '{_ISO}')) AS iso, count(*) FILTER (regexp_matches(text, '{_SYSLOG}')) AS syslog, count(*) FILTER (regexp_matches(text, '{_EPOCH}')) AS epoch FROM l GROUP BY 1))"""

ORACLES = {
    "strip_ansi": rf"WITH {LINES} SELECT * FROM l",
    "fold_repeats": rf"WITH {LINES}, {_runs(NORM)} SELECT log_id, f AS line_no, 0 AS part, ft AS text FROM r UNION ALL SELECT log_id, f, 1, '[repeated ' || (n - 1) || 'x]' FROM r WHERE n > 1 AND k <> ''",
    "fold_progress": rf"""WITH {LINES}, {_runs(rf"regexp_matches(text, '{_PROGRESS}')")} SELECT log_id, line_no, 0 AS part, text FROM a WHERE NOT k UNION ALL SELECT log_id, t, 0, tt FROM r WHERE k
        UNION ALL SELECT log_id, t, 1, '[progress: ' || (n - 1) || ' lines collapsed]' FROM r WHERE k AND n > 1""",
    "fold_global_repeats": rf"""WITH {LINES}, a AS (SELECT *, {NORM} AS norm FROM l), g AS (SELECT log_id, norm, min(line_no) AS f, count(*) AS n FROM a WHERE length(norm) >= 12 GROUP BY 1, 2 HAVING count(*) >= 3)
        SELECT log_id, line_no, 0 AS part, text FROM a LEFT JOIN g USING (log_id, norm) WHERE f IS NULL OR f = line_no UNION ALL SELECT log_id, {_LAST}, 1, '[global repeats folded: ' || sum(n - 1)::BIGINT || ']' FROM g GROUP BY 1""",
    "collapse_blanks": rf"WITH {LINES}, a AS (SELECT *, lag(text) OVER (PARTITION BY log_id ORDER BY line_no) AS p FROM l) SELECT log_id, line_no, 0 AS part, text FROM a WHERE NOT (text = '' AND coalesce(p, 'x') = '')",
    "drop_debug": _drop(r"\b(DEBUG|debug)\b", "debug lines"),
    "drop_health": _drop(r"(?i)/(health|healthz|readyz|livez)\b", "health checks"),
    "strip_user_agents": rf"""WITH {LINES} SELECT log_id, line_no, regexp_replace(text, '"[^"]*(Mozilla/5\.0|AppleWebKit/|Chrome/\d+|Safari/\d+|Firefox/\d+)[^"]*"', '"<ua>"', 'g') AS text,
        regexp_matches(text, 'Mozilla/5\.0|AppleWebKit/|Chrome/\d+|Safari/\d+|Firefox/\d+|curl/\d+') AS signed FROM l""",
    "json_histogram": rf"WITH {LINES}, {_HISTOGRAM} SELECT * FROM h",
    "json_fold": rf"""WITH {LINES}, {_HISTOGRAM} SELECT log_id, line_no, 0 AS part, text FROM l WHERE NOT regexp_matches(text, '{_JSON}') OR log_id NOT IN (SELECT log_id FROM h)
        UNION ALL SELECT log_id, -1, 1, '[json lines folded: ' || n || ' (error:' || error || ', warn:' || warn || ', info:' || info || ', debug:' || debug || ', other:' || other || ')]' FROM h""",
    "startup_fold": rf"""WITH {LINES}, n AS (SELECT log_id, count(*) FILTER (regexp_matches(text, '{_STARTED}')) AS n FROM l GROUP BY 1 HAVING count(*) >= 10 AND n > 3)
        SELECT log_id, line_no, 0 AS part, text FROM l LEFT JOIN n USING (log_id) WHERE n IS NULL OR NOT regexp_matches(text, '{_STARTED}') UNION ALL SELECT log_id, -1, 1, '[startup lines folded: ' || n || ']' FROM n""",
    "timestamp_vote": rf"WITH {LINES}, {_VOTE} SELECT * FROM v",
    "timestamp_strip": rf"""WITH {LINES}, {_VOTE}, m AS (SELECT log_id, lower(max(strip_timestamps)) AS mode FROM logs GROUP BY 1), s AS (SELECT log_id, form FROM v LEFT JOIN m USING (log_id)
        WHERE form IS NOT NULL AND (coalesce(mode, '') = 'strip' OR (coalesce(mode, '') <> 'keep' AND greatest(iso, syslog, epoch) >= 0.8 * n_lines)))
        SELECT log_id, line_no, 0 AS part, CASE form WHEN 'iso' THEN regexp_replace(text, '{_ISO}', '') WHEN 'syslog' THEN regexp_replace(text, '{_SYSLOG}', '') WHEN 'epoch' THEN regexp_replace(text, '{_EPOCH}', '') ELSE text END AS text FROM l LEFT JOIN s USING (log_id)
        UNION ALL SELECT log_id, -1, 1, '[timestamps stripped: ' || form || ']' FROM s""",
    "test_elision": _tests(LINES),
    "linter_fold": _lint(LINES),
    "diagnostics_fold": _types(LINES),
    "tool_tests": _tests(TOOLS),
    "tool_lint": _lint(TOOLS),
    "tool_types": _types(TOOLS),
}
