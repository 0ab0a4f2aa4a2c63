"""Markdown documents, phrases and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import blocks as B
from tessera.operators import diffs as D
from tessera.operators import markdown as M
from tessera.queries.text import DOC, TOK, docs
from tessera.sources.tables import table


def md(spark, d):
    return M.once(table(spark, d, "md_docs"))


def heading_ranges(spark, d):
    return M.heading_ranges(md(spark, d)).drop("tokens")


def section_costs(spark, d):
    return M.heading_ranges(md(spark, d)).select("md_id", "start_line", "heading", "depth", "tokens")


def locate_sections(spark, d):
    return M.heading_ranges(md(spark, d)).where(F.lower("heading").contains("budget")).select("md_id", "heading", "depth", "tokens")


def elide_sections(spark, d):
    """Two ways: only the sections on budgets, and all but those; counted."""
    kept, rest = M.elide(md(spark, d), only=["budget"]), M.elide(md(spark, d), strip=["budget"])
    count = lambda x, name: x.groupBy("md_id").agg(F.count("*").alias("n_lines"), F.sum(T.token_count(F.col("line"))).cast("long").alias("tokens")).withColumn("how", F.lit(name))
    return count(kept, "only").unionByName(count(rest, "strip"))


def extract_docs(spark, d):
    return B.extract_documents(md(spark, d))


def document_blocks(spark, d):
    return B.document_blocks(md(spark, d))


def frontmatter(spark, d):
    """Lists of two entries stand in one line first: a block with nested lines counts as none."""
    return M.frontmatter(md(spark, d).withColumn("content", F.regexp_replace("content", r":\r?\n  - (\S+)\r?\n  - (\S+)", ': [$1, "$2"]')))


def stage_whitespace(spark, d):
    return M.run_pipeline(md(spark, d), [M.WHITESPACE])


def stage_semantic(spark, d):
    return M.run_pipeline(md(spark, d), [M.SEMANTIC])


def stage_stats(spark, d):
    after = M.run_pipeline(md(spark, d).withColumn("before", F.octet_length("content").cast("long")), [M.WHITESPACE, M.SEMANTIC])
    size = F.octet_length("content").cast("long")
    return after.select("md_id", "before", size.alias("after"), F.when(F.col("before") == 0, 0.0).otherwise(F.round(100.0 * (F.col("before") - size) / F.col("before"), 1)).alias("saved_pct"))


def ngram_candidates(spark, d):
    return M.phrase_counts(docs(spark, d))


def long_words(spark, d):
    return docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9@._/-]{10,}"), F.lit(0))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def compact_docs(spark, d):
    return B.compact_documents(md(spark, d)).drop("same", "line", "expected", "actual")


def roundtrip(spark, d):
    return B.compact_documents(md(spark, d)).select("md_id", "same", "line", "expected", "actual")


def diff_hunks(spark, d):
    return D.hunks(D.diff_lines(docs(spark, d)))


def diff_context(spark, d):
    return D.compact(D.diff_lines(docs(spark, d)))


def diff_no_context(spark, d):
    return D.compact(D.diff_lines(docs(spark, d)), around=0, headers=False)


def diff_changes_only(spark, d):
    return D.compact(D.diff_lines(docs(spark, d)), changes_only=True)


QUERIES = {
    f.__name__: f
    for f in (heading_ranges, section_costs, locate_sections, elide_sections, extract_docs, document_blocks, frontmatter, stage_whitespace, stage_semantic, stage_stats, ngram_candidates, long_words, compact_docs, roundtrip, diff_hunks, diff_context, diff_no_context, diff_changes_only)
}

_MD = "md AS (SELECT md_id, any_value(content) AS content FROM md_docs WHERE content IS NOT NULL GROUP BY md_id), mn AS (SELECT md_id, replace(content, chr(13) || chr(10), chr(10)) AS content FROM md)"
_LINES = f"""{_MD}, ll AS (SELECT md_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT md_id, string_split(content, chr(10)) AS l FROM mn)),
    nl AS (SELECT *, coalesce(sum(regexp_matches(line, '^[ ]{{0,3}}(```|~~~)')::INT) OVER w, 0) % 2 = 1 AS coded, coalesce(sum(len(regexp_extract_all(line, '{TOK}'))) OVER w, 0) AS before FROM ll WINDOW w AS (PARTITION BY md_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_HEADS = f"""{_LINES}, h AS (SELECT md_id, line_no, before, length(regexp_extract(line, '{M.HEADING}', 1)) AS depth, regexp_extract(line, '{M.HEADING}', 2) AS heading FROM nl WHERE NOT coded AND regexp_matches(line, '{M.HEADING}')),
    tt AS (SELECT md_id, max(line_no) AS last, sum(len(regexp_extract_all(line, '{TOK}'))) AS total FROM nl GROUP BY 1),
    r AS (SELECT h.md_id, h.line_no AS start_line, h.depth, h.heading, h.before, min(n.line_no) AS nx FROM h LEFT JOIN h n ON n.md_id = h.md_id AND n.line_no > h.line_no AND n.depth <= h.depth GROUP BY ALL),
    rr AS (SELECT r.md_id, start_line, r.depth, r.heading, coalesce(nx, last + 1) AS end_line, (coalesce(n.before, total) - r.before)::BIGINT AS tokens FROM r JOIN tt USING (md_id) LEFT JOIN h n ON n.md_id = r.md_id AND n.line_no = nx)"""
_WS = "regexp_replace(regexp_replace({}, '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


def _semantic(e: str) -> str:
    e = f"regexp_replace({e}, '<!--[\\s\\S]*?-->\\n?', '', 'g')"
    for mark, plain in T.PUNCTUATION:
        e = f"replace({e}, '{mark}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({e}, '\\[([^\\]\\[]*)\\]\\([ \\t]*\\)', '\\1', 'g')"


_DIFF = f"""a AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM {DOC} AND contains(lower(text), '```diff')), b AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM a),
    c AS (SELECT *, starts_with(line, '```') AS fence, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS block FROM b), e AS (SELECT *, first_value(line) OVER (PARTITION BY doc_id, block ORDER BY line_no) AS opener FROM c),
    dl AS (SELECT doc_id, line_no, block, line, sum(starts_with(line, 'diff --git ')::INT) OVER (PARTITION BY doc_id, block ORDER BY line_no)::BIGINT AS file_no FROM e WHERE block % 2 = 1 AND NOT fence AND starts_with(lower(opener), '```diff')),
    pl AS (SELECT *, starts_with(line, '@@ ') AS opens, sum(starts_with(line, '@@ ')::INT) OVER (PARTITION BY doc_id, block, file_no ORDER BY line_no)::BIGINT AS hunk, starts_with(line, '+') OR starts_with(line, '-') OR starts_with(line, chr(92) || ' ') AS change FROM dl),
    pn AS (SELECT doc_id, block, file_no, arg_min(line[5:], line_no) FILTER (starts_with(line, '+++ ')) AS nw, arg_min(line[5:], line_no) FILTER (starts_with(line, '--- ')) AS od, arg_min(coalesce(regexp_split_to_array(trim(line), '\\s+')[4], ''), line_no) FILTER (starts_with(line, 'diff --git ')) AS gt, min(line_no) AS f FROM pl WHERE hunk = 0 GROUP BY 1, 2, 3),
    pt AS (SELECT doc_id, block, file_no, f, regexp_replace(CASE WHEN nw IS NOT NULL AND nw NOT IN ('', '/dev/null') THEN nw WHEN od IS NOT NULL AND od NOT IN ('', '/dev/null') THEN od WHEN gt <> '' THEN gt END, '^[ab]/', '') AS path FROM pn),
    nr AS (SELECT *, max(change::INT) OVER (PARTITION BY doc_id, block, file_no, hunk ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM pl WHERE hunk > 0 AND NOT opens)"""


def _edges(rows: str) -> str:
    """Rows of a rendered diff without blank lines at the edges of a file."""
    return f"{_DIFF}, mk AS ({rows}), eg AS (SELECT *, min(CASE WHEN line <> '' THEN (line_no, part) END) OVER w AS a, max(CASE WHEN line <> '' THEN (line_no, part) END) OVER w AS b FROM mk WINDOW w AS (PARTITION BY doc_id, block, file_no)) SELECT doc_id, block, line_no, part, line FROM eg WHERE (line_no, part) >= a AND (line_no, part) <= b"


ORACLES = {
    "heading_ranges": f"WITH {_HEADS} SELECT md_id, start_line, depth, heading, end_line FROM rr",
    "section_costs": f"WITH {_HEADS} SELECT md_id, start_line, heading, depth, tokens FROM rr",
    "locate_sections": f"WITH {_HEADS} SELECT md_id, heading, depth, tokens FROM rr WHERE contains(lower(heading), 'budget')",
    "elide_sections": f"""WITH {_HEADS}, hd AS (SELECT DISTINCT md_id FROM rr), x AS (SELECT *, EXISTS (SELECT 1 FROM rr WHERE rr.md_id = ll.md_id AND contains(lower(heading), 'budget') AND line_no >= start_line AND line_no < end_line) AS hit, md_id IN (SELECT md_id FROM hd) AS headed FROM ll)
        SELECT md_id, 'only' AS how, count(*) AS n_lines, sum(len(regexp_extract_all(line, '{TOK}')))::BIGINT AS tokens FROM x WHERE hit OR NOT headed GROUP BY 1 UNION ALL SELECT md_id, 'strip', count(*), sum(len(regexp_extract_all(line, '{TOK}')))::BIGINT FROM x WHERE NOT hit GROUP BY 1""",
    "frontmatter": rf"""WITH {_MD}, a AS (SELECT md_id, string_split(regexp_extract(regexp_replace(content, ':\n  - (\S+)\n  - (\S+)', ': [\1, "\2"]', 'g'), '\A---\n([\s\S]*?)\n---(?:\n|\z)', 1), chr(10)) AS l FROM mn),
        v AS (SELECT * FROM a WHERE len(list_filter(l, lambda x: trim(x, ' ' || chr(9)) <> '' AND NOT starts_with(trim(x, ' ' || chr(9)), '#') AND (regexp_matches(x, '^[ \t]') OR position(':' IN x) <= 1 OR trim(split_part(x, ':', 1)) = ''))) = 0),
        b AS (SELECT md_id, generate_subscripts(l, 1) AS n, unnest(l) AS x FROM v), c AS (SELECT md_id, n, trim(split_part(x, ':', 1), ' ' || chr(9)) AS key, trim(substr(x, position(':' IN x) + 1), ' ' || chr(9)) AS val FROM b WHERE trim(x, ' ' || chr(9)) <> '' AND NOT starts_with(trim(x, ' ' || chr(9)), '#')),
        e AS (SELECT md_id, key, arg_max(val, n) AS val FROM c GROUP BY 1, 2), k AS (SELECT *, CASE WHEN val IN ('', 'null', '~') THEN 'null' WHEN val IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(val, '^-?(?:0|[1-9]\d*)(?:\.\d+)?$') THEN 'number' WHEN starts_with(val, '[') AND ends_with(val, ']') THEN 'array' ELSE 'string' END AS kind FROM e)
        SELECT md_id, key, kind, CASE WHEN kind = 'null' THEN NULL WHEN kind = 'string' AND length(val) >= 2 AND starts_with(val, '"') AND ends_with(val, '"') THEN replace(replace(val[2:-2], '\"', '"'), '\\', '\') WHEN kind = 'string' AND length(val) >= 2 AND starts_with(val, chr(39)) AND ends_with(val, chr(39)) THEN replace(val[2:-2], chr(39) || chr(39), chr(39)) ELSE val END AS value FROM k""",
    "stage_whitespace": f"WITH {_MD} SELECT md_id, {_WS.format('content')} AS content FROM mn",
    "stage_semantic": f"WITH {_MD} SELECT md_id, {_semantic('content')} AS content FROM md",
    "stage_stats": f"WITH {_MD}, a AS (SELECT md.md_id, strlen(md.content) AS before, strlen({_semantic(_WS.format('mn.content'))}) AS after FROM md JOIN mn USING (md_id)) SELECT *, CASE WHEN before = 0 THEN 0 ELSE round(100.0 * (before - after) / before, 1) END AS saved_pct FROM a",
    "ngram_candidates": f"""WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?\\n]+')) AS s FROM {DOC}), w AS (SELECT doc_id, regexp_extract_all(s, '{TOK}') AS w FROM s), n AS (SELECT doc_id, w, unnest([2, 3, 4, 5]) AS n FROM w),
        g AS (SELECT doc_id, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS gram FROM n WHERE len(w) >= n) SELECT doc_id, n::BIGINT AS n, gram, count(*) AS occurrences FROM g GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "long_words": f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9@._/-]{{10,}}')) AS word FROM {DOC}) GROUP BY 1, 2",
    "diff_hunks": rf"WITH {_DIFF} SELECT doc_id, block, file_no, hunk, any_value(path) AS path, arg_min(trim(regexp_extract(line, '^@@\s+[-+,\d\s]+@@\s*(.*)$', 1)), line_no) AS label, count(*) FILTER (NOT opens AND starts_with(line, '+')) AS added, count(*) FILTER (NOT opens AND starts_with(line, '-')) AS removed FROM pl LEFT JOIN pt USING (doc_id, block, file_no) WHERE hunk > 0 GROUP BY 1, 2, 3, 4",
    "diff_context": "WITH " + _edges("SELECT doc_id, block, file_no, line_no, 1 AS part, line FROM nr WHERE near = 1 UNION ALL SELECT doc_id, block, file_no, line_no, 1, line FROM pl WHERE opens OR (hunk = 0 AND NOT regexp_matches(line, '^(diff --git |index |--- |\\+\\+\\+ )')) UNION ALL SELECT doc_id, block, file_no, f, 0, '=== ' || path FROM pt WHERE path IS NOT NULL"),
    "diff_changes_only": "WITH " + _edges("SELECT doc_id, block, file_no, line_no, 1 AS part, line FROM pl WHERE hunk > 0 AND NOT opens AND change UNION ALL SELECT doc_id, block, file_no, line_no, 1, '@@ ' || trim(regexp_extract(line, '^@@\\s+[-+,\\d\\s]+@@\\s*(.*)$', 1)) FROM pl WHERE opens AND trim(regexp_extract(line, '^@@\\s+[-+,\\d\\s]+@@\\s*(.*)$', 1)) <> '' UNION ALL SELECT doc_id, block, file_no, f, 0, '--- ' || path FROM pt WHERE path IS NOT NULL"),
    "diff_no_context": "WITH " + _edges("SELECT doc_id, block, file_no, line_no, 1 AS part, line FROM pl WHERE hunk = 0 OR opens OR NOT starts_with(line, ' ')"),
}
