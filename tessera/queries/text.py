"""Text functions over whole tables, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tools as O
from tessera.sources import files as S
from tessera.sources.tables import table

W = T.SPACES
TOK = T.TOKEN


def docs(spark, d):
    return table(spark, d, "documents").where("text is not null")


def files(spark, d):
    """One row per file: redelivered rows are the same content."""
    return table(spark, d, "source_files").where("content is not null").select("file_id", "repo", "path", "content").dropDuplicates(["file_id"])


FILES = "files AS (SELECT file_id, any_value(repo) repo, any_value(path) path, any_value(content) AS content FROM source_files WHERE content IS NOT NULL GROUP BY file_id)"
DOC = "documents WHERE text IS NOT NULL"
# Imports of scripts (ed) and the files they name (re), in SQL; needs FILES in front.
_PATTERNS = (r"(?:import|export)\s+(?:type\s+)?(?:\{[^}]*\}|\*\s+as\s+\w+|\w+)\s+from\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")
_ALL = ", ".join("regexp_extract_all(content, '" + p.replace("'", "''") + "', 1)" for p in _PATTERNS)
IMPORTED = rf"""ed AS (SELECT DISTINCT file_id, repo, regexp_replace(path, '^\./', '') AS path, unnest(flatten([{_ALL}])) AS specifier FROM files WHERE lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs'))"""
RESOLVED = rf"""{IMPORTED}, cn AS (SELECT file_id, repo, specifier, rank, regexp_replace(path, '/?[^/]*$', '') || '/' || CASE WHEN rank < 4 THEN regexp_replace(specifier, '\.js$', '') || ext ELSE specifier END AS p FROM ed, (VALUES ('.ts', 0), ('.tsx', 1), ('.js', 2), ('.jsx', 3), ('', 4)) e(ext, rank) WHERE specifier LIKE '.%'),
    cp AS (SELECT *, substr(list_reduce(list_concat([''], string_split(p, '/')), lambda a, x: CASE WHEN x IN ('', '.') THEN a WHEN x = '..' AND a <> '' AND NOT ends_with(a, '..') THEN regexp_replace(a, '/[^/]+$', '') ELSE a || '/' || x END), 2) AS cand FROM cn),
    hi AS (SELECT cp.file_id, cp.specifier, arg_min(f.file_id, rank) AS resolved FROM cp JOIN files f ON f.repo = cp.repo AND regexp_replace(f.path, '^\./', '') = cand GROUP BY 1, 2), re AS (SELECT ed.*, resolved FROM ed LEFT JOIN hi USING (file_id, specifier))"""


def token_stats(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", T.token_count(c).cast("long").alias("tokens"), F.octet_length(c).cast("long").alias("bytes"), F.size(F.split(c, "\n", -1)).cast("long").alias("lines"), F.ceil(F.octet_length(c) / 4).cast("long").alias("size_estimate"))


def estimate_tokens(spark, d):
    return docs(spark, d).select("doc_id", T.estimate_tokens(F.col("text")).cast("long").alias("estimate"))


def short_hash(spark, d):
    return docs(spark, d).select("doc_id", T.short_hash(F.col("text")).alias("hash"))


def line_hashes(spark, d):
    body = F.regexp_replace("text", r"\n\z", "")
    return docs(spark, d).select("doc_id", F.posexplode(F.split(body, "\n", -1)).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), T.line_hash(F.col("p") + 1, F.col("line")).alias("hash"))


def normalize_punct(spark, d):
    return docs(spark, d).select("doc_id", T.plain_punctuation(F.col("text")).alias("text"))


def strip_trailing(spark, d):
    return docs(spark, d).select("doc_id", T.strip_trailing(F.col("text")).alias("text"))


def collapse_blank_text(spark, d):
    return docs(spark, d).select("doc_id", T.collapse_blank_lines(F.col("text")).alias("text"))


def unwrap_lines(spark, d):
    return docs(spark, d).select("doc_id", T.unwrap_lines(F.col("text")).alias("text"))


def text_helpers(spark, d):
    c, first = F.col("text"), F.element_at(F.split("text", "\n", -1), 1)
    return docs(spark, d).select(
        "doc_id",
        F.regexp_replace(first, f"[{W}]+#+[{W}]*$", "").alias("heading"),
        T.truncate_text(c, 80).alias("short"),
        T.occurrences(F.lower(c), "the").cast("long").alias("n_the"),
        T.word_occurrences(c, "the").cast("long").alias("n_word"),
        F.least(T.word_occurrences(c, "the"), F.lit(5)).cast("long").alias("capped"),
        F.exists(F.array(F.lit("reading order"), F.lit("known limits")), lambda q: F.contains(F.lower(T.trim_all(first)), q)).alias("is_section"),
        F.greatest(F.lit(0), F.floor(F.coalesce(F.col("n_chars") / 100.0, F.lit(10.0)))).cast("long").alias("limit"),
        F.when(F.size(F.split(c, "\n", -1)) > 3, F.concat(F.lit("... "), (F.size(F.split(c, "\n", -1)) - 3).cast("string"), F.lit(" more items"))).alias("overflow"),
    )


def csv_codec(spark, d):
    return docs(spark, d).select("doc_id", F.concat_ws(", ", T.quote_csv(F.coalesce("source", F.lit(""))), T.quote_csv(F.coalesce("lang", F.lit(""))), T.quote_csv(F.col("text"))).alias("row"))


def language_of_path(spark, d):
    p = F.col("path")
    return files(spark, d).select(
        "file_id",
        T.language_of(p).alias("language"),
        T.is_test_path(p).alias("is_test"),
        T.extension(p).isin(*T.LANGUAGES).alias("is_code"),
        p.rlike(r"(?i)\.(md|mdx|markdown)$").alias("is_markdown"),
    )


def query_terms(spark, d):
    return files(spark, d).select("file_id", F.explode(T.query_terms(F.regexp_replace("path", "[/.-]", " "))).alias("term"))


def declared_names(spark, d):
    return files(spark, d).select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(NAMES), F.lit(1)))).alias("name"))


def headings(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6}[ \t]+([^\n\r]+)"), F.lit(1))).alias("n", "heading")).select("doc_id", F.col("n").cast("long").alias("n"), "heading")


NAMES = r"(?:export\s+)?(?:function|const|let|var|class|interface|type|enum)\s+([A-Za-z0-9_]+)"

def line_tools(spark, d):
    """Lines, literal replacement and edges, counted."""
    c = F.col("text")
    lines = O.split_lines(c)
    return docs(spark, d).select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(O.trim_edges(lines)).cast("long").alias("n_inner"), F.length(O.replace_all(c, F.lit("the "), F.lit("a "))).cast("long").alias("n_replaced"), (O.replace_all(c, F.lit(""), F.lit("x")) == c).alias("same"))


def file_kinds(spark, d):
    p = F.col("path")
    return files(spark, d).select("file_id", O.is_code_file(p).alias("is_code"), O.is_markdown_file(p).alias("is_markdown"))


def return_types(spark, d):
    """Return types that the first declaration of each file states."""
    signature = F.regexp_extract(F.replace("content", F.lit("\r"), F.lit("")), r"(?m)^[^\n]*\b(?:function|def|fn|func)\b[^\n]*$", 0)
    return files(spark, d).where(signature != "").select("file_id", O.explicit_return(signature).alias("r")).select("file_id", "r.*")


REPLIES = ("ALLOW", " allow ", "REWRITE: outline(file=a/b.ts)", "REWRITE: read(file=\"a b\", maxTokens=500, file='c')", "REWRITE: rank()", "no idea")


def judge_replies(spark, d):
    """Replies made from the documents' numbers, as a judge could give them."""
    reply = F.element_at(F.array(*[F.lit(x) for x in REPLIES]), (F.pmod("doc_id", F.lit(len(REPLIES))) + 1).cast("int"))
    return docs(spark, d).groupBy(reply.alias("reply")).agg(F.count("*").alias("n")).select("reply", "n", O.parse_reply(F.col("reply")).alias("r")).select("reply", "n", "r.outcome", "r.tool", F.array_join(F.array_sort(F.transform(F.map_entries("r.args"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("args"))


def tree_entries(spark, d):
    return S.tree_entries(files(spark, d))


def tree_totals(spark, d):
    return S.tree_totals(S.tree_entries(files(spark, d)))


def repository_tools(spark, d):
    return S.detect_tools(files(spark, d))


QUERIES = {f.__name__: f for f in (token_stats, estimate_tokens, short_hash, line_hashes, normalize_punct, strip_trailing, collapse_blank_text, unwrap_lines, text_helpers, csv_codec, language_of_path, query_terms, declared_names, headings, line_tools, file_kinds, return_types, judge_replies, tree_entries, tree_totals, repository_tools)}


def _punct(expression: str) -> str:
    for mark, plain in T.PUNCTUATION:
        expression = f"replace({expression}, '{mark}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return expression


def _quote(e: str) -> str:
    return f"""CASE WHEN {e} LIKE '%,%' OR {e} LIKE '%' || chr(10) || '%' OR {e} LIKE '%"%' THEN '"' || replace({e}, '"', '""') || '"' ELSE {e} END"""




def _trim(e: str) -> str:
    return f"regexp_replace({e}, '^[{W}]+|[{W}]+$', '', 'g')"


_LINES = "string_split({}, chr(10))"

ORACLES = {
    "token_stats": f"SELECT doc_id, len(regexp_extract_all(text, '{TOK}')) AS tokens, strlen(text) AS bytes, len({_LINES.format('text')}) AS lines, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS size_estimate FROM {DOC}",
    "estimate_tokens": f"SELECT doc_id, greatest(1, coalesce(list_sum(list_transform(regexp_extract_all(text, '{TOK}'), lambda w: CASE WHEN length(w) <= 7 THEN 1 WHEN length(w) <= 10 THEN 2 ELSE CAST(ceil(length(w) / 5.0) AS BIGINT) END)), 0))::BIGINT AS estimate FROM {DOC}",
    "short_hash": f"SELECT doc_id, substr(sha256({_trim('replace(text, chr(13) || chr(10), chr(10))')}), 1, 4) AS hash FROM {DOC}",
    "line_hashes": f"WITH a AS (SELECT doc_id, {_LINES.format('''CASE WHEN right(text, 1) = chr(10) THEN text[:-2] ELSE text END''')} AS l FROM {DOC}), b AS (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM a) SELECT doc_id, n AS line_no, substr(sha256({_trim("replace(n || ':' || line, chr(13) || chr(10), chr(10))")}), 1, 4) AS hash FROM b",
    "normalize_punct": f"SELECT doc_id, {_punct('text')} AS text FROM {DOC}",
    "strip_trailing": f"SELECT doc_id, regexp_replace(text, '(?m)[ \\t]+$', '', 'g') AS text FROM {DOC}",
    "collapse_blank_text": f"SELECT doc_id, regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM {DOC}",
    "unwrap_lines": f"SELECT doc_id, replace(regexp_replace(regexp_replace(replace(text, chr(10) || chr(10), chr(1) || chr(1)), '([\\x01])\\n', '\\1' || chr(1), 'g'), '\\n', ' ', 'g'), chr(1), chr(10)) AS text FROM {DOC}",
    "text_helpers": f"""WITH a AS (SELECT doc_id, text, n_chars, {_LINES.format('text')} AS l FROM {DOC})
        SELECT doc_id, regexp_replace(l[1], '[{W}]+#+[{W}]*$', '') AS heading,
          CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substr(text, 1, 80), '[{W}]+$', '') || ' ...' END AS short,
          ((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3)::BIGINT AS n_the, len(regexp_extract_all(lower(text), '\\bthe\\b')) AS n_word,
          least(len(regexp_extract_all(lower(text), '\\bthe\\b')), 5) AS capped,
          lower(l[1]) LIKE '%reading order%' OR lower(l[1]) LIKE '%known limits%' AS is_section, greatest(0, floor(coalesce(n_chars / 100.0, 10.0)))::BIGINT AS "limit",
          CASE WHEN len(l) > 3 THEN '... ' || (len(l) - 3) || ' more items' END AS overflow FROM a""",
    "csv_codec": f"SELECT doc_id, {_quote('coalesce(source, chr(32)[:0])')} || ', ' || {_quote('coalesce(lang, chr(32)[:0])')} || ', ' || {_quote('text')} AS row FROM {DOC}",
    "language_of_path": f"""WITH {FILES}, e AS (SELECT file_id, path, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS x FROM files)
        SELECT file_id, CASE x {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())} END AS language, regexp_matches(path, '(?i)(^|/)(__tests__|tests?|specs?)(/|$)|\\.(test|spec)\\.') AS is_test,
          x IN ({", ".join(f"'{k}'" for k in T.LANGUAGES)}) AS is_code, regexp_matches(path, '(?i)\\.(md|mdx|markdown)$') AS is_markdown FROM e""",
    "query_terms": f"""WITH {FILES}, a AS (SELECT file_id, regexp_replace(regexp_replace(regexp_replace(path, '[/.-]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[{W}_]+', ' ', 'g') AS s FROM files)
        SELECT DISTINCT file_id, term FROM (SELECT file_id, unnest(string_split(lower(s), ' ')) AS term FROM a) WHERE term <> ''""",
    "declared_names": rf"WITH {FILES} SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '(?:function|const|let|var|class|interface|type|enum)\s+(\w+)', 1)) AS name FROM files",
    "headings": f"WITH a AS (SELECT doc_id, regexp_extract_all(text, '(?m)^#{{1,6}}[ \\t]+([^\\n\\r]+)', 1) AS h FROM {DOC}) SELECT doc_id, generate_subscripts(h, 1) - 1 AS n, unnest(h) AS heading FROM a WHERE len(h) > 0",
    "line_tools": f"""WITH a AS (SELECT *, list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '[ \t]+$', '')) AS l FROM {DOC}), b AS (SELECT *, list_max(list_transform(l, lambda x, i: CASE WHEN x <> '' THEN i ELSE 0 END)) AS z, list_min(list_filter(list_transform(l, lambda x, i: CASE WHEN x <> '' THEN i END), lambda x: x IS NOT NULL)) AS a FROM a)
        SELECT doc_id, z AS n_lines, CASE WHEN a IS NULL THEN 0 ELSE z - a + 1 END AS n_inner, length(replace(text, 'the ', 'a ')) AS n_replaced, true AS same FROM b""",
    "file_kinds": rf"WITH {FILES} SELECT file_id, regexp_matches(path, '\.(ts|js|tsx|jsx|py|rs|go|java|c|cpp|rb|swift|kt|sh|yaml|yml|json|toml|css|scss)$') AS is_code, regexp_matches(path, '\.(md|mdx|markdown)$') AS is_markdown FROM files",
    "return_types": rf"""WITH {FILES}, a AS (SELECT file_id, regexp_extract(replace(content, chr(13), ''), '(?m)^[^\n]*\b(?:function|def|fn|func)\b[^\n]*$', 0) AS s FROM files), b AS (SELECT *, regexp_matches(s, '\)\s*:\s*[^=]') OR regexp_matches(s, '->\s*[^=]') AS explicit FROM a WHERE s <> '')
        SELECT file_id, explicit, explicit AND regexp_matches(s, '\bvoid\b') AS is_void, explicit AND regexp_matches(s, '\bPromise\s*<') AS is_promise FROM b""",
    "judge_replies": f"""WITH v(k, reply, outcome, tool, args) AS (VALUES (0, 'ALLOW', 'allow', NULL, NULL), (1, ' allow ', 'allow', NULL, NULL), (2, 'REWRITE: outline(file=a/b.ts)', 'rewrite', 'outline', 'file=a/b.ts'), (3, 'REWRITE: read(file="a b", maxTokens=500, file=''c'')', 'rewrite', 'read', 'file=c;maxTokens=500'), (4, 'REWRITE: rank()', 'rewrite', 'rank', ''), (5, 'no idea', 'allow', NULL, NULL))
        SELECT reply, count(*) AS n, outcome, tool, args FROM {DOC.split()[0]} JOIN v ON doc_id % 6 = k WHERE text IS NOT NULL GROUP BY ALL""",
    "tree_entries": rf"""WITH {FILES}, p AS (SELECT repo, string_split(regexp_replace(path, '^\./', ''), '/') AS p, content FROM files), s AS (SELECT repo, p, len(regexp_extract_all(content, '{TOK}')) AS tokens, strlen(content) AS bytes, len(string_split(content, chr(10))) AS lines FROM p
        WHERE len(p) <= 4 AND len(list_filter(p, lambda x: starts_with(x, '.') OR x IN ('node_modules', '.git', 'dist', 'coverage', '.next', '.cache'))) = 0), f AS (SELECT repo, p[:n] AS p, tokens FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS n FROM s))
        SELECT repo, array_to_string(p, '/') AS path, p[-1] AS name, false AS is_folder, len(p) - 1 AS level, tokens, bytes, lines FROM s UNION ALL SELECT repo, array_to_string(p, '/'), p[-1], true, len(p) - 1, sum(tokens)::BIGINT, NULL, NULL FROM f GROUP BY repo, p""",
    "tree_totals": rf"""WITH {FILES}, s AS (SELECT repo, string_split(regexp_replace(path, '^\./', ''), '/') AS p, len(regexp_extract_all(content, '{TOK}')) AS tokens FROM files) SELECT repo, count(*) AS n_files, sum(tokens)::BIGINT AS tokens FROM s
        WHERE len(p) <= 4 AND len(list_filter(p, lambda x: starts_with(x, '.') OR x IN ('node_modules', '.git', 'dist', 'coverage', '.next', '.cache'))) = 0 GROUP BY 1""",
    "repository_tools": rf"""WITH {FILES}, p AS (SELECT repo, regexp_replace(path, '^\./', '') AS p FROM files), h AS (SELECT repo, bool_or(p = 'package.json') AS npm, bool_or(p = 'bun.lock') AS bun, bool_or(p IN ('pytest.ini', 'pyproject.toml')) AS py, bool_or(p = 'Cargo.toml') AS rs, bool_or(p = 'go.mod') AS go, bool_or(p = 'tsconfig.json') AS ts, bool_or(p = 'pyproject.toml') AS pp FROM p GROUP BY 1)
        SELECT repo, CASE WHEN bun THEN 'bun' WHEN npm THEN 'npm' WHEN py THEN 'pytest' WHEN rs THEN 'cargo' WHEN go THEN 'go' END AS test_tool, CASE WHEN ts THEN 'tsc' WHEN pp THEN 'mypy' END AS type_tool FROM h""",
}
