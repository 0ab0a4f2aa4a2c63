"""Ranking, triage and budgets over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph as G
from tessera.operators import retrieval as R
from tessera.queries.text import DOC, FILES, NAMES, RESOLVED, TOK, docs, files

TERMS = ("token", "budget", "journal")
RISKS = ("secret", "token", "budget", "error", "cache", "limit", "stale", "wrong", "path")  # of this corpus
BUDGET = 5000
SEEDS, FOLDERS = ("src/minimap/index.ts",), ("cmd/queue", "src/minimap")


def idf_stats(spark, d):
    return R.term_stats(docs(spark, d), TERMS).select("term", F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"), "n_docs", F.round("avgdl", 6).alias("avgdl"))


def rank_bm25(spark, d):
    return R.rank_documents(docs(spark, d), TERMS, 10)


def file_features(spark, d):
    heads = F.regexp_extract_all("content", F.lit(r"(?m)^#{1,6}\s+([^\n]+)"), F.lit(1))
    return files(spark, d).select("file_id", "repo", "path", "content", F.regexp_extract_all("content", F.lit(NAMES), F.lit(1)).alias("names"), heads.alias("heads"))


def features_and_edges(spark, d):
    features = file_features(spark, d)
    return features, G.resolve(G.import_edges(features), features)


def metadata_score(spark, d):
    return file_features(spark, d).select("file_id", R.metadata_score(TERMS, F.col("path"), F.col("names"), F.col("heads")).cast("long").alias("score")).where("score > 0")


def file_score(spark, d):
    """Points of one file without a corpus: names and occurrences."""
    score = R.metadata_score(TERMS, F.col("path"), F.col("names"), F.col("heads")) + R.content_score(TERMS, F.col("content"))
    return file_features(spark, d).select("file_id", score.cast("long").alias("score"))


def rank_combined(spark, d):
    features = file_features(spark, d)
    stats = R.term_stats(features, TERMS, "content").collect()
    score = F.round(R.metadata_score(TERMS, F.col("path"), F.col("names"), F.col("heads")) + R.bm25(F.col("content"), stats), 6)
    return features.select("file_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "file_id").limit(10)


def evidence_lines(spark, d):
    return R.evidence_lines(docs(spark, d), RISKS)


def risk_triage(spark, d):
    """The two passes with the fixed terms of risk."""
    return R.review(docs(spark, d), TERMS)


def reviewed(spark, d):
    """With terms of this corpus, and changelogs as what was changed."""
    changed = docs(spark, d).where("kind = 'changelog'")
    return R.review(docs(spark, d), TERMS, changed, RISKS)


def review_files(spark, d):
    return reviewed(spark, d)


def review_totals(spark, d):
    return R.review_totals(reviewed(spark, d))


def review_clusters(spark, d):
    return R.review_clusters(reviewed(spark, d))


def changed_boost(spark, d):
    corpus = docs(spark, d)
    ranked = R.rank_documents(corpus, TERMS, None)
    changed = corpus.where("kind = 'changelog'").select("doc_id", F.lit(True).alias("changed"))
    both = ranked.join(changed, "doc_id", "full")
    return both.select("doc_id", F.coalesce("changed", F.lit(False)).alias("changed"), F.round(F.when(F.col("changed"), 2 * F.coalesce("score", F.lit(0.1))).otherwise(F.col("score")), 6).alias("score"))


def truncate_to_budget(spark, d):
    return R.truncate_to_budget(docs(spark, d), 100)


def context_allocation(spark, d):
    sources = docs(spark, d).select(
        "doc_id", F.coalesce("source", F.lit("")).alias("request"), T.token_count(F.col("text")).cast("long").alias("tokens"), F.when(F.col("kind") == "adr", "high").when(F.col("kind").isin("guide", "readme"), "normal").otherwise("low").alias("priority")
    )
    return R.allocate(sources, BUDGET)


def shared_dependency_boost(spark, d):
    features, edges = features_and_edges(spark, d)
    best = R.select_files(features, edges, TERMS, depth=0, k=R.SCAN)
    return G.shared_boost(best.select(F.col("file_id").alias("node"), "score"), edges)


def expand_graph(spark, d):
    """From all files with the highest priority, two steps along imports."""
    features, edges = features_and_edges(spark, d)
    best = R.select_files(features, edges, TERMS, depth=0, k=R.SCAN).select(F.col("file_id").alias("node"), "score", "priority")
    return G.expand_candidates(best, edges, 2)


def gather_files(spark, d):
    """With a file and a folder as seeds."""
    features, edges = features_and_edges(spark, d)
    return R.select_files(features, edges, TERMS, seeds=SEEDS, folders=FOLDERS)


def gather(spark, d):
    features, edges = features_and_edges(spark, d)
    return R.gather(features, edges, TERMS, BUDGET, seeds=SEEDS, folders=FOLDERS)


QUERIES = {
    f.__name__: f
    for f in (
        idf_stats, rank_bm25, metadata_score, file_score, rank_combined, evidence_lines, risk_triage, review_files, review_totals, review_clusters, changed_boost, truncate_to_budget, context_allocation, shared_dependency_boost, expand_graph,
        gather_files, gather,
    )
}

# The same results in SQL, with values of their own.
_RISKS = "['secret', 'token', 'budget', 'error', 'cache', 'limit', 'stale', 'wrong', 'path']"
_FIXED = "['deadline', 'return false', 'open(lockpath', 'writefilesync', 'renamesync', 'atomic', 'todo', 'fixme', 'hack']"


def _ranked(source: str, key: str, text: str) -> str:
    tf = [f"len(regexp_extract_all(lower({text}), '\\b{t}\\b'))" for t in TERMS]
    cols = ", ".join(f"{x} AS t{i}" for i, x in enumerate(tf))
    df = ", ".join(f"sum((t{i} > 0)::INT) AS d{i}" for i in range(len(TERMS)))
    score = " + ".join(f"ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * t{i} * 2.5 / (t{i} + 1.5 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(TERMS)))
    return f"tf AS (SELECT {key}, len(regexp_extract_all({text}, '{TOK}')) AS dl, {cols} FROM {source}), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM tf), ranked AS (SELECT {key}, CASE WHEN dl = 0 THEN 0 ELSE {score} END AS score FROM tf, st)"


def _hit(value: str) -> str:
    return rf"regexp_matches(replace({value}, '_', ' '), '\b(token|budget|journal)\b')"


_SPLIT = r"lower(regexp_replace(x, '([a-z])([A-Z])', '\1 \2', 'g'))"
_META = f"CASE WHEN {_hit('lower(f)')} THEN 3 ELSE 0 END + " + " + ".join(f"least({most}, {each} * len(list_filter({values}, lambda x: {_hit(_SPLIT)})))" for most, each, values in ((2, 1, "dirs"), (6, 2, "names"), (4, 2, "heads")))
_FEATURES = rf"""{FILES}, ft AS (SELECT file_id, content, parts[-1] AS f, parts[:-2] AS dirs, names, heads FROM (SELECT file_id, content, string_split(path, '/') AS parts,
    regexp_extract_all(content, '(?:function|const|let|var|class|interface|type|enum)\s+(\w+)', 1) AS names, regexp_extract_all(content, '(?m)^#{{1,6}}\s+([^\n]+)', 1) AS heads FROM files))"""
_SCORED = f"{_FEATURES}, {_ranked('files', 'file_id', 'content')}, sf AS (SELECT file_id, round({_META} + score, 6) AS score FROM ranked JOIN ft USING (file_id)), top AS (SELECT * FROM sf WHERE score > 0 ORDER BY score DESC, file_id LIMIT 50)"


def _read(budget: int, source: str) -> str:
    """Lines, tokens and text of a read within a budget."""
    return f"""a{budget} AS (SELECT doc_id, text, len(regexp_extract_all(text, '{TOK}')) AS total, string_split(text, chr(10)) AS l FROM {source}), b{budget} AS (SELECT doc_id, total, generate_subscripts(l, 1) AS n, unnest(l) AS x FROM a{budget}),
        c{budget} AS (SELECT *, sum(len(regexp_extract_all(x, '{TOK}'))) OVER w AS t, sum(length(x) + 1) OVER w - length(x) - 1 AS ch FROM b{budget} WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
        k{budget} AS (SELECT doc_id, coalesce(max(n) FILTER (t <= {budget} - 5 AND ch <= 5 * {budget}), 0) AS n, coalesce(max(t) FILTER (t <= {budget} - 5 AND ch <= 5 * {budget}), 0)::BIGINT AS t FROM c{budget} GROUP BY 1),
        r{budget} AS (SELECT doc_id, total, CASE WHEN total <= {budget} THEN len(l) ELSE n END AS lines, CASE WHEN total <= {budget} THEN total ELSE t + 4 END AS tokens, CASE WHEN total <= {budget} THEN text ELSE array_to_string(l[:n], chr(10)) || chr(10) || '[...truncated, ~' || (total - t) || ' more tokens]' END AS body
        FROM a{budget} JOIN k{budget} USING (doc_id))"""


def _review(risks: str, changed: str | None) -> str:
    best = "SELECT doc_id, round(score, 6) AS score FROM ranked WHERE round(score, 6) > 0 ORDER BY 2 DESC, 1 LIMIT 10"
    candidates = f"cd AS ({best})" if changed is None else f"""tp AS ({best}), ch AS (SELECT doc_id FROM {DOC} AND {changed}), cd AS (SELECT coalesce(tp.doc_id, ch.doc_id) AS doc_id, CASE WHEN ch.doc_id IS NOT NULL THEN 2 * coalesce(score, 0.1) ELSE score END::DOUBLE AS score FROM tp FULL JOIN ch ON tp.doc_id = ch.doc_id)"""
    source = "(SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM cd))"
    return f"""{_ranked(DOC, 'doc_id', 'text')}, {candidates}, {_read(600, source)}, {_read(2000, source)}, p1 AS (SELECT doc_id, score, r600.total AS full_tokens, r600.tokens AS pass1_tokens, list_filter({risks}, lambda t: contains(lower(r600.body), t)) AS risks FROM cd JOIN r600 USING (doc_id)),
        ag AS (SELECT doc_id FROM p1 WHERE len(risks) > 0 AND full_tokens > 600 ORDER BY score DESC, doc_id LIMIT 3),
        rv AS (SELECT doc_id, round(score, 6) AS score, full_tokens, pass1_tokens, len(risks) > 0 AS flagged, array_to_string(risks, ',') AS risks, CASE WHEN doc_id IN (SELECT doc_id FROM ag) THEN (SELECT tokens FROM r2000 WHERE r2000.doc_id = p1.doc_id) ELSE 0 END AS pass2_tokens FROM p1)"""


_REVIEWED = _review(_RISKS, "kind = 'changelog'")
_BOOST = "bo AS (SELECT resolved AS node, count(*)::DOUBLE AS score FROM re WHERE resolved IS NOT NULL AND file_id IN (SELECT node FROM ca) AND resolved NOT IN (SELECT node FROM ca) GROUP BY 1 HAVING count(*) >= 2)"


def _level(n: int, before: str) -> str:
    """The next level of an expansion: what the last one leads to, with the best of half the parents' scores."""
    return f"f{n} AS (SELECT resolved AS node, max(greatest(1, floor(score * 0.5))) AS score FROM (SELECT DISTINCT file_id, resolved FROM re WHERE resolved IS NOT NULL) e JOIN {before} p ON p.node = e.file_id GROUP BY 1)"


_SEEDED = r"""sp AS (SELECT sf.file_id, score, regexp_replace(path, '^\./', '') AS path FROM sf JOIN files USING (file_id)), al AS (SELECT file_id AS node, 100.0::DOUBLE AS score, 'high' AS priority, 0 AS src FROM sp WHERE path = 'src/minimap/index.ts'
    UNION ALL SELECT file_id, greatest(score, 5), 'high', 1 FROM sp WHERE score > 0 AND (starts_with(path, 'cmd/queue/') OR starts_with(path, 'src/minimap/')) UNION ALL SELECT file_id, score, CASE WHEN score >= 5 THEN 'high' ELSE 'normal' END, 2 FROM top),
    ca AS (SELECT node, arg_min(score, src) AS score, arg_min(priority, src) AS priority FROM al GROUP BY 1)"""
_PLAIN = "ca AS (SELECT file_id AS node, score, CASE WHEN score >= 5 THEN 'high' ELSE 'normal' END AS priority FROM top)"

ORACLES = {
    "idf_stats": " UNION ALL ".join(
        f"SELECT '{t}' AS term, sum((len(regexp_extract_all(lower(text), '\\b{t}\\b')) > 0)::INT)::BIGINT AS df, round(ln((count(*) - df + 0.5) / (df + 0.5) + 1), 6) AS idf, count(*) AS n_docs, round(avg(len(regexp_extract_all(text, '{TOK}'))), 6) AS avgdl FROM {DOC}"
        for t in TERMS
    ),
    "rank_bm25": f"WITH {_ranked(DOC, 'doc_id', 'text')} SELECT doc_id, round(score, 6) AS score FROM ranked WHERE round(score, 6) > 0 ORDER BY 2 DESC, 1 LIMIT 10",
    "metadata_score": f"WITH {_FEATURES} SELECT * FROM (SELECT file_id, ({_META})::BIGINT AS score FROM ft) WHERE score > 0",
    "rank_combined": f"WITH {_SCORED} SELECT * FROM top ORDER BY score DESC, file_id LIMIT 10",
    "evidence_lines": f"""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {DOC}), b AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS x FROM a)
        SELECT doc_id, line_no, term, regexp_replace(x, '^[{T.SPACES}]+|[{T.SPACES}]+$', '', 'g') AS line FROM (SELECT *, list_filter({_RISKS}, lambda t: contains(lower(x), t))[1] AS term FROM b) WHERE term IS NOT NULL""",
    "risk_triage": f"WITH {_review(_FIXED, None)} SELECT * FROM rv",
    "review_totals": f"""WITH {_REVIEWED}, t AS (SELECT sum(full_tokens)::BIGINT AS full_tokens, sum(pass1_tokens)::BIGINT AS pass1_tokens, sum(pass2_tokens)::BIGINT AS pass2_tokens, count(*) FILTER (pass2_tokens > 0) AS pass2_files FROM rv)
        SELECT *, full_tokens - pass1_tokens - pass2_tokens AS saved_tokens, round((full_tokens - pass1_tokens - pass2_tokens) * 100 / full_tokens, 1) AS reduction_pct FROM t""",
    "review_clusters": f"WITH {_REVIEWED} SELECT string_split(risks, ',')[1] AS term, count(*) AS n_files, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS files FROM rv WHERE flagged GROUP BY 1",
    "changed_boost": f"""WITH {_ranked(DOC, 'doc_id', 'text')}, r AS (SELECT doc_id, round(score, 6) AS score FROM ranked WHERE round(score, 6) > 0), c AS (SELECT doc_id FROM {DOC} AND kind = 'changelog')
        SELECT coalesce(r.doc_id, c.doc_id) AS doc_id, c.doc_id IS NOT NULL AS changed, round(CASE WHEN c.doc_id IS NOT NULL THEN 2 * coalesce(score, 0.1) ELSE score END, 6) AS score FROM r FULL JOIN c ON r.doc_id = c.doc_id""",
    "truncate_to_budget": f"WITH {_read(100, DOC)} SELECT doc_id, total, lines, tokens FROM r100",
    "context_allocation": f"""WITH s AS (SELECT doc_id, coalesce(source, '') AS request, len(regexp_extract_all(text, '{TOK}')) AS tokens, CASE WHEN kind = 'adr' THEN 'high' WHEN kind IN ('guide', 'readme') THEN 'normal' ELSE 'low' END AS priority FROM {DOC}),
        w AS (SELECT *, tokens * CASE priority WHEN 'high' THEN 2.0 WHEN 'normal' THEN 1.0 ELSE 0.25 END::DOUBLE AS w FROM s), t AS (SELECT request, sum(tokens) AS a, sum(w) AS sw FROM w GROUP BY 1)
        SELECT doc_id, request, tokens, priority, CASE WHEN a <= 5000 THEN tokens ELSE greatest(10, floor(w / sw * 5000)::BIGINT) END AS allocated FROM w JOIN t USING (request)""",
    "review_files": f"WITH {_REVIEWED} SELECT * FROM rv",
    "file_score": f"""WITH {_FEATURES} SELECT file_id, ({_META} + {" + ".join(f"least(5, (length(content) - length(replace(lower(content), '{t}', ''))) // {len(t)})" for t in TERMS)})::BIGINT AS score FROM ft""",
    "shared_dependency_boost": f"WITH {_SCORED}, {RESOLVED}, {_PLAIN}, {_BOOST} SELECT * FROM bo",
    "expand_graph": f"""WITH {_SCORED}, {RESOLVED}, {_PLAIN}, h AS (SELECT node, score FROM ca WHERE priority = 'high'), {_level(1, "h")}, g AS (SELECT * FROM f1 WHERE node NOT IN (SELECT node FROM h)), {_level(2, "g")},
        u AS (SELECT node, max(score) AS score FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY 1) SELECT coalesce(ca.node, u.node) AS node, CASE WHEN ca.node IS NOT NULL THEN ca.score ELSE u.score END AS score, coalesce(priority, 'low') AS priority FROM ca FULL JOIN u ON ca.node = u.node""",
    "gather_files": f"""WITH {_SCORED}, {RESOLVED}, {_SEEDED}, {_BOOST}, ba AS (SELECT * FROM ca UNION ALL SELECT node, score, 'low' FROM bo), h AS (SELECT node, score FROM ba WHERE priority = 'high'), {_level(1, "h")},
        x AS (SELECT coalesce(ba.node, f1.node) AS file_id, CASE WHEN coalesce(priority, 'low') = 'low' THEN greatest(ba.score, f1.score) ELSE ba.score END AS score, coalesce(priority, 'low') AS priority FROM ba FULL JOIN f1 ON ba.node = f1.node) SELECT * FROM x ORDER BY score DESC, file_id LIMIT 15""",
}
