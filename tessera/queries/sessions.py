"""Tool-call sessions, rules and the session stream over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sessions as S
from tessera.queries.text import DOC, docs
from tessera.sources.tables import table
from tessera.streaming.sessions import run_sessions

# Small fixed rule tables: event class, pattern for the file, what is injected, priority.
RULES = [("read", "^d0/", "context", "look at the outline first"), ("edit", "^d[12]/", "block", "frozen folder"), ("outline", ".", "allow", ""), ("read", "/f7$", "context", "generated file")]
LEARNINGS = [("d0/*", "prefers small edits"), ("d1/f1", "has a twin"), ("d9/*", "gone")]


def calls(spark, d):
    return S.calls(table(spark, d, "events"))


def session_signals(spark, d):
    return S.signals(calls(spark, d))


def tool_classes(spark, d):
    return calls(spark, d).groupBy("tool").agg(F.count("*").alias("n")).select("tool", S.tool_class(F.col("tool")).alias("class"), "n")


def reread_detection(spark, d):
    return S.with_history(calls(spark, d)).where("tool = 'read' AND read_turn IS NOT NULL").select("session_id", "turn", "file", "read_turn", "hot")


def dir_batching(spark, d):
    h = S.with_history(calls(spark, d)).where("tool = 'read'")
    return h.select("session_id", "turn", F.size(F.filter("recent_dirs", lambda x: x == F.col("dir"))).cast("long").alias("n_same_dir"))


def mutation_safety(spark, d):
    h = S.with_history(calls(spark, d)).where("tool = 'edit'")
    reason = F.when(F.col("read_turn").isNull(), "no read evidence").when(~F.col("fresh"), "stale")
    return h.select("session_id", "turn", "file", F.col("fresh").alias("safe"), reason.alias("reason"))


def session_metrics(spark, d):
    return S.metrics(calls(spark, d))


def rules_decision(spark, d):
    return S.decide_rules(calls(spark, d)).select("session_id", "turn", "rule", "outcome")


def cost_choice(spark, d):
    return S.cost_choice(S.decide_rules(calls(spark, d)))


def pipeline_decision(spark, d):
    return S.decide(calls(spark, d))


def surface_downgrades(spark, d):
    return S.downgrade(S.decide(calls(spark, d)))


def intent_classification(spark, d):
    kind, confidence = S.classify_intent(F.col("text"))
    return docs(spark, d).select("doc_id", kind.alias("intent"), confidence.alias("confidence"), F.size(S.focal_files(F.col("text"))).cast("long").alias("n_files"))


def budget_zones(spark, d):
    """The zones of context windows of several sizes."""
    sizes = F.explode(F.array(*[F.lit(x) for x in (200_000, 128_000, 8_191)])).alias("total")
    return spark.range(1).select(sizes).select("total", *[F.floor(F.col("total") * share + 0.5).cast("long").alias(zone) for zone, share in S.ZONES.items()])


def task_weights(spark, d):
    """Each session's corrected task and its weights, if its prompt had named the task that its user's number picks."""
    last = S.signals(calls(spark, d)).groupBy("session_id").agg(*[F.max(x).alias(x) for x in ("sequential_reads", "working_share", "unique_files", "mutations", "n_tools")])
    named = F.element_at(F.array(*[F.lit(x) for x in S.BASE_WEIGHTS]), (F.split("session_id", "/")[0].cast("long") % 6 + 1).cast("int"))
    task = S.detect_drift(F.col("named"), F.col("unique_files"), F.col("mutations"), F.col("n_tools"))
    drifted = last.withColumn("named", named).withColumn("task", task)
    tokens, latency, n_calls = S.task_weights(F.col("task"), F.col("sequential_reads"), F.col("working_share"))
    return drifted.select("session_id", "named", "task", F.round(tokens, 6).alias("w_tokens"), F.round(latency, 6).alias("w_latency"), F.round(n_calls, 6).alias("w_calls"))


def outcome_asof(spark, d):
    """What a command's result is bound to: the call before it, whatever it was."""
    c = calls(spark, d).withColumn("of_turn", F.lag("turn").over(S.in_order()))
    return c.where("tool = 'bash'").select("session_id", "turn", "of_turn")


def rule_table(spark):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(RULES)], "rule long, on_tool string, pattern string, inject string, value string")


def rule_join(spark, d):
    rules = F.broadcast(rule_table(spark))  # RULES, a fixed handful
    c = calls(spark, d)
    hit = c.join(rules, (c["tool"] == rules["on_tool"]) & F.expr("file rlike pattern"))
    rank = F.when(F.col("inject") == "block", 0).when(F.col("inject") == "allow", 1).otherwise(2)
    return hit.groupBy("session_id", "turn").agg(F.count("*").alias("n_rules"), F.min_by("inject", F.struct(rank, "rule")).alias("inject"), F.min_by("value", F.struct(rank, "rule")).alias("value"))


def learning_table(spark):
    rows = spark.createDataFrame(LEARNINGS, "file_glob string, learning string")
    return rows.withColumn("pattern", F.concat(F.lit("^"), F.replace("file_glob", F.lit("*"), F.lit("[^/]*")), F.lit("$")))


def learnings_lookup(spark, d):
    used = calls(spark, d).where("file IS NOT NULL").groupBy("file").agg(F.count("*").alias("n_calls"))
    return used.join(F.broadcast(learning_table(spark)), F.expr("file rlike pattern")).select("file", "learning", "n_calls")


def orphan_learnings(spark, d):
    used = calls(spark, d).where("file IS NOT NULL").select("file").distinct()
    return F.broadcast(learning_table(spark)).join(used, F.expr("file rlike pattern"), "left_anti").select("file_glob", "learning")


def session_windows(spark, d):
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    made = events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("value"))
    return made.select("user_id", F.unix_millis("w.start").alias("start_ms"), "n_events", "value")


def stream_sessions(spark, d):
    return run_sessions(spark, f"{d}/events.parquet")


QUERIES = {
    f.__name__: f
    for f in (
        session_signals, tool_classes, reread_detection, dir_batching, mutation_safety, session_metrics, rules_decision, cost_choice, pipeline_decision, surface_downgrades, intent_classification, budget_zones, task_weights, outcome_asof,
        rule_join, learnings_lookup, orphan_learnings, session_windows, stream_sessions,
    )
}

# The same results in SQL, with values of their own. The state before a call is found by asking the calls before it.
_K = "coalesce(json_extract_string(props, '$.k')::INT, 0)"
_C = f"""c AS (SELECT *, tool IN ('read', 'grep', 'glob', 'gather', 'outline', 'focus', 'rank', 'context') AS r, tool IN ('edit', 'write', 'patch', 'insert', 'rename', 'bash') AS m, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS turn FROM (
    SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS session_id, event_id, ts, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'grep' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'outline' ELSE 'bash' END AS tool,
    CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN 'd' || ({_K} % 3) || '/f' || ({_K} % 9) END AS file, CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN 'd' || ({_K} % 3) END AS dir,
    greatest(0, round(coalesce(value, 0) * 20 - 200)::BIGINT) AS tokens, CASE {_K} % 4 WHEN 1 THEN 'budgeted' WHEN 2 THEN 'partial' ELSE 'full' END AS strategy, {_K} % 2 = 0 AS scoped FROM events))"""
_S = f"""{_C}, s1 AS (SELECT *, CASE WHEN r THEN turn - coalesce(max(CASE WHEN NOT r THEN turn END) OVER w, -1) ELSE 0 END AS streak, (row_number() OVER (PARTITION BY session_id, tool ORDER BY turn) = 1)::INT AS nt,
    CASE WHEN r AND file IS NOT NULL THEN row_number() OVER (PARTITION BY session_id, file, r ORDER BY turn) END AS fr FROM c WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
    sg AS (SELECT session_id, turn, sum(tokens) OVER w AS tokens_so_far, streak AS read_streak, max(streak) OVER w AS sequential_reads, sum((fr = 1)::INT) OVER w AS unique_files, sum(m::INT) OVER w AS mutations, sum((fr > 1)::INT) OVER w AS rereads, sum(nt) OVER w AS n_tools FROM s1
    WINDOW w AS (PARTITION BY session_id ORDER BY turn))"""
_H = f"""{_C}, h AS (SELECT a.*, (SELECT max(b.turn) FROM c b WHERE b.session_id = a.session_id AND b.file = a.file AND b.turn < a.turn AND b.r) AS read_turn, (SELECT max(b.turn) FROM c b WHERE b.session_id = a.session_id AND b.file = a.file AND b.turn < a.turn AND b.m) AS changed_turn,
    coalesce((SELECT sum(b.tokens) FROM c b WHERE b.session_id = a.session_id AND b.turn < a.turn), 0) AS spent, (SELECT count(*) FROM c b WHERE b.session_id = a.session_id AND b.tool = 'read' AND b.turn < a.turn AND b.dir = a.dir
        AND (SELECT count(*) FROM c e WHERE e.session_id = a.session_id AND e.tool = 'read' AND e.turn >= b.turn AND e.turn < a.turn) <= 5) AS same_dir FROM c a),
    dc AS (SELECT *, CASE WHEN tool = 'read' AND read_turn IS NOT NULL AND strategy = 'full' THEN 'same_read' WHEN tool = 'read' AND read_turn IS NOT NULL AND changed_turn IS NULL THEN 'reread_unchanged' WHEN tool = 'read' AND same_dir >= 3 THEN 'dir_batching'
        WHEN tool = 'read' AND tokens < 200 THEN 'tiny_file' WHEN tool = 'read' AND read_turn IS NULL THEN 'first_read' WHEN tool = 'read' AND tokens > 2000 AND strategy = 'full' THEN 'large_file_no_budget' WHEN tool = 'grep' AND NOT scoped THEN 'unscoped_search'
        WHEN tool = 'edit' AND (read_turn IS NULL OR changed_turn > read_turn) THEN 'no_evidence' WHEN r AND tokens > 80000 - spent THEN 'budget_pressure' ELSE 'default' END AS rule,
        CASE WHEN rule = 'same_read' THEN 'return_cached' WHEN rule IN ('reread_unchanged', 'dir_batching', 'large_file_no_budget', 'budget_pressure') THEN 'escalate' WHEN rule = 'unscoped_search' THEN 'rewrite' WHEN rule = 'no_evidence' THEN 'inject_before' ELSE 'allow' END AS outcome FROM h)"""
_COST = """op AS (SELECT session_id, turn, tokens, spent, 0.4::DOUBLE * tokens + 0.6::DOUBLE AS own, 0.4::DOUBLE * greatest(50, tokens * 0.05::DOUBLE) + 0.9::DOUBLE AS o, 0.4::DOUBLE * (tokens / 3.0::DOUBLE) + 0.6::DOUBLE AS b, CASE WHEN scoped THEN 160.6::DOUBLE ELSE 'Infinity'::DOUBLE END AS f FROM dc WHERE tool = 'read' AND tokens > 500),
    co AS (SELECT *, least(o, b, f) AS best, CASE WHEN f <= o AND f <= b THEN 'focus' WHEN b <= o THEN 'read' ELSE 'outline' END AS choice, (own - best) / own AS saved, CASE WHEN saved > 0.3 THEN 'rewrite' WHEN saved >= 0.1 THEN 'escalate' ELSE 'allow' END AS cost_outcome FROM op)"""
_PIPE = f"""{_COST}, pl AS (SELECT session_id, turn, tool, rule, CASE WHEN outcome <> 'escalate' THEN outcome WHEN cost_outcome IN ('rewrite', 'escalate') THEN 'rewrite' ELSE 'allow' END AS action,
    CASE WHEN rule = 'unscoped_search' THEN 'rank' WHEN outcome = 'escalate' AND cost_outcome IN ('rewrite', 'escalate') THEN choice END AS instead FROM dc LEFT JOIN co USING (session_id, turn))"""
_INTENTS = [
    (r"(?i)^(what|where)\s+(is|are|file|class|function|module|package)\b.{0,50}$", "pinpoint", 0.7), (r"(?i)\b(fix|bug|error|crash|broken|failing)\b", "targeted_fix", 0.8), (r"(?i)\b(add|implement|create|build|new)\b", "feature", 0.7),
    (r"(?i)\b(rename|move|extract|refactor|split|merge)\b", "refactor", 0.8), (r"(?i)\b(what|how|why|explain|understand)\b", "exploration", 0.6), (r"(?i)\b(test|check|verify|does it work)\b", "verification", 0.7),
]

ORACLES = {
    "session_signals": f"WITH {_S} SELECT session_id, turn, tokens_so_far::BIGINT AS tokens_so_far, tokens_so_far / 80000.0::DOUBLE AS working_share, read_streak, sequential_reads, coalesce(unique_files, 0)::BIGINT AS unique_files, mutations::BIGINT AS mutations, coalesce(rereads, 0)::BIGINT AS rereads, n_tools::BIGINT AS n_tools FROM sg",
    "tool_classes": f"WITH {_C} SELECT tool, CASE tool WHEN 'read' THEN 'read' WHEN 'grep' THEN 'search' WHEN 'edit' THEN 'mutate' WHEN 'outline' THEN 'read' ELSE 'execute' END AS class, count(*) AS n FROM c GROUP BY 1",
    "reread_detection": f"WITH {_H} SELECT session_id, turn, file, read_turn, changed_turn IS NOT NULL AS hot FROM h WHERE tool = 'read' AND read_turn IS NOT NULL",
    "dir_batching": f"WITH {_H} SELECT session_id, turn, same_dir AS n_same_dir FROM h WHERE tool = 'read'",
    "mutation_safety": f"WITH {_H} SELECT session_id, turn, file, read_turn IS NOT NULL AND coalesce(changed_turn, -1) < read_turn AS safe, CASE WHEN read_turn IS NULL THEN 'no read evidence' WHEN changed_turn > read_turn THEN 'stale' END AS reason FROM h WHERE tool = 'edit'",
    "session_metrics": f"""WITH {_H}, {_PIPE}, nx AS (SELECT *, lead(tool) OVER (PARTITION BY session_id ORDER BY turn) AS nt FROM pl), ac AS (SELECT session_id, avg((instead = nt)::INT) AS acc FROM nx WHERE action = 'rewrite' AND nt IS NOT NULL GROUP BY 1),
        fl AS (SELECT session_id, file, bool_or(r) AS r, bool_or(m) AS m, max(CASE WHEN r THEN turn END) AS lr, max(CASE WHEN m THEN turn END) AS lm FROM c WHERE file IS NOT NULL GROUP BY 1, 2),
        ft AS (SELECT session_id, count(*) FILTER (r AND NOT m) AS wasted_reads, count(*) FILTER (lm > lr) AS stale_evidence FROM fl GROUP BY 1),
        b AS (SELECT session_id, sum(tokens)::BIGINT AS total_tokens, count(*) FILTER (m) AS nm, count(*) FILTER (r) AS nr, count(*) FILTER (r AND tokens = 0) AS hits, count(*) FILTER (m AND file IS NOT NULL AND (read_turn IS NULL OR changed_turn > read_turn)) AS safety_blocks FROM h GROUP BY 1)
        SELECT session_id, total_tokens, CASE WHEN nm = 0 THEN 'Infinity'::DOUBLE ELSE round(total_tokens / nm, 6) END AS tokens_per_mutation, CASE WHEN nm = 0 THEN 'Infinity'::DOUBLE ELSE round(nr / nm, 6) END AS reads_per_mutation,
        CASE WHEN nr = 0 THEN 0.0 ELSE round(hits / nr, 6) END AS cache_hit_rate, safety_blocks, coalesce(wasted_reads, 0) AS wasted_reads, coalesce(stale_evidence, 0) AS stale_evidence, round(coalesce(acc, 1.0), 6) AS acceptance FROM b LEFT JOIN ft USING (session_id) LEFT JOIN ac USING (session_id)""",
    "rules_decision": f"WITH {_H} SELECT session_id, turn, rule, outcome FROM dc",
    "cost_choice": f"""WITH {_H}, {_COST} SELECT session_id, turn, choice, round(saved, 6) AS saved, cost_outcome AS outcome, floor(tokens - CASE choice WHEN 'focus' THEN 400 WHEN 'read' THEN tokens / 3.0::DOUBLE ELSE greatest(50, tokens * 0.05::DOUBLE) END + 0.5)::BIGINT AS saved_tokens,
        (80000 - spent)::BIGINT AS remaining, CASE WHEN 80000 - spent < 16000 THEN 'high' WHEN 80000 - spent < 40000 THEN 'medium' ELSE 'low' END AS pressure FROM co""",
    "pipeline_decision": f"WITH {_H}, {_PIPE} SELECT * FROM pl",
    "surface_downgrades": f"""WITH {_H}, {_PIPE}, n AS (SELECT action, count(*) AS n FROM pl GROUP BY 1), s(surface, able) AS (VALUES ('hook', false), ('editor', false), ('server', true), ('shell', true), ('library', true))
        SELECT surface, action, CASE WHEN NOT able AND action IN ('return_cached', 'inject_before') THEN 'warn' ELSE action END AS done, CASE WHEN able THEN NULL WHEN action = 'rewrite' THEN 'rewriteToContext' WHEN action = 'return_cached' THEN 'returnCachedToDeny' WHEN action = 'inject_before' THEN 'injectBeforeToWarn' END AS downgrade, n FROM n, s""",
    "intent_classification": f"""SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for p, n, _ in _INTENTS)} ELSE 'exploration' END AS intent, CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN {v}" for p, _, v in _INTENTS)} ELSE 0.3 END::DOUBLE AS confidence,
        len(regexp_extract_all(text, '(?i)(?:^|\\s)((?:[\\w.-]+/)*[\\w.-]+\\.[a-z]{{1,5}})(?:\\s|$|:|\\b)', 1)) AS n_files FROM {DOC}""",
    "budget_zones": "SELECT total, floor(total * 0.15 + 0.5)::BIGINT AS system, floor(total * 0.25 + 0.5)::BIGINT AS starter, floor(total * 0.40 + 0.5)::BIGINT AS working, floor(total * 0.15 + 0.5)::BIGINT AS output, floor(total * 0.05 + 0.5)::BIGINT AS safety FROM (VALUES (200000), (128000), (8191)) v(total)",
    "task_weights": f"""WITH {_S}, l AS (SELECT session_id, max(sequential_reads) AS sr, max(tokens_so_far) / 80000.0::DOUBLE AS sh, coalesce(max(unique_files), 0) AS uf, max(mutations) AS mu, max(n_tools) AS nt, ['pinpoint', 'targeted_fix', 'feature', 'refactor', 'exploration', 'verification'][string_split(session_id, '/')[1]::BIGINT % 6 + 1] AS named FROM sg GROUP BY session_id),
        d AS (SELECT *, CASE WHEN mu >= 2 AND named NOT IN ('verification', 'refactor') THEN 'verification' WHEN (uf > 8)::INT * 3 + (mu = 0 AND uf > 5)::INT * 3 + (nt > 5)::INT * 2 > 5 THEN 'exploration' ELSE named END AS task FROM l),
        b(task, t, y, k) AS (VALUES ('pinpoint', 0.2, 0.6, 0.2), ('targeted_fix', 0.6, 0.2, 0.2), ('feature', 0.35, 0.3, 0.35), ('refactor', 0.2, 0.2, 0.6), ('exploration', 0.4, 0.3, 0.3), ('verification', 0.3, 0.5, 0.2)),
        w AS (SELECT session_id, named, task, greatest(0.05, t - CASE WHEN sr > 3 THEN 0.1 ELSE 0 END + CASE WHEN sh > 0.6 THEN 0.2 ELSE 0 END)::DOUBLE AS t, greatest(0.05, y + CASE WHEN sr > 3 THEN 0.15 ELSE 0 END - CASE WHEN sh > 0.6 THEN 0.1 ELSE 0 END)::DOUBLE AS y,
        greatest(0.05, k - CASE WHEN sr > 3 THEN 0.05 ELSE 0 END - CASE WHEN sh > 0.6 THEN 0.1 ELSE 0 END)::DOUBLE AS k FROM d JOIN b USING (task)) SELECT session_id, named, task, round(t / (t + y + k), 6) AS w_tokens, round(y / (t + y + k), 6) AS w_latency, round(k / (t + y + k), 6) AS w_calls FROM w""",
    "outcome_asof": f"WITH {_C} SELECT a.session_id, a.turn, max(b.turn) AS of_turn FROM c a LEFT JOIN c b ON a.session_id = b.session_id AND b.turn < a.turn WHERE a.tool = 'bash' GROUP BY 1, 2",
    "rule_join": f"""WITH {_C}, r(rule, on_tool, pattern, inject, value, rk) AS (VALUES (0, 'read', '^d0/', 'context', 'look at the outline first', 200), (1, 'edit', '^d[12]/', 'block', 'frozen folder', 1), (2, 'outline', '.', 'allow', '', 102), (3, 'read', '/f7$', 'context', 'generated file', 203)),
        j AS (SELECT session_id, turn, inject, value, rk FROM c JOIN r ON tool = on_tool AND regexp_matches(file, pattern)) SELECT session_id, turn, count(*) AS n_rules, arg_min(inject, rk) AS inject, arg_min(value, rk) AS value FROM j GROUP BY 1, 2""",
    "learnings_lookup": f"WITH {_C}, l(pattern, learning) AS (VALUES ('^d0/[^/]*$', 'prefers small edits'), ('^d1/f1$', 'has a twin'), ('^d9/[^/]*$', 'gone')) SELECT file, learning, count(*) AS n_calls FROM c JOIN l ON regexp_matches(file, pattern) GROUP BY 1, 2",
    "orphan_learnings": f"WITH {_C}, l(file_glob, pattern, learning) AS (VALUES ('d0/*', '^d0/[^/]*$', 'prefers small edits'), ('d1/f1', '^d1/f1$', 'has a twin'), ('d9/*', '^d9/[^/]*$', 'gone')) SELECT file_glob, learning FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE regexp_matches(file, pattern))",
    "session_windows": """WITH a AS (SELECT user_id, ts, value, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR)::INT AS same FROM events), b AS (SELECT *, sum(1 - coalesce(same, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM a)
        SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n_events, round(sum(value), 4) AS value FROM b GROUP BY user_id, run""",
    "stream_sessions": f"WITH {_S} SELECT session_id, count(*) AS n_calls, sum(tokens)::BIGINT AS tokens, max(read_streak) AS longest_streak FROM c JOIN sg USING (session_id, turn) GROUP BY 1",
}
