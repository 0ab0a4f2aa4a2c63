"""Tool-call sessions: signals, safety rules, costs and metrics over calls (session_id, turn, tool, kind, file, tokens).

A session is a user's calls of one day, so its size is bounded by what one user does in a day, and every window stays inside one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tools that read and tools that change, zones of the context, patterns of prompts with their task and confidence, weights
# of a task for tokens, latency and calls, and what surfaces can do (rewrite, return cached, inject before).
READ_TOOLS = ("read", "grep", "glob", "gather", "outline", "focus", "rank", "context")
MUTATION_TOOLS = ("edit", "write", "patch", "insert", "rename", "bash")
TOOL_CLASSES = {
    "Read": "read", "read": "read", "Grep": "search", "grep": "search", "Glob": "list", "glob": "list", "Edit": "mutate", "edit": "mutate", "Write": "mutate", "write": "mutate", "MultiEdit": "mutate", "multiedit": "mutate",
    "Bash": "execute", "bash": "execute", "gather": "search", "rank": "search", "symbols": "search", "outline": "read", "focus": "read", "context": "context", "patch": "mutate", "insert": "mutate", "rename": "mutate",
}
ZONES = {"system": 0.15, "starter": 0.25, "working": 0.40, "output": 0.15, "safety": 0.05}
CONTEXT = 200_000
INTENTS = (
    (r"^(what|where)\s+(is|are|file|class|function|module|package)(?![A-Za-z0-9_]).{0,50}$", "pinpoint", 0.7),
    (r"(?<![A-Za-z0-9_])(fix|bug|error|crash|broken|failing)(?![A-Za-z0-9_])", "targeted_fix", 0.8),
    (r"(?<![A-Za-z0-9_])(add|implement|create|build|new)(?![A-Za-z0-9_])", "feature", 0.7),
    (r"(?<![A-Za-z0-9_])(rename|move|extract|refactor|split|merge)(?![A-Za-z0-9_])", "refactor", 0.8),
    (r"(?<![A-Za-z0-9_])(what|how|why|explain|understand)(?![A-Za-z0-9_])", "exploration", 0.6),
    (r"(?<![A-Za-z0-9_])(test|check|verify|does it work)(?![A-Za-z0-9_])", "verification", 0.7),
)
BASE_WEIGHTS = {"pinpoint": (0.2, 0.6, 0.2), "targeted_fix": (0.6, 0.2, 0.2), "feature": (0.35, 0.3, 0.35), "refactor": (0.2, 0.2, 0.6), "exploration": (0.4, 0.3, 0.3), "verification": (0.3, 0.5, 0.2)}
STREAM_DAYS = 1_000_000  # days before 1970 from which the stream counts
SURFACES = (("hook", False, False, False), ("editor", False, False, False), ("server", True, True, True), ("shell", True, True, True), ("library", True, True, True))

# How the events table stands for calls.
TOOLS = {"view": "read", "click": "grep", "purchase": "edit", "error": "bash", "signup": "outline"}


def calls(events: DataFrame) -> DataFrame:
    """Events as tool calls: turn counts from 0 in a session; file, folder and arguments come from the properties. Searches and commands have no file."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    day = F.date_format("ts", "yyyy-MM-dd")
    tool = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv]), F.col("event_type")), F.lit("bash"))
    with_file = tool.isin("read", "edit", "outline")
    base = events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), day).alias("session_id"), "event_id", "ts", tool.alias("tool"),
        F.when(with_file, F.concat(F.lit("d"), (k % 3).cast("string"), F.lit("/f"), (k % 9).cast("string"))).alias("file"), F.when(with_file, F.concat(F.lit("d"), (k % 3).cast("string"))).alias("dir"),
        F.greatest(F.lit(0), F.round(F.coalesce("value", F.lit(0)) * 20 - 200).cast("long")).alias("tokens"), F.when(k % 4 == 1, "budgeted").when(k % 4 == 2, "partial").otherwise("full").alias("strategy"), (k % 2 == 0).alias("scoped"),
    )
    return base.withColumn("turn", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")).cast("long") - 1)


def in_order(*keys: str):
    return Window.partitionBy(*(keys or ("session_id",))).orderBy("turn")


def reads() -> Column:
    return F.col("tool").isin(*READ_TOOLS)


def mutates() -> Column:
    return F.col("tool").isin(*MUTATION_TOOLS)


def tool_class(tool: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TOOL_CLASSES.items() for x in kv]), tool), F.lit("execute"))


def signals(c: DataFrame) -> DataFrame:
    """After each call: consumed tokens and share of the working zone, the read streak and the longest so far, distinct files read, mutations,
    repeated reads of a file and distinct tools."""
    upto = in_order().rowsBetween(Window.unboundedPreceding, 0)
    broken = F.last(F.when(~reads(), F.col("turn")), ignorenulls=True).over(upto)
    own_file = in_order("session_id", "file").rowsBetween(Window.unboundedPreceding, -1)
    read_file = reads() & F.col("file").isNotNull()
    before = F.coalesce(F.sum(read_file.cast("long")).over(own_file), F.lit(0))
    marked = c.withColumns({"_tool": (F.row_number().over(in_order("session_id", "tool")) == 1).cast("long"), "_file": (read_file & (before == 0)).cast("long"), "_again": (read_file & (before > 0)).cast("long"), "_streak": F.when(reads(), F.col("turn") - F.coalesce(broken, F.lit(-1))).otherwise(0)})
    spent = F.sum("tokens").over(upto)
    total = lambda name: F.sum(name).over(upto)
    return marked.select(
        "session_id", "turn", spent.alias("tokens_so_far"), (spent / (CONTEXT * ZONES["working"])).alias("working_share"), F.col("_streak").alias("read_streak"), F.max("_streak").over(upto).alias("sequential_reads"),
        total("_file").alias("unique_files"), F.sum(mutates().cast("long")).over(upto).alias("mutations"), total("_again").alias("rereads"), total("_tool").alias("n_tools"),
    )


def with_history(c: DataFrame) -> DataFrame:
    """Before each call, what its session holds: the turn of the file's last read, whether the file was changed, whether its last event was a
    read, the folders of the last five reads, and the tokens spent. Read numbers carry the five, whatever stands between."""
    earlier = in_order("session_id", "file").rowsBetween(Window.unboundedPreceding, -1)
    has = F.col("file").isNotNull()
    kind = F.when(has & reads(), "read").when(has & mutates(), "mutate")
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    numbered = c.withColumn("_reads", F.coalesce(F.sum((F.col("tool") == "read").cast("long")).over(before), F.lit(0)))
    last_five = Window.partitionBy("session_id").orderBy("_reads").rangeBetween(-5, -1)
    return numbered.withColumns(
        {
            "read_turn": F.when(has, F.last(F.when(kind == "read", F.col("turn")), ignorenulls=True).over(earlier)),
            "hot": has & F.coalesce(F.max((kind == "mutate").cast("int")).over(earlier) == 1, F.lit(False)),
            "fresh": has & F.coalesce(F.last(kind, ignorenulls=True).over(earlier) == "read", F.lit(False)),
            "recent_dirs": F.collect_list(F.when(F.col("tool") == "read", F.coalesce("dir", F.lit("")))).over(last_five),
            "spent": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
        }
    ).drop("_reads")


def decide_rules(c: DataFrame) -> DataFrame:
    """The first rule that holds for each call: (session_id, turn, tool, tokens, scoped, rule, outcome)."""
    h = with_history(c)
    same_dir = F.size(F.filter("recent_dirs", lambda x: x == F.col("dir")))
    read, known = F.col("tool") == "read", F.col("file").isNotNull()
    seen = known & F.col("read_turn").isNotNull()
    rules = [
        ("same_read", read & seen & (F.col("strategy") == "full"), "return_cached"),  # what was read is kept as a full read
        ("reread_unchanged", read & seen & ~F.col("hot"), "escalate"),
        ("dir_batching", read & known & (same_dir >= 3), "escalate"),
        ("tiny_file", read & (F.col("tokens") < 200), "allow"),
        ("first_read", read & known & ~seen, "allow"),
        ("large_file_no_budget", read & (F.col("tokens") > 2000) & (F.col("strategy") == "full"), "escalate"),
        ("unscoped_search", (F.col("tool") == "grep") & ~F.col("scoped"), "rewrite"),
        ("no_evidence", mutates() & (F.col("tool") != "bash") & known & ~F.col("fresh"), "inject_before"),
        ("budget_pressure", reads() & (F.col("tokens") > CONTEXT * ZONES["working"] - F.col("spent")), "escalate"),
    ]
    rule, outcome = F.lit("default"), F.lit("allow")
    for name, test, what in reversed(rules):
        rule, outcome = F.when(test, name).otherwise(rule), F.when(test, what).otherwise(outcome)
    return h.select("session_id", "turn", "tool", "file", "tokens", "scoped", "spent", rule.alias("rule"), outcome.alias("outcome"))


def cost_choice(c: DataFrame, weights: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """Alternatives to reads of more than 500 tokens: the cheapest (of equal ones the later), the share it saves and what that means."""
    w = weights or tuple(F.lit(x) for x in BASE_WEIGHTS["exploration"])
    t = F.col("tokens").cast("double")
    cost = lambda size, trips: w[0] * size + w[1] * trips + w[2]
    option = lambda k, how, size, trips: F.struct(cost(size, trips).alias("cost"), F.lit(-k).alias("k"), F.lit(how).alias("how"), size.alias("size"))
    options = F.array(option(0, "outline", F.greatest(F.lit(50.0), t * 0.05), 2), option(1, "read", t / 3, 1), F.when(F.col("scoped"), option(2, "focus", F.lit(400.0), 1)))
    best = F.array_min(F.filter(options, lambda x: x.isNotNull()))
    saved = (cost(t, 1) - best["cost"]) / cost(t, 1)
    left = CONTEXT * ZONES["working"] - F.col("spent")
    pressure = F.when(left < CONTEXT * ZONES["working"] * 0.2, "high").when(left < CONTEXT * ZONES["working"] * 0.5, "medium").otherwise("low")
    big = c.where("tool = 'read' AND tokens > 500")
    return big.select("session_id", "turn", best["how"].alias("choice"), F.round(saved, 6).alias("saved"), F.when(saved > 0.3, "rewrite").when(saved >= 0.1, "escalate").otherwise("allow").alias("outcome"), F.floor(t - best["size"] + 0.5).cast("long").alias("saved_tokens"), left.cast("long").alias("remaining"), pressure.alias("pressure"))


def decide(c: DataFrame) -> DataFrame:
    """Rules, then costs for what rules escalate, then the cheapest alternative: (session_id, turn, tool, rule, action, instead)."""
    ruled = decide_rules(c)
    costs = cost_choice(ruled).select("session_id", "turn", "choice", F.col("outcome").alias("_cost"))
    joined = ruled.join(costs, ["session_id", "turn"], "left")
    escalated = F.col("outcome") == "escalate"
    action = F.when(~escalated, F.col("outcome")).when(F.col("_cost").isin("rewrite", "escalate"), "rewrite").otherwise("allow")
    instead = F.when(F.col("rule") == "unscoped_search", "rank").when(escalated & (action == "rewrite"), F.col("choice"))
    return joined.select("session_id", "turn", "tool", "rule", action.alias("action"), instead.alias("instead"))


def downgrade(decided: DataFrame) -> DataFrame:
    """What each surface does with each action: (surface, action, done, downgrade, n). The surfaces are a fixed handful."""
    counted = decided.groupBy("action").agg(F.count("*").alias("n"))
    surfaces = F.explode(F.array(*[F.struct(F.lit(a).alias("surface"), *[F.lit(x).alias(f"c{i}") for i, x in enumerate(can)]) for a, *can in SURFACES])).alias("s")
    each = counted.select("action", "n", surfaces)
    act = F.col("action")
    lost = F.when((act == "rewrite") & ~F.col("s.c0"), "rewriteToContext").when((act == "return_cached") & ~F.col("s.c1"), "returnCachedToDeny").when((act == "inject_before") & ~F.col("s.c2"), "injectBeforeToWarn")
    done = F.when(lost == "rewriteToContext", "rewrite").when(lost.isNotNull(), "warn").otherwise(act)
    return each.select(F.col("s.surface").alias("surface"), "action", done.alias("done"), lost.alias("downgrade"), "n")


def metrics(c: DataFrame) -> DataFrame:
    """Key figures of each session; ratios over no mutation are infinite."""
    has = F.col("file").isNotNull()
    h = with_history(c).withColumns({"_block": (mutates() & has & ~F.col("fresh")).cast("long"), "_stale": (mutates() & (F.col("tool") != "bash") & has & F.col("read_turn").isNotNull()).cast("int")})
    last = F.max_by(F.when(reads(), 0).otherwise(F.col("_stale")), F.when(reads() | (mutates() & (F.col("tool") != "bash")), F.col("turn")))
    per_file = h.where(has).groupBy("session_id", "file").agg(F.max(reads().cast("int")).alias("r"), F.max(mutates().cast("int")).alias("m"), last.alias("stale"))
    files = per_file.groupBy("session_id").agg(F.sum(((F.col("r") == 1) & (F.col("m") == 0)).cast("long")).alias("wasted_reads"), F.sum(F.coalesce("stale", F.lit(0)).cast("long")).alias("stale_evidence"))
    after = decide(c).withColumn("_next", F.lead("tool").over(in_order())).where("action = 'rewrite' AND _next IS NOT NULL")
    kept = after.groupBy("session_id").agg(F.avg((F.col("instead") == F.col("_next")).cast("double")).alias("acceptance"))
    n_mutate, n_read = F.sum(mutates().cast("long")), F.sum(reads().cast("long"))
    ratio = lambda a, b: F.when(b == 0, F.lit(float("inf"))).otherwise(F.round(a / b, 6))
    base = h.groupBy("session_id").agg(
        F.sum("tokens").alias("total_tokens"), ratio(F.sum("tokens"), n_mutate).alias("tokens_per_mutation"), ratio(n_read, n_mutate).alias("reads_per_mutation"),
        F.when(n_read == 0, 0.0).otherwise(F.round(F.sum((reads() & (F.col("tokens") == 0)).cast("long")) / n_read, 6)).alias("cache_hit_rate"), F.sum("_block").alias("safety_blocks"),
    )
    joined = base.join(files, "session_id", "left").join(kept, "session_id", "left")
    return joined.select(*base.columns, F.coalesce("wasted_reads", F.lit(0)).alias("wasted_reads"), F.coalesce("stale_evidence", F.lit(0)).alias("stale_evidence"), F.round(F.coalesce("acceptance", F.lit(1.0)), 6).alias("acceptance"))


FILE_PATH = r"(?i)(?:^|\s)((?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+\.[a-z]{1,5})(?:\s|$|:|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def classify_intent(text: Column) -> tuple[Column, Column]:
    """(task, confidence): the first pattern a prompt has; else exploration with little confidence."""
    kind, sure = F.lit("exploration"), F.lit(0.3)
    for pattern, name, confidence in reversed(INTENTS):
        hit = text.rlike("(?i)" + pattern)
        kind, sure = F.when(hit, name).otherwise(kind), F.when(hit, confidence).otherwise(sure)
    return kind, sure


def focal_files(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FILE_PATH), F.lit(1))


def detect_drift(task: Column, unique_files: Column, mutations: Column, tools: Column) -> Column:
    """The task that a session's signals show, where they contradict the prompt's. Depth is never escalated in recorded calls."""
    tenths = F.when(unique_files > 8, 3).otherwise(0) + F.when((mutations == 0) & (unique_files > 5), 3).otherwise(0) + F.when(tools > 5, 2).otherwise(0)
    return F.when((mutations >= 2) & ~task.isin("verification", "refactor"), "verification").when(tenths > 5, "exploration").otherwise(task)


def task_weights(task: Column, sequential_reads: Column, share: Column) -> tuple[Column, Column, Column]:
    """Weights of tokens, latency and calls: a task's own, moved by long read streaks and budget pressure, at least 0.05 each, of sum 1."""
    own = [F.element_at(F.create_map(*[x for k, v in BASE_WEIGHTS.items() for x in (F.lit(k), F.lit(v[i]))]), task) for i in range(3)]
    streak, pressed = sequential_reads > 3, share > 0.6
    moved = [F.greatest(F.lit(0.05), w + F.when(streak, a).otherwise(0.0) + F.when(pressed, b).otherwise(0.0)) for w, a, b in zip(own, (-0.1, 0.15, -0.05), (0.2, -0.1, -0.1))]
    total = moved[0] + moved[1] + moved[2]
    return tuple(w / total for w in moved)


def longest_streak(read_calls: Column) -> Column:
    """The longest run of reads among calls (ts, event_id, read), put in order of time here, whatever order brought them."""
    run = lambda s, x: F.when(x["read"], s["run"] + 1).otherwise(F.lit(0).cast("long"))
    folded = F.aggregate(F.sort_array(read_calls), F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("longest")), lambda s, x: F.struct(run(s, x).alias("run"), F.greatest(s["longest"], run(s, x)).alias("longest")))
    return folded["longest"]


def session_stream(events: DataFrame) -> DataFrame:
    """Streaming: per session its running state, in update mode. The state is a row of built-in aggregates, so no session costs a call of
    Python; it holds the session's calls, so an event that comes late takes its place. A session is a user's day: time counts in days, and
    a state goes, and later events of it are left out, once a call of two days after has come. Events without user or time are in no session."""
    day = F.unix_date(F.to_date("ts"))
    tool = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv]), F.col("event_type")), F.lit("bash"))
    size = F.greatest(F.lit(0), F.round(F.coalesce("value", F.lit(0)) * 20 - 200).cast("long"))
    call = F.struct("ts", F.coalesce("event_id", F.lit(2**63 - 1)).alias("event_id"), tool.isin(*READ_TOOLS).alias("read"))
    # The first watermark is 1970, so days count from long before it: no day is late at the start.
    keyed = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", F.timestamp_seconds((day + STREAM_DAYS) * F.lit(86_400).cast("long")).alias("day"), call.alias("call"), size.alias("tokens")).withWatermark("day", "2 days")
    made = keyed.groupBy("user_id", "day").agg(F.count("*").alias("n_calls"), F.sum("tokens").alias("tokens"), F.collect_list("call").alias("calls"))
    date = F.date_from_unix_date((F.unix_seconds("day") / 86_400).cast("int") - STREAM_DAYS)
    return made.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format(date, "yyyy-MM-dd")).alias("session_id"), "n_calls", "tokens", longest_streak(F.col("calls")).alias("longest_streak"))
