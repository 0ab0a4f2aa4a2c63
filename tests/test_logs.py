"""Log entries and folding on small fixtures."""

from datetime import datetime

import pytest

from tessera.operators import log_entries as E
from tessera.operators import log_lines as L

LOG = [
    "Booting scan ...",
    "2025-03-01 10:00:00,123 [pool-1] INFO  org.a.Scan - first one",
    "2025-03-01 10:00:01,000 [pool-2] WARN  org.a.Walk - cache miss for x:y",
    "java.lang.IllegalStateException: bad",
    "\tat org.a.Walk.run(Walk.java:10)",
    None,
    "Mar  1 10:00:02 node-01 walker[77]: GET /v1/x 200 3ms",
    "Mar  1 10:00:03 node-02 planner[78]: worker 3 joined",
    '{"level":50,"time":1740823204500,"name":"cache","msg":"say \\"hi\\"","turn":3}',
    "{",
    '  "severity": "WARNING",',
    '  "message": "spread out",',
    '  "logger": "hooks",',
    '  "timestamp": "2025-03-01T12:00:05.250+02:00"',
    "}",
    "{",
    '  "dump": "no message",',
    '  "time": "2025-03-01T12:00:05.250Z"',
    "}",
    'level=error time="2025-03-01T05:00:06.999-05:00" msg="rule \\"a\\" fired" component="rules"',
    "I0301 10:00:07.123456 123 pruner.go:55] dropping x",
    "W0301 10:00:08.123456 123 walker.go:56] slow query: 3s [y]",
    "\x1b[2m2025-03-01T10:00:09.5Z\x1b[0m \x1b[33m WARN\x1b[0m \x1b[1mcache\x1b[0m: limit is 3",
    "2025-03-01T10:00:10.5Z  INFO hooks: GET /x",
    "INFO:core.main:no time here",
    "ERROR:core.main:retry 2 of 3",
    "  > 2025-03-01T10:00:10.5Z INFO [quoted] not an entry",
]


def rows(spark, lines, log="l", start=1):
    return [(log, i, t, 1) for i, t in enumerate(lines, start)]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame([("l", datetime(2025, 3, 1)), ("l", datetime(2025, 3, 1)), ("big", None)], "log_id string, started_at timestamp_ntz")


SCHEMA = "log_id string, line_no int, text string, block int"  # an extra column whose name the operator uses itself


def parsed(spark, data, logs, **kw):
    return {r.line_no: tuple(r)[2:] for r in E.parse_entries(spark.createDataFrame(data, SCHEMA), logs, **kw).collect()}


def test_entries(spark, logs):
    data = rows(spark, LOG)
    got = parsed(spark, data + data[:9], logs)  # redelivered rows count once
    assert sorted(got) == [2, 3, 7, 8, 9, 10, 20, 21, 22, 23, 24, 25, 26]
    assert got[2] == (1, 1740823200123, "INFO", "org.a.Scan", "first one")
    assert got[3][0] == 4
    assert got[7] == (1, 1740823202000, "", "walker", "GET /v1/x 200 3ms")
    assert got[9] == (1, 1740823204500, "ERROR", "cache", 'say "hi"')
    assert got[10] == (10, 1740823205250, "WARN", "hooks", "spread out")
    assert got[20] == (1, 1740823206999, "ERROR", "rules", 'rule "a" fired')
    assert got[21][1:] == (1740823207123, "INFO", "pruner.go", "dropping x")
    assert got[23][1:] == (1740823209500, "WARN", "cache", "limit is 3")
    assert got[26] == (2, -1, "ERROR", "core.main", "retry 2 of 3")


def test_blocks_do_not_change_entries(spark, logs):
    data = rows(spark, LOG * 6)
    assert parsed(spark, data, logs, block_lines=16) == parsed(spark, data, logs) != {}


def test_long_tail_goes_to_the_last_entry_of_a_block(spark, logs):
    lines = [LOG[1], LOG[2]] + ["\tat x"] * 100 + [LOG[1].replace("first", "next")]
    got = parsed(spark, rows(spark, lines), logs, block_lines=8)
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 101, 103: 1}


def test_objects_longer_than_blocks(spark, logs):
    """An object printed over 5,000 lines is one entry; one that never closes, or states no message, gives its lines to the entry before it."""
    entry = "2025-03-01 10:00:00,123 [pool-1] INFO  org.a.Scan - "
    long_ = lambda *fields: ["{", *[f'  "k{k}": {k},' for k in range(5_000)], *fields, "}"]
    data = [entry + "one", "x", *long_('  "level": "warn",', '  "msg": "long"'), "tail", entry + "two", *long_('  "level": "warn"'), entry + "three", "{", *["  y"] * 3_000, entry + "four", "{", *["  z"] * 700]
    got = {}
    for size in (8192, 64, 500):
        got[size] = parsed(spark, rows(spark, data), logs, block_lines=size, together=3)
    assert got[8192] == got[64] == got[500]
    assert [(v[0], v[2], v[4]) for _, v in sorted(got[64].items())] == [(2, "INFO", "one"), (5_005, "WARN", "long"), (5_004, "INFO", "two"), (3_002, "INFO", "three"), (702, "INFO", "four")]


def test_templates_do_not_depend_on_order():
    import random

    made = [f"2025-03-01 10:00:0{k % 10},123 [pool-{k}] INFO  org.a.B{k} - did {' '.join(['x'] * (k % 7))} {k}" for k in range(90)] + [f"INFO:core.main: {k} of {k}" for k in range(50)] + [f"2025-03-01T10:00:10.5Z host{k % 3} a.b: said {k}" for k in range(70)]
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(made)
        miner = E.Miner()
        for line in made:
            miner.add(line)
        seen.add(tuple(sorted((E.classify(t) or "", n) for t, n, _ in miner.templates())))
    assert len(seen) == 1
    a, b = tuple("ab" * 300), tuple("abb" * 200)
    assert sum(x != E.GAP for x in E.common(a, b)) == brute_lcs(a, b)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_roles_need_the_type():
    mined = [(("field", "time", "T"), 9), (("field", "time", "S"), 1), (("field", "t", "S"), 7), (("field", "level", "L"), 3), (("field", "msg", "S"), 3), (("field", "source", "9"), 5)]
    roles = E.roles_of(mined)
    assert roles["ts"][:1] == ("ts",) and "time" in roles["ts"] and "t" not in roles["ts"] and "source" not in roles["component"]


def test_nothing_and_nulls(spark, logs):
    assert parsed(spark, [], logs) == {}
    assert parsed(spark, [("l", 1, None, 0), ("l", None, LOG[1], 0), (None, 2, "", None)], logs) == {}
    assert parsed(spark, rows(spark, LOG, log="big"), logs)[7][1] == -1  # no year is known


def test_times():
    assert E.parse_time("2025-02-30T00:00:00Z", None) == -1
    assert E.parse_time("1740823204500", None) == 1740823204500
    assert E.parse_time("Mar  1 10:00:02", None) == -1
    assert E.parse_time("02/Feb/2025:17:23:35 -0700", None) == 1738542215000


def test_templates_keep_headers_and_open_messages():
    miner = E.Miner()
    for text in ("alpha beta", "GET /x 3", "12 things", "one: two"):
        miner.add(f"2025-03-01T10:00:10.5Z INFO [core] {text}")
    (template, n, _), *_ = miner.templates()
    assert n == 4 and E.GAP in template and E.classify(template).count("(?P<") == 4


def test_prune_folds_and_never_grows():
    stack = ["Error: a went wrong here", "  at f (src/a.ts:1:2)", "  at g (src/b.ts:3:4)"]
    lines = ["\x1b[31mok\x1b[0m", *[f"Downloading part {k}%" for k in range(9)], *["the same line once more 1"] * 9, "", "", *["DEBUG one two three four"] * 4, *stack, *stack]
    out, rules = L.prune(lines)
    assert "[progress: 8 lines collapsed]" in out and "[stack repeated 1x]" in out and {"progress-fold", "debug-fold", "stack-dedup", "repeat-fold"} <= set(rules)
    assert L.prune(["a"]) == (["a"], [])
    out, _ = L.prune(["x", "begin", "1", "2", "end", "y"], rules=[{"type": "block", "start": "begin", "end": "end", "label": "part"}])
    assert out == ["x", "[part: 4 lines folded]", "y"]


def test_islands_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    lines = ["a 1"] * 3 + ["b"] + ["c 1", "c 2", "c 3", "c 4", "c 5", "c 6"] + ["d"]
    df = spark.createDataFrame([("l", i, t) for i, t in enumerate(lines, 1)], "log_id string, line_no int, text string")
    got = sorted((r.line_no, r.part, r.text) for r in L.fold_repeats(df).collect())
    assert got == [(1, 0, "a 1"), (1, 1, "[repeated 2x]"), (4, 0, "b"), (5, 0, "c 1"), (5, 1, "[repeated 5x]"), (11, 0, "d")]


def test_rules_on_tables_and_in_the_chain_agree(spark, monkeypatch):
    """Each rule as a DataFrame, with blocks of four lines and sums over two blocks, against the sequential one."""
    import random

    monkeypatch.setattr(L, "BLOCK", 4)
    monkeypatch.setattr(L, "TOGETHER", 2)
    random.seed(9)
    some = ["", "", "plain 1", "plain 2", "./a.ts lint x", "./b.ts format y", "  × one", "  × two", "at 5%x", "at 6%x", "src/a.ts(1,2): error TS1: q", "src/b.ts(3,4): error TS2: r", "m.py:3: error: s", "some longer line 7", "some longer line 8"]
    logs = {f"l{k}": [random.choice(some) for _ in range(random.randrange(1, 60))] for k in range(12)}
    df = spark.createDataFrame([(log, i, t) for log, lines in logs.items() for i, t in enumerate(lines, 1)], "log_id string, line_no int, text string")
    clean = L.clean_lines(df)
    for made, chain in (
        (L.fold_repeats(df), lambda x: L.fold_equal(x, L.Lines())),
        (L.fold_progress(df), L.progress_folded),
        (L.fold_lint(clean), L.fold_linted),
        (L.fold_types(clean), L.fold_typed),
        (L.collapse_blanks(df), L.one_blank),
        (L.fold_global_repeats(clean), lambda x: L.fold_often(x, [L.normal(y) for y in x])),
    ):
        got = {log: [] for log in logs}
        for r in sorted(made.collect(), key=lambda r: (r.log_id, r.line_no, r.part)):
            got[r.log_id].append(r.text)
        assert got == {log: list(chain(L.Lines(lines))) for log, lines in logs.items()}


def test_stacks():
    block = ["Error: bad 1", "  at a (b.ts:1:2)"]
    same = ["Error: bad 2", "  at a (b.ts:3:4)"]
    assert list(L.fold_stacks(["x", *block, "", *same, *block, "", "y", "", "z"])) == ["x", *block, "[stack repeated 2x]", "y", "", "z"]
    assert list(L.fold_stacks([*block, "", "Error: other", *same])) == [*block, "Error: other", *same]


def test_prune_takes_a_log_as_a_whole(spark):
    lines = [t for k in range(12) for t in (f"once in a piece of the log {k}", f"a {'x' * (k + 1)} other", "step 5%", "step 6%")]
    df = spark.createDataFrame([("l", i, t) for i, t in enumerate(lines, 1)], "log_id string, line_no int, text string")
    logs = spark.createDataFrame([("l", None, None, None)], "log_id string, profile string, strip_timestamps string, dedupe_stack_traces boolean")
    want, rules = L.prune(lines)
    assert want[-1] == "[global repeats folded: 22]" and "global-repeat-fold" in rules
    for piece in (4, 5_000):
        got = sorted(L.prune_logs(df, logs, piece).collect(), key=lambda r: r.piece)
        assert "\n".join(r.text for r in got).split("\n") == want
        assert {(r.n_lines, r.n_kept, tuple(r.rules)) for r in got} == {(48, len(want), tuple(rules))}


def test_long_logs_are_folded_alike(spark, monkeypatch):
    """The rules as tables, with blocks of 16 lines, give what one task gives, for every profile and with custom rules."""
    import random

    monkeypatch.setattr(L, "BLOCK", 16)
    monkeypatch.setattr(L, "TOGETHER", 2)
    random.seed(4)
    some = ["", "", "plain 1 text", "plain 2 text", "Downloading a 5%", "Downloading a 6%", "DEBUG x", "GET /health 200", '{"level":"warn"}', "Starting up", "=======", '1 "Mozilla/5.0 x"', "✓ a", "(pass) b", "✗ c", "./a.ts lint x", "  × one", "src/a.ts(1,2): error TS1: q", "Error: bad 1", "  at a 1", "  at a 2", "a longer line of words 7", "a longer line of words 8", "begin", "end", "begin end"]
    logs = {f"l{k}": [random.choice(some) for _ in range(random.randrange(1, 90))] for k in range(10)}
    stamped = [f"2025-03-01T10:00:0{k % 9}.5Z {w}" for k, w in enumerate(random.choices(some[2:9], k=30))]
    logs |= {"stamped": stamped, "blank": ["", "", ""], "stacks": ["Error: a", " at 1", "", "Error: a", " at 2", "", "", "Error: a", " at 3", "x"]}
    profiles = dict(zip(logs, ["test", "ci", "lint", "runtime", None, "RUNTIME", "", "ci", "test", "lint", "runtime", None, None]))
    df = spark.createDataFrame([(log, i, t) for log, lines in logs.items() for i, t in enumerate(lines, 1)], "log_id string, line_no int, text string")
    options = spark.createDataFrame([(log, profiles[log], "keep" if log == "l3" else None, log != "l4") for log in logs if log != "l6"], "log_id string, profile string, strip_timestamps string, dedupe_stack_traces boolean")
    rules = [{"type": "block", "start": "^begin", "end": "end$", "label": "part"}, {"type": "fold", "pattern": "^plain"}]
    columns = ["log_id", "piece", "n_lines", "n_kept", "tokens", "tokens_kept", "text"]
    get = lambda whole: {tuple(r[c] for c in columns): [x for x in r.rules] for r in L.prune_logs(df, options, 50, rules, whole_lines=whole).collect()}
    short, long_ = get(10_000), get(0)
    assert sorted(map(str, short)) == sorted(map(str, long_))
    assert {k: [x for x in v if x != "user-agent-strip"] for k, v in short.items()} == {k: [x for x in v if x != "user-agent-strip"] for k, v in long_.items()}


def test_prune_json_tests_lint_and_types(spark):
    made = ['{"level":"error", "m": 1}', '{"severity":"WARN"}', '{"level":null, "severity": "info"}', '{"level": 30}', "{not json}", '{"level":"trace"}']
    assert L.prune(made) == (["[json lines folded: 6 (error:1, warn:1, info:1, debug:0, other:3)]"], ["json-line-fold"])
    assert L.prune(made, "lint")[0] == made and L.prune(made[1:])[0] == made[1:]
    tests = [*[f"✓ case {chr(97 + k)} does it" for k in range(6)], "tests/a.test.ts:", "not a test line"]
    assert L.prune(tests) == (["[tests pruned: 6 passing stripped, 0 failing kept]", "not a test line", "[all tests passed]"], ["test-runner-elision"])
    out, _ = L.prune([*tests, "✗ case z breaks"])
    assert out == ["[tests pruned: 6 passing stripped, 1 failing kept]", "tests/a.test.ts:", "not a test line", "✗ case z breaks"]
    lint = ["./src/a.ts lint ━━", "", "  × one", "./src/b.ts format ━━", "  × two of it", "  × three", "  some more text here", "", "end"]
    assert L.prune(lint) == (["[diagnostic block 1] ./src/a.ts lint ━━", "", "  × one", "[diagnostic block 2] ./src/b.ts format ━━", "  × two of it", "", "end"], ["linter-fold"])
    types = [f"src/deep/er/a.tsx({k},{k}): error TS2322: Type {c * 3} is not what was asked for here" for k, c in enumerate("abcdefg", 1)]
    out, rules = L.prune([types[0], "between", *types[1:], "lib/m.py:3: error: bad"])
    assert rules == ["typecheck-fold"] and out == ["between", "[typecheck] src/deep/er/a.tsx: 7 errors", *types[:3], "[typecheck] 4 more errors folded", "[typecheck] lib/m.py: 1 errors", "lib/m.py:3: error: bad"]


def test_prune_strips_timestamps(spark):
    lines = [f"2025-03-01T10:00:0{k}.5Z {w} and so on and on" for k, w in enumerate(("one", "two", "two", "six"))]
    tail = ["plain", "lines"]
    bare = ["[timestamps stripped: iso]", "one and so on and on", "two and so on and on", "[repeated 1x]", "six and so on and on"]
    assert L.prune(lines) == (bare, ["timestamp-strip:iso", "repeat-fold"])
    assert L.prune(lines + tail, stamps="auto")[0][0] == lines[0]
    assert L.prune(lines + tail, stamps="auto", profile="runtime")[0][0] == lines[0]
    assert L.prune(lines + tail, profile="runtime")[0] == bare + tail
    df = spark.createDataFrame([(log, i, t) for log in ("keep", "auto") for i, t in enumerate(lines, 1)], "log_id string, line_no int, text string")
    logs = spark.createDataFrame([("keep", "RUNTIME", "Keep", None), ("auto", None, None, None)], "log_id string, profile string, strip_timestamps string, dedupe_stack_traces boolean")
    got = {r.log_id: r.text.split("\n") for r in L.prune_logs(df, logs).collect()}
    assert got["auto"] == bare and got["keep"][0] == lines[0]
