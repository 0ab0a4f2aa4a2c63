"""Arguments, replies, payloads and prompts."""

import json

from pyspark.sql import functions as F

from tessera.functions import tools as O


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(*columns).first()


def test_arguments(spark):
    for given, want in (({"file_path": "a"}, {"file_path": "a", "file": "a"}), ({"file_path": "a", "file": "b"}, {"file_path": "a", "file": "b"}), ({"file_path": "a", "file": ""}, {"file_path": "a", "file": "a"}), ({"x": "1"}, {"x": "1"}), ({}, {})):
        assert one(spark, O.normal_args(F.col("m")), m=("map<string,string>", given))[0] == want


def test_replies(spark):
    for reply, want in ((" ALLOW\n", ("allow", None, None)), ("REWRITE: a(k=1, k=2, q='x, y', z)", ("rewrite", "a", {"k": "2", "q": "'x"})), ("REWRITE: a(b", ("allow", None, None)), ("", ("allow", None, None)), (None, ("allow", None, None)), ('REWRITE: r(f="a=b")', ("rewrite", "r", {"f": "a=b"}))):
        assert tuple(one(spark, O.parse_reply(F.col("r")), r=("string", reply))[0]) == want


def test_payloads(spark):
    first = json.dumps({"hook_event_name": "preToolUse", "tool_name": "Edit", "tool_input": {"file_path": "a.ts", "command": "c"}, "prompt": ""})
    second = json.dumps({"event": "Stop", "toolName": "Bash", "toolArgs": json.dumps({"command": "ls", "path": "p"}), "source": "s"})
    assert tuple(one(spark, O.payload(F.col("r"), {"preToolUse": "PreToolUse"}), r=("string", first))[0]) == ("PreToolUse", "Edit", None, "c", "a.ts", None)
    assert tuple(one(spark, O.payload(F.col("r")), r=("string", second))[0]) == ("Stop", "Bash", None, "ls", "p", "s")
    assert tuple(one(spark, O.payload(F.col("r")), r=("string", "no json"))[0]) == (None,) * 6


def test_texts(spark):
    seen = one(spark, O.seen_text(F.col("f")), f=("array<struct<path:string,strategy:string,tokens:int,turn:int>>", [("a", "full", 3, 1), ("b", "partial", 4, 2)]))[0]
    assert seen == "a full (3 tokens, turn 1); b partial (4 tokens, turn 2)" and one(spark, O.seen_text(F.col("f")), f=("array<struct<path:string,strategy:string,tokens:int,turn:int>>", []))[0] == "nothing yet"
    asked = one(spark, O.request_text(F.lit("read"), F.col("a"), F.lit("fix it"), F.lit(seen), F.col("o")), a=("map<string,string>", {"file": "x"}), o=("array<struct<tool:string,args:map<string,string>,tokens:int,cost:double>>", [("outline", {"file": "x"}, 50, 1.5)]))[0]
    assert asked.startswith('Call: read({"file":"x"})\nTask: fix it\n') and '  1. outline({"file":"x"}): about 50 tokens, cost 1.5' in asked
    assert one(spark, O.trim_edges(F.col("l")), l=("array<string>", ["", "a", "", "b", ""]))[0] == ["a", "", "b"] and one(spark, O.trim_edges(F.col("l")), l=("array<string>", ["", ""]))[0] == []
    assert one(spark, O.split_lines(F.col("t")), t=("string", "a \r\n\r\nb\t\n\n"))[0] == ["a", "", "b"] and one(spark, O.split_lines(F.col("t")), t=("string", ""))[0] == []
