"""Column functions on calls of tools, replies and signatures. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

# Endings of files that reads take for code and for Markdown.
CODE_FILE = r"\.(ts|js|tsx|jsx|py|rs|go|java|c|cpp|rb|swift|kt|sh|yaml|yml|json|toml|css|scss)$"
MARKDOWN_FILE = r"\.(md|mdx|markdown)$"
REWRITE = r"^REWRITE:\s*([A-Za-z0-9_]+)\(([^)]*)\)\s*$"


def is_code_file(path: Column) -> Column:
    return path.rlike(CODE_FILE)


def is_markdown_file(path: Column) -> Column:
    return path.rlike(MARKDOWN_FILE)


def replace_all(text: Column, old: Column, new: Column) -> Column:
    """Every occurrence of a literal; an empty one changes nothing."""
    return F.when(old == "", text).otherwise(F.replace(text, old, new))


def split_lines(text: Column) -> Column:
    """Lines without trailing blanks and tabs, and without the blank ones at the end."""
    lines = F.transform(F.split(text, r"\r?\n", -1), lambda x: F.regexp_replace(x, r"[ \t]+$", ""))
    last = F.array_max(F.transform(lines, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return F.slice(lines, F.lit(1), last)


def trim_edges(lines: Column) -> Column:
    """An array of lines without the blank ones at both ends."""
    first = F.array_min(F.transform(lines, lambda x, i: F.when(x != "", i + 1)))
    last = F.array_max(F.transform(lines, lambda x, i: F.when(x != "", i + 1)))
    return F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(lines, first, last - first + 1))


def explicit_return(signature: Column) -> Column:
    """(explicit, is_void, is_promise) of a signature's stated return type."""
    explicit = F.coalesce(signature.rlike(r"\)\s*:\s*[^=]") | signature.rlike(r"->\s*[^=]"), F.lit(False))
    return F.struct(explicit.alias("explicit"), (explicit & signature.rlike(r"(?<![A-Za-z0-9_])void(?![A-Za-z0-9_])")).alias("is_void"), (explicit & signature.rlike(r"(?<![A-Za-z0-9_])Promise\s*<")).alias("is_promise"))


def normal_args(args: Column) -> Column:
    """A map of arguments in which `file` stands for `file_path` where it is missing."""
    path, file = F.try_element_at(args, F.lit("file_path")), F.try_element_at(args, F.lit("file"))
    given = F.coalesce(path, F.lit("")) != ""
    return F.when(given & (F.coalesce(file, F.lit("")) == ""), F.map_concat(F.map_filter(args, lambda k, v: k != "file"), F.create_map(F.lit("file"), path))).otherwise(args)


def parse_reply(reply: Column) -> Column:
    """(outcome, tool, args) of a reply: ALLOW, or REWRITE: tool(key=value, ...); anything else allows. Quotes around values are taken off."""
    text = T.trim_all(reply)
    hit = text.rlike(REWRITE)
    pairs = F.filter(F.split(F.regexp_extract(text, REWRITE, 2), ", "), lambda x: x.contains("="))
    key = lambda x: F.trim(F.substring_index(x, "=", 1))
    value = lambda x: F.regexp_replace(F.trim(F.substring(x, F.locate("=", x) + 1, F.length(x))), r"^\"(.*)\"$|^'(.*)'$", "$1$2")
    distinct = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda a, x: F.concat(F.filter(a, lambda e: e["key"] != key(x)), F.array(F.struct(key(x).alias("key"), value(x).alias("value")))))
    return F.struct(F.when(hit, "rewrite").otherwise("allow").alias("outcome"), F.when(hit, F.regexp_extract(text, REWRITE, 1)).alias("tool"), F.when(hit, F.map_from_entries(distinct)).alias("args"))


def request_text(tool: Column, args: Column, task: Column, seen: Column, alternatives: Column) -> Column:
    """The question for a judge of a call: alternatives are an array of (tool, args, tokens, cost) in order."""
    call = lambda t, a: F.concat(t, F.lit("("), F.to_json(a), F.lit(")"))
    lines = F.transform(alternatives, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), call(x["tool"], x["args"]), F.lit(": about "), x["tokens"].cast("string"), F.lit(" tokens, cost "), x["cost"].cast("string")))
    return F.concat_ws("\n", F.concat(F.lit("Call: "), call(tool, args)), F.concat(F.lit("Task: "), task), F.concat(F.lit("Seen so far: "), seen), F.lit("Alternatives by cost:"), F.array_join(lines, "\n"), F.lit("Answer ALLOW, or REWRITE: tool(key=value, ...)."))


def seen_text(files: Column) -> Column:
    """What a session has read, from an array of (path, strategy, tokens, turn)."""
    parts = F.transform(files, lambda x: F.concat(x["path"], F.lit(" "), x["strategy"], F.lit(" ("), x["tokens"].cast("string"), F.lit(" tokens, turn "), x["turn"].cast("string"), F.lit(")")))
    return F.when(F.size(files) <= 0, "nothing yet").otherwise(F.array_join(parts, "; "))


def payload(raw: Column, aliases: dict[str, str] | None = None) -> Column:
    """(event, tool, prompt, command, path, source) of a hook's JSON, whichever of two spellings of its keys it has; event names by `aliases`."""
    first = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(raw, f"$.{n}"), F.lit("")) for n in names])
    event = first("hook_event_name", "hookEventName", "event")
    if aliases:
        event = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), event), event)
    inner = first("toolArgs", "tool_args")  # arguments as a text of their own
    arg = lambda name: F.coalesce(first(f"tool_input.{name}", f"toolInput.{name}"), F.get_json_object(inner, f"$.{name}"))
    return F.struct(event.alias("event"), first("tool_name", "toolName").alias("tool"), first("prompt", "userPrompt").alias("prompt"), arg("command").alias("command"), F.coalesce(arg("file_path"), arg("path"), arg("file")).alias("path"), first("source").alias("source"))
