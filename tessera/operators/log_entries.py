"""Problem 5: log lines of many programs into entries with timestamp, level, component and message.

1. Mining. Each unindented line is tokenised into a shape: timestamps, levels, names, numbers, quoted strings and punctuation;
   objects and key=value lines into the row of their keys with the type of each value. Shapes whose leads (what stands before the
   free text) have a longest common subsequence as long as both form a cluster; the common subsequence of its members leaves
   constant tokens and variable slots. Partitions' templates are merged, and as a template's header is what all its members
   begin with, neither order nor partitions change it.
2. Slots are classified by type into timestamp, level, component and message, and each template becomes a pattern. A key of
   objects and key=value lines takes a role if its name proposes it and most of its values have the role's type.
3. Parsing. Lines go to blocks of consecutive line numbers, so that a log of any length spreads over many tasks; a block
   also sees the first LOOK_AHEAD lines of the next one. An object that goes on behind them is an open entry, which a second,
   keyed reading of just its lines completes. What an entry at a block's end continues into is added up afterwards
   from one row a block, by blocks of blocks, so that no task holds all blocks of a log.

Defined results: null and blank lines are continuation lines; repeated (log_id, line_no) count once (their contents are equal;
if not, the smallest text is taken); lines before a log's first entry belong to none; indented lines, quoted entries, stacks
and objects without a message never open an entry; null log_id forms a log of its own; ts_ms is -1 without a time or if the year is
missing and the log has no started_at; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import lru_cache

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sizes import broadcast_if_small

BLOCK_LINES = 8192
LOOK_AHEAD = 128
BLOCKS_TOGETHER = 4096  # blocks whose ends one task adds up

MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
LEVELS = {
    "trace": "TRACE", "trc": "TRACE", "finest": "TRACE", "verbose": "TRACE",
    "debug": "DEBUG", "dbg": "DEBUG", "debu": "DEBUG", "fine": "DEBUG",
    "info": "INFO", "inf": "INFO", "information": "INFO", "notice": "INFO",
    "warn": "WARN", "warning": "WARN", "wrn": "WARN", "war": "WARN",
    "error": "ERROR", "err": "ERROR", "erro": "ERROR", "severe": "ERROR",
    "fatal": "FATAL", "critical": "FATAL", "crit": "FATAL", "panic": "FATAL", "emerg": "FATAL",
    "10": "TRACE", "20": "DEBUG", "30": "INFO", "40": "WARN", "50": "ERROR", "60": "FATAL",
    "i": "INFO", "w": "WARN", "e": "ERROR", "f": "FATAL", "d": "DEBUG", "t": "TRACE",
}
MONTH = "(?:" + "|".join(MONTHS) + ")"
STAMPS = {
    "iso": r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?",
    "apache": rf"\d\d/{MONTH}/\d{{4}}:\d\d:\d\d:\d\d(?:\.\d+)?(?: [+-]\d{{4}})?",
    "dashed": rf"\d\d-{MONTH}-\d{{4}} \d\d:\d\d:\d\d(?:[.,]\d+)?",
    "bsd": rf"{MONTH} [ \d]\d \d\d:\d\d:\d\d(?:\.\d+)?",
    "epoch": r"\b1\d{12}\b|\b1\d{9}(?:\.\d+)?\b",
}
ANY_STAMP = "|".join(f"(?:{p})" for p in STAMPS.values())
GLOG = r"^[IWEFDT]\d{4} \d\d:\d\d:\d\d\.\d+"
LEVEL_WORD = r"\b(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|WAR|WRN|INF|DBG|TRC|ERROR|ERR|ERRO|SEVERE|FATAL|CRITICAL|CRIT|PANIC)\b"
COLOUR = r"\x1b\[[0-9;?]*[A-Za-z]|\x1b\][^\x07]*\x07"
ANSI = re.compile(COLOUR)
KEYS = {
    "ts": ("ts", "time", "timestamp", "@timestamp", "datetime", "t", "date"),
    "level": ("level", "severity", "lvl", "loglevel", "levelname"),
    "component": ("component", "logger", "name", "module", "service", "subsystem", "source"),
    "msg": ("msg", "message", "event", "text"),
}

# --- shapes and templates ------------------------------------------------------------------------------------------------
# In a shape: T timestamp, K level letter and timestamp in one, L level, w name, h name with a number, 9 number, S quoted string.


SHAPE_STEPS = [
    (re.compile(p), r)
    for p, r in (
        (r'"(?:[^"\\]|\\.)*"', "\x01S"),
        (GLOG, "\x01K"),
        (ANY_STAMP, "\x01T"),
        ("(?i)" + LEVEL_WORD, "\x01L"),
        (r"(?<![\x01\w])[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*-\d+\b", "\x01h"),
        (r"(?<![\x01\w])[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", "\x01w"),
        (r"(?<![\x01\w])\d+\w*", "\x019"),
        (r"[ \t]+", " "),
    )
]


def shape_of(line: str) -> str:
    """The shape of a line without colours and trailing white space."""
    for pattern, mark in SHAPE_STEPS:
        line = pattern.sub(mark, line)
    return line


SHAPE_TOKEN = re.compile("\x01[TKLwh9S]|.", re.S)


def tokens(shape: str) -> tuple[str, ...]:
    return tuple(t[-1] if t[0] == "\x01" else "'" + t for t in SHAPE_TOKEN.findall(shape))


GAP = "*"


def common(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """Longest common subsequence of two templates, with a gap wherever either has something else. Bit-parallel over a; an equal start is
    taken as it is, so the head of a cluster's template is what all members begin with, in whatever order they came."""
    if a == b:
        return a
    same = 0
    for x, y in zip(a, b):
        if x != y or x == GAP:
            break
        same += 1
    start, a, b = a[:same], a[same:], b[same:]
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        if x != GAP:
            where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows, v = [], full
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j, kept = len(a), len(b), []
    while i and j:  # back along the alignment
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                kept.append((i, j))
    out, at, bt = list(start), 0, 0
    for i, j in reversed(kept):
        if i > at or j > bt:
            out.append(GAP)
        out.append(a[i])
        at, bt = i + 1, j + 1
    if at < len(a) or bt < len(b):
        out.append(GAP)
    return tuple(x for k, x in enumerate(out) if x != GAP or not k or out[k - 1] != GAP)


def head(template: tuple[str, ...]) -> tuple[str, ...]:
    """The part before the first gap: constant tokens and typed slots that all members share from the start of the line."""
    return template[: template.index(GAP)] if GAP in template else template


def opens_entry(toks: tuple[str, ...]) -> bool:
    """A header states a time or a level before any free text."""
    for t in toks:
        if t in "TKL":
            return True
        if t in "wS" or t == "'{":
            return False
    return False


SEPARATORS = (("']", "' "), ("':", "' "), ("' ", "'-", "' "), ("' ", "'|", "' "), ("':",))


def lead_of(toks: tuple[str, ...]) -> tuple[str, ...]:
    """The shortest start of a shape, up to a separator, in which a name follows or precedes what can be a time and a level: two
    shapes are compared only if these agree."""
    level_at = next((i for i, t in enumerate(toks) if t in "LK"), None)
    end = None
    for i in range(len(toks)):
        for sep in SEPARATORS:
            if toks[i : i + len(sep)] == sep:
                before = toks[:i]
                named = [k for k, t in enumerate(before) if t == "w"]
                timed = any(t in "TK" for t in before) or (before and before[0] == "L")
                # a level counts as the header's if it stands before the name or right after it, between separators
                if named and timed:
                    rest = toks[i + len(sep) :]
                    if not any(t in "LK" for t in before) and sep[-1] == "' " and rest[:1] == ("L",) and rest[1:4] in (("' ", "'-", "' "), ("' ", "'|", "' ")):
                        continue
                    if named[-1] > (level_at if level_at is not None and level_at < i else -1) or any(t == "L" for t in before[named[-1] :]):
                        end = i + len(sep)
                        break
        if end:
            break
    return toks[:end] if end else toks[:1]


def header_of(template: tuple[str, ...]) -> tuple[str, ...]:
    """What all members of a cluster share from the start of the line, up to its last separator; free text begins after it."""
    shared = head(template)
    if GAP in template:
        for i in range(len(shared), 2, -1):
            if shared[i - 1] == "':" or (shared[i - 1] == "' " and shared[i - 2] in ("']", "':", "'-", "'|")):
                return shared[:i]
    return ()


def classify(template: tuple[str, ...], strict: bool = False) -> str | None:
    """A pattern with the groups ts, glog, level, component and msg for a template; None if it states neither time nor level and
    name. Slots by type: the first timestamp, the first level, the last name of the header; what follows is the message.
    strict: a pattern that only lines of the same shape match, if the levels it finds are such and its names aren't (see Miner)."""
    name, number = (r"([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)(?![\w-]|\.[A-Za-z_])", rf"(?!{ANY_STAMP})\d+\w*") if strict else (r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", r"\d+\w*")
    lead = lead_of(template)
    if len(lead) < 3 or len(head(template)) < len(lead) or not opens_entry(template):
        return None
    lead = max(lead, header_of(template), key=len)
    names = [i for i, t in enumerate(lead) if t == "w"]
    if not names:
        return None
    out, seen = [], set()
    for i, t in enumerate(lead):
        if t == "T":
            out.append(f"(?P<ts>{ANY_STAMP})" if "ts" not in seen else f"(?:{ANY_STAMP})")
            seen.add("ts")
        elif t == "K":
            out.append(r"(?P<glog>[IWEFDT]\d{4} \d\d:\d\d:\d\d\.\d+)")
        elif t == "L":
            out.append("(?P<level>[A-Za-z]+)" if "level" not in seen else "(?P<other>[A-Za-z]+)" if strict and "other" not in seen else "[A-Za-z]+")
            seen.add("other" if "level" in seen else "level")
        elif t == "w":
            out.append(f"(?P<component>{name})" if i == names[-1] else name)
        elif t == "h":
            out.append(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*-\d+")
        elif t == "9":
            out.append(number)
        elif t == "S":
            out.append(r'"(?:[^"\\]|\\.)*"')
        else:
            out.append(r"[ \t]+" if t[1] in " \t" else re.escape(t[1]))
    text = "".join(out)
    return (text.removesuffix(r"[ \t]+") + r"[ \t]*" if text.endswith(r"[ \t]+") else text) + r"(?P<msg>.*)"


SETTLED = 4  # shapes after which lines are first tried against a template's own pattern
SHAPES_HELD = 50_000  # shapes a miner remembers to count repeats by; their counts are added up when it is full
KEYED = re.compile(r"[a-z][\w.@-]*=\S")
LOGFMT = re.compile(r'([\w.@-]+)=("(?:[^"\\]|\\.)*"|\S*)(?:\s+|$)')
FIELD = "field"  # marks templates of objects and key=value lines


def fields_of(line: str) -> dict | None:
    """The named fields of an object in one line or of a key=value line."""
    if line[:1] == "{":
        try:
            fields = json.loads(line)
        except ValueError:
            return None
        return fields if isinstance(fields, dict) else None
    if not KEYED.match(line):
        return None
    pairs = LOGFMT.findall(line)
    if len(pairs) < 2 or not line.startswith(pairs[0][0] + "="):
        return None
    fields: dict = {}
    for key, value in pairs:
        if value[:1] == '"':
            try:
                value = json.loads(value)
            except ValueError:
                value = value[1:-1]
        fields.setdefault(key, value)
    return fields


def type_of(value) -> str:
    """T time, L level, w name, S text, 9 number, ? anything else."""
    if value is None or isinstance(value, (dict, list, bool)):
        return "?"
    text = str(value)
    if text.lower() in LEVELS:
        return "L"
    if (text[:1].isdigit() or text[:3] in MONTHS) and parse_time(text, 2000) != -1:
        return "T"
    if isinstance(value, (int, float)):
        return "9"
    return "w" if NAME.match(text) else "S"


NAME = re.compile(r"[A-Za-z_][\w./:-]*\Z")


LEVEL_WORDS = frozenset(LEVEL_WORD.split("(?:")[1].split(")")[0].lower().split("|"))


class Miner:
    """Templates of a stream of lines: [common subsequence, lines, shapes] by lead. A line that matches the strict pattern of a settled
    template has its header, so that merging it could not change what is read from the template; it is only counted."""

    def __init__(self) -> None:
        self.shapes: dict[str, int] = defaultdict(int)
        self.made: dict[tuple, list] = {}
        self.settled: list[list] = []

    def add(self, line: str) -> None:
        settled = self.settled
        for i, entry in enumerate(settled):
            m = entry[0](line)
            if m and all((x.lower() in LEVEL_WORDS) == (k in entry[2]) for k, x in enumerate(m.groups(), 1) if k in entry[3]):
                entry[1][1] += 1
                if i > 2:
                    settled.insert(0, settled.pop(i))
                return
        if (line[0] == "{" or KEYED.match(line)) and (fields := fields_of(line)):
            for key, value in fields.items():
                known = self.made.setdefault((FIELD, key, type_of(value)), [(FIELD, key, type_of(value)), 0, 0])
                known[1] += 1
            return
        shape = shape_of(line)
        if shape in self.shapes:
            self.shapes[shape] += 1
            return
        if len(self.shapes) >= SHAPES_HELD:
            self.add_repeats()
        self.shapes[shape] = 1
        toks = tokens(shape)
        if opens_entry(toks):
            self.merge(toks, 1, 1)

    def merge(self, toks: tuple[str, ...], lines: int, kinds: int) -> None:
        lead = lead_of(toks)  # leads whose common subsequence is as long as both are equal
        known = self.made.setdefault(lead, [toks, 0, 0])
        before = known[0]
        known[0] = common(known[0], toks) if known[1] else toks
        known[1] += lines
        known[2] += kinds
        if known[2] >= SETTLED and (known[2] == SETTLED or known[0] != before) and (pattern := classify(known[0], strict=True)) and all(pattern != e[4] for e in self.settled):
            self.settled = [e for e in self.settled if e[1] is not known]  # lines of the longer header have the shorter one too
            made = re.compile(pattern, re.S)
            levels = {made.groupindex[g] for g in ("level", "other") if g in made.groupindex}
            rest = {made.groupindex[g] for g in ("ts", "glog", "msg", "component") if g in made.groupindex}  # component holds a name's own group
            self.settled.append([made.match, known, levels, set(range(1, made.groups + 1)) - rest, pattern])

    def add_repeats(self) -> None:
        for shape, n in self.shapes.items():  # repeats of shapes that were counted by shape
            if n > 1 and (known := self.made.get(lead_of(tokens(shape)))):
                known[1] += n - 1
        self.shapes.clear()

    def templates(self) -> list[tuple[tuple[str, ...], int, int]]:
        """(template, lines, shapes)"""
        self.add_repeats()
        return [tuple(x) for x in self.made.values()]


def mine_templates(lines: DataFrame, text_col: str = "text") -> list[tuple[tuple[str, ...], int]]:
    """Templates of all unindented lines with the number of lines of each, most frequent first; for objects and key=value lines
    (FIELD, key, type of value) with the number of values."""
    opening = lines.where(F.col(text_col).rlike(r"^[^\s}]")).select(text_col)

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        miner = Miner()
        for batch in batches:
            for line in batch.column(0).to_pylist():
                line = (ANSI.sub("", line) if "\x1b" in line else line).rstrip()
                if line and line != "{":
                    miner.add(line)
        made = miner.templates()
        yield pa.RecordBatch.from_arrays(
            [pa.array(["\x02".join(t[0]) for t in made], pa.string()), pa.array([t[1] for t in made], pa.int64()), pa.array([t[2] for t in made], pa.int64())],
            names=["template", "n", "kinds"],
        )

    # equal templates of different partitions are added up in Spark; what comes to the driver grows with the layouts only
    parts = opening.mapInArrow(per_partition, "template string, n long, kinds long").groupBy("template").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect()
    merged, fields = Miner(), []
    for r in sorted(parts, key=lambda r: (-r.n, r.template)):
        toks = tuple(r.template.split("\x02"))
        if toks[0] == FIELD:
            fields.append((toks, r.n))
        else:
            merged.merge(toks, r.n, 0)
    return sorted([*((t, n) for t, n, _ in merged.templates()), *fields], key=lambda x: (-x[1], x[0]))


TYPES = {"ts": "T9", "level": "L", "component": "wSL", "msg": "SwL9T"}


def roles_of(templates: list[tuple[tuple[str, ...], int]]) -> dict[str, tuple[str, ...]]:
    """The keys of each role, in the order of preference: those whose name proposes it and most of whose values have its types."""
    values: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for t, n in templates:
        if t[0] == FIELD:
            values[t[1]][t[2]] += n
    fits = lambda key, role: 2 * sum(n for kind, n in values[key].items() if kind in TYPES[role]) >= sum(n for kind, n in values[key].items() if kind != "?")
    return {role: tuple(k for k in keys if fits(k, role)) for role, keys in KEYS.items()}


# --- times ---------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=20_000)
def day_ms(year: int, month: int, day: int) -> int | None:
    try:
        return int(datetime(year, month, day, tzinfo=timezone.utc).timestamp()) * 1000
    except ValueError:
        return None


def zone_ms(zone: str) -> int:
    if not zone or zone == "Z":
        return 0
    digits = zone[1:].replace(":", "")
    ms = (int(digits[:2]) * 60 + int(digits[2:4] or 0)) * 60_000
    return -ms if zone[0] == "-" else ms


TIME = re.compile(r"(?:(\d{4})-(\d\d)-(\d\d)[T ]|(\d\d)[/-]([A-Z][a-z]{2})[/-](\d{4})[: ]|([A-Z][a-z]{2}) ([ \d]\d) )(\d\d):(\d\d):(\d\d)(?:[.,](\d+))? ?(Z|[+-]\d\d:?\d\d)?$")


def parse_time(text: str, year: int | None) -> int:
    """Milliseconds since 1970, cut off; -1 if it isn't a time or its year isn't known."""
    m = TIME.match(text)
    if not m:
        try:
            value = float(text)
        except ValueError:
            return -1
        return int(text) if text.isdigit() and value >= 1e11 else int(value * 1000) if 1e8 <= value < 1e11 else -1
    y, mo, d, d2, mon, y2, mon3, d3, hh, mm, ss, frac, zone = m.groups()
    if y:
        base = day_ms(int(y), int(mo), int(d))
    elif d2:
        base = day_ms(int(y2), MONTHS.get(mon, 0), int(d2))
    else:
        base = day_ms(year, MONTHS.get(mon3, 0), int(d3)) if year else None
    if base is None:
        return -1
    return base + ((int(hh) * 60 + int(mm)) * 60 + int(ss)) * 1000 + (int((frac + "00")[:3]) if frac else 0) - (zone_ms(zone) if zone else 0)


# --- parsing -------------------------------------------------------------------------------------------------------------

Entry = tuple[int, str, str, str]


def pick(fields: dict, keys: tuple[str, ...]):
    for key in keys:
        if key in fields and fields[key] is not None and not isinstance(fields[key], (dict, list)):
            return fields[key]
    return None


def from_fields(fields: dict, year: int | None, roles: dict[str, tuple[str, ...]] = KEYS) -> Entry | None:
    """An entry from named fields; without a message, or with neither time nor level, it is no entry."""
    msg = pick(fields, roles["msg"])
    stamp, level = pick(fields, roles["ts"]), pick(fields, roles["level"])
    if msg is None or (stamp is None and level is None):
        return None
    component = pick(fields, roles["component"])
    return (-1 if stamp is None else parse_time(str(stamp), year), LEVELS.get(str(level).lower(), "") if level is not None else "", "" if component is None else str(component), str(msg).strip())


class EntryParser:
    """Opens entries by the mined patterns; JSON and key=value lines by the roles of their keys."""

    def __init__(self, patterns: list[str], roles: dict[str, tuple[str, ...]] = KEYS):
        self.patterns = [re.compile(p, re.S) for p in patterns]
        self.roles = roles

    def entry(self, line: str, year: int | None) -> Entry | None:
        first = line[:1]
        if not first or first.isspace():
            return None
        if first == "{" or (first.islower() and "=" in line):
            fields = fields_of(line)
            if fields is not None and (first == "{" or fields) and (found := from_fields(fields, year, self.roles)) is not None:
                return found
            if first == "{":
                return None
        for i, pattern in enumerate(self.patterns):
            m = pattern.match(line)
            if not m:
                continue
            got = m.groupdict()
            level = got.get("level")
            if level is not None and level.lower() not in LEVELS:
                continue
            if i:  # neighbouring lines mostly have the same layout
                self.patterns.insert(0, self.patterns.pop(i)) if i > 3 else None
            component = got["component"]
            if glog := got.get("glog"):
                ms = -1
                if year and (base := day_ms(year, int(glog[1:3]), int(glog[3:5]))) is not None:
                    ms = base + ((int(glog[6:8]) * 60 + int(glog[9:11])) * 60 + int(glog[12:14])) * 1000 + int((glog[15:] + "00")[:3])
                return ms, LEVELS[glog[0].lower()], component, got["msg"].strip()
            stamp = got.get("ts")
            return (parse_time(stamp, year) if stamp else -1, LEVELS[level.lower()] if level else "", component, got["msg"].strip())
        return None


OPEN = (None, None, None, None)  # the fields of an entry that is still to be read


def parse_block(lines: list[tuple[int, str, int | None]], limit: int, parser: EntryParser) -> tuple[list, int]:
    """Entries that begin below line number `limit`: [line_no, n_lines within the block, ts, level, component, msg]; and the number of lines before
    the first. `lines` are in order, each number once; those from `limit` on only complete objects. An object that isn't over with the
    last of them is an entry with OPEN fields."""
    entries: list[list] = []
    before = k = 0
    n = len(lines)
    while k < n and lines[k][0] < limit:
        number, text, year = lines[k]
        found, span = None, 1
        if text == "{":
            e = k + 1
            while e < n and (not lines[e][1] or lines[e][1][0] in " \t"):
                e += 1
            if e == n:
                found = OPEN
            elif (found := object_entry([x[1] for x in lines[k : e + 1]], year, parser.roles)) is not None:
                span = e - k + 1
        else:
            found = parser.entry(text, year)
        inside = sum(1 for x in lines[k : k + span] if x[0] < limit) if span > 1 else 1
        if found is not None:
            entries.append([number, inside, *found])
        elif entries:
            entries[-1][1] += 1
        else:
            before += 1
        k += span
    return entries, before


def object_entry(lines: list[str], year: int | None, roles: dict[str, tuple[str, ...]]) -> Entry | None:
    """The entry of an object printed over lines, the last of which should close it."""
    if lines[-1] != "}":
        return None
    try:
        fields = json.loads("\n".join(lines))
    except ValueError:
        return None
    return from_fields(fields, year, roles)


OUT_SCHEMA = "log_id string, line_no int, n_lines int, ts_ms bigint, log_level string, component string, msg string"


def parse_entries(lines: DataFrame, logs: DataFrame, block_lines: int = BLOCK_LINES, together: int = BLOCKS_TOGETHER) -> DataFrame:
    """One row per entry of `lines`(log_id, line_no, text); `logs`(log_id, started_at) gives the year where a line has none."""
    lines = lines.select("log_id", "line_no", "text").where(F.col("line_no").isNotNull())
    templates = mine_templates(lines)
    patterns, roles = [p for t, _ in templates if t[0] != FIELD and (p := classify(t))], roles_of(templates)
    years = logs.where(F.col("log_id").isNotNull()).groupBy("log_id").agg(F.year(F.min("started_at")).alias("log_year"))
    ahead = min(LOOK_AHEAD, block_lines)
    block = F.floor(F.col("line_no") / block_lines).cast("int")
    copies = F.when((F.col("line_no") % block_lines < ahead) & (F.col("line_no") >= block_lines), F.array(block, block - 1)).otherwise(F.array(block))
    held = lines.join(broadcast_if_small(years), "log_id", "left")
    spread = held.select("log_id", F.explode(copies).alias("block"), "line_no", "text", "log_year").repartition("log_id", "block").sortWithinPartitions("log_id", "block", "line_no", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, key, held, out = EntryParser(list(patterns), roles), None, [], []

        def finish() -> None:
            limit = (key[1] + 1) * block_lines
            if held[0][0] >= limit:
                return  # lines of the next block only
            entries, before = parse_block(held, limit, parser)
            still = entries.pop() if entries and entries[-1][5] is None else None
            for e in entries[:-1]:
                out.append((key[0], 2 * key[1], 0, False, None, *e))
            last = entries[-1] if entries else [None, 0, None, None, None, None]
            out.append((key[0], 2 * key[1], before, True, entries[0][0] if entries else None, *last))
            if still:  # stands for a block of its own, which has an entry or only lines of the one before
                out.append((key[0], 2 * key[1] + 1, 0, True, still[0], *still))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 11
            out.clear()
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for log_id, block_no, number, text, year in zip(*(c.to_pylist() for c in batch.columns)):
                if (log_id, block_no) != key:
                    if held:
                        finish()
                        if len(out) > 5000:
                            yield flush()
                    key, held = (log_id, block_no), []
                if held and held[-1][0] == number:
                    continue
                if text is None:
                    text = ""
                elif "\x1b" in text:
                    text = ANSI.sub("", text)
                held.append((number, text.rstrip(), year))
        if held:
            finish()
        yield flush()

    names = ["log_id", "block", "before", "last", "first_entry", "line_no", "n_lines", "ts_ms", "log_level", "component", "msg"]
    parsed = spread.mapInArrow(run, "log_id string, block int, before int, last boolean, first_entry int, line_no int, n_lines int, ts_ms bigint, log_level string, component string, msg string")
    parsed = parsed.persist(StorageLevel.DISK_ONLY)  # read twice below; a lost copy is made again from the lines
    closing = parsed.where("last")
    opened = closing.where("line_no IS NOT NULL AND msg IS NULL")  # objects that go on behind what their block saw: mostly none
    columns = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
    if opened.limit(1).count():
        closing = settle_open(closing, opened, held, block_lines, roles)
    ends = tails_of(closing, together)
    return parsed.where("not last").select(columns).unionByName(ends.select(columns))


def tails_of(closing: DataFrame, together: int) -> DataFrame:
    """The last entry of each block with the lines before the first entry of the blocks that follow, up to one with an entry. Blocks are
    numbered by the entries up to them, first inside groups of `together` blocks, then by the groups' sums."""
    has = F.col("line_no").isNotNull()
    group = F.floor(F.col("block") / together).alias("_group")
    sums = closing.groupBy("log_id", group).agg(F.sum(has.cast("long")).alias("_n"))
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("log_id").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = offsets.select(F.col("log_id").alias("_log"), F.col("_group").alias("_g"), "_before")
    inside = F.sum(has.cast("long")).over(Window.partitionBy("log_id", "_group").orderBy("block"))
    numbered = closing.withColumn("_group", group).withColumn("_own", inside)
    numbered = numbered.join(offsets, F.col("log_id").eqNullSafe(F.col("_log")) & (F.col("_group") == F.col("_g"))).withColumn("_own", F.col("_own") + F.col("_before"))
    # blocks up to and with the next that has an entry share the number of the entry they belong to
    more = numbered.groupBy(F.col("log_id").alias("_log2"), (F.col("_own") - has.cast("long")).alias("_run")).agg(F.sum("before").alias("more"))
    joined = numbered.where(has).join(more, F.col("log_id").eqNullSafe(F.col("_log2")) & (F.col("_own") == F.col("_run")), "left")
    return joined.withColumn("n_lines", (F.col("n_lines") + F.coalesce("more", F.lit(0))).cast("int"))


def settle_open(closing: DataFrame, opened: DataFrame, lines: DataFrame, block_lines: int, roles: dict[str, tuple[str, ...]]) -> DataFrame:
    """`closing` with the entries of objects that run over blocks read, or, where such an object turns out to be none, its lines given to the
    entry before it."""
    later = Window.partitionBy("log_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    spans = closing.withColumn("_next", F.first("first_entry", ignorenulls=True).over(later)).where("line_no IS NOT NULL AND msg IS NULL")
    last_block = F.max("block").over(Window.partitionBy("log_id"))
    spans = closing.select("log_id", "block").withColumn("_last", last_block).distinct().join(spans, ["log_id", "block"]).select(
        F.col("log_id").alias("_log"), F.col("line_no").alias("_start"), F.coalesce("_next", (F.floor(F.col("_last") / 2) + 1) * block_lines).alias("_stop")
    )
    per_block = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / block_lines), F.floor((F.col("_stop") - 1) / block_lines))))
    at = F.floor(F.col("line_no") / block_lines)
    inside = lines.join(per_block, F.col("log_id").eqNullSafe(F.col("_log")) & (at == F.col("_block")) & F.col("line_no").between(F.col("_start"), F.col("_stop") - 1))
    inside = inside.groupBy("_log", "_start", "line_no").agg(F.min("text").alias("text"), F.min("log_year").alias("log_year"))
    whole = inside.groupBy("_log", "_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("texts"), F.min("log_year").alias("log_year"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for log_id, start, texts, year in zip(*(c.to_pylist() for c in batch.columns)):
                texts = [ANSI.sub("", t).rstrip() for t in texts]
                end = next((k for k, t in enumerate(texts) if k and t and t[0] not in " \t"), None)
                if end is not None and (found := object_entry(texts[: end + 1], year, roles)) is not None:
                    out.append((log_id, start, *found))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["_log", "_start", "_ts", "_level", "_component", "_msg"])

    read = whole.select("_log", "_start", "texts", "log_year").mapInArrow(run, "_log string, _start int, _ts bigint, _level string, _component string, _msg string")
    joined = closing.join(read, F.col("log_id").eqNullSafe(F.col("_log")) & (F.col("line_no") == F.col("_start")), "left")
    none = F.col("line_no").isNotNull() & F.coalesce("msg", "_msg").isNull()
    return joined.select(
        "log_id", "block", F.when(none, F.col("n_lines")).otherwise(F.col("before")).alias("before"), "last", "first_entry", F.when(~none, F.col("line_no")).alias("line_no"), F.when(none, F.lit(0)).otherwise(F.col("n_lines")).alias("n_lines"),
        *[F.coalesce(mine, theirs).alias(mine) for mine, theirs in (("ts_ms", "_ts"), ("log_level", "_level"), ("component", "_component"), ("msg", "_msg"))],
    )
