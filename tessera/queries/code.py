"""Source files: edges, trees, symbols, conventions and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import code as C
from tessera.operators import edits as ED
from tessera.operators import focus as FO
from tessera.operators import graph as G
from tessera.queries.text import FILES, IMPORTED, RESOLVED, TOK, files

OLD, NEW = "budget", "allowance"
STATEMENT = "import os"


def outgoing_edges(spark, d):
    return G.import_edges(files(spark, d)).select("file_id", "specifier")


def resolve_specifiers(spark, d):
    f = files(spark, d)
    return G.resolve(G.import_edges(f), f).select("file_id", "specifier", "resolved")


def resolved(spark, d):
    f = files(spark, d)
    return G.resolve(G.import_edges(f), f)


def incoming_edges(spark, d):
    return G.incoming(resolved(spark, d))


def expand_imports(spark, d):
    """From the first file of each repository two steps along imports."""
    first = files(spark, d).groupBy("repo").agg(F.min("file_id").alias("node")).select("node", F.lit(100.0).alias("score"), F.lit("high").alias("priority"))
    return G.expand_candidates(first, resolved(spark, d), 2)


def tree_rollup(spark, d):
    return G.tree_rollup(files(spark, d))


def symbol_definitions(spark, d):
    return C.definitions(files(spark, d)).drop("repo")


def symbol_usages(spark, d):
    return C.usages(files(spark, d))


def callers_outside_body(spark, d):
    return C.usages(files(spark, d), outside_definitions=True)


def dependencies(spark, d):
    return C.dependencies(files(spark, d))


def tests_for_file(spark, d):
    return G.tests_of(resolved(spark, d), files(spark, d))


def conventions(spark, d):
    return C.conventions(files(spark, d))


def naming_styles(spark, d):
    return C.naming(files(spark, d))


def changed_symbols(spark, d):
    f = files(spark, d)
    return C.changed_symbols(f, f.withColumn("content", F.replace("content", F.lit(OLD), F.lit(NEW))))


def changed_outlines(spark, d):
    f = files(spark, d)
    return C.changed_outlines(f, f.withColumn("content", F.replace("content", F.lit(OLD), F.lit(NEW))))


def symbol_callers(spark, d):
    return C.callers(files(spark, d))


def rename_refs(spark, d):
    return C.rename(files(spark, d), OLD, NEW)


def insert_dry_run(spark, d):
    return C.insert_after_imports(files(spark, d), STATEMENT)


def outline_symbols(spark, d):
    return C.outlines(files(spark, d))


def edited_files(spark, d):
    """A function into each file, behind its imports, then the first line replaced by its hash; the second request is stale where a file changed."""
    f = files(spark, d)
    first = F.element_at(F.split("content", "\n", -1), 1)
    empty = F.lit(None).cast("array<struct<hash:string,replace:string,after:string,before:string,delete:boolean>>")
    edit = F.array(F.struct(T.line_hash(F.lit(1), first).alias("hash"), F.lit("# first").alias("replace"), F.lit(None).cast("string").alias("after"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("boolean").alias("delete")))
    none = F.lit(None).cast("string")
    row = lambda n, op, position, body, edits: f.select("file_id", F.lit(n).alias("request"), F.lit(op).alias("op"), none.alias("symbol"), none.alias("expected"), position.alias("position"), body.alias("body"), edits.alias("edits"), F.lit(None).cast("array<string>").alias("imports"))
    requests = row(1, "insert", F.lit("after-imports"), F.lit("# inserted"), empty).unionByName(row(2, "lines", none, none, edit))
    return ED.apply(f, requests).select("file_id", "request", "ok", "code", "n_changed", F.substring(F.sha2("content", 256), 1, 8).alias("hash"))


def scoped_rename(spark, d):
    return ED.rename(files(spark, d), OLD, NEW, scope=("src/**", "lib/**")).drop("content")


def focus(spark, d):
    """The first symbol of the first file of each repository."""
    f = files(spark, d)
    firsts = f.groupBy("repo").agg(F.min("file_id").alias("file_id")).select("file_id")
    first = C.outlines(f).where("ordinal = 0").join(firsts, "file_id", "left_semi").select(F.col("file_id").alias("request"), "file_id", F.col("name").alias("symbol"), F.lit(None).cast("string").alias("hash"))
    return FO.focus(f, first)


def verify_changes(spark, d):
    f = files(spark, d)
    return FO.verify(f, f.withColumn("content", F.replace("content", F.lit(OLD), F.lit(NEW))))


QUERIES = {
    f.__name__: f
    for f in (outgoing_edges, resolve_specifiers, incoming_edges, expand_imports, tree_rollup, symbol_definitions, symbol_usages, callers_outside_body, dependencies, tests_for_file, conventions, naming_styles, changed_symbols, changed_outlines, symbol_callers, rename_refs, insert_dry_run, outline_symbols, edited_files, scoped_rename, focus, verify_changes)
}


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_LINES = f"{FILES}, sl AS (SELECT file_id, repo, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT file_id, repo, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM files))"
_DEFS = f"{_LINES}, df AS (SELECT * FROM (SELECT file_id, repo, line_no, regexp_extract(line, '{C.DEFINITION}', 1) AS name, line FROM sl) WHERE name <> '')"
_WORDS = f"{_DEFS}, wl AS (SELECT DISTINCT file_id, repo, line_no, unnest(regexp_extract_all(line, '{C.WORD}')) AS name FROM sl)"
_LANG = f"CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in T.LANGUAGES.items())} END"
_TEST = "(?i)(^|/)(__tests__|tests?|specs?)(/|$)|\\.(test|spec)\\."

ORACLES = {
    "outgoing_edges": f"WITH {FILES}, {IMPORTED} SELECT file_id, specifier FROM ed",
    "resolve_specifiers": f"WITH {FILES}, {RESOLVED} SELECT file_id, specifier, resolved FROM re",
    "incoming_edges": f"WITH {FILES}, {RESOLVED} SELECT DISTINCT resolved AS file_id, file_id AS importer FROM re WHERE resolved <> file_id",
    "expand_imports": f"""WITH {FILES}, {RESOLVED}, s AS (SELECT min(file_id) AS node FROM files GROUP BY repo), e AS (SELECT DISTINCT file_id, resolved FROM re WHERE resolved IS NOT NULL), a AS (SELECT DISTINCT resolved AS node FROM e WHERE file_id IN (SELECT node FROM s)),
        b AS (SELECT DISTINCT resolved AS node FROM e WHERE file_id IN (SELECT node FROM a) AND file_id NOT IN (SELECT node FROM s)) SELECT node, CASE WHEN node IN (SELECT node FROM s) THEN 100.0 WHEN node IN (SELECT node FROM a) THEN 50.0 ELSE 25.0 END::DOUBLE AS score, CASE WHEN node IN (SELECT node FROM s) THEN 'high' ELSE 'low' END AS priority
        FROM (SELECT node FROM s UNION SELECT node FROM a UNION SELECT node FROM b)""",
    "tree_rollup": f"""WITH {FILES}, p AS (SELECT repo, string_split(regexp_replace(path, '^\\./', ''), '/') AS parts, len(regexp_extract_all(content, '{TOK}')) AS tokens FROM files), l AS (SELECT *, unnest(generate_series(0, least(len(parts) - 1, 3))) AS level FROM p)
        SELECT repo, array_to_string(parts[:level], '/') AS prefix, level, count(*) AS n_files, sum(tokens)::BIGINT AS tokens FROM l GROUP BY 1, 2, 3""",
    "symbol_definitions": f"WITH {_DEFS} SELECT file_id, line_no, name FROM df",
    "symbol_usages": f"WITH {_WORDS} SELECT repo, name, count(*) AS n_lines, count(DISTINCT file_id) AS n_files FROM wl WHERE (repo, name) IN (SELECT repo, name FROM df) GROUP BY 1, 2",
    "callers_outside_body": f"WITH {_WORDS} SELECT repo, name, count(*) AS n_lines, count(DISTINCT file_id) AS n_files FROM wl WHERE (repo, name) IN (SELECT repo, name FROM df) AND (file_id, line_no, name) NOT IN (SELECT file_id, line_no, name FROM df) GROUP BY 1, 2",
    "dependencies": f"""WITH {FILES}, a AS (SELECT file_id, regexp_extract_all(content, '{C.CALL}', 1) AS l FROM files), b AS (SELECT file_id, unnest(l) AS name, generate_subscripts(l, 1) AS i FROM a),
        c AS (SELECT file_id, name, min(i) AS i FROM b WHERE name NOT IN ({", ".join(f"'{x}'" for x in C.NOT_CALLS)}) GROUP BY 1, 2), r AS (SELECT file_id, name, row_number() OVER (PARTITION BY file_id ORDER BY i) - 1 AS n FROM c) SELECT file_id, n, name FROM r WHERE n < 12""",
    "tests_for_file": f"""WITH {FILES}, {RESOLVED}, tf AS (SELECT file_id FROM files WHERE regexp_matches(path, '{_TEST}')) SELECT DISTINCT resolved AS file_id, file_id AS test FROM re WHERE resolved <> file_id AND file_id IN (SELECT file_id FROM tf) UNION SELECT file_id, file_id FROM tf""",
    "naming_styles": f"WITH {_DEFS} SELECT repo, CASE WHEN regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') THEN 'camel' WHEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') THEN 'pascal' WHEN regexp_matches(name, '^[a-z][a-z0-9_]*$') AND contains(name, '_') THEN 'snake' ELSE 'other' END AS style, count(*) AS n FROM df GROUP BY 1, 2",
    "changed_symbols": f"""WITH {_LINES}, o AS (SELECT file_id, name, arg_min(trim(line, ' ' || chr(9) || chr(13)), line_no) AS l FROM (SELECT *, regexp_extract(line, '{C.DEFINITION}', 1) AS name FROM sl) WHERE name <> '' GROUP BY 1, 2),
        n AS (SELECT file_id, name, arg_min(trim(line, ' ' || chr(9) || chr(13)), line_no) AS l FROM (SELECT file_id, line_no, replace(line, '{OLD}', '{NEW}') AS line, regexp_extract(replace(line, '{OLD}', '{NEW}'), '{C.DEFINITION}', 1) AS name FROM sl) WHERE name <> '' GROUP BY 1, 2)
        SELECT coalesce(o.file_id, n.file_id) AS file_id, coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.file_id = n.file_id AND o.name = n.name WHERE o.l IS DISTINCT FROM n.l""",
    "rename_refs": f"""WITH {FILES}, a AS (SELECT file_id, content, regexp_replace(content, '\\b{OLD}\\b', '{NEW}', 'g') AS c2 FROM files WHERE contains(content, '{OLD}'))
        SELECT * FROM (SELECT file_id, len(regexp_extract_all(content, '\\b{OLD}\\b')) AS n_matches, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\\b{OLD}\\b'))) AS n_lines, substr(sha256(c2), 1, 8) AS hash FROM a) WHERE n_matches > 0""",
    "insert_dry_run": f"""WITH {FILES}, a AS (SELECT file_id, string_split(content, chr(10)) AS l FROM files), b AS (SELECT *, CASE WHEN len(list_filter(l, lambda x: trim(x) = '{STATEMENT}')) > 0 THEN -1 ELSE coalesce(list_max(list_filter(list_transform(l, lambda x, i: CASE WHEN regexp_matches(x, '^(import|from|use|#include|require)\\b') THEN i ELSE 0 END), lambda x: x > 0)), 0) END AS at_line FROM a)
        SELECT file_id, at_line::BIGINT AS at_line, substr(sha256(CASE WHEN at_line < 0 THEN array_to_string(l, chr(10)) ELSE array_to_string(list_concat(list_concat(l[:at_line], ['{STATEMENT}']), l[at_line + 1 :]), chr(10)) END), 1, 8) AS hash FROM b""",
    "scoped_rename": rf"""WITH {FILES}, a AS (SELECT file_id, path, len(regexp_extract_all(content, '\b{OLD}\b')) AS n_references, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\b{OLD}\b'))) AS n_lines FROM files WHERE regexp_matches(regexp_replace(path, '^\./', ''), '^(src|lib)/'))
        SELECT *, false AS defines FROM a WHERE n_references > 0""",
}
