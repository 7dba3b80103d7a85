"""Queries over the text of source files: scan, extraction, graph, code map."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import codemap, extract, graph, order, quality, snapshots
from lodestone.plans import analysis
from lodestone.session import settled, shared_folder
from lodestone.sources import corpus as scan
from workload import fixtures as fx
from workload.registry import query


def _units(spark, d):
    return extract.units(fx.sources(spark, d))


def _stored_functions(spark, d):
    """The stored parse as the functions table reads it."""
    return settled(extract.for_functions(_units(spark, d)))


def _graph(spark, d):
    """Functions (names and places alone) and resolved call sites over one stored parse."""
    u = settled(extract.for_graph(_units(spark, d)))
    fns = extract.functions(u)
    return fns, graph.resolve(graph.call_sites(u), graph.directory(fns))


def _edges(spark, d):
    """Functions and the stored edge table."""
    fns, resolved = _graph(spark, d)
    return fns, settled(graph.call_edges(resolved))


# -- scan ---------------------------------------------------------------------

@query("corpus_scan", f"""WITH {fx.SQL_SOURCES}
SELECT md5(path) AS file_key, path, md5(content) AS content_hash, length(content) AS n_chars FROM files""")
def corpus_scan(spark, d):
    return scan.scan_table(fx.sources(spark, d)).select(
        "file_key", "path", "content_hash", F.length("content").alias("n_chars"))


@query("scan_folder", f"""WITH {fx.SQL_SOURCES}
SELECT md5(path) AS file_key, path, md5(content) AS content_hash, length(content) AS n_chars FROM files""")
def scan_folder(spark, d):
    """The sources as files of a folder, read back from there."""
    root = f"{shared_folder(spark).rstrip('/')}/folders/{uuid.uuid4().hex}"
    fx.write_tree(fx.sources(spark, d), root)
    return scan.scan_folder(spark, root, "*.txt", fx.path_in_tree()).select(
        "file_key", "path", "content_hash", F.length("content").alias("n_chars"))


@query("source_filter", f"""WITH {fx.SQL_DOCFILES}
SELECT path, length(content) AS n_chars FROM docfiles WHERE path LIKE '%.c' OR path LIKE '%.h'""")
def source_filter(spark, d):
    return scan.scan_table(fx.docfiles(spark, d)).select("path", F.length("content").alias("n_chars"))


@query("tolerant_decode", f"""WITH {fx.SQL_DOCFILES}
SELECT path, md5('x' || chr(65533) || chr(10) || content || chr(65533)) AS content_hash FROM docfiles""")
def tolerant_decode(spark, d):
    raw = F.concat(F.unhex(F.lit("78FF0D0A")), F.col("content").cast("binary"), F.unhex(F.lit("C3")))
    return fx.docfiles(spark, d).select("path", F.md5(text.tolerant_text(raw).cast("binary")).alias("content_hash"))


@query("file_dimension", f"""WITH {fx.SQL_DOCFILES} SELECT file_key, path FROM docfiles""")
def file_dimension(spark, d):
    docs = fx.docfiles(spark, d)
    known = docs.where(F.split("path", "/")[1] == "en").select("file_key", "path")
    # every path arrives twice
    return scan.file_dimension(known, docs.select("path").unionByName(docs.select("path")))


@query("function_snippet", f"""WITH {fx.SQL_DOCFILES}
SELECT path, string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) AS snippet
FROM (SELECT path, len(string_split(content, chr(10))) AS n, unnest(string_split(content, chr(10))) AS line,
             generate_subscripts(string_split(content, chr(10)), 1) AS i FROM docfiles)
WHERE i BETWEEN 2 AND 4 GROUP BY path
UNION ALL
SELECT path, '' FROM docfiles WHERE len(string_split(content, chr(10))) < 2""")
def function_snippet(spark, d):
    return fx.docfiles(spark, d).select("path", text.line_range("content", F.lit(2), F.lit(4)).alias("snippet"))


@query("code_hash", f"""WITH {fx.SQL_DOCFILES}
SELECT path, md5(content) AS code_hash FROM docfiles""")
def code_hash(spark, d):
    windows = F.replace("content", F.lit("\n"), F.lit("\r\n"))
    return fx.docfiles(spark, d).select("path", text.code_hash(windows).alias("code_hash"))


# -- extraction ---------------------------------------------------------------

@query("extract_functions", f"""WITH {fx.SQL_CORPUS}
SELECT path, name, start_line, end_line FROM fn""")
def extract_functions(spark, d):
    return extract.definitions(extract.units(fx.corpus(spark, d))).select("path", "name", "start_line", "end_line")


@query("function_return_type", f"""WITH {fx.SQL_CORPUS}
SELECT path, name, start_line, return_type FROM fn""")
def function_return_type(spark, d):
    return extract.definitions(extract.units(fx.corpus(spark, d))).select("path", "name", "start_line", "return_type")


@query("function_parameters", f"""WITH {fx.SQL_SOURCES}
SELECT path, name, start_line, parameters FROM functions""")
def function_parameters(spark, d):
    return extract.functions(_stored_functions(spark, d)).select("path", "name", "start_line", "parameters")


@query("extract_prototypes", f"""WITH {fx.SQL_HEADERS}
SELECT path, declared AS name, start_line, start_line AS end_line, return_type
FROM item WHERE p_partkey % 5 = 0""")
def extract_prototypes(spark, d):
    return extract.prototypes(extract.units(fx.headers(spark, d))).select(
        "path", "name", "start_line", "end_line", "return_type")


@query("variant_functions", f"""WITH {fx.SQL_VARIANTS}
SELECT path, name, return_type, parameters, start_line, end_line FROM variant_function""")
def variant_functions(spark, d):
    """Functions in conditional arms and with old-style heads."""
    return extract.definitions(extract.units(fx.variants(spark, d))).select(
        "path", "name", "return_type", "parameters", "start_line", "end_line")


@query("variant_calls", f"""WITH {fx.SQL_VARIANTS} SELECT path, line, caller, callee FROM variant_call""")
def variant_calls(spark, d):
    """Calls in all arms belong to the function that the arms are part of."""
    return graph.call_sites(settled(extract.units(fx.variants(spark, d)))).select("path", "line", "caller", "callee")


@query("variant_globals", f"""WITH {fx.SQL_VARIANTS} SELECT path, 'v_' || name AS name, 'int' AS type FROM variant WHERE kind = 3""")
def variant_globals(spark, d):
    """Declared parameters are no globals."""
    return extract.globals_(extract.units(fx.variants(spark, d))).select("path", "name", "type")


_SQL_STRUCTS = """
structs AS (
  SELECT path, 'node' AS name, 'struct node { int id; char name[16]; }' AS code, 'int id|char name' AS fields, 0 AS k
  FROM corpus
  UNION ALL
  SELECT path, CASE p_partkey % 5 WHEN 1 THEN 's_' ELSE 'a_' END || name,
         CASE p_partkey % 5 WHEN 1 THEN left(text, length(text) - 1)
              ELSE 'struct {' || chr(10) || '    long x, y;' || chr(10) || '}' END,
         CASE p_partkey % 5 WHEN 1 THEN 'int id|char tag|struct s_other next' ELSE 'long x|long y' END, unit
  FROM item WHERE p_partkey % 5 IN (1, 4))"""
_SQL_TYPEDEFS = """
typedefs AS (
  SELECT path, CASE p_partkey % 5 WHEN 2 THEN 't_' ELSE 'a_' END || name AS alias,
         CASE p_partkey % 5 WHEN 2 THEN 'unsigned int' ELSE '<complex type>' END AS original, text AS code, unit AS k
  FROM item WHERE p_partkey % 5 IN (2, 4))"""
_SQL_GLOBALS = """
globals AS (
  SELECT path, 'g_count' AS name, 'static int' AS type, 1 AS k FROM corpus
  UNION ALL
  SELECT path, v.prefix || item.name, 'extern unsigned int', unit
  FROM item CROSS JOIN (VALUES ('g_'), ('h_')) v(prefix) WHERE p_partkey % 5 = 3)"""
_SQL_SYMBOLS = _SQL_STRUCTS + "," + _SQL_TYPEDEFS + "," + _SQL_GLOBALS + """,
symbols AS (
  SELECT md5(path) AS file_key, path, 'struct' AS symbol_type, name AS symbol_name, code AS code_snippet,
         fields, NULL AS original, k FROM structs
  UNION ALL SELECT md5(path), path, 'typedef', alias, code, NULL, original, k FROM typedefs
  UNION ALL SELECT md5(path), path, 'global', name, type, NULL, NULL, k FROM globals)"""


@query("extract_structs", f"""WITH {fx.SQL_SOURCES}, {_SQL_STRUCTS} SELECT path, name, code FROM structs""")
def extract_structs(spark, d):
    return extract.structs(_units(spark, d)).select("path", "name", "code")


@query("struct_fields", f"""WITH {fx.SQL_SOURCES}, {_SQL_STRUCTS}
SELECT path, name, unnest(string_split(fields, '|')) AS field,
       generate_subscripts(string_split(fields, '|'), 1) - 1 AS position FROM structs""")
def struct_fields(spark, d):
    return extract.structs(_units(spark, d)).select("path", "name", F.posexplode("fields").alias("position", "field"))


@query("extract_typedefs", f"""WITH {fx.SQL_HEADERS}, {_SQL_TYPEDEFS} SELECT path, alias, original, code FROM typedefs""")
def extract_typedefs(spark, d):
    return extract.typedefs(extract.units(fx.headers(spark, d))).select("path", "alias", "original", "code")


@query("extract_globals", f"""WITH {fx.SQL_SOURCES}, {_SQL_GLOBALS} SELECT path, name, type FROM globals""")
def extract_globals(spark, d):
    return extract.globals_(_units(spark, d)).select("path", "name", "type")


_DECLARES = r"^\s*(static |extern |const |unsigned )*(struct|int|char|long|short|float|double|void)\b[^()]*[;={{]"


@query("declarations_outside", f"""WITH {fx.SQL_SOURCES},
lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::BIGINT AS line_no FROM files),
found AS (SELECT path, line_no AS start_line, line_no AS end_line FROM lines WHERE regexp_matches(line, '{_DECLARES.replace("{{", "{")}'))
SELECT * FROM found d WHERE NOT EXISTS (
  SELECT 1 FROM fn f WHERE f.path = d.path AND f.start_line <= d.start_line AND f.end_line >= d.end_line)""")
def declarations_outside(spark, d):
    """Lines that begin a declaration and lie in no function."""
    files = fx.sources(spark, d)
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    at = (F.col("at") + 1).cast("int")
    found = lines.where(F.col("line").rlike(_DECLARES.replace("{{", "{"))).select("path", at.alias("start_line"), at.alias("end_line"))
    # the sweep reads both twice
    fns = settled(extract.definitions(extract.units(files)).select("path", "start_line", "end_line"))
    return order.outside(settled(found), fns, "path", "start_line", "end_line")


@query("extract_calls", f"""WITH {fx.SQL_CORPUS}
SELECT path, line AS caller_line, callee AS callee_name FROM call_site""")
def extract_calls(spark, d):
    return extract.calls(extract.units(fx.corpus(spark, d)))


@query("file_symbols", f"""WITH {fx.SQL_SOURCES}, {_SQL_SYMBOLS} SELECT * EXCLUDE (k) FROM symbols""")
def file_symbols(spark, d):
    u = settled(extract.for_symbols(_units(spark, d)).where("text IS NOT NULL").select("path", "unit", "is_function", "text", "body"))
    return extract.file_symbols(u).drop("ordinal", "pos")


@query("functions_table", f"""WITH {fx.SQL_SOURCES}
SELECT function_key, file_key, path, name, return_type, parameters, start_line, end_line, is_prototype,
       md5(snippet) AS code_hash, snippet AS code_snippet, ordinal FROM functions""")
def functions_table(spark, d):
    # the prologue of a .c file makes two units, so its functions start at 2
    return extract.functions(_stored_functions(spark, d))


@query("params_json", f"""WITH {fx.SQL_SOURCES}
SELECT function_key, '["' || replace(parameters, '|', '","') || '"]' AS parameters FROM functions""")
def params_json(spark, d):
    return extract.functions(_stored_functions(spark, d)).select(
        "function_key", text.encode_parameters("parameters").alias("parameters"))


@query("file_info", f"""WITH {fx.SQL_SOURCES}, {_SQL_SYMBOLS},
marks AS (
  SELECT path, CASE WHEN is_prototype THEN 'prototypes' ELSE 'definitions' END AS kind FROM functions
  UNION ALL SELECT path, symbol_type || 's' FROM symbols UNION ALL SELECT path, 'calls' FROM call_site
  UNION ALL SELECT path, 'file' FROM files)
SELECT path, count(*) FILTER (kind = 'definitions') AS n_definitions,
       count(*) FILTER (kind = 'prototypes') AS n_prototypes, count(*) FILTER (kind = 'structs') AS n_structs,
       count(*) FILTER (kind = 'typedefs') AS n_typedefs, count(*) FILTER (kind = 'globals') AS n_globals,
       count(*) FILTER (kind = 'calls') AS n_calls FROM marks GROUP BY path""")
def file_info(spark, d):
    files = fx.sources(spark, d)
    u = settled(extract.for_symbols(extract.units(files)))
    return extract.file_info(files, extract.functions(u), extract.file_symbols(u), extract.calls(u))


@query("file_quality", f"""WITH {fx.SQL_SOURCES} SELECT path || '.broken' AS path, 1 AS final_depth FROM corpus""")
def file_quality(spark, d):
    files = fx.sources(spark, d)
    broken = fx.corpus(spark, d).select(F.concat("path", F.lit(".broken")).alias("path"),
                                        F.concat("content", F.lit("int f(void) { {}\n")).alias("content"))
    return extract.file_quality(files.unionByName(broken)).select("path", "final_depth")


# -- graph --------------------------------------------------------------------

@query("call_enclosing", f"""WITH {fx.SQL_CORPUS}
SELECT path, line AS caller_line, callee AS callee_name, caller FROM call_site""")
def call_enclosing(spark, d):
    u = settled(extract.for_graph(extract.units(fx.corpus(spark, d))))
    return graph.enclosing_functions(extract.calls(u), extract.functions(u)).select(
        "path", "caller_line", "callee_name", "caller")


@query("resolve_calls", f"""WITH {fx.SQL_SOURCES}
SELECT path, line, caller_key, caller_name, callee_key, callee_name FROM all_edges""")
def resolve_calls(spark, d):
    return _graph(spark, d)[1].select("path", "line", "caller_key", "caller_name", "callee_key", "callee_name")


@query("unresolved_calls", f"""WITH {fx.SQL_SOURCES}
SELECT c.path, c.line, c.callee FROM call_site c LEFT JOIN directory d USING (callee) WHERE d.callee IS NULL""")
def unresolved_calls(spark, d):
    u = settled(extract.for_graph(_units(spark, d)))
    return graph.unresolved(graph.call_sites(u), graph.directory(extract.functions(u))).select("path", "line", "callee")


@query("call_edges", f"""WITH {fx.SQL_SOURCES} SELECT caller_key, callee_key, caller_name, callee_name FROM edges""")
def call_edges(spark, d):
    return graph.call_edges(_graph(spark, d)[1])


@query("distinct_edges", f"""WITH {fx.SQL_SOURCES}
SELECT caller_key, callee_key, caller_name, callee_name, count(*) AS n_sites FROM edges GROUP BY ALL""")
def distinct_edges(spark, d):
    return graph.distinct_edges(_edges(spark, d)[1])


@query("recursive_functions", f"""WITH {fx.SQL_SOURCES}
SELECT DISTINCT caller_key, caller_name FROM all_edges WHERE caller_key = callee_key""")
def recursive_functions(spark, d):
    return graph.recursive_functions(_graph(spark, d)[1])


@query("qualified_names", f"""WITH {fx.SQL_SOURCES}
SELECT caller_key, callee_key, caller_name, callee_name FROM edges
WHERE NOT (substr(caller_key, 1, 1) = '0' OR substr(callee_key, 1, 1) = 'f')""")
def qualified_names(spark, d):
    fns, edges = _edges(spark, d)
    return graph.qualified_edges(_broken(edges).where("caller_key <> callee_key"), fns)


_SQL_BROKEN = """
broken AS (
  SELECT CASE WHEN substr(caller_key, 1, 1) = '0' THEN md5(caller_key || 'gone') ELSE caller_key END AS caller_key,
         CASE WHEN substr(callee_key, 1, 1) = 'f' THEN md5(callee_key || 'gone') ELSE callee_key END AS callee_key
  FROM edges)"""


def _broken(edges):
    """Edges with some ends replaced by keys that no function has."""
    def lost(c, digit):
        return F.when(F.substring(c, 1, 1) == digit, F.md5(F.concat(c, F.lit("gone")).cast("binary"))).otherwise(F.col(c))
    return edges.select(lost("caller_key", "0").alias("caller_key"), lost("callee_key", "f").alias("callee_key"))


@query("valid_edges", f"""WITH {fx.SQL_SOURCES}, {_SQL_BROKEN}
SELECT caller_key, callee_key FROM broken
WHERE caller_key IN (SELECT function_key FROM functions) AND callee_key IN (SELECT function_key FROM functions)""")
def valid_edges(spark, d):
    fns, edges = _edges(spark, d)
    return graph.valid_edges(_broken(edges), fns)


@query("edge_orphans", f"""WITH {fx.SQL_SOURCES}, {_SQL_BROKEN}
SELECT caller_key, callee_key, 'caller_key' AS missing FROM broken
WHERE caller_key NOT IN (SELECT function_key FROM functions)
UNION ALL SELECT caller_key, callee_key, 'callee_key' FROM broken
WHERE callee_key NOT IN (SELECT function_key FROM functions)""")
def edge_orphans(spark, d):
    fns, edges = _edges(spark, d)
    return quality.edge_orphans(_broken(edges), fns)


@query("callers", f"""WITH {fx.SQL_SOURCES}
SELECT callee_key AS function_key, row_number() OVER (PARTITION BY callee_key ORDER BY caller_name) AS position, caller_name
FROM (SELECT DISTINCT callee_key, caller_name FROM edges)""")
def callers(spark, d):
    return graph.callers(_edges(spark, d)[1])


@query("callees", f"""WITH {fx.SQL_SOURCES}
SELECT caller_key AS function_key, string_agg(DISTINCT callee_name, '|' ORDER BY callee_name) AS callees
FROM edges GROUP BY caller_key""")
def callees(spark, d):
    return graph.callees(_edges(spark, d)[1])


def _unified_sql(functions="functions", edges="edges"):
    return f"""
incoming AS (SELECT callee_key AS function_key, list_sort(list(DISTINCT caller_name)) AS callers FROM {edges} GROUP BY 1),
outgoing AS (SELECT caller_key AS function_key, list_sort(list(DISTINCT callee_name)) AS callees FROM {edges} GROUP BY 1),
unified AS (
  SELECT path, name, start_line, end_line, min(ordinal) AS ordinal, arg_min(return_type, ordinal) AS return_type,
         arg_min(is_prototype, ordinal) AS prototype,
         list_sort(list_distinct(flatten(list(coalesce(callers, []))))) AS callers,
         list_sort(list_distinct(flatten(list(coalesce(callees, []))))) AS callees
  FROM {functions} LEFT JOIN incoming USING (function_key) LEFT JOIN outgoing USING (function_key)
  GROUP BY path, name, start_line, end_line)"""


_SQL_UNIFIED = _unified_sql()
# A prototype beside every definition of brand1, and the other way round, which has part of its edges.
_SQL_TWINS = """
twins AS (
  SELECT * FROM functions
  UNION ALL SELECT path, name, 'long', parameters, start_line, end_line, NOT is_prototype, snippet, ordinal + 1000000,
                   md5(function_key || 'twin'), file_key, qualified_name FROM functions WHERE path LIKE '%/brand1/%'),
twin_edges AS (
  SELECT CASE WHEN caller_name LIKE '%/brand1/%' AND callee_key < '8' THEN md5(caller_key || 'twin') ELSE caller_key END AS caller_key,
         CASE WHEN callee_name LIKE '%/brand1/%' AND caller_key < '8' THEN md5(callee_key || 'twin') ELSE callee_key END AS callee_key,
         caller_name, callee_name FROM edges)"""


def _twins(spark, d):
    fns, edges = _edges(spark, d)

    def twin(key):
        return F.md5(F.concat(key, F.lit("twin")).cast("binary"))

    own = fns.where(F.col("path").contains("/brand1/")).withColumns({
        "function_key": twin("function_key"), "is_prototype": ~F.col("is_prototype"), "ordinal": F.col("ordinal") + 1_000_000,
        "return_type": F.lit("long")})

    def end(key, name, other):
        return F.when(F.col(name).contains("/brand1/") & (F.col(other) < "8"), twin(key)).otherwise(F.col(key)).alias(key)

    return settled(fns.unionByName(own)), edges.select(
        end("caller_key", "caller_name", "callee_key"), end("callee_key", "callee_name", "caller_key"), "caller_name", "callee_name")


@query("unify_functions", f"""WITH {fx.SQL_SOURCES}, {_SQL_TWINS}, {_unified_sql("twins", "twin_edges")}
SELECT path, name, start_line, end_line, prototype, return_type, len(callers) AS n_callers,
       array_to_string(callers, '|') AS callers, array_to_string(callees, '|') AS callees,
       CASE WHEN prototype AND path NOT LIKE '%/brand1/%' THEN NULL ELSE name || '!' END AS func_summary
FROM unified""")
def unify_functions(spark, d):
    """Records of one or two functions; the summary is that of the definition, prototypes have empty ones."""
    fns, edges = _twins(spark, d)
    summaries = fns.select("function_key", F.lit("").alias("summary"),
                           F.when(~F.col("is_prototype"), F.concat("name", F.lit("!"))).alias("summary_refined")).distinct()
    return codemap.unified_functions(fns, edges, summaries, with_callers=True).select(
        "path", "name", "start_line", "end_line", "prototype", "return_type", "n_callers", "callers", "callees", "func_summary")


@query("function_callers", f"""WITH {fx.SQL_SOURCES}, {_SQL_TWINS}, {_unified_sql("twins", "twin_edges")}
SELECT path, name, start_line, end_line, unnest(callers) AS caller, unnest(range(1, len(callers) + 1)) AS position FROM unified""")
def function_callers(spark, d):
    return codemap.code_map_callers(*_twins(spark, d))


@query("call_hubs", f"""WITH {fx.SQL_SOURCES},
pairs AS (SELECT DISTINCT caller_key, callee_key FROM edges)
SELECT path, name, is_prototype,
       (SELECT count(*) FROM pairs p WHERE p.callee_key = f.function_key) AS n_callers,
       (SELECT count(*) FROM pairs p WHERE p.caller_key = f.function_key) AS n_callees FROM functions f""")
def call_hubs(spark, d):
    return graph.degree(*_edges(spark, d))


def _code_map(spark, d, without=None):
    """Code map and callers; the functions of the brand ``without`` are known, its files are not."""
    sources = fx.sources(spark, d)
    t = analysis.structure(sources)
    edges = settled(t["function_calls"])
    files = sources.where(~F.col("path").contains(f"/{without}/")) if without else sources
    key = F.md5(F.col("path").cast("binary"))
    texts = files.select("path", key.alias("file_key"), F.col("content").alias("summary"),
                         F.lit("").alias("summary_refined"))
    return codemap.code_map(files, t["functions"], t["file_symbols"], edges, texts), codemap.code_map_callers(t["functions"], edges)


@query("code_map", f"""WITH {fx.SQL_SOURCES}, {_SQL_SYMBOLS}, {_SQL_UNIFIED},
fns AS (
  SELECT path, count(*) AS n_functions, string_agg(name, '|' ORDER BY ordinal) AS function_names,
         CAST(sum(len(callers)) AS BIGINT) AS n_callers, CAST(sum(len(callees)) AS BIGINT) AS n_callees
  FROM unified GROUP BY path),
syms AS (
  SELECT path, count(*) FILTER (symbol_type = 'struct') AS n_structs, count(*) FILTER (symbol_type = 'typedef') AS n_typedefs,
         count(*) FILTER (symbol_type = 'global') AS n_globals,
         string_agg(symbol_name, '|' ORDER BY symbol_name) FILTER (symbol_type = 'struct') AS struct_names
  FROM symbols GROUP BY path)
SELECT path, md5(content) AS file_summary, coalesce(n_functions, 0) AS n_functions,
       coalesce(function_names, '') AS function_names, coalesce(n_callers, 0) AS n_callers,
       coalesce(n_callees, 0) AS n_callees, coalesce(n_structs, 0) AS n_structs, coalesce(n_typedefs, 0) AS n_typedefs,
       coalesce(n_globals, 0) AS n_globals, coalesce(struct_names, '') AS struct_names
FROM files LEFT JOIN fns USING (path) LEFT JOIN syms USING (path)""")
def code_map(spark, d):
    def total(each):
        return F.aggregate(F.transform("functions", each), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _code_map(spark, d)[0].select(
        "path", F.md5(F.col("file_summary").cast("binary")).alias("file_summary"), F.size("functions").alias("n_functions"),
        F.col("functions.name").alias("function_names"), total(lambda f: f["n_callers"]).alias("n_callers"),
        total(lambda f: F.greatest(F.coalesce(F.size(f["callees"]), F.lit(0)), F.lit(0)).cast("bigint")).alias("n_callees"),
        F.size("structs").alias("n_structs"), F.size("typedefs").alias("n_typedefs"),
        F.size("globals").alias("n_globals"), F.array_sort("structs.name").alias("struct_names"))


@query("code_map_json", f"""WITH {fx.SQL_SOURCES}, {_SQL_SYMBOLS}, {_SQL_UNIFIED},
params AS (SELECT path, name, start_line, end_line, arg_min(parameters, ordinal) AS parameters FROM functions GROUP BY ALL),
shown AS (SELECT * FROM files WHERE path NOT LIKE '%/brand2/%'),
syms AS (SELECT *, row_number() OVER (PARTITION BY path, symbol_type ORDER BY k, symbol_name) AS n FROM symbols)
SELECT path, 'file' AS kind, 0 AS position, NULL AS name, md5(content) AS text, NULL AS lines, 'path|file_summary|functions|structs|typedefs|globals' AS more
FROM shown
UNION ALL SELECT path, CASE WHEN prototype THEN 'prototype' ELSE 'function' END, row_number() OVER (PARTITION BY path ORDER BY ordinal), name,
       return_type || '(' || parameters || ')', start_line || '-' || end_line, len(callers) || '<' || array_to_string(callees, '|')
FROM unified JOIN params USING (path, name, start_line, end_line) JOIN shown USING (path)
UNION ALL SELECT path, symbol_type, n, symbol_name, code_snippet, NULL, coalesce(fields, original, '') FROM syms JOIN shown USING (path)
UNION ALL SELECT path, 'caller', unnest(range(1, len(callers) + 1)), name, unnest(callers), start_line || '-' || end_line, '' FROM unified""")
def code_map_json(spark, d):
    """Written as JSON lines, read back with the declared schema, and taken apart field by field."""
    folder = f"{shared_folder(spark).rstrip('/')}/json/{uuid.uuid4().hex}"
    codemap.write_json(*_code_map(spark, d, "brand2"), folder)
    files, callers = codemap.read_json(spark, folder)
    keys = spark.read.text(f"{folder}/files").select(
        F.get_json_object("value", "$.path").alias("path"), F.array_join(F.json_object_keys("value"), "|").alias("keys"))
    none = F.lit(None).cast("string")
    span = F.concat_ws("-", "x.start_line", "x.end_line")

    def part(items, kind, name, text, lines, more):
        rows = files.select("path", F.posexplode(items).alias("n", "x"))
        return rows.select("path", kind.alias("kind"), (F.col("n") + 1).cast("bigint").alias("position"), F.col(name).alias("name"), text.alias("text"),
                           lines.alias("lines"), more.alias("more"))

    shown = [
        files.join(keys, "path").select("path", F.lit("file").alias("kind"), F.lit(0).cast("bigint").alias("position"), none.alias("name"),
                                        F.md5(F.col("file_summary").cast("binary")).alias("text"), none.alias("lines"), F.col("keys").alias("more")),
        part("functions", F.when(F.col("x.prototype"), "prototype").otherwise("function"), "x.name",
             F.concat("x.return_type", F.lit("("), F.array_join("x.parameters", "|"), F.lit(")")), span,
             F.concat("x.n_callers", F.lit("<"), F.array_join(F.coalesce("x.callees", F.array().cast("array<string>")), "|"))),
        part("structs", F.lit("struct"), "x.name", F.col("x.code"), none, F.array_join("x.fields", "|")),
        part("typedefs", F.lit("typedef"), "x.alias", F.col("x.code"), none, F.col("x.original")),
        part("globals", F.lit("global"), "x.name", F.col("x.type"), none, F.lit("")),
        callers.select("path", F.lit("caller").alias("kind"), "position", "name", F.col("caller").alias("text"),
                       F.concat_ws("-", "start_line", "end_line").alias("lines"), F.lit("").alias("more"))]
    return functools.reduce(DataFrame.unionByName, shown)


@query("function_report", f"""WITH {fx.SQL_SOURCES}, {_SQL_UNIFIED}
SELECT f.path, CASE WHEN u.path IS NOT NULL THEN row_number() OVER (PARTITION BY f.path ORDER BY ordinal) END AS number,
       u.name, u.return_type, u.start_line || '–' || u.end_line AS lines,
       len(callers) > 0 OR len(callees) > 0 OR (NOT prototype AND start_line % 2 = 0) AS has_details
FROM files f LEFT JOIN unified u ON u.path = f.path""")
def function_report(spark, d):
    """Summaries for every definition that starts on an even line, empty ones for the others."""
    files = fx.sources(spark, d)
    u = settled(extract.for_graph(extract.units(files)))
    fns = settled(extract.functions(u).select("function_key", "path", "name", "return_type", "start_line", "end_line", "is_prototype", "ordinal"))
    edges = settled(graph.call_edges(graph.resolve(graph.call_sites(u), graph.directory(fns))).select("caller_key", "callee_key"))
    text = F.when(~F.col("is_prototype") & (F.col("start_line") % 2 == 0), "text").otherwise("")
    summaries = fns.select("function_key", text.alias("summary"), F.lit("").alias("summary_refined"))
    return codemap.function_report(files, fns, edges, summaries)


@query("path_tree", f"""WITH {fx.SQL_SOURCES},
segs AS (SELECT path, string_split(path, '/') AS p FROM files),
pre AS (SELECT path, p, unnest(range(1, len(p) + 1)) AS depth FROM segs)
SELECT array_to_string(p[1:depth], '/') AS prefix, array_to_string(p[1:depth - 1], '/') AS parent, p[depth] AS name,
       depth, bool_or(depth = len(p)) AS is_file, count(*) AS n_files,
       row_number() OVER (ORDER BY p[1:depth]) AS idx FROM pre GROUP BY p[1:depth], p[1:depth - 1], p[depth], depth""")
def path_tree(spark, d):
    return codemap.path_tree(fx.source_paths(spark, d))


# -- quality ------------------------------------------------------------------

@query("name_collisions", f"""WITH {fx.SQL_SOURCES}
SELECT name, count(DISTINCT path) AS n_files FROM functions WHERE NOT is_prototype
GROUP BY name HAVING count(DISTINCT path) > 1""")
def name_collisions(spark, d):
    return quality.name_collisions(extract.functions(_units(spark, d)))


@query("prototype_match", f"""WITH {fx.SQL_SOURCES}
SELECT path, name, name IN (SELECT name FROM functions WHERE NOT is_prototype) AS has_definition
FROM functions WHERE is_prototype""")
def prototype_match(spark, d):
    return quality.prototype_match(extract.functions(settled(extract.for_graph(_units(spark, d)))))


_SQL_COPIES = fx.SQL_SOURCES + """,
copied AS (
  SELECT path || '::' || name AS label, md5(snippet) AS code_hash FROM functions
  UNION ALL SELECT 'copy/' || path || '::' || name, md5(snippet) FROM functions WHERE path LIKE '%/brand1/%')"""


def _copied(spark, d):
    fns = settled(extract.functions(_units(spark, d)).select("path", "name", "code_hash"))
    copies = fns.where(F.col("path").contains("/brand1/")).withColumn("path", F.concat(F.lit("copy/"), "path"))
    return fns.unionByName(copies)


@query("duplicate_functions", f"""WITH {_SQL_COPIES}
SELECT code_hash, count(*) AS n_copies, min(label) AS first_name, coalesce(string_agg(label, '|' ORDER BY label), '') AS names
FROM copied GROUP BY code_hash HAVING count(*) > 1""")
def duplicate_functions(spark, d):
    return quality.duplicate_code(_copied(spark, d), "code_hash", text.qualified_name("path", "name"))


@query("duplicate_members", f"""WITH {_SQL_COPIES}
SELECT code_hash, label AS name, n_copies FROM (SELECT *, count(*) OVER (PARTITION BY code_hash) AS n_copies FROM copied)
WHERE n_copies > 1""")
def duplicate_members(spark, d):
    return quality.duplicate_members(_copied(spark, d), "code_hash", text.qualified_name("path", "name"))


# -- whole jobs ---------------------------------------------------------------

@query("full_analysis", f"""WITH {fx.SQL_SOURCES}, {_SQL_UNIFIED}
SELECT path, name, start_line, end_line, prototype, return_type, len(callers) AS n_callers, len(callees) AS n_callees
FROM unified""")
def full_analysis(spark, d):
    t = analysis.structure(scan.scan_table(fx.sources(spark, d)))
    return codemap.unified_functions(t["functions"], t["function_calls"]).groupBy(
        "path", "name", "start_line", "end_line", "prototype", "return_type").agg(
        F.sum("n_callers").alias("n_callers"), F.sum(F.size("callees")).alias("n_callees"))


@query("refresh_changed", f"""WITH {fx.SQL_SOURCES}
SELECT 'edge' AS kind, path, line, caller_key AS key, callee_key AS other FROM edges
UNION ALL SELECT 'function', path, start_line, function_key, md5(snippet) FROM functions""")
def refresh_changed(spark, d):
    new = scan.scan_table(settled(fx.sources(spark, d)))
    old_files = scan.scan_table(fx.old_sources(new.select("path", "content")))
    old = analysis.structure(old_files)
    old = {name: settled(rows) for name, rows in old.items()}
    t = analysis.refreshed(old, old_files, new)
    return t["function_calls"].select(
        F.lit("edge").alias("kind"), "path", "line", F.col("caller_key").alias("key"),
        F.col("callee_key").alias("other")).unionByName(t["functions"].select(
            F.lit("function").alias("kind"), "path", F.col("start_line").alias("line"),
            F.col("function_key").alias("key"), F.col("code_hash").alias("other")))


@query("changed_functions", f"""WITH {fx.SQL_SOURCES},
keyed AS (SELECT path, name, row_number() OVER (PARTITION BY path, name ORDER BY ordinal) AS occurrence,
                 string_split(path, '/')[2] AS brand, is_prototype FROM functions)
SELECT path, name, occurrence, CASE brand WHEN 'brand7' THEN 'added' ELSE 'modified' END AS change FROM keyed
WHERE brand = 'brand7' OR (brand = 'brand8' AND NOT is_prototype)
UNION ALL SELECT 'a_legacy/' || path, name, occurrence, 'deleted' FROM keyed WHERE brand = 'brand9'""")
def changed_functions(spark, d):
    new = fx.sources(spark, d)

    def hashed(files):
        fns = extract.functions(settled(extract.for_functions(extract.units(files))))
        return fns.select("path", "name", "ordinal", "code_hash")

    return snapshots.changed_functions(hashed(fx.old_sources(new)), hashed(new))
