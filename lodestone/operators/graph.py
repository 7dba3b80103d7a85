"""The call graph: call sites -> callers and callees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.arrays import struct, those
from lodestone.operators.extract import each_entry, function_key
from lodestone.operators.order import ranked
from lodestone.operators.skew import counted_join, skewed_join
from lodestone.session import settled


def directory(functions: DataFrame) -> DataFrame:
    """The function a name stands for: definitions before prototypes, then path
    and position (J3).  One row per name, ranked before any call joins it."""
    best = Window.partitionBy("name").orderBy("is_prototype", "path", "ordinal")
    return (functions.select("name", "is_prototype", "path", "ordinal", "function_key")
            .withColumn("rn", F.row_number().over(best)).where("rn = 1")
            .select(F.col("name").alias("callee"), F.col("function_key").alias("callee_key"),
                    F.concat("path", F.lit("::"), "name").alias("callee_name")))


def call_sites(u: DataFrame) -> DataFrame:
    """Call sites with the function each belongs to (J1 and J2 in one pass).

    A call belongs to the first function whose lines hold it, and that to the
    first function of its file with the same name.  Both only concern rows of
    one file.  Columns: path, caller, caller_key, caller_name, line, callee.

    ``u`` is read twice and should be stored: hashes of (path, name) tell which names a file has more than
    once, and only functions of these are brought together.
    """
    key = function_key("path", "name", "start_line", "end_line", "false")
    own = struct(caller="name", me=struct(ordinal="unit", key=key), calls=those("calls", lambda c: f"NOT {c}.shared"))
    # Functions that share a line: the calls there go to the first of them.
    other = struct(caller="cover_name", me="CAST(NULL AS struct<ordinal:int,key:string>)",
                   calls=those("calls", lambda c: f"{c}.shared"))
    fns = u.where("is_function")
    rows = each_entry(fns, those(f"array({own}, {other})", lambda r: f"{r}.caller IS NOT NULL"), "r", "path")
    rows = rows.selectExpr("path", "r.caller AS caller", "r.me AS me", "r.calls AS calls")
    pair = F.xxhash64("path", "caller").alias("_pair")
    callers = fns.selectExpr("path", "name AS caller").unionByName(fns.selectExpr("path", "cover_name AS caller"))
    several = settled(callers.where("caller IS NOT NULL").groupBy(pair).agg(F.count("*").alias("n")).where("n > 1").select("_pair"))
    marked = counted_join(rows.withColumn("_pair", pair), several.withColumn("_several", F.lit(True)), "_pair", "left")
    alone = marked.where("_several IS NULL").selectExpr("path", "caller", "me.key AS caller_key", "calls")
    # min over the struct: the lowest position wins
    first = F.min("me").over(Window.partitionBy("path", "caller"))
    rows = alone.unionByName(marked.where("_several").select("path", "caller", first["key"].alias("caller_key"), "calls"))
    return each_entry(rows, "calls", "c", "path", "caller", "caller_key").selectExpr(
        "path", "caller", "caller_key", "concat(path, '::', caller) AS caller_name", "c.line AS line",
        "c.name AS callee")


def resolve(sites: DataFrame, names: DataFrame) -> DataFrame:
    """Call sites whose callee is known.  The names are stored first, so that their number is known."""
    return counted_join(sites, settled(names), "callee")


def unresolved(sites: DataFrame, names: DataFrame) -> DataFrame:
    """Call sites to names that no file declares."""
    known = counted_join(sites, settled(names.select("callee", F.lit(True).alias("known"))), "callee", "left")
    return known.where("known is null").drop("known")


EDGE_COLUMNS = ["caller_key", "callee_key", "caller_name", "callee_name"]


def call_edges(resolved: DataFrame) -> DataFrame:
    """One row per call site, without self calls."""
    return resolved.where("caller_key <> callee_key").select(*EDGE_COLUMNS)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per (caller, callee) with its number of call sites."""
    return edges.groupBy("caller_key", "callee_key").agg(
        F.first("caller_name").alias("caller_name"), F.first("callee_name").alias("callee_name"),
        F.count("*").alias("n_sites"))


def recursive_functions(resolved: DataFrame) -> DataFrame:
    """Functions that call themselves; the graph leaves these edges out."""
    return resolved.where("caller_key = callee_key").select("caller_key", "caller_name").distinct()


def enclosing_functions(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """J1 for any call table: the first function with start <= line <= end.

    Both sides are cut into blocks of lines, so that the join is on (path,
    block) and a file with many functions does not pair all of them with all
    of its calls.
    """
    block = 64
    spans = functions.select(
        "path", F.col("name").alias("caller"), "start_line", "end_line", "ordinal",
        F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))
                  ).alias("_block"))
    site = calls.select("path", "caller_line", "callee_name",
                        F.floor(F.col("caller_line") / block).alias("_block"))
    hits = site.join(spans, (site["path"] == spans["path"]) & (site["_block"] == spans["_block"])
                     & site["caller_line"].between(spans["start_line"], spans["end_line"])).select(
        site["path"], "caller_line", "callee_name", "caller", "ordinal", "start_line", "end_line")
    # Sites of one line have the same enclosing function: pick it per line.
    first = Window.partitionBy("path", "caller_line")
    return hits.withColumn("_first", F.min("ordinal").over(first)).where("ordinal = _first").drop("_first")


def qualified_edges(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges of any table with the names of both ends; edges with an unknown end go."""
    names = functions.select("function_key", F.concat("path", F.lit("::"), "name").alias("n")).dropDuplicates(
        ["function_key"])
    callers = names.select(F.col("function_key").alias("caller_key"), F.col("n").alias("caller_name"))
    callees = names.select(F.col("function_key").alias("callee_key"), F.col("n").alias("callee_name"))
    known = skewed_join(edges.select("caller_key", "callee_key"), callers, "caller_key", large=True)
    return skewed_join(known, callees, "callee_key", large=True).select(*EDGE_COLUMNS)


def valid_edges(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    keys = functions.select("function_key").distinct()
    kept = skewed_join(edges, keys.withColumnRenamed("function_key", "caller_key"), "caller_key", "left_semi", large=True)
    return skewed_join(kept, keys.withColumnRenamed("function_key", "callee_key"), "callee_key", "left_semi", large=True)


def callers(edges: DataFrame) -> DataFrame:
    """Who calls each function: function_key, position (from 1, by name), caller_name (A1).

    One row per caller, whatever their number: the pairs are sorted by range, so a function that
    everything calls is spread over as many tasks as its callers need.
    """
    pairs = edges.select(F.col("callee_key").alias("function_key"), "caller_name").distinct()
    placed = settled(ranked(pairs, F.col("function_key"), F.col("caller_name"), out="_rank"))
    first = placed.groupBy("function_key").agg(F.min("_rank").alias("_first"))
    return skewed_join(placed, first, "function_key", large=True).select(
        "function_key", (F.col("_rank") - F.col("_first") + 1).alias("position"), "caller_name")


def caller_counts(edges: DataFrame) -> DataFrame:
    """Number of distinct callers of each function that has any: function_key, n_callers."""
    return (edges.select(F.col("callee_key").alias("function_key"), "caller_name").distinct()
            .groupBy("function_key").agg(F.count("*").alias("n_callers")))


def caller_lists(edges: DataFrame) -> DataFrame:
    """All callers of each function that has any, in one row: function_key, callers."""
    return (edges.select(F.col("callee_key").alias("function_key"), "caller_name").distinct()
            .groupBy("function_key").agg(F.array_sort(F.collect_list("caller_name")).alias("callers")))


def callees(edges: DataFrame) -> DataFrame:
    """What each function calls: function_key, callees (A2).  Bounded by its body."""
    return (edges.select(F.col("caller_key").alias("function_key"), "callee_name").distinct()
            .groupBy("function_key").agg(F.array_sort(F.collect_list("callee_name")).alias("callees")))


def degree(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of distinct callers and callees of every function."""
    d = distinct_edges(edges)
    ends = d.select(F.col("callee_key").alias("function_key"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        d.select(F.col("caller_key").alias("function_key"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    counts = ends.groupBy("function_key").agg(F.sum("i").alias("n_callers"), F.sum("o").alias("n_callees"))
    return functions.select("function_key", "path", "name", "is_prototype").join(
        counts.hint("merge"), "function_key", "left").select(
        "path", "name", "is_prototype", F.coalesce("n_callers", F.lit(0)).cast("bigint").alias("n_callers"),
        F.coalesce("n_callees", F.lit(0)).cast("bigint").alias("n_callees"))
