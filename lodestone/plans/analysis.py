"""Full analysis and refresh as jobs over stored tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import settled
from lodestone.operators import codemap, extract, graph, snapshots, status, summarize
from lodestone.operators.skew import skewed_join
from lodestone.sources.store import Store

REFRESHED = ["files", "file_symbols", "functions", "call_sites", "function_calls"]


def edges_of(sites: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of function_calls: one per resolved call site that is no self call."""
    return graph.resolve(sites, names).where("caller_key <> callee_key").select(
        "path", "line", "caller_key", "caller_name", "callee", "callee_key", "callee_name")


def structure(files: DataFrame, keep: Callable[[DataFrame], DataFrame] = settled) -> dict[str, DataFrame]:
    """All structure tables of a corpus, derived from one parsed table that ``keep`` stores."""
    u = keep(extract.units(files))
    fns = keep(extract.functions(u))
    sites = graph.call_sites(u)
    return {"file_symbols": extract.file_symbols(u), "functions": fns, "call_sites": sites,
            "function_calls": edges_of(sites, graph.directory(fns))}


def full_analysis(store: Store, files: DataFrame, commit_sha: str, now: Column,
                  with_functions: bool = True, **how) -> DataFrame:
    """Parse a snapshot, resolve its calls, summarise what is new, return the code map.

    The parsed units are stored first: every table below reads them instead of
    the text, and a lost executor repeats no parsing.  Counts per stage are observed while
    the tables are written (A8, ``run_metrics``).
    """
    store.bootstrap()
    store.replace("files", files)
    files = store.read("files")
    u = store.replace("units", extract.units(files))
    store.replace("file_symbols", extract.file_symbols(u))
    fns = store.replace("functions", extract.functions(u), **_kinds())
    sites = store.replace("call_sites", graph.call_sites(u))
    store.replace("function_calls", edges_of(sites, graph.directory(fns)))
    parsed = status.marks(files, "file", "file_key", status.PARSED, commit_sha, now).unionByName(
        status.marks(fns, "function", "function_key", status.PARSED, commit_sha, now))
    store.replace_all(_recorded(store, parsed))
    summarize_new(store, commit_sha, now, with_functions, **how)
    record_metrics(store, commit_sha, now)
    return view(store, commit_sha)


def _kinds() -> dict[str, Column]:
    """What is counted of functions while they are written."""
    return {"definitions": F.count_if(F.expr("NOT is_prototype")), "prototypes": F.count_if(F.col("is_prototype"))}


def stage_metrics(store: Store) -> dict[str, int]:
    """Counts of the stages that this store object has written (A8), without another read of any table."""
    seen = store.metrics
    found = {"files": ("files", "rows"), "definitions": ("functions", "definitions"), "prototypes": ("functions", "prototypes"),
             "call_sites": ("call_sites", "rows"), "edges": ("function_calls", "rows"), "unprocessed_files": ("first_pass_files", "rows"),
             "unprocessed_functions": ("first_pass_functions", "rows"), "failed_files": ("second_pass_files", "failed"),
             "failed_functions": ("second_pass_functions", "failed")}
    return {stage: int(seen[table][name] or 0) for stage, (table, name) in found.items() if table in seen and name in seen[table]}


def record_metrics(store: Store, commit_sha: str, now: Column) -> None:
    rows = store.spark.createDataFrame(list(stage_metrics(store).items()), "stage string, n bigint").select(
        F.lit(commit_sha).alias("commit_sha"), "stage", "n", now.alias("recorded_at"), F.lit(0).alias("_seq"))
    store.replace_all({"run_metrics": store.merge("run_metrics", rows, ["commit_sha", "stage"], "_seq")})


def _recorded(store: Store, marks: DataFrame) -> dict[str, tuple[DataFrame, list[int]]]:
    buckets = store.touched(marks.select("item_key"))
    return {"status_items": (status.merge_items(store.read("status_items", buckets), marks), buckets),
            "status_commits": (status.merge_commits(store.read("status_commits", buckets), marks), buckets)}


def summarize_new(store: Store, commit_sha: str, now: Column, with_functions: bool = True,
                  carry: bool = False, **how) -> None:
    """Summaries of files and functions that have none at the commit; with ``carry`` also
    a summary of the same text from another commit will do.  Failures stay unprocessed
    and are listed in ``rejects``."""
    def chosen(table: str, key: str) -> DataFrame:
        rows = store.read(table)
        return rows.join(_carried(store, key), key, "left_anti") if carry else rows

    def settle(item: str):
        return lambda rows: store.replace(f"first_pass_{item}", rows)

    def second(item: str, rows: DataFrame) -> DataFrame:
        return store.replace(f"second_pass_{item}", rows, failed=F.count("error"))

    files = status.unprocessed(chosen("files", "file_key"), "file_key", store.read("status_commits"), "file",
                               commit_sha, status.SUMMARIZED)
    done = second("files", summarize.summarize_files(files, store.read("file_symbols"), commit_sha, settle("files"), **how))
    _accept(store, done, "file", "file_key", "file_summaries", commit_sha, now)
    if with_functions:
        fns = status.unprocessed(chosen("functions", "function_key"), "function_key", store.read("status_commits"),
                                 "function", commit_sha, status.SUMMARIZED)
        done = second("functions", summarize.summarize_functions(
            fns.dropDuplicates(["function_key"]), commit_sha, settle("functions"), **how))
        _accept(store, done, "function", "function_key", "function_summaries", commit_sha, now)


def _accept(store: Store, done: DataFrame, item_type: str, key: str, table: str, commit_sha: str,
            now: Column) -> None:
    good = done.where("error is null").drop("error").withColumn("_seq", F.lit(0))
    bad = done.where("error is not null").select(
        F.lit(item_type).alias("item_type"), F.col(key).alias("item_key"), "commit_sha", "error")
    basis = good.select(F.col(key).alias("item_key"), "commit_sha", "_seq").join(
        _texts(store, key).withColumnRenamed(key, "item_key"), "item_key").withColumn("summarized_at", now)
    store.replace_all({
        table: store.merge(table, good, [key, "commit_sha"], "_seq"),
        "summary_basis": store.merge("summary_basis", basis.select(
            F.lit(item_type).alias("item_type"), "item_key", "commit_sha", "text_hash", "summarized_at", "_seq"),
            ["item_type", "item_key", "commit_sha"], "_seq"),
        "rejects": store.merge("rejects", bad.withColumn("_seq", F.lit(0)), ["item_type", "item_key", "commit_sha"], "_seq"),
        **_recorded(store, status.marks(good, item_type, key, status.SUMMARIZED, commit_sha, now))})


def _texts(store: Store, key: str) -> DataFrame:
    """The hash of each item's present text: key, text_hash."""
    table, text = ("files", "content_hash") if key == "file_key" else ("functions", "code_hash")
    return store.read(table).groupBy(key).agg(F.min(text).alias("text_hash"))


def _carried(store: Store, key: str) -> DataFrame:
    """Items with a summary of their present text, and the last commit that has it."""
    basis = store.read("summary_basis").where(F.col("item_type") == key.removesuffix("_key"))
    return (basis.withColumnRenamed("item_key", key).join(_texts(store, key), [key, "text_hash"])
            .groupBy(key).agg(F.max(F.struct("summarized_at", "commit_sha"))["commit_sha"].alias("commit_sha")))


def _summaries(store: Store, table: str, key: str, commit_sha: str) -> DataFrame:
    """Summaries of the commit; items that have none keep that of the same text elsewhere."""
    stored = store.read(table)
    own = stored.where(F.col("commit_sha") == commit_sha)
    kept = _carried(store, key).join(own.select(key), key, "left_anti")
    return own.unionByName(stored.join(kept, [key, "commit_sha"], "left_semi"))


def view(store: Store, commit_sha: str) -> DataFrame:
    """The code map with the summaries of one commit, and those of texts unchanged at it."""
    files = store.read("files")
    file_text = _summaries(store, "file_summaries", "file_key", commit_sha).join(
        files.select("file_key", "path"), "file_key")
    fn_text = _summaries(store, "function_summaries", "function_key", commit_sha)
    return codemap.code_map(files, store.read("functions"), store.read("file_symbols"),
                            store.read("function_calls"), file_text, fn_text)


def callers_view(store: Store) -> DataFrame:
    """The callers of every record of :func:`view`."""
    return codemap.code_map_callers(store.read("functions"), store.read("function_calls"))


class Changes(NamedTuple):
    """What a new snapshot does to the stored tables.

    ``touched`` (path) files are new, gone or different; ``moved`` (callee) names stand for another function now;
    ``fresh`` has per table the rows that come in.
    """
    touched: DataFrame
    moved: DataFrame
    fresh: dict[str, DataFrame]

    def applied(self, table: str, old: DataFrame) -> DataFrame:
        """``old``, the table or some of its buckets, without what is stale, and all that is fresh."""
        kept = old.join(self.touched, "path", "left_anti")
        if table == "function_calls":
            marked = skewed_join(kept, self.moved.withColumn("_moved", F.lit(True)), "callee", "left")
            kept = marked.where("_moved is null").drop("_moved")
        return kept.select(*old.columns).unionByName(self.fresh[table].select(*old.columns))


def changes(old: dict[str, DataFrame], old_files: DataFrame, new_files: DataFrame,
            keep: Callable[[DataFrame], DataFrame] = settled) -> Changes:
    """Parse the changed files and look up again the sites whose file or callee changed.

    Only names that a changed file has or had can stand for another function, and only names that are called from sites to
    look up are needed, so the functions of these names alone are ranked.
    """
    listed = snapshots.changed_files(old_files, new_files)
    touched = settled(listed.select("path"))
    parse = new_files.join(snapshots.files_to_refresh(listed).select("path"), "path", "left_semi")
    u = keep(extract.units(parse))
    fresh = settled(extract.functions(u))
    columns = ["name", "is_prototype", "path", "ordinal", "function_key"]
    before = old["functions"].select(*columns)
    after = before.join(touched, "path", "left_anti").unionByName(fresh.select(*columns))
    names = settled(before.join(touched, "path", "left_semi").select("name").union(fresh.select("name")).distinct())

    def standing(functions: DataFrame, among: DataFrame) -> DataFrame:
        return graph.directory(skewed_join(functions, among, "name", "left_semi"))

    moved = settled(standing(before, names).select("callee", F.col("callee_key").alias("_old"))
                    .join(standing(after, names).select("callee", F.col("callee_key").alias("_new")), "callee", "full_outer")
                    .where(~F.col("_old").eqNullSafe(F.col("_new"))).select("callee"))
    new_sites = settled(graph.call_sites(u))
    kept_sites = old["call_sites"].join(touched, "path", "left_anti")
    again = settled(new_sites.unionByName(skewed_join(kept_sites, moved, "callee", "left_semi").select(*new_sites.columns)))
    called = again.select(F.col("callee").alias("name")).distinct()
    return Changes(touched, moved, {
        "functions": fresh, "file_symbols": extract.file_symbols(u), "call_sites": new_sites,
        "function_calls": settled(edges_of(again, standing(after, called)))})


def refreshed(old: dict[str, DataFrame], old_files: DataFrame, new_files: DataFrame,
              keep: Callable[[DataFrame], DataFrame] = settled) -> dict[str, DataFrame]:
    """Structure tables of the new snapshot from those of the old one."""
    found = changes(old, old_files, new_files, keep)
    return {table: found.applied(table, old[table]) for table in found.fresh}


def refresh(store: Store, new_files: DataFrame, commit_sha: str, now: Column,
            with_functions: bool = True, **how) -> DataFrame:
    """Bring the stored tables to a new snapshot and summarise what changed.

    Only buckets that hold a changed file, or an edge to a name that stands for another function now,
    are written.  All structure tables change in one step, so a run that stops before it starts again
    from the old ones, and one that stops after it goes on with the summaries.
    """
    store.bootstrap()
    old = {t: store.read(t) for t in REFRESHED}
    found = changes(old, old["files"], new_files, lambda u: store.replace("units_changed", u))
    buckets = store.touched(found.touched)
    stale = skewed_join(old["call_sites"].select("path", "callee"), found.moved, "callee", "left_semi").select("path")
    of_edges = store.touched(found.touched, stale)
    tables = {t: (found.applied(t, store.read(t, b)), b)
              for t in found.fresh for b in [of_edges if t == "function_calls" else buckets]}
    store.replace_all({**tables, "files": (new_files, buckets)}, {"functions": _kinds()})
    parsed = status.marks(store.read("files"), "file", "file_key", status.PARSED, commit_sha, now).unionByName(
        status.marks(store.read("functions"), "function", "function_key", status.PARSED, commit_sha, now))
    store.replace_all(_recorded(store, parsed))
    summarize_new(store, commit_sha, now, with_functions, carry=True, **how)
    record_metrics(store, commit_sha, now)
    return view(store, commit_sha)
