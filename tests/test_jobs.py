"""Folders, streams, stored tables and the whole jobs."""

import os
import random

from pyspark.sql import functions as F

from lodestone.operators import extract, packages, projects, summarize
from lodestone.plans import analysis
from lodestone.schemas import DDL
from lodestone.sources import corpus
from lodestone.sources.store import Store, upsert
from lodestone.streaming import ingest



def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def write(root, **texts):
    for name, data in texts.items():
        path = os.path.join(root, name.replace("__", "/").replace("_DOT_", "."))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())


def test_scan_folder(spark, tmp_path):
    root = str(tmp_path / "src")
    write(root, a__one_DOT_c="int f(void)\r\n{\r\n}\r\n", a__two_DOT_h=b"int \xff;", a__no_DOT_txt="x", a__NO_DOT_C="y", top_DOT_c="int x;")
    rows = {r.path: r.content for r in corpus.scan_folder(spark, root).collect()}
    assert rows == {"a/one.c": "int f(void)\n{\n}\n", "a/two.h": "int �;", "top.c": "int x;"}


def test_stream_takes_each_file_once(spark, tmp_path):
    root, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    seen = []
    for name in ("one", "two", None):
        if name:
            write(root, **{f"{name}_DOT_c": f"int {name}(void) {{ }}\n"})
        ingest.ingest(spark, root, out, mark).awaitTermination()
        seen.append(sorted(r.path for r in ingest.ingested(spark, out).collect()))
    assert seen == [["one.c"], ["one.c", "two.c"], ["one.c", "two.c"]]


def test_stream_ingest_reads_a_table_of_one_file_or_of_many(spark, tmp_path):
    from workload import state
    docs = spark.createDataFrame([(i, "text %d" % i, "en", "web", 6) for i in range(8)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "parts" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "made"))
    os.makedirs(tmp_path / "one")
    part, = (tmp_path / "made").glob("part-*.parquet")
    os.rename(part, tmp_path / "one" / "documents.parquet")
    found = [sorted(r.path for r in state.stream_ingest(spark, str(tmp_path / n)).collect()) for n in ("parts", "one")]
    assert found[0] == found[1] == sorted(f"web/en/{i}.{'ch'[i % 4]}" for i in (0, 1, 4, 5))


def test_python_files_are_parsed_once_and_by_many_tasks(spark):
    rows = [(f"lib/d{i % 7}/m{i}.py", f"def f{i}(): pass\n") for i in range(200)]
    files = spark.createDataFrame(rows, "path string, content string").coalesce(1)
    named = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(named)
    spark.conf.set(named, "false")
    try:
        assert packages.py_symbols(files).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set(named, before)
    exports = packages.package_exports(packages.py_symbols(files))
    assert "MapInPandas" not in exports._jdf.queryExecution().executedPlan().toString()
    assert {r.name for r in exports.where("kind = 'function'").collect()} == {f"f{i}" for i in range(200)}


def test_bootstrap_and_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert sorted(store.bootstrap()) == sorted(DDL) and store.bootstrap() == []
    rows = spark.createDataFrame([("p", "/p", "u", None, "s")], DDL["projects"])
    store.replace("projects", rows)
    store.append("projects", rows)
    assert store.read("projects").count() == 2
    # a rewrite may read the table it replaces
    assert store.replace("projects", store.read("projects").distinct()).count() == 1


def parquet_files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_an_upsert_writes_the_buckets_of_its_keys(spark, tmp_path):
    root = str(tmp_path / "store")
    store = Store(spark, root, buckets=8)
    store.bootstrap()
    rows = spark.range(400).select(F.concat(F.lit("k"), "id").alias("file_key"), F.lit("c").alias("commit_sha"), F.lit("old").alias("summary"),
                                   F.lit("").alias("summary_refined"))
    store.replace("file_summaries", rows)
    before = parquet_files(f"{root}/file_summaries")
    assert len(before) == 8 and store.metrics["file_summaries"]["rows"] == 400
    update = rows.where("file_key IN ('k7', 'new')").withColumn("summary", F.lit("new")).withColumn("seq", F.lit(1))
    change = store.merge("file_summaries", update, ["file_key", "commit_sha"], "seq")
    assert len(change[1]) == 1
    store.replace_all({"file_summaries": change})
    assert len(parquet_files(f"{root}/file_summaries") - before) == 1 and store.metrics["file_summaries"]["rows"] < 100
    got = {r.file_key: r.summary for r in store.read("file_summaries").collect()}
    assert got == {f"k{i}": "new" if i == 7 else "old" for i in range(400)}
    # a bucket that loses its last row is gone, the others stay
    bucket = change[1]
    store.replace_all({"file_summaries": (store.read("file_summaries", bucket).limit(0), bucket)})
    assert 300 < store.read("file_summaries").count() < 400
    # folders that no recent manifest names are removed
    for _ in range(6):
        store.replace("file_summaries", store.read("file_summaries"))
    assert not before & parquet_files(f"{root}/file_summaries")
    assert len(os.listdir(f"{root}/_manifests")) - sum(f.endswith(".crc") for f in os.listdir(f"{root}/_manifests")) == 4
    assert Store(spark, root, buckets=99).buckets == 8


def test_a_refresh_writes_the_buckets_it_touches(spark, tmp_path, files):
    root = str(tmp_path / "store")
    store = Store(spark, root, buckets=16)
    names = {f"f{i}_DOT_c": f"int f{i}(void) {{ f{(i + 1) % 60}(); }}\n" for i in range(60)}
    analysis.full_analysis(store, corpus.with_hash(files(**names)), "c1", now(), with_functions=False)
    before = parquet_files(root)
    new = corpus.with_hash(files(**dict(names, f3_DOT_c="\nint f3(void) { f4(); f9(); }\n")))
    analysis.refresh(store, new, "c2", now(), with_functions=False)
    for table in ("files", "functions", "call_sites", "file_symbols"):
        assert len(parquet_files(f"{root}/{table}") - before) <= 1, table
    assert len(parquet_files(f"{root}/function_calls") - before) <= 2  # f2 calls f3, whose place changed
    fresh = Store(spark, str(tmp_path / "fresh"))
    analysis.full_analysis(fresh, new, "c2", now(), with_functions=False)
    assert tables_of(store) == tables_of(fresh)


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", "c", 1), ("b", "c", 2)], "k string, sha string, v int")
    new = spark.createDataFrame([("a", "c", 5, 1), ("a", "c", 6, 2), ("n", "c", 7, 1)], "k string, sha string, v int, seq int")
    once = upsert(old, new, ["k", "sha"], "seq")
    twice = upsert(once, new, ["k", "sha"], "seq")
    want = [("a", "c", 6), ("b", "c", 2), ("n", "c", 7)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def one_by_one(bases, known=()):
    taken, out = set(known), []
    for base in bases:
        name, n = base, 0
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        out.append(name)
    return out


def test_unique_names_as_if_one_by_one(spark):
    for bases in (["x", "x", "y", "x"], ["x_1", "x", "x", "x"], ["x", "x_1", "x", "x_1", "x_1_1", "x", "x_2", "x"],
                  ["x", "x", "x_1", "x_1", "x", "x_2"]):
        df = spark.createDataFrame(list(enumerate(bases)), "seq bigint, base string")
        got = [r.name for r in projects.unique_names(df, "base", "seq").orderBy("seq").collect()]
        assert got == one_by_one(bases), bases


def test_unique_names_beside_a_known_registry(spark):
    for known, bases in ((["x", "x_1", "x_3", "x_4", "x_01", "y_2"], ["x", "x", "y", "x", "x", "y", "y", "y_2", "z"]),
                         (["x_1", "x_1_1"], ["x_1", "x", "x", "x_1", "x_2", "x"]), (["q"], [])):
        df = spark.createDataFrame(list(enumerate(bases)), "seq bigint, base string")
        taken = spark.createDataFrame([(n,) for n in known], "name string")
        got = [r.name for r in projects.unique_names(df, "base", "seq", taken=taken).orderBy("seq").collect()]
        assert got == one_by_one(bases, known), (known, bases)


def test_nested_stems_take_a_fixed_number_of_jobs(spark, tmp_path):
    """A chain x, x_1, x_1_1, ... of 1,000 names, each twice, and a random mix beside a known registry."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(bases, known=None):
        df = spark.createDataFrame(list(enumerate(bases)), "seq bigint, base string")
        taken = None if known is None else spark.createDataFrame([(n,) for n in known], "name string")
        group = f"names-{len(bases)}-{id(bases)}"
        spark.sparkContext.setJobGroup(group, "names")
        got = [r.name for r in projects.unique_names(df, "base", "seq", taken=taken).orderBy("seq").collect()]
        assert got == one_by_one(bases, known or ())
        return len(tracker.getJobIdsForGroup(group))

    chain = ["x" + "_1" * k for k in range(1000)]
    short = jobs(chain[:3] + chain[:3])
    assert jobs(chain + chain) <= short + 4  # the same plan; only its adaptive stages may differ
    rng = random.Random(4)
    mix = [rng.choice("xy") + "".join(f"_{rng.randrange(4)}" for _ in range(rng.randrange(4))) for _ in range(800)]
    jobs(mix, [rng.choice("xy") + "".join(f"_{rng.randrange(1, 4)}" for _ in range(rng.randrange(3))) for _ in range(20)])


def failing_on_bad(requests, options):
    if any("bad" in r.prompt for r in requests):
        raise RuntimeError("no")
    return ["S:" + r.prompt[-20:] for r in requests]


def test_failures_cost_only_themselves(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(10)], "i int, p string")
    rows = {r.i: r for r in summarize.summarize(df, ["i"], "p", failing_on_bad).collect()}
    assert rows[3].summary is None and rows[3].error == "RuntimeError: no"
    assert all(rows[i].summary == f"S:t{i}" and rows[i].error is None for i in range(10) if i != 3)


def test_open_requests_are_bounded(spark):
    """Each answer says how many batches were open in its task; order is kept."""
    class Counting:  # what a task gets: its own counter, made there
        def __call__(self, requests, options):
            import builtins
            import threading as th
            import time as clock
            shared = builtins.__dict__.setdefault("_open_requests", {"lock": th.Lock(), "open": 0})
            with shared["lock"]:
                shared["open"] += 1
                seen = shared["open"]
            clock.sleep(0.02)
            with shared["lock"]:
                shared["open"] -= 1
            return [f"{r.prompt}:{seen}" for r in requests]

    slots = spark.sparkContext.defaultParallelism
    df = spark.createDataFrame([(i, f"p{i}") for i in range(600)], "i int, p string").repartition(5)
    for allowed in (1, 3):
        assert summarize.open_per_task(spark, allowed * slots) == allowed
        rows = summarize.summarize(df, ["i"], "p", Counting(), parallelism=allowed * slots, batch=4)
        assert rows.rdd.getNumPartitions() == 5  # tasks follow the input
        got = {r.i: r.summary.split(":") for r in rows.collect()}
        assert all(got[i][0] == f"p{i}" for i in range(600))
        assert max(int(n) for _, n in got.values()) == allowed
    assert summarize.open_per_task(spark, None) == summarize.open_per_task(spark, 1) == 1


def tables_of(store):
    return {t: sorted(map(str, store.read(t).collect())) for t in ("functions", "function_calls", "file_symbols", "call_sites")}


def test_full_analysis_then_refresh(spark, tmp_path, files):
    store = Store(spark, str(tmp_path / "store"))
    first = corpus.with_hash(files(
        a_DOT_c="int f(void) { g(); }\n", b_DOT_c="int g(void) { h(); }\n", c_DOT_h="int h(void);\nint k(void);\n",
        bad_DOT_c="int bad(void) { f(); }\n"))
    cmap = analysis.full_analysis(store, first, "c1", now(), fn=failing_on_bad)
    by_path = {r.path: r for r in cmap.collect()}
    assert by_path["b.c"].functions[0].n_callers == 1 and by_path["b.c"].file_summary.startswith("S:")
    assert [(r.name, r.caller) for r in analysis.callers_view(store).where("path = 'b.c'").collect()] == [("g", "a.c::f")]
    counted = {r.stage: r.n for r in store.read("run_metrics").collect()}
    assert counted == {"files": 4, "definitions": 3, "prototypes": 2, "call_sites": 3, "edges": 3, "unprocessed_files": 4,
                       "unprocessed_functions": 5, "failed_files": 1, "failed_functions": 1}
    assert by_path["b.c"].functions[0].func_summary.startswith("S:")
    assert by_path["bad.c"].file_summary is None
    rejected = {(r.item_type, r.error) for r in store.read("rejects").collect()}
    assert rejected == {("file", "RuntimeError: no"), ("function", "RuntimeError: no")}
    # a second run only asks again for what failed
    n = store.read("status_commits").where("stage = 'summarized'").count()
    analysis.summarize_new(store, "c1", now())
    assert store.read("status_commits").where("stage = 'summarized'").count() == n + 2

    second = corpus.with_hash(files(
        a_DOT_c="int f(void) { g(); }\n", a2_DOT_c="int h(void) { k(); }\n", c_DOT_h="int h(void);\nint k(void);\n",
        z_DOT_c="\nint g(void) { f(); }\n"))
    analysis.refresh(store, second, "c2", now())
    again = Store(spark, str(tmp_path / "fresh"))
    analysis.full_analysis(again, second, "c2", now())
    assert tables_of(store) == tables_of(again)
    # only changed files are summarised for the new commit
    done = store.read("file_summaries").where("commit_sha = 'c2'").join(store.read("files"), "file_key")
    assert sorted(r.path for r in done.collect()) == ["a2.c", "z.c"]


def summaries_of(cmap):
    return {r.path: (r.file_summary, {f.name: f.func_summary for f in r.functions}) for r in cmap.collect()}


def test_refresh_keeps_summaries_of_what_did_not_change(spark, tmp_path, files):
    store = Store(spark, str(tmp_path / "store"))
    old = dict(a_DOT_c="int f(void) { g(); }\n", b_DOT_c="int g(void) { return 1; }\n", c_DOT_c="int k(void) { f(); }\n")
    before = summaries_of(analysis.full_analysis(store, corpus.with_hash(files(**old)), "c1", now()))
    new = dict(old, b_DOT_c="int g(void) { return 2; }\n")
    after = summaries_of(analysis.refresh(store, corpus.with_hash(files(**new)), "c2", now()))
    assert after["a.c"] == before["a.c"] and after["c.c"] == before["c.c"]
    assert after["b.c"][0] and after["b.c"] != before["b.c"]
    assert None not in [t for text, fns in after.values() for t in (text, *fns.values())]


def test_refresh_that_stops_between_tables_can_be_run_again(spark, tmp_path, files, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    analysis.full_analysis(store, corpus.with_hash(files(
        a_DOT_c="int f(void) { g(); }\n", b_DOT_c="int g(void) { }\n")), "c1", now())
    new = corpus.with_hash(files(a_DOT_c="int f(void) { g(); }\n", b2_DOT_c="\nint g(void) { }\n"))
    unchanged = tables_of(store)
    whole = Store._write
    written = []

    def stops(self, table, rows, buckets=None, **metrics):
        if buckets is not None:
            written.append(table)
            if len(written) > 2:
                raise RuntimeError("executor lost")
        return whole(self, table, rows, buckets, **metrics)

    with monkeypatch.context() as m:
        m.setattr(Store, "_write", stops)
        try:
            analysis.refresh(store, new, "c2", now())
        except RuntimeError:
            pass
    assert len(written) == 3 and tables_of(store) == unchanged
    got = summaries_of(analysis.refresh(store, new, "c2", now()))
    fresh = Store(spark, str(tmp_path / "fresh"))
    assert got == summaries_of(analysis.full_analysis(fresh, new, "c2", now()))
    assert tables_of(store) == tables_of(fresh)


def test_mode_without_text_fails(spark):
    import pytest
    df = spark.createDataFrame([("c",), (None,), ("asm",)], "m string")
    good = summarize.with_mode(df.where("m = 'c'"), F.col("m"), {"c": "C"}).collect()
    assert [r.system_prompt for r in good] == ["C"]
    for rows in (df.where("m is null"), df.where("m = 'asm'")):
        with pytest.raises(Exception, match="no system prompt"):
            summarize.with_mode(rows, F.col("m"), {"c": "C"}).collect()


def test_catch_up_reads_edited_files_again(spark, tmp_path):
    root, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))

    counts = {}

    def names():
        rows = ingest.catch_up(spark, root, out, mark, counts=counts)
        return sorted((r.path, r.name) for r in extract.functions(rows).collect())

    write(root, a_DOT_c="int f(void) { }\n", b_DOT_c="int g(void) { }\n")
    assert names() == [("a.c", "f"), ("b.c", "g")] and counts == {"added": 2, "edited": 0, "deleted": 0}
    write(root, a_DOT_c="int edited(void) { }\n", c_DOT_c="int h(void) { }\n")
    assert names() == [("a.c", "edited"), ("b.c", "g"), ("c.c", "h")] == names()
    os.remove(os.path.join(root, "b.c"))
    write(root, c_DOT_c="int twice(void) { return 2; }\n")
    assert names() == [("a.c", "edited"), ("c.c", "twice")] and counts == {"added": 0, "edited": 1, "deleted": 1}
    write(root, b_DOT_c="int back(void) { }\n")
    assert names() == [("a.c", "edited"), ("b.c", "back"), ("c.c", "twice")]
    # touched, or written again as it was: known by its hash
    write(root, b_DOT_c="int back(void) { }\n")
    os.utime(os.path.join(root, "a.c"))
    assert names() == [("a.c", "edited"), ("b.c", "back"), ("c.c", "twice")]
    log = sorted((r.run, r.path, r.change) for r in ingest.folder_changes(spark, out).collect())
    assert log == [(1, "a.c", "added"), (1, "b.c", "added"), (2, "a.c", "edited"), (2, "c.c", "added"), (4, "b.c", "deleted"),
                   (4, "c.c", "edited"), (5, "b.c", "added")]


def test_catch_up_after_a_listing_that_was_not_processed(spark, tmp_path):
    root, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    write(root, a_DOT_c="int f(void) { }\n", b_DOT_c="int g(void) { }\n")
    ingest._list(spark, root, out, "*.{c,h}", None)  # and the run is lost here
    os.remove(os.path.join(root, "b.c"))
    rows = ingest.catch_up(spark, root, out, mark)
    assert [r.name for r in extract.functions(rows).collect()] == ["f"]
    assert [r.name for r in extract.functions(ingest.catch_up(spark, root, out, mark)).collect()] == ["f"]


def test_paths_are_known_without_the_texts(spark, tmp_path):
    from workload import fixtures as fx
    part = [(i, i % 7, f"Brand#{i % 3}", f"TYPE{i % 2}", f"name {i}") for i in range(60)]
    lines = [(i * 997 % 200_000, i * 7 % 58, i % 11) for i in range(300)]
    spark.createDataFrame(part, "p_partkey long, p_size int, p_brand string, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    paths = fx.source_paths(spark, str(tmp_path))
    assert sorted(paths.collect()) == sorted(fx.sources(spark, str(tmp_path)).select("path").collect()) != []
    plan = paths._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "repeat(" not in plan
