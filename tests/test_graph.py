import random

from pyspark.sql import functions as F

from lodestone.operators import codemap, extract, graph
from lodestone.operators.skew import position_in_group, skewed_join
from lodestone.session import settled


def build(df):
    u = extract.units(df)
    fns = extract.functions(u)
    return fns, graph.call_sites(u), graph.directory(fns)


def test_definitions_win_and_lowest_path_wins(spark, files):
    df = files(a_DOT_h="int f(int);\nint only(void);\n", b_DOT_c="int f(int a) { only(); none(); }\n",
               c_DOT_c="int f(int a) { }\nint g(void) { f(1); f(2); g(); }\n")
    fns, sites, names = build(df)
    edges = {(r.caller_name, r.callee_name) for r in graph.call_edges(graph.resolve(sites, names)).collect()}
    assert edges == {("b.c::f", "a.h::only"), ("c.c::g", "b.c::f")}
    assert [r.callee for r in graph.unresolved(sites, names).collect()] == ["none"]
    assert [r.caller_name for r in graph.recursive_functions(graph.resolve(sites, names)).collect()] == ["c.c::g"]


def test_functions_on_one_line_and_repeated_names(spark, files):
    text = "int a(void){p();} int b(void){q();\n r(); }\nint a(void){s();}\n"
    _, sites, _ = build(files(a_DOT_c=text))
    got = {(r.callee, r.caller, r.caller_key) for r in sites.collect()}
    key = {r.callee: r.caller_key for r in sites.collect()}
    assert {(c, n) for c, n, _ in got} == {("p", "a"), ("q", "a"), ("r", "b"), ("s", "a")}
    # the second "a" counts as the first one of the file
    assert key["s"] == key["p"] == key["q"]


def test_enclosing_functions_against_brute_force(spark):
    rng = random.Random(7)
    fns, calls = [], []
    for path in ("x.c", "y.c"):
        line = 1
        for i in range(60):
            end = line + rng.choice([0, 0, 3, 90, 200])
            fns.append((path, f"f{i}", line, end, i))
            line = end + rng.choice([0, 1, 5])
        calls += [(path, rng.randrange(1, line + 5), f"c{j}") for j in range(300)]
    want = sorted((p, n, c, next(f[1] for f in fns if f[0] == p and f[2] <= n <= f[3]))
                  for p, n, c in calls if any(f[0] == p and f[2] <= n <= f[3] for f in fns))
    got = graph.enclosing_functions(
        spark.createDataFrame(calls, "path string, caller_line int, callee_name string"),
        spark.createDataFrame(fns, "path string, name string, start_line int, end_line int, ordinal int"))
    assert sorted((r.path, r.caller_line, r.callee_name, r.caller) for r in got.collect()) == want


def test_callers_in_one_layout_at_any_number(spark):
    """One callee above 50,000 callers beside small ones, sorted by range."""
    n = 60_000
    hot = spark.range(n).select(F.lit("hot").alias("callee_key"), F.format_string("f%06d", F.col("id")).alias("caller_name"))
    few = spark.createDataFrame([("cold", "b"), ("cold", "a"), ("cold", "b"), ("lone", "z")], "callee_key string, caller_name string")
    rows = settled(graph.callers(hot.unionByName(hot.limit(100)).unionByName(few)))
    assert rows.where("function_key = 'hot'").count() == n
    assert rows.where("function_key = 'hot' AND caller_name <> format_string('f%06d', position - 1)").count() == 0
    assert sorted((r.function_key, r.position, r.caller_name) for r in rows.where("function_key <> 'hot'").collect()) == [
        ("cold", 1, "a"), ("cold", 2, "b"), ("lone", 1, "z")]
    assert graph.callers(few.limit(0)).count() == 0


def test_code_map_and_its_callers(spark, files):
    body = "\n".join(f"int f{i}(void) {{ hot(); }}" for i in range(40))
    df = files(a_DOT_c="int hot(void) { cold(); }\n", b_DOT_c=body, c_DOT_h="int cold(void);\nstruct s { int a; };\n", d_DOT_c="")
    u = extract.units(df)
    fns, sites, names = build(df)
    edges = graph.call_edges(graph.resolve(sites, names))
    rows = {r.path: r for r in codemap.code_map(df, fns, extract.file_symbols(u), edges).collect()}
    assert [(f.n_callers, f.callees) for f in rows["a.c"].functions] == [(40, ["c.h::cold"])]
    assert rows["d.c"].functions == [] and [s.name for s in rows["c.h"].structs] == ["s"]
    assert [f.prototype for f in rows["c.h"].functions] == [True]
    callers = codemap.code_map_callers(fns, edges).where("path = 'a.c'").orderBy("position").collect()
    assert [(r.position, r.caller) for r in callers] == [(k + 1, c) for k, c in enumerate(sorted(f"b.c::f{i}" for i in range(40)))]
    # files that are not asked for have no row, and no record of theirs goes to another
    assert [r.path for r in codemap.code_map(df.where("path = 'a.c'"), fns, extract.file_symbols(u), edges).collect()] == ["a.c"]


def test_skewed_join_and_positions_against_brute_force(spark):
    rng = random.Random(1)
    left = [(rng.choice(["hot", "hot", "a", "b", "z"]), i) for i in range(500)]
    right = [("hot", 1), ("a", 2), ("b", 3), ("c", 4)]
    l_df, r_df = spark.createDataFrame(left, "k string, i int"), spark.createDataFrame(right, "k string, x int")
    lookup = dict(right)
    got = skewed_join(l_df, r_df, "k", "left").collect()
    assert sorted((r.k, r.i, r.x or 0) for r in got) == sorted((k, i, lookup.get(k, 0)) for k, i in left)
    placed = position_in_group(l_df, "k", "i", "n", width=7).collect()
    seen, want = {}, {}
    for k, i in left:
        want[i] = seen.get(k, 0)
        seen[k] = want[i] + 1
    assert {r.i: r.n for r in placed} == want
    sparse = l_df.withColumn("t", F.col("i").cast("bigint") * 1_000_003 - 7)
    assert {r.i: r.n for r in position_in_group(sparse, "k", "t", "n").collect()} == want
    assert position_in_group(l_df.where("i < 0"), "k", "i", "n").count() == 0


def test_a_hot_name_is_split(spark):
    """90 % of the rows on one name: adaptive execution splits them, and nothing is lost or repeated."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        sites = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id"))).alias("callee"), "id")
        fns = sites.select("callee", "id", F.lit(False).alias("is_prototype"), F.concat(F.lit("p"), F.col("id") % 5).alias("path"))
        names = graph.directory(fns.select(F.col("callee").alias("name"), "is_prototype", "path", F.col("id").alias("ordinal"),
                                           F.md5(F.col("id").cast("string").cast("binary")).alias("function_key")))
        joined = graph.resolve(sites, names)
        assert len(joined.select("id").distinct().collect()) == joined.count() == 60_000
        joined = graph.resolve(sites, names)
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan and "Generate" not in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
