"""Registered queries keep all files, all callers and all copies."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import quality


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    part = [(k, k, f"Brand#{k % 3 + 1}", "TIN", f"p{k}") for k in range(6)]
    spark.createDataFrame(part, "p_partkey long, p_size int, p_brand string, p_type string, p_name string").write.parquet(f"{root}/part.parquet")
    # every function calls parts 1 and 2, some twice
    calls = [(k, (c - k) % 6, 1) for k in range(6) for c in (1, 2, 2)]
    spark.createDataFrame(calls, "l_partkey long, l_suppkey long, l_orderkey long").write.parquet(f"{root}/lineitem.parquet")
    return root


def test_code_map_has_every_file(spark, tables):
    paths = {r.path for r in entry.queries()["code_map"](spark, tables).collect()}
    assert paths == {r.path for r in entry.queries()["corpus_scan"](spark, tables).collect()}
    assert any("/brand2/" in p for p in paths)


def test_unified_functions_name_all_callers(spark, tables):
    rows = {r.name: r for r in entry.queries()["unify_functions"](spark, tables).collect() if r.path.startswith("src/")}
    names = [c.split("::")[1] for c in rows["p2_2"].callers.split("|")]
    assert sorted(names) == ["p0_0", "p1_1", "p3_3", "p4_4", "p5_5"] and rows["p2_2"].n_callers == 5
    assert rows["p5_5"].callers == "" and rows["p5_5"].n_callers == 0


def test_duplicate_functions_name_all_copies(spark):
    rows = [("h1", "b"), ("h1", "a"), ("h2", "c"), ("h1", "b"), (None, "x"), (None, None)]
    df = spark.createDataFrame(rows, "code_hash string, name string")
    got = {r.code_hash: r for r in quality.duplicate_code(df, "code_hash", F.col("name")).collect()}
    assert set(got) == {"h1", None}
    assert got["h1"].names == ["a", "b", "b"] and got["h1"].n_copies == 3 and got["h1"].first_name == "a"
    assert got[None].names == ["x"] and got[None].n_copies == 2


def test_duplicate_functions_query_names_all_copies(spark, tables):
    rows = entry.queries()["duplicate_functions"](spark, tables).collect()
    assert rows and all(len(r.names.split("|")) == r.n_copies and r.names.split("|")[0] == r.first_name for r in rows)
