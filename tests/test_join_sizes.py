"""Joins of tables that grow with the corpus gather neither side in the driver, however small their files look."""

import pytest

from lodestone.operators import codemap, extract, graph, quality, skew
from lodestone.session import settled

KEYS = "abcdefgh"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(a, b, f"f::{a}", f"f::{b}") for a in KEYS for b in KEYS if a != b]
    return settled(spark.createDataFrame(rows, "caller_key string, callee_key string, caller_name string, callee_name string"))


@pytest.fixture(scope="module")
def functions(spark):
    rows = [(k, "f", k, i, i, False, i, "int", ["void"]) for i, k in enumerate(KEYS[:-1])]
    return settled(spark.createDataFrame(rows, "function_key string, path string, name string, start_line int, end_line int, "
                                               "is_prototype boolean, ordinal int, return_type string, parameters array<string>"))


def gathered(df, capsys):
    """The joins of the plan that send a side to all tasks, without the sizes of partitions that ranks are made of."""
    capsys.readouterr()
    df.explain()
    return [line for line in capsys.readouterr().out.splitlines() if "BroadcastHashJoin" in line and "_part" not in line]


@pytest.mark.parametrize("of", [graph.qualified_edges, graph.valid_edges, quality.edge_orphans, lambda e, f: graph.degree(f, e),
                                lambda e, f: graph.callers(e)])
def test_function_keys_are_not_gathered(of, edges, functions, capsys):
    assert not gathered(of(edges, functions), capsys)


def test_records_and_callers_are_not_gathered(edges, functions, capsys, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    assert not gathered(codemap.unified_functions(functions, edges, with_callers=True), capsys)
    assert not gathered(codemap.code_map_callers(functions, edges), capsys)


def test_sites_are_never_the_gathered_side(spark, capsys, monkeypatch):
    sites = settled(spark.createDataFrame([("p", "x", "k", "n", 1, "a"), ("p", "x", "k", "n", 2, "z")],
                                          "path string, caller string, caller_key string, caller_name string, line int, callee string"))
    names = spark.createDataFrame([(k, k * 40, k * 80) for k in KEYS], "callee string, callee_key string, callee_name string")
    for rows, most in ((8, 1), (7, 0)):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", rows)
        found = graph.resolve(sites, names)
        lines = gathered(found, capsys)
        assert len(lines) == most and all("BuildRight" in line for line in lines)
        assert [(r.line, r.callee_key) for r in found.collect()] == [(1, "a" * 40)]
        assert [r.line for r in graph.unresolved(sites, names).collect()] == [2]


def test_only_names_that_a_file_has_twice_are_brought_together(spark, monkeypatch):
    """Sites of functions with one name in their file are not shuffled; of two, the first is the caller."""
    text = "int f(void) { a(1); }\nint g(void) { b(1); } int k(void) { b(2); }\nint f(void) {\n  c(1);\n}\n"
    files = spark.createDataFrame([("a.c", text), ("b.c", "int f(void) {\n  d(1);\n}\n"), (None, text)], "path string, content string")
    u = settled(extract.units(files))
    first = {(r.path, r.name): r.function_key for r in extract.functions(u).orderBy(extract.F.desc("ordinal")).collect()}
    want = [("f", "a", 1), ("f", "c", 4), ("g", "b", 2), ("g", "b", 2)]
    for rows in (skew.BROADCAST_ROWS, -1):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", rows)
        got = graph.call_sites(u).collect()
        for path in ("a.c", None):
            own = [r for r in got if r.path == path]
            assert sorted((r.caller, r.callee, r.line) for r in own) == want
            assert all(r.caller_key == first[path, r.caller] for r in own)
        assert [(r.caller, r.callee, r.caller_key) for r in got if r.path == "b.c"] == [("f", "d", first["b.c", "f"])]


def test_sites_of_distinct_names_are_not_shuffled(spark, capsys):
    files = spark.createDataFrame([("a.c", "int f(void) {\n  a(1);\n}\nint g(void) {\n  f(1);\n}\n")], "path string, content string")
    found = graph.call_sites(settled(extract.units(files)))
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    unions = plan[plan.index("Union"):]
    alone = unions[:unions.index("Window")]
    assert "Exchange hashpartitioning" not in alone and found.count() == 2
