"""Queries over all functions store what they read, not the texts."""

from lodestone.operators import extract
from lodestone.session import settled
from workload import structure


def stored(monkeypatch, spark, query):
    found, kept = [], structure.settled

    def settled(df):
        found.append(set(df.columns))
        return kept(df)

    monkeypatch.setattr(structure, "settled", settled)
    query(spark, "/root/testdata/sf0.001").count()
    return found


def test_members_and_declarations_store_no_texts(monkeypatch, spark):
    for query in (structure.duplicate_members, structure.declarations_outside):
        columns = stored(monkeypatch, spark, query)
        assert columns and not any(c & {"content", "text", "body", "snippet"} for c in columns)


def test_texts_of_functions_are_stored_once(monkeypatch, spark):
    """Head and body stand in the snippet already, and symbols need those with a struct or a typedef alone."""
    kept, tables = structure.settled, []

    def settled(df):
        tables.append(kept(df))
        return tables[-1]

    monkeypatch.setattr(structure, "settled", settled)
    for query in (structure.functions_table, structure.function_parameters, structure.file_symbols, structure.file_info,
                  structure.function_report, structure.changed_functions):
        query(spark, "/root/testdata/sf0.001")
    parsed = [t for t in tables if "is_function" in t.columns]
    assert len(parsed) == 7 and not any({"content"} & set(t.columns) for t in tables)
    assert not any(t.where("is_function AND (text IS NOT NULL OR body IS NOT NULL)").count() for t in parsed)


def test_lean_tables_have_the_same_symbols(spark):
    text = ("struct a { int x; };\nint f(struct a *p) {\n  struct b { int y; } z;\n  return 1;\n}\nint g(void) {\n  typedef int t;\n  return 2;\n}\n"
            "int h(void) { return g(); }\nint v;\ntypedef struct { int q; } c;\n")
    files = spark.createDataFrame([("a.c", text), ("b.h", "int p(void);\n" + text), ("c.c", None), (None, text)], "path string, content string")
    u = settled(extract.units(files))
    want = sorted(map(str, extract.file_symbols(u).collect()))
    assert len(want) == 18
    for narrow in (extract.lean, extract.for_symbols):
        assert sorted(map(str, extract.file_symbols(settled(narrow(u))).collect())) == want
    fns = sorted(map(str, extract.functions(u).collect()))
    for narrow in (extract.lean, extract.for_functions):
        assert sorted(map(str, extract.functions(settled(narrow(u))).collect())) == fns
