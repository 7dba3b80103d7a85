"""Small C texts with the records they must give."""

import hashlib
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions.arrays import each, struct
from lodestone.functions.segments import BRACE, FLAGS, START, STOP, bracket_depth, function_head, marks_of
from lodestone.operators import extract, graph

SAMPLE = '''\
/* struct no { int a; }; */
int *gp, table[N] = {1,2,3}, (*fp)(int a), arr[3][4];
struct foo; struct foo bar, *baz = &bar;
enum color { RED, GREEN } paint;
static const struct { int x; struct inner { char c:3, d; } in; void (*cb)(int, char *); } anon[] = { {1} };
typedef int (*cmp_t)(const void *, const void *);
typedef struct tag { int a; } tag_t, *tag_p;
typedef struct { unsigned long a[3]; } *ptr_t;
DEFINE_MUTEX(lock);
__attribute__((unused)) static inline struct foo *mk(struct foo *p, int (*cb)(int x, char y), ...) __attribute__((pure));
void (*signal(int sig, void (*func)(int)))(int) { typedef int local_t; return 0; }
unsigned long f(  const char  *a /* one */, int b /* two */) { return g(a) + h (b); }
main() { x(); p->skip(); q.skip(); (*r)(); if (y) while (z()) ; }
extern "C" {
int a1 = 1, b1; float proto(int), vv;
}
int *pointer_only;
'''


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy("ordinal").collect()]


def test_functions_of_a_header(spark, files):
    u = extract.units(files(a_DOT_h=SAMPLE))
    got = rows(extract.functions(u), "name", "return_type", "parameters", "start_line", "is_prototype")
    assert got == [
        ("signal", "void", ["int sig", "void (*func)(int)", "int", "int"], 11, False),
        ("f", "unsigned long", ["const char  *a", "int b"], 12, False),
        ("main", "int", [], 13, False),
        ("fp", "int", ["int a"], 2, True),
        ("mk", "static inline struct foo", ["struct foo *p", "int (*cb)(int x, char y)", "int x", "char y"], 10, True),
        ("proto", "float", ["int"], 15, True),
    ]


def test_no_prototypes_outside_of_headers(spark, files):
    u = extract.units(files(a_DOT_c=SAMPLE))
    assert extract.prototypes(u).count() == 0


def test_structs_typedefs_globals(spark, files):
    u = extract.units(files(a_DOT_c=SAMPLE))
    assert rows(extract.structs(u), "name", "fields") == [
        ("<anonymous>", ["int x", "struct inner in", "void cb"]), ("inner", ["char c", "char d"]),
        ("tag", ["int a"]), ("ptr_t", ["unsigned long a"])]
    assert rows(extract.typedefs(u), "alias", "original") == [
        ("cmp_t", "int"), ("tag_t", "<complex type>"), ("tag_p", "<complex type>"), ("ptr_t", "<complex type>"), ("local_t", "int")]
    assert rows(extract.globals_(u), "name", "type") == [
        ("gp", "int"), ("table", "int"), ("fp", "int"), ("arr", "int"), ("bar", "struct foo"), ("baz", "struct foo"),
        ("paint", "enum color"), ("anon", "static const struct"), ("a1", "int"), ("b1", "int"), ("vv", "float"),
        ("pointer_only", "int")]


def test_calls(spark, files):
    got = extract.calls(extract.units(files(a_DOT_c=SAMPLE))).collect()
    assert sorted((r.caller_line, r.callee_name) for r in got) == [(12, "g"), (12, "h"), (13, "x"), (13, "z")]


def test_calls_over_lines_and_decoys(spark, files):
    text = '''#define M(x) { \\
   no(x)
/* no() { */
int f(void)
{
    s = "no( {"; c = '{'; // no(1) }
    p->
       no(1);
    yes /* here */
      (2);
#if no(3) {
    also(4);
#endif
}
'''
    u = extract.units(files(a_DOT_c=text))
    assert [(r.start_line, r.end_line) for r in u.collect()] == [(4, 14)]
    assert [(r.caller_line, r.callee_name) for r in extract.calls(u).collect()] == [(9, "yes"), (12, "also")]


def test_empty_and_broken_files(spark, files):
    df = files(empty_DOT_c="", directives_DOT_c="#include <a>\n#define B {\n", open_DOT_c="int f(void) { g();\n",
               close_DOT_c="} int f(void) { g(); }\n")
    u = extract.units(df)
    assert [(r.path, r.is_function) for r in u.collect()] == [("close.c", True)]
    assert [tuple(r) for r in extract.file_quality(df).collect()] == [("open.c", 0, 1)]


def test_long_comment_and_literal_do_not_overflow(spark, files):
    text = "/*" + "x*y\n" * 100_000 + "*/\nchar *s = \"" + "\\\"a" * 100_000 + "\";\nint f(void) { g(); }\n// " + "\\\n" * 50_000
    u = extract.units(files(a_DOT_c=text))
    assert [(r.name, r.start_line) for r in extract.functions(u).collect()] == [("f", 100_003)]
    assert [r.name for r in extract.globals_(u).collect()] == ["s"]


def test_snippet_and_hash_take_whole_lines(spark, files):
    u = extract.units(files(a_DOT_c="int x; int f(void) {\n} int y;\n"))
    row = extract.functions(u).collect()[0]
    assert row.code_snippet == "int x; int f(void) {\n} int y;\n"
    assert row.code_hash == hashlib.md5(row.code_snippet.encode()).hexdigest()


def test_marks_against_brute_force():
    rng = random.Random(3)
    lists = []
    for size in (0, 1, 40, 300):
        depth, codes = rng.choice([0, -2]), []
        for _ in range(size):
            codes.append(depth * FLAGS + rng.choice([0, 0, START, STOP, BRACE]))
            depth += rng.choice([-1, 0, 0, 1])
        lists.append(codes)

    def after(codes, at, depth, flag):
        return next((j for j in range(at + 1, len(codes)) if codes[j] // FLAGS == depth and codes[j] % FLAGS & flag), None)

    want = []
    for codes in lists:
        rows = []
        for i in (i for i, c in enumerate(codes) if c % FLAGS & START):
            k = after(codes, i, codes[i] // FLAGS, STOP)
            rows.append({"i": i, "k": k, "e": None if k is None else after(codes, k, codes[i] // FLAGS + 1, BRACE)})
        want.append(rows)
    assert marks_of(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == want
    assert marks_of(pa.array([], pa.list_(pa.int32()))).to_pylist() == []


def test_a_large_unit_takes_seconds(spark, files):
    body = "".join(f"struct foo *p{i} = get({i}, x + y);\n" for i in range(8000))  # about 100,000 tokens
    u = extract.units(files(a_DOT_c="struct foo *f(int a) {\nstruct own { int a; } o; typedef int t, u;\n" + body + "}\n"))
    start = time.time()
    assert [(r.name, r.fields) for r in extract.structs(u).collect()] == [("own", ["int a"])]
    assert [r.alias for r in extract.typedefs(u).collect()] == ["t", "u"]
    assert time.time() - start < 60


def test_conditional_arms(spark, files):
    text = """#ifdef X
int f(int a) {
#else
int f(long a) {
#endif
    g(1);
}
int h(int a,
#if A
  int b)
#else
  long b)
#endif
{
    if (a) {
#ifdef B
        k(1); }
#else
        k(2);
    }
#endif
    m();
}
#if defined(C)
int both(void) { return 1; }
#else
long both(void) { return 2; }
#endif
#ifdef __cplusplus
extern "C" {
#endif
static int n
#ifdef D
 = 1
#else
 = 2
#endif
;
int last(void) { q(); }
#else
#endif
#endif
int after(void) { r(); }
"""
    u = extract.units(files(a_DOT_c=text))
    got = rows(extract.functions(u), "name", "return_type", "parameters", "start_line", "end_line")
    assert got == [("f", "int", ["int a"], 2, 7), ("h", "int", ["int a", "int b"], 8, 23), ("both", "int", ["void"], 25, 25),
                   ("both", "long", ["void"], 27, 27), ("last", "int", ["void"], 39, 39), ("after", "int", ["void"], 43, 43)]
    assert sorted((r.caller_line, r.callee_name) for r in extract.calls(u).collect()) == [
        (6, "g"), (17, "k"), (19, "k"), (22, "m"), (39, "q"), (43, "r")]
    assert rows(extract.globals_(u), "name", "type") == [("n", "static int")]
    assert extract.file_quality(files(a_DOT_c=text)).count() == 0


def test_old_style_definitions(spark, files):
    text = """int add(a, b) int a; int b; {
    return g(a) + b;
}
static char *
cat(s, n, cb)
    register char *s, **t;
    int (*cb)();
    struct pair n[2];
{ h(); }
int plain;
main(argc, argv)
int argc; char *argv[];
{
    if (argc) { p(); }
}
MACRO(a);
int f(int a) { k(a); }
void none() { }
"""
    u = extract.units(files(a_DOT_c=text))
    assert rows(extract.functions(u), "name", "return_type", "parameters", "start_line", "end_line") == [
        ("add", "int", ["int a", "int b"], 1, 3), ("cat", "static char", ["register char *s", "register char **t", "int (*cb)()", "struct pair n[2]"], 4, 9),
        ("main", "int", ["int argc", "char *argv[]"], 11, 15), ("f", "int", ["int a"], 17, 17), ("none", "void", [], 18, 18)]
    assert rows(extract.globals_(u), "name", "type") == [("plain", "int")]
    assert sorted((r.caller_line, r.callee_name) for r in extract.calls(u).collect()) == [(2, "g"), (9, "h"), (14, "p"), (17, "k")]


def test_heads_declare_what_the_declarator_says(spark):
    """All heads of a batch at once against the SQL macro, on random tokens."""
    rng = random.Random(5)
    words = ["int", "f", "g", "struct", "enum", "*", "*", "(", "(", ")", ")", "[", "]", "=", ":", ",", "{", "}", "__attribute__", "9", "\u00e9", "_x"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randrange(14))]) for i in range(4000)] + [(4000, None)]
    df = spark.createDataFrame(rows, "id int, tok array<string>").withColumns({
        "depth": bracket_depth(F.expr("coalesce(tok, array())")), "head": function_head(F.expr("coalesce(tok, array())"))})
    df = df.withColumn("z", F.expr(each("coalesce(tok, array())", lambda t, i: struct(i=i, t=t, d=f"get(depth, {i})"))))
    found = df.withColumn("d", F.expr(extract._declarator("z", "0"))).selectExpr(
        "id", "head.depth = depth AS depths", "struct(head.name, head.at, head.type) AS got", "struct(d.name, d.at, d.type) AS want").collect()
    assert len(found) == 4001 and all(r.depths and tuple(r.got) == tuple(r.want) for r in found)
    assert sum(r.want.name is not None for r in found) > 500


def test_the_parse_for_the_graph_has_the_same_functions_and_calls(spark, files):
    u = extract.units(files(a_DOT_c="struct s { int a; };\nint f(void) { g(1); } int g(int a) { f(); }\n", b_DOT_h="int g(int a);\nint v;\n"))
    small = extract.for_graph(u)
    columns = ["function_key", "path", "name", "return_type", "start_line", "end_line", "is_prototype", "ordinal"]

    def rows(df):
        return sorted(map(tuple, df.collect()))

    assert rows(extract.functions(small).select(columns)) == rows(extract.functions(u).select(columns)) != []
    assert rows(graph.call_sites(small)) == rows(graph.call_sites(u)) != []
    assert small.where("body IS NOT NULL OR snippet IS NOT NULL").count() == 0 and small.count() == u.count() - 1
