"""Kinds of pieces from their bytes against the patterns that define them, and work in runs."""

import random
import re

import pyarrow as pa

from lodestone.functions import segments as sg

SINGLE = {"(": sg.LPAR, ")": sg.RPAR, ";": sg.SEMI, "{": sg.OPEN, "}": sg.CLOSE}
END = r"[\r\x85  ]?\Z"  # a line terminator may follow


def kind(p):
    """One piece by the patterns."""
    def has(pattern):
        return re.search(pattern, p, re.A) is not None

    if p in SINGLE:
        return SINGLE[p]
    directive = (sg.IF if has(r"^[ \t]*#[ \t]*if") else sg.ELSE if has(r"^[ \t]*#[ \t]*el")
                 else sg.ENDIF if has(r"^[ \t]*#[ \t]*endif") else sg.TRIVIA)
    if "\n" in p:
        return sg.KINDS * p.count("\n") + (sg.LITERAL if p[0] in "\"'" else directive if p.lstrip(" ").startswith("#") else sg.TRIVIA)
    if p.startswith(("/*", "//")):
        return sg.TRIVIA
    if p[:1] in ("'", '"'):
        return sg.LITERAL
    if p.lstrip(" ").startswith("#"):
        return directive
    worded = sg.WORDED if has(r"^[ \t]*[A-Za-z_]") else 0
    if has(rf"[A-Za-z0-9_][ \t]*{END}"):
        if has(rf"^[ \t]*[A-Za-z_]\w*[ \t]*{END}"):
            return sg.BARE + sg.WORDED
        if has(rf"(?:\.|->)[ \t]*[A-Za-z_]\w*[ \t]*{END}"):
            return sg.MEMBER
        return sg.IDENT + worded if has(rf"(?<!\w)[A-Za-z_]\w*[ \t]*{END}") else sg.TEXT
    if has(rf"^[ \t\r\f\x0b]*{END}"):
        return sg.TRIVIA
    return sg.ARROW if has(rf"(?:\.|->)[ \t]*{END}") else sg.TEXT + worded


def test_kinds_of_pieces():
    r = random.Random(3)
    atoms = [*"(){};\"'/#ab_09 \t\n\r\f\x0b.->*,=", "\u0085", " ", " ", "é", "->", "#if", "#  el", "# endif", "/*", "//", "ab1", " .", "-> "]
    words = ["x", "1", ".", "->", " ", "\t", "\r", " ", "_", "-", ">"]
    pieces = ["".join(r.choice(a) for _ in range(r.randrange(1, 9))) for a in (atoms, words) for _ in range(8000)] + list(SINGLE)
    assert sg.piece_codes(pa.array(pieces, pa.large_string())).tolist() == [kind(p) for p in pieces]


def test_a_batch_is_worked_off_in_runs(monkeypatch):
    monkeypatch.setattr(sg, "RUN", 5)
    lists = pa.array([["("], [], None, ["(", "a", ")", "b", "(", "c", "]"], ["{", "["], ["x"]], pa.list_(pa.string()))
    seen = []

    def work(some):
        seen.append(sum(len(x or []) for x in some.to_pylist()))
        return sg.depths_of(some)

    got = sg.in_runs(work, lists)
    assert got.to_pylist() == sg.depths_of(lists).to_pylist() == [[0], [], [], [0, 1, 1, 0, 0, 1, 1], [0, 1], [0]]
    assert max(seen) == 7 and sum(seen) == 11 and len(seen) > 2
    assert sg.in_runs(sg.depths_of, lists.slice(3, 2)).to_pylist() == [[0, 1, 1, 0, 0, 1, 1], [0, 1]]


def test_files_without_text_or_units(spark):
    from lodestone.operators import extract
    rows = spark.createDataFrame([("a.c", None), ("b.c", ""), ("c.c", "int f(void) {\n g(1);\n}\n")], "path string, content string")
    assert [(r.path, r.name) for r in extract.definitions(extract.units(rows)).collect()] == [("c.c", "f")]
