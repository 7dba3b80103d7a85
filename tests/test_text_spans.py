"""Pieces cut from the bytes of texts against the pattern that defines them, and places of units in bytes."""

import random
import re

import numpy as np
import pyarrow as pa

from lodestone.functions import lexis
from lodestone.functions import segments as sg

ATOMS = [*"(){};\"'/#ab_09 \t\n\f\x0b.->*,=\\", "é", " x", "#if", "  #if x\n", "\n#else\n", "\n \t# endif\n", "/*", "*/", "//", "\\\n", "{\n", "(1);\n"]


def pieces(texts):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    whole = b"".join(data)
    ends = sg.piece_ends(np.frombuffer(whole, dtype=np.uint8), offsets)
    at = np.searchsorted(ends, offsets)
    return [[whole[x:y] for x, y in zip(ends[i:j], ends[i + 1:j + 1])] for i, j in zip(at, at[1:])]


def by_pattern(text):
    """Matches of the pattern; blanks with line ends apart at each line end."""
    for p in re.findall(lexis.PIECE.replace(r"\z", r"\Z").encode(), text.encode()):
        yield from re.findall(rb"\n|[^\n]+", p) if re.fullmatch(rb"\s*\n", p) else [p]


def test_pieces_are_those_of_the_pattern():
    r = random.Random(5)
    texts = ["", "#a\n", "\t #a", *("".join(r.choice(ATOMS) for _ in range(r.randrange(30))) for _ in range(6000))]
    assert pieces(texts) == [list(by_pattern(t)) for t in texts]


def test_a_directive_may_follow_other_line_ends():
    assert pieces(["a\r#b\nc", "a\u0085#b", "a #b(", "a\r #b("]) == [
        [b"a\r", b"#b", b"\n", b"c"], ["a\u0085".encode(), b"#b"], ["a ".encode(), b"#b("], [b"a\r ", b"#", b"b", b"("]]


TEXT = """#if A
int f(int é) {
#else
int f(void) {
#endif
  g (1); // }
  "h(2)";
}
int v; int k() { return x->m(2) + n\t(3); }"""


def test_places_of_texts_and_calls():
    def cut(c):
        return raw[c["at"]:c["at"] + c["n"]].decode()

    raw = TEXT.encode()
    for found in (sg.text_spans_of(pa.array([b"", raw, None], pa.binary())), sg.text_spans_of(pa.array([b"#x\n{", raw, raw], pa.binary()).slice(1))):
        units = next(x for x in found.to_pylist() if x["units"])["units"]
        f, v, k = units
        assert (cut(f), f["kept"]) == ("int f(int é) ", [])
        assert cut(f["body"]).endswith("}") and '"h(2)"' in cut(f["body"])
        assert [(cut(c), c["line"]) for c in f["calls"]] == [("g", 6)]
        assert (cut(v).strip(), cut(k).strip(), cut(k["body"])) == ("int v;", "int k()", "{ return x->m(2) + n\t(3); }")
        assert [cut(c) for c in k["calls"]] == ["n"]
        assert cut(k["whole_lines"]) == TEXT.split("\n")[-1]


def test_later_arms_are_no_part_of_a_head():
    raw = "é;\nint f(int é\n#if A\n, int b)\n#else\n, long b)\n#endif\n{ }".encode()
    f = sg.text_spans_of(pa.array([raw], pa.binary())).to_pylist()[0]["units"][-1]
    head = b"".join(raw[k["at"]:k["at"] + k["n"]] for k in f["kept"]).decode()
    assert "int b)" in head and "long" not in head and len(f["kept"]) > 1


def test_texts_in_runs(monkeypatch):
    texts = pa.array([TEXT.encode(), b"", None, b"int f() { g(); }" * 50, TEXT.encode() * 3], pa.binary())
    whole = sg.in_text_runs(sg.text_spans_of, texts)
    seen = []
    monkeypatch.setattr(sg, "RUN_BYTES", 300)

    def work(some):
        seen.append(len(some))
        return sg.text_spans_of(some)

    assert sg.in_text_runs(work, texts).to_pylist() == whole.to_pylist()
    assert len(seen) > 2


def test_long_blanks_and_words_are_looked_at_as_a_whole():
    texts = [b" " * 40 + b"f" * 40 + b" " * 40, b"(", b"1" + b" " * 40, b" " * 40, b"\t" * 9 + b"#"]
    assert sg.piece_codes(pa.array(texts, pa.large_binary()).cast(pa.large_string())).tolist() == [
        sg.BARE + sg.WORDED, sg.LPAR, sg.TEXT, sg.TRIVIA, sg.TEXT]
