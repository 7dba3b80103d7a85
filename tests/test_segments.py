"""The vectorised spans against a step-by-step reading of the same codes."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions import segments as sg

code = st.builds(lambda kind, lines: kind + lines * sg.KINDS, st.integers(0, 11), st.sampled_from([0, 0, 0, 1, 2]))
soup = st.lists(st.lists(st.one_of(code, st.sampled_from(
    [sg.OPEN, sg.CLOSE, sg.SEMI, sg.LPAR, sg.RPAR, sg.IDENT])), max_size=60), max_size=5)
# text that is mostly functions: name ( ) { ... }
function = st.lists(st.sampled_from([
    [sg.IDENT, sg.LPAR, sg.RPAR, sg.OPEN, sg.IDENT, sg.LPAR, sg.RPAR, sg.SEMI, sg.CLOSE],
    [sg.BARE, sg.LPAR, sg.RPAR, sg.OPEN, sg.ARROW, sg.BARE, sg.LPAR, sg.RPAR, sg.SEMI, sg.KINDS, sg.CLOSE],
    [sg.KINDS], [sg.TEXT, sg.SEMI], [sg.LITERAL, sg.OPEN], [sg.CLOSE]]), max_size=12).map(
        lambda parts: [x for p in parts for x in p])


arms = st.lists(st.sampled_from([[sg.IF], [sg.ELSE], [sg.ENDIF], [sg.OPEN], [sg.CLOSE], [sg.SEMI], [sg.KINDS],
                                 [sg.IDENT, sg.LPAR, sg.RPAR], [sg.IDENT, sg.LPAR, sg.RPAR, sg.OPEN], [sg.TEXT, sg.SEMI],
                                 [sg.BARE, sg.LPAR, sg.RPAR, sg.SEMI]]), max_size=14).map(lambda parts: [x for p in parts for x in p])
old_style = st.lists(st.sampled_from([
    [sg.IDENT, sg.LPAR, sg.IDENT, sg.RPAR, sg.KINDS, sg.IDENT + sg.WORDED, sg.SEMI], [sg.IDENT + sg.WORDED, sg.SEMI], [sg.OPEN], [sg.CLOSE],
    [sg.OPEN, sg.BARE, sg.LPAR, sg.RPAR, sg.SEMI, sg.CLOSE], [sg.IDENT, sg.LPAR, sg.RPAR, sg.SEMI], [sg.IF], [sg.ELSE], [sg.ENDIF],
    [sg.IDENT, sg.LPAR, sg.RPAR, sg.OPEN, sg.CLOSE]]), max_size=10).map(lambda parts: [x for p in parts for x in p])


def step_by_step(codes):
    """One token after another, with a stack of conditionals and segments that a later brace may join."""
    done, stack, place = [], [], []  # finished segments, conditionals, later arm of each piece
    line, depth, fn, segment = 1, 0, False, None
    prev = before = sg.TRIVIA
    prev_at = None
    for i, x in enumerate(codes):
        kind, lines = x % sg.WORDED, x // sg.KINDS
        if kind == sg.IF:
            stack.append({"depth": depth, "first": None, "later": stack[-1]["later"] if stack else -1})
        elif kind == sg.ELSE and stack:
            stack[-1]["first"] = depth if stack[-1]["first"] is None else stack[-1]["first"]
            stack[-1]["later"], depth = i, stack[-1]["depth"]
        elif kind == sg.ENDIF and stack:
            gone = stack.pop()
            depth = depth if gone["first"] is None else gone["first"]
        place.append(stack[-1]["later"] if stack else -1)
        if kind == sg.TRIVIA or kind >= sg.IF:
            line += lines
            continue
        segment = segment or {"first": i, "line": line, "brace": None, "old": False, "calls": [], "listed": False, "braces": 0}
        linkage = kind == sg.OPEN and prev == sg.LITERAL
        if depth == 0 and prev == sg.RPAR and x & sg.WORDED:
            segment["listed"], segment["braces"] = True, 0
        closes = None
        if kind == sg.OPEN and not linkage:
            if depth == 0:
                old = False
                if prev == sg.SEMI:
                    back = len(done) - 1
                    while back >= 0 and done[back]["ended_by"] == sg.SEMI and not done[back]["listed"] and not done[back]["braces"]:
                        back -= 1
                    if back >= 0 and done[back]["ended_by"] == sg.SEMI and done[back]["listed"] and not done[back]["braces"]:
                        old = True
                        segment = done[back] | {"old": True}
                        del done[back:]
                fn = prev == sg.RPAR or old
                if fn and segment["brace"] is None:
                    segment["brace"] = i
                    segment["old"] = old
            segment["braces"] += 1
            depth += 1
        elif kind == sg.OPEN:
            segment["braces"] += 1
            closes = "linkage"
        elif kind == sg.CLOSE:
            if depth == 0:
                closes = "stray"
            else:
                depth -= 1
                closes = "function" if depth == 0 and fn else None
        elif kind == sg.SEMI and depth == 0:
            closes = sg.SEMI
        elif kind == sg.LPAR and depth > 0 and fn and (prev == sg.IDENT or (prev == sg.BARE and before != sg.ARROW)):
            segment["calls"].append((prev_at[0] + 1, prev_at[1]))
        before, prev, prev_at = prev, kind, (i, line)
        if closes is not None:
            segment |= {"last": i, "end_line": line, "ended_by": closes}
            if closes == "function" and segment["brace"] is None:
                if done and done[-1]["ended_by"] == "function" and done[-1]["first"] < done[-1]["last"]:
                    done[-1] |= {"last": i, "end_line": line, "calls": done[-1]["calls"] + segment["calls"]}
            else:
                done.append(segment)
            segment = None
        line += lines
    units, end_line, end_unit = [], 0, -1
    for s in done:
        if s["ended_by"] not in (sg.SEMI, "function") or s["first"] >= s["last"]:
            continue
        is_fn, k = s["ended_by"] == "function", len(units)
        stop = s["brace"] if is_fn else s["last"] + 1
        units.append({"unit": k, "first": s["first"] + 1, "size": s["last"] - s["first"] + 1, "brace": s["brace"] + 1 if is_fn else 0,
                      "start_line": s["line"], "end_line": s["end_line"], "is_function": is_fn, "old_style": is_fn and s["old"],
                      "cover": end_unit if is_fn and s["line"] == end_line else k,
                      "skips": {j + 1 for j in range(s["first"], stop) if place[j] > s["first"]},
                      "calls": [{"piece": p, "line": n, "shared": n == end_line} for p, n in s["calls"]] if is_fn else []})
        if is_fn and s["end_line"] != end_line:
            end_line, end_unit = s["end_line"], k
    return {"units": units, "depth": depth}


def significant_only(codes):
    """Inside linkage blocks at depth > 0 the two readings may differ: never valid C."""
    depth = 0
    prev = None
    for x in codes:
        k = x % sg.WORDED
        if k == sg.TRIVIA:
            continue
        if k == sg.OPEN and prev == sg.LITERAL and depth:
            return False
        depth = max(0, depth + (k == sg.OPEN and prev != sg.LITERAL) - (k == sg.CLOSE))
        prev = k
    return True


def read(batch):
    got = sg.spans_of(pa.array(batch, pa.list_(pa.int32()))).to_pylist()
    for f in got:
        for u in f["units"]:
            u["skips"] = {i for r in u["skips"] for i in range(r["first"], r["first"] + r["size"])}
    return got


@settings(max_examples=400, deadline=None)
@given(st.one_of(soup, st.lists(function, max_size=5)))
def test_spans_agree(batch):
    batch = [c for c in batch if significant_only(c)]
    assert read(batch) == [step_by_step(c) for c in batch]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(arms, old_style, function), max_size=5))
def test_spans_agree_with_conditionals_and_old_heads(batch):
    batch = [c for c in batch if significant_only(c)]
    assert read(batch) == [step_by_step(c) for c in batch]


def test_sliced_and_null_lists():
    whole = pa.array([[1, 1], None, [2, 3, 4], []], pa.list_(pa.int32()))
    assert sg.sums_before(whole).to_pylist() == [[0, 1], [], [0, 2, 5], []]
    assert sg.sums_before(whole.slice(2)).to_pylist() == [[0, 2, 5], []]
