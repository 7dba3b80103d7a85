"""Running sums over arrays of small integers, as Arrow functions.

These are the running depth, running line number and last-open-block of a file.
As window functions they would sort one row per piece of text; as an
``aggregate`` fold they are interpreted step by step (measured about 20 times
slower).  Here the texts of a batch of files cross to Python as one flat Arrow buffer; a regular
expression finds comments, literals and directives in it, numpy cuts the rest into pieces, classes
them by their first and last bytes, all at once, and sums with a restart at every file.  (Pieces cut
and classed by regular expressions of the JVM took most of the time of the whole parse.)  A batch is
worked off in runs of at most :data:`RUN` list entries or :data:`RUN_BYTES` bytes, so that what a
worker holds beside the batch does not grow with it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lodestone.functions import lexis

# Codes of the coarse pieces: the kind in the low four bits, WORDED where the piece begins
# with a word, line ends counted in the rest.  The last three kinds are conditional directives.
TRIVIA, IDENT, MEMBER, TEXT, LITERAL, OPEN, CLOSE, SEMI, LPAR, RPAR, BARE, ARROW, IF, ELSE, ENDIF = range(15)
WORDED = 16
KINDS = 32
#: Entries that are worked on at once; a longer list is a run of its own.
RUN = 1 << 18
#: Bytes of text that are worked on at once; a longer text is a run of its own.
RUN_BYTES = 1 << 18
#: Bytes at a piece's ends that are looked at one by one.
STEPS = 8
# Flags of the tokens of a unit.
START, STOP, BRACE, FLAGS = 1, 2, 4, 8

_CALL = T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("line", T.IntegerType()),
    T.StructField("shared", T.BooleanType())])
_RANGE = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("size", T.IntegerType())])
_UNIT = T.StructType([
    T.StructField("unit", T.IntegerType()), T.StructField("first", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("brace", T.IntegerType()),
    T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
    T.StructField("is_function", T.BooleanType()), T.StructField("old_style", T.BooleanType()),
    T.StructField("cover", T.IntegerType()), T.StructField("skips", T.ArrayType(_RANGE)),
    T.StructField("calls", T.ArrayType(_CALL))])
SPANS = T.StructType([
    T.StructField("units", T.ArrayType(_UNIT)), T.StructField("depth", T.IntegerType())])
# What :func:`text_spans` tells of a file: places are bytes from its start, ``kept`` is empty where the text is in one piece.
_CUT = [T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())]
TEXT_SPANS = T.StructType([
    T.StructField("units", T.ArrayType(T.StructType([
        T.StructField("unit", T.IntegerType()), T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()), T.StructField("is_function", T.BooleanType()),
        T.StructField("old_style", T.BooleanType()), T.StructField("cover", T.IntegerType()), *_CUT,
        T.StructField("kept", T.ArrayType(T.StructType(_CUT))), T.StructField("body", T.StructType(_CUT)),
        T.StructField("whole_lines", T.StructType(_CUT)), T.StructField("calls", T.ArrayType(T.StructType([
            *_CUT, T.StructField("line", T.IntegerType()), T.StructField("shared", T.BooleanType())])))]))),
    T.StructField("depth", T.IntegerType())])
MARKS = T.ArrayType(T.StructType([
    T.StructField("i", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("e", T.IntegerType())]))

HEAD = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("type", T.StringType()),
    T.StructField("depth", T.ArrayType(T.IntegerType()))])

# Ship these functions with the job, so that workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(lexis)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list array without nulls, and the offsets starting at 0."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return values, offsets - offsets[0]


def _previous(values: np.ndarray, owner: np.ndarray, default) -> np.ndarray:
    """The preceding entry of the same owner."""
    out = np.empty_like(values)
    out[:1] = default
    out[1:] = np.where(owner[1:] == owner[:-1], values[:-1], default)
    return out


def _sum_before(values: np.ndarray, offsets: np.ndarray, owner: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[:-1] - total[offsets[:-1]][owner]


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def in_runs(work: Callable[[pa.Array], pa.Array], lists: pa.Array) -> pa.Array:
    """``work`` on a list array, some lists at a time: no more than :data:`RUN` entries, or one list."""
    ends = lists.offsets.to_numpy()
    if ends[-1] - ends[0] <= RUN:
        return work(lists)
    out, at = [], 0
    while at < len(lists):
        after = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN, side="right")) - 1)
        out.append(work(lists.slice(at, after - at)))
        at = after
    return pa.concat_arrays(out)


def in_text_runs(work: Callable[[pa.Array], pa.Array], texts: pa.Array) -> pa.Array:
    """``work`` on an array of texts, some at a time: no more than :data:`RUN_BYTES` bytes, or one text."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    if ends[-1] <= RUN_BYTES:
        return work(texts)
    out, at = [], 0
    while at < len(texts):
        after = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN_BYTES, side="right")) - 1)
        out.append(work(texts.slice(at, after - at)))
        at = after
    return pa.concat_arrays(out)


def _strings(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts of a list array without nulls, and the offsets starting at 0."""
    lists = lists.fill_null([]) if lists.null_count else lists
    offsets = lists.offsets.to_numpy()
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.large_string()), offsets - offsets[0]


def _bytes_in(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


_LETTER = _bytes_in(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_WORD = _LETTER | _bytes_in(b"0123456789")
_BLANK = _bytes_in(b" \t")
_SPACE = _bytes_in(b" \t\r\f\x0b")
_SINGLE = np.full(256, -1, dtype=np.int64)
for _byte, _kind in ((b"(", LPAR), (b")", RPAR), (b";", SEMI), (b"{", OPEN), (b"}", CLOSE)):
    _SINGLE[ord(_byte)] = _kind


def _last_outside(data: np.ndarray, members: np.ndarray, before: np.ndarray, start: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Place of the last byte in front of ``before`` that is not among ``members``; -1 if there is none from ``start`` on.

    ``steps`` bytes are looked at one by one, and for what goes on longer all bytes are.
    """
    found = before - 1
    more = np.flatnonzero(found >= start)
    for _ in range(steps):
        more = more[members[data[found[more]]]]
        found[more] -= 1
        more = more[found[more] >= start[more]]
        if not len(more):
            break
    else:
        others = np.concatenate(([-1], np.flatnonzero(~members[data])))
        found[more] = others[np.searchsorted(others, found[more] + 1) - 1]
    return np.where(found >= start, found, -1)


def _first_outside(data: np.ndarray, members: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of the first byte from ``start`` on that is not among ``members``; -1 if there is none before ``end``."""
    found = start.copy()
    more = np.flatnonzero(found < end)
    for _ in range(STEPS):
        more = more[members[data[found[more]]]]
        found[more] += 1
        more = more[found[more] < end[more]]
        if not len(more):
            break
    else:
        others = np.append(np.flatnonzero(~members[data]), len(data))
        found[more] = others[np.searchsorted(others, found[more])]
    return np.where(found < end, found, -1)


def piece_codes(pieces: pa.Array) -> np.ndarray:
    """Kind of each piece, WORDED if it begins with a word, plus KINDS times the line ends in it.

    A piece that ends in a word is BARE if it is nothing else, MEMBER behind ``.`` or ``->``, IDENT
    otherwise, and TEXT when the word is a number; a line terminator other than LF may follow the word.
    """
    n = len(pieces)
    if not n:
        return np.zeros(0, dtype=np.int64)
    _, ends, data = pieces.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[pieces.offset:pieces.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    ends = ends - ends[0]
    start, end = ends[:-1], ends[1:]
    padded = np.append(data, np.zeros(2, dtype=np.uint8))  # safe to read past the end
    size, first, second = end - start, padded[start], padded[start + 1]
    second = np.where(size > 1, second, 0)
    breaks = np.flatnonzero(data == 10)
    lines = np.diff(np.searchsorted(breaks, ends))

    single = np.where(size == 1, _SINGLE[first], -1)
    quote = (size > 0) & ((first == 34) | (first == 39))
    hash_at = _first_outside(data, _bytes_in(b" "), start, end)
    directive = (hash_at >= 0) & (padded[hash_at] == 35)
    comment = (first == 47) & ((second == 42) | (second == 47)) & (lines == 0)
    codes = np.full(n, TRIVIA, dtype=np.int64)
    codes[quote] = LITERAL
    conditional = np.flatnonzero(directive & ~quote & ~comment)
    if len(conditional):
        texts = pieces.take(pa.array(conditional))
        kinds = np.full(len(conditional), TRIVIA)
        for start_of, kind in (("endif", ENDIF), ("el", ELSE), ("if", IF)):
            kinds[pc.match_substring_regex(texts, rf"^[ \t]*#[ \t]*{start_of}").to_numpy(zero_copy_only=False)] = kind
        codes[conditional] = kinds

    plain = np.flatnonzero((single < 0) & (lines == 0) & ~comment & ~quote & ~directive & (size > 0))
    if len(plain):
        codes[plain] = _plain_codes(data, padded, start[plain], end[plain])
    codes += KINDS * lines
    return np.where(single >= 0, single, codes)


def _last_word(data: np.ndarray, padded: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pieces on one line: where a line terminator at the end begins, the last byte in front of it that is
    no blank, whether that ends a word, and where the word begins."""
    def back(k: int) -> np.ndarray:
        return np.where(end - start >= k, padded[end - k], 0)

    one, two, three = back(1), back(2), back(3)
    stop = end - np.where(one == 13, 1, np.where((two == 0xC2) & (one == 0x85), 2, np.where(
        (three == 0xE2) & (two == 0x80) & ((one == 0xA8) | (one == 0xA9)), 3, 0)))
    last = _last_outside(data, _BLANK, stop, start)
    word_end = (last >= 0) & _WORD[padded[last]]
    run = np.where(word_end, np.maximum(_last_outside(data, _WORD, last, start, 0) + 1, start), start)
    return stop, last, word_end, run


def _plain_codes(data: np.ndarray, padded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of pieces on one line that are no structure, comment, literal or directive."""
    stop, last, word_end, run = _last_word(data, padded, start, end)
    named = word_end & _LETTER[padded[run]]
    # what stands in front of the name, or ends a piece without one
    ahead = np.where(word_end, _last_outside(data, _BLANK, run, start), last)
    arrow = (ahead >= 0) & ((padded[ahead] == 46) | (
        (padded[ahead] == 62) & (ahead > start) & (padded[np.maximum(ahead - 1, 0)] == 45)))
    opening = _first_outside(data, _BLANK, start, end)
    worded = np.where((opening >= 0) & _LETTER[padded[opening]], WORDED, 0)
    empty = _last_outside(data, _SPACE, stop, start) < 0
    return np.where(word_end, np.where(~named, TEXT, np.where(ahead < 0, BARE + WORDED, np.where(arrow, MEMBER, IDENT + worded))),
                    np.where(empty, TRIVIA, np.where(arrow, ARROW, TEXT + worded)))


def _arms(kinds: np.ndarray, at: np.ndarray, owner: np.ndarray, sums: np.ndarray, lowest: np.ndarray,
          n_files: int) -> tuple[np.ndarray, np.ndarray]:
    """Depth at the start of each stretch between conditional directives, and the directive of the
    innermost later arm that holds the stretch (-1 for none).

    ``sums`` and ``lowest`` are the depth change of each stretch and its lowest point.  Every arm starts
    at the depth of its ``#if``; what follows ``#endif`` starts where the first arm ended.  A directive
    without its counterpart changes nothing.
    """
    starts = np.zeros(len(sums), dtype=np.int64)
    later = np.full(len(sums), -1, dtype=np.int64)
    stack: list[list] = []
    file, depth = -1, 0
    for j, (kind, place, f) in enumerate(zip(kinds.tolist(), at.tolist(), owner.tolist())):
        stretch = j + f
        if f != file:
            file, depth, stack = f, 0, []
        depth += int(sums[stretch]) + max(0, -(depth + int(lowest[stretch])))
        if kind == IF:
            stack.append([depth, None, stack[-1][2] if stack else -1])
        elif stack and kind == ELSE:
            if stack[-1][1] is None:
                stack[-1][1] = depth
            depth, stack[-1][2] = stack[-1][0], place
        elif stack and kind == ENDIF:
            _, first, _ = stack.pop()
            depth = depth if first is None else first
        starts[stretch + 1] = depth
        later[stretch + 1] = stack[-1][2] if stack else -1
    return starts, later


def spans_of(codes: pa.Array) -> pa.Array:
    """Piece codes of each file -> its units with their calls, and its last depth."""
    codes = codes.fill_null([]) if codes.null_count else codes
    values, offsets = _flat(codes)
    n_files = len(codes)
    file_all = np.repeat(np.arange(n_files), np.diff(offsets))
    line_all = 1 + _sum_before(values // KINDS, offsets, file_all)

    kind_all = values % WORDED
    directives = np.flatnonzero(kind_all >= IF)
    keep = np.flatnonzero((kind_all != TRIVIA) & (kind_all < IF))
    kind, file, line = kind_all[keep], file_all[keep], line_all[keep]
    pos = keep - offsets[:-1][file]
    n = len(keep)
    starts = np.searchsorted(file, np.arange(n_files + 1))
    prev = _previous(kind, file, TRIVIA)
    before_prev = _previous(prev, file, TRIVIA)

    # extern "C" { is transparent; a closing brace at depth 0 stays at depth 0.
    linkage = (kind == OPEN) & (prev == LITERAL)
    step = ((kind == OPEN) & ~linkage).astype(np.int64) - (kind == CLOSE)
    stretch = np.searchsorted(directives, keep) + file
    bounds = np.searchsorted(stretch, np.arange(n_files + len(directives) + 1))
    base = np.zeros(len(bounds) - 1, dtype=np.int64)
    later = np.full(len(bounds) - 1, -1, dtype=np.int64)
    raw = _sum_before(step, bounds, stretch) + step
    apart = stretch * (4 * n + 4)  # keeps running minima inside their stretch
    if len(directives):
        lowest = np.zeros(len(base), dtype=np.int64)
        filled = np.flatnonzero(np.diff(bounds))
        if n:
            lowest[filled] = np.minimum.reduceat(raw, bounds[filled])
        total = np.concatenate(([0], np.cumsum(step)))
        base, later = _arms(kind_all[directives], directives - offsets[:-1][file_all[directives]], file_all[directives],
                            np.diff(total[bounds]), lowest, n_files)
    level = raw + base[stretch]
    floor = np.minimum(np.minimum.accumulate(level - apart) + apart, 0) if n else level
    depth_after = level - floor
    depth = _previous(depth_after, stretch, 0)
    heads = bounds[:-1][np.diff(bounds) > 0]
    depth[heads] = base[stretch[heads]]

    top = depth == 0
    # Declarations between ")" and "{" belong to the head: no other brace follows a ";" at depth 0.
    after_semi = np.flatnonzero((kind == OPEN) & top & ~linkage & (prev == SEMI))
    old_open, unended = np.zeros(n, dtype=bool), np.zeros(n + 1, dtype=np.int64)
    if len(after_semi):
        listed = np.flatnonzero(top & (prev == RPAR) & (values[keep] & WORDED > 0))
        braces = np.flatnonzero((kind == OPEN) | (kind == CLOSE))
        place = np.searchsorted(listed, after_semi) - 1
        head = np.where(place >= 0, listed[np.maximum(place, 0)] if len(listed) else -1, -1)
        brace_before = np.concatenate(([-1], braces))[np.searchsorted(braces, after_semi)]
        ok = (head >= 0) & (head > brace_before) & (file[head] == file[after_semi])
        old_open[after_semi[ok]] = True
        np.add.at(unended, head[ok], 1)
        np.add.at(unended, after_semi[ok], -1)
    in_list = np.cumsum(unended)[:n] > 0
    opens = (kind == OPEN) & top & ~linkage
    body_open = opens & ((prev == RPAR) | old_open)
    last_open = np.maximum.accumulate(np.where(opens, np.arange(n), -1)) if n else np.arange(0)
    in_function = (last_open >= 0) & body_open[last_open] if n else top
    ends = (top & (kind == SEMI) & ~in_list) | ((kind == CLOSE) & (depth == 1) & in_function)
    cuts = np.flatnonzero(ends | linkage | ((kind == CLOSE) & top))
    first = np.maximum(_previous(cuts, file[cuts], -1) + 1, starts[file[cuts]])
    bodies = np.append(np.flatnonzero(body_open), n)
    brace_of = bodies[np.searchsorted(bodies, first)]
    closing = kind[cuts] == CLOSE
    # a later arm that closes a function again goes on with it
    again = ends[cuts] & closing & (brace_of > cuts)
    emitted = ends[cuts] & (first < cuts) & ~again
    cut_end = cuts.copy()
    if again.any():
        for k in np.flatnonzero(again).tolist():
            j = k - 1
            while j >= 0 and again[j]:
                j -= 1
            if j >= 0 and emitted[j] and closing[j] and file[cuts[j]] == file[cuts[k]]:
                cut_end[j] = cuts[k]
    last, first, brace_at = cut_end[emitted], first[emitted], brace_of[emitted]

    owner = file[last]
    per_file = np.bincount(owner, minlength=n_files)
    unit = np.arange(len(last)) - (np.cumsum(per_file) - per_file)[owner]
    start_line, end_line = line[first], line[last]
    is_function = kind[last] == CLOSE

    # The first function that holds a line: several may share one.
    fn = np.flatnonzero(is_function)
    fn_owner = owner[fn]
    previous_end = _previous(end_line[fn], fn_owner, 0)
    new_line = previous_end != end_line[fn]
    run_head = np.maximum.accumulate(np.where(new_line, np.arange(len(fn)), 0)) if len(fn) else fn
    head_unit = unit[fn][run_head] if len(fn) else fn
    cover = unit.copy()
    cover[fn] = np.where(start_line[fn] == previous_end,
                         _previous(head_unit, fn_owner, -1), unit[fn])
    end_before = np.zeros(len(last), dtype=np.int64)
    end_before[fn] = previous_end

    names = (prev == IDENT) | ((prev == BARE) & (before_prev != ARROW))
    at = np.flatnonzero((kind == LPAR) & ~top & in_function & names)
    inside = np.searchsorted(last, at)
    ok = inside < len(last)
    at, inside = at[ok], inside[ok]
    ok = (first[inside] <= at) & is_function[inside] if len(at) else ok[:0]
    at, inside = at[ok], inside[ok]
    calls = pa.StructArray.from_arrays(
        [pa.array(pos[at - 1] + 1, pa.int32()), pa.array(line[at - 1], pa.int32()),
         pa.array(line[at - 1] == end_before[inside], pa.bool_())],
        names=["piece", "line", "shared"])

    # Later arms that begin inside a head or a declaration are no part of its text.
    skipped, skips = np.zeros(len(last), dtype=np.int64), []
    if len(directives) and len(last):
        text_end = np.where(is_function, np.minimum(brace_at, last), last)
        place = directives - offsets[:-1][file_all[directives]]
        for u in np.flatnonzero(stretch[first] != stretch[text_end]).tolist():
            for s in range(int(stretch[first[u]]) + 1, int(stretch[text_end[u]]) + 1):
                if later[s] > pos[first[u]]:
                    left = int(place[s - 1 - owner[u]])
                    right = int(place[s - owner[u]]) if s < stretch[text_end[u]] else int(pos[text_end[u]]) + (not is_function[u])
                    skips.append((left + 1, right - left))
                    skipped[u] += 1
    ranges = pa.StructArray.from_arrays(
        [pa.array([r[k] for r in skips], pa.int32()) for k in (0, 1)], names=["first", "size"])
    units = pa.StructArray.from_arrays(
        [pa.array(unit, pa.int32()), pa.array(pos[first] + 1, pa.int32()),
         pa.array(pos[last] - pos[first] + 1, pa.int32()),
         pa.array(np.where(is_function, pos[np.minimum(brace_at, last)] + 1, 0), pa.int32()),
         pa.array(start_line, pa.int32()), pa.array(end_line, pa.int32()),
         pa.array(is_function, pa.bool_()), pa.array(is_function & old_open[np.minimum(brace_at, last)], pa.bool_()),
         pa.array(cover, pa.int32()), _lists(skipped, ranges),
         _lists(np.bincount(inside, minlength=len(last)), calls)],
        names=["unit", "first", "size", "brace", "start_line", "end_line", "is_function", "old_style",
               "cover", "skips", "calls"])
    final = np.zeros(n_files, dtype=np.int64)
    tail = np.arange(n_files) + np.searchsorted(file_all[directives], np.arange(n_files), side="right")
    filled = np.diff(bounds)[tail] > 0
    final[~filled] = base[tail[~filled]]
    final[filled] = depth_after[bounds[tail[filled] + 1] - 1]
    return pa.StructArray.from_arrays(
        [_lists(per_file, units), pa.array(final, pa.int32())], names=["units", "depth"])


def sums_before(steps: pa.Array) -> pa.Array:
    """Exclusive running sum inside each list."""
    steps = steps.fill_null([]) if steps.null_count else steps
    values, offsets = _flat(steps)
    owner = np.repeat(np.arange(len(steps)), np.diff(offsets))
    return _lists(np.diff(offsets), pa.array(_sum_before(values, offsets, owner), pa.int32()))


def marks_of(codes: pa.Array) -> pa.Array:
    """Depth and flags of each token (:data:`FLAGS` times the depth, plus the flags) -> for
    every token with START its position ``i``, the next STOP of its depth ``k``, and the
    BRACE that closes what opens there ``e``; null where there is none."""
    codes = codes.fill_null([]) if codes.null_count else codes
    values, offsets = _flat(codes)
    owner = np.repeat(np.arange(len(codes)), np.diff(offsets))
    n = len(values)
    flags, depth = values % FLAGS, (values // FLAGS).astype(np.int64)
    if n:
        depth -= depth.min()
    level = owner * (depth.max(initial=0) + 2) + depth

    def following(at: np.ndarray, wanted: np.ndarray, flag: int) -> np.ndarray:
        marked = np.flatnonzero(flags & flag)
        keys = np.concatenate((np.sort(level[marked] * n + marked), [-1]))
        found = keys[np.minimum(np.searchsorted(keys[:-1], wanted * n + at, side="right"), len(keys) - 1)]
        return np.where((at >= 0) & (found >= 0) & (found // max(n, 1) == wanted), found % max(n, 1), -1)

    start = np.flatnonzero(flags & START)
    stop = following(start, level[start], STOP)
    end = following(stop, level[start] + 1, BRACE)
    base = offsets[:-1][owner[start]]
    fields = [pa.array((x - base).astype(np.int32), pa.int32(), mask=x < 0) for x in (start, stop, end)]
    return _lists(np.bincount(owner[start], minlength=len(codes)),
                  pa.StructArray.from_arrays(fields, names=["i", "k", "e"]))


_CONSTRUCT, _FIRST = (re.compile(p.encode()) for p in (lexis.CONSTRUCT, lexis.FIRST_DIRECTIVE))
# bytes of the line end that is matched in front of a directive, by the first of them
_LINE_END = np.zeros(256, dtype=np.int64)
_LINE_END[[10, 13, 0xC2, 0xE2]] = 1, 1, 2, 3
_APART = _bytes_in(b"\n{};()\"'/#")


def piece_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the coarse pieces of texts that lie one after another, a 0 in front.

    As the matches of ``lexis.PIECE``, but for blanks with line ends, which are cut at each line end.
    """
    view, found, firsts = memoryview(data), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        begin = a
        if first := _FIRST.match(view[a:b]):
            begin = a + first.end()
            firsts.append((a, begin))
        found += [m.span() for m in _CONSTRUCT.finditer(view, begin, b)]
    spans = np.array(found, dtype=np.int64).reshape(-1, 2)
    spans[:, 0] += _LINE_END[data[spans[:, 0]]]
    starts, stops = np.concatenate((spans, np.array(firsts, dtype=np.int64).reshape(-1, 2))).T
    turn = np.zeros(len(data) + 1, dtype=np.int8)
    turn[starts] += 1
    turn[stops] -= 1
    apart = np.flatnonzero(_APART[data] & (np.cumsum(turn[:-1], dtype=np.int8) == 0))
    cuts = np.zeros(len(data) + 1, dtype=bool)
    for places in (starts, stops, apart, apart + 1, offsets):
        cuts[places] = True
    return np.flatnonzero(cuts)


def _pairs(at: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    return [pa.array(at, pa.int32()), pa.array(end - at, pa.int32())]


def text_spans_of(texts: pa.Array) -> pa.Array:
    """Text of each file, as bytes -> its units with the places of their texts and calls, and its last depth."""
    texts = (texts.fill_null(b"") if texts.null_count else texts).cast(pa.large_binary())
    n_files = len(texts)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[texts.offset:texts.offset + n_files + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    ends = piece_ends(data, offsets)
    base = np.searchsorted(ends, offsets)
    pieces = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))
    spans = spans_of(pa.ListArray.from_arrays(pa.array(base, pa.int32()), pa.array(piece_codes(pieces), pa.int32())))

    per_file = spans.field("units")
    units = per_file.values
    owner = np.repeat(np.arange(n_files), np.diff(per_file.offsets.to_numpy()))

    def column(name: str) -> np.ndarray:
        return units.field(name).to_numpy(zero_copy_only=False)

    def byte(piece: np.ndarray, file: np.ndarray) -> np.ndarray:
        """Where the piece with that number (from 1) begins in its file."""
        return ends[base[file] + piece - 1] - offsets[file]

    is_function, first, after = column("is_function"), column("first"), column("first") + column("size")
    text_after = np.where(is_function, column("brace"), after)
    body_at = byte(text_after, owner)

    breaks = np.flatnonzero(data == 10)
    seen = np.searchsorted(breaks, offsets)

    def line_start(line: np.ndarray) -> np.ndarray:
        """Where a line (from 1) begins in its file; the end of the file behind the last one."""
        k = seen[owner] + line - 2
        begun = (np.append(breaks, 0)[np.minimum(np.maximum(k, 0), len(breaks))] + 1) - offsets[owner]
        return np.where(line == 1, 0, np.where(k < seen[owner + 1], begun, (offsets[1:] - offsets[:-1])[owner]))

    skips = units.field("skips")
    skip_sizes = np.diff(skips.offsets.to_numpy())
    kept, kept_sizes = [], np.zeros(len(owner), dtype=np.int64)
    for u in np.flatnonzero(skip_sizes).tolist():
        left, stretches = first[u], []
        for r in sorted(skips[u].as_py(), key=lambda r: r["first"]):
            if r["first"] > left:
                stretches.append((left, min(r["first"], text_after[u])))
            left = max(left, r["first"] + r["size"])
        if left < text_after[u]:
            stretches.append((left, text_after[u]))
        kept += [tuple(byte(np.array(s), owner[u]).tolist()) for s in stretches] or [(0, 0)]
        kept_sizes[u] = max(len(stretches), 1)
    kept = np.array(kept, dtype=np.int64).reshape(-1, 2)

    calls = units.field("calls")
    call_sizes = np.diff(calls.offsets.to_numpy())
    call_owner = np.repeat(owner, call_sizes)
    called = base[call_owner] + calls.values.field("piece").to_numpy() - 1
    _, last, _, run = _last_word(data, np.append(data, np.zeros(2, dtype=np.uint8)), ends[called], ends[called + 1])
    cut = ["at", "n"]
    calls = pa.StructArray.from_arrays(
        [*_pairs(run - offsets[call_owner], last + 1 - offsets[call_owner]), calls.values.field("line"),
         calls.values.field("shared")], names=[*cut, "line", "shared"])
    at = byte(first, owner)
    out = pa.StructArray.from_arrays(
        [units.field("unit"), units.field("start_line"), units.field("end_line"), units.field("is_function"),
         units.field("old_style"), units.field("cover"), *_pairs(at, body_at),
         _lists(kept_sizes, pa.StructArray.from_arrays(_pairs(kept[:, 0], kept[:, 1]), names=cut)),
         pa.StructArray.from_arrays(_pairs(body_at, byte(after, owner)), names=cut),
         pa.StructArray.from_arrays(_pairs(line_start(column("start_line")), line_start(column("end_line") + 1)), names=cut),
         _lists(call_sizes, calls)],
        names=["unit", "start_line", "end_line", "is_function", "old_style", "cover", *cut, "kept", "body", "whole_lines", "calls"])
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(per_file.offsets, out), spans.field("depth")], names=["units", "depth"])


def _bracket_steps(texts: pa.Array) -> np.ndarray:
    """What each token adds to the bracket depth."""
    kinds = pc.index_in(texts, pa.array(["(", "[", "{", ")", "]", "}"], pa.large_string()))
    kinds = kinds.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.where(kinds < 0, 0, np.where(kinds < 3, 1, -1))


def depths_of(tokens: pa.Array) -> pa.Array:
    """Bracket depth in front of each token."""
    texts, offsets = _strings(tokens)
    return sums_before(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_bracket_steps(texts), pa.int32())))


def heads_of(tokens: pa.Array) -> pa.Array:
    """Tokens of each function head -> the name it declares, its place, the type words and the bracket depths.

    The same as ``_declarator`` of :mod:`lodestone.operators.extract` at depth 0, for all heads of a run at once.
    """
    texts, offsets = _strings(tokens)
    n, first, last = len(texts), offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    owner = np.repeat(np.arange(len(first)), last - first)
    depth = _sum_before(_bracket_steps(texts), offsets, owner)
    flat = depth == 0

    def among(words: list[str]) -> np.ndarray:
        return pc.is_in(texts, value_set=pa.array(words, pa.large_string())).to_numpy(zero_copy_only=False)

    def at_place(marks: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The mark of the token at ``place``, False outside of its list."""
        inside = (place >= first) & (place < last)
        return inside & np.append(marks, False)[np.where(inside, place, n)]

    def first_from(marks: np.ndarray, start: np.ndarray) -> np.ndarray:
        places = np.append(np.flatnonzero(marks), n)
        found = places[np.searchsorted(places[:-1], start)]
        return np.where(found < last, found, -1)

    attribute, tag, opening, star = among(lexis.ATTRIBUTE_WORDS), among(lexis.TAG_WORDS), among(["("]), among(["*"])
    word = pc.match_substring_regex(texts, lexis.WORD).to_numpy(zero_copy_only=False) & ~attribute
    name = word & ~tag

    paren = first_from(opening & flat & ~_previous(attribute, owner, False), first)
    cut = first_from(flat & among(["=", "[", ":"]), first)
    starred = first_from(flat & star, first)
    has = (paren >= 0) & ((cut < 0) | (paren < cut))
    close = np.where(has, first_from(among([")"]) & (depth == 1), paren + 1), -1)
    grouped = has & (((close >= 0) & at_place(opening | among(["["]), close + 1)) | at_place(star, paren + 1))
    plain = np.append(np.flatnonzero(flat & name), -1)
    plain = plain[np.searchsorted(plain[:-1], np.where(cut >= 0, cut, last)) - 1]
    plain = np.where(plain >= first, plain, -1)
    inner = first_from(name, paren + 1)
    at = np.where(grouped, inner, np.where(has, paren - 1, plain))
    unknown = np.where(grouped, inner < 0, ~has & (plain < 0))
    ok = ~unknown & at_place(name, at) & ~at_place(tag, at - 1)

    far = np.int64(n + 1)
    end = np.minimum(np.minimum(np.where(unknown, far, at), np.where(starred >= 0, starred, far)), np.where(grouped, paren, far))
    end = np.where(end == far, first, end)
    typed = np.flatnonzero(flat & word & (np.arange(n) < end[owner]))
    types = pc.binary_join(_lists(np.bincount(owner[typed], minlength=len(first)), texts.take(pa.array(typed)).cast(pa.string())), " ")
    names = texts.take(pa.array(np.where(ok, at, 0), mask=~ok)).cast(pa.string())
    return pa.StructArray.from_arrays(
        [names, pa.array((at - first).astype(np.int32), pa.int32(), mask=~ok), types,
         _lists(last - first, pa.array(depth, pa.int32()))], names=["name", "at", "type", "depth"])


@arrow_udf(TEXT_SPANS)
def text_spans(texts: pa.Array) -> pa.Array:
    return in_text_runs(text_spans_of, texts)


@arrow_udf(T.ArrayType(T.IntegerType()))
def bracket_depth(tokens: pa.Array) -> pa.Array:
    return in_runs(depths_of, tokens)


@arrow_udf(HEAD)
def function_head(tokens: pa.Array) -> pa.Array:
    return in_runs(heads_of, tokens)


@arrow_udf(MARKS)
def token_marks(codes: pa.Array) -> pa.Array:
    return in_runs(marks_of, codes)
