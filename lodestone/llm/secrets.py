"""Secret scan with a random forest that removes false positives.

Candidates are values of any length that are quoted, assigned (behind = or :) or a password in
``user:password@host``, and runs of ``LEAST`` or more characters that keys are made of, with
and without the punctuation inside them (``= :`` only in the values).  No other length or
look is asked for; the forest judges.  Each is described by its length, character classes and their changes, entropy, how usual its
character transitions are and how much of it a dictionary covers (both learned from the
words of the labelled findings' surroundings), its path, and its neighbouring words; a
random forest of numpy decision trees, trained from labelled findings, tells secrets from
what only looks like one.

A finding is ``(path, before, value, after, label)``.  Training takes at most ``FINDINGS``
of each label among long, short, assigned and other values, chosen by hash, on the driver; the forest has a bounded number of nodes and
goes out with the tasks.  Scanning is a map over whole texts without a shuffle.

Defined results: null and empty texts have no candidates; a candidate is as long as the run,
however long; paths may be null; rows that repeat are scanned each; of secrets that
overlap the first and longest is reported.  Without findings of
both labels every candidate gets the share of positive labels (0 if there are none).
"""

from __future__ import annotations

import functools
import itertools
import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, held_out, table
from lodestone.session import settled

LEAST, LONG = 6, 16
#: One in so many short unassigned findings is kept for training (they are nearly all words).
PLAIN = 64
#: Tokens and values whose judgement a task remembers.
SHAPES = 400_000
FINDINGS = 2000
TREES, DEPTH, LEAF, SPLITS = 40, 8, 4, 24
THRESHOLD = 0.5
_SET = ("\"", "'", "=", ":")
_KEY, _MARK = r"A-Za-z0-9+/_\-", r".!@$#%^&*~|?"
_RUN = re.compile(rf"[{_KEY}]{{{LEAST},}}")
_MARKED = re.compile(rf"(?<![{_KEY}{_MARK}])[{_KEY}{_MARK}]{{{LEAST},}}")
_VALUES = (re.compile(r"[=:][ \t]*(?:\"([^\"\n]+)\"|'([^'\n]+)'|(?!//)([^\s\"'=:]\S*))"), re.compile(r"\"([^\"\s]+)\"|'([^'\s]+)'"),
           re.compile(r"(?<![\w.+\-])[\w.+\-]++:([^\s/\"']+)@(?=[\w.\-])"))
NEAR = 40
_WORDS = re.compile(r"[^\W\d_]+")


def found(text: str | None, plain: int = 1, skip: Callable[[str], bool] | None = None) -> list[tuple[int, str, str, str]]:
    """(start, value, what stands before, what stands after) of every candidate.

    With ``plain`` above 1, of short values that are neither quoted nor assigned one in so many,
    by hash; for training only.  Runs of key characters and marks for which ``skip`` holds are passed over.
    """
    if not text:
        return []
    spans = set()
    for m in _MARKED.finditer(text):
        if skip and skip(m.group()):
            continue
        spans.update(r.span() for r in _RUN.finditer(text, *m.span()))
        if m.group().isalnum():
            continue
        value = m.group().rstrip(".!?,")
        start = m.end() - len(m.group().lstrip(_MARK))
        if m.start() + len(value) - start >= LEAST:
            spans.add((start, m.start() + len(value)))
    for kind, signs in zip(_VALUES, ("=:", "\"'", "@")):
        if not any(c in text for c in signs):
            continue
        for m in kind.finditer(text):
            start, end = m.span(m.lastindex)
            spans.add((start, end))
            if kind is _VALUES[0] and m.lastindex == 3:
                # a bare value ends before quotes and what closes a clause
                value = re.split("[\"'<>]", m.group(3), maxsplit=1)[0].rstrip(",;.)]}")
                spans.discard((start, end))
                if value:
                    spans.add((start, start + len(value)))
    if plain > 1:
        spans = {(s, e) for s, e in spans if e - s >= LONG or text[max(0, s - NEAR):s].rstrip()[-1:] in _SET
                 or xxhash.xxh32_intdigest(text[max(0, s - NEAR):e].encode("utf-8", "surrogatepass")) % plain == 0}
    return [(s, text[s:e], text[max(0, s - NEAR):s], text[e:e + NEAR]) for s, e in sorted(spans)]


@dataclass
class Model:
    share: float
    pairs: dict = field(default_factory=dict)        # log probability of character transitions
    dictionary: frozenset = frozenset()
    near: dict = field(default_factory=dict)         # log odds of neighbouring words
    path: dict = field(default_factory=dict)
    trees: list = field(default_factory=list)

    def shape(self, values: list[str]) -> np.ndarray:
        """Nine numbers of each value, all values at once: length, shares of digits, upper and lower case letters and signs,
        changes of class, entropy, mean log probability of neighbouring characters, share that the dictionary covers."""
        if not values:
            return np.zeros((0, 9))
        low = [v.lower() for v in values]
        low = [w if len(w) == len(v) else "".join(c.lower()[:1] for c in v) for v, w in zip(values, low)]
        n = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
        owner = np.repeat(np.arange(len(n)), n)
        starts = np.cumsum(n) - n
        code, lower = (np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) for x in (values, low))
        kind = np.full(len(code), 3, dtype=np.int64)
        for k, (first, last) in enumerate(((48, 57), (65, 90), (97, 122))):
            kind[(code >= first) & (code <= last)] = k
        shares = np.bincount(owner * 4 + kind, minlength=4 * len(n)).reshape(-1, 4) / n[:, None]
        together = owner[1:] == owner[:-1]
        changes = np.bincount(owner[1:][together & (kind[1:] != kind[:-1])], minlength=len(n)) / n
        each = np.sort(owner * (1 << 21) + code)
        heads = np.flatnonzero(np.diff(each, prepend=-1))
        times, whose = np.diff(np.append(heads, len(each))), each[heads] >> 21
        p = times / n[whose]
        entropy = -np.bincount(whose, weights=p * np.log2(p), minlength=len(n))
        pair = (lower[:-1] << 21 | lower[1:])[together]
        at = np.minimum(np.searchsorted(self._pair_keys, pair), max(len(self._pair_keys) - 1, 0))
        usual = np.full(len(pair), -9.0)
        if len(self._pair_keys):
            hit = self._pair_keys[at] == pair
            usual[hit] = self._pair_logs[at[hit]]
        usual = np.bincount(owner[1:][together], weights=usual, minlength=len(n)) / np.maximum(n - 1, 1)
        # the longest dictionary word that begins at each place, taken greedily from the left
        size = np.zeros(len(lower), dtype=np.int64)
        room = np.repeat(starts + n, n) - np.arange(len(lower))
        h = np.zeros(len(lower), dtype=np.uint64)
        for k in range(1, 9):
            if len(h) < k:
                break
            h = (h[:len(lower) - k + 1] ^ lower[k - 1:].astype(np.uint64)) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
            if k >= 3 and len(self._words[k]):
                place = np.minimum(np.searchsorted(self._words[k], h), len(self._words[k]) - 1)
                size[:len(h)][(self._words[k][place] == h) & (room[:len(h)] >= k)] = k
        covered, spot, end, left = np.zeros(len(n)), starts.copy(), starts + n, np.flatnonzero(n > 0)
        while len(left):
            step = size[spot[left]]
            covered[left] += step
            spot[left] += np.maximum(step, 1)
            left = left[spot[left] < end[left]]
        return np.column_stack([n, shares[:, 0], shares[:, 1], shares[:, 2], shares[:, 3], changes, entropy, usual, covered / n])

    def prepare(self) -> None:
        """Lookup arrays of the dictionaries, and the trees as flat arrays."""
        pairs = sorted((ord(p[0]) << 21 | ord(p[1]), v) for p, v in self.pairs.items())
        self._pair_keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self._pair_logs = np.array([v for _, v in pairs])
        self._words = {k: np.sort(np.array([_hash(w) for w in self.dictionary if len(w) == k], dtype=np.uint64)) for k in range(3, 9)}
        flat: list[list] = []

        def add(tree) -> int:
            at = len(flat)
            flat.append([-1, 0.0, at, at, tree if not isinstance(tree, tuple) else 0.0])
            if isinstance(tree, tuple):
                flat[at][:4] = tree[0], tree[1], add(tree[2]), add(tree[3])
            return at

        self._roots = np.array([add(t) for t in self.trees], dtype=np.int64)
        columns = list(zip(*flat)) if flat else [()] * 5
        self._feature, self._left, self._right = (np.array(columns[k], dtype=np.int64) for k in (0, 2, 3))
        self._cut, self._value = np.array(columns[1], dtype=float), np.array(columns[4], dtype=float)

    def context(self, path: str | None, before: str, after: str) -> list[float]:
        left, right = _neighbours(before, after)
        return [self.near.get(("l", left), 0.0), self.near.get(("r", right), 0.0), float(before[-1:] in "\"'="), self.path.get(path, 0.0)]

    def features(self, rows: list[tuple]) -> np.ndarray:
        """``rows``: (path, before, value, after)."""
        values = sorted({v for _, _, v, _ in rows})
        shapes = dict(zip(values, self.shape(values)))
        return np.array([[*shapes[v], *self.context(p, b, a)] for p, b, v, a in rows])

    def ask(self, x: np.ndarray) -> np.ndarray:
        """The forest's probability of every row: all trees go down side by side."""
        at = np.tile(self._roots, (len(x), 1))
        line = np.arange(len(x))[:, None]
        for _ in range(DEPTH + 1):
            f = self._feature[at]
            at = np.where(f < 0, at, np.where(x[line, f] <= self._cut[at], self._left[at], self._right[at]))
        return self._value[at].mean(axis=1)

    def most(self, values: list[str]) -> np.ndarray:
        """The highest probability that any surroundings could give to each value.

        Where a tree asks for the surroundings, both of its branches are followed.
        """
        if not self.trees:
            return np.full(len(values), self.share)
        shapes = self.shape(values)

        def below(tree, rows):
            if not isinstance(tree, tuple):
                return np.full(len(rows), tree)
            f, cut, left, right = tree
            if f >= shapes.shape[1]:
                return np.maximum(below(left, rows), below(right, rows))
            side, out = shapes[rows, f] <= cut, np.empty(len(rows))
            out[side], out[~side] = below(left, rows[side]), below(right, rows[~side])
            return out

        every = np.arange(len(values))
        return np.mean([below(t, every) for t in self.trees], axis=0)

    def score(self, rows: list[tuple]) -> np.ndarray:
        if not self.trees or not rows:
            return np.full(len(rows), self.share)
        return self.ask(self.features(rows))


def _hash(word: str) -> int:
    h = np.zeros(1, dtype=np.uint64)
    for c in word:
        h = (h ^ np.uint64(ord(c))) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return int(h[0])


def _neighbours(before: str, after: str) -> tuple[str, str]:
    left, right = _WORDS.search(before.lower()[::-1]), _WORDS.search(after.lower())
    return left.group()[::-1] if left else "", right.group() if right else ""


def _grow(x, y, rng, depth=0):
    """(feature, threshold, left, right), or the share of ones in a leaf."""
    p = y.mean()
    if depth >= DEPTH or len(y) < 2 * LEAF or p in (0.0, 1.0):
        return float(p)
    best = None
    for f in rng.choice(x.shape[1], size=max(1, int(math.sqrt(x.shape[1]))), replace=False):
        values = np.unique(x[:, f])
        between = (values[1:] + values[:-1]) / 2  # half-way, so that unseen values fall to the nearer side
        for cut in between[np.unique(np.linspace(0, len(between) - 1, SPLITS).astype(int))] if len(between) else ():
            side = x[:, f] <= cut
            k = side.sum()
            if LEAF <= k <= len(y) - LEAF:
                a, b = y[side].mean(), y[~side].mean()
                impurity = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
                if best is None or impurity < best[0]:
                    best = (impurity, int(f), float(cut), side)
    if best is None:
        return float(p)
    _, f, cut, side = best
    return f, cut, _grow(x[side], y[side], rng, depth + 1), _grow(x[~side], y[~side], rng, depth + 1)


def _log_odds(keys: list, y: np.ndarray, share: float) -> dict:
    """Smoothed log odds of a positive label for keys that are seen at least three times."""
    seen, ones = Counter(keys), Counter(k for k, v in zip(keys, y) if v)
    base = math.log((share + 1e-3) / (1 - share + 1e-3))
    return {k: math.log((ones[k] + share) / (n - ones[k] + 1 - share)) - base for k, n in seen.items() if n >= 3}


def train(findings: list[tuple], labels: list[int], seed: int = 5) -> Model:
    """``findings``: (path, before, value, after)."""
    y = np.array(labels, dtype=float)
    if len(set(labels)) < 2:
        return Model(float(y.mean()) if len(y) else 0.0)
    rng, share = np.random.default_rng(seed), float(y.mean())
    words = Counter(w for _, before, _, after in findings for w in _WORDS.findall((before + " " + after).lower()))
    chunks = Counter()
    pairs: Counter = Counter()
    for w, n in words.items():
        for i in range(len(w) - 1):
            pairs[w[i:i + 2]] += n
        if 3 <= len(w) <= 8:
            chunks[w] += n
    total = sum(pairs.values()) or 1
    model = Model(share, {p: math.log(n / total) for p, n in pairs.items()}, frozenset(w for w, n in chunks.items() if n >= 3))
    model.prepare()
    sides = [_neighbours(b, a) for _, b, _, a in findings]
    model.near = {**_log_odds([("l", left) for left, _ in sides], y, share), **_log_odds([("r", right) for _, right in sides], y, share)}
    model.path = _log_odds([p for p, _, _, _ in findings], y, share)
    x = model.features(findings)
    for _ in range(TREES):
        pick = rng.integers(0, len(y), len(y))
        model.trees.append(_grow(x[pick], y[pick], rng))
    model.prepare()
    return model


#: Rows of a batch whose candidates are held at once in training, and characters of texts that are scanned at once.
HELD, CHARS = 64, 1 << 20


def _each(batches: Iterator[pa.RecordBatch], plain: int = 1):
    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            part = batch.slice(at, HELD)
            rows = zip(*(part.column(n).to_pylist() for n in ("id", "path", "text")))
            yield [(i, p, *c, k) for k, (i, p, t) in enumerate(rows) for c in found(t, plain)]


def _portions(batch: pa.RecordBatch):
    """Rows (id, path, text) in portions of about ``CHARS`` characters."""
    rows, size = [], 0
    for k in range(batch.num_rows):
        rows.append(tuple(batch.column(n)[k].as_py() for n in ("id", "path", "text")))
        size += len(rows[-1][2] or "")
        if size >= CHARS:
            yield rows
            rows, size = [], 0
    yield rows


def _in_token(token: str) -> list[str]:
    """The candidates of :func:`found` that a run of key characters and marks holds."""
    values = _RUN.findall(token)
    if not token.isalnum():
        end = len(token.rstrip(".!?,"))
        start = len(token) - len(token.lstrip(_MARK))
        if end - start >= LEAST:
            values.append(token[start:end])
    return values


def _in_signs(text: str) -> set[str]:
    """The other candidates of :func:`found`: quoted and assigned values, and passwords in addresses."""
    values = set()
    for kind, signs in zip(_VALUES, ("=:", "\"'", "@")):
        if any(c in text for c in signs):
            for m in kind.finditer(text):
                values.add(m.group(m.lastindex))
                if kind is _VALUES[0] and m.lastindex == 3:
                    values.add(re.split("[\"'<>]", m.group(3), maxsplit=1)[0].rstrip(",;.)]}"))
    return values - {""}


class Scanner:
    """Secrets of many texts.  A text is taken apart only if it holds a value that some surroundings could make a secret.

    For each distinct value the forest's highest probability is worked out once (:meth:`Model.most`); below the
    threshold the value is no secret wherever it stands, so nothing is lost.  Tokens of earlier texts are remembered.
    """

    def __init__(self, model: Model, threshold: float):
        self.model, self.threshold, self.hopeful = model, threshold, {}

    def _judge(self, tokens: set[str], values: set[str]) -> None:
        """Fill ``hopeful`` for new tokens (any value in it) and values."""
        if len(self.hopeful) > SHAPES:
            self.hopeful.clear()
        parts = {t: _in_token(t) for t in tokens if ("t", t) not in self.hopeful}
        new = sorted({v for p in parts.values() for v in p} | {v for v in values if ("v", v) not in self.hopeful})
        best = dict(zip(new, (self.model.most(new) >= self.threshold - 1e-9).tolist()))
        self.hopeful.update((("t", t), any(best[v] for v in p)) for t, p in parts.items())
        self.hopeful.update((("v", v), hope) for v, hope in best.items())

    def secrets(self, rows: list[tuple]) -> list[tuple]:
        """(id, start, length, probability) of ``rows`` (id, path, text)."""
        tokens = [set(_MARKED.findall(t)) if t else set() for _, _, t in rows]
        signs = [_in_signs(t) if t else set() for _, _, t in rows]
        self._judge(set().union(*tokens), set().union(*signs))
        hope = self.hopeful
        spans = [(i, p, *c, k) for k, (i, p, text) in enumerate(rows)
                 if any(hope["t", t] for t in tokens[k]) or any(hope["v", v] for v in signs[k])
                 for c in found(text, skip=lambda t: not hope["t", t])]
        self._judge(set(), {r[3] for r in spans})
        asked = [r for r in spans if hope["v", r[3]]]
        scores = self.model.score([(p, before, value, after) for _, p, _, value, before, after, _ in asked])
        kept, last, till = [], None, 0
        for r, s in sorted(((asked[i], float(scores[i])) for i in np.flatnonzero(scores >= self.threshold)), key=lambda x: (x[0][6], x[0][2], -len(x[0][3]))):
            if r[6] != last or r[2] >= till:
                kept.append((r[0], r[2], len(r[3]), s))
                last, till = r[6], r[2] + len(r[3])
        return kept


_CANDIDATES = pa.schema([("id", pa.int64()), ("path", pa.string()), ("start", pa.int64()), ("value", pa.string()), ("before", pa.string()),
                         ("after", pa.string())])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source",
               plain: int = 1) -> DataFrame:
    """``(id, path, start, value, before, after)`` of every candidate (``plain``: see :func:`found`)."""

    def run(batches):
        for rows in _each(batches, plain):
            columns = list(zip(*rows))[:6] if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CANDIDATES)], schema=_CANDIDATES)

    return _read(docs, id_col, text_col, path_col).mapInArrow(run, "id long, path string, start long, value string, before string, after string")


def _read(docs, id_col, text_col, path_col):
    return docs.select(column(id_col).cast("bigint").alias("id"), column(path_col).cast("string").alias("path"),
                       column(text_col).cast("string").alias("text"))


def fit(findings: DataFrame, limit: int = FINDINGS) -> Model:
    """A forest from a table ``(path, before, value, after, label)``."""
    usable = findings.where("value IS NOT NULL AND label IN (0, 1)").select(
        "path", F.coalesce("before", F.lit("")).alias("before"), "value", F.coalesce("after", F.lit("")).alias("after"), "label")
    # equal findings are one row with a number, so that none of them is common; the hash picks a little more than the bound of each kind
    kind = [F.col("label").alias("a"), (F.length("value") >= LONG).alias("b"), F.col("before").rlike("[\"'=:][ \t]*$").alias("c")]
    keyed = settled(usable.groupBy(*usable.columns).agg(F.count("*").alias("times")).select("*", F.struct(*kind).alias("kind"), F.xxhash64("value", "before", "after", "path").alias("hash")))
    counts = {tuple(r["kind"]): r["n"] for r in keyed.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    wanted = limit + 10 * math.isqrt(limit) + 10
    reach = {k: min(-(1 << 63) + (1 << 64) * wanted // n, (1 << 63) - 1) for k, n in counts.items()}
    picked = functools.reduce(lambda a, b: a | b, [
        (F.col("kind.a") == a) & (F.col("kind.b") == b) & (F.col("kind.c") == c) & (F.col("hash") <= top) for (a, b, c), top in reach.items()], F.lit(False))
    ranked: dict[tuple, list] = {}
    for r in keyed.where(picked).collect():
        ranked.setdefault(tuple(r["kind"]), []).append(r)
    rows = []
    for group in ranked.values():
        group.sort(key=lambda r: (r["hash"], r["value"], r["before"], r["after"], r["path"] or ""))
        rows += itertools.islice((r for r in group for _ in range(r["times"])), limit)
    rows.sort(key=lambda r: (r["value"], r["before"], r["after"], r["path"] or "", r["label"]))
    return train([(r["path"], r["before"], r["value"], r["after"]) for r in rows], [r["label"] for r in rows])


def scan(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
         path_col: str = "source") -> DataFrame:
    """One row per secret: id, start (character, from 0), length, probability."""
    sent = cloudpickle.dumps(model)

    def run(batches):
        scanner = Scanner(pickle.loads(sent), threshold)
        for batch in batches:
            for part in _portions(batch):
                kept = scanner.secrets(part)
                columns = list(zip(*kept)) if kept else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                                                 ["id", "start", "length", "probability"])

    return _read(docs, id_col, text_col, path_col).mapInArrow(run, "id long, start long, length long, probability double").withColumnRenamed("id", id_col)


def labelled(docs: DataFrame) -> DataFrame:
    """Findings of ``documents`` with a reviewer's rule as label.

    The tables hold no labelled findings, so a rule stands in for the reviewer: an access key
    of fixed form, a value that is assigned to a password or token, or the password of an address.  The forest is given
    neither the rule nor its patterns.
    """
    rule = (F.col("value").rlike("^AKIA[A-Z0-9]{16}$")
            | F.col("before").rlike("(?i)(password|passwd|secret|token|api[_-]?key)\\s*[=:]\\s*[\"']?$")
            | (F.col("before").rlike("://[^\\s/:@]*:$") & F.col("after").startswith("@")))
    return candidates(docs.where(~held_out()), plain=PLAIN).select("path", "before", "value", "after", rule.cast("int").alias("label"))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(labelled(docs)))
