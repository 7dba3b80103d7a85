"""Language ID for code-switched text with a linear-chain conditional random field.

Every word (a run of letters, lower-cased) is labelled with a language.  The potential of
a word is a sum over its hashed character n-grams, where those that touch the marks before
and after the word are its affixes, and over its entry in a lexicon learned from the
training words.  Transitions between neighbouring words are learned too, from sequences
that are spliced out of pieces of different languages.  Labels of words are the marginals
of the forward-backward algorithm; a text gets the language with the largest share of
them, and that share as its score.

Training takes at most ``rows_per_language`` labelled rows of each language, chosen by a
hash of the identifier among the rows that models may learn from, and runs on the driver
in numpy; the model is 4 bytes for each bucket and language (a few MB) and goes out with
the tasks.  Labelling is a map over all rows and whole texts without a shuffle.

Forward-backward runs over all texts of a batch at once: texts are cut into blocks of
``BLOCK`` words, the blocks' transfer matrices are multiplied side by side, and the messages
at the borders of blocks follow from them, so the result is that of one pass over each
whole text.

Defined results: null texts and texts without letters are ``und`` with score 0; ties go to
the language that sorts first; identifiers, sources and labels are never inputs of a
prediction; rows without identifier or label are predicted like all others.  With no
labelled row at all, every text is ``und``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import subwords
from lodestone.llm.common import bounded_sample, column, held_out, packed, table, unpacked

ROWS_PER_LANGUAGE = 200
BUCKETS = 1 << 17
SIZES = (1, 2, 3, 4)
BLOCK = 64
#: Words between two splices in the training sequences, and the chance of a new language there.
PIECE, SWITCH = 20, 0.25
#: A word enters the lexicon when it was seen so often, this purely.
SEEN, PURE = 3, 0.8
UND = "und"
#: Words and n-grams that one step of the training holds with all their temporaries.
WORDS, GRAMS = 1 << 15, 1 << 18


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray      # buckets x languages
    lexicon: dict[str, int]
    known: np.ndarray      # languages x languages: lexicon language -> potential
    steps: np.ndarray      # log potentials of transitions
    start: np.ndarray

    def words(self, types: list[str]) -> np.ndarray:
        """Potentials of the types."""
        bucket, owner = subwords.grams(types, SIZES, len(self.grams))
        k = len(self.languages)
        out = subwords.add_at(owner, self.grams[bucket].astype(np.float64), len(types)) if len(types) else np.zeros((0, k))
        entry = np.array([self.lexicon.get(t, -1) for t in types], dtype=np.int64)
        out[entry >= 0] += self.known[entry[entry >= 0]]
        return out


def marginals(potential: np.ndarray, ends: np.ndarray, steps: np.ndarray, start: np.ndarray,
              want_steps: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of every word of every sequence; with ``want_steps`` also expected transitions.

    ``potential``: words x labels; sequences are ``ends[i]:ends[i + 1]``.
    """
    n, k = potential.shape
    psi = np.exp(potential - potential.max(axis=1, keepdims=True)) if n else potential
    move, first = np.exp(steps - steps.max()), np.exp(start - start.max())
    lengths = np.diff(ends)
    full = lengths > 0
    begins, lengths = ends[:-1][full], lengths[full]
    if not len(lengths):
        return np.zeros((0, k)), (np.zeros((k, k)) if want_steps else None)
    per = -(-lengths // BLOCK)                                   # blocks of each sequence
    block_seq = np.repeat(np.arange(len(per)), per)
    number = np.arange(len(block_seq)) - np.repeat(np.cumsum(per) - per, per)
    at = begins[block_seq] + number * BLOCK
    size = np.minimum(BLOCK, begins[block_seq] + lengths[block_seq] - at)
    order = np.argsort(-size, kind="stable")                     # longest first: the active blocks are a prefix
    at, size, number, block_seq = at[order], size[order], number[order], block_seq[order]
    active = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks with more than t words
    head = number == 0

    # transfer matrix of each block; the first word of a text has no transition before it
    inner = np.where(head[:, None, None], np.eye(k), move)       # step into the first word of the block
    matrix = inner * psi[at][:, None, :]
    for t in range(1, BLOCK):
        m = active[t]
        if not m:
            break
        matrix[:m] = (matrix[:m] @ move) * psi[at[:m] + t][:, None, :]
        matrix[:m] /= matrix[:m].sum(axis=(1, 2), keepdims=True)

    # messages at the borders, over the blocks of each text in turn
    nb = len(at)
    place = np.empty(nb, dtype=np.int64)
    place[np.lexsort((number, block_seq))] = np.arange(nb)        # position in text order
    in_order = np.argsort(place)
    ahead = np.empty((nb, k))
    back = np.empty((nb, k))
    start_of = np.cumsum(per) - per
    longest = int(per.max())
    message = np.tile(first, (len(per), 1))
    by_length = np.argsort(-per, kind="stable")
    alive = np.searchsorted(-per[by_length], -np.arange(longest), side="left")
    for b in range(longest):
        rows = by_length[:alive[b]]
        blocks = in_order[start_of[rows] + b]
        ahead[blocks] = message[rows]
        message[rows] = np.einsum("ni,nij->nj", message[rows], matrix[blocks])
        message[rows] /= message[rows].sum(axis=1, keepdims=True)
    message = np.ones((len(per), k))
    for b in range(longest - 1, -1, -1):
        rows = by_length[:alive[b]]
        blocks = in_order[start_of[rows] + b]
        back[blocks] = message[rows]
        message[rows] = np.einsum("nij,nj->ni", matrix[blocks], message[rows])
        message[rows] /= message[rows].sum(axis=1, keepdims=True)

    # forward and backward within the blocks
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    a = np.einsum("ni,nij->nj", ahead, inner) * psi[at]
    a /= a.sum(axis=1, keepdims=True)
    alpha[at] = a
    for t in range(1, BLOCK):
        m = active[t]
        if not m:
            break
        a[:m] = (a[:m] @ move) * psi[at[:m] + t]
        a[:m] /= a[:m].sum(axis=1, keepdims=True)
        alpha[at[:m] + t] = a[:m]
    last = at + size - 1
    beta[last] = back
    b_ = back.copy()
    for t in range(BLOCK - 1, 0, -1):
        m = active[t]
        if not m:
            continue
        b_[:m] = (psi[at[:m] + t] * b_[:m]) @ move.T
        b_[:m] /= b_[:m].sum(axis=1, keepdims=True)
        beta[at[:m] + t - 1] = b_[:m]
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    if not want_steps:
        return gamma, None
    later = np.ones(n, dtype=bool)
    later[begins] = False
    later = np.flatnonzero(later)
    pair = alpha[later - 1][:, :, None] * move[None] * (psi[later] * beta[later])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return gamma, pair.sum(axis=0)


def _spliced(codes: np.ndarray, ends: np.ndarray, labels: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training sequences of about five pieces each: word types, their labels, bounds."""
    pieces: dict[int, list[np.ndarray]] = {}
    for i, label in enumerate(labels):
        own = codes[ends[i]:ends[i + 1]]
        pieces.setdefault(int(label), []).extend(own[s:s + PIECE] for s in range(0, len(own), PIECE))
    stacks = {k: [v[j] for j in rng.permutation(len(v))] for k, v in pieces.items()}
    words, tags, bounds, label = [], [], [0], None
    while stacks:
        if label not in stacks or len(stacks) > 1 and rng.random() < SWITCH:
            left = sorted(stacks)
            weights = np.array([len(stacks[k]) for k in left], dtype=float)
            label = int(rng.choice(left, p=weights / weights.sum()))
        piece = stacks[label].pop()
        if not stacks[label]:
            del stacks[label]
        words.append(piece)
        tags.append(np.full(len(piece), label))
        if len(words) % 5 == 0 or not stacks:
            bounds.append(sum(map(len, words)) if len(bounds) == 1 else bounds[-1] + sum(map(len, words[-((len(words) - 1) % 5 + 1):])))
    return np.concatenate(words), np.concatenate(tags), np.array(bounds, dtype=np.int64)


def train(texts: list[str], labels: list[str], rounds: int = 30, seed: int = 7) -> Model | None:
    """Maximise the likelihood of the words' labels; a word has the label of its text."""
    languages = sorted(set(labels))
    if not languages:
        return None
    return _learned(languages, np.array([languages.index(x) for x in labels]), *_numbered(texts), rounds, seed)


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The words of the texts as numbers, the bounds of the texts, and the distinct words."""
    flat, ends = subwords.tokens(texts, subwords.LETTERS)
    codes, types = subwords.distinct(flat)
    return codes.astype(np.int32), ends, types


def _slabs(n: int, size: int):
    return ((at, min(at + size, n)) for at in range(0, n, size))


def _learned(languages: list[str], label: np.ndarray, codes: np.ndarray, ends: np.ndarray, types: list[str], rounds: int = 30,
             seed: int = 7) -> Model:
    """Gradients are added up over slabs of ``WORDS`` words and ``GRAMS`` n-grams; beside the slab that is at work
    only the words' numbers and a row per distinct word are held."""
    k, rng = len(languages), np.random.default_rng(seed)
    model = Model(languages, np.zeros((BUCKETS, k), dtype=np.float32), {}, np.zeros((k, k)), np.zeros((k, k)), np.zeros(k))
    if not len(codes):
        return model
    words, tags, bounds = _spliced(codes, ends, label, rng)
    words, tags = words.astype(np.int32), tags.astype(np.int8)
    n, size = len(words), len(types)
    seen = np.stack([np.bincount(words[tags == c], minlength=size) for c in range(k)], axis=1)
    top, total = seen.argmax(axis=1), seen.sum(axis=1)
    pure = (total >= SEEN) & (seen.max(axis=1) >= PURE * total)
    model.lexicon = {types[i]: int(top[i]) for i in np.flatnonzero(pure)}
    entry = np.where(pure, top, -1)
    bucket, owner = (x.astype(np.int32) for x in subwords.grams(types, SIZES, BUCKETS))
    del types, codes, label
    heads = bounds[:-1][bounds[:-1] < n]
    gold_steps = np.zeros((k, k))
    for a, b in _slabs(n - 1, WORDS):
        inside = np.ones(b - a, dtype=bool)
        inside[heads[(heads > a) & (heads <= b)] - 1 - a] = False
        np.add.at(gold_steps, (tags[a:b][inside], tags[a + 1:b + 1][inside]), 1.0)
    # whole sequences of about WORDS words
    cuts = np.unique(np.append(np.searchsorted(bounds, np.arange(0, n, WORDS)), len(bounds) - 1))
    weights = [np.zeros((BUCKETS, k)), model.known, model.steps, model.start]
    squares = [np.full_like(w, 1e-6) for w in weights]
    for _ in range(rounds):
        emit = np.zeros((size, k))
        emit[entry >= 0] = weights[1][entry[entry >= 0]]
        for a, b in _slabs(len(bucket), GRAMS):
            subwords.add_into(emit, owner[a:b], weights[0][bucket[a:b]])
        by_type, steps, start = np.zeros((size, k)), np.zeros((k, k)), np.zeros(k)
        for a, b in zip(cuts, cuts[1:]):
            own, first = bounds[a:b + 1] - bounds[a], bounds[a]
            mine, gold = words[first:bounds[b]], tags[first:bounds[b]]
            gap, moved = marginals(emit[mine], own, weights[2], weights[3], want_steps=True)
            steps += moved
            np.negative(gap, out=gap)
            gap[np.arange(len(gap)), gold] += 1.0
            start += gap[own[:-1][own[:-1] < len(gap)]].sum(axis=0)
            subwords.add_into(by_type, mine, gap)
        by_type /= n
        grams = np.zeros((BUCKETS, k))
        for a, b in _slabs(len(bucket), GRAMS):
            subwords.add_into(grams, bucket[a:b], by_type[owner[a:b]])
        grams -= 1e-6 * weights[0]
        slopes = [grams, subwords.add_at(np.maximum(entry, 0), by_type * (entry >= 0)[:, None], k) - 1e-6 * weights[1],
                  (gold_steps - steps) / n - 1e-6 * weights[2], start / n - 1e-6 * weights[3]]
        for w, s, g in zip(weights, squares, slopes):
            s += g * g
            w += 0.3 * g / np.sqrt(s)
    model.grams = weights[0].astype(np.float32)
    model.known, model.steps, model.start = weights[1], weights[2], weights[3]
    return model


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    flat, ends = subwords.tokens(texts, subwords.LETTERS)
    langs, scores = [UND] * len(texts), [0.0] * len(texts)
    if model is None or not flat:
        return langs, scores
    codes, types = subwords.distinct(flat)
    spelled = np.array([any(map(str.isalpha, t)) for t in types], dtype=float)[codes]
    gamma, _ = marginals(model.words(types)[codes], ends, model.steps, model.start)
    mass = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(gamma * spelled[:, None], axis=0)])
    share = mass[ends[1:]] - mass[ends[:-1]]
    total = share.sum(axis=1)
    for i in np.flatnonzero(total > 1e-9):
        best = int(share[i].argmax())
        langs[i], scores[i] = model.languages[best], float(min(1.0, share[i, best] / total[i]))
    return langs, scores


def _predictor(sent: bytes, words: int = 1 << 19):
    """Labels batches in groups of texts of about ``words`` words, so memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent)
        for batch in batches:
            langs, scores, held, size = [], [], [], 0
            for text in batch.column("text").to_pylist():
                held.append(text)
                size += len(text or "") // 6
                if size >= words:
                    a, b = predict(model, held)
                    langs, scores, held, size = langs + a, scores + b, [], 0
            a, b = predict(model, held)
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(langs + a, pa.string()), pa.array(scores + b, pa.float64())],
                                             [*rest.schema.names, "lang_pred", "score"])

    return run


def sample(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
           lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """At most ``rows_per_language`` labelled rows of each language, by hash of the identifier."""
    from_these = docs.where(column(lang_col).isNotNull() & column(text_col).isNotNull() & ~held_out(id_col)).select(
        column(id_col).cast("string").alias("id"), column(lang_col).cast("string").alias("lang"), column(text_col).cast("string").alias("text"))
    rows = bounded_sample(from_these, "lang", rows_per_language)
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, **columns) -> Model | None:
    texts, labels = sample(docs, rows_per_language, **columns)
    languages = sorted(set(labels))
    given = _numbered(texts)
    del texts
    return _learned(languages, np.array([languages.index(x) for x in labels]), *given) if languages else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    rows = docs.select(column(id_col).alias(id_col), held_out(id_col).alias("held_out"), column(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_predictor(cloudpickle.dumps(model)), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def in_languages(docs: DataFrame, model: Model | None, wanted: tuple[str, ...] | None = None, least: float = 0.4,
                 text_col: str = "text") -> DataFrame:
    """``docs`` without those that no language holds.

    Rejected are ``und``, languages outside of ``wanted`` (all learned ones if null), and
    texts whose main language has less than the share ``least`` of their words.
    """
    rows = packed(docs, column(text_col).cast("string").alias("text"))
    named = rows.mapInArrow(_predictor(cloudpickle.dumps(model)), rows.select("_row").schema.add("lang_pred", "string").add("score", "double"))
    held = (F.col("lang_pred") != UND) & (F.col("score") >= least)
    if wanted is not None:
        held = held & F.col("lang_pred").isin(*wanted)
    return unpacked(named.where(held))


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
