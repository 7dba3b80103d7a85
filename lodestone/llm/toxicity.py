"""Toxicity with subword-bag embeddings averaged into a linear softmax.

A word (a run of letters and digits, lower-cased) is the average of the embeddings of its
hashed character n-grams, a passage of ``PASSAGE`` words the average of its words, and a
softmax over the passage's vector gives the two classes; embeddings and softmax are trained
together in numpy.  As a few words make a text toxic, a text is as toxic as its worst
passage: in training, passages of toxic texts count by their own score so far, so that the
toxic ones win.  A misspelt word shares most n-grams with the word it stands for.

Scores are calibrated (Platt) on labelled rows that the embeddings have not seen, with the
classes weighted as they occur among all labels that may be used.

Training takes at most ``ROWS`` labelled rows of each class, chosen by a hash of the
identifier, on the driver; afterwards only one number per bucket is needed, so the model
that goes out with the tasks is ``BUCKETS`` * 4 bytes.  Scoring is a map over whole texts
without a shuffle.

Defined results: null and empty texts, and texts without letters or digits, get the score
of an empty passage; labels, lang, source and identifiers are never inputs of a score; rows
without identifier or label are scored like all others.  Without labels of both classes the
score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import subwords
from lodestone.llm.common import bounded_sample, column, held_out, table

ROWS = 800
BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIMENSIONS = 8
PASSAGE = 3
THRESHOLD = 0.3
#: Step size, and the number of training texts that an n-gram needs.
STEP, LEAST = 0.4, 10
#: Start of the squared slopes, and range of the first embeddings.
DAMP, INIT = 1e-9, 0.05


@dataclass
class Model:
    value: np.ndarray    # of each bucket: its embedding's weight for the toxic class
    bias: float
    slope: float
    offset: float


def passages(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the passages of all texts, and the text of each passage."""
    lengths = np.diff(ends)
    per = -(-lengths // PASSAGE)
    text = np.repeat(np.arange(len(lengths)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    starts = ends[:-1][text] + number * PASSAGE
    return np.append(starts, ends[-1]), text


def _means(owner: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    return subwords.add_at(owner, rows, size) / np.maximum(np.bincount(owner, minlength=size), 1)[:, None]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def raw(value: np.ndarray, bias: float, texts: list[str | None]) -> np.ndarray:
    """The score of the worst passage of each text, before calibration."""
    flat, ends = subwords.tokens(texts, subwords.ALNUM)
    out = np.full(len(texts), bias)
    if not flat:
        return out
    codes, types = subwords.distinct(flat)
    bucket, owner = subwords.grams(types, SIZES, len(value))
    words = np.bincount(owner, weights=value[bucket], minlength=len(types)) / np.maximum(np.bincount(owner, minlength=len(types)), 1)
    bounds, text = passages(ends)
    scores = np.add.reduceat(words[codes], bounds[:-1]) / np.diff(bounds) + bias
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, text, scores)
    return np.where(np.isfinite(top), top, out)


def train(texts: list[str], toxic: list[int], share: float, rounds: int = 25, seed: int = 11) -> Model:
    """``share`` is that of toxic rows among all labels, for the calibration."""
    y = np.array(toxic, dtype=np.int64)
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    fold = np.arange(len(y)) % 4 == 3
    flat, ends = subwords.tokens([t for t, f in zip(texts, fold) if not f], subwords.ALNUM)
    value, bias = np.zeros(BUCKETS), 0.0
    if flat:
        value, bias = _embed(flat, ends, y[~fold], rounds, seed)
    kept = np.flatnonzero(fold) if len(set(y[fold])) == 2 else np.arange(len(y))
    scores = raw(value, bias, [texts[i] for i in kept])
    slope, offset = _platt(scores, y[kept], share)
    return Model(value.astype(np.float32), bias, slope, offset)


def _embed(flat, ends, y, rounds, seed):
    rng = np.random.default_rng(seed)
    codes, types = subwords.distinct(flat)
    bucket, owner = subwords.grams(types, SIZES, BUCKETS)
    grams_of = np.maximum(np.bincount(owner, minlength=len(types)), 1)
    bounds, text = passages(ends)
    sizes = np.diff(bounds)
    passage = np.repeat(np.arange(len(sizes)), sizes)
    label = y[text]
    per_text = np.bincount(text, minlength=len(y))
    table_, out, bias = rng.uniform(-INIT, INIT, (BUCKETS, DIMENSIONS)), rng.uniform(-0.5, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    # n-grams of too few training texts say nothing
    pair = np.unique(np.repeat(np.arange(len(y)), np.diff(ends)) * len(types) + codes)
    texts_of = np.bincount(pair % len(types), minlength=len(types))
    met = np.bincount(bucket, weights=texts_of[owner], minlength=BUCKETS) >= LEAST
    table_[~met] = 0.0
    squares = [np.full_like(table_, DAMP), np.full_like(out, DAMP), np.full_like(bias, DAMP)]
    balance = np.array([0.5 / max(1, (y == k).sum()) for k in (0, 1)])
    share = 1.0 / per_text[text]
    for turn in range(rounds):
        words = _means(owner, table_[bucket], len(types))
        vectors = subwords.add_at(passage, words[codes], len(sizes)) / sizes[:, None]
        logits = vectors @ out + bias
        margin = logits[:, 1] - logits[:, 0]
        p = _sigmoid(margin)
        if turn >= 4:
            # a text's weight goes to its worst passages, sharper with every round
            sharp = np.exp(min(6.0, 0.5 + 0.25 * turn) * np.clip(margin - _max_by(margin, text, len(y))[text], -30, 0))
            share = sharp / np.bincount(text, weights=sharp, minlength=len(y))[text]
            # passages of harmless texts are all harmless
            share = np.where(label == 1, share, 0.5 * share + 0.5 / per_text[text])
        slope = (p - label) * share * balance[label]
        d = np.stack([-slope, slope], axis=1)
        d_vec = (d @ out.T) / sizes[:, None]
        d_types = subwords.add_at(codes, d_vec[passage], len(types)) / grams_of[:, None]
        for w, s, g in ((table_, squares[0], subwords.add_at(bucket, d_types[owner], BUCKETS) * met[:, None]), (out, squares[1], vectors.T @ d),
                        (bias, squares[2], d.sum(axis=0))):
            s += g * g
            w -= STEP * g / np.sqrt(s)
    return np.where(met, table_ @ (out[:, 1] - out[:, 0]), 0.0), float(bias[1] - bias[0])


def _max_by(values: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    top = np.full(size, -np.inf)
    np.maximum.at(top, group, values)
    return top


def _platt(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic regression on one number by Newton steps, classes weighted to ``share``."""
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    center, scale = x.mean(), x.std() or 1.0
    z = (x - center) / scale
    a, b = 1.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    for _ in range(50):
        p = _sigmoid(a * z + b)
        g, h = weight * (p - y), weight * p * (1 - p)
        slope = np.array([(g * z).sum() + 1e-2 * a, g.sum()])
        bend = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        step = np.clip(np.linalg.solve(bend, slope), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    a = max(a, 1e-6)
    return a / scale, b - a * center / scale


def probability(model: Model, texts: list[str | None]) -> np.ndarray:
    return _sigmoid(model.slope * raw(model.value, model.bias, texts) + model.offset)


def _scorer(sent: bytes, chars: int = 4 << 20):
    """Scores batches in groups of texts of about ``chars`` characters, so memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent)
        for batch in batches:
            out, held, size = [], [], 0
            for text in batch.column("text").to_pylist():
                held.append(text)
                size += len(text or "")
                if size >= chars:
                    out.append(probability(model, held))
                    held, size = [], 0
            out.append(probability(model, held))
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.concatenate(out), pa.float64())], [*rest.schema.names, "score"])

    return run


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic") -> tuple[list[str], list[int], float]:
    """At most ``rows`` texts of each class, and the share of toxic labels, over rows that may be learned from."""
    usable = labels.where(column(label_col).isin(0, 1) & column(id_col).isNotNull() & ~held_out(id_col)).select(
        column(id_col).alias("id"), column(label_col).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    ranked = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = usable.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= rows).select("id", "label")
    by_id = dict(sorted((r["id"], r["label"]) for r in chosen.collect()))
    label = functools.reduce(lambda c, k: c.when(F.col("id").isin([i for i, v in by_id.items() if v == k]), k), (0, 1), F.when(F.lit(False), 0))
    texts = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    # an identifier can have several documents: they are ranked in their turn
    found = bounded_sample(texts.where(F.col("id").isin(list(by_id))).withColumn("label", label), "label", rows) if by_id else []
    total = sum(counts.values())
    return [r["text"] or "" for r in found], [by_id[r["id"]] for r in found], counts.get(1, 0) / total if total else 0.0


def fit(docs: DataFrame, labels: DataFrame, **how) -> Model:
    return train(*sample(docs, labels, **how))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    rows = docs.select(column(id_col).alias(id_col), held_out(id_col).alias("held_out"), column(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_scorer(cloudpickle.dumps(model)), f"`{id_col}` {kind}, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
