"""The pipeline, stage by stage, against brute force over all rows."""

import collections
import hashlib
import re

import pytest

import corpus_pipeline
from lodestone.llm import language, mixing

SF = "/root/testdata/sf0.001"
WHITE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in WHITE.split((text or "").lower()) if w]


def classes(nodes, pairs):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def in_languages(docs, model):
    """Texts of which a learned language has two fifths of the words."""
    langs, scores = language.predict(model, [d.text for d in docs])
    return [d for d, lang, score in zip(docs, langs, scores) if lang != "und" and score >= 0.4]


def without_copies(docs):
    first = {}
    for d in docs:
        first[d.text or ""] = min(first.get(d.text or "", d.doc_id), d.doc_id)
    return [d for d in docs if first[d.text or ""] == d.doc_id]


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def without_near_copies(docs):
    """Of each component of similarity 0.8 the smallest identifier stays."""
    sets, holders = {d.doc_id: shingle_set(d.text) for d in docs}, collections.defaultdict(list)
    pairs = set()
    for doc, own in sets.items():
        for s in own:
            for other in holders[s]:
                pairs.add((other, doc))
            holders[s].append(doc)
    like = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    top = classes(list(sets), like)
    return [d for d in docs if top[d.doc_id] == d.doc_id]


def leaks(text, items):
    """Any window of an item's number of words with weighted similarity 0.8 or more."""
    w = words_of(text)
    runs = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    for n, wanted in items:
        at = [i for i, r in enumerate(runs) if r in wanted]
        size = sum(wanted.values())
        for start in {s for i in at for s in range(max(0, i - size + 1), min(i, max(0, len(runs) - size)) + 1)}:
            own = collections.Counter(runs[start:start + size])
            both = sum((own & wanted).values())
            if both >= 0.8 * (size + sum(own.values()) - both):
                return True
    return False


def copies(docs):
    """How often each document is taken, from the sizes of all sources."""
    size = {d.doc_id: len([w for w in WHITE.split(d.text or "") if w]) for d in docs}
    total = collections.Counter()
    for d in docs:
        total[d.source] += size[d.doc_id]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, left, budget = {}, set(order), sum(total.values())
    while left:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * total[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s], budget = 3 * total[s], budget - 3 * total[s]
        left -= over
    out = {}
    for d in docs:
        rate = target[d.source] / total[d.source] if total[d.source] else 0.0
        u = int(hashlib.md5(f"{mixing.SEED}/{d.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[d.doc_id] = int(rate) + (u < rate - int(rate))
    return out


@pytest.mark.parametrize("sf", [SF])
def test_every_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    items = [(len(w), collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)))
             for w in (words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()) if len(w) >= 5]
    brute = [lambda d: in_languages(d, model), without_copies, without_near_copies, lambda d: [x for x in d if not leaks(x.text, items)]]
    rows, now = docs.collect(), docs
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], brute):
        now = stage(spark, now, sf)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
        rows = plain(rows)
        assert sorted(r.doc_id for r in now.collect()) == sorted(r.doc_id for r in rows), name
    taken = collections.Counter(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, sf).collect())
    assert taken == {i: n for i, n in copies(rows).items() if n}
    assert len(rows) < docs.count()


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = now = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert got.columns == [*docs.columns, "copy"]
    assert sorted(map(repr, got.select("doc_id", "copy").collect())) == sorted(map(repr, now.select("doc_id", "copy").collect()))
