"""Packing: every identifier in one piece, windows full, steps balanced, odd rows."""

import collections
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def identifiers():
    with open(packing.vocabulary_path(), encoding="utf-8") as f:
        return packing.Identifiers(f.read())


def direct(identifiers, text):
    return identifiers.tokenizer.encode(text or "", add_special_tokens=False).ids


def check_windows(rows, texts, identifiers):
    """Pieces of (doc_id, text) pairs, each identifier one document."""
    of = collections.defaultdict(list)
    for r in rows:
        assert r.size & (r.size - 1) == 0 and r.size <= 2048 and len(r.ids) == 4 * r.size
        assert [p.offset for p in r.pieces] == [sum(q.length for q in r.pieces[:k]) for k in range(len(r.pieces))]
        ids = np.frombuffer(r.ids, "<u4").tolist()
        for p in r.pieces:
            of[p.id].append((p.start, ids[p.offset:p.offset + p.length], p.doc_tokens))
    assert set(of) == set(texts)
    for key, text in texts.items():
        whole = direct(identifiers, text) + [1]
        got = sorted(of[key])
        assert [x for _, part, _ in got for x in part] == whole
        assert [start for start, _, _ in got] == [sum(len(p[1]) for p in got[:k]) for k in range(len(got))]
        assert {n for _, _, n in got} == {len(whole)}


def test_identifiers_are_the_tokenizers(identifiers):
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(9, 0x180)] + [" "] * 60 + list("'sS'T'reLLveDm") + [
        "́", " ", "　", "Σ", "漢", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "ﬁ", "Å", "ǅ"]
    for _ in range(5000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        want = np.array(direct(identifiers, text), "<u4").tobytes()
        assert identifiers.of(text) == want == identifiers.of(text, 4), text
    identifiers.known.clear()
    assert packing.REMEMBERED > 0 and identifiers.of("The end") == np.array(direct(identifiers, "the end"), "<u4").tobytes()


def test_windows_of_the_table(spark, identifiers):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    rows = packing.packed_windows(docs).collect()
    check_windows(rows, {r.doc_id: r.text for r in docs.collect()}, identifiers)
    assert len({r.sequence_id for r in rows}) == len(rows)
    steps = collections.Counter()
    for r in rows:
        steps[r.step] += r.size
    full = [s for s, n in steps.items() if n == packing.STEP]
    assert len(full) >= len(steps) - 3 and max(steps.values()) == packing.STEP


def test_query_digests(spark, identifiers):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in packing.op11_packing(spark, SF).collect():
        ids = (direct(identifiers, texts[r.doc_id]) + [1])
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())


def test_packer_fills_gaps_from_shorter_tiers():
    rng = random.Random(2)
    packer = packing.Packer(buffer=20_000)
    lengths = [rng.choice([3, 40, 100, 300, 700, 1500, 5000]) + rng.randrange(30) for _ in range(2000)]
    windows = [w for k, n in enumerate(lengths) for w in packer.add(k, k.to_bytes(4, "little") * n)] + list(packer.end())
    assert all(sum(r[0] for r in rests) == size for size, rests in windows)
    got = collections.Counter()
    for _, rests in windows:
        for length, _, doc, _, _, ids in rests:
            assert ids == doc.to_bytes(4, "little") * length
            got[doc] += length
    assert got == dict(enumerate(lengths))
    sizes = collections.Counter(size for size, _ in windows)
    assert {2048, 1024} <= set(sizes) and sum(n for s, n in sizes.items() if s < 64) <= 6


def test_steps_have_equal_tokens_and_near_costs():
    rng = random.Random(3)
    steps, made = packing.Steps(4096, 8), []
    for _ in range(400):
        size = rng.choice([64, 128, 256, 512, 1024, 2048])
        cuts = sorted(rng.sample(range(1, size), rng.randrange(4)))
        rests = [(b - a,) for a, b in zip([0, *cuts], [*cuts, size])]
        made += steps.add(size, rests)
    made += steps.deal(last=True)
    total, cost = collections.Counter(), collections.Counter()
    for k, size, rests in made:
        total[k] += size
        cost[k] += sum(r[0] ** 2 for r in rests)
    assert len(made) == 400 and all(n == 4096 for k, n in total.items() if k != max(total))
    first = [cost[k] for k in range(8)]
    assert max(first) <= 2 * min(first)


def test_packing_odd_rows(spark, identifiers):
    long = "river stone <|endoftext|> Été " * 40_000
    schema = "doc_id long, text string, ids string, size long, pieces string, step long, start long, sequence_id string"
    rows = [(1, None), (2, ""), (3, long), (4, "same"), (4, "same"), (None, "no number"), (5, " \n\t ")]
    docs = spark.createDataFrame([(a, b, "x", 1, "y", 2, 3, "z") for a, b in rows], schema)
    got = packing.packed_windows(docs).collect()
    assert sum(r.size for r in got) == sum(len(direct(identifiers, t)) + 1 for _, t in rows)
    mine = packing.pieces(packing.packed_windows(docs)).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in mine} == {1, 2, 3, 4, 5, None}
    check_windows(packing.packed_windows(docs.where("doc_id <> 4")).collect(), {1: "", 2: "", 3: long, 5: ""}, identifiers)
    assert packing.packed_windows(docs.limit(0)).count() == 0
    named = docs.selectExpr("CAST(doc_id AS string) AS doc_id", "text")
    assert {p.id for r in packing.packed_windows(named).collect() for p in r.pieces} == {"1", "2", "3", "4", "5", None}
    with pytest.raises(ValueError):
        packing.packed_windows(docs, step=1000)
