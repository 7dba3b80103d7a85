"""The prefix trie against nodes counted one by one, its layouts, and odd rows."""

import collections
import hashlib
import random
import zlib

import pytest

from lodestone.llm import prefix_trie
from lodestone.llm.prefix_trie import AdaptiveRadixTree, Full, Indexed, Sorted

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_nodes(sequences):
    """Rows of every prefix of ``{conv: [(role, text), ...]}``."""
    members = collections.defaultdict(list)
    for conv in sorted(sequences):
        for d in range(len(sequences[conv]) + 1):
            members[tuple(sequences[conv][:d])].append(conv)
    children, out = collections.Counter(p[:-1] for p in members if p), set()
    leaves, saved = collections.Counter(), collections.Counter()
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1].encode()) if p else 0
    for p, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(sequences[c]) == len(p))
        out.add((convs[0], len(p), members[p[:-1]][0] if p else None, len(convs), children[p], leaves[p], saved[p],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def brute_rebuilt(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None),
                                         key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        own[conv].append((role, text))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def result(nodes):
    rows = [tuple(r[c] for c in COLUMNS) for r in nodes.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(prefix_trie.op12_prefix_trie(spark, SF)) == brute_nodes(brute_rebuilt(rows))


@pytest.mark.parametrize("held_bytes", [1, 3000, 1 << 26])
def test_trees_cut_anywhere(spark, held_bytes):
    """Copies, shared starts, keys that are prefixes of others, one long conversation; trees of one key and more."""
    rng = random.Random(held_bytes)
    said = [("user" if k % 2 else "assistant", "x" * k) for k in range(5)]
    sequences = {c: [rng.choice(said) for _ in range(rng.choice([0, 1, 2, 3, 4, 9]))] for c in range(-20, 180)}
    sequences.update({c: [said[0], said[1], said[2]] for c in range(200, 260)})
    sequences[300] = [said[1], said[4]] * 200
    sequences[70_000] = [said[1], said[4]] * 100
    sequences[70_001] = [said[0], said[1], said[2]]
    spelled = {s: hashlib.sha256(f"{len(s[0])}:{s[0]}{s[1]}".encode()).digest()[:16] + len(s[1].encode()).to_bytes(4, "big") for s in said}
    members = spark.createDataFrame([(c, bytearray(b"".join(spelled[t] for t in s))) for c, s in sequences.items()], "conv long, key binary")
    got = prefix_trie.prefix_nodes(members.repartition(4), held_bytes)
    assert result(got) == brute_nodes(sequences)
    assert {r.turn_id for r in got.where("depth = 1").collect()} <= {bytes(v) for v in spelled.values()}


def test_layouts_grow_and_keep_order():
    layout, seen = Sorted(), {}
    for k, branch in enumerate(random.Random(1).sample(range(256), 256)):
        layout = layout.add(branch, branch * 2)
        seen[branch] = branch * 2
        assert layout.room == next(r for r in (4, 16, 48, 256) if r >= k + 1)
        assert list(layout.children()) == [seen[b] for b in sorted(seen)]
        assert all(layout.find(b) == seen.get(b) for b in range(256))
    assert (Sorted.__name__, Indexed.room, Full.room) == ("Sorted", 48, 256)


def test_runs_without_branches_are_one_node():
    tree = AdaptiveRadixTree(4)
    long = bytes(range(256)) * 400
    tree.insert(long, (1, 1, "a"))
    tree.insert(long[:40_000], (1, 2, "b"))
    tree.insert(long[:39_996] + b"\xff" * 4, (1, 3, "c"))
    assert len(tree._measure()) == 5
    assert len(list(tree.nodes(0))) == len(long) // 4 + 2


def test_turns_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, key binary, path string, conv int, id string, base long, part int"
    rows = [(0, 1, "user", "a"), (0, 0, None, None), (0, None, "user", "first"), (0, 1, "user", "a"), (0, 1, "assistant", "b"),
            (0, 1, "user", "Z"), (None, 0, "user", "nobody"), (3, 0, "user", "é" * 50_000), (3, None, None, "z"), (3, None, "y", None),
            (4, 2, "user", ""), (-3, 0, "user", "minus"), (11, 0, "user", "a"), (17, 0, "user", "absent base"), (5, 0, "user", "same"), (6, 0, "user", "same")]
    table = spark.createDataFrame([(*r, b"k", "p", 1, "i", 2, 3) for r in rows], schema)
    got = prefix_trie.prefix_nodes(prefix_trie.rebuilt_keys(prefix_trie.turns(table)))
    assert result(got) == brute_nodes(brute_rebuilt(rows))
    plain = {}
    for c in {r[0] for r in rows} - {None}:
        plain[c] = [(r or "", x or "") for _, t, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
    assert result(prefix_trie.prefix_nodes(prefix_trie.keys(prefix_trie.turns(table)))) == brute_nodes(plain)
    none = prefix_trie.turns(table.limit(0))
    assert prefix_trie.prefix_nodes(prefix_trie.rebuilt_keys(none)).count() == 0
