"""The prefix trie against a dictionary of prefixes."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from vigia.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string"


def brute(rows, grown):
    """{(conv_id, depth): (parent, convs, children, leaves, saved, ends)}."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    convs = own
    if grown:
        h = {c: crc32(str(c).encode()) % 9 for c in own}
        convs = {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    name = {p: min(m) for p, m in members.items()}
    children = defaultdict(int)
    saved, leaves = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not children[p]
    return {
        (name[p], len(p)): (
            name[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p],
            sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest(),
        )
        for p, m in members.items()
    }


def found_in(frame):
    rows = [tuple(r) for r in frame.collect()]
    out = {r[:2]: r[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def chats(seed, n, deep):
    rng = random.Random(seed)
    stock = [[("user", f"question {i}") if j % 2 == 0 else ("assistant", "näh " * j) for j in range(deep)] for i in range(4)]
    rows = []
    for c in range(n):
        turns = list(rng.choice(stock))[: rng.choice([1, 2, 3, 15, 16, 17, 33, deep])]
        if rng.random() < 0.5:
            turns[rng.randrange(len(turns))] = ("user", rng.choice(["x", "y", ""]))
        rows += [(c * 3 - 60, t, *x) for t, x in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [250_000, 300, 20])
def test_trie_equals_brute_force(spark, shard_turns):
    rows = chats(shard_turns, 150, 40)
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, KIND).repartition(4), shard_turns=shard_turns)
    assert found_in(found) == brute(rows, False)


def test_trie_of_copies_that_fill_many_shards(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(400) for t in range(3)]
    rows += [(1_000 + c, t, "user", f"same {t}" if t < 3 else f"own {c}") for c in range(60) for t in range(5)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, KIND), shard_turns=100)
    assert found_in(found) == brute(rows, False)


def test_regrown_and_odd_rows(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "b", "", None])) for c in range(80) if c % 10 != 5 for t in range(rng.randint(1, 12))]
    rows += [(7, None, "user", "first"), (7, None, "user", "also first"), (7, 0, "user", "tie"), (7, 0, "user", "tie")]
    rows += [(None, 0, "user", "nobody"), (100, 0, "user", "word " * 40_000), (101, 0, "user", "word " * 40_000)]
    kind = KIND + ", key string, turns int, depth string, base int"
    frame = spark.createDataFrame([(*r, "k", 1, "d", 2) for r in rows], kind).repartition(3)
    conv = F.col("conv_id")
    taken = F.crc32(conv.cast("string")) % 9
    found = prefix_trie.prefix_trie(frame, conv - conv % 5, taken, 8, shard_turns=60)
    assert found_in(found) == brute(rows, True)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], KIND)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], KIND)).collect() == []
