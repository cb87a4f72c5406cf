"""Operators over whole tables, against brute force."""

import random
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigia.llm import components, decontaminate, jaccard_join, multi_index, substring_dedup, toxicity


def words_of(text):
    return (text or "").encode().lower().split()


def shingle_set(text, size):
    w = words_of(text)
    return set() if not w else {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def linked(rows, size, num, den):
    """(shingles, smallest id reached) by comparing every pair that shares a shingle."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for s in sets[i]:
            holders[s].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.choice([5, 12, 30, 60, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 7])):
            w[rng.randrange(len(w))] = rng.choice("xyz") * rng.randint(1, 5)
        if rng.random() < 0.2:
            w += [rng.choice("uvw") * rng.randint(1, 4) for _ in range(rng.randint(1, 5))]
        rows.append((3 * i + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("tile, size, num, den", [(3_000, 3, 90, 100), (15, 3, 90, 100), (15, 5, 8, 10)])
def test_jaccard_components_equal_brute_force(spark, tile, size, num, den):
    rows = near_copies(tile + size, 250)
    rows += [(9_000, None), (9_001, ""), (9_002, " \n"), (9_003, "one two"), (9_004, "ONE\ttwo"), (9_005, "two one"), (9_006, "w " * 20_000)]
    docs = spark.createDataFrame([(*r, 1) for r in [*rows, *rows[:5]]], "doc_id long, text string, component_id int")
    docs = docs.union(spark.createDataFrame([(None, rows[0][1], 1)], docs.schema))
    got = jaccard_join.jaccard_components(docs, size, num, den, tile).collect()
    assert len(got) == len(rows) + 6
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert found.pop(None)[1] is None
    assert found == linked(rows, size, num, den)


def test_tiles_of_long_documents_are_bounded_by_bytes(spark, monkeypatch):
    rng = random.Random(10)
    base = [f"w{rng.randrange(100_000)}" for _ in range(3_000)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.choice([1, 5, 20, 60])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(100_000)}"
        rows.append((i, " ".join(w)))
    tiles, links = [], jaccard_join._links

    def seen(members, cuts):
        sizes = members.withColumn("b", F.octet_length("words")).groupBy("tile").agg(F.sum("b").alias("b"))
        tiles.append(max((r["b"] for r in sizes.collect()), default=0))
        return links(members, cuts)

    monkeypatch.setattr(jaccard_join, "_links", seen)
    monkeypatch.setattr(jaccard_join, "TILE_BYTES", 200_000, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, 3, 90, 100).collect()}
    assert got == linked(rows, 3, 90, 100)
    assert max(tiles) <= 2 * 200_000  # 960,000 bytes of hashes in all


def sets_of_one_component(seed, n):
    """Sets of hashes, most without links, some changed copies of others."""
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(20, 160), dtype=np.uint64)) for _ in range(n)]
    for k in range(0, n // 6):
        s = sets[n - 1 - k]
        changed = rng.integers(0, 1 << 63, rng.integers(1, 30), dtype=np.uint64)
        sets[k] = np.unique(np.concatenate([s[len(changed) // 3 :], changed]))
    return sets


def links_of(sets, cuts):
    shared = {(a, b): len(np.intersect1d(sets[a], sets[b])) for b in range(len(sets)) for a in range(b)}
    return [p for p, both in shared.items() if cuts.den * both >= cuts.num * (len(sets[p[0]]) + len(sets[p[1]]) - both)]


@pytest.mark.parametrize("tile", [15, 4_000])
def test_a_large_component_moves_only_sets_that_can_be_linked(spark, monkeypatch, tile):
    cuts, n = jaccard_join.Cut(8, 10), 180
    sets = sets_of_one_component(5, n)
    expected = links_of(sets, cuts)
    assert 5 < len(expected) < 30
    moved, links = [], jaccard_join._links

    def seen(members, cuts):
        moved.append(members.count())
        return links(members, cuts)

    monkeypatch.setattr(jaccard_join, "_links", seen)
    rows = [(0, i, len(s), False, s.tobytes()) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "cand long, doc_id long, n long, fits boolean, words binary")
    found = jaccard_join._candidate_links(members, cuts, tile).collect()
    assert {tuple(sorted(r)) for r in found} == set(expected)
    assert sum(moved) < n / 3  # in blocks, each set moves several times


def test_counts_tell_no_linked_sets_apart():
    cuts = jaccard_join.Cut(8, 10)
    sets = sets_of_one_component(6, 150)
    groups = defaultdict(list)
    for i, s in enumerate(sets):
        for low, high in cuts.bands(len(s)):
            groups[low].append((i, len(s), len(s) <= high, i % 3, low, s))
    pairs = set()
    for low, rows in groups.items():
        for x, y in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)):
            some = [(*r[:4], x != y, jaccard_join.counted(r[5], low)) for r in rows if r[3] in (x, y)]
            pairs |= {tuple(sorted(p)) for p in jaccard_join.near_pairs(some, cuts)}
    root = {i: i for p in pairs for i in p}
    for _ in pairs:  # short chains only
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    expected = links_of(sets, cuts)
    assert expected and all(a in root and b in root and root[a] == root[b] for a, b in expected)
    assert len(pairs) < 2 * len(expected)


def test_jaccard_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(docs).count() == 0


def test_signatures_lose_no_linked_pair():
    rng = np.random.default_rng(1)
    for cuts in (jaccard_join.Cut(90, 100), jaccard_join.Cut(8, 10)):
        for n in [*range(1, 60), 150, 700]:
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for keep in {n, n - cuts.differ(n), n - cuts.differ(n) // 2}:
                b = np.unique(rng.permutation(a)[:keep])
                if keep and keep * cuts.den >= cuts.num * n and (n >= cuts.first and keep >= cuts.first):
                    assert set(cuts.signatures(a).tolist()) & set(cuts.signatures(b).tolist())


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(30)] + [(5, 5), (None, 7)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in components.components(df, "a", "b").collect()} == root


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([2, 4, 5, 9, 20, 40]))) for i in range(25)]
    docs = []
    for i in range(120):
        w = text(rng.randint(0, 80)).split()
        if rng.random() < 0.5:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = leak
        docs.append((i, " ".join(w)))
    docs += [(1_000, None), (1_001, ""), (1_002, items[0][1].upper())]

    def bag(w, size=5):
        return Counter([tuple(w)] if len(w) < size else [tuple(w[k : k + size]) for k in range(len(w) - size + 1)])

    expected = {}
    for i, t in docs:
        w = words_of(t)
        for item, x in items:
            n = len(words_of(x))
            b = bag(words_of(x))
            for at in range(len(w) - n + 1):
                a = bag(w[at : at + n])
                both = sum((a & b).values())
                s = both / (sum(a.values()) + sum(b.values()) - both)
                if s >= 0.8 and s > expected.get((i, item), (0,))[0]:
                    expected[i, item] = (s, at)
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([*items, (None, "w1 w2"), (99, None), (98, " ")], "item_id long, text string")
    found = decontaminate.find_benchmark(df, bench)
    hits = found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*").collect()
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in hits} == expected
    assert found.count() == len(docs) and len(expected) > 30
    assert decontaminate.find_benchmark(df.limit(0), bench).count() == 0
    assert decontaminate.find_benchmark(df, bench.limit(0)).where(F.size("hits") > 0).count() == 0


def test_decontamination_of_texts_shorter_than_an_item(spark):
    w = [f"w{i}" for i in range(59)]
    docs = [(1, " ".join(w[:57])), (2, " ".join(w[3:])), (3, " ".join(w[:48])), (4, " ".join(w[:47])), (5, " ".join(w[:3])), (6, "w0 w1 w2 w3")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(w)), (8, "w0 w1 w2 w3 w4"), (9, "a b c d")], "item_id long, text string")
    found = decontaminate.find_benchmark(df, bench).select("doc_id", F.explode("hits").alias("h")).where("h.item_id <> 8")
    got = {r["doc_id"]: (r["item_id"], r["similarity"], r["start_word"], r["n_words"]) for r in found.select("doc_id", "h.*").collect()}
    assert got == {1: (7, 53 / 55, 0, 57), 2: (7, 52 / 55, 0, 56), 3: (7, 44 / 55, 0, 48)}


def test_a_long_text_of_a_phrase_that_many_items_share_costs_little():
    phrase = "a phrase that they all share"
    items = [(i, f"{phrase} " + " ".join(f"w{i}x{k}" for k in range(24))) for i in range(4_000)]
    index = decontaminate.Index([(i, t.encode()) for i, t in items], 5, 22, 0.8)
    copy = items[77][1]
    text = " ".join([f"{phrase} and then"] * 3_000 + [copy] + [f"{phrase} or"] * 3_000).encode()
    tracemalloc.start()
    began = time.perf_counter()
    hits = index.hits(text)
    took, (_, most) = time.perf_counter() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [(h["item_id"], h["similarity"], h["start_word"]) for h in hits] == [(77, 1.0, 8 * 3_000)]
    assert took < 20 and most < 200 << 20


def test_long_texts_of_many_copies_equal_brute_force():
    rng = random.Random(9)
    items = [(i, " ".join(f"v{rng.randrange(40)}" for _ in range(30))) for i in range(60)]
    parts = []
    for _ in range(900):
        w = rng.choice(items)[1].split()
        w[rng.randrange(30)] = "x" if rng.random() < 0.5 else w[0]
        parts += w[rng.randrange(6) :]
    index = decontaminate.Index([(i, t.encode()) for i, t in items], 5, 22, 0.8)
    got = {h["item_id"]: (h["similarity"], h["start_word"]) for h in index.hits(" ".join(parts).encode())}
    bags = {i: Counter(tuple(t.split()[k : k + 5]) for k in range(26)) for i, t in items}
    holders = defaultdict(set)
    for i, b in bags.items():
        for x in b:
            holders[x].add(i)
    shingles = [tuple(parts[k : k + 5]) for k in range(len(parts) - 4)]
    best = {}
    for at in range(len(parts) - 29):
        window = shingles[at : at + 26]
        for i, n in Counter(i for x in set(window) for i in holders[x]).items():
            if n >= 20:
                both = sum((Counter(window) & bags[i]).values())
                if both / (52 - both) >= 0.8:
                    best[i] = min(best.get(i, (0, 0)), (-both / (52 - both), at))
    assert got == {i: (-x, at) for i, (x, at) in best.items()} and len(best) > 30


def test_blocks_find_every_print_within_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    queries = prints[:50].copy()
    for i, q in enumerate(queries):
        for b in rng.choice(63, i % 23, replace=False):
            q ^= np.uint64(1) << np.uint64(b)
        queries[i] = q
    near = decontaminate.Blocks(prints, 22).near(queries)
    d = np.bitwise_count(queries[:, None] ^ prints[None]).astype(int)
    assert {tuple(r) for r in near.tolist()} == {(i, j, d[i, j]) for i, j in zip(*np.nonzero(d <= 22), strict=True)}


def without_repeats(rows, window=50):
    first = {}
    for i, t in sorted(rows):
        for p in range(len(t) - window + 1):
            first.setdefault(t[p : p + window], i)
    out = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if first[t[p : p + window]] < i:
                gone[p : p + window] = b"\1" * window
        out[i] = bytes(c for c, g in zip(t, gone, strict=True) if not g)
    return out


def test_substring_dedup_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh  \né") for _ in range(rng.randint(20, 600))) for _ in range(25)]
    rows = []
    for i in range(150):
        t = ""
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            k = rng.randint(0, len(b))
            t += b[k : k + rng.randint(0, 400)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))
        t += rng.choice(["", "", "-" * rng.randint(0, 400), "\0" * rng.randint(0, 200)])
        rows.append((i, t))
    expected = without_repeats([(i, t.encode()) for i, t in rows])
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    for run, part in ((8 << 20, 100_000), (4_000, 40)):
        monkeypatch.setattr(substring_dedup, "RUN_BYTES", run)
        monkeypatch.setattr(substring_dedup, "PART_SUFFIXES", part)
        monkeypatch.setattr(substring_dedup, "PART_ANCHORS", part)
        got = substring_dedup.drop_repeated_bytes(docs).collect()
        assert {r["doc_id"]: bytes(r["kept"]) for r in got} == expected
        for r in got:
            text = dict(rows)[r["doc_id"]].encode()
            left = bytearray(text)
            for s in reversed(r["spans"]):
                del left[s["start"] : s["start"] + s["length"]]
            assert bytes(left) == bytes(r["kept"]) and r["n_bytes"] == len(text)


def test_substring_dedup_bounds_hot_anchors(spark, monkeypatch):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))

    def grams(text):  # that are the anchor of some window
        return len(set(substring_dedup._anchors(np.frombuffer(text.encode(), np.uint8)).tolist()))

    phrase = letters(24)  # shorter than a window: its neighbours differ, and it is the anchor of all of them
    while any(grams(letters(26) + phrase + letters(26)) > 1 for _ in range(20)):
        phrase = letters(24)
    rows = [(i, letters(rng.randint(30, 60)) + phrase + letters(rng.randint(30, 60))) for i in range(400)]
    rows += [(1_000 + i, letters(20) + rows[i][1][5:] + "\0" * 60 * (i % 2) + letters(20)) for i in range(0, 400, 7)]
    expected = without_repeats([(i, t.encode()) for i, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substring_dedup, "RUN_BYTES", 12_000)
    monkeypatch.setattr(substring_dedup, "PART_SUFFIXES", 400)
    monkeypatch.setattr(substring_dedup, "PART_ANCHORS", 400)
    held = {}
    for hot, windows in ((20_000, 500_000), (30, 500_000), (30, 200), (0, 20)):
        monkeypatch.setattr(substring_dedup, "HOT_SUFFIXES", hot, raising=False)
        monkeypatch.setattr(substring_dedup, "PART_WINDOWS", windows, raising=False)
        out, sent = substring_dedup._passes(docs, "doc_id", "text")
        assert {r["doc_id"]: bytes(r["kept"]) for r in out.collect()} == expected
        held[hot, windows] = [r["n"] for r in sent.groupBy("part", "anchor", "sub").agg(F.sum("n").alias("n")).collect()]
    assert max(held[20_000, 500_000]) > 400 and max(held[30, 500_000]) > 2_000
    assert max(held[30, 200]) < 400


def test_substring_dedup_of_odd_rows(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(300))
    rows = [(1, long), (1, long), (2, long), (None, long), (None, long), (3, None), (4, ""), (0, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], len(r["kept"])) for r in substring_dedup.drop_repeated_bytes(docs).collect()), key=str)
    assert got == sorted([(1, 300), (1, 300), (2, 0), (None, 300), (None, 300), (3, 0), (4, 0), (0, 5)], key=str)
    assert substring_dedup.drop_repeated_bytes(docs.limit(0)).count() == 0


def test_loser_tree_merges_and_knows_shared_prefixes():
    rng = random.Random(6)
    for runs in (1, 2, 3, 7):
        lists = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))}) for _ in range(runs)]
        coded = [substring_dedup.read_run(*substring_dedup.front_code(x)) if x else iter(()) for x in lists]
        out = list(substring_dedup.merge(coded))
        names = [n for _, _, n in out]
        assert names == sorted(n for x in lists for n in x)
        for (_, h, n), before in zip(out[1:], names, strict=False):
            assert h == substring_dedup.common(before, n, 0)


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3_000, 16)).astype(np.float32)
    x[100:400] = x[100]  # one vector with a tenth of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5_000, None), (5_020, [0.0] * 16), (5_040, [float("nan")] * 16), (5_060, [1.0] * 15), (None, x[0].tolist()), (5_080, [None] + [1.0] * 15), (5_100, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, *odd, *rows[:3]]], "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in multi_index.neighbours(df, k=20, s=multi_index.Settings(least=0, index_block=700, query_block=50)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(range(0, 3_000, 20))
    y, hit = x.astype(np.float64), 0
    for q, found in got.items():
        score = y @ y[q]
        best = [i for i in np.lexsort((np.arange(3_000), -score)) if i != q][:20]
        hit += len(set(best) & {i for i, _, _ in found})
        assert [r for _, _, r in found] == list(range(1, 21)) and q not in {i for i, _, _ in found}
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s - score[i]) < 1e-9 for i, s, _ in found)
    assert hit >= 0.9 * 20 * len(got)


def test_neighbours_of_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in multi_index.neighbours(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert multi_index.neighbours(df.limit(0)).count() == 0


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(8)
    syllables = ["tha", "ing", "er", "on", "st", "re", "le", "in"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    insults = ["zorgum", "blefty", "krampo"]
    docs, labels = [], []
    for i in range(1_500):
        toxic = i % 6 == 0
        w = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(2, 6) * toxic):
            w.insert(rng.randint(0, len(w)), rng.choice(insults) + word())
        docs.append((i, " ".join(w), "en"))
        labels.append((i, int(toxic)))
    odd = [(9_000, None, None), (9_001, "", "x"), (9_002, "tha " * 30_000, "x"), (None, "zorgum", "x")]
    df = spark.createDataFrame([*docs, *odd, docs[0]], "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (1, None), (None, 1), (7_777, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    rows = toxicity.score(df, model).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert len(rows) == 1_505
    truth = dict(labels)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held"] and r["doc_id"] in truth]
    caught = sum(p for y, p in held if y) / sum(y for y, _ in held)
    alarms = sum(p for y, p in held if not y) / sum(1 - y for y, _ in held)
    assert caught >= 0.9 and alarms <= 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert {r["predicted"] for r in rows if r["doc_id"] in (9_000, 9_001, 9_002)} == {0}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_of_given_labels(spark):
    """Held-out recall, false alarms, and those among long texts, on the largest given table."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    lab = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    model = toxicity.train(docs, lab)
    held = docs.join(lab, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    rows = toxicity.score(held, model).select("toxic", "predicted", "n_windows").collect()
    rejected = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    long = [r["predicted"] for r in rows if r["toxic"] == 0 and r["n_windows"] >= 1_000]
    assert sum(rejected) >= 0.7 * len(rejected)
    assert sum(clean) <= 0.01 * len(clean)
    assert sum(long) <= 0.05 * len(long)


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(df, model).collect()} == {0.5}


def test_forest_joins_each_node_to_the_smallest():
    rng = np.random.default_rng(2)
    for n, edges in ((1, 0), (50, 20), (300, 200), (2_000, 1_999)):
        a, b = rng.integers(-n, n, edges), rng.integers(-n, n, edges)
        if edges == 1_999:
            a, b = np.arange(1_999), np.arange(1, 2_000)  # a path
        node, root = jaccard_join.forest(a, b)
        reach = {x: x for x in node.tolist()}
        changed = True
        while changed:
            changed = False
            for x, y in zip(a.tolist(), b.tolist()):
                low = min(reach[x], reach[y])
                changed |= reach[x] != low or reach[y] != low
                reach[x] = reach[y] = low
            if edges == 1_999:
                break
        assert root.tolist() == ([0] * 2_000 if edges == 1_999 else [reach[x] for x in node.tolist()])


@pytest.mark.parametrize("tasks", [4, 16])
def test_a_group_of_near_copies_makes_few_edges(spark, tasks):
    rng = random.Random(tasks)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(300)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks, "doc_id")
    cuts = jaccard_join.Cut(8, 10)
    edges = jaccard_join._stars(jaccard_join._signature_rows(docs, 5, cuts, 12, 50)).collect()
    assert len({x for e in edges for x in e}) == 600 and len(edges) < 1_200
