"""Near-duplicates, components, embeddings and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import buckets, forest, graph, repeats, simhash, suffixes
from tidemark.llm.common import Scratch
from tidemark.llm.suffixes import repeated_starts, suffix_array


def united(nodes, pairs):
    """node -> least node of its component."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("pairs", [[], [(1, 2), (2, 1), (3, 3)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(30)] + [(50, 51)]])
def test_components(spark, pairs):
    edges = spark.createDataFrame([*pairs, (None, 5)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges, Scratch(spark, "t")).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: c for n, c in united(linked, [p for p in pairs if p[0] != p[1]]).items()}


def test_random_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    want = united(range(300), pairs)
    assert got == {n: want[n] for a, b in pairs if a != b for n in (a, b)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt_and_lose_no_row(spark, how):
    # One key of a third of all rows, a null key, keys that only one side has; a table key may have two rows.
    left = [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i}", i) for i in range(6000)]
    right = [("hot", 1), ("hot", 2), ("absent", 3), *[(f"k{i}", i) for i in range(0, 6000, 2)]]
    rows, table = spark.createDataFrame(left, "key string, member long"), spark.createDataFrame(right, "key string, value long")
    scratch = Scratch(spark, "t")
    hot = buckets.hot_keys(rows.groupBy("key").agg(F.count("*").alias("n")).where("key is not null"), "key", "n", scratch, "hot")
    assert [(r._hot, r._parts) for r in hot.collect()] == [("hot", 334)]
    got = buckets.join_hot(rows, table, "key", hot, "member", how)
    want = rows.join(table, "key", how)
    assert got.columns == want.columns
    order = lambda df: sorted(map(str, df.collect()))
    assert order(got) == order(want)
    assert not buckets.hot_keys(rows.limit(0).groupBy("key").agg(F.count("*").alias("n")), "key", "n", scratch, "none").count()


def bitwise_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aB é\t\n\x1c"), max_size=80))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == bitwise_fingerprint(text)


def test_long_text_has_no_prefix():
    words = [f"w{i % 977}" for i in range(30_000)]
    assert simhash.fingerprint(" ".join(words)) == bitwise_fingerprint(" ".join(words))


def near_prints(n, seed=3):
    rng = random.Random(seed)
    prints = []
    for _ in range(n):
        base = rng.getrandbits(64)
        prints.append(base)
        for _ in range(rng.randrange(4)):
            p = base
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                p ^= 1 << b
            prints.append(p)
    return list(dict.fromkeys(prints))


@pytest.mark.parametrize("cell_limit", [20_000, 3])
def test_links_join_all_and_only_what_links(spark, cell_limit):
    prints = np.array(near_prints(120) + [(1 << 64) - 1 << k & (1 << 64) - 1 for k in range(8)], np.uint64)
    rows = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint long")
    got = [(r.a, r.b) for r in simhash.links(rows, Scratch(spark, "t"), cell_limit=cell_limit).collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 for a, b in got)
    signed = prints.view(np.int64).tolist()
    want = [(signed[i], signed[j]) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4) if i < j]
    assert want and united(signed, got) == united(signed, want)


def test_manhattan_is_a_lower_bound():
    prints = np.random.default_rng(1).integers(0, 1 << 63, 400, dtype=np.uint64)
    code = simhash._counts_code(prints)
    for p, c in zip(prints, code):
        manhattan = sum(abs(int(p >> np.uint64(2 * s) & np.uint64(3)).bit_count() - int(prints[0] >> np.uint64(2 * s) & np.uint64(3)).bit_count()) for s in range(32))
        assert int(np.bitwise_count(c ^ code[0])) == manhattan <= int(np.bitwise_count(p ^ prints[0]))


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base + " tail"), (1, "another text of its own kind"), (None, base), (7, None), (8, ""), (2, " \n"), (4, "Few"), (6, "few"), (3, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).withColumn("component", F.lit(1))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [simhash.fingerprint(t or "") for _, t in rows]
    groups = united(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[groups[k]] = i if least[groups[k]] is None else min(i, least[groups[k]])
    assert got == sorted(((i, least[groups[k]]) for k, (i, _) in enumerate(rows)), key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_at_the_similarity(spark):
    """Copies at Jaccard 0.8 to 0.95, most of them over 4 bits apart, are joined; texts below 0.8 are not."""
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows.append(" ".join(words))
        for changes in (2, 5, 12):  # each change parts five shingles of 296
            copy = list(words)
            for k in rng.sample(range(0, 295, 10), changes):
                copy[k] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += [rows[0].upper(), "", " ", "few words", "FEW words"]
    sets = [simhash.shingle_set(t) for t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if simhash.similar(sets[i], sets[j])]
    prints = [simhash.fingerprint(t) for t in rows]
    assert sum((prints[i] ^ prints[j]).bit_count() > 4 for i, j in pairs) > 40
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == united(range(len(rows)), pairs)
    assert simhash.near_copies(docs.limit(0)).count() == 0


def family(pairs: int) -> list[str]:
    """Pairs of texts at a Jaccard similarity of 0.8 and a little more, whose other near texts are all just below it."""
    rng = random.Random(11)

    def changed(words, times):  # each change parts five shingles of 296
        out = list(words)
        for k in rng.sample(range(2, 295, 5), times):
            out[k] = f"x{rng.randrange(10**6)}"
        return out

    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    firsts = [changed(base, 5) for _ in range(pairs)]
    return [" ".join(t) for first in firsts for t in (first, changed(first, 6))]


@pytest.mark.parametrize("cell_limit", [20_000, 50])
def test_near_copies_lose_no_link_among_texts_just_below(spark, cell_limit):
    """Large groups that share least hashes and shingles without being copies hide no pair that is one."""
    rows = family(100) + ["few words", "", "FEW words", None]
    sets = [simhash.shingle_set(t or "") for t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if simhash.similar(sets[i], sets[j])]
    assert len(pairs) >= 100
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, **({"cell_limit": cell_limit} if cell_limit < 20_000 else {})).collect()}
    assert got == united(range(len(rows)), pairs)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 4, simhash.SLOTS).astype(np.uint8)
    tight = 0
    for n in [*range(1, 60), 250, 997]:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert simhash.prefix_length(len(a)) == len(a) - -(-4 * len(a) // 5) + 1
        for gone in range(len(a) // 5 + 1):
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, rng.integers(0, len(a) // 4 + 1), dtype=np.uint64)]))
            c = np.setdiff1d(a, simhash.rarest(a, levels)[:gone])  # without the rarest ones
            for other in (b, c):
                if simhash.similar(a, other):
                    tight += 1
                    assert len(np.intersect1d(simhash.rarest(a, levels), simhash.rarest(other, levels)))
    assert tight > 500 and simhash.prefix_length(0) == 0


def test_one_key_of_those_with_the_same_nodes(spark):
    """The first by the order of the prefixes stays; other sets of nodes, of one size too, keep their own, lone nodes none."""
    rows = [(key, node, at) for key, nodes, at in ((9, (1, 2), 0), (5, (1, 2), 1), (7, (1, 2), 2), (4, (1, 3), 3), (3, (1, 2, 3), 4), (8, (3,), 0)) for node in nodes]
    tokens = spark.createDataFrame(rows, "key long, node long, at long")
    assert sorted(tuple(r) for r in simhash.first_keys(tokens).collect()) == [(3, 3), (4, 2), (9, 2)]


def test_all_pairs_follow_one_round_of_neighbours(spark, monkeypatch):
    """Where comparisons are few a row, no further round passes over all rows."""
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, *a: written.append(name) or write(self, df, name, *a))
    rows = family(100)
    sets = [simhash.shingle_set(t) for t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if simhash.similar(sets[i], sets[j])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == united(range(len(rows)), pairs)
    assert "placed-1" in written and "placed-2" not in written


@pytest.mark.parametrize("limit", [20_000, 30])
def test_meetings_of_other_components(spark, limit):
    """Of every shared key the pairs of different components, in small groups and large, whole and in tiles."""
    rng = random.Random(2)
    rows = [(key, node, 20, rng.randrange(4), node % 3 if key % 2 else node) for key, size in ((0, 5), (1, 90), (2, 100), (3, 1)) for node in rng.sample(range(1000), size)]
    shared = spark.createDataFrame(rows, "key long, node long, n long, at long, component long")
    got = {(r.u, r.v) for r in simhash.meetings(shared, 80, Scratch(spark, "t"), "t", limit=limit).collect()}
    # Two sets of 20 must share 18, so the key stands at 2 or before in both.
    want = {(max(a[1], b[1]), min(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[4] != b[4] and max(a[3], b[3]) <= 2}
    assert got == want and len(want) > 3000
    near = {(r.u, r.v) for r in simhash.meetings(shared, 80, Scratch(spark, "t"), "t", chain=4, limit=limit).collect()}
    assert near < want and len(near) > 100


def test_sketches_differ_in_no_more_bits_than_the_sets():
    """Of any sizes and folded to any other; sets of much the same size at the similarity are told within a few hashes."""
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 1 << 63, 9000, dtype=np.uint64) << np.uint64(1))
    sets = [base[:0], base[:1], base[:64], base[:65], base[:400], base[40:420], base[:2500], base[300:2600], base, base[1000:]]
    sketches = [simhash.sketch(s) for s in sets]
    assert len({len(s) for s in sketches}) > 3
    apart = simhash.differences(sketches)
    every = np.arange(len(sets))
    for i, a in enumerate(sets):
        bits, slots = apart(i, every)
        single = np.array([len(np.setxor1d(a, b)) for b in sets])
        assert (bits <= single).all() and (bits % 2 == single % 2).all() and bits[i] == 0
        assert (slots == [8 * min(len(sketches[i]), len(s)) for s in sketches]).all()
        assert (apart(np.full(len(sets), i), every)[0] == bits).all()
    assert apart(4, np.array([5]))[0][0] >= 50 and len(np.setxor1d(sets[4], sets[5])) == 60


def test_spanning_edges_join_the_same_without_a_circle():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (2, 5), (200, 90), (200, 230), (60, 900)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        x, y = buckets.spanning(n, a, b)
        want = united(range(n), zip(a.tolist(), b.tolist(), strict=True))
        assert united(range(n), zip(x.tolist(), y.tolist(), strict=True)) == want
        assert len(x) == n - len(set(want.values())) and set(zip(x.tolist(), y.tolist(), strict=True)) <= set(zip(a.tolist(), b.tolist(), strict=True))


def test_candidates_grow_with_the_texts_and_not_their_pairs(spark, monkeypatch):
    """Near copies of one text at similarities around 0.8: four times the texts give no more than some four times the candidates."""
    made, write = Counter(), Scratch.write

    def counted(self, df, name, *a):
        out = write(self, df, name, *a)
        made["pairs"] += out.count() if name.endswith("-pairs") else 0
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    rng, counts = random.Random(21), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    for n in (60, 240):
        rows = []
        for _ in range(n):
            copy = list(base)
            for k in rng.sample(range(2, 295, 5), rng.choice([1, 3, 5, 6])):  # each change parts five shingles of 296
                copy[k] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
        sets = [simhash.shingle_set(t) for t in rows]
        pairs = [(i, j) for i in range(n) for j in range(i) if simhash.similar(sets[i], sets[j])]
        made.clear()
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == united(range(n), pairs)
        counts.append(made["pairs"])
        assert counts[-1] < 8 * n < len(pairs)
    assert counts[1] < 8 * counts[0]


def test_forest_of_edges_needs_no_pairs():
    asked = Counter()

    def near(i, others):
        asked["rows"] += len(others)
        return np.ones(len(others), bool)

    assert len(buckets.forest(1000, near)) == 999
    assert asked["rows"] == 999


# ---------------------------------------------------------------- embeddings


def brute_links(rows, threshold=0.93):
    out = {k: set() for k in range(len(rows))}
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            w, other = rows[j][1], rows[j][2]
            if label is None or label != other or not v or not w or len(v) != len(w) or None in v or None in w:
                continue
            a, b = np.array(v), np.array(w)
            if not np.isfinite(a).all() or not np.isfinite(b).all() or not a.any() or not b.any():
                continue
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                out[i].add(j)
                out[j].add(i)
    return out


def vectors(n=400, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        v = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, 5))):
            w = v + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.3, 0.4])
            rows.append((len(rows), w.tolist(), int(rng.integers(0, 2))))
    return rows


@pytest.mark.parametrize("leaf, limit", [(400, 1500), (30, 1500), (60, 7)])
def test_embeddings(spark, monkeypatch, leaf, limit):
    monkeypatch.setattr(forest, "LEAF_LIMIT", limit)
    monkeypatch.setattr(forest, "forest_shape", lambda n, threshold, f=forest.forest_shape: f(n, threshold, leaf=leaf))
    rows = vectors()
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [None] + [1.0] * 15, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, rows[0][1], None), (n + 5, [], 0), (n + 6, [1e300] * 16, 0), (n + 7, [1e-300] * 16, 0), (n + 8, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_vectors(df).collect()}
    want = brute_links(rows)
    found, all_ = sum(g[0] for g in got.values()), sum(map(len, want.values()))
    assert all(got[i][0] <= len(want[i]) for i in want)
    assert found >= 0.99 * all_
    if found == all_:
        least = united(range(len(rows)), [(i, j) for i in want for j in want[i]])
        assert {i: g[1] for i, g in got.items()} == least
    assert all(g[2] == (g[1] == i) for i, g in got.items())


@pytest.mark.parametrize("common", [0.0, 0.85])
def test_trees_hold_their_recall_on_vectors_with_a_common_direction(common):
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = np.sqrt(1 - common) * unit(rng.standard_normal((20_000, 64))) + np.sqrt(common) * unit(rng.standard_normal(64))
    x = unit(x)
    away = rng.standard_normal((2000, 64))
    away = unit(away - (away * x[:2000]).sum(1, keepdims=True) * x[:2000])
    y = 0.94 * x[:2000] + np.sqrt(1 - 0.94**2) * away
    trees = forest.fitted_trees(x, len(x), 0.93, 7)
    met = np.any([t.together(x[:2000], y) == t.depth for t in trees], axis=0)
    assert met.mean() >= 0.995, (len(trees), trees[0].depth, met.mean())
    if common:
        depth, n = forest.forest_shape(len(x))
        plain = [forest.Tree(x, depth, forest.SPILL, 7000 + t) for t in range(n)]
        assert np.any([t.together(x[:2000], y) == depth for t in plain], axis=0).mean() < 0.99
    else:
        assert trees[0].depth == forest.forest_shape(len(x))[0]


def test_embedding_copies_and_empty(spark):
    rows = [(9, [1.0, 2.0], 1)] * 3 + [(4, [2.0, 4.0], 1), (1, [1.0, 2.0], 2), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter(map(tuple, forest.near_vectors(df).collect()))
    assert got == Counter({(9, 4, 4, False): 3, (4, 4, 4, True): 1, (1, 0, 1, True): 1, (None, 4, 4, False): 1})
    assert forest.near_vectors(df.limit(0)).count() == 0


# ---------------------------------------------------------------- repeated strings


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(text):
    assert suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 9, 10**12]), max_size=60), st.randoms(use_true_random=False))
def test_suffix_array_of_some_starts(text, rng):
    wanted = [rng.random() < 0.4 for _ in text]
    got = suffix_array(np.array(text, np.int64), np.array(wanted, bool)).tolist()
    assert got == [i for i in sorted(range(len(text)), key=lambda i: text[i:]) if wanted[i]]


@pytest.mark.parametrize("bits", [1, 20, 54, 55, 63])
def test_order_of_keys_whose_places_fit_or_not(bits):
    key = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint64) >> np.uint64(1) << np.uint64(1)
    assert suffixes._order(key, bits).tolist() == sorted(range(len(key)), key=lambda i: (int(key[i]), i))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=120), st.integers(1, 12), st.integers(0, 12), st.randoms(use_true_random=False))
def test_repeated_starts_of_some_starts(text, length, more, rng):
    starts = [i for i in range(len(text)) if rng.random() < 0.6]
    room = [rng.randint(0, len(text) - i) for i in starts]
    found = repeated_starts(np.array(text, np.int64), np.array(starts, np.int64), np.array(room, np.int64), (length, length + more))
    for size, got in zip((length, length + more), found, strict=True):
        count = Counter(tuple(text[i : i + size]) for i, r in zip(starts, room, strict=True) if r >= size)
        assert got.tolist() == [r >= size and count[tuple(text[i : i + size])] > 1 for i, r in zip(starts, room, strict=True)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 2), min_size=4, max_size=60), st.lists(st.integers(1, 12), min_size=1, max_size=3))
def test_repeated_starts(text, lengths):
    lengths = tuple(sorted(lengths))
    starts = np.arange(max(0, len(text) - lengths[0] + 1))
    if not len(starts):
        return
    found = repeated_starts(np.array(text, np.int64), starts, len(text) - starts, lengths)
    for length, got in zip(lengths, found, strict=True):
        count = Counter(tuple(text[i : i + length]) for i in range(len(text) - length + 1))
        assert got.tolist() == [i + length <= len(text) and count[tuple(text[i : i + length])] > 1 for i in starts]


def brute_repeats(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def texts_with_repeats(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(30) for _ in range(3)]
    texts = [prose(rng.randrange(0, 60)) + rng.choice([*shared, "", ""]) + prose(rng.randrange(0, 60)) for _ in range(40)]
    texts += [texts[0], texts[0], "z" * 700, "xy" * 300, shared[0][:50], shared[1] + shared[1], "", None, "é" * 90]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (3, texts[3]), (4, prose(50))]


@pytest.mark.parametrize("length", [40, 64, 400])
@pytest.mark.parametrize("array_bytes", [repeats.ARRAY_BYTES, 150])
def test_repeats(spark, length, array_bytes):
    """One length or two in one pass give the same: 400 is judged beside the shorter length of passages."""
    rows = texts_with_repeats()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("digest", "spans", "copied", "key")})
    got = repeats.repeat_digests(df, length, array_bytes=array_bytes)
    assert Counter(tuple(r)[:5] for r in got.collect()) == brute_repeats(rows, length)
    assert repeats.repeat_digests(df.limit(0), length).count() == 0


def brute_passages(rows, length, words):
    """Bytes of whole words in ranges that repeated strings cover, of ranges with more words than ``words``."""
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        total, at = 0, 0
        for k, g in enumerate(gone):
            if g and not (k and gone[k - 1]):
                at = k
            if not g and k and gone[k - 1]:
                inside = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b) if at <= m.start() and m.end() <= k]
                if len(inside) > words:
                    total += inside[-1][1] - inside[0][0]
        out.append(total)
    return out


def test_passages_between_the_lengths(spark):
    """A passage of 51 words under 400 bytes is told, removes nothing from op10, and goes from the pipeline's texts."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(n))
    shared, short = prose(52), prose(45)
    rows = [(i, f"{prose(40)} {shared} {prose(40)}") for i in range(3)] + [(10 + i, f"{prose(40)} {short} {prose(30)}") for i in range(2)] + [(20, prose(90)), (21, None)]
    assert 200 < len(short) and len(shared) < 398
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.repeat_digests(df).collect()}
    assert all(r.n_removed == 0 for r in got.values())
    for (i, _), want in zip(rows, brute_passages(rows, 200, 50), strict=True):
        assert abs(got[i].n_passage_bytes - want) <= 2, i  # blanks at the ends
    assert all(got[i].n_passage_bytes >= len(shared) for i in range(3)) and not any(got[i].n_passage_bytes for i in (10, 11, 20, 21))
    cut = {r.doc_id: r.text for r in repeats.without_repeats(df, 200, over_words=50).collect()}
    assert all(shared not in cut[i] and len(cut[i].split()) <= 82 for i in range(3))
    assert all(cut[i] == t for i, t in rows if i >= 10)


def test_long_windows_cross_slices(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 100)
    data = bytes(random.Random(1).randrange(97, 123) for _ in range(1500)) * 2
    runs = repeats.window_runs(data, 50)
    assert [r[1] for r in runs] == np.cumsum([0, *[r[2] for r in runs]])[:-1].tolist()
    assert sum(r[2] for r in runs) == len(data) - 49


def test_cut_texts_keep_whole_characters(spark):
    rows = texts_with_repeats()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string")
    cut = repeats.without_repeats(df, 41)
    assert cut.columns == df.columns
    got = {(r.doc_id, r.text) for r in cut.collect() if r.doc_id is not None}
    assert {i for i, t in rows if t is None} <= {i for i, t in got if t is None}
    want = {i: removed for i, _, removed, _, _ in brute_repeats(rows, 41) if i not in (3, None)}
    for i, text in got:
        if i in want and text is not None:
            before = len((dict(rows)[i] or "").encode())
            assert 0 <= before - want[i] <= len(text.encode()) <= before - want[i] + 4 * 10
