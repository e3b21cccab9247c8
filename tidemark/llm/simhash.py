"""SimHash near-duplicates by segment popcounts.

A fingerprint's 64 bits are 32 segments of two; the vector of their bit counts (0..2 each) is its embedding, and the
Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints.  Links need a Manhattan
distance of at most the radius, so when the 32 axes are dealt into ``blocks`` groups, at least ``blocks - radius`` of
them agree: two fingerprints that link share a cell of the grid of such a choice of groups.  Every fingerprint goes
into one cell per choice; within a cell the Manhattan distance is the first test and the exact one the second.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.buckets import by_group, forest, hot_keys, join_hot, spanning, tiled, whole_groups
from tidemark.llm.common import Scratch, documents, field, id_and_text, map_rows, texts_of
from tidemark.llm.graph import components

SEGMENTS, RADIUS, WORDS, SEED = 32, 4, 4, 42
#: Chance that two random segments of two bits have the same count.
SAME = 6 / 16
#: Fingerprints of a cell that one task compares; larger cells are dealt into tiles.
CELL_LIMIT = 20_000
#: What links two texts of the pipeline: shingles of so many words, Jaccard similarity in percent.
COPY_WORDS, COPY_PERCENT = 5, 80
#: Slots in which shingles are counted, to order them by frequency, and slices in which the counts are added up.
SLOTS, SLICES = 1 << 20, 64
#: Least and most bits of a set's parity sketch, which has at least four a shingle in between.
SKETCH = 256, 16_384


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 hashes of the text's shingles of ``words`` words, repeats included, in bounded arrays; a shorter text is
    one shingle, a text without a word has none."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    line = b" ".join(parts)
    if len(parts) <= words:
        yield np.array([xxh64_intdigest(line, seed)], np.uint64)
        return
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1))).tolist()
    ends = starts[words:]
    for i in range(0, len(ends), 8192):
        yield np.array([xxh64_intdigest(line[s : e - 1], seed) for s, e in zip(starts[i : i + 8192], ends[i : i + 8192])], np.uint64)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """Bits set in over half the hashes; 0 without any."""
    counts, n = np.zeros(64, np.int64), 0
    for h in hashes:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Bits set in over half the XXH64 hashes of the text's shingles of ``words`` words, repeats included."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fingerprint`` (long, the 64 bits) to every row; no shuffle.  Texts without a word, null ones among them,
    have fingerprint 0."""

    def make():
        return lambda texts: {"fingerprint": np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)}

    return map_rows(docs, make, [field("fingerprint", "long")], text_col, keep)


def counts_code(bits: Column) -> Column:
    """The embedding in 64 bits: each segment's count as 00, 01 or 11, so that Manhattan distances are bit counts."""
    low = F.lit(0x5555555555555555)
    even, odd = bits.bitwiseAND(low), F.shiftrightunsigned(bits, 1).bitwiseAND(low)
    return even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def axis_blocks(blocks: int) -> list[int]:
    """Bit masks of the groups of axes, as even as can be."""
    edges = [round(i * SEGMENTS / blocks) for i in range(blocks + 1)]
    return [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def choose_blocks(n: int, radius: int = RADIUS) -> int:
    """The number of groups that costs least for n fingerprints: cells each one goes into, and who is met there."""
    cost = lambda b: comb(b, radius) * (20 + n * SAME ** (SEGMENTS * (b - radius) / b))
    return min(range(radius + 1, 2 * radius + 5), key=cost)


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Edges (a, b) of the fingerprints in column ``fingerprint`` (distinct) that join all that link, none below."""
    blocks = choose_blocks(distinct.count(), radius)
    masks = axis_blocks(blocks)
    choices = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    code = counts_code(F.col("fingerprint"))
    cells = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("_code").bitwiseAND(F.lit(signed(m))).alias("cell")) for k, m in enumerate(choices)])
    rows = distinct.select("fingerprint", code.alias("_code")).select("fingerprint", F.explode(cells).alias("_c")).select("_c.choice", "_c.cell", "fingerprint")
    dealt = tiled(rows, ["choice", "cell"], "fingerprint", cell_limit, scratch, "cells")
    key = ["choice", "cell", "tile_a", "tile_b"]

    def run(batches):
        for table, ends in whole_groups(batches, key):
            bits = table.column("fingerprint").to_numpy().view(np.uint64)
            code = _counts_code(bits)
            sizes = np.diff(ends)
            # Small cells: all cells at once, row against the d-th row below.
            end_of = np.repeat(ends[1:], sizes)
            small = np.repeat(sizes <= 64, sizes)
            a, b = [], []
            at = np.flatnonzero(small)
            for d in range(1, 64):
                at = at[at + d < end_of[at]]
                if not len(at):
                    break
                near = at[np.bitwise_count(code[at] ^ code[at + d]) <= radius]
                near = near[np.bitwise_count(bits[near] ^ bits[near + d]) <= radius]
                a.append(bits[near])
                b.append(bits[near + d])
            for s, e in zip(ends[:-1][sizes > 64], ends[1:][sizes > 64], strict=True):
                own, codes = bits[s:e], code[s:e]

                def near_to(i, others, own=own, codes=codes):
                    hit = np.bitwise_count(codes[others] ^ codes[i]) <= radius
                    hit[hit] = np.bitwise_count(own[others[hit]] ^ own[i]) <= radius
                    return hit

                found = np.array(forest(e - s, near_to), np.int64).reshape(-1, 2)
                a.append(own[found[:, 0]])
                b.append(own[found[:, 1]])
            if a and sum(map(len, a)):
                pairs = np.unique(np.stack([np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return by_group(dealt, key).mapInArrow(run, schema)


def _counts_code(bits: np.ndarray) -> np.ndarray:
    low = np.uint64(0x5555555555555555)
    even, odd = bits & low, bits >> np.uint64(1) & low
    return even | odd | (even & odd) << np.uint64(1)


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (long), component_id of every row: the least doc_id of the rows reachable over links.

    Rows of one fingerprint are one node however many they are, and components are named per fingerprint, so groups of
    copies never become pairs.  Null ids take part and are never a name unless the whole component has none.  Repeated
    rows get the same result each; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(id_and_text(docs, id_col, text_col), words, seed, keep=["doc_id"]), "marked")
    distinct = scratch.write(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")), "distinct")
    edges = scratch.write(links(distinct.select("fingerprint"), scratch, radius), "links")
    return _of_rows(marked, distinct, "fingerprint", components(edges, scratch), scratch).select("doc_id", "fingerprint", "component_id")


def _of_rows(marked: DataFrame, distinct: DataFrame, node: str, joined: DataFrame, scratch: Scratch) -> DataFrame:
    """``marked`` with component_id, the least id of its node's component.  ``distinct`` has a row a node, with its least_id
    and its rows; neither a component of most nodes nor a node of most rows is gathered in one task."""
    nodes = distinct.select(node, "least_id").join(joined.withColumnRenamed("node", node), node, "left")
    nodes = scratch.write(nodes.withColumn("component", F.coalesce("component", node)), "nodes")
    names = scratch.write(nodes.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("nodes")), "names")
    large = hot_keys(names, "component", "nodes", scratch, "hot-components")
    named = scratch.write(join_hot(nodes, names, "component", large, node).select(node, "component_id"), "named")
    return join_hot(marked, named, node, hot_keys(distinct, node, "rows", scratch, "hot-nodes"), "doc_id")


def shingle_set(text: str, words: int = COPY_WORDS, seed: int = SEED) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words, seed)]))


def similar(a: np.ndarray, b: np.ndarray, percent: int = COPY_PERCENT) -> bool:
    """Whether two sets have this Jaccard similarity; empty ones are equal."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def prefix_length(n: int, percent: int = COPY_PERCENT) -> int:
    """So many of a set's ``n`` first shingles, in an order that all sets share, hold one of any set this similar: the two
    have at least ``percent`` of the n in common, so the first common one stands no later."""
    return n + 1 + -percent * n // 100 if n else 0


def sketch(hashes: np.ndarray) -> bytes:
    """For each slot whether an odd number of the set's hashes is in it.  A shared hash leaves no difference, so two sketches
    differ in at most as many bits as hashes are in one set only.  The slots are a power of two; halves of a sketch, one
    laid on the other by exclusive or, are the set's sketch of half as many."""
    least, most = SKETCH
    slots = min(max(least, 1 << (4 * len(hashes) - 1).bit_length()), most)
    odd = np.bincount((hashes >> np.uint64(32) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differences(sketches: list[bytes]) -> Callable[[int | np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function of rows (i, j), i one row or as many as j: in how many bits their sketches differ, of how many; the
    larger one is folded to the smaller."""
    words = np.array([len(s) // 8 for s in sketches], np.int64)
    place, folded = {}, {}
    for w in np.unique(words).tolist():
        has = np.flatnonzero(words >= w)
        place[w], folded[w] = np.zeros(len(words), np.int64), np.empty((len(has), w), np.uint64)
        place[w][has] = np.arange(len(has))
        for own in np.unique(words[has]).tolist():
            of = np.flatnonzero(words == own)
            whole = np.frombuffer(b"".join([sketches[k] for k in of.tolist()]), np.uint64).reshape(len(of), own // w, w)
            folded[w][place[w][of]] = np.bitwise_xor.reduce(whole, axis=1)

    def apart(i, j):
        least = np.minimum(words[i], words[j])
        bits = np.zeros(len(j), np.int64)
        for w in np.unique(least).tolist():
            of, table = least == w, folded[w]
            a = place[w][i[of] if np.ndim(i) else i]
            bits[of] = np.bitwise_count(table[a] ^ table[place[w][j[of]]]).sum(axis=-1, dtype=np.int64)
        return bits, 64 * least

    return apart


def slot_levels(rows: DataFrame, words: int = COPY_WORDS) -> np.ndarray:
    """How frequent shingles are, a byte for each of ``SLOTS`` slots of their hashes, in eighths of an octave.

    Every text is counted, one array a task.  The levels only order shingles, rare ones first; no result hangs on them.
    """

    def count(batches):
        total, seen = np.zeros(SLOTS, np.int64), False
        for b in batches:
            hashes = [h for t in texts_of(b.column("text")) for h in shingle_hashes(t, words)]
            if hashes:
                total += np.bincount((np.concatenate(hashes) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
                seen = True
        if seen:
            parts = total.astype(np.int32).reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slice", "counts"])

    def add(batches):
        sums = {}
        for b in batches:
            for k, counts in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        levels = [(8 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(levels, pa.binary())], names=["slice", "counts"])

    schema = T.StructType([field("slice", "long"), field("counts", "binary")])
    found = np.zeros((SLICES, SLOTS // SLICES), np.uint8)
    for r in rows.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).collect():
        found[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    return found.reshape(-1)


def rarest(hashes: np.ndarray, levels: np.ndarray, percent: int = COPY_PERCENT) -> np.ndarray:
    """The prefix of a set (sorted hashes) by (level, hash)."""
    order = np.argsort(levels[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")
    return hashes[order[: prefix_length(len(hashes), percent)]]


def first_keys(tokens: DataFrame) -> DataFrame:
    """(key, rows) of the keys of several nodes, one of all that have the same nodes: the first in the order of the prefixes.

    A pair's first common key is the first of all keys with its nodes, so none is lost with the others.  Node sets are told
    by their number and a 128-bit sum of hashes.
    """
    sets = tokens.groupBy("key").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.sum("at").alias("at"))
    return sets.where("rows > 1").groupBy("rows", "x", "y").agg(F.min_by("key", "at").alias("key")).select("key", "rows")


def meetings(shared: DataFrame, percent: int, scratch: Scratch, name: str, chain: bool = False, limit: int = CELL_LIMIT) -> DataFrame:
    """Pairs (u, v), u > v, of nodes of different components that share a ``key`` and can have the similarity: by their
    numbers of shingles ``n``, by what is left of both behind the key's places ``at``, as if it were the first they share, and
    by the bits in which their sketches (where ``shared`` has them) differ.
    With ``chain`` only pairs whose sketches differ in no more bits than those of sets at the similarity do on average, and of
    each group's no more than chain together what they all would: fewer than the group has rows."""
    key = ["key", "tile_a", "tile_b"]
    sketched = ["sketch"] if "sketch" in shared.columns else []
    dealt = tiled(shared.select("key", "node", "n", "at", "component", *sketched), ["key"], "node", limit, scratch, name)

    def run(batches):
        for table, ends in whole_groups(batches, key):
            sizes = np.diff(ends)
            # By node, so that groups of much the same nodes chain them by the same pairs.
            table = table.take(np.lexsort((table.column("node").to_numpy(), np.repeat(np.arange(len(sizes)), sizes))))
            node, n, at, component = (table.column(c).to_numpy() for c in ("node", "n", "at", "component"))
            rest = n - at
            apart = differences(table.column("sketch").to_pylist()) if sketched else None

            def can(i, j, n=n, rest=rest, apart=apart, component=component):
                """Whether the pairs (i, j) can; i is one row or as many as j."""
                least, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                fits = (100 * least >= percent * most) & ((100 + percent) * np.minimum(rest[i], rest[j]) >= percent * (least + most))
                fits &= component[i] != component[j]
                at = np.flatnonzero(fits)
                if apart and len(at):
                    bits, slots = apart(i[at] if np.ndim(i) else i, j[at])
                    single = (100 - percent) * (least + most)[at] / (100 + percent)  # hashes in one set only, at the similarity
                    fits[at] = bits <= (slots / 2 * -np.expm1(single * np.log1p(-2 / slots)) if chain else single)
                return fits

            def out(i, j, node=node):
                pairs = np.unique(np.stack([np.maximum(node[i], node[j]), np.minimum(node[i], node[j])], 1), axis=0)
                return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

            # Small groups: all at once, row against the d-th row below.
            end_of, row = np.repeat(ends[1:], sizes), np.flatnonzero(np.repeat(sizes <= 64, sizes))
            a, b = [], []
            for d in range(1, 64):
                row = row[row + d < end_of[row]]
                if not len(row):
                    break
                met = row[can(row, row + d)]
                a.append(met)
                b.append(met + d)
            if a and sum(map(len, a)):
                i, j = np.concatenate(a), np.concatenate(b)
                yield out(*(spanning(len(node), i, j) if chain else (i, j)))
            for s, e in zip(ends[:-1][sizes > 64], ends[1:][sizes > 64], strict=True):
                if chain:
                    found = np.array(forest(e - s, lambda i, others, s=s, can=can: can(s + i, s + others)), np.int64).reshape(-1, 2)
                    if len(found):
                        yield out(s + found[:, 0], s + found[:, 1])
                    continue
                # Rows of the largest component come last and need no partners of their own.
                _, which, many = np.unique(component[s:e], return_inverse=True, return_counts=True)
                last = which == many.argmax()
                order = s + np.concatenate([np.flatnonzero(~last), np.flatnonzero(last)])
                a, b, held = [], [], 0
                for k in range(e - s - int(last.sum())):
                    others = order[k + 1 :]
                    met = others[can(order[k], others)]
                    if len(met):
                        a.append(np.full(len(met), order[k]))
                        b.append(met)
                        held += len(met)
                    if held > 1 << 18:
                        yield out(np.concatenate(a), np.concatenate(b))
                        a, b, held = [], [], 0
                if held:
                    yield out(np.concatenate(a), np.concatenate(b))

    return by_group(dealt, key).mapInArrow(run, T.StructType([field("u", "long"), field("v", "long")])).distinct()


def near_copies(docs: DataFrame, words: int = COPY_WORDS, percent: int = COPY_PERCENT, id_col: str = "doc_id", text_col: str = "text", cell_limit: int = CELL_LIMIT) -> DataFrame:
    """doc_id, component_id of every row: the least doc_id of the rows reachable over texts whose sets of shingles have
    a Jaccard similarity of ``percent``.

    At that similarity fingerprints differ in some 5 to 13 of 64 bits; the grid of such a radius has cells of a tenth of
    all rows.  So fingerprints within ``RADIUS`` give the first candidates, and the rest come from prefixes: sets of this
    similarity share one of their rarest shingles (``prefix_length``), so no pair is left out.  Every candidate is compared
    exactly.  Of the texts that share a shingle first only so many pairs are taken as chain together what sketches tell to be
    likely links; then all pairs of different components that can be links are, so that no link between components is left
    out and groups of copies never become pairs.  Texts of one set are one node however many they are.
    Ids must be unique and not null (row numbers, say).
    """
    scratch = Scratch(docs.sparkSession, "copies")
    rows = id_and_text(docs, id_col, text_col)
    levels = slot_levels(rows, words)

    def make():
        from xxhash import xxh64_intdigest

        def work(texts):
            sets, prints = [], []
            for t in texts:
                hashes = list(shingle_hashes(t, words))
                prints.append(majority(hashes))
                sets.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes])))
            return {
                "node": np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64),
                "n": [len(s) for s in sets],
                "fingerprint": np.array(prints, np.uint64).view(np.int64),
                "prefix": [rarest(s, levels, percent).view(np.int64) for s in sets],
                "sketch": [sketch(s) for s in sets],
            }

        return work

    fields = [field("node", "long"), field("n", "long"), field("fingerprint", "long"), T.StructField("prefix", T.ArrayType(T.LongType())), field("sketch", "binary")]
    read = scratch.write(map_rows(rows, make, fields, keep=["doc_id"]), "read")
    # Texts of one set have one number of shingles and the same prefix; their fingerprints may differ by repeats.
    whole = read.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.min("fingerprint").alias("fingerprint"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.count("*").alias("rows"))
    whole = scratch.write(whole, "whole")
    marked, distinct = scratch.write(read.select("doc_id", "node"), "marked"), scratch.write(whole.drop("prefix"), "distinct")
    scratch.drop("read")
    tokens = whole.select("node", "n", F.posexplode("prefix").alias("at", "key")).withColumn("at", F.col("at").cast("long"))
    several = tokens.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    met = scratch.write(tokens.join(several.hint("shuffle_hash"), "key", "left_semi"), "met")
    groups = scratch.write(first_keys(met), "groups")
    shared = scratch.write(met.join(groups.select("key").hint("shuffle_hash"), "key", "left_semi"), "shared")
    left = scratch.write(shared.join(distinct.select("node", "sketch"), "node").withColumn("component", F.col("node")), "left-0")
    scratch.drop("met", "whole")

    def verified(pairs, name):
        """Of the pairs those that have the similarity."""
        pairs = scratch.write(pairs, f"{name}-pairs")
        # Sets of the candidates only, out of one text each.
        wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        one_each = distinct.select("node", F.col("least_id").alias("doc_id")).join(wanted, "node")

        def parse():
            return lambda texts: {"set": [shingle_set(t, words).tobytes() for t in texts]}

        sets = scratch.write(map_rows(rows.join(one_each, "doc_id"), parse, [field("set", "binary")], keep=["node"]), f"{name}-sets")
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("set_u")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("set_v")), "v")

        def verify(batches):
            for b in batches:
                of = zip(b.column("set_u").to_pylist(), b.column("set_v").to_pylist(), strict=True)
                is_copy = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in of], pa.bool_())
                yield b.select(["u", "v"]).filter(is_copy)

        found = scratch.write(both.select("u", "v", "set_u", "set_v").mapInArrow(verify, T.StructType([field("u", "long"), field("v", "long")])), f"{name}-found")
        scratch.drop(f"{name}-sets", f"{name}-pairs")
        return found

    prints = scratch.write(distinct.groupBy("fingerprint").agg(F.min("node").alias("m")), "prints")
    edges = scratch.write(links(prints.select("fingerprint"), scratch), "links")
    ends = edges.join(prints.select(F.col("fingerprint").alias("a"), F.col("m").alias("u")), "a").join(prints.select(F.col("fingerprint").alias("b"), F.col("m").alias("v")), "b")
    pairs = ends.select("u", "v").unionByName(distinct.join(prints, "fingerprint").select(F.col("node").alias("u"), F.col("m").alias("v")))
    pairs = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    sizes = lambda end: distinct.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"))
    # Sets whose sizes are further apart than the similarity can't have it.
    pairs = pairs.join(sizes("u"), "u").join(sizes("v"), "v").where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")).select("u", "v")
    found = verified(pairs.unionByName(meetings(left, percent, scratch, "met-0", True, cell_limit)).distinct(), "met-0")
    scratch.drop("left-0")
    joined = components(found, Scratch(docs.sparkSession, "copies-joined"))
    placed = scratch.write(shared.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed-1")
    apart = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    left = scratch.write(placed.join(apart, "key", "left_semi").join(distinct.select("node", "sketch"), "node"), "left-1")
    scratch.drop("placed-1")
    more = verified(meetings(left, percent, scratch, "met-1", limit=cell_limit), "met-1")
    if not more.isEmpty():
        both = joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
        joined = components(both, Scratch(docs.sparkSession, "copies-joined"))
    return _of_rows(marked, distinct, "node", joined, scratch).select("doc_id", "component_id")


def op5_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))
