"""Embedding near-duplicates by a forest of random-projection trees with spill.

Each tree splits the space by random directions at the medians of a bounded sample; every vector goes down every tree
and, within a margin of a split, down both sides.  Vectors are compared in the leaves they share, exactly, so links are
never false; a link is missed only if every tree parts its two vectors.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.buckets import by_group, tiled, whole_groups
from tidemark.llm.common import Scratch, tune
from tidemark.llm.graph import components

THRESHOLD = 0.93
#: Vectors of a dimension that fit the trees (the bound of the sample), vectors a leaf should hold, share of a node's
#: sample that goes down both sides, and the recall that the number of trees is chosen for, at the threshold itself.
SAMPLE, LEAF, SPILL, RECALL = 20_000, 400, 0.06, 0.999
#: Pairs of each kind that parting is measured on, and how many times the trees of ``forest_shape`` may be needed before
#: another depth is sought.
MEASURED, MORE_TREES = 500, 4
#: Vectors of one leaf that a task compares; larger leaves are dealt into tiles.
LEAF_LIMIT = 1500


class Tree:
    """Directions and thresholds of a complete tree, in heap order."""

    def __init__(self, sample: np.ndarray, depth: int, spill: float, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.directions = rng.standard_normal((2**depth - 1, sample.shape[1]))
        self.low, self.high = np.zeros(2**depth - 1), np.zeros(2**depth - 1)
        rows = {0: np.arange(len(sample))}
        for node in range(2**depth - 1):
            own = rows.pop(node)
            at = sample[own] @ self.directions[node]
            if len(own):
                middle, self.low[node], self.high[node] = np.quantile(at, [0.5, 0.5 - spill / 2, 0.5 + spill / 2])
            else:
                middle = 0.0
            rows[2 * node + 1], rows[2 * node + 2] = own[at <= middle], own[at > middle]

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf a vector falls into."""
        row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            at = np.einsum("ij,ij->i", vectors[row], self.directions[node])
            left, right = at <= self.high[node], at >= self.low[node]
            row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
        return row, node - (2**self.depth - 1)


    def together(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Down to which depth the rows of x and y share a node."""
        pair, node, deepest = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for level in range(self.depth):
            at = np.stack([np.einsum("ij,ij->i", v[pair], self.directions[node]) for v in (x, y)])
            left, right = (at <= self.high[node]).all(0), (at >= self.low[node]).all(0)
            pair, node = np.concatenate((pair[left], pair[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
            deepest[pair] = level + 1
        return deepest


def threshold_pairs(points: np.ndarray, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs about the threshold: sample vectors with partners at its angle, in random directions and in directions
    between sample vectors, and pairs of the sample itself up to half way from there to equality."""
    rng = np.random.default_rng(seed)
    x = points[rng.integers(0, len(points), 2 * MEASURED)]
    away = rng.standard_normal(x.shape)
    away[MEASURED:] = points[rng.integers(0, len(points), MEASURED)] - points[rng.integers(0, len(points), MEASURED)]
    away -= np.einsum("ij,ij->i", away, x)[:, None] * x
    norm = np.linalg.norm(away, axis=1)
    some = norm > 1e-9
    x, away = x[some], away[some] / norm[some, None]
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * away
    first = rng.permutation(len(points))[:2000]
    found = []
    for k in range(0, len(first), 250):
        cosine = points[first[k : k + 250]] @ points.T
        i, j = np.nonzero((cosine >= threshold) & (cosine <= (1 + threshold) / 2))
        found += zip(first[k + i].tolist(), j.tolist(), strict=True)
    own = np.array([found[k] for k in rng.permutation(len(found))[:MEASURED]], np.int64).reshape(-1, 2)
    return np.concatenate((x, points[own[:, 0]])), np.concatenate((y, points[own[:, 1]]))


def fitted_trees(points: np.ndarray, n: int, threshold: float, seed: int, recall: float = RECALL) -> list[Tree]:
    """The trees for n vectors: those of ``forest_shape``, and more until the measured pairs meet with this recall.

    Splits are at medians, so vectors with a common direction are parted more often than their angle says (and a shift
    of all vectors changes no split).  Where that needs many more trees, the depth that compares least is taken.
    """
    depth, n_trees = forest_shape(n, threshold)
    # A leaf needs some sample; beyond that the trees grow no further and large leaves are dealt into tiles.
    depth = min(depth, max(0, int(math.log2(max(1, len(points) / 8)))))
    x, y = threshold_pairs(points, threshold, seed)
    tree = lambda t: Tree(points, depth, SPILL, seed * 1000 + t)
    trees = [tree(t) for t in range(n_trees if depth else 1)]
    if not depth or not len(x):
        return trees
    deepest = [t.together(x, y) for t in trees]
    enough = lambda: np.any([d == depth for d in deepest], axis=0).mean() >= recall
    while not enough() and len(trees) < MORE_TREES * n_trees:
        trees.append(tree(len(trees)))
        deepest.append(trees[-1].together(x, y))
    if enough():
        return trees
    shares = np.stack(deepest)

    def needed(d: int) -> int:
        parted = 1 - np.maximum((shares >= d).mean(0), 0.5 / len(shares))
        return 1 if not d else next(t for t in range(1, 100_000) if (parted**t).mean() <= 1 - recall)

    cost = lambda d: needed(d) * (n / 2**d + LEAF) * (1 + SPILL) ** d
    depth = min(range(depth + 1), key=cost)
    trees = [tree(t) for t in range(needed(depth))]
    met = np.any([t.together(x, y) == depth for t in trees], axis=0)
    while met.mean() < recall:
        trees.append(tree(len(trees)))
        met |= trees[-1].together(x, y) == depth
    return trees


def forest_shape(n: int, threshold: float = THRESHOLD, leaf: int = LEAF, recall: float = RECALL) -> tuple[int, int]:
    """(depth, trees) to begin with: a split through the centre of centred vectors parts two of them at the threshold's
    angle with probability angle / pi at most."""
    depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
    stays = (1 - math.acos(threshold) / math.pi) ** depth
    trees = 1 if depth == 0 else max(4, math.ceil(math.log(1 - recall) / math.log(1 - stays)))
    return depth, trees


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, dim, digest (of the vector's bytes as doubles), unit (bytes of the unit vector); digest and unit are
    null for rows that link with nothing."""
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    fields = [rows.schema["vec_id"], rows.schema["label"], T.StructField("dim", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("unit", T.BinaryType())]
    tune(vectors.sparkSession)

    def run(batches):
        for b in batches:
            dims, digests, units = [], [], []
            for v, label in zip(b.column("vector").to_pylist(), b.column("label").to_pylist(), strict=True):
                dim = digest = unit = None
                if v and label is not None and None not in v:
                    x = np.array(v, np.float64) + 0.0  # one zero only
                    scale = np.abs(x).max()
                    if np.isfinite(scale) and scale > 0:
                        y = x / scale  # no overflow or underflow of the norm
                        dim, digest = len(v), hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                        unit = (y / math.sqrt(float(y @ y))).tobytes()
                dims.append(dim), digests.append(digest), units.append(unit)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def _stack(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows are compared when their labels are equal and not null and their vectors have one dimension; null, empty and
    zero vectors and those with null or non-finite components link with nothing.  Equal vectors of a label are one node
    with a multiplicity, so groups of copies never become pairs.  Null ids take part and name a component only if it
    has no other; ``kept`` holds for rows whose id names their component.  Repeated rows are vectors of their own.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    rows = scratch.write(prepared(vectors, id_col, vector_col, label_col), "rows")
    valid = rows.where(F.col("digest").isNotNull())
    nodes = valid.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    found = None
    for (dim,) in nodes.groupBy("dim").count().select("dim").collect():
        of_dim = nodes.where(F.col("dim") == dim)
        part = _links_of(of_dim, dim, threshold, seed, scratch)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "node long, links long, other long")
    found = scratch.write(found, "found")

    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select("node", "other"), scratch).withColumnRenamed("component", "root")
    named = nodes.select("node", "label", "digest", "copies", "least_id").join(linked, "node", "left").join(joined, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    result = named.join(names, "root").select(
        "label", "digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    out = rows.select("vec_id", "label", "digest").join(scratch.write(result, "result"), ["label", "digest"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _links_of(nodes: DataFrame, dim: int, threshold: float, seed: int, scratch: Scratch) -> DataFrame:
    """(node, links, other): rows that a node has from each leaf: links counted there, or an edge of a spanning forest.

    A pair that meets in several leaves is counted in the first of them only: every row carries the list of its leaves.
    """
    sample = nodes.select("unit").orderBy(F.xxhash64("digest", F.lit(seed)), "digest").limit(SAMPLE).collect()
    points = np.frombuffer(b"".join(r["unit"] for r in sample), np.float64).reshape(-1, dim)
    trees = fitted_trees(points, nodes.count(), threshold, seed)
    shared = nodes.sparkSession.sparkContext.broadcast(trees)  # at most 8 * trees * SAMPLE / 8 * dim bytes
    fields = [T.StructField("leaf", T.LongType())] + [nodes.schema[c] for c in ("label", "node", "copies", "unit")] + [T.StructField("leaves", T.BinaryType())]

    def spread(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _stack(b.column("unit"), dim)
            got = [t.leaves(x) for t in shared.value]
            row = np.concatenate([r for r, _ in got])
            leaf = np.concatenate([leaf + (k << 32) for k, (_, leaf) in enumerate(got)])
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            cuts = np.searchsorted(row, np.arange(len(x) + 1))
            own = [leaf[s:e].tobytes() for s, e in zip(cuts, cuts[1:])]
            for i in range(0, len(row), 2000):
                r = pa.array(row[i : i + 2000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[i : i + 2000]), *[b.column(c).take(r) for c in ("label", "node", "copies", "unit")], pa.array([own[k] for k in row[i : i + 2000]], pa.binary())],
                    names=[f.name for f in fields],
                )

    in_leaves = nodes.select("label", "node", "copies", "unit").mapInArrow(spread, T.StructType(fields))
    in_leaves = scratch.write(in_leaves, f"leaves-{dim}")
    key = ["leaf", "label", "tile_a", "tile_b"]
    dealt = tiled(in_leaves, ["leaf", "label"], "node", LEAF_LIMIT, scratch, f"leaves-{dim}")
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("node", "links", "other")])

    def compare(batches):
        for table, ends in whole_groups(batches, key):
            for s, e in zip(ends, ends[1:]):
                if e - s > 1:
                    yield from leaf_links(table.slice(s, e - s))

    def leaf_links(group: pa.Table):
        x, n = _stack(group.column("unit"), dim), group.num_rows
        link = np.zeros((n, n), bool)
        for i in range(0, n, 500):
            cosine = x[i : i + 500] @ x.T
            link[i : i + 500] = cosine >= threshold
            for a, b in np.argwhere(np.abs(cosine - threshold) < 1e-9):  # not left to the order of a product's sums
                link[i + a, b] = math.fsum(x[i + a] * x[b]) >= threshold
        np.fill_diagonal(link, False)
        if not link.any():
            return
        link |= link.T
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        # Which pairs have met before: in a leaf before this one.
        here = group.column("leaf")[0].as_py()
        earlier = [leaves[leaves < here] for leaves in (np.frombuffer(v, np.int64) for v in group.column("leaves").to_pylist())]
        hit = np.flatnonzero(link.any(1))
        names = np.unique(np.concatenate([earlier[i] for i in hit]))
        count = link.copy()
        # Tiles of one leaf share their chunks: a pair within a chunk belongs to the tile (chunk, chunk).
        if len(names):
            member = np.zeros((len(hit), len(names)), np.float32)
            for k, i in enumerate(hit):
                member[k, np.searchsorted(names, earlier[i])] = 1
            for i in range(0, len(hit), 500):
                met = member[i : i + 500] @ member.T > 0
                count[np.ix_(hit[i : i + 500], hit)] &= ~met
        a, b = group.column("tile_a")[0].as_py(), group.column("tile_b")[0].as_py()
        if a != b:
            side = group.column("chunk").to_numpy()
            count &= side[:, None] != side[None, :]
        links = count @ copies
        label = np.arange(n)
        while True:  # least reachable row
            new = label.copy()
            for i in range(0, n, 500):
                new[i : i + 500] = np.minimum(new[i : i + 500], np.where(link[i : i + 500], label[None, :], n).min(1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        counted, joined = np.flatnonzero(links), np.flatnonzero(label != np.arange(n))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((node[counted], node[joined]))),
                pa.array(np.concatenate((links[counted], np.zeros(len(joined), np.int64)))),
                pa.array([None] * len(counted) + node[label[joined]].tolist(), pa.int64()),
            ],
            names=out.names,
        )

    return by_group(dealt, key).mapInArrow(compare, out)


def op9_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
