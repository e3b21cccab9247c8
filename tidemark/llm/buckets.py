"""Streams of sorted groups: what Python stages over buckets share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def tiled(rows: DataFrame, key: list[str], member: str, limit: int, scratch: Scratch, name: str) -> DataFrame:
    """Add (tile_a, tile_b, chunk): a group of more than ``limit`` rows is dealt into k chunks, and each row goes to the k tiles
    of its chunk, so that any two rows of a group meet in a tile and none holds more than about twice ``limit`` rows."""
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    sizes = scratch.write(sizes.withColumn("_k", F.ceil(F.col("_n") / limit).cast("int")).drop("_n"), f"{name}-sizes")
    if sizes.isEmpty():
        return rows.select("*", *[F.lit(0).alias(c) for c in ("tile_a", "tile_b", "chunk")])
    chunks = F.coalesce("_k", F.lit(1))
    dealt = rows.join(sizes, key, "left").withColumn("_c", F.pmod(F.xxhash64(member), chunks).cast("int"))
    dealt = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return dealt.select(*rows.columns, F.least("_c", "_j").alias("tile_a"), F.greatest("_c", "_j").alias("tile_b"), F.col("_c").alias("chunk"))


#: A key is hot from one part in so many of all rows on: fewer keys than that can be.
HOT_SHARE = 1000


def hot_keys(sizes: DataFrame, key: str, n: str, scratch: Scratch, name: str) -> DataFrame:
    """(_hot, _parts) of the keys that hold over a ``HOT_SHARE``-th of all rows: fewer than ``HOT_SHARE`` rows, whatever the
    input.  ``sizes`` has a row a key, with its rows in ``n``; no part of a key is larger than that share."""
    total = sizes.agg(F.sum(n).alias("n")).first()["n"] or 0
    least = -(-total // HOT_SHARE) or 1
    return scratch.write(sizes.where(F.col(n) > least).select(F.col(key).alias("_hot"), F.ceil(F.col(n) / least).cast("long").alias("_parts")), name)


def join_hot(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, member: str, how: str = "inner") -> DataFrame:
    """The join on ``key``, a hot key's rows dealt by ``member`` over its parts, for each of which ``table`` (few rows a key)
    gets a copy of the key's row.  Only the bounded list of hot keys is broadcast."""
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_part", F.pmod(F.xxhash64(member), parts)).drop("_hot", "_parts")
    copies = table.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    copies = copies.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_hot", "_parts")
    return dealt.join(copies, [key, "_part"], how).drop("_part")


def by_group(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a group next to each other in one partition."""
    return df.repartition(*key).sortWithinPartitions(*key)


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table of whole groups, first row of every group and the end): groups cut by a batch border are held back."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in key:
            column = table.column(k).combine_chunks()
            values = column.to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    def ends_in(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(k)[at].as_py() for k in key)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and ends_in(held[-1], -1) == ends_in(batch, 0) == ends_in(batch, -1):
            held.append(batch)  # nothing but more of the open group
            continue
        table = pa.Table.from_batches([*held, batch])
        ends = cut(table)
        if len(ends) > 2:
            yield table.slice(0, ends[-2]), ends[:-1]
            held = table.slice(ends[-2]).to_batches()
        else:
            held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join what ``near`` links: a search that asks each reached item only about items not reached yet, so a
    dense cluster costs little more than its size and no pair is listed.  ``near(i, others)`` is a boolean mask."""
    edges, waiting = [], np.arange(n)
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            i = queue.pop()
            hit = near(i, waiting)
            if hit.any():
                found = waiting[hit].tolist()
                edges += [(i, j) for j in found]
                queue += found
                waiting = waiting[~hit]
    return edges


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges (a, b) among n items those that join all that they join, without a circle.  In each round every
    component takes one edge to a component of a smaller name."""
    name, taken = np.arange(n), []
    while True:
        x, y = name[a], name[b]
        out = np.flatnonzero(x != y)
        if not len(out):
            break
        above, first = np.unique(np.maximum(x[out], y[out]), return_index=True)
        taken.append(out[first])
        to = np.arange(n)
        to[above] = np.minimum(x[out], y[out])[first]
        while (further := to[to] != to).any():
            to[further] = to[to[further]]
        name = to[name]
    chosen = np.concatenate([np.zeros(0, np.int64), *taken])
    return a[chosen], b[chosen]
