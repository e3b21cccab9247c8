"""Packed id matrices: best-fit-decreasing with a segment tree over free room, within bounded runs of documents.

A run is what a task reads until it holds ``run_tokens`` ids; it is packed by itself, so nothing is shuffled, memory
is bounded by the run and a lost task repeats only its own rows.  The price is a few underfull sequences per run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import documents, id_and_text, texts_of, tune
from tidemark.llm.packing import cut
from tidemark.llm.ranks import encoder_for, ranks_are_equivalent
from tidemark.llm.segments import vocabulary_path

VOCABULARY, CAPACITY, END_ID, PAD_ID = "byte_bpe_50k.json", 1024, 50256, 50256
RUN_TOKENS = 4_000_000


class RoomTree:
    """Counts of open bins by free room in a segment tree; ``least(n)`` is the least room of at least n, or -1."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += n
            k >>= 1

    def least(self, n: int) -> int:
        count, k = self.count, n + self.size
        if count[k]:
            return n
        while k > 1:
            if not k & 1 and count[k + 1]:  # the sibling to the right holds larger rooms
                k += 1
                while k < self.size:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces in each bin."""
    tree, open_, bins = RoomTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room = tree.least(n)
        if room < 0:
            room, b = capacity, len(bins)
            bins.append([])
        else:
            b = open_[room].pop()
            tree.add(room, -1)
        bins[b].append(i)
        left = room - n
        if left:
            open_.setdefault(left, []).append(b)
            tree.add(left, 1)
    return bins


SCHEMA = T.StructType(
    [
        T.StructField("sequence_id", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("input_ids", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("position_resets", T.ArrayType(T.IntegerType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_starts", T.ArrayType(T.LongType())),
    ]
)


def pack_matrices(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY,
    end_id: int | None = END_ID,
    pad_id: int = PAD_ID,
    dtype: str = "<u2",
    run_tokens: int = RUN_TOKENS,
) -> DataFrame:
    """One row per sequence: ``input_ids`` (capacity ids of ``dtype``, padded), ``cu_seqlens`` (0 and the ends of the
    segments), ``position_resets`` (where position ids start at 0 again), and of every segment the document's id and
    the number of its ids before.  Documents longer than a sequence are split without loss.

    Null texts are empty: with an end id they are a segment of it, without one they have none.  Null and repeated ids
    and repeated rows are documents of their own.
    """
    rows = id_and_text(docs)
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField(f.name, T.ArrayType(id_type)) if f.name == "doc_ids" else f for f in SCHEMA.fields])
    by_ranks = ranks_are_equivalent(vocabulary_path(vocabulary))
    tune(docs.sparkSession)
    kind = np.dtype(dtype)
    if max(pad_id, end_id or 0) > np.iinfo(kind).max:
        raise ValueError(f"ids don't fit {dtype}")
    tail = b"" if end_id is None else np.array([end_id], kind).tobytes()

    def run(batches):
        encoder, width = encoder_for(vocabulary, by_ranks, dtype), kind.itemsize
        number = TaskContext.get().partitionId() << 33
        pad = np.array([pad_id], kind).tobytes()
        pieces: list[tuple] = []
        held = 0

        def packed():
            nonlocal number, held
            out = []
            for bin_ in best_fit_decreasing([len(p[2]) // width for p in pieces], capacity):
                ids = b"".join([pieces[i][2] for i in bin_])
                ends = np.cumsum([0] + [len(pieces[i][2]) // width for i in bin_]).tolist()
                out.append((number, ends[-1], ids + pad * (capacity - ends[-1]), ends, ends[:-1], [pieces[i][0] for i in bin_], [pieces[i][1] for i in bin_]))
                number += 1
                if len(out) == 1000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)
            pieces.clear()
            held = 0

        def batch_of(out):
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(to_arrow_type(id_type)), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=SCHEMA.names)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts_of(batch.column("text"))), strict=True):
                ids += tail
                n = len(ids) // width
                if n:
                    pieces += [(doc_id, s, ids[s * width : (s + k) * width]) for s, k in cut(n, capacity)]
                    held += n
                if held >= run_tokens:
                    yield from packed()
        if pieces:
            yield from packed()

    return rows.mapInArrow(run, schema)


def position_ids(position_resets: list[int], n_tokens: int) -> np.ndarray:
    """Position of every token of a sequence, from 0 at each reset."""
    starts = np.zeros(n_tokens, np.int64)
    starts[position_resets] = position_resets
    return np.arange(n_tokens) - np.maximum.accumulate(starts)


def op3_id_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_matrices(documents(spark, sf_dir))
