"""Packing of documents into as few sequences as possible by swap-based local search over classes of equal bins.

The corpus decides only how many pieces of each length there are: 1..capacity, so the plan works on a table of at most
``capacity`` counts whatever the corpus holds.  Bins that hold the same lengths are one class with a multiplicity, and
an exchange between two classes is done for as many bins as both have.  Pieces then find their place by their rank
among the pieces of their length, which needs counts by task and length, not a global sort.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, documents, id_and_text, texts_of, tune
from tidemark.llm.ranks import encoder_for, ranks_are_equivalent
from tidemark.llm.segments import vocabulary_path

VOCABULARY, CAPACITY, END_ID = "byte_bpe_50k.json", 1024, 2

Bin = tuple[int, ...]  # lengths, descending


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Counter[Bin]:
    """Classes of bins: every length goes to the fullest bins that still take it, equal bins at once."""
    room: dict[int, Counter[Bin]] = {}

    def put(bin_: Bin, n: int, left: int) -> None:
        room.setdefault(left, Counter())[bin_] += n

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            left = min((r for r in room if r >= length), default=None)
            if left is None:
                bin_, have, left = (), n, capacity
            else:
                bin_, have = room[left].popitem()
                if not room[left]:
                    del room[left]
            fits = left // length
            full = min(have, n // fits)
            if full:
                put(bin_ + (length,) * fits, full, left - fits * length)
            n -= full * fits
            if full < have and n and n < fits:
                put(bin_ + (length,) * n, 1, left - n * length)
                full, n = full + 1, 0
            if bin_ and full < have:
                put(bin_, have - full, left)
    bins: Counter[Bin] = Counter()
    for classes in room.values():
        bins.update(classes)
    return bins


def _exchange(giver: Bin, taker: Bin, gap: int) -> tuple[int, Bin, Bin] | None:
    """The best way to raise ``taker``'s fill by at most ``gap`` out of ``giver``: a move, a one-for-one or a
    two-for-one swap.  Returns (gain, new giver, new taker)."""
    best: tuple[int, tuple[int, ...], tuple[int, ...]] | None = None
    gives, takes = sorted(set(giver), reverse=True), [0, *sorted(set(taker))]
    for x in gives:  # a move (y = 0) or a swap of x for y
        for y in takes:
            if 0 < x - y <= gap and (best is None or x - y > best[0]):
                best = (x - y, (x,), (y,) if y else ())
    if best is None or best[0] < gap:
        own = Counter(giver)
        for i, x in enumerate(gives):
            for z in gives[i:]:
                if x == z and own[x] < 2:
                    continue
                for y in takes[1:]:
                    if 0 < x + z - y <= gap and (best is None or x + z - y > best[0]):
                        best = (x + z - y, (x, z), (y,))
    if best is None:
        return None
    _, out, back = best
    left, held = Counter(giver), Counter(taker)
    left.subtract(out)
    left.update(back)
    held.subtract(back)
    held.update(out)
    order = lambda c: tuple(sorted(c.elements(), reverse=True))
    return best[0], order(left), order(held)


def _masks(bin_: Bin, capacity: int) -> tuple[int, int]:
    """Bits of the amounts that a bin can give (one length, or two together) and of those that it can take: into its gap,
    or into the gap and the place of one length that it gives back."""
    gives, takes, own = 0, 0, Counter(bin_)
    lengths = list(own)
    for i, x in enumerate(lengths):
        gives |= 1 << x
        for z in lengths[i:]:
            if x != z or own[x] > 1:
                gives |= 1 << x + z
    gap = (1 << capacity - sum(bin_)) - 1
    for y in (0, *lengths):
        takes |= gap << y + 1
    return gives, takes & (1 << capacity + 1) - 1


class _Open:
    """Classes of underfull bins: their numbers, fills and masks, row by row."""

    def __init__(self, capacity: int):
        self.capacity, self.bytes = capacity, 8 * (capacity // 64 + 1)
        self.row: dict[Bin, int] = {}
        self.bins: list[Bin | None] = []
        self.free: list[int] = []
        self.n = np.zeros(0, np.int64)
        self.fill = np.zeros(0, np.int64)
        self.gives = self.takes = np.zeros((0, self.bytes // 8), np.uint64)

    def add(self, bin_: Bin, n: int) -> None:
        if bin_ not in self.row:
            if not self.free:
                more = max(64, len(self.n))
                self.free = list(range(len(self.n) + more - 1, len(self.n) - 1, -1))
                self.bins += [None] * more
                for name in ("n", "fill", "gives", "takes"):
                    old = getattr(self, name)
                    setattr(self, name, np.concatenate((old, np.zeros((more, *old.shape[1:]), old.dtype))))
            k = self.row[bin_] = self.free.pop()
            self.bins[k], self.fill[k] = bin_, sum(bin_)
            self.gives[k], self.takes[k] = (np.frombuffer(m.to_bytes(self.bytes, "little"), np.uint64) for m in _masks(bin_, self.capacity))
        k = self.row[bin_]
        self.n[k] += n
        if not self.n[k]:
            self.gives[k] = self.takes[k] = 0
            self.bins[k] = None
            self.free.append(self.row.pop(bin_))

    def taker(self, giver: Bin) -> Bin | None:
        """The fullest class, at least as full, that can take something of this one."""
        g = self.row[giver]
        some = np.flatnonzero(self.gives[g])
        hit = ((self.takes[:, some] & self.gives[g, some]) != 0).any(axis=1) & (self.fill >= self.fill[g])
        hit[g] &= self.n[g] > 1
        at = np.flatnonzero(hit)
        if not len(at):
            return None
        at = at[self.fill[at] == self.fill[at].max()]
        return min(self.bins[k] for k in at)

    def givers(self, taker: Bin) -> list[Bin]:
        """The classes, at most as full, of which this one can take something."""
        t = self.row[taker]
        some = np.flatnonzero(self.takes[t])
        hit = ((self.gives[:, some] & self.takes[t, some]) != 0).any(axis=1) & (self.fill <= self.fill[t])
        return [self.bins[k] for k in np.flatnonzero(hit)]


def local_search(bins: Counter[Bin], capacity: int) -> Counter[Bin]:
    """Exchange between underfull bins until no exchange raises the sum of squared fills; emptied bins go.

    The taker is at least as full as the giver, so a gain g raises the sum by 2g(taker - giver + g) > 0.  A bin's fill
    is at most the capacity, so the sum is bounded and the search ends by itself.  A class that found no taker is looked
    at again only when a class appears, or has a second bin, that can take of it.
    """
    full: Counter[Bin] = Counter({b: n for b, n in bins.items() if sum(b) == capacity})
    open_ = _Open(capacity)
    for b, n in bins.items():
        if sum(b) < capacity and n:
            open_.add(b, n)
    waiting = [(sum(b), b) for b in open_.row]  # empty the least full first
    heapq.heapify(waiting)
    queued = set(open_.row)

    def wait(b: Bin) -> None:
        if b not in queued:
            queued.add(b)
            heapq.heappush(waiting, (sum(b), b))

    while waiting:
        giver = heapq.heappop(waiting)[1]
        queued.discard(giver)
        taker = open_.taker(giver) if giver in open_.row else None
        if taker is None:
            continue
        _, left, held = _exchange(giver, taker, capacity - sum(taker))
        have, takes = int(open_.n[open_.row[giver]]), int(open_.n[open_.row[taker]])
        n = have // 2 if giver == taker else min(have, takes)
        open_.add(giver, -n)
        open_.add(taker, -n)
        if giver in open_.row:
            wait(giver)
        for b in (left, held):
            if not b:
                continue
            if sum(b) == capacity:
                full[b] += n
                continue
            new = b not in open_.row
            open_.add(b, n)
            wait(b)
            if new:
                for other in open_.givers(b):
                    wait(other)
    return full + Counter({b: int(open_.n[k]) for b, k in open_.row.items()})


def plan_bins(counts: dict[int, int], capacity: int) -> Counter[Bin]:
    return local_search(best_fit_decreasing(counts, capacity), capacity)


class Places:
    """Where the piece of a length and rank goes: arrays by length, as large as the plan."""

    def __init__(self, bins: Counter[Bin]):
        by_length: dict[int, list[tuple[int, int, int, int]]] = {}
        first = 0
        for bin_, n in sorted(bins.items(), reverse=True):
            offset = 0
            for length, copies in sorted(Counter(bin_).items(), reverse=True):
                by_length.setdefault(length, []).append((copies * n, first, copies, offset))
                offset += length * copies
            first += n
        self.n_bins = first
        self.by_length = {}
        for length, rows in by_length.items():
            sizes, firsts, copies, offsets = map(np.array, zip(*rows, strict=True))
            self.by_length[length] = np.concatenate(([0], np.cumsum(sizes))), firsts, copies, offsets

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset) of every piece."""
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            until, firsts, copies, offsets = self.by_length[int(length)]
            k = np.searchsorted(until, ranks[at], side="right") - 1
            inside = ranks[at] - until[k]
            sequence[at] = firsts[k] + inside // copies[k]
            offset[at] = offsets[k] + inside % copies[k] * length
        return sequence, offset


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole sequences, but for the first, which is shorter."""
    if n <= capacity:
        return [(0, n)]
    rest = n % capacity
    return ([(0, rest)] if rest else []) + [(s, capacity) for s in range(rest, n, capacity)]


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int | None, keep_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids], and for ranks: task and the piece's number among the task's
    pieces of that length."""
    rows = id_and_text(docs)
    by_ranks = ranks_are_equivalent(vocabulary_path(vocabulary))
    tune(docs.sparkSession)
    fields = [rows.schema["doc_id"]] + [T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "ids_crc32", "task", "number")]
    fields += [T.StructField("ids", T.BinaryType())] * keep_ids
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches):
        encoder, task = encoder_for(vocabulary, by_ranks), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            source, out = [], []
            for k, packed in enumerate(encoder.encode(texts_of(batch.column("text")))):
                packed += tail
                for piece, (start, length) in enumerate(cut(len(packed) // 4, capacity)):
                    ids = packed[4 * start : 4 * (start + length)]
                    out.append((piece, start, length, zlib.crc32(ids), task, seen[length], ids))
                    seen[length] += 1
                    source.append(k)
            columns = list(zip(*out, strict=True))
            arrays = [batch.column("doc_id").take(pa.array(source, pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def pack_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int | None = END_ID, keep_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids] of every piece of every row.

    Documents longer than a sequence are cut without loss.  Null texts are empty; with an end id they are a piece of
    one token.  Without one an empty text has a piece of length 0 in sequence -1.  Null, repeated ids and repeated rows
    are documents of their own.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(tokenized_pieces(docs, vocabulary, capacity, end_id, keep_ids), "pieces")
    by_task = scratch.write(pieces.where("length > 0").groupBy("task", "length").count(), "by_task")
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = Places(plan_bins(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("task", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    # By shuffle: the counts grow with the number of tasks.  A key is one task's pieces of one length.
    ranked = pieces.join(first.hint("shuffle_hash"), ["task", "length"], "left").withColumn("rank", F.coalesce(F.col("before") + F.col("number"), F.lit(0)))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = T.StructType([*[ranked.schema[c] for c in kept], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        for b in batches:
            lengths, ranks = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
            some = lengths > 0
            sequence[some], offset[some] = places.of(lengths[some], ranks[some])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.select(*kept, "rank").mapInArrow(run, schema)


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (binary) out of ``pack_documents(..., keep_ids=True)``; a sequence is bounded by the
    capacity, so its pieces fit a row."""
    pieces = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = packed.where("sequence_id >= 0").groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), pieces.alias("pieces"))
    return whole.select("sequence_id", "n_tokens", F.aggregate("pieces", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def op8_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
