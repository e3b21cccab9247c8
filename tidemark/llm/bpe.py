"""Byte-level BPE by corpus-level merge replay.

Three passes.  The first cuts every text into pattern matches and numbers the distinct ones of a chunk of texts; only
numbers stay of the texts.  The second brings each distinct match of the corpus to one bucket and replays the merges
there: all of a bucket's matches are laid out in one flat array of bytes, an inverted index maps each pair that the ranks
know to the positions where it stands, pairs are taken in rank order off a heap, every merge touches only the two
neighbouring pairs, and a merge that makes a pair of lower rank puts the rest of its own rank back.  That is the order in
which the byte-pair library merges each match by itself.  The third meets a chunk's numbers with their ids again.

What moves between passes are packed blocks, one for each chunk and bucket: distinct matches, their ids, and the numbers
of a chunk's texts.  A chunk and a batch of blocks are bounded whatever the corpus holds.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, documents, field, id_and_text, map_rows, tune
from tidemark.llm.segments import WholeTexts, vocabulary_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct matches and pairs that a worker remembers, in each of two generations.
REMEMBERED, PAIRS = 250_000, 400_000


@dataclass(frozen=True)
class Bounds:
    """A chunk of texts ends with so many distinct matches or characters of text, a block with so many matches or texts."""

    matches: int = 400_000
    text: int = 48 << 20
    block: int = 1_000_000
    texts: int = 10_000


class MergeReplay:
    """Encoder and decoder for a file of base64 tokens and ranks; the token's id is its rank."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.byte_array = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.byte_pairs = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        self.seen: dict[str, list[int]] = {}
        self.seen_before: dict[str, list[int]] = {}
        self.matches = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.pair_rank: dict[int, int] = {}
        self.table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _rank(self, left: int, right: int) -> int:
        """Rank of the pair's bytes, -1 without one."""
        key = left << 32 | right
        rank = self.pair_rank.get(key)
        if rank is None:
            rank = self.pair_rank[key] = self.ranks.get(self.token[left] + self.token[right], -1)
        return rank

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """ids of every word."""
        if len(self.pair_rank) > PAIRS:  # the older half goes
            for key in list(islice(self.pair_rank, len(self.pair_rank) // 2)):
                del self.pair_rank[key]
        whole = self.ranks
        out: list[list[int] | None] = [None] * len(words)
        open_words = []
        for i, w in enumerate(words):
            if (rank := whole.get(w)) is not None:
                out[i] = [rank]
            else:
                open_words.append(i)
        if not open_words:
            return out  # type: ignore[return-value]
        # One flat row of byte tokens; a word ends in a border, whose pairs have no rank.
        lengths = np.array([len(words[i]) + 1 for i in open_words])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        flat = np.frombuffer(b"\0".join([words[i] for i in open_words]) + b"\0", np.uint8)
        borders = starts + lengths - 1
        first = self.byte_pairs[flat[:-1], flat[1:]]
        first[borders[:-1]] = -1
        first[borders - 1] = -1
        tokens = self.byte_array[flat]
        tokens[borders] = -1
        ids, pair = tokens.tolist(), [*first.tolist(), -1]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        ranked = first[order]
        heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(order) else np.array([], int)
        places = {int(ranked[h]): part.tolist() for h, part in zip(heads, np.split(order, heads[1:]), strict=True)} if len(order) else {}
        heap = list(places)
        heapify(heap)
        rank_of, known = self._rank, self.pair_rank.get
        while heap:
            rank = heappop(heap)
            spots = places.pop(rank, None)
            if spots is None:
                continue
            spots.sort()
            base = rank << 32
            for k, p in enumerate(spots):
                if pair[p] != rank:
                    continue  # a neighbour's merge has changed it
                q = after[p]
                r = after[q]
                ids[p] = rank
                after[p] = r
                before[r] = p
                pair[q] = -1
                lowest = rank
                right = ids[r]
                if right >= 0:
                    new = known(base | right)
                    if new is None:
                        new = rank_of(rank, right)
                    pair[p] = new
                    if new >= 0:
                        if new in places:
                            places[new].append(p)
                        else:
                            places[new] = [p]
                            heappush(heap, new)
                        if new < lowest:
                            lowest = new
                else:
                    pair[p] = -1
                o = before[p]
                if o >= 0 and (left := ids[o]) >= 0:
                    new = known(left << 32 | rank)
                    if new is None:
                        new = rank_of(left, rank)
                    pair[o] = new
                    if new >= 0:
                        if new in places:
                            places[new].append(o)
                        else:
                            places[new] = [o]
                            heappush(heap, new)
                        if new < lowest:
                            lowest = new
                if lowest < rank:  # the lower pair goes first, then the rest of this rank
                    if k + 1 < len(spots):
                        if rank not in places:
                            heappush(heap, rank)
                        places[rank] = spots[k + 1 :] + places.get(rank, [])
                    break
        for i, p in zip(open_words, starts.tolist(), strict=True):
            got = []
            while (token := ids[p]) >= 0:
                got.append(token)
                p = after[p]
            out[i] = got
        return out  # type: ignore[return-value]

    def ids_of(self, words: set[str]) -> dict[str, list[int]]:
        """ids of distinct matches, those not remembered replayed together.  When the young generation is full it becomes
        the old one, so matches that come again stay."""
        found, missing = {}, []
        for w in words:
            got = self.seen.get(w) or self.seen_before.get(w)
            if got is None:
                missing.append(w)
            else:
                found[w] = self.seen[w] = got
        for i in range(0, len(missing), 50_000):
            part = missing[i : i + 50_000]
            for w, ids in zip(part, self.replay([w.encode() for w in part]), strict=True):
                found[w] = self.seen[w] = ids
        if len(self.seen) > REMEMBERED:
            self.seen_before, self.seen = self.seen, {}
        return found

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """ids of texts, their distinct matches replayed together."""
        cut = [self.matches(t) for t in texts]
        ids = self.ids_of({m for c in cut for m in c})
        return [[x for m in c for x in ids[m]] for c in cut]

    def byte_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of each token, first of them, all tokens' bytes in a row)."""
        if self.table is None:
            lengths = np.array([len(t) for t in self.token], np.int64)
            self.table = lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(self.token), np.uint8)
        return self.table

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_LOADED: dict[str, MergeReplay] = {}


def merge_replay(vocabulary: str = VOCABULARY) -> MergeReplay:
    """A worker's replay, kept for its next task."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = MergeReplay(vocabulary_path(vocabulary))
    return _LOADED[vocabulary]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``token_ids`` (binary, little-endian unsigned 32-bit) to every row batch by batch, without a shuffle: for tables
    too small to gain from the corpus-level passes of ``corpus_ids``.

    Null and empty texts give no ids.  Rows are independent: repeated rows repeat their result.
    """

    def make():
        encoder = WholeTexts(merge_replay(vocabulary).encode_many)
        return lambda texts: {"token_ids": encoder.encode(texts)}

    return map_rows(docs, make, [field("token_ids", "binary")], text_col, keep)


# ---------------------------------------------------------------- blocks


def _coded(values: np.ndarray) -> bytes:
    """Numbers from 0 as a count, the bits that each needs (one byte, which packs well), and what stands below each one's
    leading bit, bit by bit: numbers by frequency take little more than their entropy."""
    v = np.asarray(values, np.int64) + 1
    size = np.frexp(v.astype(np.float64))[1].astype(np.uint8)
    out = [len(v).to_bytes(8, "little"), size.tobytes()]
    for k in range(2, int(size.max(initial=0)) + 1):
        below = v[size == k] - (1 << (k - 1))
        out.append(np.packbits((below[:, None] >> np.arange(k - 1) & 1).astype(np.uint8)).tobytes())
    return b"".join(out)


def _decoded(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The numbers at a place, and the place behind them."""
    n = int.from_bytes(raw[at : at + 8], "little")
    size = np.frombuffer(raw, np.uint8, n, at + 8)
    at += 8 + n
    v = np.zeros(n, np.int64)
    for k in range(2, int(size.max(initial=0)) + 1):
        own = np.flatnonzero(size == k)
        length = (len(own) * (k - 1) + 7) // 8
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, length, at), count=len(own) * (k - 1)).reshape(-1, k - 1)
        v[own] = (1 << (k - 1)) - 1 + bits @ (1 << np.arange(k - 1))
        at += length
    return v, at


def _pack(*arrays: np.ndarray, tail: bytes = b"", level: int = 6) -> bytes:
    """Arrays of numbers, and bytes behind them, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(b"".join(map(_coded, arrays)) + tail)


def _unpack(block: bytes, arrays: int) -> tuple[list[np.ndarray], bytes]:
    import zstandard

    raw, at, found = zstandard.ZstdDecompressor().decompress(block), 0, []
    for _ in range(arrays):
        values, at = _decoded(raw, at)
        found.append(values)
    return found, raw[at:]


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=0)


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The pieces flat[starts[i] : starts[i] + lengths[i]] of every i in ``pick``, in a row."""
    n = lengths[pick]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[pick] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class _Numbers(dict):
    """Numbers distinct keys from 0 in the order they are asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _blocks_schema(id_field: T.StructField) -> T.StructType:
    ids = T.ArrayType(id_field.dataType)
    return T.StructType([T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("block", T.BinaryType()), T.StructField("doc_ids", ids)])


def _matches(rows: DataFrame, vocabulary: str, buckets: int, bounds: Bounds) -> DataFrame:
    """Blocks of every chunk of texts: its distinct matches by bucket, and its texts as numbers of matches (bucket -1)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _blocks_schema(rows.schema["doc_id"])
    arrow = to_arrow_schema(schema)

    def cut(batches):
        from pyspark import TaskContext

        matches = merge_replay(vocabulary).matches
        chunk = TaskContext.get().partitionId() << 32
        numbers, size, ids, texts = _Numbers(), 0, [], []

        def row(bucket, block, of=None):
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((chunk, bucket, block, of), arrow, strict=True)], schema=arrow)

        def blocks():
            """All of the chunk, its matches numbered anew from the most frequent down."""
            every = np.concatenate([*texts, np.array([], np.uint32)])
            order = np.argsort(-np.bincount(every, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            lengths = np.array([len(t) for t in texts])
            ends = np.cumsum(lengths)
            part = np.maximum(ends // bounds.block, np.arange(len(ends)) // bounds.texts) if len(ends) else ends
            part = np.maximum.accumulate(part)
            for own in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(part)) + 1):
                first, last = own[0], own[-1]
                yield row(-1, _pack(lengths[own], rank[every[ends[first] - lengths[first] : ends[last]]]), ids[first : last + 1])
            words = [w.encode() for w in numbers]
            words = [words[i] for i in order.tolist()]
            bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            for own in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1) if len(words) else ():
                parts = [words[i] for i in own.tolist()]
                yield row(int(bucket[own[0]]), _pack(_gaps(own), np.array([len(w) for w in parts]), tail=b"".join(parts), level=12))

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = matches(text or "")
                texts.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                ids.append(doc_id)
                size += len(text or "")
                if len(numbers) >= bounds.matches or size >= bounds.text:
                    yield from blocks()
                    chunk, numbers, size, ids, texts = chunk + 1, _Numbers(), 0, [], []
        if ids:
            yield from blocks()

    return rows.mapInArrow(cut, schema)


def _replayed(words: DataFrame, vocabulary: str, buckets: int) -> DataFrame:
    """Blocks of ids for blocks of distinct matches; blocks of a bucket come one after the other."""

    def work(batches):
        replay = merge_replay(vocabulary)
        for b in batches:
            read, every = [], set()
            for block in b.column("block").to_pylist():
                (gaps, lengths), raw = _unpack(block, 2)
                ends = np.cumsum(lengths)
                own = [raw[e - n : e].decode() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                read.append((gaps, own))
                every.update(own)
            ids = replay.ids_of(every)
            out = []
            for gaps, own in read:
                got = [ids[w] for w in own]
                out.append(_pack(gaps, np.array([len(g) for g in got]), np.array([x for g in got for x in g], np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "block"])

    placed = words.select("chunk", "bucket", "block").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(work, "chunk long, block binary")


def corpus_ids(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, buckets: int | None = None, bounds: Bounds = Bounds()) -> DataFrame:
    """(doc_id, token_ids) of every row by the corpus-level replay; with ``digests`` instead of the ids their number, their
    SHA-256 and that of the decoded bytes (n_tokens, ids_sha256, decoded_sha256).

    Null and empty texts have no ids.  Rows are independent: repeated rows and null ids stay rows of their own.  No special
    token is ever made.  ``buckets`` and ``bounds`` change no result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "replay")
    tune(spark)
    rows = id_and_text(docs, id_col, text_col)
    # A third of the session's partitions: blocks hold the more matches, and pack the better, the fewer buckets there are.
    buckets = buckets or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)
    blocks = scratch.write(_matches(rows, vocabulary, buckets, bounds), "blocks")
    ids = _replayed(blocks.where("bucket >= 0"), vocabulary, buckets).select("chunk", F.lit(0).alias("kind"), "block")
    texts = blocks.where("bucket < 0").select("chunk", F.lit(1).alias("kind"), "block", "doc_ids")
    both = ids.unionByName(texts, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "kind")
    id_field = rows.schema["doc_id"]
    new = [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string")] if digests else [field("token_ids", "binary")]
    schema = T.StructType([id_field, *new])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def work(batches):
        chunk, known, table = None, [], None
        for b in batches:
            for of, kind, block, doc_ids in zip(*[b.column(c).to_pylist() for c in ("chunk", "kind", "block", "doc_ids")], strict=True):
                if of != chunk:
                    chunk, known, table = of, [], None
                if kind == 0:
                    known.append(block)
                    continue
                if table is None:
                    table, known = _table(known), []
                (lengths, numbers), _ = _unpack(block, 2)
                flat, starts, counts = table
                yield from texts_of(doc_ids, lengths, numbers, flat, starts, counts)

    def texts_of(doc_ids, lengths, numbers, flat, starts, counts):
        token_bytes, token_starts, all_bytes = merge_replay(vocabulary).byte_table()
        ends = np.cumsum(lengths)
        out = []
        held = 0
        for k, (doc_id, e, n) in enumerate(zip(doc_ids, ends.tolist(), lengths.tolist(), strict=True)):
            ids = _gather(flat, starts, counts, numbers[e - n : e])
            packed = ids.astype("<u4").tobytes()
            if digests:
                decoded = _gather(all_bytes, token_starts, token_bytes, ids)
                out.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            else:
                out.append((doc_id, packed))
                held += len(packed)
            if held > 4 << 20 or len(out) >= 1000 or k + 1 == len(doc_ids):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out, held = [], 0

    return both.mapInArrow(work, schema)


def _table(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all ids, first of each number, how many) of a chunk's matches."""
    if not blocks:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.int64)
    read = [_unpack(b, 3)[0] for b in blocks]
    number = np.concatenate([np.cumsum(gaps) for gaps, _, _ in read])
    length = np.concatenate([lengths for _, lengths, _ in read])
    flat = np.concatenate([ids for _, _, ids in read])
    starts, counts = np.empty_like(number), np.empty_like(number)
    starts[number], counts[number] = np.cumsum(length) - length, length
    return flat, starts, counts


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded`` (binary: the tokens' bytes); null ids decode to nothing."""
    kept = [c for c in (encoded.columns if keep is None else keep) if c != "decoded"]
    source = encoded.select(*[encoded[f"`{c}`"] for c in dict.fromkeys([*kept, ids_col])])
    schema = T.StructType([*[source.schema[c] for c in kept], field("decoded", "binary")])

    def run(batches):
        replay = merge_replay(vocabulary)
        for b in batches:
            decoded = [replay.decode(x or b"") for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(decoded, pa.binary())], names=[*kept, "decoded"])

    return source.mapInArrow(run, schema)


def op6_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_ids(documents(spark, sf_dir), digests=True)
