"""Removal of repeated byte strings with distributed difference-cover suffix arrays.

Equal strings must meet before they can be sorted, and only strings that may repeat need to.  Each window of ``length``
bytes has a key that depends on its bytes alone: the least hash of the shorter strings inside it.  Consecutive windows
of one key are a run; runs whose key occurs once in the corpus can't repeat and go no further.  The texts of the other
runs are dealt by key; each task drops what no window with a shared hash covers, sorts the suffixes of the rest by the
difference-cover algorithm and compares neighbours' prefixes.  Equal run texts are one text with a count before that.  A key with more text than one array
takes is settled by digests of its windows instead, which Spark counts with partial aggregates.

Several lengths are judged in one pass: keys are those of the shortest, and a run's text reaches as far as the longest.
Texts move packed, and always through shuffles: no table is broadcast, whatever its size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.buckets import by_group, hot_keys, join_hot, whole_groups
from tidemark.llm.common import Scratch, documents, field, id_and_text, tune
from tidemark.llm.suffixes import MAX_LENGTH, repeated_starts

LENGTH = 400
#: A passage is a repeated string of over ``PASSAGE_WORDS`` words; strings from ``PASSAGE_BYTES`` on are looked at, the
#: length of as many words of three letters.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200
#: Text that one suffix array takes at most, and that a task gathers for one.
ARRAY_BYTES, BLOCK_BYTES = 1_900_000, 1_000_000
#: Windows of a text handled at once.
SLICE = 1 << 20


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """least of every ``width`` consecutive values."""
    out, have = values, 1
    while 2 * have <= width:
        out = least(out[:-have], out[have:])
        have *= 2
    n = len(values) - width + 1
    return least(out[:n], out[width - have : width - have + n])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash of every ``gram`` consecutive bytes; ``gram`` is a power of two."""
    h, have, power = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while have < gram:
        h = h[:-have] * np.uint64(power) + h[have:]
        power, have = power * power % (1 << 64), 2 * have
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return h


def window_runs(data: bytes, length: int = LENGTH) -> list[tuple[int, int, int, bool]]:
    """(key, first window, windows, whether its key stands at two places) of each run of windows of one key."""
    gram = 1 << max(0, (length // 3).bit_length() - 1)
    width, runs = length - gram + 1, []
    for at in range(0, len(data) - length + 1, SLICE):
        part = np.frombuffer(data, np.uint8, min(SLICE + length - 1, len(data) - at), at)
        h = gram_hashes(part, gram)
        key = _sliding(h, width, np.minimum)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        # Places of keys: hashes that are the least of some window around them.
        edge = np.zeros(width - 1, np.uint64)
        places = h[h == _sliding(np.concatenate((edge, key, edge)), width, np.maximum)]
        values, count = np.unique(places, return_counts=True)
        twice = np.isin(key[first], values[count > 1])
        runs += zip(key[first].view(np.int64).tolist(), (first + at).tolist(), np.diff(np.append(first, len(key))).tolist(), twice.tolist(), strict=True)
    return runs


def _packed(rows: DataFrame) -> DataFrame:
    """The rows with ``text`` as compressed bytes, for a shuffle."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in rows.schema.fields])

    def work(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts = pa.array([pack((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if n == "text" else b.column(n) for n in schema.names], names=schema.names)

    tune(rows.sparkSession)
    return rows.mapInArrow(work, schema)


def _unpacked(column: pa.Array) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) for t in column.to_pylist()]


def _scan(rows: DataFrame, length: int) -> DataFrame:
    run = T.StructType([T.StructField("key", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("twice", T.BooleanType())])
    schema = T.StructType([rows.schema["doc_id"], T.StructField("digest", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("runs", T.ArrayType(run))])
    kind = pa.list_(pa.struct([("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("twice", pa.bool_())]))
    tune(rows.sparkSession)

    def work(batches):
        for b in batches:
            data = [t.encode() for t in b.column("text").to_pylist()]
            runs = [[dict(zip(("key", "start", "n", "twice"), r, strict=True)) for r in window_runs(d, length)] for d in data]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array([len(d) for d in data], pa.int64()), pa.array(runs, kind)], names=schema.names)

    return rows.mapInArrow(work, schema)


def _run_texts(carriers: DataFrame, reach: int) -> DataFrame:
    """A row for each candidate run: text_id, start, n, key, text_key (digest of the run's text) and the text, which goes on
    for ``reach`` bytes from the last window's start where its document does."""
    schema = T.StructType([T.StructField("text_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("text_key", T.BinaryType()), T.StructField("run_text", T.BinaryType())])

    def work(batches):
        for b in batches:
            out, held = [], 0
            for text_id, data, runs in zip(b.column("text_id").to_pylist(), _unpacked(b.column("text")), b.column("runs").to_pylist(), strict=True):
                for r in runs:
                    own = data[r["start"] : r["start"] + r["n"] + reach - 1]
                    out.append((text_id, r["start"], r["n"], r["key"], hashlib.blake2b(own, digest_size=16).digest(), own))
                    held += len(own)
                    if held > 4 << 20:
                        yield batch_of(out)
                        out, held = [], 0
            if out:
                yield batch_of(out)

    def batch_of(out):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    return carriers.select("text_id", "text", "runs").mapInArrow(work, schema)


MARKS = T.StructType([T.StructField("text_key", T.BinaryType()), T.StructField("windows", T.ArrayType(T.BinaryType()))])


def _intervals(flags: np.ndarray) -> bytes:
    """Runs of true flags as pairs of 32-bit integers [from, to)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.astype("<i4").tobytes()


def _by_suffix_arrays(texts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Marks of repeated windows, by length, in run texts whose keys fit an array."""

    def work(batches):
        for table, ends in whole_groups(batches, ["key"]):
            keys, data, n = (table.column(c).to_pylist() for c in ("text_key", "run_text", "n"))
            group: list[int] = []
            held = 0
            for s, e in zip(ends, ends[1:]):
                size = sum(len(data[i]) + 1 for i in range(s, e))
                if group and held + size > BLOCK_BYTES:
                    yield from marked(keys, data, n, group)
                    group, held = [], 0
                group += range(s, e)
                held += size
            if group:
                yield from marked(keys, data, n, group)

    def marked(keys, data, windows, group):
        sizes = np.array([len(data[i]) for i in group])
        text = np.frombuffer(b"".join([data[i] for i in group]), np.uint8).astype(np.int64) + 2
        begins = np.cumsum(sizes + 1) - sizes - 1
        whole = np.ones(int(sizes.sum() + len(sizes)), np.int64)  # 1 parts the texts
        inside = np.ones(len(whole), bool)
        inside[begins + sizes] = False
        whole[inside] = text
        n = np.array([windows[i] for i in group])
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        starts, room = np.repeat(begins, n) + offset, np.repeat(sizes, n) - offset
        flags = repeated_starts(whole, starts, room, lengths)
        ends = np.cumsum(n).tolist()
        out = [(keys[i], [_intervals(f[e - k : e]) for f in flags]) for i, e, k in zip(group, ends, n.tolist(), strict=True)]
        out = [o for o in out if any(o[1])]
        if out:
            keys_out, windows_out = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys_out, pa.binary()), pa.array(windows_out, pa.list_(pa.binary()))], names=MARKS.names)

    return by_group(texts.select("key", "text_key", "n", "run_text"), ["key"]).mapInArrow(work, MARKS)


def _by_window_digests(texts: DataFrame, lengths: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """The same marks without gathering a key's texts: every window's 128-bit digest, counted."""
    schema = T.StructType([T.StructField("text_key", T.BinaryType()), T.StructField("kind", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("window", T.BinaryType())])

    def work(batches):
        from hashlib import blake2b

        for b in batches:
            for key, data, windows in zip(*[b.column(c).to_pylist() for c in ("text_key", "run_text", "n")], strict=True):
                for kind, length in enumerate(lengths):
                    n = min(windows, len(data) - length + 1)
                    for i in range(0, n, 50_000):
                        at = range(i, min(n, i + 50_000))
                        found = pa.array([blake2b(data[k : k + length], digest_size=16).digest() for k in at], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.binary()), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int32()), found], names=schema.names)

    windows = scratch.write(texts.select("text_key", "n", "run_text").mapInArrow(work, schema), "windows")
    repeated = windows.groupBy("kind", "window").agg(F.count("*").alias("_n")).where("_n > 1").select("kind", "window")
    hits = windows.join(scratch.write(repeated, "repeated"), ["kind", "window"], "left_semi")
    gathered = hits.groupBy("text_key").agg(F.collect_list(F.struct("kind", "at")).alias("hits"))  # at most one text's windows

    def joined(batches):
        for b in batches:
            marks = []
            for found in b.column("hits").to_pylist():
                own = []
                for kind in range(len(lengths)):
                    at = [h["at"] for h in found if h["kind"] == kind]
                    flags = np.zeros(max(at, default=-1) + 1, bool)
                    flags[at] = True
                    own.append(_intervals(flags))
                marks.append(own)
            yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(marks, pa.list_(pa.binary()))], names=MARKS.names)

    return gathered.mapInArrow(joined, MARKS)


def repeated_parts(rows: DataFrame, lengths: tuple[int, ...], scratch: Scratch, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """(digest, copied, spans) of every distinct text that holds a repeated string: whether all of it is there twice, and
    for each of ``lengths`` (ascending) the byte ranges that repeated strings of so many bytes cover (pairs of 32-bit
    integers).  ``rows`` has doc_id, text and digest."""
    if array_bytes > MAX_LENGTH or list(lengths) != sorted(lengths):
        raise ValueError("array_bytes, lengths")
    least, reach = lengths[0], lengths[-1]
    scanned = scratch.write(_scan(rows, least), "scanned")
    texts = scanned.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("carrier"), F.first("n_bytes").alias("n_bytes"), F.first("runs").alias("runs"))
    texts = scratch.write(texts.withColumn("text_id", F.monotonically_increasing_id()), "texts")
    scratch.drop("scanned")
    runs = texts.select("text_id", F.explode("runs").alias("r")).select("text_id", "r.*")
    keys = runs.groupBy("key").agg(F.count("*").alias("_n"), F.max("twice").alias("_t")).where("_n > 1 or _t").select("key", "_n")
    keys = scratch.write(keys, "keys")
    wanted = join_hot(runs, keys.select("key"), "key", hot_keys(keys, "key", "_n", scratch, "hot-keys"), "text_id").groupBy("text_id").agg(F.collect_list(F.struct("key", "start", "n")).alias("runs"))
    wanted = scratch.write(wanted.join(texts.select("text_id", F.col("digest").alias("of"), "carrier"), "text_id"), "wanted")
    carriers = _packed(rows).join(wanted.hint("shuffle_hash"), (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("carrier")))
    found = scratch.write(_run_texts(carriers, reach), "found")
    owners = scratch.write(found.select("text_id", "start", "n", "text_key").distinct(), "owners")
    counts = scratch.write(owners.groupBy("text_key").agg(F.count("*").alias("owners")), "counts")
    distinct = found.groupBy("text_key", "key").agg(F.first("n").alias("n"), F.first("run_text").alias("run_text"))
    distinct = scratch.write(distinct.join(counts, "text_key"), "distinct")
    scratch.drop("found", "wanted", "keys")
    sizes = distinct.groupBy("key").agg(F.sum(F.octet_length("run_text") + 1).alias("_b"), F.count("*").alias("_n"), F.max("owners").alias("_o"))
    sizes = scratch.write(sizes, "sizes")
    large = sizes.where(F.col("_b") > array_bytes).select("key")
    settled = sizes.where("_n = 1 and _o > 1").select("key")  # the one text of its key repeats as a whole
    rest = distinct.join(settled, "key", "left_anti")
    if large.isEmpty():
        marks = _by_suffix_arrays(rest, lengths)
    else:
        marks = _by_suffix_arrays(rest.join(large, "key", "left_anti"), lengths)
        marks = marks.unionByName(_by_window_digests(distinct.join(large, "key", "left_semi"), lengths, scratch))
    copied = distinct.where("owners > 1").select("text_key", F.array(*[_full_marks(F.least("n", F.octet_length("run_text") - length + 1)) for length in lengths]).alias("windows"))
    marks = scratch.write(marks.unionByName(copied), "marks")
    hot = hot_keys(counts, "text_key", "owners", scratch, "hot-texts")
    spans = join_hot(owners, marks, "text_key", hot, "text_id").groupBy("text_id").agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= least)
    parts = texts.select("text_id", "digest", "n_bytes", whole.alias("copied")).join(spans, "text_id", "left").where("copied or found is not null")
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("copied", T.BooleanType()), T.StructField("spans", T.ArrayType(T.BinaryType()))])

    def merged(batches):
        for b in batches:
            out = []
            for found, copied, n_bytes in zip(*[b.column(c).to_pylist() for c in ("found", "copied", "n_bytes")], strict=True):
                own = []
                for k, length in enumerate(lengths):
                    ranges = [np.frombuffer(f["windows"][k], "<i4").reshape(-1, 2) + f["start"] for f in found or [] if f["windows"][k]]
                    if copied and n_bytes >= length:
                        ranges = [np.array([[0, n_bytes - length + 1]])]
                    own.append(merge(np.concatenate(ranges), length).astype("<i4").tobytes() if ranges else b"")
                out.append(own)
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("copied"), pa.array(out, pa.list_(pa.binary()))], names=schema.names)

    parts = scratch.write(parts.select("digest", "copied", "found", "n_bytes").mapInArrow(merged, schema), "parts")
    scratch.drop("texts", "owners", "counts", "distinct", "sizes", "marks", "windows", "repeated", "hot-keys", "hot-texts")
    return parts


def _full_marks(n):
    """[0, n) as two little-endian 32-bit integers; nothing if n is not positive."""
    whole = F.concat(F.lit("00000000"), *[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)])
    return F.unhex(F.when(n > 0, whole).otherwise(F.lit("")))


def merge(windows: np.ndarray, length: int) -> np.ndarray:
    """Byte ranges that windows starting in [from, to) cover; touching ranges are one."""
    windows = windows[np.argsort(windows[:, 0], kind="stable")]
    begin, end = windows[:, 0], np.maximum.accumulate(windows[:, 1] + length - 1)
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return np.stack((begin[first], end[np.append(first[1:], len(end)) - 1]), 1)


def _with_parts(packed: DataFrame, parts: DataFrame) -> DataFrame:
    return packed.join(parts.withColumnRenamed("digest", "_of").hint("shuffle_merge"), F.col("digest") == F.col("_of"), "left")


def _ranges(spans: list[bytes] | None, k: int) -> list[list[int]]:
    return np.frombuffer(spans[k], "<i4").reshape(-1, 2).tolist() if spans else []


def _cut(data: bytes, ranges: list[list[int]]) -> list[bytes]:
    """What is left without the ranges."""
    kept, at = [], 0
    for s, e in ranges:
        kept.append(data[at:s])
        at = e
    return [*kept, data[at:]]


def _passages(data: bytes, ranges: list[list[int]], words: int = PASSAGE_WORDS) -> list[list[int]]:
    """The ranges that hold over ``words`` whole words: a word that a range cuts does not count, nor is it in the range."""
    found = []
    for s, e in ranges:
        while 0 < s < e and data[s - 1 : s] not in _BLANKS and data[s : s + 1] not in _BLANKS:
            s += 1
        while s < e < len(data) and data[e : e + 1] not in _BLANKS and data[e - 1 : e] not in _BLANKS:
            e -= 1
        if len(data[s:e].split()) > words:
            found.append([s, e])
    return found


_BLANKS = {bytes([c]) for c in (9, 10, 11, 12, 13, 32)}


def repeat_digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", array_bytes: int = ARRAY_BYTES, passages: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with ``passages`` the bytes of repeated passages
    of over 50 words, whatever their length in bytes from 200 on (n_passage_bytes; it removes nothing).

    A byte goes if a ``length``-byte string over it starts anywhere else, in this or another row; strings are judged on
    the input.  Null texts are empty; texts shorter than ``length`` stay whole.  Repeated rows are texts of their own,
    so equal texts of at least ``length`` bytes go whole.  Null ids stay rows.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = id_and_text(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2("text", 256)))
    lengths = (PASSAGE_BYTES, length) if passages and length > PASSAGE_BYTES else (length,)
    parts = repeated_parts(rows, lengths, scratch, array_bytes)
    more = ["n_passage_bytes"] if len(lengths) > 1 else []
    schema = T.StructType([rows.schema["doc_id"], *[field(c, "long") for c in ("n_bytes", "n_removed", "n_spans")], field("kept_sha256", "string"), *[field(c, "long") for c in more]])

    def work(batches):
        for b in batches:
            out = []
            for data, spans in zip(_unpacked(b.column("text")), b.column("spans").to_pylist(), strict=True):
                ranges = _ranges(spans, len(lengths) - 1)
                row = (len(data), sum(e - s for s, e in ranges), len(ranges), hashlib.sha256(b"".join(_cut(data, ranges))).hexdigest())
                out.append((*row, *[sum(e - s for s, e in _passages(data, _ranges(spans, 0))) for _ in more]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * len(more))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names=schema.names)

    return _with_parts(_packed(rows), parts).select("doc_id", "text", "spans").mapInArrow(work, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", over_words: int = 0) -> DataFrame:
    """All columns of ``docs``, the repeated bytes gone from the text; a character goes only if all its bytes do.  With
    ``over_words`` only ranges of more words than that go, and only whole words.

    Null texts stay null.  Other columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    names = docs.columns
    text = docs[text_col]
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in names if c != text_col], text.isNull().alias("_null")).alias("row"), docs[id_col].alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    held = held.withColumn("digest", F.unhex(F.sha2("text", 256)))
    parts = repeated_parts(held.select("doc_id", "text", "digest"), (length,), scratch)
    joined = _with_parts(_packed(held), parts)
    plain = [c for c in names if c != text_col]
    flat = joined.select(*[F.col("row").getItem(c).alias(f"c{i}") for i, c in enumerate(plain)], F.col("row").getItem("_null").alias("null"), "text", "spans")
    schema = T.StructType([*[flat.schema[f"c{i}"] for i in range(len(plain))], field("text", "string")])

    def work(batches):
        for b in batches:
            out = []
            for data, null, spans in zip(_unpacked(b.column("text")), b.column("null").to_pylist(), b.column("spans").to_pylist(), strict=True):
                ranges = _ranges(spans, 0)
                if over_words:
                    ranges = _passages(data, ranges, over_words)
                out.append(None if null else b"".join(_cut(data, [_to_borders(data, s, e) for s, e in ranges])).decode())
            yield pa.RecordBatch.from_arrays([*[b.column(f"c{i}") for i in range(len(plain))], pa.array(out, pa.string())], names=schema.names)

    cut = flat.mapInArrow(work, schema)
    at = {c: f"c{i}" for i, c in enumerate(plain)} | {text_col: "text"}
    return cut.select(*[F.col(at[c]).alias(c) for c in names])


def _to_borders(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The range without characters that it covers in part."""
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while start < end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir))
