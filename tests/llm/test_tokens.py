"""Tokenising operators against the libraries and against brute force."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm import bpe, id_matrix, packing, token_cache  # noqa: E402
from tidemark.llm.common import Scratch  # noqa: E402
from tidemark.llm.ranks import encoder_for, ranks_are_equivalent  # noqa: E402
from tidemark.llm.segments import library_encoder, vocabulary_path  # noqa: E402

TEXTS = [
    "", " ", "plain words, and more words.", "  a  b\n\n c\t d \n", "aaaaaaaa bbbb aaaa", "\x1c \x1c!\x1c! x\x85 y", "日本語 テスト  ",
    "it's  we'll 'll '", "a<|endoftext|>b  <|endoftext|> c", "x" * 3000, "é́ ﷺ 🎉🎉 ​z", "word " * 700, "1234567890" * 300, "\n" * 50 + "end",
]
ALPHABET = st.text(st.sampled_from(list("ab 's.\n\t1é 日")), max_size=60)


def docs(spark, texts=TEXTS, clash=True):
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (None, "no id"), (2, texts[2]), (3, "again")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.withColumns({c: F.lit("x") for c in ("n_tokens", "ids", "length", "offset", "rank", "task")}) if clash else made


def reference(texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def byte_pair():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ranks_are_proven():
    assert ranks_are_equivalent(vocabulary_path("byte_bpe_50k.json"))
    assert not ranks_are_equivalent(vocabulary_path("word_bpe_49k.json"))


@pytest.mark.parametrize("by_ranks", [True, False])
def test_fast_encoders_equal_the_library(by_ranks):
    encoder = encoder_for("byte_bpe_50k.json", by_ranks)
    want = reference(TEXTS)
    for _ in range(2):  # with and without a warm cache
        assert [np.frombuffer(p, "<u4").tolist() for p in encoder.encode(TEXTS)] == want


def test_other_tokenizers_get_whole_texts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [np.frombuffer(p, "<u4").tolist() for p in library_encoder("piece_bpe_32k.model").encode(TEXTS)] == [model.encode(t) for t in TEXTS]
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert [np.frombuffer(p, "<u4").tolist() for p in library_encoder("word_bpe_49k.json").encode(TEXTS)] == [words.encode(t, add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=4))
def test_merge_replay_equals_the_library(texts):
    replay = bpe.merge_replay()
    packed = [np.array(ids, "<u4").tobytes() for ids in replay.encode_many(texts)]
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [byte_pair_cached().encode_ordinary(t) for t in texts]
    assert [replay.decode(p).decode() for p in packed] == texts


_CACHED = []


def byte_pair_cached():
    if not _CACHED:
        _CACHED.append(byte_pair())
    return _CACHED[0]


def test_replay_of_a_lower_rank_made_by_a_merge(tmp_path):
    """A merge may make a pair of lower rank; that goes before the rest of its own rank."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 300, b"cab": 301, b"bc": 302}
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    library = tiktoken.Encoding("low", pat_str=r"\w+|\W+", mergeable_ranks=ranks, special_tokens={})
    replay = bpe.MergeReplay(str(path), r"\w+|\W+")
    for text in ("abcabcab", "ababab", "cabcab", "bcabcabbc", "aabbccabc"):
        assert replay.encode_many([text])[0] == library.encode_ordinary(text)


@pytest.mark.parametrize("buckets", [None, 3])
def test_round_trip_digests(spark, buckets):
    library = byte_pair()
    rows = docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a\0b a\0b"), (7, None), (7, "x")], "doc_id long, text string"))
    got = sorted(((r.doc_id or -1), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.corpus_ids(rows, digests=True, buckets=buckets).collect())
    want = []
    for r in rows.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    encoded = bpe.corpus_ids(rows.select(F.col("doc_id").cast("string"), "text"))
    decoded = bpe.decode_documents(encoded).collect()
    assert sorted(bytes(r.decoded) for r in decoded) == sorted((r.text or "").encode() for r in rows.collect())
    encoded = bpe.encode_documents(docs(spark).select("doc_id", "text"))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in bpe.decode_documents(encoded).collect())


def test_chunks_and_blocks_are_bounded(spark):
    """Bounds given as parameters: every chunk is numbered by itself, and the ids are those of one chunk."""
    rows = docs(spark).select("doc_id", "text").coalesce(1)
    whole = {(r.doc_id, bytes(r.token_ids)) for r in bpe.corpus_ids(rows).collect()}
    cut = bpe.corpus_ids(rows, bounds=bpe.Bounds(matches=50, text=1000, block=20))
    assert {(r.doc_id, bytes(r.token_ids)) for r in cut.collect()} == whole


def test_corpus_ids_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, chunk int, block int")
    assert bpe.corpus_ids(none).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert [(r.n_tokens, r.decoded_sha256) for r in bpe.corpus_ids(blank, digests=True).collect()] == [(0, hashlib.sha256(b"").hexdigest())] * 2


def test_a_warm_cache_moves_no_text(spark):
    """Known contents are told by digests; with few misses only their texts leave the scan, and beyond that all do."""
    path = Scratch(spark, "t").path("cache")
    rows = docs(spark).select("doc_id", "text")
    first = {tuple(r) for r in token_cache.count_tokens(rows, path).collect()}
    before = spark.read.parquet(path).count()
    warm = token_cache.count_tokens(rows, path)
    assert "MapInArrow" not in warm._jdf.queryExecution().toString()
    assert {tuple(r) for r in warm.collect()} == first and spark.read.parquet(path).count() == before
    more = rows.unionByName(spark.createDataFrame([(10**6, "a new text")], "doc_id long, text string"))
    assert token_cache.count_tokens(more, path).where("doc_id = 1000000").first().n_tokens > 0
    assert spark.read.parquet(path).count() == before + 1


def test_counts_and_cache(spark):
    cache = Scratch(spark, "t").path("cache")
    rows = docs(spark)
    first = token_cache.count_tokens(rows, cache).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), n) for r, n in ((r, len(reference([r.text or ""])[0])) for r in rows.collect()))
    assert Counter(map(tuple, first)) == want
    stored = spark.read.parquet(cache)
    distinct = rows.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert stored.count() == distinct
    more = rows.select("doc_id", "text").unionByName(spark.createDataFrame([(7777, "a new text")], "doc_id long, text string"))
    assert token_cache.count_tokens(more, cache).count() == rows.count() + 1
    assert spark.read.parquet(cache).count() == distinct + 1  # one miss
    assert token_cache.count_tokens(rows.limit(0), Scratch(spark, "t").path("cache")).count() == 0


def assert_packed(rows, capacity, want):
    """Every document's pieces are its ids in order; sequences are gapless and not too long."""
    by_sequence, by_piece = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_piece[(r.doc_id, r.start)].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_packing(spark):
    rows = docs(spark)
    packed = packing.pack_documents(rows, keep_ids=True)
    want = Counter()
    total = 0
    for r in rows.collect():
        ids = [*reference([r.text or ""])[0], 2]
        total += len(ids)
        rest = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        starts = ([0] if rest else []) + list(range(rest, len(ids), 1024))
        for piece, start in enumerate(starts):
            own = ids[start : start + 1024] if start >= rest else ids[:rest]
            want[(r.doc_id, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert_packed(packed.collect(), 1024, want)
    whole = packing.assemble(packed).collect()
    assert sum(len(r.ids) // 4 for r in whole) == sum(r.n_tokens for r in whole) == total
    assert packing.pack_documents(rows.limit(0)).count() == 0


def test_last_stage_packs_documents_without_text(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.length for r in corpus_pipeline.pack(spark, docs, "").collect()}
    assert set(got) == {1, 2, 3} and got[2] == got[3] == 1


def test_few_sequences():
    rng = np.random.default_rng(1)
    for capacity, lengths in ((1024, rng.integers(1, 1025, 5000)), (100, rng.choice([34, 33, 51, 49, 7], 999)), (10, [6, 6, 4, 4, 5, 5, 3, 7]), (10, [])):
        counts = Counter(int(n) for n in lengths)
        bins = packing.plan_bins(counts, capacity)
        packed = Counter()
        for b, n in bins.items():
            assert sum(b) <= capacity
            for length in b:
                packed[length] += n
        assert packed == counts
        assert sum(bins.values()) <= sum(packing.best_fit_decreasing(counts, capacity).values())
        if capacity == 1024:  # lengths of every size leave hardly any gap
            assert sum(bins.values()) <= -(-sum(lengths) // capacity) * 1.02 + 1


def test_local_search_ends_by_itself():
    """No exchange is left, however many that takes: over 4000 here."""
    rng = np.random.default_rng(3)
    counts = Counter(rng.integers(200, 701, 20_000).tolist())
    made, exchange = [], packing._exchange
    packing._exchange = lambda *a: made.append(1) or exchange(*a)
    try:
        bins = packing.plan_bins(counts, 1024)
    finally:
        packing._exchange = exchange
    assert len(made) > 4000
    assert sum((Counter({length: n * b.count(length) for length in set(b)}) for b, n in bins.items()), Counter()) == counts
    least = sorted((b for b in bins if sum(b) < 1024), key=lambda b: (sum(b), b))
    for k, giver in enumerate(least):
        for taker in least[k:]:
            if giver != taker or bins[giver] > 1:
                assert exchange(giver, taker, 1024 - sum(taker)) is None


def test_local_search_empties_bins():
    """Exchanges alone bring a bad packing to the least number of bins, and never lower the sum of squares."""
    bad = Counter({(6, 2): 2, (4, 3): 2, (5,): 2, (7,): 1, (3,): 1, (3, 2): 2})
    good = packing.local_search(bad, 10)
    squares = lambda bins: sum(n * sum(b) ** 2 for b, n in bins.items())
    assert squares(good) >= squares(bad)
    assert sum(good.values()) == -(-sum(n * sum(b) for b, n in bad.items()) // 10)
    each = lambda bins: sum((Counter({k: c * n for k, c in Counter(b).items()}) for b, n in bins.items()), Counter())
    assert each(good) == each(bad)


def test_id_matrices(spark):
    rows = docs(spark)
    for run_tokens in (4_000_000, 1500):
        pieces = defaultdict(list)
        for r in id_matrix.pack_matrices(rows, run_tokens=run_tokens).collect():
            ids = np.frombuffer(r.input_ids, "<u2").tolist()
            assert len(ids) == 1024 and r.n_tokens == r.cu_seqlens[-1] <= 1024
            assert set(ids[r.n_tokens :]) <= {id_matrix.PAD_ID}
            positions = id_matrix.position_ids(r.position_resets, r.n_tokens)
            for s, e, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_starts):
                pieces[doc].append((start, ids[s:e]))
                assert positions[s:e].tolist() == list(range(e - s))
        want = defaultdict(list)
        for r in rows.collect():
            want[r.doc_id].append([*reference([r.text or ""])[0], id_matrix.END_ID])
        for doc, whole in want.items():
            if len(whole) == 1:
                assert [x for _, p in sorted(pieces[doc]) for x in p] == whole[0]
        assert sum(len(p) for v in pieces.values() for _, p in v) == sum(len(w) for v in want.values() for w in v)
    assert id_matrix.pack_matrices(rows.limit(0)).count() == 0
    named = rows.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    assert {x for r in id_matrix.pack_matrices(named).collect() for x in r.doc_ids if x} == {f"d{i}" for i in want if i is not None}
    with pytest.raises(ValueError):
        id_matrix.pack_matrices(rows, pad_id=70_000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_segment_tree_best_fit(lengths):
    """The tree finds what a search through all open bins finds."""
    bins, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fitting = [r for r in room if r >= lengths[i]]
        if fitting:
            b = max(k for k, r in enumerate(room) if r == min(fitting))
        else:
            b = len(bins)
            bins.append([])
            room.append(64)
        bins[b].append(i)
        room[b] -= lengths[i]
    got = id_matrix.best_fit_decreasing(lengths, 64)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 64 for b in got)
    assert len(got) == len(bins)
