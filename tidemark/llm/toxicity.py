"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on what toxic text holds beyond that.  A window of
words is compressed once with the ordinary dictionary and once with both; the bytes that the toxic dictionary saves
are the window's signal, and a logistic curve over a text's windows, fitted on labelled texts, is its score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, field, id_and_text, map_rows, tune

#: The bounded sample that a model is fitted on: texts of each label, and the longest text of it.
TOXIC_SAMPLE, ORDINARY_SAMPLE, LONGEST = 1500, 3000, 20_000
WINDOW_WORDS, GRAMS, LEVEL = 24, (5, 6, 7, 8), 6
ORDINARY_BYTES, TOXIC_BYTES = 131_072, 1024
#: Nats of evidence (a Chernoff bound against chance) that a beginning of words needs to count as toxic.
EVIDENCE = 11.0


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def windows(text: str, words: int = WINDOW_WORDS) -> list[bytes]:
    """The whole text in windows of ``words`` words."""
    parts = text.lower().split()
    return [f" {' '.join(parts[i : i + words])} ".encode() for i in range(0, len(parts), words)]


def _beginnings(text: str) -> dict[str, int]:
    """The beginnings of a text's words, by ``GRAMS`` characters with the blank before, and where each stands first."""
    found: dict[str, int] = {}
    at = 0
    for word in text.split(" "):
        for n in GRAMS:
            if len(word) >= n - 1:
                found.setdefault(f" {word[: n - 1]}", at)
        at += len(word) + 1
    return found


def _evidence(toxic: int, ordinary: int, share: float) -> float:
    """Chernoff bound on the chance that ``toxic`` of the occurrences fall into the toxic share of the sample."""
    n = toxic + ordinary
    q = toxic / n
    if q <= share:
        return 0.0
    return n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))


def toxic_parts(toxic: list[str], ordinary: list[str]) -> Counter[str]:
    """Beginnings of words that stand in toxic texts far more often than chance, by the texts of the longest of each
    word.  Texts in which a beginning first stands in one context count once, so copies of a text are no evidence."""
    chars = [sum(map(len, t)) for t in (toxic, ordinary)]
    share = max((chars[0] + 1) / (sum(chars) + 2), (len(toxic) + 1) / (len(toxic) + len(ordinary) + 2))
    first: list[dict[str, set[int]]] = [defaultdict(set), defaultdict(set)]
    wanted: set[str] | None = None
    for texts, found in zip((toxic, ordinary), first, strict=True):
        for t in texts:
            t = plain(t)
            for g, at in _beginnings(t).items():
                if wanted is None or g in wanted:
                    found[g].add(zlib.crc32(f"{t[max(0, at - 12) : at]}|{t[at : at + 24]}".encode()))
        if wanted is None:
            wanted = {g for g, where in found.items() if len(where) >= 3}
    sure = {g for g in wanted or () if _evidence(len(first[0][g]), len(first[1].get(g, ())), share) >= EVIDENCE}
    parts: Counter[str] = Counter()
    for t in toxic:
        own = set()
        for word in plain(t).split(" "):
            longest = next((g for n in reversed(GRAMS) if len(word) >= n - 1 and (g := f" {word[: n - 1]}") in sure), None)
            if longest:
                own.add(longest)
        parts.update(own)
    return parts


def _train(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass(frozen=True)
class Model:
    """``ordinary`` and ``toxic`` are dictionaries; ``weights`` belong to the features, the last one is the bias."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def scorer(self):
        import zstandard

        def compressor(content: bytes):
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=own, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress

        if not self.ordinary or not self.toxic:
            return lambda text: _logistic(self.weights[-1])
        plain_size, both_size = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        weights = np.array(self.weights)

        def score(text: str) -> float:
            saved = [len(plain_size(w)) - len(both_size(w)) for w in windows(text)]
            return _logistic(float(features(saved) @ weights))

        score.saved = lambda text: [len(plain_size(w)) - len(both_size(w)) for w in windows(text)]
        return score


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def features(saved: list[int]) -> np.ndarray:
    """Of the bytes saved in a text's windows: the most, the mean of the two most, the mean, how many windows are clear
    and their share; and 1."""
    if not saved:
        return np.array([0, 0, 0, 0, 0, 1.0])
    s = np.sort(np.array(saved, float))[::-1]
    clear = (s >= 4).sum()
    return np.array([min(s[0], 12) / 4, min(s[:2].mean(), 12) / 4, s.mean(), math.log1p(clear), clear / len(s), 1.0])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * len(y) / 100)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """A model of two lists of texts.  Without toxic or without ordinary texts every score is the share of the former,
    within 0.001 and 0.999; without any text it is 0.001."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if not toxic or not ordinary:
        share = min(0.999, max(0.001, len(toxic) / max(1, len(toxic) + len(ordinary))))
        return Model(b"", b"", (math.log(share / (1 - share)),))
    parts = toxic_parts(toxic, ordinary)
    order = sorted(parts.items(), key=lambda p: (-p[1], p[0]))
    rng = np.random.default_rng(5)
    drawn = [p for p, n in order for _ in range(n)]
    drawn = [drawn[i] for i in rng.permutation(len(drawn))]
    toxic_samples = ["".join(drawn[i : i + 12]).encode() for i in range(0, len(drawn), 12)]
    common = [w for t in ordinary for w in windows(t)]
    common = [common[i] for i in rng.permutation(len(common))[:40_000]]
    ordinary_dictionary = _train(ORDINARY_BYTES, common)
    toxic_dictionary = _train(TOXIC_BYTES, toxic_samples) if drawn else b""
    if not toxic_dictionary or not ordinary_dictionary:
        return Model(b"", b"", (math.log(len(toxic) / len(ordinary)),))
    saved = Model(ordinary_dictionary, toxic_dictionary, (0.0,) * 6).scorer().saved
    x = np.array([features(saved(t)) for t in toxic + ordinary])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    return Model(ordinary_dictionary, toxic_dictionary, tuple(_fit(x, y).tolist()))


def held_out(doc_id):
    """Rows that no model learns from: crc32 of the id as text is a multiple of 5, and rows without id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of labelled texts outside the held-out fifth, drawn by a hash of the id.

    Ids with both labels, null labels and texts over ``LONGEST`` characters are not drawn.
    """
    tune(docs.sparkSession)
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    draw = lambda toxic, n: known.where(F.col("toxic") == toxic).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    drawn = draw(1, TOXIC_SAMPLE).unionByName(draw(0, ORDINARY_SAMPLE))  # bounded, so it may be broadcast
    rows = id_and_text(docs, id_col, text_col).where(F.length("text") <= LONGEST).join(F.broadcast(drawn.withColumnRenamed("doc_id", "of")), F.col("doc_id") == F.col("of"))
    texts = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).collect()
    texts.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in texts if r["toxic"]], [r["text"] for r in texts if not r["toxic"]])


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add ``name`` (0 to 1) to every row; no shuffle.  The whole text counts; null and empty texts get the score of a
    text without windows; columns of that name are replaced."""

    def make():
        score = model.scorer()
        return lambda texts: {name: [score(t) for t in texts]}

    return map_rows(docs, make, [field(name, "double")], text_col, keep)


def op4_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(id_and_text(docs), model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
