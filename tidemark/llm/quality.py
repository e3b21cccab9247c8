"""Quality rules: base counts and divergence from language references.

A text's histograms over character classes and over the common words of its language are compared with those of all
texts of the language by Jensen-Shannon distance.  Short texts have histograms of chance, so each test has a length
from which it speaks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, documents, field, tune

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Share of the rows that a language needs for a reference of its own (so there are at most 1000); other rows are
#: compared with the reference of all.
LANGUAGE_SHARE = 0.001
COMMON_WORDS = 64
#: Where references go by an absolute amount: texts that speak for a language, and for the distances of a length.
LEAST_TEXTS = 100
#: Measured limits: so many deviations (by the median deviation) above the median, in steps of the distance.
DEVIATIONS, DISTANCE_STEP = 5, 0.002
#: Distances from which a text goes, and the shortest text that each test judges.
MAX_CHARS_DISTANCE, MIN_CHARS = 0.30, 200
MAX_WORDS_DISTANCE, MIN_WORDS = 0.46, 100
MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 50, 50

CLASSES = ("lower", "upper", "digit", "space", "line end", "sentence mark", "symbol", "other ASCII", "beyond ASCII")


def _class_table() -> np.ndarray:
    """Class of every UTF-8 byte; a character beyond ASCII counts by its first byte, its other bytes are class 9."""
    table = np.full(256, 7, np.uint8)
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t", 3), ("\n\r\x0b\x0c", 4), (".,;:!?'\"-()", 5), (SYMBOLS, 6)):
        table[[ord(c) for c in chars]] = k
    table[0x80:0xC0] = 9
    table[0xC0:] = 8
    return table


_CLASS = _class_table()


def class_counts(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=10)[:9]


def common_form(word: str) -> str:
    """A word as the histograms count it: lower case, without marks around it."""
    return word.lower().strip(".,;:!?'\"-()[]{}" + SYMBOLS)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, 0 to 1, of two histograms; 0 if one of them is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def against(x: np.ndarray) -> float:
        some = x > 0
        return float((x[some] * np.log2(x[some] / m[some])).sum())

    return math.sqrt(max(0.0, (against(p) + against(q)) / 2))


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < MIN_BASE_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def base_counts(text: str) -> tuple[Base, list[str]]:
    """Counts over the words ``[^\\x20\\x09-\\x0D]+`` and lines of a text, and its words."""
    words = WORD.findall(text)
    lines = text.split("\n")
    n_dup_lines = 0
    if len(lines) > 1:
        seen = Counter(lines)
        if len(seen) < len(lines):
            n_dup_lines = sum(n - 1 for line, n in seen.items() if n > 1 and WORD.search(line))
    windows = list(zip(words, words[1:], words[2:]))
    n_repeat_words = 0
    if len(set(windows)) < len(windows):
        seen_windows = Counter(windows)
        until = 0  # words before this one are counted
        for i, w in enumerate(windows):
            if seen_windows[w] > 1:
                n_repeat_words += i + 3 - max(until, i)
                until = i + 3
    return Base(len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), n_dup_lines, n_repeat_words), words


class Reference(NamedTuple):
    """Histograms of a language: classes, and counts of its common words with those of all other words at the end."""

    classes: tuple[int, ...]
    words: dict[str, int]
    counts: tuple[int, ...]
    #: (length class, limit of the word distance from this class on); without any, MAX_WORDS_DISTANCE holds.
    limits: tuple[tuple[int, float], ...] = ()

    def words_limit(self, n_words: int) -> float:
        at = length_class(n_words)
        return next((limit for k, limit in reversed(self.limits) if k <= at), MAX_WORDS_DISTANCE)


def length_class(n_words: int) -> int:
    """Half octaves of the number of words: the distance of a sample from its source falls with its size."""
    return int(2 * math.log2(max(1, n_words)))


def distances(data: bytes, words: list[str], reference: Reference) -> tuple[float, float]:
    """(distance of classes, distance of common words)."""
    own = np.zeros(len(reference.counts))
    at = reference.words
    rest = len(own) - 1
    for w, n in Counter(map(common_form, words)).items():
        own[at.get(w, rest)] += n
    return js_distance(class_counts(data), np.array(reference.classes)), js_distance(own, np.array(reference.counts))


def keeps(text: str, words: list[str], reference: Reference) -> bool:
    """Whether the divergence tests that speak of a text of this length let it pass."""
    far_chars, far_words = distances(text.encode(), words, reference)
    if len(text) >= MIN_CHARS and far_chars > MAX_CHARS_DISTANCE:
        return False
    return len(words) < MIN_WORDS or far_words <= reference.words_limit(len(words))


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_texts: int | None = None) -> dict[str | None, Reference]:
    """References of every language with ``LANGUAGE_SHARE`` of the rows, and under None of all rows: counts over all
    texts in one pass, summed by task before they are shuffled.

    With ``least_texts``, of every named language with so many texts whatever its share, some 2 KB each, and none of all
    rows: no reference speaks for the other texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    rows = _rows(docs, text_col, lang_col)
    schema = T.StructType([field("lang", "string"), field("kind", "int"), field("name", "string"), field("n", "long")])

    def count(batches):
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        texts: Counter[str] = Counter()

        def flush(last: bool):
            out = [(lang, 0, w, n) for lang, c in words.items() for w, n in c.items()]
            words.clear()
            if last:
                out += [(lang, 1, str(k), int(n)) for lang, c in classes.items() for k, n in enumerate(c)]
                out += [(lang, 2, "", n) for lang, n in texts.items()]
            for i in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 50_000], strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=schema.names)

        for b in batches:
            raw: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw.setdefault(lang, Counter()).update(WORD.findall(text))
                classes[lang] = classes.get(lang, 0) + class_counts(text.encode())
                texts[lang] += 1
            for lang, c in raw.items():
                own = words.setdefault(lang, Counter())
                for w, n in c.items():
                    own[common_form(w)] += n
            if sum(map(len, words.values())) > 200_000:
                yield from flush(False)
        yield from flush(True)

    tune(spark)
    counted = rows.mapInArrow(count, schema).groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))
    counted = scratch.write(counted, "counted")
    n_rows = counted.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    enough = F.col("n") >= F.lit(LANGUAGE_SHARE * n_rows) if least_texts is None else (F.col("n") >= least_texts) & (F.col("lang") != "")
    own = counted.join(F.broadcast(counted.where((F.col("kind") == 2) & enough).select("lang")), "lang", "left_semi")
    every = counted.groupBy("kind", "name").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "kind", "name", "n")
    both = (own.unionByName(every) if least_texts is None else own).where("kind < 2")
    totals = both.groupBy("lang", "kind").agg(F.sum("n").alias("n")).where("kind = 0").collect()
    words = both.where("kind = 0 and name <> ''")
    order = [F.desc("n"), "name"]
    some = words.withColumn("_r", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("name"), F.lit(64))).orderBy(*order))).where(F.col("_r") <= COMMON_WORDS)
    top = some.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_r") <= COMMON_WORDS)
    found: dict[str | None, Reference] = {}
    best: dict[str | None, list] = {}
    for r in top.collect():
        best.setdefault(r["lang"], []).append((r["_r"], r["name"], r["n"]))
    by_class: dict[str | None, list[int]] = {}
    for r in both.where("kind = 1").collect():
        by_class.setdefault(r["lang"], [0] * 9)[int(r["name"])] = r["n"]
    total = {r["lang"]: r["n"] for r in totals}
    for lang, classes in by_class.items():
        listed = sorted(best.get(lang, []))
        counts = [n for _, _, n in listed]
        found[lang] = Reference(tuple(classes), {w: k for k, (_, w, _) in enumerate(listed)}, (*counts, total.get(lang, 0) - sum(counts)))
    scratch.drop()
    return found or ({None: Reference((0,) * 9, {}, (0,))} if least_texts is None else {})


def measured_limits(docs: DataFrame, reference: dict[str | None, Reference], text_col: str = "text", lang_col: str = "lang", least_texts: int = LEAST_TEXTS) -> dict[str | None, Reference]:
    """The references with limits of the word distance by length, out of the distances of all texts of the language that
    pass the base counts.  A length class with fewer than ``least_texts`` takes the limit of the class below (shorter
    texts lie further off); no limit is above MAX_WORDS_DISTANCE."""
    schema = T.StructType([field("lang", "string"), field("length", "int"), field("step", "int"), field("n", "long")])

    def count(batches):
        found: Counter[tuple[str, int, int]] = Counter()
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if lang not in reference:
                    continue
                base, words = base_counts(text)
                if not base.failed and len(words) >= MIN_WORDS:
                    found[lang, length_class(len(words)), round(distances(text.encode(), words, reference[lang])[1] / DISTANCE_STEP)] += 1
        out = [(*k, n) for k, n in found.items()]
        for i in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 50_000], strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=schema.names)

    tune(docs.sparkSession)
    counted = _rows(docs, text_col, lang_col).mapInArrow(count, schema).groupBy("lang", "length", "step").agg(F.sum("n").alias("n"))
    by_length: dict[str, dict[int, list[tuple[int, int]]]] = {}
    for r in counted.collect():  # at most 1 / DISTANCE_STEP rows by language and length
        by_length.setdefault(r["lang"], {}).setdefault(r["length"], []).append((r["step"], r["n"]))

    def median(rows: list[tuple[float, int]]) -> float:
        rows = sorted(rows)
        until = np.cumsum([n for _, n in rows])
        return rows[int(np.searchsorted(until, until[-1] / 2))][0]

    def limit(rows: list[tuple[int, int]]) -> float:
        middle = median(rows)
        spread = median([(abs(s - middle), n) for s, n in rows])
        return min(MAX_WORDS_DISTANCE, DISTANCE_STEP * (middle + DEVIATIONS * 1.4826 * max(spread, 1)))

    return {
        lang: r._replace(limits=tuple((k, limit(rows)) for k, rows in sorted(by_length.get(lang, {}).items()) if sum(n for _, n in rows) >= least_texts))
        for lang, r in reference.items()
    }


FIELDS = [*[field(n, "long") for n in Base._fields], field("base_failed", "boolean"), field("kept", "boolean")]


def quality_rules(docs: DataFrame, reference: dict[str | None, Reference], text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept to every row; no shuffle.

    Null and empty texts have no words and fail.  Rows of unknown or null language are compared with the reference of
    all rows; without one the divergence tests don't speak of them.  Columns of these names are replaced, other columns may have any name; repeated rows repeat their result.
    """
    new = {f.name for f in FIELDS}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    own = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)]
    source = docs.select(*own, F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    schema = T.StructType([*[source.schema[f"c{i}"] for i in range(len(kept))], *FIELDS])
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_()]
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                base, words = base_counts(text)
                held_to = reference.get(lang) or reference.get(None)
                out.append((*base, base.failed, not base.failed and (held_to is None or keeps(text, words, held_to))))
            yield pa.RecordBatch.from_arrays([*[b.column(f"c{i}") for i in range(len(kept))], *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names=schema.names)

    made = source.mapInArrow(run, schema)
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *[f.name for f in FIELDS])


def op1_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules(docs, references(docs), keep=["doc_id"])
