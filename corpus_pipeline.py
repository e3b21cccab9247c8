"""Corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, quality, repeats, simhash, toxicity
from tidemark.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores below one half."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs.select(*COLUMNS), model, name="_score").where("_score < 0.5").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base counts and the divergence tests against references of what is left: of each language
    with enough texts, whatever its share, and with limits out of its own distances."""
    reference = quality.measured_limits(docs, quality.references(docs, least_texts=quality.LEAST_TEXTS))
    marked = quality.quality_rules(docs.select(*COLUMNS), reference)
    return marked.where("kept").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component of near copies (Jaccard similarity 0.8 of five-word shingles): the least by id (rows without id last), then by place.

    Rows are numbered and written first, so that repeated and missing ids stay rows of their own.
    """
    scratch = Scratch(spark, "groups")
    rows = scratch.write(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = simhash.near_copies(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))
    kept = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(least.alias("r")).select(F.col("r._row").alias("_row"))
    return rows.join(scratch.write(kept, "kept").hint("shuffle_hash"), "_row", "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that repeat in what is left; ``n_chars`` is counted anew.

    Strings of 200 bytes are looked at, as many as 50 words of three letters have, and not of op10's 400: 51 words of the
    corpus's languages have some 290 to 400 bytes.
    """
    cut = repeats.without_repeats(docs.select(*COLUMNS), repeats.PASSAGE_BYTES, over_words=repeats.PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of at most 1024 tokens; one without text left is its end token."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("simhash near-dedup", one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: Classifiers, components and tokenizers are no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
