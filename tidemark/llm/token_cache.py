"""Token counts through a digest cache: encode only contents that no earlier run has counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.buckets import hot_keys, join_hot
from tidemark.llm.common import Scratch, documents, field, id_and_text, map_rows
from tidemark.llm.ranks import encoder_for, ranks_are_equivalent
from tidemark.llm.segments import vocabulary_digest, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: Misses up to this size in memory are broadcast; a miss is a digest and an id.
FEW_BYTES, MISS_BYTES = 1 << 20, 100
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def read_cache(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """One row per content counted by this tokenizer version (jobs that ran at once may have stored a content twice)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    else:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return stored.where(F.col("tokenizer_digest") == tokenizer).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache_path: str, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row, through the cache table at ``cache_path``, to which misses are appended.

    Content is normalised by taking null as empty text; anything further would change counts.  Null and repeated ids
    and repeated rows keep a row each.  Each distinct content is encoded once however many rows hold it: one row by
    (content, least id) carries its text to the encoder.

    The cache is asked with digests alone.  If it knows all contents, no text is read again; a few misses (``FEW_BYTES``)
    are broadcast, so that only their texts leave the scan; beyond that texts are shuffled to their digests.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-cache")
    tokenizer = vocabulary_digest(vocabulary)
    by_ranks = ranks_are_equivalent(vocabulary_path(vocabulary))
    rows = id_and_text(docs, id_col, text_col).withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    keyed = scratch.write(rows.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")), "keyed")
    contents = scratch.write(keyed.groupBy("content_digest").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")), "contents")
    hot = hot_keys(contents, "content_digest", "rows", scratch, "hot")
    stored = read_cache(spark, cache_path, tokenizer)
    misses = contents.drop("rows").join(stored, "content_digest", "left_anti")
    misses = scratch.write(misses.withColumnRenamed("content_digest", "miss_digest"), "misses")
    n_misses = misses.count()
    if not n_misses:
        return _counts(keyed, stored, hot)
    how = "broadcast" if n_misses * MISS_BYTES <= FEW_BYTES else "shuffle_hash"
    carriers = rows.join(misses.hint(how), (F.col("content_digest") == F.col("miss_digest")) & F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi")

    def make():
        encoder = encoder_for(vocabulary, by_ranks)
        width = 4

        def work(texts: list[str]) -> dict[str, list]:
            return {"n_tokens": [len(p) // width for p in encoder.encode(texts)]}

        return work

    counted = map_rows(carriers, make, [field("n_tokens", "long")], keep=["content_digest"]).dropDuplicates(["content_digest"])
    counted.select("content_digest", F.lit(tokenizer).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache_path)
    return _counts(keyed, read_cache(spark, cache_path, tokenizer), hot)


def _counts(keyed: DataFrame, known: DataFrame, hot: DataFrame) -> DataFrame:
    return join_hot(keyed, known, "content_digest", hot, "doc_id", "left").select("doc_id", "n_bytes", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    """Every run starts with a cache of its own, so that it counts all it is given."""
    cache = Scratch(spark, "counts").path("cache")
    counted = count_tokens(documents(spark, sf_dir), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
