"""Files, partitions and plans: what a table looks like and how a query runs."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_id(path: Column) -> Column:
    """D T hh : mm out of a path .../dt=D/hh=H/min5=M/...; null for other paths."""
    pattern = r"/dt=(\d{4}-\d{2}-\d{2})/hh=(\d{2})/min5=(\d{2})/"
    part = lambda k: F.regexp_extract(path, pattern, k)
    return F.when(part(1) != "", F.concat(part(1), F.lit("T"), part(2), F.lit(":"), part(3)))


def with_audit_columns(rows: DataFrame, in_batches: bool = True) -> DataFrame:
    """Add the source file, the micro-batch (where files lie in batches), and when the row was read."""
    columns = {"_src_file": F.col("_metadata.file_path"), "_src_bytes": F.col("_metadata.file_size"), "_ingested_at": F.current_timestamp(), "ingest_date": F.current_date()}
    if in_batches:
        columns["_batch_id"] = batch_id(F.col("_metadata.file_path"))
    return rows.withColumns(columns)


def day_probe(rows: DataFrame, time_column: str, day: int) -> DataFrame:
    """Rows of the day number ``day`` of the table (0 is the first); the bounds are scalar subqueries."""
    bound = lambda d: rows.select(F.date_trunc("day", F.min(time_column)) + F.make_dt_interval(F.lit(d))).scalar()
    return rows.where((F.col(time_column) >= bound(day)) & (F.col(time_column) < bound(day + 1)))


def partition_skew(rows: DataFrame, key: str, n: int = 200, part: Column | None = None) -> DataFrame:
    """Rows of the fullest and of the median partition of a key, and their ratio; counted by partition number without
    moving the rows.  ``part`` is the partition number, by default that of Spark's hash partitioning."""
    number = F.pmod(F.hash(key), F.lit(n)) if part is None else part
    sizes = rows.groupBy(number.alias("p")).agg(F.count("*").alias("count"))
    return sizes.agg(F.max("count").alias("most"), F.percentile_approx("count", 0.5).alias("median")).withColumn("ratio", F.col("most") / F.col("median"))


def digest(rows: DataFrame) -> DataFrame:
    """Rows, and a digest of all columns that does not depend on their order."""
    return rows.agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])).alias("digest"))


def physical_plan(rows: DataFrame) -> str:
    return rows._jdf.queryExecution().explainString(rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def plan_operators(plan: str, pattern: str = r"\w*Join\w*") -> list[str]:
    """Operators of a formatted plan that match, each once, in order."""
    found = re.findall(rf"\(\d+\)\s+({pattern})|[+\-:\s]*(?:\* )?({pattern})\s+\(\d+\)", plan)
    return list(dict.fromkeys(a or b for a, b in found))


def timed(rows: DataFrame) -> float:
    """Seconds to compute every column of every row."""
    start = time.perf_counter()
    rows.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def root_estimate(rows: DataFrame) -> dict[str, int | None]:
    """What the optimizer expects of a query's root: bytes, and rows where statistics tell."""
    stats = rows._jdf.queryExecution().optimizedPlan().stats()
    count = stats.rowCount()
    return {"bytes": int(str(stats.sizeInBytes())), "rows": int(str(count.get())) if count.isDefined() else None}


def completeness(rows: DataFrame) -> DataFrame:
    """Rows, and how many files and micro-batches they came from."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("_src_file").alias("files"), F.count_distinct("_batch_id").alias("batches"))


def landing_stats(rows: DataFrame, time_column: str, path: Column) -> DataFrame:
    """First and last instant as text, rows, files, and micro-batch folders; each folder should hold one file."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    found = rows.agg(
        shown(F.min(time_column)).alias("first_event"),
        shown(F.max(time_column)).alias("last_event"),
        F.count("*").alias("n_rows"),
        F.count_distinct(path).alias("files"),
        F.count_distinct(batch_id(path)).alias("batches"),
    )
    return found.withColumn("one_file_a_batch", F.col("files") == F.col("batches"))


def same_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of each side that the other lacks, counted with repeats: both are 0 for equal bags."""
    only = lambda a, b, name: a.exceptAll(b).agg(F.count("*").alias(name))
    return only(first, second, "only_first").crossJoin(only(second, first, "only_second"))  # one row each


def file_probe(rows: DataFrame, time_column: str, day: int) -> DataFrame:
    """Files, their mean bytes, and how many files hold rows of the day number ``day``."""
    at = rows.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"), F.col(time_column).alias("t"))
    start = lambda d: rows.select(F.date_trunc("day", F.min(time_column)) + F.make_dt_interval(F.lit(d))).scalar()
    by_file = at.groupBy("f").agg(F.max("b").alias("b"), F.count_if((F.col("t") >= start(day)) & (F.col("t") < start(day + 1))).alias("n"))
    return by_file.agg(F.count("*").alias("files"), F.avg("b").cast("long").alias("mean_bytes"), F.count_if(F.col("n") > 0).alias("files_of_day"), F.sum("n").alias("rows_of_day"))
