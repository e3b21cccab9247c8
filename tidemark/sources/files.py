"""Files as sources and sinks, always with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.schemas import EVENT


#: How instants are written as text: to the microsecond, which the writers' default would cut off.
INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    """Comma-separated files with a header line; the header must name the schema's columns."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def scan_json(spark: SparkSession, path: str, schema: T.StructType = EVENT, parts: tuple[str, ...] = ()) -> DataFrame:
    """Lines of JSON below a folder; ``parts`` are read from folder names as text, so that "05" stays "05"."""
    wanted = T.StructType([*schema.fields, *[T.StructField(p, T.StringType()) for p in parts]])
    return spark.read.schema(wanted).json(path).select(*wanted.names)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("timestampFormat", INSTANT).csv(path)


def write_one_parquet(rows: DataFrame, path: str) -> str:
    """A small feed as one Parquet file, and its path.  One task writes it, so it is for tables of a checked size."""
    from tidemark.sources.store import Files

    rows.coalesce(1).write.mode("overwrite").parquet(path)
    (file,) = Files(rows.sparkSession).parquet(path)
    return file


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def source_files(rows: DataFrame) -> DataFrame:
    """(file, bytes, rows) of every file that a scan reads."""
    named = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return named.groupBy("file", "bytes").agg(F.count("*").alias("n_rows"))
