"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow row mapping, input projection."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.paths import shared_folder

#: Rows and bytes of an Arrow batch handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


class Scratch:
    """Written tables that cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        tune(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        df.write.mode(mode).option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no result reads any more (all of them without names)."""
        jvm = self.spark._jvm
        for target in [self.path(n) for n in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(target)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that very long texts can't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, under fixed names: others can't clash, null texts are empty."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    fields: list[T.StructField],
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append columns computed from a text column, batch by batch and without a shuffle.

    ``make`` runs once a task and returns the function of a batch's texts; ``keep`` names the input columns that
    stay (all by default).  New columns replace input columns of the same name.
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    tune(df.sparkSession)
    source = df.select(*[df[f"`{c}`"] for c in dict.fromkeys([*kept, text_col])])
    schema = T.StructType([*[source.schema[c] for c in kept], *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                out = work(texts_of(batch.column(text_col)))
                columns = [batch.column(c) for c in kept] + [pa.array(out[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *[f.name for f in arrow]])

    return source.mapInArrow(run, schema)


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if "<" in kind else _KINDS[kind], True)


_KINDS = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
}
