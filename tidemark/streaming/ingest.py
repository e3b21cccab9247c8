"""Micro-batches of JSON files into a versioned table, each file once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.layout import batch_id
from tidemark.operators.prices import micro_batches
from tidemark.operators.quality import CLICKSTREAM, enforce
from tidemark.sources.files import INSTANT
from tidemark.sources.schemas import EVENT, RESCUED
from tidemark.sources.store import Table

BATCHES = ("dt", "hh", "min5")


def land(events: DataFrame, path: str, minutes: int, mode: str = "errorifexists") -> None:
    """Events as JSON under dt=/hh=/min5=, one file per micro-batch; ``mode`` "ignore" keeps what is there."""
    batches = micro_batches(events.select(*EVENT.names), minutes)
    batches.repartition(*BATCHES).write.mode(mode).partitionBy(*BATCHES).option("timestampFormat", INSTANT).json(path)


def rescued(line, schema: T.StructType):
    """JSON of the fields of a line that the schema does not know or whose value has another type; a line that is no
    object is rescued whole, null if nothing is lost."""
    raw = F.from_json(line, "map<string,string>")
    parsed = F.from_json(line, schema)
    kept = F.create_map(*[x for f in schema.fields for x in (F.lit(f.name), parsed[f.name].isNotNull())])
    lost = F.map_filter(raw, lambda k, v: v.isNotNull() & ~F.coalesce(F.try_element_at(kept, k), F.lit(False)))
    return F.when(raw.isNull(), line).when(F.size(lost) > 0, F.to_json(lost))


def parsed(lines: DataFrame, schema: T.StructType = EVENT) -> DataFrame:
    """Rows of JSON lines with the rescue column, the source file, the batch and the time of reading."""
    fields = F.from_json("value", schema)
    return lines.select(
        *[fields[f.name].alias(f.name) for f in schema.fields],
        rescued(F.col("value"), schema).alias(RESCUED),
        F.col("_metadata.file_path").alias("_src_file"),
        F.col("_metadata.file_size").alias("_src_bytes"),
        batch_id(F.col("_metadata.file_path")).alias("_batch_id"),
        F.current_timestamp().alias("_ingested_at"),
        F.current_date().alias("ingest_date"),
    )


EVENTS = "batch long, n_rows long, rule string, failed long"


def ingest(spark: SparkSession, landing: str, table: Table, checkpoint: str, rules: dict | None = None) -> DataFrame:
    """Read what has landed since the last run.  Every epoch is one commit that the log knows, so a repeated epoch
    changes nothing; rows that break a ``fail`` rule stop the stream before its commit.

    Returns the run's event log: for each batch and rule the rows that broke it, counted on the way.
    """
    rules = CLICKSTREAM if rules is None else rules
    lines = spark.readStream.schema("value string").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(landing)
    rows = parsed(lines)
    broken = [F.count_if(~F.coalesce(F.expr(test), F.lit(False))).alias(name) for name, (test, _) in rules.items()]
    rows = enforce(rows.observe("rules", F.count(F.lit(1)).alias("n_rows"), *broken), rules)

    def commit(batch: DataFrame, epoch: int) -> None:
        query = json.loads(table.files.read(f"{checkpoint}/metadata"))["id"]
        if not table.exists():
            table.create(batch.limit(0))
        table.append_once(batch, query, epoch)

    query = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commit).start()
    query.awaitTermination()
    seen = [(p.batchId, p.observedMetrics["rules"].asDict()) for p in query.recentProgress if "rules" in p.observedMetrics]
    return spark.createDataFrame([(k, m["n_rows"], rule, m[rule]) for k, m in seen for rule in rules], EVENTS)


def ingest_parquet(spark: SparkSession, landing: str, schema: T.StructType, target: str, checkpoint: str) -> None:
    """Parquet files as they come, appended once each."""
    rows = spark.readStream.schema(schema).parquet(landing)
    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").format("parquet").start(target).awaitTermination()
