"""The ``events`` fixture as a clickstream with stepped prices; the SQL twin is ``plans.sql.EVENTS``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of the clickstream's payload columns.
PAYLOAD = ["price", "category_id", "category_code", "brand", "user_session"]


def pin_utc(spark: SparkSession) -> SparkSession:
    """All instants are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: type, product, category, brand, price and session by formulas over the fixture."""
    events = pin_utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    moment = F.col("ts").cast("timestamp")
    step = (F.floor(F.datediff(moment, F.lit("2024-01-01").cast("date")) / 3) + F.col("k")) % 3
    kind = F.when(F.col("event_type") == "click", "cart").when(F.col("event_type") == "error", "remove_from_cart").when(F.col("event_type") == "signup", "view")
    return events.withColumn("k", k).select(
        "event_id",
        moment.alias("event_time"),
        kind.otherwise(F.col("event_type")).alias("event_type"),
        F.col("k").cast("string").alias("product_id"),
        (F.col("k") % 10).cast("string").alias("category_id"),
        F.when(F.col("k") % 10 == 0, F.lit("cat.0")).alias("category_code"),
        F.when(F.col("event_id") % 5 >= 2, F.concat(F.lit("b"), (F.col("k") % 7).cast("string"))).alias("brand"),
        ((1000 + 300 * step + F.col("event_id") % 2).cast("long") / F.lit(100.0)).alias("price"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_id") % 97 != 0, F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string"))).alias("user_session"),
    )


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clickstream as it lands: with late copies of another price, some of them from the same file and minute."""
    events = clickstream(spark, sf_dir).withColumns({"ingested_at": F.lit("2024-02-02").cast("timestamp"), "src_file": F.lit("b.json")})
    again = events.where("event_id % 7 = 0").withColumns(
        {
            "price": F.col("price") + F.lit(0.5),
            "ingested_at": F.when(F.col("event_id") % 14 == 0, F.col("ingested_at")).otherwise(F.lit("2024-02-01").cast("timestamp")),
        }
    )
    return events.unionByName(again)


def part_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices of parts by day: a product stream with many events at one instant."""
    lines = pin_utc(spark).read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
        (F.expr("CAST(round(l_extendedprice * 100) AS BIGINT) div CAST(l_quantity AS BIGINT)") / F.lit(100.0)).alias("price"),
    )
