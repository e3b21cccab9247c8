"""Deduplication, sessions, and how they compare with the ids that came with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rates import seconds
from tidemark.sources.fixtures import PAYLOAD


def usable(events: DataFrame) -> DataFrame:
    return events.where("event_time is not null and user_id is not null and product_id is not null")


def deduplicate(events: DataFrame) -> DataFrame:
    """One row per (event_time, user_id, product_id, event_type): the newest ingested, then by file and by payload, so
    that the choice never depends on row order."""
    best = Window.partitionBy("event_time", "user_id", "product_id", "event_type").orderBy(
        F.desc("ingested_at"), F.desc("src_file"), *[F.col(c).asc_nulls_last() for c in PAYLOAD]
    )
    return events.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def sessionize(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Add gap_s, session_seq (from 1) and session_key: a session ends when the next whole-second gap is longer.

    A user may hold most of the rows, so histories are cut into days: gaps and sessions are counted within each day, the
    days of a user are chained (a row a day), and every row gets its day's number of sessions before.
    """
    own = Window.partitionBy("user_id", "_day").orderBy("event_time", "event_type", "product_id")
    at = seconds(F.col("event_time"))
    days = events.withColumn("_day", F.to_date("event_time")).withColumn("_gap", at - F.lag(at).over(own))
    parts = days.groupBy("user_id", "_day").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.count_if(F.col("_gap") > gap_seconds).alias("_inner"))
    chain = Window.partitionBy("user_id").orderBy("_day")
    parts = parts.withColumn("_from", F.col("_first") - F.lag("_last").over(chain)).withColumn("_opens", F.when(F.col("_from") <= gap_seconds, 0).otherwise(1))
    so_far = F.sum(F.col("_opens") + F.col("_inner")).over(chain.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("user_id", "_day", "_from", (F.coalesce(so_far, F.lit(0)) + F.col("_opens")).alias("_base"))
    inner = F.sum(F.when(F.col("_gap") > gap_seconds, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    joined = days.withColumn("_in_day", inner).join(parts, ["user_id", "_day"])
    numbered = joined.withColumns({"gap_s": F.coalesce("_gap", "_from"), "session_seq": (F.col("_base") + F.col("_in_day")).cast("long")})
    keyed = numbered.withColumn("session_key", F.concat_ws("#", "user_id", F.col("session_seq").cast("string")))
    return keyed.select(*events.columns, "gap_s", "session_seq", "session_key")


def session_stats(sessions: DataFrame) -> DataFrame:
    sizes = sessions.groupBy("session_key").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("sessions"),
        F.percentile_approx("n", 0.5).cast("long").alias("median_events"),
        F.round(F.sum("n").cast("double") / F.count("*").cast("double"), 2).alias("mean_events"),
        F.max("n").cast("long").alias("max_events"),
    )


def session_disagreement(sessions: DataFrame) -> DataFrame:
    """Ids from outside that fall into several sessions, sessions that hold several of them, and their share."""
    known = sessions.where("user_session is not null")
    split = known.groupBy("user_session").agg(F.count_distinct("session_key").alias("n")).agg(F.count_if(F.col("n") > 1).alias("raw_split"))
    merged = known.groupBy("session_key").agg(F.count_distinct("user_session").alias("n")).agg(F.count_if(F.col("n") > 1).alias("own_merged"))
    every = sessions.agg(F.count_distinct("session_key").alias("sessions"))
    one = split.crossJoin(merged).crossJoin(every)  # one row each
    return one.withColumn("merged_pct", F.round(100 * F.try_divide(F.col("own_merged").cast("double"), F.col("sessions").cast("double")), 2))


def most_split(sessions: DataFrame) -> DataFrame:
    """The events of the outside id that spans most sessions (the least id of equals)."""
    known = sessions.where("user_session is not null")
    worst = known.groupBy("user_session").agg(F.count_distinct("session_key").alias("n")).orderBy(F.desc("n"), "user_session").limit(1)
    return sessions.join(F.broadcast(worst.select("user_session")), "user_session", "left_semi").select("event_time", "gap_s", "event_type", "product_id", "session_key")


def events_per_user(events: DataFrame) -> DataFrame:
    sizes = events.groupBy("user_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.max("n").alias("most"), F.percentile_approx("n", 0.5).cast("long").alias("median"))
