"""Binding the price in force to each click: four ways with one result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rates import seconds, within
from tidemark.settings import MONEY, RULES


DAY = 86_400


def _sides(clicks: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    prices = intervals.select(F.col("product_id").alias("_p"), F.col("price").alias("catalog_price"), F.col("effective_start").alias("_from"), F.col("effective_until").alias("_until"))
    return clicks, prices


def _in_force():
    return (F.col("product_id") == F.col("_p")) & within(F.col("event_time"), F.col("_from"), F.col("_until"))


def planned_bytes(rows: DataFrame) -> int:
    """The optimizer's size of a result, without running it; of a written table the size of its files."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bind_broadcast(clicks: DataFrame, intervals: DataFrame, limit: int = RULES.broadcast_bytes) -> DataFrame:
    """Every click with the price of its interval, or null.  Intervals that are not known to stay below ``limit`` bytes are
    not broadcast but joined by bins of a day."""
    left, right = _sides(clicks, intervals)
    if planned_bytes(right) > limit:
        return bind_binned(clicks, intervals, DAY)
    return left.join(F.broadcast(right), _in_force(), "left").drop("_p", "_from", "_until")


def bind_naive(clicks: DataFrame, intervals: DataFrame) -> DataFrame:
    """The plain range join: a control for small tables."""
    left, right = _sides(clicks, intervals)
    return left.join(right.hint("shuffle_hash"), _in_force(), "left").drop("_p", "_from", "_until")


def bin_seconds(intervals: DataFrame) -> int:
    """A bin as long as the median interval, an hour at least."""
    length = seconds(F.col("effective_until")) - seconds(F.col("effective_start"))
    median = intervals.agg(F.percentile_approx(length, 0.5).alias("m")).first()["m"]
    return max(3600, int(median or 0))


def bind_binned(clicks: DataFrame, intervals: DataFrame, width: int | None = None) -> DataFrame:
    """An equi-join on (product, time bin): intervals are repeated for the bins they touch, so work per key stays
    bounded by a bin instead of a product's whole history."""
    width = width or bin_seconds(intervals)
    left, right = _sides(clicks, intervals)
    last = F.floor((seconds(F.col("_until")) - F.when(F.col("_until") == F.date_trunc("second", "_until"), 1).otherwise(0)) / width)
    right = right.where("_until > _from").withColumn("_bin", F.explode(F.sequence(F.floor(seconds(F.col("_from")) / width), F.greatest(last, F.floor(seconds(F.col("_from")) / width)))))
    left = left.withColumn("_b", F.floor(seconds(F.col("event_time")) / width))
    return left.join(right, _in_force() & (F.col("_b") == F.col("_bin")), "left").drop("_p", "_from", "_until", "_bin", "_b")


def bind_asof(clicks: DataFrame, intervals: DataFrame) -> DataFrame:
    """The last price at or before each click, out of the starts alone.

    Histories are cut into days, so that a hot product is spread over its days: the window runs inside a (product, day),
    and what no price of the day covers takes the last price of the days before, which a chain of one row a day carries.
    Of starts at one instant the open interval holds, else the dearer.
    """
    day = F.to_date("event_time").alias("_day")
    rank = F.struct("event_time", F.col("effective_end").isNull().alias("open"), "price")
    starts = intervals.withColumnRenamed("effective_start", "event_time").select("product_id", "event_time", day, "price", rank.alias("_rank"))
    ends = starts.groupBy("product_id", "_day").agg(F.max_by("price", "_rank").alias("_close"))
    chain = ends.unionByName(clicks.select("product_id", day).distinct(), allowMissingColumns=True).groupBy("product_id", "_day").agg(F.max("_close").alias("_close"))
    earlier = Window.partitionBy("product_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = chain.select("product_id", "_day", F.last("_close", ignorenulls=True).over(earlier).alias("_carry"))
    marked = clicks.select("*", day).join(carried, ["product_id", "_day"], "left").select(*clicks.columns, "_day", "_carry", F.lit(True).alias("_click"))
    opened = starts.select("product_id", "_day", "event_time", F.col("price").alias("_price"), "_rank")
    so_far = Window.partitionBy("product_id", "_day").orderBy("event_time", F.col("_click").asc_nulls_first(), "_rank").rowsBetween(Window.unboundedPreceding, 0)
    both = marked.unionByName(opened, allowMissingColumns=True).withColumn("_here", F.last("_price", ignorenulls=True).over(so_far))
    return both.where("_click").select(*clicks.columns, F.ifnull("_here", "_carry").alias("catalog_price"))


def bind_hourly_grid(clicks: DataFrame, intervals: DataFrame) -> DataFrame:
    """The contrast: the price in force when the click's hour began, by an equi-join on (product, hour).

    Changes inside an hour are seen an hour late, which is why no other query uses it.
    """
    first = F.date_trunc("hour", F.col("_from") + F.expr("INTERVAL 3599.999999 SECOND"))
    left, right = _sides(clicks, intervals)
    grid = right.where(first < F.col("_until")).select("_p", "catalog_price", F.explode(F.sequence(first, F.col("_until") - F.expr("INTERVAL 0.000001 SECOND"), F.expr("INTERVAL 1 HOUR"))).alias("_hour"))
    return left.join(grid, (F.col("product_id") == F.col("_p")) & (F.date_trunc("hour", "event_time") == F.col("_hour")), "left").drop("_p", "_hour")


def bind(clicks: DataFrame, intervals: DataFrame, limit: int = RULES.broadcast_bytes) -> DataFrame:
    """Broadcast intervals that the optimizer knows to stay below ``limit`` bytes, and bin them by their median length beyond."""
    return bind_broadcast(clicks, intervals, limit) if planned_bytes(intervals) <= limit else bind_binned(clicks, intervals)


def to_silver(bound: DataFrame) -> DataFrame:
    """Money as decimals, and whether the price shown was the price in force (null where there was none)."""
    money = {"price_at_event": "price", "catalog_price": "catalog_price"}
    as_money = [F.col(c).cast(MONEY).alias(name) for name, c in money.items()]
    same = (as_money[0] == as_money[1]).alias("price_match")
    return bound.select("event_time", "event_type", "product_id", "category_id", "category_code", "brand", *as_money, same, "user_id", "session_key")


KEY = ["event_time", "user_id", "product_id", "event_type"]


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: clicks, and how many of them two bindings price differently (null-safe on keys and prices)."""
    a = first.select(*[F.col(c).alias(f"a_{c}") for c in KEY], F.col("catalog_price").alias("a_price"), F.lit(1).alias("a"))
    b = second.select(*[F.col(c).alias(f"b_{c}") for c in KEY], F.col("catalog_price").alias("b_price"), F.lit(1).alias("b"))
    same = None
    for c in KEY:
        test = F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        same = test if same is None else same & test
    both = a.join(b, same, "full_outer")
    differs = F.col("a").isNull() | F.col("b").isNull() | ~F.col("a_price").eqNullSafe(F.col("b_price"))
    return both.agg(F.count("*").alias("clicks"), F.count_if(differs).alias("disagreements"))


def price_match(silver: DataFrame) -> DataFrame:
    """Clicks, unpriced ones, exact matches, matches within a cent, and both as percentages of priced clicks."""
    off = F.abs((F.col("price_at_event") * 100).cast("long") - (F.col("catalog_price") * 100).cast("long"))
    found = silver.agg(
        F.count("*").alias("clicks"),
        F.count_if(F.col("catalog_price").isNull()).alias("unpriced"),
        F.count_if(F.col("price_match")).alias("exact"),
        F.count_if(off <= 1).alias("near"),
    )
    percent = lambda c: F.round(100 * F.try_divide(F.col(c).cast("double"), (F.col("clicks") - F.col("unpriced")).cast("double")), 3)
    return found.withColumns({"exact_pct": percent("exact"), "near_pct": percent("near")})
