"""Expectations on rows, and profiles of the dirt that is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.settings import EVENT_TYPES

_KNOWN = ", ".join(f"'{t}'" for t in EVENT_TYPES)
#: (dataset, rule) -> (what a row must satisfy, what happens to one that doesn't: warn, drop or fail).
CLICKSTREAM = {
    "event_time_present": ("event_time IS NOT NULL", "warn"),
    "product_present": ("product_id IS NOT NULL", "warn"),
    "user_present": ("user_id IS NOT NULL", "warn"),
    "known_event_type": (f"event_type IN ({_KNOWN})", "warn"),
    "positive_price": ("price > 0", "warn"),
    "category_code_present": ("category_code IS NOT NULL", "warn"),
    "brand_present": ("brand IS NOT NULL", "warn"),
    "user_session_present": ("user_session IS NOT NULL", "warn"),
    "nothing_rescued": ("_rescued_data IS NULL", "warn"),
    "file_in_micro_batch_layout": ("_batch_id IS NOT NULL", "fail"),
}
CATALOG = {
    "positive_price": ("price > 0", "warn"),
    "interval_not_inverted": ("effective_end IS NULL OR effective_end >= effective_start", "warn"),
    "nothing_rescued": ("_rescued_data IS NULL", "warn"),
    "product_present": ("product_id IS NOT NULL", "fail"),
    "start_present": ("effective_start IS NOT NULL", "fail"),
}


class ExpectationError(ValueError):
    """A rule that must hold for every row does not."""


def expectation_counts(rows: DataFrame, dataset: str, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """(dataset, rule, action, passed, failed) in one pass; a rule that is null for a row has failed it."""
    counted = rows.agg(F.count("*").alias("_n"), *[F.count_if(F.expr(test)).alias(name) for name, (test, _) in rules.items()])
    each = [F.struct(F.lit(dataset).alias("dataset"), F.lit(name).alias("rule"), F.lit(action).alias("action"), F.col(name).alias("passed"), (F.col("_n") - F.col(name)).alias("failed")) for name, (_, action) in rules.items()]
    return counted.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def enforce(rows: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows, without those that break a ``drop`` rule; a row that breaks a ``fail`` rule stops the query."""
    for name, (test, action) in rules.items():
        holds = F.coalesce(F.expr(test), F.lit(False))
        if action == "drop":
            rows = rows.where(holds)
        elif action == "fail":
            rows = rows.where(F.when(holds, F.lit(True)).otherwise(F.raise_error(F.lit(f"rule {name} does not hold")).cast("boolean")))
    return rows


def dirt_profile(events: DataFrame, rescue: str | None = None) -> DataFrame:
    """Percentages of nulls, the count of prices that are no price, and of rescued rows where a column holds them."""
    pct = lambda c: F.round(100 * F.try_divide(F.count_if(F.col(c).isNull()).cast("double"), F.count("*").cast("double")), 2).alias(f"{c}_null_pct")
    bad = F.count_if(F.coalesce(F.col("price") <= 0, F.lit(True)))
    lost = [F.count_if(F.col(rescue).isNotNull()).alias("rescued")] if rescue else []
    return events.agg(F.count("*").alias("n_rows"), *[pct(c) for c in ("category_code", "brand", "user_session", "product_id")], bad.alias("no_price"), *lost)
