"""The layers of an input, each written once as a versioned table that later queries read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import binding, gold, prices, sessions
from tidemark.plans.sql import FUNNEL_COLUMNS
from tidemark.settings import RULES
from tidemark.sources import fixtures
from tidemark.sources.paths import workspace
from tidemark.sources.store import Files, Table


def by_day(clicks: DataFrame, held: DataFrame) -> DataFrame:
    """Bins of a day: no table is gathered, and a hot product is spread over its days."""
    return binding.bind_binned(clicks, held, binding.DAY)


class Layers:
    """deduped, sessions, intervals, silver and hourly below ``root``; each is built from the ones before when first read."""

    def __init__(self, spark: SparkSession, raw: Callable[[], DataFrame], root: str):
        self.spark, self.raw, self.root = spark, raw, root

    def deduplicate(self) -> DataFrame:
        return sessions.deduplicate(sessions.usable(self.raw()))

    def sessionize(self) -> DataFrame:
        return sessions.sessionize(self.read("deduped"), RULES.session_gap_seconds)

    def derive_intervals(self) -> DataFrame:
        return prices.price_intervals(prices.priced_events(self.read("deduped")), RULES.noise_cents)

    def closed(self) -> DataFrame:
        return prices.closed_intervals(self.read("intervals"), self.read("deduped"))

    def bind(self, how: Callable[[DataFrame, DataFrame], DataFrame] = by_day) -> DataFrame:
        return binding.to_silver(how(self.read("sessions"), self.closed()))

    def funnel(self) -> DataFrame:
        return gold.funnel_hourly(self.read("silver")).select(*FUNNEL_COLUMNS.split(", "))

    #: Name of a layer: (layer of the store, what builds it, clustering columns).
    TABLES = {
        "deduped": ("silver", deduplicate, ()),
        "sessions": ("silver", sessionize, ()),
        "intervals": ("silver", derive_intervals, ()),
        "silver": ("silver", bind, ()),
        "hourly": ("gold", funnel, ("event_hour", "product_id")),
    }

    def table(self, name: str) -> Table:
        layer, build, cluster_by = self.TABLES[name]
        found = Table(self.spark, f"{self.root}/{layer}/{name}", layer)
        if not found.exists():
            found.create(build(self), cluster_by)
        return found

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def build(self) -> None:
        for name in self.TABLES:
            self.table(name)


_known: dict[tuple, Layers] = {}


def layers(spark: SparkSession, sf_dir: str) -> Layers:
    """The layers of a folder's events; another input at the same path, by its size or time of change, has others."""
    key = (spark.sparkContext.applicationId, sf_dir, Files(spark).stamp(f"{sf_dir}/events.parquet"))
    if key not in _known:
        _known[key] = Layers(spark, lambda: fixtures.ingested(spark, sf_dir), workspace(spark, "layers"))
    return _known[key]
