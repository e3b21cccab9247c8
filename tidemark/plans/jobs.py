"""A function per job of the engine, over one project folder; any scheduler can call them in order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import audit, binding, evidence, gold, layout, prices, quality, sessions
from tidemark.plans.layers import Layers
from tidemark.settings import RULES
from tidemark.sources import files
from tidemark.sources.schemas import INTERVAL
from tidemark.sources.serving import MaterializedView
from tidemark.sources.store import Files, Table
from tidemark.streaming.ingest import ingest, ingest_parquet, land


class Project:
    """Landing, bronze, silver, gold and audit tables of one source of events, below ``root``."""

    def __init__(self, spark: SparkSession, root: str, minutes: int = RULES.batch_minutes):
        self.spark, self.root, self.minutes, self.run_id = spark, root, minutes, uuid.uuid4().hex
        self.bronze_clicks = Table(spark, f"{root}/bronze/clickstream", "bronze")
        self.layers = Layers(spark, self._raw, root)
        self.measurements = Table(spark, f"{root}/ops/measurements", "ops")
        self.frozen_path = f"{root}/audit/hourly"

    def _raw(self) -> DataFrame:
        return self.bronze_clicks.read().withColumnsRenamed({"_ingested_at": "ingested_at", "_src_file": "src_file"})

    def evidence(self, step: str) -> evidence.Evidence:
        return evidence.Evidence(self.measurements, self.run_id, step)

    def setup(self) -> None:
        for folder in ("landing", "bronze", "silver", "gold", "audit", "ops"):
            Files(self.spark).make_folder(f"{self.root}/{folder}")

    def harness(self, events: DataFrame) -> None:
        """Replay the first days as micro-batches, and derive the price feed from them."""
        ev = self.evidence("harness")
        land(prices.replay_window(events, RULES.replay_days), f"{self.root}/landing/clicks", self.minutes, "ignore")
        landed = files.scan_json(self.spark, f"{self.root}/landing/clicks")
        stats = layout.landing_stats(landed.select("event_time", F.col("_metadata.file_path").alias("p")), "event_time", F.col("p")).first()
        feed = prices.price_intervals(prices.priced_events(landed), RULES.noise_cents)
        files.write_one_parquet(feed, f"{self.root}/landing/prices")
        changed = prices.changed_products(files.scan_parquet(self.spark, f"{self.root}/landing/prices", INTERVAL), RULES.significant_change).first().products
        ev.record("events_landed", stats.n_rows)
        ev.verdict("A1", stats.one_file_a_batch)
        ev.verdict("A2", changed >= RULES.min_changed_products, f"{changed} of {RULES.min_changed_products}")
        ev.flush()

    def bronze(self) -> DataFrame:
        """Ingest what has landed; the event log of the run."""
        log = ingest(self.spark, f"{self.root}/landing/clicks", self.bronze_clicks, f"{self.root}/ops/checkpoint-clicks")
        ingest_parquet(self.spark, f"{self.root}/landing/prices", INTERVAL, f"{self.root}/bronze/prices", f"{self.root}/ops/checkpoint-prices")
        ev = self.evidence("bronze")
        found = layout.completeness(self.bronze_clicks.read()).first()
        ev.record("bronze_rows", found.n_rows)
        ev.record("bronze_files", found.files)
        ev.record("bronze_rescued", quality.dirt_profile(self.bronze_clicks.read(), "_rescued_data").first().rescued)
        ev.flush()
        return log

    def silver(self) -> None:
        ev = self.evidence("silver")
        split = sessions.session_disagreement(self.layers.read("sessions")).first()
        ev.record("own_merged", split.own_merged)
        ev.verdict("A3", split.sessions > 0)
        held = self.layers.closed()
        clicks = self.layers.read("sessions")
        found = binding.agreement(binding.bind_broadcast(clicks, held), binding.bind_asof(clicks, held)).first()
        ev.verdict("A4", found.disagreements == 0, f"{found.disagreements} of {found.clicks}")
        exact = binding.price_match(self.layers.read("silver")).first().near_pct or 0.0
        ev.verdict("A5", exact >= RULES.min_match_percent, f"{exact} percent within a cent")
        ev.flush()

    def gold(self) -> None:
        ev = self.evidence("gold")
        totals = gold.funnel_totals(self.layers.read("hourly")).first()
        ev.record("product_hours", totals.product_hours)
        changes = prices.significant_changes(self.layers.read("intervals"), RULES.significant_change)
        measured = Table(self.spark, f"{self.root}/gold/elasticity")
        measured.create(gold.elasticity(self.layers.read("silver"), changes, RULES))
        short = measured.read().where(F.col("post_hours") < RULES.min_post_hours)
        ev.verdict("A9", short.isEmpty() and totals.null_rates == 0)
        lost = gold.abandonment_funnel(self.layers.read("silver"), changes.where("pct_price_change > 0"), RULES.abandonment_minutes).first()
        ev.verdict("A10", lost.lost_at_cart_price >= lost.lost_at_old_price)
        ev.flush()

    def evolution(self) -> DataFrame:
        ev = self.evidence("evolution")
        proof = audit.evolution_proof(Table(self.spark, f"{self.root}/silver/silver", "silver"), "catalog_price")
        kept = proof.where("not same_files or not empty_column").isEmpty() and proof.select("n_rows", "checksum").distinct().count() == 1
        ev.verdict("A6", kept)
        ev.verdict("A7", kept)
        ev.flush()
        return proof

    def maintenance(self) -> DataFrame:
        """Compact, guard history, and judge all criteria."""
        ev = self.evidence("maintenance")
        before, after = (r.files for r in audit.layout_probe(self.layers.table("hourly"), "event_hour", 0).orderBy("step").collect())
        ev.verdict("A8", after <= before, f"{before} to {after} files")
        short = audit.history_guard([self.layers.table(n) for n in Layers.TABLES])
        ev.record("history_shortfalls", short.count())
        ev.flush()
        return evidence.gate(self.measurements.read())

    def audit(self) -> DataFrame:
        """Freeze the hourly table, prove that the copy stands, and check that it will."""
        ev = self.evidence("audit")
        live = self.layers.table("hourly")
        frozen = audit.freeze(live, self.frozen_path)
        checked = audit.retention_check(live, frozen, audit.immutability_proof(live, frozen))
        ev.verdict("A11", checked.where("not holds").isEmpty())
        ev.flush()
        return checked

    def serving(self) -> DataFrame:
        ev = self.evidence("serving")
        answers = three_ways(self.spark, self.layers.table("hourly"), f"{self.root}/gold/category_daily")
        ev.verdict("A12", answers.select("n_rows", "purchases", "revenue").distinct().count() == 1)
        ev.flush()
        return answers

    def run(self, events: DataFrame) -> DataFrame:
        """All jobs in order; the verdict on every criterion."""
        self.setup()
        self.harness(events)
        self.bronze()
        for job in (self.silver, self.gold, self.evolution, self.audit, self.serving):
            job()
        return self.maintenance()


def three_ways(spark: SparkSession, hourly: Table, view_path: str) -> DataFrame:
    """(way, n_rows, purchases, revenue): the rollup by day asked of the table, by SQL, and of the view kept ready."""
    direct = gold.category_daily(hourly.read(), F.lit(hourly.path).isNotNull())  # a condition that is always true
    view = MaterializedView(Table(spark, view_path), lambda: gold.category_daily(hourly.read())).create()
    view.refresh()
    columns = "count(*) AS n_rows, CAST(sum(purchases) AS BIGINT) AS purchases, CAST(sum(revenue) AS DECIMAL(18,2)) AS revenue"
    by_sql = f"""SELECT 'sql' AS way, {columns} FROM (SELECT category_id, date_trunc('day', event_hour) AS d, sum(purchases) AS purchases, sum(revenue) AS revenue
        FROM {{hourly}} WHERE :run IS NOT NULL GROUP BY ALL)"""
    answer = lambda rows, way: rows.selectExpr(f"'{way}' AS way", *columns.split(", C")[:1], *["C" + c for c in columns.split(", C")[1:]])
    return answer(direct, "direct").unionByName(spark.sql(by_sql, args={"run": hourly.path}, hourly=hourly.read())).unionByName(answer(view.read(), "view"))
