"""All registered queries and their SQL statements by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import audit, binding, evidence, gold, layout, prices, quality, sessions
from tidemark.plans.jobs import Project, three_ways
from tidemark.plans.layers import layers
from tidemark.plans.sql import FUNNEL_COLUMNS, INTERVAL_COLUMNS, ORACLES
from tidemark.settings import RULES
from tidemark.sources import catalog, files, fixtures
from tidemark.sources.paths import workspace
from tidemark.sources.schemas import EVENT, INTERVAL
from tidemark.sources.serving import MaterializedView
from tidemark.sources.store import Table
from tidemark.streaming.ingest import ingest, land

Query = Callable[[SparkSession, str], DataFrame]
__all__ = ["ORACLES", "QUERIES"]


def plain(rows: DataFrame) -> DataFrame:
    """Instants without zone, as the fixtures have them."""
    return rows.select(*[F.col(n).cast("timestamp_ntz").alias(n) if k == "timestamp" else F.col(n) for n, k in rows.dtypes])


# ---------------------------------------------------------------- layers


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).read("deduped")


def sessionized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).read("sessions")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).read("intervals")


def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).closed()


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).read("silver")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).read("hourly")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.significant_changes(intervals(spark, sf_dir), RULES.significant_change)


def increases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).where("pct_price_change > 0")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.elasticity(silver(spark, sf_dir), changes(spark, sf_dir), RULES)


# ---------------------------------------------------------------- queries that need more than a line


def bind_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, held = sessionized(spark, sf_dir), closed(spark, sf_dir)
    first = binding.bind_broadcast(clicks, held)
    pairs = {"broadcast-binned": binding.bind_binned, "broadcast-asof": binding.bind_asof}
    found = [binding.agreement(first, how(clicks, held)).withColumn("pair", F.lit(name)) for name, how in pairs.items()]
    return found[0].unionByName(found[1])


def latest_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    moment = lambda t: F.lit(t).cast("timestamp")
    newest = rows.withColumns({"ingested_at": moment("2024-03-02"), "src_file": F.lit("v2")})
    older = rows.withColumns({"price": (F.col("price") + 1).cast("decimal(12,2)"), "ingested_at": moment("2024-03-01"), "src_file": F.lit("v1")})
    empty = newest.where("change_reason = 'increase'").withColumn("effective_end", F.col("effective_start"))
    return prices.latest_intervals(newest.unionByName(older).unionByName(empty)).select(*INTERVAL_COLUMNS.split(", "))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    clicks = fixtures.clickstream(spark, sf_dir).withColumns({"_rescued_data": nothing, "_batch_id": F.lit("x")})
    catalog = intervals(spark, sf_dir).withColumn("_rescued_data", nothing)
    return quality.expectation_counts(clicks, "clickstream", quality.CLICKSTREAM).unionByName(quality.expectation_counts(catalog, "price_catalog", quality.CATALOG))


def batch_id_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["s3://b/dt=2024-01-01/hh=05/min5=10/part-0.json", "/v/dt=2024-12-31/hh=23/min5=55/x.json", "/v/2024-12-31/x.json", None]
    return spark.createDataFrame([(p,) for p in paths], "p string").withColumn("batch_id", layout.batch_id(F.col("p")))


def changed_live(rows: DataFrame) -> DataFrame:
    return rows.where("category_id <> '3'").withColumn("purchases", F.col("purchases") + 1)


def q3_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen = hourly(spark, sf_dir)
    return gold.drift(frozen, changed_live(frozen))


def audit_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hourly(spark, sf_dir)
    top = gold.top_category(rows).select(F.col("category_id").alias("_top"))
    return gold.reading(rows.join(F.broadcast(top)), F.col("_top"))


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freeze, change the live table, and read every side again."""
    root = workspace(spark, "audit")
    live = Table(spark, f"{root}/gold/hourly", "gold")
    live.create(hourly(spark, sf_dir), ("event_hour", "product_id"))
    frozen = live.clone(f"{root}/audit/hourly", 0)
    live.update(F.lit(True), {"purchases": F.col("purchases") + 1})
    changed = live.delete(F.col("category_id") == "3")
    restored = live.restore(0)
    sides = {"1 before": live.read(0), "2 live": live.read(changed), "3 version 0": live.read(0), "4 frozen": frozen.read(), "5 restored": live.read(restored)}
    found = [gold.reading(rows, "").select(F.lit(step).alias("step"), "n_rows", "purchases", "revenue") for step, rows in sides.items()]
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    return every


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land batches of six hours, ingest them twice (the second run finds nothing new), and sum by batch."""
    root = workspace(spark, "ingest")
    land(fixtures.clickstream(spark, sf_dir), f"{root}/landing", 360)
    table = Table(spark, f"{root}/bronze/clickstream", "bronze")
    for _ in range(2):
        ingest(spark, f"{root}/landing", table, f"{root}/checkpoint")
    return table.read().groupBy(F.col("_batch_id").alias("batch_id")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"))


def partition_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skew of users by a remainder, which SQL can compute too; Spark's own hash is the operator's default."""
    return layout.partition_skew(deduped(spark, sf_dir), "user_id", part=F.col("user_id").cast("long") % 64)


def union(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for rows in parts[1:]:
        every = every.unionByName(rows)
    return every


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{workspace(spark, 'csv')}/clicks"
    files.write_csv(fixtures.clickstream(spark, sf_dir).select(*EVENT.names), path)
    return files.scan_csv(spark, path)


def _landed(spark: SparkSession, sf_dir: str) -> str:
    path = f"{workspace(spark, 'json')}/clicks"
    land(fixtures.clickstream(spark, sf_dir), path, 360)
    return path


def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_json(spark, _landed(spark, sf_dir), parts=("dt", "hh", "min5"))


def landing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = files.scan_json(spark, _landed(spark, sf_dir)).select("event_time", F.col("_metadata.file_path").alias("p"))
    return layout.landing_stats(landed, "event_time", F.col("p"))


def price_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{workspace(spark, 'feed')}/prices"
    files.write_one_parquet(intervals(spark, sf_dir), path)
    feed = files.scan_parquet(spark, path, INTERVAL)
    return feed.crossJoin(files.source_files(feed).agg(F.count("*").alias("n_files")))  # one row


def _bronze(spark: SparkSession, sf_dir: str) -> tuple[Table, DataFrame]:
    root = workspace(spark, "bronze")
    land(fixtures.clickstream(spark, sf_dir), f"{root}/landing", 360)
    table = Table(spark, f"{root}/bronze", "bronze")
    return table, ingest(spark, f"{root}/landing", table, f"{root}/checkpoint")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.completeness(_bronze(spark, sf_dir)[0].read())


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _bronze(spark, sf_dir)[1]
    return log.groupBy("rule").agg(F.sum("n_rows").alias("n_rows"), F.sum("failed").alias("failed"))


def rescued_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dirt_profile(_bronze(spark, sf_dir)[0].read(), "_rescued_data")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows out of the events: verdicts on fifteen criteria, and other metrics."""
    rows = fixtures.clickstream(spark, sf_dir)
    k = F.col("product_id").cast("int")
    metric = F.when(k < 50, F.concat(F.lit("acceptance_A"), (k % 15).cast("string"))).otherwise(F.concat(F.lit("rows_"), F.col("category_id")))
    value = F.when(F.col("event_type") == "purchase", "FAIL").otherwise("PASS")
    return rows.select(metric.alias("metric"), F.when(k < 50, value).otherwise(F.col("event_id").cast("string")).alias("value"), F.col("event_time").alias("recorded_at"))


def _named(spark: SparkSession, sf_dir: str) -> str:
    """The hourly table under a name of its own in the catalog."""
    root = workspace(spark, "catalog")
    schema = f"tidemark_{root.rsplit('-', 1)[1]}"
    catalog.create_schema(spark, schema, "gold tables")
    catalog.publish(hourly(spark, sf_dir), f"{schema}.hourly", f"{root}/hourly", {"layer": "gold"}, "the hourly funnel")
    return f"{schema}.hourly"


def table_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, _named(spark, sf_dir))


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _named(spark, sf_dir)
    layer = catalog.properties(spark, name).where("key = 'layer'").select(F.col("value").alias("layer"))
    return catalog.listing(spark, name.split(".")[0]).select("table").crossJoin(layer)  # one row


def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls by column, as collected for the optimizer; distinct counts there are estimates."""
    return catalog.analyze(spark, _named(spark, sf_dir)).select("column", "nulls")


def optimizer_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the optimizer expects of an analyzed table."""
    name = _named(spark, sf_dir)
    catalog.analyze(spark, name)
    before = spark.conf.get("spark.sql.cbo.enabled")
    spark.conf.set("spark.sql.cbo.enabled", "true")
    try:
        found = layout.root_estimate(spark.table(name))
    finally:
        spark.conf.set("spark.sql.cbo.enabled", before)
    return spark.createDataFrame([(found["rows"],)], "expected_rows long")


def client_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    client = catalog.Client(spark)
    return client.run("SELECT event_type, count(*) AS n FROM IDENTIFIER(:t) GROUP BY event_type", t=_view(silver(spark, sf_dir), "client_clicks"))


def _view(rows: DataFrame, name: str) -> str:
    rows.createOrReplaceTempView(name)
    return name


def materialized_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup by day: as created, stale after the source has changed, and refreshed."""
    root = workspace(spark, "view")
    source = Table(spark, f"{root}/hourly")
    source.create(hourly(spark, sf_dir))
    view = MaterializedView(Table(spark, f"{root}/daily"), lambda: gold.category_daily(source.read())).create()
    source.delete(F.col("category_id") == "3")
    found = [view.read().withColumn("step", F.lit("1 stale"))]
    view.refresh()
    view.create()  # it is there already
    return union([*found, view.read().withColumn("step", F.lit("2 refreshed"))])


def serving_three_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return three_ways(spark, layers(spark, sf_dir).table("hourly"), f"{workspace(spark, 'ways')}/daily")


def _copy(spark: SparkSession, rows: DataFrame, layer: str = "gold", cluster_by: tuple[str, ...] = ()) -> Table:
    table = Table(spark, f"{workspace(spark, 'copy')}/{layer}/hourly", layer)
    table.create(rows, cluster_by)
    return table


def evolution_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.evolution_proof(_copy(spark, silver(spark, sf_dir), "silver"), "catalog_price")


def immutability_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _copy(spark, hourly(spark, sf_dir))
    return audit.immutability_proof(live, audit.freeze(live, f"{live.path}-frozen"))


def retention_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _copy(spark, hourly(spark, sf_dir))
    frozen = audit.freeze(live, f"{live.path}-frozen")
    return audit.retention_check(live, frozen, audit.immutability_proof(live, frozen))


def freeze_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of the version of a past moment, asked for twice: the second time changes nothing."""
    live = _copy(spark, hourly(spark, sf_dir))
    moment = live.entry().timestamp
    live.delete(F.col("category_id") == "3")
    first = audit.freeze(live, f"{live.path}-frozen", moment)
    live.delete(F.lit(True))
    again = audit.freeze(live, f"{live.path}-frozen")
    return union([gold.reading(t.read(), "").select(F.lit(step).alias("step"), "n_rows", "purchases", "revenue") for step, t in {"1 first": first, "2 again": again, "3 live": live}.items()])


def history_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three tables one keeps too little and one is no versioned table."""
    kept, short = _copy(spark, hourly(spark, sf_dir)), _copy(spark, hourly(spark, sf_dir))
    short.set_properties(log="2 weeks", deleted_files="interval 36 hours")
    return audit.history_guard([kept, short, Table(spark, f"{kept.path}-none")])


def layout_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first day, and whether compaction left no more files in all and for that day."""
    table = _copy(spark, hourly(spark, sf_dir).repartition(12, "product_id"))
    table.set_cluster_by("event_hour")
    probe = audit.layout_probe(table, "event_hour", 0, 4)
    a, b = probe.where("step = '1 before'"), probe.where("step = '2 after'").select(F.col("files").alias("f2"), F.col("files_of_day").alias("d2"), F.col("rows_of_day").alias("r2"))
    return a.crossJoin(b).select("rows_of_day", F.col("r2").alias("rows_after"), (F.col("f2") <= F.col("files")).alias("fewer_files"), (F.col("d2") <= F.col("files_of_day")).alias("fewer_for_day"))  # one row each


def _worked_on(spark: SparkSession, sf_dir: str) -> Table:
    table = _copy(spark, hourly(spark, sf_dir))
    table.delete(F.col("category_id") == "3")
    table.optimize(2)
    table.vacuum(dry_run=False)
    table.optimize(1)
    return table


def table_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worked_on(spark, sf_dir).history().orderBy("version").select("version", "operation")


def last_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worked_on(spark, sf_dir).history().orderBy(F.desc("timestamp"), F.desc("version")).limit(1).select("version", "operation")


def clean_up_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worked_on(spark, sf_dir).clean_ups()


def orchestrated_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs over the fixture in batches of six hours: the verdict on every criterion."""
    project = Project(spark, workspace(spark, "project"), 360)
    return project.run(fixtures.clickstream(spark, sf_dir)).select("id", "status", "kind", "blocks")


_Q: dict[str, Query] = {
    "replay_window": lambda s, d: prices.replay_window(fixtures.clickstream(s, d), RULES.replay_days).select("event_id", "event_time", "event_type", "product_id", "price"),
    "micro_batches": lambda s, d: prices.micro_batches(fixtures.clickstream(s, d), RULES.batch_minutes).groupBy("dt", "hh", "min5").agg(F.count("*").alias("n")),
    "priced_events": lambda s, d: prices.priced_events(deduped(s, d)),
    "dedup": lambda s, d: layers(s, d).deduplicate().select("event_id", "event_time", "user_id", "product_id", "event_type", "price"),
    "sessionize": lambda s, d: layers(s, d).sessionize().select("event_id", "user_id", "event_time", "gap_s", "session_seq", "session_key"),
    "session_stats": lambda s, d: sessions.session_stats(sessionized(s, d)),
    "session_disagreement": lambda s, d: sessions.session_disagreement(sessionized(s, d)),
    "most_split_session": lambda s, d: sessions.most_split(sessionized(s, d)),
    "events_per_user": lambda s, d: sessions.events_per_user(deduped(s, d)),
    "price_intervals": lambda s, d: layers(s, d).derive_intervals(),
    "tie_intervals_lineitem": lambda s, d: prices.price_intervals(prices.priced_events(fixtures.part_prices(s, d)), RULES.noise_cents),
    "interval_reasons": lambda s, d: intervals(s, d).groupBy("change_reason").agg(F.count("*").alias("intervals"), F.count_distinct("product_id").alias("products"), F.count_if(F.col("effective_end").isNull()).alias("open_ended")),
    "changed_products": lambda s, d: prices.changed_products(intervals(s, d), RULES.significant_change),
    "latest_intervals": latest_intervals,
    "closed_intervals": lambda s, d: closed(s, d).select("product_id", "effective_start", "effective_until"),
    "bind_broadcast": lambda s, d: layers(s, d).bind(binding.bind_broadcast),
    "bind_binned": lambda s, d: layers(s, d).bind(binding.bind_binned),
    "bind_asof": lambda s, d: layers(s, d).bind(binding.bind_asof),
    "bind_chosen": lambda s, d: layers(s, d).bind(binding.bind),
    "bind_agreement": bind_agreement,
    "price_match_accuracy": lambda s, d: binding.price_match(silver(s, d)),
    "funnel_hourly": lambda s, d: layers(s, d).funnel(),
    "funnel_totals": lambda s, d: gold.funnel_totals(hourly(s, d)),
    "category_daily": lambda s, d: gold.category_daily(hourly(s, d)),
    "salted_rollup": lambda s, d: gold.category_rollup(hourly(s, d), RULES.salt_buckets),
    "category_share": lambda s, d: gold.category_share(hourly(s, d), F.col("views")),
    "significant_changes": changes,
    "change_counts": lambda s, d: gold.change_counts(changes(s, d)),
    "q1_elasticity": measured,
    "q1_floor_stats": lambda s, d: gold.floor_stats(measured(s, d), RULES),
    "q1_report": lambda s, d: gold.elasticity_report(measured(s, d), 1, RULES.significant_change),
    "carts_after_increase": lambda s, d: gold.carts_after_increase(silver(s, d), increases(s, d), RULES.abandonment_minutes),
    "latest_increase": lambda s, d: gold.latest_increase_only(gold.carts_after_increase(silver(s, d), increases(s, d), RULES.abandonment_minutes)),
    "q2_abandoned": lambda s, d: gold.abandoned_carts(silver(s, d), increases(s, d), RULES.abandonment_minutes),
    "q2_report": lambda s, d: gold.abandonment_report(gold.abandoned_carts(silver(s, d), increases(s, d), RULES.abandonment_minutes)),
    "q2_funnel": lambda s, d: gold.abandonment_funnel(silver(s, d), increases(s, d), RULES.abandonment_minutes),
    "dirt_profile": lambda s, d: quality.dirt_profile(fixtures.clickstream(s, d)),
    "quality_rules": quality_rules,
    "batch_id_from_path": batch_id_from_path,
    "day_probe": lambda s, d: layout.day_probe(fixtures.clickstream(s, d), "event_time", 3).select("event_id", "event_time"),
    "q3_drift": q3_drift,
    "audit_reading": audit_reading,
    "time_travel": time_travel,
    "stream_ingest": stream_ingest,
    "partition_skew": partition_skew,
    "float_intervals": lambda s, d: prices.float_intervals(deduped(s, d)),
    "bind_hourly_grid": lambda s, d: layers(s, d).bind(binding.bind_hourly_grid),
    "plain_equals_salted": lambda s, d: layout.same_rows(gold.category_rollup(hourly(s, d)), gold.category_rollup(hourly(s, d), RULES.salt_buckets)),
    "audit_report": lambda s, d: gold.audit_report(hourly(s, d), changed_live(hourly(s, d))),
    "longest_sessions": lambda s, d: sessionized(s, d).groupBy("session_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "session_key").limit(20),
    "latest_per_metric": lambda s, d: evidence.latest_per_metric(measurements(s, d), "acceptance_"),
    "latest_overall": lambda s, d: evidence.latest(measurements(s, d), "acceptance_A3"),
    "acceptance_gate": lambda s, d: evidence.gate(measurements(s, d)).select("id", "status", "kind", "blocks"),
    **{f.__name__: f for f in (
        csv_scan, json_scan, landing_stats, price_feed, completeness, event_log, rescued_profile, table_by_name, catalog_listing, column_statistics,
        optimizer_estimate, client_report, materialized_view, serving_three_ways, evolution_proof, immutability_proof, retention_check, freeze_at, history_guard,
        layout_probe, table_history, last_operation, clean_up_counts, orchestrated_run,
    )},
}


def _pinned(query: Query) -> Query:
    return lambda spark, sf_dir: plain(query(fixtures.pin_utc(spark), sf_dir))


QUERIES: dict[str, Query] = {name: _pinned(query) for name, query in _Q.items()}
