"""The rules of intervals, sessions and bindings on hand-made rows."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import binding, prices, sessions

T0 = datetime(2024, 1, 1, 10)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def seen(spark, *rows):
    return spark.createDataFrame([(p, at(s), float(price)) for p, s, price in rows], "product_id string, event_time timestamp, price double")


def held(spark, *rows, noise=1):
    return sorted(prices.price_intervals(prices.priced_events(seen(spark, *rows)), noise).collect(), key=lambda r: (r.product_id, r.effective_start))


@pytest.mark.parametrize("prices_, n", [((100.00, 99.99), 1), ((10.00, 9.99), 1), ((10.00, 9.98), 2), ((10.00, 9.99, 9.98), 1)])
def test_one_cent_is_noise(spark, prices_, n):
    got = held(spark, *[("a", 60 * i, p) for i, p in enumerate(prices_)])
    assert len(got) == n
    assert got[0].price == Decimal(str(prices_[0])).quantize(Decimal("0.01"))


def test_reasons_and_ends(spark):
    got = held(spark, ("a", 0, 10), ("a", 60, 12), ("a", 120, 9))
    assert [r.change_reason for r in got] == ["initial", "increase", "decrease"]
    assert [r.effective_end for r in got] == [at(60), at(120), None]
    assert got[1].pct_change == pytest.approx(0.2)


def test_prices_of_one_instant_leave_no_empty_interval(spark):
    rows = [("a", 0, 5), ("a", 0, 9), ("a", 60, 5)]
    for order in (rows, rows[::-1]):
        got = held(spark, *order)
        assert [(r.price, r.effective_start, r.effective_end) for r in got] == [(Decimal("9.00"), at(0), at(60)), (Decimal("5.00"), at(60), None)]


def test_no_price_is_no_observation(spark):
    rows = spark.createDataFrame([("a", T0, 0.0), ("a", T0, None), (None, T0, 1.0), ("a", None, 1.0)], "product_id string, event_time timestamp, price double")
    assert prices.priced_events(rows).count() == 0


def test_replay_bound_is_exclusive(spark):
    rows = spark.createDataFrame([(T0,), (T0 + timedelta(days=2) - timedelta(microseconds=1),), (T0 + timedelta(days=2),), (None,)], "event_time timestamp")
    assert prices.replay_window(rows, 2).count() == 2


def test_micro_batch_start(spark):
    row = prices.micro_batches(spark.createDataFrame([(datetime(2024, 1, 1, 10, 7, 59),)], "event_time timestamp"), 5).first()
    assert (row.dt, row.hh, row.min5) == ("2024-01-01", "10", "05")


EVENT = "event_time timestamp, event_type string, product_id string, user_id string, price double, user_session string, category_id string, category_code string, brand string, ingested_at timestamp, src_file string"


def event(s, user="u", kind="view", product="p", price=1.0, ingested=0, file="f", session="x"):
    return (at(s), kind, product, user, price, session, None, None, None, at(ingested), file)


def test_dedup_does_not_depend_on_order(spark):
    rows = [event(0, price=2.0), event(0, price=1.0), event(0, price=3.0, ingested=-5), event(0, price=1.5, file="a")]
    for order in (rows, rows[::-1]):
        assert [r.price for r in sessions.deduplicate(spark.createDataFrame(order, EVENT)).collect()] == [1.0]


def test_session_gap_is_inclusive_and_per_user(spark):
    rows = spark.createDataFrame([event(0), event(1800), event(3601), event(1, user="v")], EVENT)
    got = {(r.user_id, r.event_time): r.session_key for r in sessions.sessionize(rows, 1800).collect()}
    assert got == {("u", at(0)): "u#1", ("u", at(1800)): "u#1", ("u", at(3601)): "u#2", ("v", at(1)): "v#1"}


def intervals_of(spark, *rows):
    return spark.createDataFrame([("p", Decimal(p), at(s), None if e is None else at(e)) for p, s, e in rows], "product_id string, price decimal(12,2), effective_start timestamp, effective_end timestamp")


BINDINGS = [binding.bind_broadcast, binding.bind_naive, binding.bind_binned, binding.bind_asof, binding.bind]


@pytest.mark.parametrize("how", BINDINGS)
def test_bindings(spark, how):
    clicks = sessions.sessionize(spark.createDataFrame([event(s) for s in (-1, 0, 99, 100, 5000)], EVENT), 1800)
    closed = prices.closed_intervals(intervals_of(spark, ("10.00", 0, 100), ("8.00", 100, None)), clicks)
    got = {r.event_time: r.catalog_price for r in how(clicks, closed).collect()}
    ten, eight = Decimal("10.00"), Decimal("8.00")
    assert got == {at(-1): None, at(0): ten, at(99): ten, at(100): eight, at(5000): eight}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 9000), st.integers(1, 5)), min_size=1, max_size=25))
def test_intervals_tile_time_and_bindings_agree(spark, rows):
    events = spark.createDataFrame([event(s, product=p, price=float(c)) for p, s, c in rows], EVENT)
    clicks = sessions.sessionize(sessions.deduplicate(events), 1800)
    derived = prices.price_intervals(prices.priced_events(clicks), 1)
    by_product = {}
    for r in sorted(derived.collect(), key=lambda r: r.effective_start):
        by_product.setdefault(r.product_id, []).append(r)
    for rows_ in by_product.values():
        assert [r.effective_end for r in rows_[:-1]] == [r.effective_start for r in rows_[1:]]
        assert rows_[-1].effective_end is None
    closed = prices.closed_intervals(derived, clicks)
    first = binding.bind_broadcast(clicks, closed)
    for how in (binding.bind_binned, binding.bind_asof):
        assert binding.agreement(first, how(clicks, closed)).first().disagreements == 0


def test_agreement_counts_null_keys_and_prices_as_equal(spark):
    rows = spark.createDataFrame([(T0, "u", None, "view", None)], "event_time timestamp, user_id string, product_id string, event_type string, catalog_price decimal(12,2)")
    assert binding.agreement(rows, rows).first().disagreements == 0
    other = rows.withColumn("catalog_price", F.lit(1).cast("decimal(12,2)"))
    assert binding.agreement(rows, other).first().disagreements == 1


def test_latest_version_wins(spark):
    rows = spark.createDataFrame(
        [("p", 1.0, T0, None, T0, "a"), ("p", 2.0, T0, None, at(5), "a"), ("p", 3.0, T0, T0, at(5), "a")],
        "product_id string, price double, effective_start timestamp, effective_end timestamp, ingested_at timestamp, src_file string",
    )
    assert [r.price for r in prices.latest_intervals(rows).collect()] == [Decimal("2.00")]
