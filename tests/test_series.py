"""Daily and half-hour jobs with a series key: interleaved series give the rows of separate runs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import calls, scoring
from tidemark.plans.boosting import Boost

NAMES = ["north", "south", None]


@pytest.fixture(scope="module")
def tables(spark):
    """Three series of different span and level, one without a name; transactions shared by all."""
    random.seed(4)
    rows, day0 = [], dt.date(2023, 1, 2)
    for s, (first, last, level) in zip(NAMES, ((0, 170, 9), (30, 160, 4), (10, 150, 2))):
        for d in range(first, last):
            busy = level + 3 * ((day0 + dt.timedelta(days=d)).weekday() < 5)
            rows += [(s, day0 + dt.timedelta(days=d))] * (0 if random.random() < 0.05 else random.randrange(busy // 2, busy + 1))
    log = [(s, n, dt.datetime.combine(d, dt.time(random.randrange(5, 18), random.choice([0, 10, 40])))) for n, (s, d) in enumerate(rows)]
    random.shuffle(log)
    items = [(day0 + dt.timedelta(days=random.randrange(170)), None if n % 3 else "x", n % 2) for n in range(900)]
    calls_table = spark.createDataFrame(log, "s string, call_id long, call_start_at timestamp_ntz").withColumn("call_date", F.to_date("call_start_at")).cache()
    items_table = spark.createDataFrame(items, "transaction_date date, cascade_type string, is_m0 int").withColumn("order_date", F.col("transaction_date")).cache()
    return calls_table, items_table


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names) for r in df.collect()), key=str)


def each(table, run):
    """The same job on every series alone, with its name put back."""
    out = []
    for name in NAMES:
        alone = run(table.filter(F.col("s").eqNullSafe(F.lit(name))).drop("s"))
        out += rows_of(alone.withColumn("s", F.lit(name).cast("string")))
    return sorted(out, key=str)


def test_daily_features_of_many_series(tables):
    log, items = tables
    for horizon in (14, 7):
        got = calls.daily_feature_table(log, items, horizon=horizon, ahead=horizon, keys=["s"])
        assert rows_of(got) == each(log, lambda t: calls.daily_feature_table(t, items, horizon=horizon, ahead=horizon))


def test_target_and_future_rows_of_many_series(tables):
    log, items = tables
    assert rows_of(scoring.daily_table(log, items, keys=["s"])) == each(log, lambda t: scoring.daily_table(t, items))
    got = calls.after_the_data(calls.daily_feature_table(log, items, ahead=14, keys=["s"]), log, keys=["s"])
    assert got.count() == 3 * 14
    assert rows_of(got) == each(log, lambda t: calls.after_the_data(calls.daily_feature_table(t, items, ahead=14), t))


def test_volumes_with_the_series_key_are_its_own(tables):
    log, items = tables
    keyed = items.withColumn("s", F.when(F.col("is_m0") == 1, "north"))
    got = calls.daily_feature_table(log, keyed, keys=["s"])
    for name in NAMES:
        own = F.col("s").eqNullSafe(F.lit(name))
        want = calls.daily_feature_table(log.filter(own).drop("s"), keyed.filter(own).drop("s"))
        assert rows_of(got.filter(own).drop("s")) == rows_of(want)


def test_half_hours_of_many_series(tables):
    log, _ = tables
    asof = F.to_date("call_date")
    got = calls.intraday_profile(log, asof, keys=["s"])
    assert rows_of(got) == each(log, lambda t: calls.intraday_profile(t, asof))
    totals = calls.slot_shares(log, ["s"]).groupBy("s", "call_date").agg(F.sum("pct_of_daily_volume").alias("p")).collect()
    assert all(r.p == pytest.approx(100.0) for r in totals) and len({r.s for r in totals}) == 3
    daily = log.groupBy("s", F.date_add("call_date", 7).alias("date")).agg(F.count(F.lit(1)).alias("predicted_calls"))
    spread = calls.intraday_allocate(daily, got, ["s"])
    want = []
    for name in NAMES:
        own = F.col("s").eqNullSafe(F.lit(name))
        want += rows_of(calls.intraday_allocate(daily.filter(own).drop("s"), got.filter(own).drop("s")).withColumn("s", F.lit(name).cast("string")))
    assert rows_of(spread) == sorted(want, key=str)


def test_folds_are_cut_by_date(spark):
    from tidemark.operators.splits import fold_roles, linear_recency_weight

    rows = spark.sql("SELECT date_add(DATE '2024-01-01', CAST(d AS INT)) AS date, s FROM range(40) t(d), VALUES ('a'), ('b') v(s) WHERE d < 35 OR s = 'a'")
    roles = fold_roles(rows, ["date"], 2, 8, 4, by="date").groupBy("fold", "date").agg(F.count_distinct("role").alias("n"), F.first("role").alias("role"))
    assert roles.filter("n > 1").count() == 0 and roles.filter("role = 'test'").count() == 16
    weights = linear_recency_weight(rows, ["date"], by="date").groupBy("date").agg(F.count_distinct("sample_weight").alias("n"), F.max("sample_weight").alias("w"))
    assert weights.agg(F.max("n"), F.min("w"), F.max("w")).first() == (1, 1.0, 5.0)


def test_one_model_for_many_series(tables):
    """Predictions for the days of every series, closer than the mean of its week, with its own level."""
    log, items = tables
    made = scoring.daily_forecast(log, items, folds=2, test=20, val=10, boost=Boost(depth=3, patience=15, chunk=8), keys=["s"])
    future = made.future.collect()
    table = calls.after_the_data(scoring.daily_table(log, items, ahead=14, keys=["s"]), log, keys=["s"])
    known = table.dropna(subset=["anchor_7d", "dow_historical_ratio_14d"]).count()
    assert {r.s for r in future} == set(NAMES) and len(future) == known > 30 and all(r.predicted_calls >= 0 for r in future)
    level = {name: sum(r.predicted_calls for r in future if r.s == name) for name in NAMES}
    assert level["north"] > level["south"] > level[None]
    report = {(r.fold, r.s): r for r in made.fold_report.collect()}
    assert {f for f, _ in report} == {1, 2} and all(r.mae_share < 1 for r in report.values())
    assert made.folds.filter("trees < 1").count() == 0 and made.trees >= 1


def test_series_effects_leave_the_own_days_out(spark):
    rows = [(f"s{n % 40}", dt.date(2024, 1, 1) + dt.timedelta(days=n // 40), random.random()) for n in range(2000)]
    fit = spark.createDataFrame(rows, "series string, date date, target_ratio double")
    effects = scoring.series_effects(fit)
    assert abs(effects.apply(fit, F.lit(True)).corr("series_mean", "target_ratio")) < 0.1
