"""Splits, economics, forecasts and scoring against brute force and their own promises."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.catalog import learning
from tidemark.catalog.registry import Inputs
from tidemark.functions.scalar import hash_fraction
from tidemark.operators import economics as eco
from tidemark.operators import evaluation as ev
from tidemark.operators import splits
from tidemark.plans import attempts, forecast, scoring


def test_hash_fraction_matches_python(spark):
    ids = [1, 42, 99_999]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(hash_fraction(F.col("i"), "s")).collect()]
    assert got == [int(hashlib.md5(f"s:{i}".encode()).hexdigest()[:16], 16) / 2**64 for i in ids]


def test_hash_split_is_stable_when_ids_are_added(spark):
    small, large = spark.range(200).withColumnRenamed("id", "k"), spark.range(1000).withColumnRenamed("id", "k").orderBy(F.rand(1))
    a = {r.k: r.split for r in splits.hash_split(small, "k").collect()}
    b = {r.k: r.split for r in splits.hash_split(large, "k").collect()}
    assert all(b[k] == v for k, v in a.items()) and set(b.values()) == {"train", "stop", "calib", "random_test"}


def test_exact_sample_and_folds(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    assert splits.exact_sample(df, "k", share=0.1).filter("is_sampled").count() == 10
    assert splits.exact_sample(df, "k", n=7).filter("is_sampled").count() == 7
    folds = splits.cv_no_shuffle(df, ["k"], 3).groupBy("fold").agg(F.count("*").alias("n"), F.min("k").alias("a")).orderBy("fold").collect()
    assert [(f.n, f.a) for f in folds] == [(35, 0), (34, 35), (34, 69)]
    roles = splits.fold_roles(df, ["k"], 2, 10, 5).groupBy("fold", "role").agg(F.count("*").alias("n"), F.max("k").alias("b"))
    assert {(r.fold, r.role): (r.n, r.b) for r in roles.collect()} == {
        (1, "train"): (78, 77), (1, "val"): (5, 82), (1, "test"): (10, 92), (2, "train"): (88, 87), (2, "val"): (5, 92), (2, "test"): (10, 102),
    }


def test_samples_are_selected_without_sorting_the_rows(spark):
    """The same rows as by rank in the seeded order, also with repeated ids, odd shares and small cells."""
    rows = [(n % 700, f"g{n % 3}" if n % 50 else None, "payload") for n in range(1500)] + [(5, "g1", "payload")] * 400
    df = spark.createDataFrame(rows, "k long, g string, extra string")
    order = sorted(rows, key=lambda r: (hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]))
    for n in (0, 1, 7, 431, 1200, 1900, 5000):
        got = splits.exact_sample(df, "k", n=n).filter("is_sampled").collect()
        assert sorted(r.k for r in got) == sorted(r[0] for r in order[:n])
    got = splits.stratified_split(df, "g", "k", share=0.37).collect()
    assert len(got) == len(rows)
    for g in ("g0", "g1", "g2", None):
        mine = [r for r in order if r[1] == g]
        assert sorted(r.k for r in got if r.g == g and r.split == "val") == sorted(r[0] for r in mine[: int(len(mine) * 0.37 + 0.5)])
    assert splits.exact_sample(df.limit(0), "k", n=3).count() == 0
    whole = splits.exact_sample(df.dropDuplicates(["k"]).cache(), "k", share=0.1)
    text = whole._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert not any(word in text for word in ("Window", "Sort", "Exchange"))


def test_one_pass_sweep_equals_a_loop(spark, data):
    i = Inputs(spark, data)
    frame = eco.cutoff_frame(attempts.scored_attempts(i.attempt), i.order_cltv)
    pdf = frame.toPandas().sort_values(["order_id", "transaction_datetime", "transaction_id"])
    got = {r.policy: r for r in eco.threshold_sweep(frame).collect()}
    assert set(got) == {f"{t:.2f}" for t in eco.THRESHOLDS if ((pdf.success_probability < t) & (pdf.ecltv_1y < 20)).any()}
    for t in eco.THRESHOLDS:
        cut = pdf[(pdf.success_probability < t) & (pdf.ecltv_1y < 20)].drop_duplicates("order_id")
        if cut.empty:
            continue
        gain = cut.attempts_saved * eco.RETRY_COST
        loss = (cut.cltv_360 - cut.historical_collected_amount).clip(lower=0)
        proj = (cut.ecltv_1y - cut.historical_collected_amount).clip(lower=0).where(cut.future_success == 1, 0)
        r = got[f"{t:.2f}"]
        assert (r.orders_cut, r.false_negatives, r.free_cuts) == (len(cut), (cut.future_success == 1).sum(), (cut.cltv_360 == 0).sum())
        assert r.net_actual == pytest.approx((gain - loss).sum()) and r.net_proj == pytest.approx((gain - proj).sum())


def test_invoice_shared_by_two_orders_does_not_multiply(spark):
    rows = [
        (1, 10, 7, "2024-01-01 00:00:00", "declined", 0, 5.0), (2, 20, 7, "2024-01-02 00:00:00", "accepted", 0, 6.0),
        (3, 10, 7, "2024-01-03 00:00:00", "declined", 1, 5.0),
    ]
    df = spark.createDataFrame(
        rows, "transaction_id long, order_id long, invoice_id long, t string, transaction_status string, retries int, transaction_amount double"
    ).withColumn("transaction_datetime", F.col("t").cast("timestamp_ntz")).withColumn("decline_code", F.lit("x"))
    history = attempts.order_history(attempts.invoice_summary(df))
    assert attempts.attempt_sequence(df, history).count() == 3


def test_resolution_reports_success_without_payment(spark):
    df = spark.createDataFrame([(1, "declined", 1)], "invoice_id int, transaction_status string, is_eventually_successful int").withColumn(
        "transaction_datetime", F.lit("2024-01-01").cast("timestamp_ntz")
    )
    assert attempts.resolution_errors(attempts.invoice_resolution(df)).first()[0] == 1


def months(spark, values, key="s"):
    start = pd.Period("2020-01", "M")
    rows = [(key, (start + n).to_timestamp().date(), float(v)) for n, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, month date, y double")


def test_level_and_holt(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(50, 150, 30).astype(float)
    df = months(spark, y).unionByName(months(spark, y[:3], "short"))
    levels = {(r.k, r.month.strftime("%Y-%m")): r.level for r in forecast.ses_level(df, ["k"]).collect()}
    last = y[-6]
    for v in y[-5:]:
        last = 0.8 * v + 0.2 * last
    assert levels[("s", "2022-06")] == pytest.approx(last)
    assert levels[("short", "2020-01")] == y[0]
    level, trend = y[0], y[1] - y[0]
    for v in y[1:]:
        new = 0.8 * v + 0.2 * (level + trend)
        level, trend = new, 0.2 * (new - level) + 0.8 * trend
    states = [r for r in forecast.holt_states(df, ["k"]).collect() if r.k == "s"]
    end = max(states, key=lambda r: r.month)
    assert (end.level, end.trend, end.history) == (pytest.approx(level), pytest.approx(trend), 30)
    out = forecast.holt_linear(df, ["k"], ahead=5, adjust_from=F.lit("2022-07-01").cast("date"))
    far = [r for r in out.collect() if r.k == "s" and r.horizon == 5][0]
    assert far.forecast == pytest.approx((level + 5 * trend) * 0.9)


def test_seasonal_index_finds_a_known_season(spark):
    season = np.array([0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.2, 1.1, 1.0, 0.9, 0.8, 0.7])
    season = season / season.mean()
    df = months(spark, [100 * season[n % 12] for n in range(48)])
    got = [r.factor for r in forecast.seasonal_index(df, ["k"]).orderBy("month_of_year").collect()]
    assert got == pytest.approx(list(season), abs=0.01) and np.mean(got) == pytest.approx(1.0)


def test_backtest_uses_nothing_after_the_origin(spark):
    y = list(np.random.default_rng(1).integers(50, 150, 30).astype(float))
    factors = forecast.seasonal_index(months(spark, y), ["k"])
    a = forecast.rolling_backtest(months(spark, y), ["k"], factors=factors).filter("month < '2022-05-01'").collect()
    b = forecast.rolling_backtest(months(spark, y[:-3] + [1.0, 1.0, 1.0]), ["k"], factors=factors).filter("month < '2022-05-01'").collect()
    assert {r.month: r.predicted for r in a} == pytest.approx({r.month: r.predicted for r in b}) and len(a) == 20


def test_scorer(spark, data, tmp_path):
    i = Inputs(spark, data.replace("sf0.001", "sf0.01"))
    rows = learning.training_rows(i).cache()
    model = scoring.train_scorer(rows, learning.ROLES, "label", boost=learning.BOOST)
    scored = model.score(rows).cache()
    metrics = {r.split: r for r in ev.eval_split(scored, "success_prob", "label", "split").collect()}
    assert metrics["random_test"].auc > 0.7 and metrics["random_test"].brier < 0.25
    # Calibration keeps the order of the scores.
    pairs = scored.select("raw_score", "success_prob").distinct().toPandas().sort_values("raw_score")
    assert (pairs.success_prob.diff().dropna() >= -1e-9).all()
    scoring.save_artifact(model, str(tmp_path / "a"), {"threshold": 0.05})
    again, spec = scoring.load_artifact(spark, str(tmp_path / "a"))
    back = again.score(rows).select("row_id", F.col("success_prob").alias("p"))
    assert spec["threshold"] == 0.05
    assert scored.join(back, "row_id").filter("abs(success_prob - p) > 1e-12").count() == 0
    assert scoring.banned_columns(learning.ROLES, ["row_id", "label"]) == []
    with pytest.raises(KeyError):
        model.score(rows.drop("score"))
    held = model.pre.apply(rows.filter("split = 'random_test'")).withColumn("o", F.xxhash64("row_id"))
    importance = {r.feature: r.importance for r in scoring.permutation_importance(model.trees, held, model.pre.inputs(), "label", ["o"]).collect()}
    assert max(importance, key=importance.get) == "score" and importance["score"] > 0


def test_score_batch_flags_exactly_a_tenth(spark, data):
    out = learning.decisions(Inputs(spark, data)).cache()
    n = out.count()
    assert n > 0 and out.filter("random_selection").count() == int(n * 0.1)


def test_linear_attribution_is_exact(spark, data):
    rows = learning.training_rows(Inputs(spark, data)).fillna(0, ["retries"])
    contributions, error = scoring.linear_attribution(rows, ["score", "retries"], "label", "row_id")
    assert error.first().max_error < 1e-6
    assert contributions.count() == 2 * rows.count()


def test_daily_forecast(spark, data):
    i = Inputs(spark, data.replace("sf0.001", "sf0.01"))
    out = scoring.daily_forecast(i.daily_call, i.order_item, folds=2, boost=learning.CALL_BOOST)
    future = out.future.collect()
    last = i.daily_call.agg(F.max("call_date")).first()[0]
    assert len(future) == 14 and all(r.predicted_calls >= 0 and r.date > last for r in future)
    report = {r.fold: r for r in out.fold_report.collect()}
    assert set(report) == {1, 2} and all(r.n == 60 and r.mae_share < 1.0 for r in report.values())
    assert out.holdout.count() == 5 and out.trees >= 1


def test_registered_training_has_the_whole_budget():
    """500 to 2,000 trees of depth 3 to 7, patience 50 and more, as in the jobs they stand for."""
    for boost, depth, patience in ((learning.BOOST, 7, 50), (learning.CALL_BOOST, 6, 75)):
        assert (boost.max_iter, boost.depth, boost.patience) == (2000, depth, patience)


def test_without_stop_rows_all_trees_are_grown(spark):
    rows = spark.createDataFrame([(float(n % 7), float(n % 2), False) for n in range(60)], "x double, label double, is_stop boolean")
    pre = scoring.fit_preprocessor(rows, scoring.FeatureRoles(["x"]), "label")
    model = scoring.train_gbt_classifier(rows, pre, "label", boost=scoring.Boost(max_iter=5, depth=2, chunk=2))
    assert len(model.trees) == 5
