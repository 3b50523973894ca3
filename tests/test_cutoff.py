"""The training frame as of each decline, the split, and the two cut-off jobs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_attempts import COLUMNS, attempt
from tidemark.plans import attempts, boosting, cutoff, scoring
from tidemark.plans.boosting import Boost
from tidemark.sources.scratch import staged
from tidemark.sources.views import view



def date(text):
    return F.lit(text).cast("date")


SMALL = Boost(max_iter=12, depth=3, chunk=4)


def histories(orders=12, invoices=4, seed=5):
    """Invoices of an order follow one another; each has a few declines and perhaps an accepted attempt at its end."""
    random.seed(seed)
    rows, txn = [], 0
    for order in range(1, orders + 1):
        day = random.random()
        for number in range(invoices):
            for retry in range(random.randrange(1, 5)):
                txn, day = txn + 1, day + random.random() * 3
                last = retry and random.random() < 0.3
                rows.append(attempt(order, 100 * order + number, txn, day - 40, retry, "accepted" if last else "declined", random.randrange(1, 90) / 4))
                if last:
                    break
    return rows


@pytest.fixture(scope="module")
def tier(spark):
    return spark.createDataFrame([("b", "low")], "vertical_type_bin string, bin_tier string")


LATER = {"is_eventually_successful", "invoice_start", "invoice_last_txn", "resolved_at"}


def test_states_are_those_scoring_would_have_seen(spark, tier):
    """The row of a past decline equals the scoring table of that moment."""
    rows = histories()
    frame = attempts.training_frame(spark.createDataFrame(rows, COLUMNS), tier, days=5).collect()
    last = max(r[3] for r in rows)
    starts = {}
    for r in rows:
        starts.setdefault(r[:2], r[3])
    mature = {k for k, t in starts.items() if t <= last - dt.timedelta(days=5)}
    assert sorted(r.transaction_id for r in frame) == sorted(r[2] for r in rows if r[5] == "declined" and r[:2] in mature)
    assert len(frame) > 40
    for r in random.sample(frame, 6):
        seen = [x for x in rows if x[3] <= r.transaction_datetime]
        day = F.lit(r.transaction_datetime.date())
        then = attempts.attempt_features(spark.createDataFrame(seen, COLUMNS), tier, day, date("2023-01-01"))
        row = then.filter(F.col("transaction_id") == r.transaction_id).collect()[0].asDict()
        assert {k: v for k, v in row.items() if k not in LATER} == {k: v for k, v in r.asDict().items() if k not in LATER}


def test_labels_are_final(spark, tier):
    rows = histories(seed=6)
    won = {r[:2] for r in rows if r[5] == "accepted"}
    first_paid = {}
    for r in sorted(rows, key=lambda r: r[3]):
        if r[5] == "accepted":
            first_paid.setdefault(r[:2], r[3])
    for r in attempts.training_frame(spark.createDataFrame(rows, COLUMNS), tier, days=5).collect():
        key = (r.order_id, r.invoice_id)
        assert r.is_eventually_successful == (key in won)
        assert r.resolved_at == (first_paid[key] if key in won else r.invoice_start + dt.timedelta(days=5))


def test_a_shared_invoice_id_looks_back_in_its_own_order(spark, tier):
    rows = [attempt(1, 77, 1, 1, 0), attempt(2, 77, 2, 2, 1), attempt(1, 77, 3, 3, 2), attempt(2, 77, 4, 4, 3), attempt(3, 9, 5, 40, 0)]
    got = {r.transaction_id: r for r in attempts.training_frame(spark.createDataFrame(rows, COLUMNS), tier, days=30).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert [got[n].days_since_last_failure for n in (1, 2, 3, 4)] == [-1, -1, 2, 2]
    assert got[2].last_decline_code == "unknown" and got[4].last_decline_code == "05"


def test_split_keeps_orders_together_and_the_latest_invoices_apart(spark, tier):
    frame = attempts.training_frame(spark.createDataFrame(histories(60, 5), COLUMNS), tier, days=3)
    rows = cutoff.split_frame(frame).collect()
    starts = sorted({(r.order_id, r.invoice_id): r.invoice_start for r in rows}.values())
    late = {r.invoice_start for r in rows if r.split == cutoff.OUT_OF_TIME}
    early = {r.invoice_start for r in rows if r.split != cutoff.OUT_OF_TIME}
    assert min(late) > max(early) and sum(s in late for s in starts) == pytest.approx(0.15 * len(starts), abs=1.5)
    sides = {}
    for r in rows:
        if r.split != cutoff.OUT_OF_TIME:
            sides.setdefault(r.order_id, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values()) and len({*map(tuple, sides.values())}) >= 3


def test_training_and_scoring_jobs(spark, tier, tmp_path):
    fact = spark.createDataFrame(histories(80, 5), COLUMNS)
    job = cutoff.train_cutoff(fact, tier, str(tmp_path / "a"), days=3, threshold=0.4, boost=SMALL)
    report = {r.split: r for r in job.report.collect()}
    assert {"train", cutoff.OUT_OF_TIME, cutoff.UNSEEN_ORDERS} <= set(report) and all(r.n_rows > 0 for r in report.values())
    assert job.drift.count() == 1
    assert not {*cutoff.NOT_FEATURES} & {*cutoff.roles(job.parts).names()}
    features = attempts.attempt_features(fact, tier, date("2024-02-10"), date("2023-01-01")).collect()
    out = cutoff.score_cutoff(fact, tier, str(tmp_path / "a"), date("2024-02-10"), date("2023-01-01"), F.expr("TIMESTAMP_NTZ '2024-02-10 00:00:00'")).collect()
    assert sorted(r.transaction_id for r in out) == sorted(str(r.transaction_id) for r in features) and out
    assert sum(r.random_selection for r in out) == len(out) // 10 and all(r.is_cutoff_early is not None for r in out)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_key_of_an_attempt_is_parsed_once_however_often_filters_mention_it(spark, tmp_path):
    rows = [(n, dt.datetime(2024, 1, 20, 3, n), n % 3, "purchase" if n % 2 else "view", 1.5 * n, props) for n, props in enumerate(
        ['{"k": 13}', '{"k": 99}', '{"k": 24}', '{"k": 9}', '{"k": 8}', '{"k": null}', '{"j": 1}', "broken", None, '{"k": 17}', '{"k": 17}'])]
    path = str(tmp_path)
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    fact = view(spark, path, "attempt")
    live = attempts.live_invoices(fact, date("2024-02-10"), date("2023-01-01"))
    assert plan_of(live).count("get_json_object") == 1
    assert plan_of(fact.filter(attempts.extract_filter())).count("get_json_object") == 1
    assert {r.transaction_id: r.retries for r in fact.collect()} == {0: None, 1: 31, 2: 0, 3: 1, 4: 0, 5: None, 6: None, 7: None, 8: None, 9: 1, 10: 1}
    # 99 and 9 are refunds, 13 has no retry number, 24 is cancelled.
    assert sorted(r.transaction_id for r in fact.filter(attempts.extract_filter()).collect()) == [2, 4, 9, 10]
    assert sorted(r.order_id for r in live.collect()) == [0, 1]


def test_the_split_hashes_every_row_once_and_keeps_rows_without_a_start(spark):
    rows = [(o, 10 * o + n, None if (o, n) == (3, 1) else dt.datetime(2024, 1, 1 + o)) for o in range(1, 21) for n in range(2)]
    frame = spark.createDataFrame(rows, "order_id long, invoice_id long, invoice_start timestamp_ntz")
    parts = cutoff.split_frame(frame)
    assert "md5" not in plan_of(parts)
    got = {(r.order_id, r.invoice_id): r.split for r in parts.collect()}
    assert len(got) == 40 and got[3, 31] == got[3, 30] != cutoff.OUT_OF_TIME
    assert {o for (o, _), s in got.items() if s == cutoff.OUT_OF_TIME} == {18, 19, 20}
    assert cutoff.split_frame(frame.limit(0)).collect() == []


def test_training_writes_only_what_trees_read(spark, tier, tmp_path, monkeypatch):
    seen = {}

    def noted(df, name):
        seen[name] = df.columns
        return staged(df, name)

    monkeypatch.setattr(scoring, "staged", noted)
    cutoff.train_cutoff(spark.createDataFrame(histories(40, 4), COLUMNS), tier, str(tmp_path / "a"), days=3, boost=SMALL)
    assert {"split", "is_stop", cutoff.LABEL, *cutoff.TEXT, "retries", "bin_tier_mean"} <= {*seen["ready"]}
    assert not {"order_id", "invoice_id", "transaction_id", "transaction_datetime", "bin_tier", "resolved_at"} & {*seen["ready"]}
    assert seen["calibration"] == ["score", "rate", "weight"]


def test_the_jobs_learn_from_all_rows(spark, tier, tmp_path, monkeypatch):
    """Artifact, report and live probabilities are those of one task that sees all rows."""
    fact = spark.createDataFrame(histories(60, 4), COLUMNS)
    live = staged(cutoff.model_columns(attempts.attempt_features(fact, tier, date("2024-02-10"), date("2023-01-01"))), "live")

    def job(name):
        made = cutoff.train_cutoff(fact, tier, str(tmp_path / name), days=3, boost=Boost(max_iter=3, depth=3, chunk=3))
        numbers = {(r.split, k): v for r in made.report.collect() for k, v in r.asDict().items() if isinstance(v, float)}
        scorer, _ = scoring.load_artifact(spark, str(tmp_path / name))
        numbers |= {r.transaction_id: r.raw_score for r in scorer.score(live).select("transaction_id", "raw_score").collect()}
        return [(t.feature, t.threshold) for t in scorer.trees.trees], numbers

    trees, numbers = job("a")
    monkeypatch.setattr(boosting, "SAMPLE_CELLS", 300)
    again, found = job("b")
    assert again == trees and len(numbers) > 10 and found == pytest.approx(numbers, abs=1e-9, nan_ok=True)
