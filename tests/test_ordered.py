"""Scans, ranges, quantiles and lookups against brute force, plain and in blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.evaluation import average_precision, max_f1_threshold, roc_auc
from tidemark.operators.ordered import (
    SECOND_US,
    KeySkew,
    TimeRange,
    exact_quantiles,
    lookup_join,
    measure_skew,
    position,
    prefix_scan,
    previous,
    rolling_ranges,
    running_count,
    running_max,
    running_min,
    running_sum,
)


@pytest.fixture(scope="module")
def frame():
    """One key holds a third of all rows; a null key, tied order values and null values occur."""
    rng = np.random.default_rng(7)
    n = 300
    key = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", None], n))
    seconds = np.sort(rng.integers(0, 40, n))
    df = pd.DataFrame({"id": np.arange(n), "k": key, "s": seconds, "x": rng.integers(0, 9, n).astype(float)})
    df.loc[rng.random(n) < 0.1, "x"] = np.nan
    return df


@pytest.fixture
def rows(spark, frame):
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "id long, k string, s long, x double")
    base = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    return df.withColumn("ts", base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s")))


def by_key(frame):
    return [g.sort_values(["s", "id"]) for _, g in frame.groupby(frame.k.fillna("<null>"))]


def expected_scan(frame, reverse):
    out = {}
    for g in by_key(frame):
        g = g.iloc[::-1] if reverse else g
        before = g.x.shift()
        seen = before.notna().cumsum()
        sums = before.fillna(0).cumsum().where(seen > 0)
        for i, (rid, *_) in enumerate(g.itertuples(index=False)):
            vals = g.x.iloc[:i].dropna()
            incl = g.x.iloc[: i + 1].dropna()
            out[rid] = (
                sums.iloc[i], int(seen.iloc[i]), i + 1, before.iloc[i],
                incl.max() if len(incl) else np.nan, vals.min() if len(vals) else np.nan,
            )
    return out


def same(a, b):
    return (a is None or pd.isna(a)) and (b is None or pd.isna(b)) or a == b


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("blocks", [False, True])
def test_prefix_scan(request, rows, frame, reverse, blocks):
    if blocks:
        request.getfixturevalue("hot")
    x = F.col("x")
    scans = {
        "total": running_sum(x), "n": running_count(x), "pos": position(), "prev": previous(x),
        "top": running_max(x, True), "low": running_min(x),
    }
    got = prefix_scan(rows, ["k"], ["ts", "id"], scans, reverse=reverse).collect()
    want = expected_scan(frame, reverse)
    assert len(got) == len(want)
    for r in got:
        found = (r.total, r.n, r.pos, r.prev, r.top, r.low)
        assert all(same(a, b) for a, b in zip(found, want[r.id])), (r.id, found, want[r.id])


def test_measure_skew_lists_only_hot_keys(rows):
    skew = measure_skew(rows, ["k"], "ts", hot_rows=80)
    assert [r.k for r in skew.hot.collect()] == ["hot"]
    assert measure_skew(rows, ["k"], "ts", hot_rows=1000).hot is None


@pytest.mark.parametrize("blocks", [False, True])
def test_rolling_ranges(request, rows, frame, blocks):
    if blocks:
        request.getfixturevalue("hot")
    ranges = {"open": TimeRange(7 * SECOND_US), "closed": TimeRange(8 * SECOND_US, SECOND_US, closed_end=True)}
    got = rolling_ranges(rows, ["k"], "ts", F.col("x"), ranges).collect()
    assert len(got) == len(frame)
    keys = frame.k.fillna("<null>")
    for r in got:
        mine = frame[keys == (r.k or "<null>")]
        for name, inside in (
            ("open", (mine.s >= r.s - 7) & (mine.s < r.s)), ("closed", (mine.s >= r.s - 8) & (mine.s <= r.s - 1)),
        ):
            x = mine[inside].x.dropna()
            assert r[f"{name}_n"] == len(x)
            assert (r[f"{name}_s"] or 0) == x.sum()


@pytest.mark.parametrize("blocks", [False, True])
def test_exact_quantiles(request, rows, frame, blocks):
    if blocks:
        request.getfixturevalue("hot")
    probs = [0.0, 0.1, 0.5, 0.85, 1.0]
    got = {(r.k, r.prob): r.q for r in exact_quantiles(rows, ["k"], "x", probs).collect()}
    for g in by_key(frame):
        key = g.k.iloc[0]
        for p in probs:
            assert got[(key if isinstance(key, str) else None, p)] == pytest.approx(np.quantile(g.x.dropna(), p))


@pytest.mark.parametrize("limit", [10_000, 20])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join(spark, rows, limit, how):
    table = spark.createDataFrame([("hot", 1), ("a", 2), (None, 3)], "k string, v int")
    got = lookup_join(rows, table, ["k"], measure_skew(rows, ["k"], "ts", limit), how)
    want = {"hot": 1, "a": 2, None: 3}
    kept = got.collect()
    assert all(r.v == want.get(r.k) for r in kept)
    assert len(kept) == rows.count() if how == "left" else len(kept) == rows.filter("k IS NULL OR k IN ('hot', 'a')").count()
    with pytest.raises(ValueError):
        lookup_join(rows, table, ["k"], measure_skew(rows, ["k"], "ts", limit), "right")


@pytest.mark.parametrize("blocks", [False, True])
def test_ranking_metrics(request, spark, blocks):
    if blocks:
        request.getfixturevalue("hot")
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    s = np.round(np.clip(0.3 * y + rng.random(200) * 0.7, 0, 1), 1)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert roc_auc(df, "s", "y").first().auc == pytest.approx(np.mean(pairs))
    ap, best, last = 0.0, (-1, None), 0
    for t in sorted(set(s), reverse=True):
        tp, flagged = y[s >= t].sum(), (s >= t).sum()
        ap += (tp - last) / y.sum() * tp / flagged
        last = tp
        f1 = 2 * tp / (flagged + y.sum())
        best = max(best, (round(f1, 12), -t))
    assert average_precision(df, "s", "y").first().average_precision == pytest.approx(ap)
    row = max_f1_threshold(df, "s", "y").first()
    assert (row.f1, row.threshold) == (pytest.approx(best[0]), -best[1])


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert roc_auc(df, "s", "y").first().auc is None


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, ts timestamp_ntz, x double")
    assert prefix_scan(df, ["k"], ["ts"], {"n": position()}).count() == 0
    assert rolling_ranges(df, ["k"], "ts", F.col("x"), {"r": TimeRange(SECOND_US)}).count() == 0
    assert exact_quantiles(df, [], "x", [0.5]).count() == 0


def test_blocks_follow_the_rows_not_the_values(spark, hot):
    """One outlier, NaN, infinity and a plateau: no block holds much more than its share, results are the plain ones."""
    values = [float(n % 50) for n in range(600)] + [7.0] * 1200 + [1e12, float("inf"), float("nan"), None]
    df = spark.createDataFrame(list(enumerate(values)), "id long, x double")
    skew = measure_skew(df, [], "x")
    assert skew.blocks == 7
    scans = {"n": running_count(), "total": running_sum(F.lit(1).cast("decimal(10,2)"))}
    got = prefix_scan(df, [], ["x", "id"], {**scans, "block": running_count(inclusive=True)}, skew)
    plain = prefix_scan(df, [], ["x", "id"], scans, KeySkew([]))
    assert {r.id: (r.n, r.total) for r in got.collect()} == {r.id: (r.n, r.total) for r in plain.collect()}
    sizes = df.repartitionByRange(7, "x", "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 3 * len(values) / 7
