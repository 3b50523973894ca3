"""Metrics, threshold tables, drift and profiles, all as grouped aggregates.

Ranking metrics first count rows per distinct score, so the ordered step works on distinct
scores, and it is a ``prefix_scan``, which splits a segment that is too large for one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cleaning import detect_numeric, long_form
from tidemark.operators.ordered import (
    KeySkew,
    exact_quantiles,
    lookup_join,
    measure_skew,
    micros,
    prefix_scan,
    running_sum,
)
from tidemark.sources.scratch import checked

EPS = 1e-15


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe join on keys that keeps one copy of them. Without keys, right is a single row."""
    if not keys:
        row = right.select(F.struct(*right.columns)).scalar()
        return left.withColumn("__row", row).select(*left.columns, "__row.*")
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__k_{k}" for k in keys])


def score_counts(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(F.sum(F.col(label)).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    )


def score_skew(df: DataFrame, keys: list[str], score: str) -> KeySkew:
    """Segments with many rows; counted before the distinct scores are."""
    return measure_skew(df.select(*keys, score), keys, score)


def roc_auc(df: DataFrame, score: str, label: str, keys: list[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties counted half; null with a single class."""
    keys = list(keys)
    counts = score_counts(df, keys, score, label)
    ranked = prefix_scan(counts, keys, ["score"], {"below": running_sum(F.col("neg"))}, score_skew(df, keys, score))
    wins = F.sum(F.col("pos") * (F.coalesce(F.col("below"), F.lit(0.0)) + F.col("neg") / 2))
    return ranked.groupBy(*keys).agg(
        F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"),
        (F.sum("pos") + F.sum("neg")).cast("long").alias("n"),
        F.sum("pos").cast("long").alias("positives"),
    )


def average_precision(df: DataFrame, score: str, label: str, keys: list[str] = ()) -> DataFrame:
    """Step-wise area under the precision-recall curve."""
    keys = list(keys)
    curve = precision_recall(df, score, label, keys)
    return curve.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos")).alias("average_precision")
    )


def precision_recall(df: DataFrame, score: str, label: str, keys: list[str] = ()) -> DataFrame:
    """Per distinct score as threshold: true and false positives, precision."""
    keys = list(keys)
    counts = score_counts(df, keys, score, label)
    ranked = prefix_scan(
        counts, keys, ["score"],
        {"tp": running_sum(F.col("pos"), True), "fp": running_sum(F.col("neg"), True)}, score_skew(df, keys, score), reverse=True,
    )
    return ranked.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))


def log_loss_of(score: Column, label: Column) -> Column:
    p = F.greatest(F.least(score, F.lit(1 - EPS)), F.lit(EPS))
    return F.avg(F.when(label == 1, -F.log(p)).when(label == 0, -F.log(1 - p)))


def brier_of(score: Column, label: Column) -> Column:
    return F.avg((score - label) * (score - label))


def obs_exp_of(score: Column, label: Column) -> Column:
    """Mean prediction over base rate."""
    return F.avg(score) / F.greatest(F.avg(label), F.lit(1e-12))


def eval_split(df: DataFrame, score: str, label: str, split: str) -> DataFrame:
    """All metrics per split on rows with a known label; a split without labels is reported as such."""
    s, y = F.col(score), F.col(label)
    known = F.when(y.isNotNull(), s)
    simple = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(y).alias("n_labelled"),
        F.avg(y.cast("double")).alias("base_rate"),
        log_loss_of(known, y).alias("log_loss"),
        brier_of(known, y).alias("brier"),
        (F.avg(known) / F.greatest(F.avg(y), F.lit(1e-12))).alias("obs_exp"),
        (F.count(y) == 0).cast("int").alias("no_labels"),
    )
    auc = roc_auc(df, score, label, [split]).select(split, "auc")
    ap = average_precision(df, score, label, [split])
    return join_keys(join_keys(simple, auc, [split]), ap, [split])


def degradation(metrics: DataFrame, split: str, reference: str, future: str, train: str) -> DataFrame:
    """Drop in AUC from the random to the future test set, base-rate shift and alarms."""

    def of(name, column):
        return F.max(F.when(F.col(split) == name, F.col(column)))

    out = metrics.agg(
        (of(reference, "auc") - of(future, "auc")).alias("auc_drop"),
        (of(future, "base_rate") / F.greatest(of(train, "base_rate"), F.lit(1e-12))).alias("rate_shift"),
        F.greatest(of(reference, "auc"), of(future, "auc")).alias("top_auc"),
    )
    # Accepted band of the shift, alarm level of the AUC.
    return out.select(
        "auc_drop", "rate_shift",
        (~F.col("rate_shift").between(0.7, 1.4)).cast("int").alias("rate_warning"),
        (F.col("top_auc") > 0.99).cast("int").alias("leak_alert"),
    )


def max_f1_threshold(df: DataFrame, score: str, label: str, keys: list[str] = ()) -> DataFrame:
    """Threshold with the best F1; of equal ones the lowest."""
    keys = list(keys)
    curve = precision_recall(df, score, label, keys)
    totals = curve.groupBy(*keys).agg(F.sum("pos").alias("__p"))
    curve = join_keys(curve, totals, keys)
    recall = F.col("tp") / F.col("__p")
    f1 = 2 * F.col("precision") * recall / F.greatest(F.col("precision") + recall, F.lit(1e-12))
    best = F.max(F.struct(F.round(f1, 12).alias("f1"), (-F.col("score")).alias("s")))
    return curve.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.s")).alias("threshold"), F.col("b.f1").alias("f1"))


def confusion_counts(predicted: Column, label: Column) -> list[Column]:
    return [
        F.count_if((label == 0) & ~predicted).alias("tn"),
        F.count_if((label == 0) & predicted).alias("fp"),
        F.count_if((label == 1) & ~predicted).alias("fn"),
        F.count_if((label == 1) & predicted).alias("tp"),
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, shares and lift from tn/fp/fn/tp; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns(
        {
            "flagged_share": ratio(tp + fp, n),
            "precision": precision,
            "recall": recall,
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "lift": precision / F.greatest(ratio(tp + fn, n), F.lit(1e-12)),
        }
    )


def confusion(df: DataFrame, score: str, label: str, threshold: float, keys: list[str] = ()) -> DataFrame:
    predicted = F.col(score) >= threshold
    return with_rates(df.groupBy(*keys).agg(*confusion_counts(predicted, F.col(label))))


def order_confusion(df: DataFrame, key: str, score: str, label: str, threshold: float) -> DataFrame:
    """Counts of keys: a good key is lost if any row is below the threshold, a bad one kept if any is not."""
    per_key = df.groupBy(key).agg(
        F.max(label).alias("y"),
        F.bool_or(F.col(score) < threshold).alias("any0"),
        F.bool_or(F.col(score) >= threshold).alias("any1"),
    )
    y = F.col("y")
    return per_key.agg(
        F.count_if((y == 0) & ~F.col("any1")).alias("tn"),
        F.count_if((y == 0) & F.col("any1")).alias("fp"),
        F.count_if((y == 1) & F.col("any0")).alias("fn"),
        F.count_if((y == 1) & ~F.col("any0")).alias("tp"),
    )


# Review rates and reported percentiles.
REVIEW_RATES = [0.001, 0.005, 0.01, 0.05, 0.10]
BOTTOM_PERCENTILES = [5, 10, 15, 20, 25, 30, 35, 40]


def counts_at(df: DataFrame, score: str, label: str, cuts: DataFrame, above: bool) -> DataFrame:
    """Rows and positives at or beyond each cut of a small table (id, cut): a scan over distinct scores."""
    counts = score_counts(df, [], score, label).select(
        "score", F.col("pos").alias("p"), (F.col("pos") + F.col("neg")).alias("c")
    )
    marks = cuts.select(F.col("cut").alias("score"), F.lit(0.0).alias("p"), F.lit(0.0).alias("c"), F.col("id"))
    # At equal scores the cut comes last in the direction of the scan, so its own score counts.
    both = counts.withColumn("id", F.lit(None).cast("double")).unionByName(marks)
    both = both.withColumn("__mark", F.col("id").isNotNull().cast("int") * (-1 if above else 1))
    scanned = prefix_scan(
        both, [], ["score", "__mark"],
        {"positives": running_sum(F.col("p"), True), "n": running_sum(F.col("c"), True)}, score_skew(df, [], score), reverse=above,
    )
    return scanned.filter("id IS NOT NULL").select(
        "id", F.col("score").alias("cut"), F.col("n").cast("long"), F.col("positives").cast("long")
    )


def capture_at_rates(df: DataFrame, score: str, label: str, rates=REVIEW_RATES, min_rows: int = 20) -> DataFrame:
    """Precision, recall and lift when the top share is reviewed. Rates that flag fewer than
    ``min_rows`` rows or the same rows as a lower rate are left out."""
    cuts = exact_quantiles(df, [], score, [1 - r for r in rates]).select(
        F.round(1 - F.col("prob"), 6).alias("id"), F.col("q").alias("cut")
    )
    at = counts_at(df, score, label, cuts, above=True).filter(F.col("n") >= min_rows)
    at = at.groupBy("n").agg(F.min(F.struct("id", "cut", "positives")).alias("x")).select("n", "x.*")
    total = df.agg(F.struct(F.sum(label).alias("p"), F.avg(label).alias("rate"))).scalar()
    precision = F.col("positives") / F.col("n")
    return at.select(
        F.col("id").alias("rate"), F.col("cut").alias("threshold"), "n", precision.alias("precision"),
        (F.col("positives") / total["p"]).alias("recall"),
        (precision / F.greatest(total["rate"], F.lit(1e-12))).alias("lift"),
    )


def bottom_percentile_table(df: DataFrame, score: str, label: str, percentiles=BOTTOM_PERCENTILES) -> DataFrame:
    """Rows at or below each percentile: count, share of negatives, positives lost, negatives found."""
    cuts = exact_quantiles(df, [], score, [p / 100 for p in percentiles]).select(
        F.round(F.col("prob") * 100, 6).alias("id"), F.col("q").alias("cut")
    )
    at = counts_at(df, score, label, cuts, above=False)
    tn = F.col("n") - F.col("positives")
    return at.select(
        F.col("id").cast("int").alias("percentile"), "n", (tn / F.col("n")).alias("precision"),
        F.col("positives").alias("fn"), tn.alias("tn"),
    )


def percentile_rank_pct(df: DataFrame, value: str, out: str = "percentile_rank") -> DataFrame:
    """Average rank of equal values as a percentage of all rows.

    Ranks are computed per distinct value and looked up for each row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranked = prefix_scan(counts, [], ["__v"], {"__upto": running_sum(F.col("__c"), True)}, score_skew(df, [], value))
    n = counts.agg(F.sum("__c")).scalar()
    ranked = ranked.select(
        F.col("__v").alias(value), ((F.col("__upto") - F.col("__c") + (F.col("__c") + 1) / 2) / n * 100).alias(out)
    )
    # A plateau of equal scores may hold most rows.
    return lookup_join(df, ranked, [value], measure_skew(df.select(value), [value], value))


def quantile_buckets(df: DataFrame, value: str, n: int, keys: list[str] = (), out: str = "bucket_idx") -> DataFrame:
    """Right-closed quantile buckets 1..m; equal edges merge, the first includes the lowest value.

    Null for missing values; with a single edge left, every value is in bucket 1 (raw value).
    """
    keys = list(keys)
    probs = [i / n for i in range(n + 1)]
    edges = exact_quantiles(df, keys, value, probs).groupBy(*keys).agg(
        F.array_sort(F.collect_set("q")).alias("__edges")  # n + 1 numbers
    )
    if keys:  # one row per key; a report has one key per column
        edges, side = checked(edges, "edges")
        edges = side(edges)
    joined = join_keys(df, edges, keys)
    v, e = F.col(value), F.col("__edges")
    below = F.size(F.filter(e, lambda x: x < v))
    return joined.withColumn(out, F.when(v.isNotNull(), F.greatest(below, F.lit(1)))).withColumn(
        "bucket_low", F.when(v.isNotNull(), F.get(e, F.col(out) - 1))
    ).withColumn("bucket_high", F.when(v.isNotNull(), F.coalesce(F.get(e, F.col(out)), F.get(e, F.lit(0))))).drop("__edges")


def segment_auc(df: DataFrame, score: str, label: str, segment: str) -> DataFrame:
    """AUC per segment; null for segments with one class only."""
    return roc_auc(df, score, label, [segment]).withColumn("single_class", F.col("auc").isNull().cast("int"))


def reject_breakdown(df: DataFrame, seller: str, label: str, predicted: Column) -> DataFrame:
    """Rejected rows per seller: rightly and wrongly."""
    rejected = df.filter(~predicted)
    return rejected.groupBy(seller).agg(
        F.count_if(F.col(label) == 0).alias("true_negatives"),
        F.count_if(F.col(label) == 1).alias("false_negatives"),
        F.count_if(F.col(label).isin(0, 1)).alias("total_rejected"),
    )


def regression_errors(df: DataFrame, actual: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    a, e = F.col(actual), F.col(predicted) - F.col(actual)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum(e), F.sum(a)).alias("bias"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.try_divide(F.sum(F.abs(e)), F.sum(a)).alias("wmape"),
        F.try_divide(F.avg(F.abs(e)), F.avg(a)).alias("mae_share"),
    )


def worst_rows(df: DataFrame, actual: str, predicted: str, tie: str, n: int = 5) -> DataFrame:
    """The n largest absolute errors."""
    error = F.col(predicted) - F.col(actual)
    return df.withColumns({"error": error, "abs_error": F.abs(error)}).orderBy(F.col("abs_error").desc(), tie).limit(n)


# --------------------------------------------------------------------------- leakage audit


def univariate_auc_scan(
    train: DataFrame, numeric: list[str], categorical: list[str], label: str, stop: DataFrame | None = None
) -> DataFrame:
    """How well one column alone ranks the label: max(auc, 1 - auc), above 0.95 suspect.

    Numbers are scored on train. Categories get the mean label of train and are scored on
    ``stop``; unseen levels get the prior. All columns are scored in one pass each.
    """
    parts = []
    if numeric:
        parts.append(roc_auc(long_form(train, numeric, [label], "double"), "value", label, ["feature"]))
    if categorical:
        prior = train.agg(F.avg(label)).scalar()
        enc = long_form(train, categorical, [label], "string").groupBy("feature", "value").agg(F.avg(label).alias("__m"))
        enc, side = checked(enc, "means")
        cells = join_keys(long_form(stop, categorical, [label], "string"), side(enc), ["feature", "value"])
        cells = cells.withColumn("__m", F.coalesce("__m", prior))
        parts.append(roc_auc(cells, "__m", label, ["feature"]))
    out = reduce(DataFrame.unionByName, parts)
    best = F.greatest(F.col("auc"), 1 - F.col("auc"))
    return out.select("feature", best.alias("auc"), (best > 0.95).cast("int").alias("suspect"))


def vector_resolution(train: DataFrame, features: list[str], label: str) -> DataFrame:
    """Distinct feature vectors, rows per vector, share of ambiguous rows and the error floor."""
    g = train.groupBy(*features).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("n1"))
    mixed = (F.col("n1") > 0) & (F.col("n1") < F.col("n"))
    return g.agg(
        F.count(F.lit(1)).alias("vectors"),
        (F.sum("n") / F.count(F.lit(1))).alias("rows_per_vector"),
        (F.sum(F.when(mixed, F.col("n")).otherwise(0)) / F.sum("n")).alias("ambiguous_share"),
        (F.sum(F.least(F.col("n1"), F.col("n") - F.col("n1"))) / F.sum("n")).alias("error_floor"),
    )


def vector_overlap(test: DataFrame, train: DataFrame, features: list[str]) -> DataFrame:
    """Share of test rows whose feature vector is found in train."""
    vectors = test.groupBy(*features).agg(F.count(F.lit(1)).alias("n"))
    known = train.select(*features).distinct().withColumn("__hit", F.lit(1))
    joined = join_keys(vectors, known, features)
    return joined.agg((F.sum(F.col("n") * F.coalesce("__hit", F.lit(0))) / F.sum("n")).alias("overlap_share"))


def near_constant(df: DataFrame, features: list[str], above: float = 0.90) -> DataFrame:
    """Features whose most frequent value (null counted) covers more than ``above`` of the rows."""
    counts = long_form(df, features, [], "string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("top_share")).filter(F.col("top_share") > above)


# --------------------------------------------------------------------------- drift and profiles


def numeric_drift(df: DataFrame, features: list[str], recent: Column) -> DataFrame:
    """Mean before and in the recent window, sentinel -1 left out, and the shift in percent."""
    cells = long_form(df.withColumn("__recent", recent), features, ["__recent"], "double").filter("value <> -1")
    out = cells.groupBy("feature").agg(
        F.avg(F.when(~F.col("__recent"), F.col("value"))).alias("historical"),
        F.avg(F.when(F.col("__recent"), F.col("value"))).alias("recent"),
    )
    return out.withColumn("shift_pct", F.try_divide(F.col("recent") - F.col("historical"), F.col("historical")) * 100)


def categorical_drift(df: DataFrame, features: list[str], label: str, recent: Column, top: int = 3) -> DataFrame:
    """Label rate then and now of the ``top`` most frequent historical values of each feature."""
    cells = long_form(df.withColumn("__recent", recent), features, ["__recent", label], "string").filter("value IS NOT NULL")
    now = F.col("__recent")
    rates = cells.groupBy("feature", "value").agg(
        F.count_if(~now).alias("n_historical"),
        (F.coalesce(F.avg(F.when(~now, F.col(label))), F.lit(0.0)) * 100).alias("historical_rate"),
        (F.coalesce(F.avg(F.when(now, F.col(label))), F.lit(0.0)) * 100).alias("recent_rate"),
    ).filter("n_historical > 0")
    w = Window.partitionBy("feature").orderBy(F.col("n_historical").desc(), "value")
    return rates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def profile_categorical(
    df: DataFrame, features: list[str], group: Column, min_n: int = 20, min_share: float = 0.02
) -> DataFrame:
    """Values over-represented in a group: lift = share in the group over share in the rest.

    Infinite when the rest has none.
    """
    marked = df.withColumn("__g", group.cast("int"))
    cells = long_form(marked, features, ["__g"], "string").withColumn("value", F.coalesce("value", F.lit("(missing)")))
    counts = cells.groupBy("feature", "value").agg(
        F.sum("__g").alias("n_group"), F.sum(1 - F.col("__g")).alias("n_rest")
    )
    sizes = marked.agg(F.struct(F.sum("__g").alias("g"), F.sum(1 - F.col("__g")).alias("r"))).scalar()
    share, rest = F.col("n_group") / sizes["g"], F.col("n_rest") / sizes["r"]
    kept = counts.filter((F.col("n_group") >= min_n) & (share >= min_share))
    return kept.select(
        "feature", "value", "n_group", (100 * share).alias("group_pct"), (100 * rest).alias("rest_pct"),
        F.when(rest == 0, F.lit(float("inf"))).otherwise(F.try_divide(share, rest)).alias("lift"),
    )


def profile_numeric(df: DataFrame, features: list[str], group: Column) -> DataFrame:
    """Medians and means in the group and in the rest, and their standardised difference."""
    cells = long_form(df.withColumn("__g", group), features, ["__g"], "double").filter("value IS NOT NULL")
    medians = exact_quantiles(cells, ["feature", "__g"], "value", [0.5]).groupBy("feature").agg(
        F.max(F.when(F.col("__g"), F.col("q"))).alias("group_median"),
        F.max(F.when(~F.col("__g"), F.col("q"))).alias("rest_median"),
    )
    means = cells.groupBy("feature").agg(
        F.avg(F.when(F.col("__g"), F.col("value"))).alias("group_mean"),
        F.avg(F.when(~F.col("__g"), F.col("value"))).alias("rest_mean"),
        F.stddev_samp("value").alias("__sd"),
    )
    diff = F.col("group_mean") - F.col("rest_mean")
    return means.join(medians, "feature").select(
        "feature", "group_median", "rest_median", "group_mean", "rest_mean",
        F.when(F.col("__sd") > 0, diff / F.when(F.col("__sd") > 0, F.col("__sd"))).otherwise(0.0).alias("std_diff"),
    )


def as_instant(df: DataFrame, column: str) -> Column:
    """Microseconds of a date, a timestamp (its wall clock) or a text that reads as one; null for anything else."""
    kind = dict(df.dtypes)[column]
    c = F.col(f"`{column}`")
    if kind == "string":
        c = F.try_to_timestamp(F.trim(c)).cast("timestamp_ntz")
    elif kind in ("date", "timestamp"):
        c = c.cast("timestamp_ntz")
    elif kind != "timestamp_ntz":
        return F.lit(None).cast("long")
    return micros(c)


def attribute_kinds(df: DataFrame, columns: list[str], least: float = 0.80) -> dict[str, str]:
    """numeric, datetime or categorical per column, by the share of its values that read as such, from one aggregate over
    all columns. Columns without a value are left out."""
    found = detect_numeric(df, columns, least, dates=True).collect()  # one row per column
    return {r["column_name"]: r["kind"] for r in found if r["n_valid"]}


def day_of(instant: Column) -> Column:
    """The day of an instant in microseconds, as text, whatever the session's time zone."""
    day = F.floor(instant / F.lit(86_400_000_000.0)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd")


def attributes_report(
    df: DataFrame, columns: list[str], label: str, partner: Column, bins: int = 8, max_levels: int = 30, min_n: int = 1, least: float = 0.80
) -> DataFrame:
    """``attribute_conversion`` of columns whose kind is found from their values; what doesn't read as the kind is missing."""
    kinds = attribute_kinds(df, columns, least)
    of = {kind: [c for c, k in kinds.items() if k == kind] for kind in ("numeric", "categorical", "datetime")}
    plain = df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in of["numeric"]} | {c: F.col(f"`{c}`").cast("string") for c in of["categorical"]})
    return attribute_conversion(plain, of["numeric"], of["categorical"], label, partner, bins, max_levels, min_n, of["datetime"])


def attribute_conversion(
    df: DataFrame, numeric: list[str], categorical: list[str], label: str, partner: Column,
    bins: int = 8, max_levels: int = 30, min_n: int = 1, datetimes: list[str] = (),
) -> DataFrame:
    """Conversion per attribute and bucket, next to one partner's in the same buckets.

    Numbers fall into quantile buckets, categories into their most frequent levels, dates and times into
    quantile buckets of their instants named by the days of the edges; buckets of one name are one bucket.
    """
    base = df.withColumns({"__y": F.col(label), "__p": F.coalesce(partner, F.lit(False)).cast("int")})
    totals = base.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("rate"))).scalar()
    measures = [
        F.count(F.lit(1)).alias("n"), F.sum("__y").alias("m0"),
        F.sum("__p").alias("n_p"), F.sum(F.col("__y") * F.col("__p")).alias("m0_p"),
    ]
    parts = []
    if numeric:
        cells = quantile_buckets(long_form(base, numeric, ["__y", "__p"], "double"), "value", bins, ["feature"])
        cells = cells.withColumn("bucket_idx", F.coalesce("bucket_idx", F.lit(999)))
        g = cells.groupBy("feature", "bucket_idx").agg(
            *measures, F.max("bucket_low").alias("bucket_low"), F.max("bucket_high").alias("bucket_high")
        )
        label_text = F.when(F.col("bucket_idx") == 999, "(Missing)").otherwise(
            F.concat(F.lit("bucket "), F.lpad(F.col("bucket_idx").cast("string"), 2, "0"))
        )
        parts.append(g.withColumns({"bucket": label_text, "type": F.lit("numeric")}))
    if datetimes:
        instants = base.select("__y", "__p", *[as_instant(base, c).cast("double").alias(c) for c in datetimes])
        cells = quantile_buckets(long_form(instants, list(datetimes), ["__y", "__p"], "double"), "value", bins, ["feature"])
        days = F.concat(day_of(F.col("bucket_low")), F.lit(" - "), day_of(F.col("bucket_high")))
        cells = cells.withColumns({"bucket": F.coalesce(days, F.lit("(Missing)")), "bucket_idx": F.coalesce("bucket_idx", F.lit(999))})
        g = cells.groupBy("feature", "bucket").agg(
            *measures, F.min("bucket_low").alias("bucket_low"), F.max("bucket_high").alias("bucket_high"), F.min("bucket_idx").alias("bucket_idx")
        )
        parts.append(g.withColumn("type", F.lit("datetime")))
    if categorical:
        cells = long_form(base, categorical, ["__y", "__p"], "string")
        g = cells.groupBy("feature", "value").agg(*measures)
        w = Window.partitionBy("feature").orderBy(F.col("value").isNull(), F.col("n").desc(), "value")
        levels = g.filter("value IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("__levels"))
        ranked = g.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= max_levels)
        top = join_keys(ranked, levels, ["feature"])
        fits = F.col("__levels") <= max_levels
        kept = top.filter(F.col("value").isNotNull() & (fits | (F.col("__rank") < max_levels)))
        named = join_keys(g, kept.select("feature", "value", F.lit(1).alias("__keep")), ["feature", "value"])
        bucket = F.when(F.col("value").isNull(), "(Missing)").when(F.col("__keep").isNull(), "(Other)").otherwise(F.col("value"))
        g = named.withColumn("bucket", bucket).groupBy("feature", "bucket").agg(
            *[F.sum(c).alias(c) for c in ("n", "m0", "n_p", "m0_p")]
        )
        idx = F.when(F.col("bucket") == "(Missing)", 999).when(F.col("bucket") == "(Other)", 998).otherwise(1)
        parts.append(
            g.withColumns(
                {"bucket_idx": idx, "type": F.lit("categorical"),
                 "bucket_low": F.lit(None).cast("double"), "bucket_high": F.lit(None).cast("double")}
            )
        )
    out = reduce(DataFrame.unionByName, parts).filter(F.col("n") >= min_n)
    rate = F.col("m0") / F.col("n")
    return out.select(
        F.col("feature").alias("attribute"), "type", "bucket", "bucket_idx", "bucket_low", "bucket_high", "n",
        (F.col("n") / totals["n"]).alias("share"), "m0", F.col("m0_p").alias("partner_m0"),
        rate.alias("conversion_rate"), F.try_divide(F.col("m0_p"), F.col("n_p")).alias("partner_rate"),
        F.try_divide(rate, totals["rate"]).alias("lift"),
    )


def attribute_summary(report: DataFrame) -> DataFrame:
    """Per attribute the spread of conversion over its buckets and the best and worst one.

    '(Missing)' and '(Other)' are left out when at least two other buckets exist; of equal
    rates the first bucket counts.
    """
    special = F.col("bucket").isin("(Missing)", "(Other)")
    real = report.groupBy("attribute").agg(
        F.count_if(~special).alias("__real"), F.count(F.lit(1)).alias("n_buckets")
    )
    used = join_keys(report, real, ["attribute"]).filter(~special | (F.col("__real") < 2))
    rate = F.round(F.col("conversion_rate"), 9)
    place = F.struct(F.col("bucket_idx").alias("i"), F.col("bucket").alias("b"), F.col("partner_rate").alias("p"))
    best = F.min(F.struct((-rate).alias("r"), place.alias("x")))["x"]
    worst = F.min(F.struct(rate.alias("r"), place.alias("x")))["x"]
    out = used.groupBy("attribute").agg(
        F.max("type").alias("type"), F.max("n_buckets").alias("n_buckets"),
        F.min("conversion_rate").alias("min_conv"), F.max("conversion_rate").alias("max_conv"),
        best.alias("__b"), worst.alias("__w"),
    )
    return out.filter("n_buckets > 1").select(
        "attribute", "type", "n_buckets", "min_conv", "max_conv",
        (F.col("max_conv") - F.col("min_conv")).alias("spread"),
        F.col("__b.b").alias("highest_bucket"), F.col("__b.p").alias("partner_at_high"),
        F.col("__w.b").alias("lowest_bucket"), F.col("__w.p").alias("partner_at_low"),
    )


# --------------------------------------------------------------------------- attribution


def linear_contributions(df: DataFrame, coefficients: dict[str, float], means: dict[str, float], id_column: str):
    """Contribution of each feature to a linear score, in long form: coefficient x (value - mean)."""
    cells = [
        F.struct(
            F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
            (F.lit(float(w)) * (F.col(c).cast("double") - F.lit(float(means[c])))).alias("contribution"),
        )
        for c, w in coefficients.items()
    ]
    return df.select(id_column, F.explode(F.array(*cells)).alias("c")).select(id_column, "c.*")


def attribution_summary(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution, share of the total and direction (rank correlation of value and contribution)."""
    c = contributions
    for column, rank in (("value", "__rv"), ("contribution", "__rc")):
        counts = c.groupBy("feature", column).agg(F.count(F.lit(1)).alias("__c"))
        skew = score_skew(c, ["feature"], column)
        ranked = prefix_scan(counts, ["feature"], [column], {"__upto": running_sum(F.col("__c"), True)}, skew)
        ranked = ranked.withColumn(rank, F.col("__upto") - F.col("__c") + (F.col("__c") + 1) / 2)
        c = join_keys(c, ranked.select("feature", column, rank), ["feature", column])
    out = c.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs"), F.corr("__rv", "__rc").alias("rank_corr")
    )
    total = out.agg(F.sum("mean_abs")).scalar()
    r = F.when(F.isnan("rank_corr"), F.lit(None)).otherwise(F.col("rank_corr"))
    direction = (
        F.when(r.isNull(), "flat").when(F.abs(r) < 0.2, "non-monotone").when(r > 0, "raises").otherwise("lowers")
    )
    return out.select("feature", "mean_abs", (F.col("mean_abs") / total).alias("share"), direction.alias("direction"))


def head_tail_levels(df: DataFrame, level: str, value: str, head: int = 4, tail: int = 3, min_n: int = 30) -> DataFrame:
    """The levels with the highest and the lowest mean among those with ``min_n`` rows."""
    g = df.groupBy(level).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    mean = F.round(F.col("mean_value"), 9)
    top = g.orderBy(mean.desc(), level).limit(head)
    bottom = g.orderBy(mean, F.col(level).desc()).limit(tail)
    return top.unionByName(bottom).distinct()
