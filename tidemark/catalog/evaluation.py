"""Metrics, threshold tables, drift, profiles and the leakage audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import register
from tidemark.catalog.splits import HASH, HASH_SPLIT
from tidemark.operators import evaluation as ev
from tidemark.operators import splits
from tidemark.sources.scratch import staged

AUC = """SELECT {g} (SUM(CASE WHEN label = 1 THEN r END) - SUM(label) * (SUM(label) + 1) / 2.0) / NULLIF(SUM(label) * SUM(1 - label), 0) AS auc,
  COUNT(*) AS n, SUM(label) AS positives FROM (SELECT *, RANK() OVER ({p} ORDER BY score) + (COUNT(*) OVER ({ps} score) - 1) / 2.0 AS r
  FROM {t}) {b}"""


def auc_sql(table="v_scored", key=None):
    if key is None:
        return AUC.format(g="", p="", ps="PARTITION BY", t=table, b="")
    return AUC.format(g=f"{key},", p=f"PARTITION BY {key}", ps=f"PARTITION BY {key},", t=table, b=f"GROUP BY {key}")


CURVE = """(SELECT {k} score, SUM(p) OVER ({w} ORDER BY score DESC) AS tp, SUM(c) OVER ({w} ORDER BY score DESC) AS n, p
  FROM (SELECT {k} score, SUM(label) AS p, COUNT(*) AS c FROM {t} GROUP BY ALL))"""


def curve(table="v_scored", key=None):
    return CURVE.format(k=f"{key}," if key else "", w=f"PARTITION BY {key}" if key else "", t=table)


@register("roc_auc", "auc:d n positives", auc_sql())
def roc_auc(i):
    return ev.roc_auc(i.scored, "score", "label")


LOGLOSS = """AVG(-ln(CASE WHEN label = 1 THEN GREATEST(LEAST(score, 1 - 1e-15), 1e-15)
  ELSE 1 - GREATEST(LEAST(score, 1 - 1e-15), 1e-15) END))"""


@register("log_loss", "log_loss:d", f"SELECT {LOGLOSS} AS log_loss FROM v_scored")
def log_loss(i):
    return i.scored.agg(ev.log_loss_of(F.col("score"), F.col("label")).alias("log_loss"))


@register("brier", "brier:d", "SELECT AVG((score - label) * (score - label)) AS brier FROM v_scored")
def brier(i):
    return i.scored.agg(ev.brier_of(F.col("score"), F.col("label")).alias("brier"))


@register(
    "average_precision", "average_precision:d",
    f"SELECT SUM(p * tp / n) / SUM(p) AS average_precision FROM {curve()}",
)
def average_precision(i):
    return ev.average_precision(i.scored, "score", "label")


@register("obs_exp", "obs_exp:d", "SELECT AVG(score) / AVG(label) AS obs_exp FROM v_scored")
def obs_exp(i):
    return i.scored.agg(ev.obs_exp_of(F.col("score"), F.col("label")).alias("obs_exp"))


SPLIT_ROWS = f"(SELECT *, {HASH_SPLIT.format(h='h')} AS split FROM (SELECT *, {HASH.format(k='row_id')} AS h FROM v_scored))"
METRICS = f"""(SELECT * FROM (SELECT split, COUNT(*) AS n_rows, COUNT(label) AS n_labelled, AVG(label) AS base_rate,
    {LOGLOSS} AS log_loss, AVG((score - label) * (score - label)) AS brier, AVG(score) / AVG(label) AS obs_exp, 0 AS no_labels
    FROM {SPLIT_ROWS} GROUP BY 1)
  JOIN ({auc_sql(SPLIT_ROWS, 'split')}) USING (split)
  JOIN (SELECT split, SUM(p * tp / n) / SUM(p) AS average_precision FROM {curve(SPLIT_ROWS, 'split')} GROUP BY 1) USING (split))"""


def split_metrics(i):
    return ev.eval_split(splits.hash_split(i.scored, "row_id"), "score", "label", "split")


@register(
    "eval_split", "split:s n_rows n_labelled base_rate:d log_loss:d brier:d obs_exp:d no_labels auc:d average_precision:d",
    f"SELECT * FROM {METRICS}",
)
def eval_split(i):
    return split_metrics(i)


@register(
    "degradation", "auc_drop:d rate_shift:d rate_warning leak_alert",
    f"""SELECT a.auc - b.auc AS auc_drop, b.base_rate / t.base_rate AS rate_shift,
        CAST(b.base_rate / t.base_rate NOT BETWEEN 0.7 AND 1.4 AS INT) AS rate_warning, CAST(GREATEST(a.auc, b.auc) > 0.99 AS INT) AS leak_alert
        FROM {METRICS} a, {METRICS} b, {METRICS} t WHERE a.split = 'random_test' AND b.split = 'calib' AND t.split = 'train'""",
)
def degradation(i):
    return ev.degradation(split_metrics(i), "split", "random_test", "calib", "train")


@register(
    "max_f1_threshold", "threshold:d f1:d",
    f"""SELECT score AS threshold, f1 FROM (SELECT score, round(2 * tp / (n + (SELECT SUM(label) FROM v_scored)), 12) AS f1 FROM {curve()})
        ORDER BY f1 DESC, score LIMIT 1""",
)
def max_f1_threshold(i):
    return ev.max_f1_threshold(i.scored, "score", "label")


CONFUSION = """COUNT(*) FILTER (label = 0 AND score < {t}) AS tn, COUNT(*) FILTER (label = 0 AND score >= {t}) AS fp,
  COUNT(*) FILTER (label = 1 AND score < {t}) AS fn, COUNT(*) FILTER (label = 1 AND score >= {t}) AS tp"""


@register(
    "confusion", "segment:s tn fp fn tp flagged_share:d precision:d recall:d f1:d lift:d",
    f"""SELECT *, (tp + fp) / (tn + fp + fn + tp) AS flagged_share, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
        2 * tp / (2 * tp + fp + fn) AS f1, (tp / (tp + fp)) / ((tp + fn) / (tn + fp + fn + tp)) AS lift
        FROM (SELECT segment, {CONFUSION.format(t=0.5)} FROM v_scored GROUP BY 1)""",
)
def confusion(i):
    return ev.confusion(i.scored, "score", "label", 0.5, ["segment"])


@register(
    "order_confusion", "tn fp fn tp",
    """SELECT COUNT(*) FILTER (y = 0 AND hi < 0.02) AS tn, COUNT(*) FILTER (y = 0 AND hi >= 0.02) AS fp,
         COUNT(*) FILTER (y = 1 AND lo < 0.02) AS fn, COUNT(*) FILTER (y = 1 AND lo >= 0.02) AS tp
       FROM (SELECT order_id, MAX(label) AS y, MIN(score) AS lo, MAX(score) AS hi FROM v_scored GROUP BY 1)""",
)
def order_confusion(i):
    return ev.order_confusion(i.scored, "order_id", "score", "label", 0.02)


RATES = ", ".join(str(r) for r in ev.REVIEW_RATES)


@register(
    "capture_at_rates", "rate:d threshold:d n precision:d recall:d lift:d",
    f"""WITH r AS (SELECT unnest([{RATES}]) AS rate), q AS (SELECT rate, (SELECT quantile_cont(score, [0.999, 0.995, 0.99, 0.95, 0.9]) FROM v_scored)
          [CAST(ROW_NUMBER() OVER (ORDER BY rate) AS INT)] AS threshold FROM r),
         m AS (SELECT rate, threshold, COUNT(*) AS n, SUM(label) AS p FROM q JOIN v_scored ON score >= threshold GROUP BY 1, 2),
         d AS (SELECT * FROM m WHERE n >= 20 QUALIFY ROW_NUMBER() OVER (PARTITION BY n ORDER BY rate) = 1)
       SELECT rate, threshold, n, p / n AS precision, p / (SELECT SUM(label) FROM v_scored) AS recall,
         (p / n) / (SELECT AVG(label) FROM v_scored) AS lift FROM d""",
)
def capture_at_rates(i):
    return ev.capture_at_rates(i.scored, "score", "label")


@register(
    "bottom_percentile_table", "percentile n precision:d fn tn",
    """WITH q AS (SELECT unnest([5, 10, 15, 20, 25, 30, 35, 40]) AS percentile,
           unnest(quantile_cont(score, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4])) AS t FROM v_scored)
       SELECT percentile, COUNT(*) AS n, SUM(1 - label) / COUNT(*) AS precision, SUM(label) AS fn, SUM(1 - label) AS tn
       FROM q JOIN v_scored ON score <= t GROUP BY 1""",
)
def bottom_percentile_table(i):
    return ev.bottom_percentile_table(i.scored, "score", "label")


@register(
    "segment_auc", "segment:s auc:d n positives single_class",
    f"SELECT *, CASE WHEN auc IS NULL THEN 1 ELSE 0 END AS single_class FROM ({auc_sql(key='segment')})",
)
def segment_auc(i):
    return ev.segment_auc(i.scored, "score", "label", "segment")


BUCKETED = """(SELECT *, GREATEST(len(list_filter(q, lambda x: x < amount)), 1) AS bucket_idx FROM v_scored CROSS JOIN
  (SELECT list_sort(list_distinct(quantile_cont(amount, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]))) AS q FROM v_scored))"""


@register("segment_auc_buckets", "bucket_idx auc:d n positives", auc_sql(BUCKETED, "bucket_idx"))
def segment_auc_buckets(i):
    return ev.segment_auc(ev.quantile_buckets(i.scored, "amount", 8), "score", "label", "bucket_idx")


@register(
    "reject_breakdown", "segment:s true_negatives false_negatives total_rejected",
    """SELECT segment, COUNT(*) FILTER (label = 0) AS true_negatives, COUNT(*) FILTER (label = 1) AS false_negatives,
       COUNT(*) AS total_rejected FROM v_scored WHERE NOT (score >= 0.4) GROUP BY 1""",
)
def reject_breakdown(i):
    return ev.reject_breakdown(i.scored, "segment", "label", F.col("score") >= 0.4)


@register(
    "fn_lookup", "class:s outcome:s cascade_type:s n amount:m",
    """WITH s AS (SELECT jluvr, CASE WHEN is_m0 = 1 THEN 'fn' ELSE 'tn' END AS class FROM v_lead WHERE seller_minimum_price < 0.4)
       SELECT class, order_status AS outcome, cascade_type, COUNT(*) AS n, SUM(transaction_amount) AS amount
       FROM v_order_item JOIN s ON jluvr = order_id GROUP BY 1, 2, 3""",
)
def fn_lookup(i):
    ids = i.lead.filter("seller_minimum_price < 0.4").select(
        F.col("jluvr").alias("order_id"), F.when(F.col("is_m0") == 1, "fn").otherwise("tn").alias("class")
    )
    return i.order_item.join(ids, "order_id").groupBy("class", F.col("order_status").alias("outcome"), "cascade_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("transaction_amount").alias("amount")
    )


NAIVE = """(SELECT d.call_type, d.call_date, d.n AS actual, p.n AS predicted FROM
  (SELECT call_type, call_date, COUNT(*) AS n FROM v_daily_call GROUP BY 1, 2) d JOIN
  (SELECT call_type, call_date + 7 AS call_date, COUNT(*) AS n FROM v_daily_call GROUP BY 1, 2) p
  ON d.call_type = p.call_type AND d.call_date = p.call_date)"""


def naive_forecast(i):
    counts = i.daily_call.groupBy("call_type", "call_date").agg(F.count(F.lit(1)).alias("actual"))
    week_before = counts.select("call_type", F.date_add("call_date", 7).alias("call_date"), F.col("actual").alias("predicted"))
    return counts.join(week_before, ["call_type", "call_date"])


@register(
    "regression_errors", "call_type:s n bias:d mae:d rmse:d wmape:d mae_share:d",
    f"""SELECT call_type, COUNT(*) AS n, SUM(predicted - actual) / SUM(actual) AS bias, AVG(abs(predicted - actual)) AS mae,
        sqrt(AVG((predicted - actual) * (predicted - actual))) AS rmse, SUM(abs(predicted - actual)) / SUM(actual) AS wmape,
        AVG(abs(predicted - actual)) / AVG(actual) AS mae_share FROM {NAIVE} GROUP BY 1""",
)
def regression_errors(i):
    return ev.regression_errors(naive_forecast(i), "actual", "predicted", ["call_type"])


@register(
    "worst_days", "call_date:D actual predicted abs_error",
    f"""SELECT call_date, actual, predicted, abs(predicted - actual) AS abs_error FROM (SELECT call_date, SUM(actual) AS actual,
        SUM(predicted) AS predicted FROM {NAIVE} GROUP BY 1) ORDER BY abs_error DESC, call_date LIMIT 5""",
)
def worst_days(i):
    daily = naive_forecast(i).groupBy("call_date").agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"))
    return ev.worst_rows(daily, "actual", "predicted", "call_date")


ITEMS = f"(SELECT *, {HASH_SPLIT.format(h='h')} AS split FROM (SELECT *, {HASH.format(k='order_id')} AS h FROM v_order_item))"
NUMS = ["transaction_amount", "quantity", "discount"]
CATS = ["cascade_type", "bank"]


def scan_sql():
    parts = []
    for c in NUMS:
        t = f"(SELECT label, {c} AS score FROM {ITEMS} WHERE split = 'train' AND {c} IS NOT NULL)"
        parts.append(f"SELECT '{c}' AS feature, auc FROM ({auc_sql(t)})")
    for c in CATS:
        t = f"""(SELECT s.label, COALESCE(e.m, (SELECT AVG(label) FROM {ITEMS} WHERE split = 'train')) AS score
          FROM (SELECT * FROM {ITEMS} WHERE split = 'stop') s LEFT JOIN (SELECT {c} AS k, AVG(label) AS m FROM {ITEMS}
          WHERE split = 'train' GROUP BY 1) e ON s.{c} IS NOT DISTINCT FROM e.k)"""
        parts.append(f"SELECT '{c}' AS feature, auc FROM ({auc_sql(t)})")
    return "SELECT feature, GREATEST(auc, 1 - auc) AS auc, CAST(GREATEST(auc, 1 - auc) > 0.95 AS INT) AS suspect FROM (" + " UNION ALL ".join(parts) + ")"


@register("univariate_auc_scan", "feature:s auc:d suspect", scan_sql())
def univariate_auc_scan(i):
    # Read several times: split once, written once.
    rows = staged(splits.hash_split(i.order_item, "order_id").select("label", "split", *NUMS, *CATS), "split_items")
    return ev.univariate_auc_scan(rows.filter("split = 'train'"), NUMS, CATS, "label", rows.filter("split = 'stop'"))


VECTOR = ["quantity", "discount", "cascade_type", "bank"]
VECTOR_SQL = f"(SELECT {', '.join(VECTOR)}, COUNT(*) AS n, SUM(label) AS n1 FROM {ITEMS} WHERE split = 'train' GROUP BY ALL)"


@register(
    "vector_resolution", "vectors rows_per_vector:d ambiguous_share:d error_floor:d",
    f"""SELECT COUNT(*) AS vectors, SUM(n) / COUNT(*) AS rows_per_vector, SUM(CASE WHEN n1 > 0 AND n1 < n THEN n ELSE 0 END) / SUM(n)
        AS ambiguous_share, SUM(LEAST(n1, n - n1)) / SUM(n) AS error_floor FROM {VECTOR_SQL}""",
)
def vector_resolution(i):
    rows = splits.hash_split(i.order_item, "order_id").filter("split = 'train'")
    return ev.vector_resolution(rows, VECTOR, "label")


@register(
    "vector_overlap", "overlap_share:d",
    f"""SELECT AVG(CASE WHEN t.n IS NULL THEN 0.0 ELSE 1 END) AS overlap_share FROM (SELECT * FROM {ITEMS} WHERE split = 'random_test') s
        LEFT JOIN {VECTOR_SQL} t ON {' AND '.join(f's.{c} IS NOT DISTINCT FROM t.{c}' for c in VECTOR)}""",
)
def vector_overlap(i):
    rows = splits.hash_split(i.order_item, "order_id")
    return ev.vector_overlap(rows.filter("split = 'random_test'"), rows.filter("split = 'train'"), VECTOR)


FLAT = ["vertical_type", "transaction_status", "membership_status", "bank", "invoice_type"]


@register(
    "near_constant", "feature:s top_share:d",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, MAX(n) / SUM(n) AS top_share FROM (SELECT {c}, COUNT(*) AS n FROM v_attempt GROUP BY 1)" for c in FLAT
    ) + ") WHERE top_share > 0.90",
)
def near_constant(i):
    return ev.near_constant(i.attempt, FLAT)


RECENT = "transaction_datetime >= TIMESTAMP '2024-01-25'"


def recent():
    return F.col("transaction_datetime") >= F.lit("2024-01-25").cast("timestamp_ntz")


DRIFT_NUM = {"transaction_amount": "transaction_amount", "retries": "COALESCE(retries, -1)"}


@register(
    "numeric_drift", "feature:s historical:d recent:d shift_pct:f",
    "SELECT *, (recent - historical) / historical * 100 AS shift_pct FROM (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, AVG({e}) FILTER (NOT {RECENT} AND {e} <> -1) AS historical,
            AVG({e}) FILTER ({RECENT} AND {e} <> -1) AS recent FROM v_attempt""" for c, e in DRIFT_NUM.items()
    ) + ")",
)
def numeric_drift(i):
    return ev.numeric_drift(i.attempt.fillna(-1, ["retries"]), list(DRIFT_NUM), recent())


DRIFT_CAT = ["bank", "super_partner_id_name"]


@register(
    "categorical_drift", "feature:s value:s n_historical historical_rate:f recent_rate:f",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS feature, {c} AS value, COUNT(*) FILTER (NOT {RECENT}) AS n_historical,
          100 * COALESCE(AVG(CASE WHEN transaction_status = 'accepted' THEN 1.0 ELSE 0 END) FILTER (NOT {RECENT}), 0) AS historical_rate,
          100 * COALESCE(AVG(CASE WHEN transaction_status = 'accepted' THEN 1.0 ELSE 0 END) FILTER ({RECENT}), 0) AS recent_rate
          FROM v_attempt WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY n_historical DESC, value LIMIT 3)""" for c in DRIFT_CAT
    ),
)
def categorical_drift(i):
    rows = i.attempt.withColumn("accepted", (F.col("transaction_status") == "accepted").cast("int"))
    return ev.categorical_drift(rows, DRIFT_CAT, "accepted", recent())


LOW = "success_probability < 0.05"


@register(
    "profile_categorical", "feature:s value:s n_group group_pct:f rest_pct:f lift:f",
    f"""WITH z AS (SELECT COUNT(*) FILTER ({LOW}) AS g, COUNT(*) FILTER (NOT {LOW}) AS r FROM v_attempt),
         c AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, COALESCE({c}, '(missing)') AS value, COUNT(*) FILTER ({LOW}) AS n_group, COUNT(*) FILTER (NOT {LOW}) AS n_rest FROM v_attempt GROUP BY 2" for c in ('bank', 'decline_code', 'card_type'))})
       SELECT feature, value, n_group, 100 * n_group / g AS group_pct, 100 * n_rest / r AS rest_pct,
         CASE WHEN n_rest = 0 THEN 'inf'::DOUBLE ELSE (n_group / g) / (n_rest / r) END AS lift
       FROM c, z WHERE n_group >= 20 AND n_group / g >= 0.02""",
)
def profile_categorical(i):
    return ev.profile_categorical(i.attempt, ["bank", "decline_code", "card_type"], F.expr(LOW))


def profile_sql(c):
    return f"""SELECT '{c}' AS feature, quantile_cont({c}, 0.5) FILTER ({LOW}) AS group_median, quantile_cont({c}, 0.5) FILTER (NOT {LOW}) AS rest_median,
      AVG({c}) FILTER ({LOW}) AS group_mean, AVG({c}) FILTER (NOT {LOW}) AS rest_mean,
      (AVG({c}) FILTER ({LOW}) - AVG({c}) FILTER (NOT {LOW})) / stddev_samp({c}) AS std_diff FROM v_attempt"""


@register(
    "profile_numeric", "feature:s group_median:d rest_median:d group_mean:d rest_mean:d std_diff:d",
    " UNION ALL ".join(profile_sql(c) for c in ("transaction_amount", "retries", "offer_amount")),
)
def profile_numeric(i):
    return ev.profile_numeric(i.attempt, ["transaction_amount", "retries", "offer_amount"], F.expr(LOW))


def attribute_sql(bins=8):
    """Report over the leads: one numeric attribute with nulls and two categorical ones."""
    probs = ", ".join(str(n / bins) for n in range(bins + 1))
    numeric = "".join(
        f"""SELECT '{c}' AS attribute, 'numeric' AS type, CASE WHEN b = 999 THEN '(Missing)' ELSE concat('bucket ', lpad(CAST(b AS VARCHAR), 2, '0')) END AS bucket,
            b AS bucket_idx, COUNT(*) AS n, SUM(y) AS m0, SUM(p) AS n_p, SUM(y * p) AS m0_p FROM (
              SELECT y, p, CASE WHEN {c} IS NULL THEN 999 ELSE GREATEST(len(list_filter(list_sort(list_distinct(q)), lambda x: x < {c})), 1) END AS b
              FROM a CROSS JOIN (SELECT quantile_cont({c}, [{probs}]) AS q FROM a)) GROUP BY ALL UNION ALL """
        for c in ("transaction_amount", "retries")
    )
    cats = " UNION ALL ".join(
        f"""SELECT '{c}' AS attribute, 'categorical' AS type, v AS bucket, CASE v WHEN '(Missing)' THEN 999 WHEN '(Other)' THEN 998 ELSE 1 END AS bucket_idx,
            COUNT(*) AS n, SUM(y) AS m0, SUM(p) AS n_p, SUM(y * p) AS m0_p FROM (SELECT y, p, CASE WHEN {c} IS NULL THEN '(Missing)'
              WHEN (SELECT COUNT(DISTINCT {c}) FROM a) <= 5 OR {c} IN (SELECT {c} FROM a WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, {c} LIMIT 4)
              THEN {c} ELSE '(Other)' END AS v FROM a) GROUP BY ALL"""
        for c in ("bank", "card_type")
    )
    return f"""(WITH a AS (SELECT *, CASE WHEN transaction_status = 'accepted' THEN 1 ELSE 0 END AS y,
        CASE WHEN super_partner_id_name = 'P3' THEN 1 ELSE 0 END AS p FROM v_attempt), r AS ({numeric}{cats})
      SELECT attribute, type, bucket, bucket_idx, n, n / (SELECT COUNT(*) FROM a) AS share, m0, m0_p AS partner_m0, m0 / n AS conversion_rate,
        m0_p / NULLIF(n_p, 0) AS partner_rate, (m0 / n) / (SELECT AVG(y) FROM a) AS lift FROM r)"""


ATTRIBUTES = attribute_sql()


def attribute_report(i):
    rows = i.attempt.withColumn("y", (F.col("transaction_status") == "accepted").cast("int"))
    return ev.attribute_conversion(
        rows, ["transaction_amount", "retries"], ["bank", "card_type"], "y", F.col("super_partner_id_name") == "P3", max_levels=5
    )


@register(
    "attribute_conversion",
    "attribute:s type:s bucket:s bucket_idx n share:f m0 partner_m0 conversion_rate:f partner_rate:f lift:f",
    f"SELECT * FROM {ATTRIBUTES}",
)
def attribute_conversion(i):
    return attribute_report(i)


# Attributes whose kind is found from their values: a date, a timestamp, a text of dates of which one in 25 is junk, a number
# as text and a category.
TYPED = """(SELECT *, CAST(transaction_datetime AS DATE) + CAST(transaction_id % 60 AS INT) AS due,
    CASE WHEN transaction_id % 25 = 0 THEN 'n/a' ELSE CAST(CAST(transaction_datetime AS DATE) - CAST(transaction_id % 90 AS INT) AS VARCHAR) END AS opened,
    CASE WHEN transaction_id % 30 = 0 THEN '-' ELSE CAST(transaction_amount AS VARCHAR) END AS amount_text,
    CASE WHEN transaction_status = 'accepted' THEN 1 ELSE 0 END AS y, CASE WHEN super_partner_id_name = 'P3' THEN 1 ELSE 0 END AS p FROM v_attempt)"""


def typed_sql(bins=8):
    probs = ", ".join(str(n / bins) for n in range(bins + 1))
    day = "strftime(make_timestamp(CAST(floor({e}) AS BIGINT)), '%Y-%m-%d')"
    instants = {"due": "epoch_us(CAST(due AS TIMESTAMP))", "transaction_datetime": "epoch_us(transaction_datetime)", "opened": "epoch_us(TRY_CAST(opened AS TIMESTAMP))"}
    parts = []
    for c, us in instants.items():
        parts.append(f"""SELECT '{c}' AS attribute, 'datetime' AS type, CASE WHEN v IS NULL THEN '(Missing)' ELSE {day.format(e='e[b]')} || ' - '
          || {day.format(e='COALESCE(e[b + 1], e[1])')} END AS bucket, y, p FROM (SELECT *, GREATEST(len(list_filter(e, lambda x: x < v)), 1) AS b
            FROM (SELECT CAST({us} AS DOUBLE) AS v, y, p FROM t), (SELECT list_sort(list_distinct(quantile_cont(CAST({us} AS DOUBLE), [{probs}]))) AS e FROM t))""")
    parts.append(f"""SELECT 'amount_text', 'numeric', CASE WHEN v IS NULL THEN '(Missing)' ELSE 'bucket ' || lpad(CAST(GREATEST(len(list_filter(e, lambda x: x < v)), 1)
          AS VARCHAR), 2, '0') END, y, p FROM (SELECT TRY_CAST(amount_text AS DOUBLE) AS v, y, p FROM t),
          (SELECT list_sort(list_distinct(quantile_cont(TRY_CAST(amount_text AS DOUBLE), [{probs}]))) AS e FROM t)""")
    parts.append("SELECT 'card_type', 'categorical', COALESCE(card_type, '(Missing)'), y, p FROM t")
    return f"""WITH t AS {TYPED}, r AS ({' UNION ALL '.join(parts)})
      SELECT attribute, type, bucket, COUNT(*) AS n, COUNT(*) / (SELECT COUNT(*) FROM t) AS share, SUM(y) AS m0, SUM(y * p) AS partner_m0, AVG(y) AS conversion_rate,
        SUM(y * p) / NULLIF(SUM(p), 0) AS partner_rate, AVG(y) / (SELECT AVG(y) FROM t) AS lift FROM r GROUP BY ALL"""


@register(
    "attribute_conversion_typed", "attribute:s type:s bucket:s n share:f m0 partner_m0 conversion_rate:f partner_rate:f lift:f", typed_sql()
)
def attribute_conversion_typed(i):
    k, day = F.col("transaction_id"), F.to_date("transaction_datetime")
    rows = i.attempt.withColumns(
        {
            "due": F.date_add(day, (k % 60).cast("int")),
            "opened": F.when(k % 25 == 0, "n/a").otherwise(F.date_sub(day, (k % 90).cast("int")).cast("string")),
            "amount_text": F.when(k % 30 == 0, "-").otherwise(F.col("transaction_amount").cast("string")),
            "y": (F.col("transaction_status") == "accepted").cast("int"),
        }
    )
    columns = ["due", "transaction_datetime", "opened", "amount_text", "card_type"]
    return ev.attributes_report(rows, columns, "y", F.col("super_partner_id_name") == "P3")


@register(
    "attribute_summary",
    "attribute:s type:s n_buckets min_conv:f max_conv:f spread:f highest_bucket:s partner_at_high:f lowest_bucket:s partner_at_low:f",
    f"""WITH r AS (SELECT *, COUNT(*) FILTER (bucket NOT IN ('(Missing)', '(Other)')) OVER (PARTITION BY attribute) AS real,
          COUNT(*) OVER (PARTITION BY attribute) AS n_buckets FROM {ATTRIBUTES}),
        u AS (SELECT *, round(conversion_rate, 9) AS k FROM r WHERE bucket NOT IN ('(Missing)', '(Other)') OR real < 2)
        SELECT attribute, MAX(type) AS type, MAX(n_buckets) AS n_buckets, MIN(conversion_rate) AS min_conv, MAX(conversion_rate) AS max_conv,
          MAX(conversion_rate) - MIN(conversion_rate) AS spread, arg_min(bucket, (-k, bucket_idx, bucket)) AS highest_bucket,
          arg_min_null(partner_rate, (-k, bucket_idx, bucket)) AS partner_at_high, arg_min(bucket, (k, bucket_idx, bucket)) AS lowest_bucket,
          arg_min_null(partner_rate, (k, bucket_idx, bucket)) AS partner_at_low FROM u WHERE n_buckets > 1 GROUP BY 1""",
)
def attribute_summary(i):
    return ev.attribute_summary(attribute_report(i))


@register(
    "example_rows", "invoice_id transaction_id success_probability:d retries",
    f"SELECT * FROM v_attempt WHERE {LOW} ORDER BY success_probability, transaction_id LIMIT 15",
)
def example_rows(i):
    return i.attempt.filter(LOW).orderBy("success_probability", "transaction_id").limit(15)
