"""Leakage-safe splits, samples and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.aggregates import RESOLUTION
from tidemark.catalog.registry import register
from tidemark.catalog.windows import BASE
from tidemark.operators import splits
from tidemark.operators.cleaning import rare_pool
from tidemark.operators.ordered import exact_quantiles, micros
from tidemark.plans import attempts


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@register(
    "maturity_filter", "transaction_id",
    """WITH s AS (SELECT invoice_id, MIN(transaction_datetime) AS a FROM v_attempt GROUP BY 1)
       SELECT transaction_id FROM v_attempt JOIN s USING (invoice_id)
       WHERE a <= (SELECT MAX(transaction_datetime) - INTERVAL 10 DAY FROM v_attempt)""",
)
def maturity_filter(i):
    return splits.maturity_filter(i.attempt, "invoice_id", "transaction_datetime", days=10)


ORDERS_SQL = """(SELECT order_id, MIN(transaction_date) AS order_start, MAX(transaction_date) AS order_last_txn,
  MAX(label) AS label, COUNT(*) AS n FROM v_order_item GROUP BY 1)"""


def order_spans(i):
    return i.order_item.groupBy("order_id").agg(
        F.min("transaction_date").alias("order_start"), F.max("transaction_date").alias("order_last_txn"),
        F.max("label").alias("label"), F.count(F.lit(1)).alias("n"),
    )


@register(
    "maturity_runway", "orders too_young truncated dropped dropped_positives",
    f"""WITH o AS (SELECT *, order_last_txn > DATE '2001-11-01' - 90 AS y,
          order_last_txn > (SELECT MAX(transaction_date) FROM v_order_item) - 30 AS t FROM {ORDERS_SQL})
        SELECT COUNT(*) AS orders, COUNT(*) FILTER (y) AS too_young, COUNT(*) FILTER (t) AS truncated,
          COUNT(*) FILTER (y OR t) AS dropped, COUNT(*) FILTER ((y OR t) AND label = 1) AS dropped_positives FROM o""",
)
def maturity_runway(i):
    flagged = splits.maturity_runway(order_spans(i), "order_last_txn", F.lit("2001-11-01").cast("date"))
    dropped = ~F.col("is_mature")
    return flagged.agg(
        F.count(F.lit(1)).alias("orders"), F.count_if("too_young").alias("too_young"), F.count_if("truncated").alias("truncated"),
        F.count_if(dropped).alias("dropped"), F.count_if(dropped & (F.col("label") == 1)).alias("dropped_positives"),
    )


@register(
    "chrono_quantile_split", "invoice_id side:s n",
    """WITH s AS (SELECT invoice_id, epoch_us(MIN(transaction_datetime)) AS a, COUNT(*) AS n FROM v_attempt GROUP BY 1)
       SELECT invoice_id, CASE WHEN a < (SELECT quantile_cont(CAST(a AS DOUBLE), 0.85) FROM s) THEN 'past' ELSE 'oot' END AS side, n FROM s""",
)
def chrono_quantile_split(i):
    split = splits.chrono_quantile_split(i.attempt, "invoice_id", "transaction_datetime")
    return split.groupBy("invoice_id", "side").agg(F.count(F.lit(1)).alias("n"))


@register(
    "asof_split", "transaction_id side:s",
    f"""SELECT transaction_id, CASE WHEN transaction_datetime < TIMESTAMP '2024-01-20' THEN 'past' ELSE 'oot' END AS side
        FROM {BASE} b JOIN {RESOLUTION} r USING (invoice_id)
        WHERE (resolved_at < TIMESTAMP '2024-01-20' AND invoice_last_txn < TIMESTAMP '2024-01-20'
            AND transaction_datetime < TIMESTAMP '2024-01-20')
          OR (transaction_datetime >= TIMESTAMP '2024-01-20' AND transaction_datetime < TIMESTAMP '2024-01-27')""",
)
def asof_split(i):
    rows = attempts.scored_attempts(i.attempt)
    times = attempts.invoice_resolution(rows).drop("is_eventually_successful")
    return splits.asof_split(rows.join(times, "invoice_id"), ts("2024-01-20"), ts("2024-01-27"))


HASH = """CAST(('0x' || left(md5(concat('retry_cutoff_v1:', CAST({k} AS VARCHAR))), 16)) AS UBIGINT) / 18446744073709551616.0"""
HASH_SPLIT = "CASE WHEN {h} < 0.75 THEN 'train' WHEN {h} < 0.85 THEN 'stop' WHEN {h} < 0.95 THEN 'calib' ELSE 'random_test' END"


@register(
    "hash_split", "jluvr split:s",
    f"SELECT jluvr, {HASH_SPLIT.format(h='h')} AS split FROM (SELECT jluvr, {HASH.format(k='jluvr')} AS h FROM v_lead)",
)
def hash_split(i):
    return splits.hash_split(i.lead, "jluvr")


@register(
    "row_position_split", "jluvr split:s",
    """SELECT jluvr, CASE WHEN p <= floor(n * 0.8) THEN 'train' WHEN p <= floor(n * 0.9) THEN 'val' ELSE 'holdout' END AS split
       FROM (SELECT jluvr, ROW_NUMBER() OVER (ORDER BY request_datetime, jluvr) AS p, COUNT(*) OVER () AS n FROM v_lead)""",
)
def row_position_split(i):
    return splits.row_position_split(i.lead, ["request_datetime", "jluvr"], [("train", 0.8), ("val", 0.9)], "holdout")


@register(
    "stratified_split", "jluvr split:s",
    """SELECT jluvr, CASE WHEN p <= round(n * 0.2) THEN 'val' ELSE 'train' END AS split
       FROM (SELECT jluvr, ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5(concat('42:', CAST(jluvr AS VARCHAR)))) AS p,
         COUNT(*) OVER (PARTITION BY label) AS n FROM v_lead)""",
)
def stratified_split(i):
    return splits.stratified_split(i.lead, "label", "jluvr")


@register(
    "exact_sample", "row_id is_sampled",
    """SELECT row_id, CAST(p <= floor(n * 0.1) AS INT) AS is_sampled
       FROM (SELECT row_id, ROW_NUMBER() OVER (ORDER BY md5(concat('42:', CAST(row_id AS VARCHAR)))) AS p, COUNT(*) OVER () AS n FROM v_scored)""",
)
def exact_sample(i):
    return splits.exact_sample(i.scored, "row_id", share=0.1)


DAYS = "(SELECT call_date, ROW_NUMBER() OVER (ORDER BY call_date) AS p, COUNT(*) OVER () AS n FROM (SELECT DISTINCT call_date FROM v_daily_call))"


@register(
    "walk_forward_folds", "call_date:D fold role:s",
    f"""SELECT call_date, fold, CASE WHEN p <= e - 90 THEN 'train' WHEN p <= e - 60 THEN 'val' ELSE 'test' END AS role
        FROM (SELECT *, n - (5 - fold) * 60 AS e FROM {DAYS}, (SELECT unnest(generate_series(1, 5)) AS fold)) WHERE p <= e""",
)
def walk_forward_folds(i):
    return splits.fold_roles(i.daily_call.select("call_date").distinct(), ["call_date"], folds=5, test=60, val=30)


@register("cv_no_shuffle", "jluvr fold", "SELECT jluvr, NTILE(3) OVER (ORDER BY request_datetime, jluvr) AS fold FROM v_lead")
def cv_no_shuffle(i):
    return splits.cv_no_shuffle(i.lead, ["request_datetime", "jluvr"])


@register(
    "class_weight", "seller_name:s negatives positives scale_pos_weight:d",
    """SELECT seller_name, COUNT(*) - SUM(is_m0) AS negatives, SUM(is_m0) AS positives,
       (COUNT(*) - SUM(is_m0)) / GREATEST(SUM(is_m0), 1) AS scale_pos_weight FROM v_lead GROUP BY 1""",
)
def class_weight(i):
    return splits.class_weight(i.lead, "is_m0", ["seller_name"])


@register(
    "hard_example_reweight", "row_id weight:d",
    """WITH c AS (SELECT quantile_cont(score, 0.4) AS a, quantile_cont(score, 0.5) AS b FROM v_scored),
         w AS (SELECT row_id, CASE WHEN score <= a AND label = 1 THEN 2.0 WHEN score <= a THEN 1.2 WHEN score <= b AND label = 1 THEN 1.5
           ELSE 1.0 END AS w FROM v_scored, c)
       SELECT row_id, LEAST(GREATEST(w / (SELECT AVG(w) FROM w), 0.1), 10) AS weight FROM w""",
)
def hard_example_reweight(i):
    rows = i.scored.withColumn("weight", F.lit(1.0))
    return splits.hard_example_reweight(rows, "score", "label", "weight", net=40, zone=50)


@register(
    "split_report", "split:s n_rows n_keys positives base_rate:d first_date:t last_date:t few_positives",
    f"""SELECT split, COUNT(*) AS n_rows, COUNT(DISTINCT person_id) AS n_keys, SUM(is_m0) AS positives, AVG(is_m0) AS base_rate,
          MIN(request_datetime) AS first_date, MAX(request_datetime) AS last_date, CAST(SUM(is_m0) < 20 AS INT) AS few_positives
        FROM (SELECT *, {HASH_SPLIT.format(h='h')} AS split FROM (SELECT *, {HASH.format(k='person_id')} AS h FROM v_lead)) GROUP BY 1""",
)
def split_report(i):
    rows = splits.hash_split(i.lead, "person_id")
    return splits.split_report(rows, "split", "is_m0", "request_datetime", "person_id")


@register(
    "label_split_report", "lang:s n_rows positives base_rate:d",
    "SELECT lang, COUNT(*) AS n_rows, SUM(quality) AS positives, AVG(quality) AS base_rate FROM labels JOIN documents USING (doc_id) GROUP BY 1",
)
def label_split_report(i):
    rows = i.labels.join(i.documents.select("doc_id", "lang"), "doc_id")
    return splits.split_report(rows, "lang", "quality", "doc_id", "doc_id")


@register(
    "late_share", "late_share:d",
    f"""WITH o AS (SELECT * FROM {ORDERS_SQL}), c AS (SELECT quantile_cont(CAST(epoch_us(CAST(order_start AS TIMESTAMP)) AS DOUBLE), 0.85) AS s FROM o)
        SELECT AVG(CASE WHEN epoch_us(CAST(order_last_txn AS TIMESTAMP)) >= s THEN 1.0 ELSE 0 END) AS late_share FROM o, c
        WHERE epoch_us(CAST(order_start AS TIMESTAMP)) < s""",
)
def late_share(i):
    spans = order_spans(i).withColumn("start", micros("order_start").cast("double"))
    cut = exact_quantiles(spans, [], "start", [0.85]).select("q").scalar()
    past = spans.filter(F.col("start") < cut)
    return past.agg(F.avg((micros("order_last_txn") >= cut).cast("double")).alias("late_share"))


@register(
    "rare_pool", "order_id transaction_id part_id supp_id cascade:s part:s",
    """WITH c AS (SELECT part_id AS p, COUNT(*) AS n FROM v_order_item GROUP BY 1)
       SELECT o.order_id, transaction_id, o.part_id, supp_id, cascade_type AS cascade,
         CASE WHEN n >= 30 THEN CAST(part_id AS VARCHAR) ELSE '__RARE__' END AS part FROM v_order_item o JOIN c ON p = part_id""",
)
def rare_pool_query(i):
    rows = i.order_item.withColumns({"part": F.col("part_id").cast("string"), "cascade": F.col("cascade_type")})
    return rare_pool(rows, ["part", "cascade"], min_count=30)


