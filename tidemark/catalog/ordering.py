"""Sorting, limits, top-k and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import register
from tidemark.operators import cleaning, economics, evaluation
from tidemark.operators.ordered import position, prefix_scan
from tidemark.plans import attempts, orders


@register(
    "order_by_multi", "order_id invoice_id retries transaction_id",
    "SELECT * FROM v_attempt ORDER BY order_id, invoice_id, retries, transaction_id",
)
def order_by_multi(i):
    return i.attempt.orderBy("order_id", "invoice_id", "retries", "transaction_id")


@register(
    "top_n_rows", "row_id score:d", "SELECT * FROM v_scored ORDER BY score, row_id LIMIT 15"
)
def top_n_rows(i):
    return i.scored.orderBy("score", "row_id").limit(15)


@register(
    "dedupe_keep_priority", "transaction_id part_id supp_id label",
    """SELECT * FROM v_order_item QUALIFY ROW_NUMBER() OVER (
       PARTITION BY transaction_id ORDER BY label DESC, part_id, supp_id) = 1""",
)
def dedupe_keep_priority(i):
    return orders.one_per_transaction(i.order_item)


@register(
    "first_qualifying_per_order", "order_id transaction_id transaction_datetime:t",
    """SELECT * FROM v_attempt WHERE success_probability < 0.05
       QUALIFY ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY transaction_datetime, transaction_id) = 1""",
)
def first_qualifying_per_order(i):
    return economics.first_cuts(i.attempt, {"p": F.col("success_probability") < 0.05}, ("retries",))


@register(
    "top_k_else_other", "c_custkey bucket:s",
    """WITH v AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE concat('N', CAST(c_nationkey AS VARCHAR)) END AS nation FROM customer),
         t AS (SELECT nation FROM v WHERE nation IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, nation LIMIT 9)
       SELECT c_custkey, CASE WHEN nation IS NULL THEN '(Missing)' WHEN nation IN (SELECT nation FROM t) THEN nation ELSE '(Other)' END
         AS bucket FROM v""",
)
def top_k_else_other(i):
    nation = F.when(F.col("c_nationkey") != 3, F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    return cleaning.top_k_else_other(i.customer.withColumn("nation", nation), "nation", 9)


@register(
    "head_tail_extremes", "level:s mean_value:f n",
    """WITH g AS (SELECT concat('N', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS level, AVG(c_acctbal) AS mean_value, COUNT(*) AS n
           FROM customer GROUP BY 1 HAVING COUNT(*) >= 30)
       SELECT * FROM (SELECT * FROM g ORDER BY round(mean_value, 9) DESC, level LIMIT 4)
       UNION SELECT * FROM (SELECT * FROM g ORDER BY round(mean_value, 9), level DESC LIMIT 3)""",
)
def head_tail_extremes(i):
    level = F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    return evaluation.head_tail_levels(i.customer.withColumn("level", level), "level", "c_acctbal")


@register(
    "bucket_order", "attribute:s bucket:s bucket_idx n",
    """WITH e AS (SELECT list_distinct(quantile_cont(transaction_amount, [0, 0.25, 0.5, 0.75, 1.0])) AS q FROM v_attempt),
         b AS (SELECT CASE WHEN retries IS NULL THEN 999 ELSE GREATEST(len(list_filter(list_sort(q), lambda x: x < v)), 1) END AS bucket_idx
               FROM (SELECT retries, CASE WHEN retries IS NOT NULL THEN transaction_amount END AS v FROM v_attempt) CROSS JOIN
                 (SELECT list_distinct(quantile_cont(transaction_amount, [0, 0.25, 0.5, 0.75, 1.0])) AS q
                  FROM v_attempt WHERE retries IS NOT NULL))
       SELECT 'amount' AS attribute, CASE WHEN bucket_idx = 999 THEN '(Missing)' ELSE concat('bucket ', lpad(CAST(bucket_idx AS VARCHAR), 2, '0')) END
         AS bucket, bucket_idx, COUNT(*) AS n FROM b GROUP BY 1, 2, 3""",
)
def bucket_order(i):
    rows = i.attempt.withColumn("amount", F.when(F.col("retries").isNotNull(), F.col("transaction_amount")))
    rows = rows.withColumn("y", F.when(attempts.accepted(), 1).otherwise(0))
    report = evaluation.attribute_conversion(rows, ["amount"], [], "y", F.lit(False), bins=4)
    return report.orderBy("attribute", "bucket_idx")


@register(
    "last_n_rows", "call_date:D num_calls is_holdout",
    """SELECT call_date, n AS num_calls, CASE WHEN ROW_NUMBER() OVER (ORDER BY call_date DESC) <= 100 THEN 1 ELSE 0 END AS is_holdout
       FROM (SELECT call_date, COUNT(*) AS n FROM v_daily_call GROUP BY 1)""",
)
def last_n_rows(i):
    days = i.daily_call.groupBy("call_date").agg(F.count(F.lit(1)).alias("num_calls"))
    ranked = prefix_scan(days, [], ["call_date"], {"from_end": position()}, reverse=True)
    return ranked.withColumn("is_holdout", (F.col("from_end") <= 100).cast("int"))
