"""Scans, generated rows and the tables the jobs write."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.registry import register
from tidemark.plans.attempts import scored_attempts
from tidemark.sources import tables
from tidemark.sources.scratch import scratch_folder


@register("read_table", "o_orderkey o_custkey o_totalprice:m o_orderdate:t", "SELECT * FROM orders")
def read_table(i):
    return tables.read_table(i.spark, f"{i.sf_dir}/orders.parquet")


@register(
    "read_query", "partner:s n amount:m",
    """WITH part AS (SELECT * FROM v_attempt WHERE order_date >= DATE '2024-01-08' AND order_date < DATE '2024-01-22'),
         totals AS (SELECT super_partner_id_name AS partner, COUNT(*) AS n, SUM(transaction_amount) AS amount FROM part GROUP BY 1)
       SELECT * FROM totals""",
)
def read_query(i):
    text = """
      WITH part AS (SELECT * FROM {attempt} WHERE order_date >= :start AND order_date < :end),
        totals AS (SELECT super_partner_id_name AS partner, COUNT(*) AS n, SUM(transaction_amount) AS amount
                   FROM part GROUP BY 1)
      SELECT * FROM totals"""
    args = {"start": date(2024, 1, 8), "end": date(2024, 1, 22)}
    return tables.read_query(i.spark, text, args, attempt=i.attempt)


CSV_SCHEMA = T.StructType(
    [T.StructField("month", T.DateType()), T.StructField("call_type", T.StringType()), T.StructField("calls_count", T.LongType())]
)
MONTHLY = """SELECT CAST(date_trunc('month', call_date) AS DATE) AS month, call_type, COUNT(*) AS calls_count
             FROM v_daily_call GROUP BY 1, 2"""


def monthly_calls(i):
    return i.daily_call.groupBy(F.trunc("call_date", "month").alias("month"), "call_type").agg(
        F.count(F.lit(1)).alias("calls_count")
    )


@register("read_csv", "month:D call_type:s calls_count", MONTHLY)
def read_csv(i):
    path = scratch_folder(i.spark, "csv")
    tables.write_csv(monthly_calls(i), path)
    return tables.read_csv(i.spark, path, CSV_SCHEMA)


@register(
    "write_csv", "file_lines",
    f"SELECT COUNT(*) AS file_lines FROM ({MONTHLY})",
)
def write_csv(i):
    path = scratch_folder(i.spark, "csv")
    tables.write_csv(monthly_calls(i), path)
    lines = i.spark.read.text(path).filter(~F.startswith(F.col("value"), F.lit("month,")))
    return lines.agg(F.count(F.lit(1)).alias("file_lines"))


@register(
    "append_or_replace", "order_id:s invoice_id:s transaction_id:s is_cutoff_early cut_off_at_retry current_cltv:m",
    """SELECT order_id, invoice_id, transaction_id, success_probability < 0.05 AS is_cutoff_early, retries AS cut_off_at_retry,
         COALESCE(SUM(CASE WHEN transaction_status = 'accepted' THEN transaction_amount ELSE 0 END) OVER (
           PARTITION BY order_id ORDER BY transaction_datetime, transaction_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS current_cltv
       FROM v_attempt WHERE retries IS NOT NULL AND transaction_type IN ('sale', 'capture') AND invoice_type NOT LIKE '%trial%'""",
)
def append_or_replace(i):
    rows = scored_attempts(i.attempt).select(
        "order_id", "invoice_id", "transaction_id", (F.col("success_probability") < 0.05).alias("is_cutoff_early"),
        F.lit("2024-02-01 00:00:00").alias("cutoff_datetime"), F.col("retries").alias("cut_off_at_retry"),
        F.col("historical_collected_amount").alias("current_cltv"), F.lit(False).alias("random_selection"),
    )
    path = scratch_folder(i.spark, "predictions")
    # The second run of the same date replaces the first one.
    for _ in range(2):
        tables.append_or_replace(rows, path, tables.PREDICTION_SCHEMA, "replace", "2024-02-01")
    return i.spark.read.parquet(path)


@register(
    "report_tables", "call_type:s months calls_count",
    f"SELECT call_type, COUNT(*) AS months, SUM(calls_count) AS calls_count FROM ({MONTHLY}) GROUP BY 1",
)
def report_tables(i):
    detail = monthly_calls(i)
    summary = detail.groupBy("call_type").agg(F.count(F.lit(1)).alias("months"), F.sum("calls_count").alias("calls_count"))
    path = scratch_folder(i.spark, "report")
    tables.report_tables(detail, summary, path)
    return i.spark.read.parquet(f"{path}/summary")


@register(
    "generate_rows", "call_date:D n",
    """SELECT d.call_date, COUNT(o.call_id) AS n FROM (SELECT unnest(generate_series((SELECT MIN(call_date) FROM v_daily_call),
         (SELECT MAX(call_date) FROM v_daily_call), INTERVAL 1 DAY))::DATE AS call_date) d
       LEFT JOIN v_daily_call o ON o.call_date = d.call_date GROUP BY 1""",
)
def generate_rows(i):
    ends = i.daily_call.agg(F.min("call_date").alias("a"), F.max("call_date").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("call_date"))
    counts = i.daily_call.groupBy("call_date").agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, "call_date", "left").fillna(0, ["n"])


@register(
    "align_features", "retries bank:s unseen_number unseen_text:s",
    "SELECT retries, bank, -1 AS unseen_number, 'unknown' AS unseen_text FROM v_attempt",
)
def align_features(i):
    return tables.align_features(
        i.attempt, ["retries", "bank", "unseen_number", "unseen_text"], categorical=["bank", "unseen_text"]
    )
