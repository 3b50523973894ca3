"""The cut-off training and scoring jobs on the attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.economics import FEATURES_SQL, FRAME_SQL, MATURE_DAYS
from tidemark.catalog.learning import BOOST
from tidemark.catalog.registry import register
from tidemark.catalog.splits import HASH, HASH_SPLIT
from tidemark.catalog.windows import asof, since
from tidemark.plans import attempts, cutoff
from tidemark.sources.scratch import scratch_folder, staged

PARTS_SQL = f"""{FRAME_SQL},
  framed AS (SELECT * FROM known JOIN mature USING (order_id, invoice_id)),
  cut AS (SELECT quantile_cont(CAST(epoch_us(invoice_start) AS DOUBLE), 0.85) AS edge FROM (SELECT DISTINCT order_id, invoice_id, invoice_start FROM framed)),
  parts AS (SELECT framed.*, CASE WHEN epoch_us(invoice_start) >= (SELECT edge FROM cut) THEN 'oot' ELSE {HASH_SPLIT.format(h=HASH.format(k='order_id'))} END AS split
    FROM framed)"""


@register(
    "cutoff_split", "split:s n_rows n_orders n_invoices n_positive first_start:t last_start:t shared_orders",
    f"""WITH {PARTS_SQL} SELECT split, COUNT(*) AS n_rows, COUNT(DISTINCT order_id) AS n_orders, COUNT(DISTINCT (order_id, invoice_id)) AS n_invoices,
          SUM(is_eventually_successful) AS n_positive, MIN(invoice_start) AS first_start, MAX(invoice_start) AS last_start,
          (SELECT COUNT(*) FROM (SELECT order_id FROM parts WHERE split <> 'oot' GROUP BY 1 HAVING COUNT(DISTINCT split) > 1)) AS shared_orders
        FROM parts GROUP BY split""",
)
def cutoff_split(i):
    """Rows, orders and invoices per split; no order in two of train, stop, calib and random_test."""
    parts = cutoff.split_frame(attempts.training_frame(i.attempt, i.bin_tier, MATURE_DAYS))
    dealt = parts.filter(F.col("split") != cutoff.OUT_OF_TIME).groupBy("order_id").agg(F.count_distinct("split").alias("n"))
    shared = dealt.agg(F.count_if(F.col("n") > 1)).first()[0]
    return parts.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("order_id").alias("n_orders"), F.count_distinct("order_id", "invoice_id").alias("n_invoices"),
        F.sum("is_eventually_successful").alias("n_positive"), F.min("invoice_start").alias("first_start"), F.max("invoice_start").alias("last_start"),
        F.lit(shared).alias("shared_orders"),
    )


_trained: dict[tuple[str, str], tuple[str, cutoff.CutoffModel]] = {}


def trained(i) -> tuple[str, cutoff.CutoffModel]:
    """Artifact folder and report of the training job, which runs once for a table."""
    key = (i.spark.sparkContext.applicationId, i.sf_dir)
    if key not in _trained:
        path = scratch_folder(i.spark, "cutoff_artifact")
        _trained[key] = path, cutoff.train_cutoff(i.attempt, i.bin_tier, path, MATURE_DAYS, boost=BOOST)
    return _trained[key]


@register(
    "cutoff_training", "split:s n_rows base_rate:d calibrated_mean:f metrics_known",
    f"""WITH {PARTS_SQL} SELECT split, COUNT(*) AS n_rows, AVG(is_eventually_successful) AS base_rate,
          CASE WHEN split = 'calib' THEN AVG(is_eventually_successful) END AS calibrated_mean, 1 AS metrics_known FROM parts GROUP BY split""",
)
def cutoff_training(i):
    """The job's report: every split with its base rate; on the calibration rows the mean probability is that rate."""
    report = trained(i)[1].report
    mean = F.col("obs_exp") * F.col("base_rate")
    known = F.col("log_loss").isNotNull() & (F.col("auc").isNull() | F.col("auc").between(0, 1)) & F.col("brier").between(0, 1)
    return report.select(
        "split", "n_rows", "base_rate", F.when(F.col("split") == "calib", mean).alias("calibrated_mean"), known.cast("int").alias("metrics_known")
    )


@register(
    "cutoff_scoring", "order_id:s invoice_id:s transaction_id:s cut_off_at_retry current_cltv:m decided n_flagged",
    f"""SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(invoice_id AS VARCHAR) AS invoice_id, CAST(transaction_id AS VARCHAR) AS transaction_id,
          retries AS cut_off_at_retry, historical_collected_amount AS current_cltv, 1 AS decided,
          CAST(floor(COUNT(*) OVER () * 0.1) AS BIGINT) AS n_flagged FROM ({FEATURES_SQL})""",
)
def cutoff_scoring(i):
    """Decisions of the scoring job for the live invoices of the feature table, a tenth flagged at random."""
    path, _ = trained(i)
    out = staged(cutoff.score_cutoff(i.attempt, i.bin_tier, path, asof(), since(), F.expr("TIMESTAMP_NTZ '2024-02-10 00:00:00'")), "decisions")
    flagged = out.filter("random_selection").count()
    return out.select(
        "order_id", "invoice_id", "transaction_id", "cut_off_at_retry", "current_cltv", F.col("is_cutoff_early").isNotNull().cast("int").alias("decided"),
        F.lit(flagged).alias("n_flagged"),
    )
