"""The early cut-off of retries: from attempts to a model artifact, and from live invoices to decisions.

Training takes the past declines of mature invoices (``attempts.training_frame``), sets the most recent invoices apart as
the out-of-time side, deals the orders of the rest to train, stop, calib and random_test, trains, calibrates, evaluates on
unseen orders and on unseen time, and writes the artifact. Scoring reads the artifact and the same features of live
invoices, from the same states. Nothing but the artifact passes between the two.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluation import degradation, eval_split
from tidemark.operators.ordered import exact_quantiles, micros
from tidemark.operators.splits import hash_split
from tidemark.plans import attempts, scoring
from tidemark.plans.boosting import CLASSIFY, Boost
from tidemark.sources.scratch import staged

LABEL = "is_eventually_successful"
# Ids, times, the outcome and what only evaluation may read.
NOT_FEATURES = [
    *attempts.INVOICE, "transaction_id", "transaction_datetime", "transaction_status", "invoice_start", "invoice_last_txn", "resolved_at",
    "trial_collected_amount", LABEL, "split",
]
TEXT = ["super_partner_id_name", "bank"]
OUT_OF_TIME, UNSEEN_ORDERS = "oot", "random_test"
# Invoices that start from this quantile of starts on are the out-of-time side.
RECENT = 0.85


def model_columns(frame: DataFrame) -> DataFrame:
    """What both jobs add: the family of the last decline code is its first character."""
    return frame.withColumn("decline_family", F.left(F.col("last_decline_code").cast("string"), F.lit(1)))


def roles(frame: DataFrame) -> scoring.FeatureRoles:
    return scoring.feature_roles(frame, NOT_FEATURES, TEXT)


def split_frame(frame: DataFrame, recent: float = RECENT) -> DataFrame:
    """Add ``split``: oot for invoices that start at or after the quantile of starts, else train, stop, calib or
    random_test by a hash of the order. No order is in two of these four; returning customers may also be in oot.

    The frame is staged once, with the side of its order, and the quantile is one number read from that; what is left to its
    readers is a comparison."""
    dealt = staged(hash_split(frame, "order_id"), "cutoff_parts")
    starts = dealt.select(*attempts.INVOICE, micros("invoice_start").cast("double").alias("__start")).distinct()
    cut = exact_quantiles(starts, [], "__start", [recent]).first()
    late = micros("invoice_start").cast("double") >= F.lit(cut["q"] if cut else None).cast("double")
    return dealt.withColumn("split", F.when(late, OUT_OF_TIME).otherwise(F.col("split")))


@dataclass
class CutoffModel:
    scorer: scoring.Scorer
    report: DataFrame  # metrics per split
    drift: DataFrame  # what is lost from unseen orders to unseen time
    parts: DataFrame


def train_cutoff(fact: DataFrame, bin_tier: DataFrame, path: str, days: int = 30, threshold: float = 0.05, boost: Boost = CLASSIFY) -> CutoffModel:
    """Train on all attempts known, and write the artifact to ``path``.

    The report has the metrics of calibrated probabilities per split: random_test are orders, oot days that training has
    not seen."""
    frame = model_columns(attempts.training_frame(fact, bin_tier, days))
    parts = split_frame(frame)
    found = roles(parts)
    banned = scoring.banned_columns(found, NOT_FEATURES)
    if banned:
        raise ValueError(f"not features: {banned}")
    scorer = scoring.train_scorer(parts.filter(F.col("split") != OUT_OF_TIME), found, LABEL, boost=boost, fold_key="order_id")
    scored = staged(scorer.score(parts).select("split", LABEL, "success_prob"), "cutoff_scored")
    report = staged(eval_split(scored, "success_prob", LABEL, "split"), "cutoff_report")
    metrics = {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in report.collect()}
    scoring.save_artifact(scorer, path, {"threshold": threshold, "maturity_days": days, "metrics": metrics})
    return CutoffModel(scorer, report, degradation(report, "split", UNSEEN_ORDERS, OUT_OF_TIME, "train"), parts)


def score_cutoff(fact: DataFrame, bin_tier: DataFrame, path: str, asof: Column, since: Column, run_at: Column) -> DataFrame:
    """Decisions for the live invoices that stand declined, with the model and the threshold of the artifact."""
    scorer, spec = scoring.load_artifact(fact.sparkSession, path)
    features = staged(model_columns(attempts.attempt_features(fact, bin_tier, asof, since)), "live_features")
    return scoring.score_batch(scorer, features, run_at, spec["threshold"])
