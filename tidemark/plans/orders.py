"""Order-level table: one row per order from transactions, and its hygiene reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cleaning import numeric_columns, text_columns


def label_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label."""
    return df.groupBy(key).agg((F.min(label) != F.max(label)).alias("__mixed")).filter("__mixed").select(key)


def one_per_transaction(items: DataFrame, key: str = "transaction_id", label: str = "label") -> DataFrame:
    """One row per transaction: the one with the highest label, then the smallest part and supplier.

    A minimum of (rank, row) combines on the map side; no group is sorted.
    """
    rank = F.struct((-F.col(label)).alias("r"), F.col("part_id").alias("p"), F.col("supp_id").alias("s"))
    payload = [c for c in items.columns if c != key]
    first = items.groupBy(key).agg(F.min_by(F.struct(*payload), rank).alias("__row"))
    return first.select(key, "__row.*").select(*items.columns)


def first_value(column: str, order: list[str]) -> Column:
    """First non-null value in attempt order."""
    present = F.col(column).isNotNull()
    return F.min_by(F.col(column), F.when(present, F.struct(*order)))


def order_rollup(rows: DataFrame) -> DataFrame:
    """One row per order: span, number of attempts, highest label, amounts, first known categories."""
    order = ["transaction_date", "transaction_id"]
    return rows.groupBy("order_id").agg(
        F.min("transaction_date").alias("order_start"),
        F.max("transaction_date").alias("order_last_txn"),
        F.count(F.lit(1)).alias("n_transactions"),
        F.max("label").alias("label"),
        F.sum("transaction_amount").alias("amount_sum"),
        F.max("transaction_amount").alias("amount_max"),
        F.max("quantity").alias("quantity_max"),
        first_value("cascade_type", order).alias("first_cascade"),
        first_value("bank", order).alias("bank"),
        first_value("order_status", order).alias("order_status"),
    )


def rollup_by_role(rows: DataFrame, key: str, order: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """One row per key whatever the columns: number of rows, sum and maximum of every numeric column,
    first known value of every text column in row order. Columns that come out constant can be dropped
    with ``drop_constant_columns``."""
    left_out = (key, *order, *skip)
    numbers, texts = numeric_columns(rows, left_out), text_columns(rows, left_out)
    cells = [F.count(F.lit(1)).alias("n_rows")]
    cells += [f(c).alias(f"{c}_{name}") for c in numbers for name, f in (("sum", F.sum), ("max", F.max))]
    return rows.groupBy(key).agg(*cells, *[first_value(c, order).alias(c) for c in texts])


def group_share(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per group and share of all rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / df.agg(F.count(F.lit(1))).scalar())
