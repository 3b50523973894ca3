"""Readers and writers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.jsonfn import camel_to_snake

# Columns of the tables written by the jobs.
PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("invoice_id", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("is_cutoff_early", T.BooleanType()),
        T.StructField("cutoff_datetime", T.TimestampNTZType()),
        T.StructField("cut_off_at_retry", T.LongType()),
        T.StructField("current_cltv", T.DoubleType()),
        T.StructField("random_selection", T.BooleanType()),
    ]
)
DAILY_CALL_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("predicted_calls", T.DoubleType()),
        T.StructField("pulled_at_utc", T.StringType()),
    ]
)
SLOT_CALL_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("day_of_week", T.StringType()),
        T.StructField("time_of_day", T.StringType()),
        T.StructField("predicted_calls_30mins", T.DoubleType()),
        T.StructField("pulled_at_utc", T.StringType()),
    ]
)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or a Parquet path when the name holds a slash. Later selects prune the columns."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_query(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """A SQL query with bound parameters over given DataFrames (``{name}`` in the text); no session state."""
    return spark.sql(sql, args=args or {}, **tables)


def optional_filter(df: DataFrame, column: str, value=None) -> DataFrame:
    """Filter only when a value is given."""
    return df if value is None else df.filter(F.col(column) == value)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """CSV with a declared schema; no inference pass."""
    return spark.read.csv(path, schema=schema, header=header, mode="PERMISSIVE")


def csv_or_table(spark: SparkSession, path: str | None, schema: T.StructType, table: Callable[[], DataFrame]) -> DataFrame:
    """The file when a path is given, else the table."""
    return read_csv(spark, path, schema) if path else table()


def check_columns(df: DataFrame, required: list[str], what: str = "columns") -> DataFrame:
    """Fail when required columns are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"missing {what}: {missing}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in declared order and type."""
    check_columns(df, schema.fieldNames(), "output columns")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def append_or_replace(df: DataFrame, path: str, schema: T.StructType, mode: str = "append", run_date: str | None = None):
    """Write with the declared schema; partitioned by run date when one is given.

    Replacing a run date replaces only that partition, so a repeated run is safe.
    """
    if mode not in ("append", "replace"):
        raise ValueError(f"mode {mode!r}: expected 'append' or 'replace'")
    out = conform(df, schema)
    writer = out.write.mode("append" if mode == "append" else "overwrite")
    if run_date is not None:
        out = out.withColumn("run_date", F.lit(run_date).cast("date"))
        writer = out.write.mode("append" if mode == "append" else "overwrite").partitionBy("run_date")
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def stamp_run(run_utc: Column, zone: str | None = None) -> Column:
    """Text of the run time given in UTC: as it is, or as wall time in a zone."""
    if zone is None:
        return F.date_format(run_utc, "yyyy-MM-dd HH:mm:ss")
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), run_utc), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def report_tables(detail: DataFrame, summary: DataFrame, path: str) -> None:
    """The two tables of a report side by side."""
    detail.write.mode("overwrite").parquet(f"{path}/detail")
    summary.write.mode("overwrite").parquet(f"{path}/summary")


def generate_rows(spark: SparkSession, n: int, name: str = "n") -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", name)


def align_features(df: DataFrame, features: list[str], categorical: list[str], number=-1, text="unknown") -> DataFrame:
    """The features in training order: missing ones filled with a default, extra ones dropped."""
    cells = []
    for c in features:
        if c in df.columns:
            cells.append(F.col(c))
        else:
            cells.append(F.lit(text if c in categorical else number).alias(c))
    return df.select(*cells)


def column_set_diff(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) columns against a feature list."""
    return [c for c in features if c not in df.columns], [c for c in df.columns if c not in features]


def normalise_columns(df: DataFrame, case: str = "lower") -> DataFrame:
    """Column names trimmed, 'fn(name)' unwrapped, symbols squeezed to '_'; lower, upper or snake case."""
    def name(c: str) -> str:
        c = re.sub(r"^\w+\((.*)\)$", r"\1", c.strip())
        c = re.sub(r"\W+", "_", c).strip("_")
        return {"lower": str.lower, "upper": str.upper, "snake": camel_to_snake}[case](c)

    return df.toDF(*[name(c) for c in df.columns])


def save_spec(spark: SparkSession, spec: dict, path: str) -> None:
    """A small JSON document next to a saved pipeline."""
    spark.createDataFrame([(json.dumps(spec, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_spec(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])
