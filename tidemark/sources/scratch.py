"""A new folder per use, under the shared folder the session names."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir


# Rows of a lookup table up to which it is broadcast.
BROADCAST_ROWS = 100_000


def scratch_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back: later steps read only the columns they
    need, nothing upstream runs again, and a lost executor costs one task."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store after its last reader."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def checked(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """A lookup table written once, and how to join parts of it: by broadcast where its rows, counted,
    are few, else as it is."""
    side = staged(df, name)
    return side, (F.broadcast if side.count() <= BROADCAST_ROWS else lambda part: part)
