"""Session settings the library relies on, and the few knobs it reads from a session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Rows of one key that a single task may sort. Keys above it are split into blocks.
HOT_ROWS_SETTING = "spark.tidemark.hotRows"
HOT_ROWS_DEFAULT = 500_000
# Blocks to cut a table with larger keys into; by default four for every HOT_ROWS rows.
HOT_BLOCKS_SETTING = "spark.tidemark.hotBlocks"


def local_session(cores: str = "8", app: str = "tidemark") -> SparkSession:
    """Session for tests and local measurements; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS_DEFAULT)))


def hot_blocks(spark: SparkSession, rows: int, limit: int) -> int:
    given = spark.conf.get(HOT_BLOCKS_SETTING, None)
    return int(given) if given else -(-rows // limit) * 4


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch folder only in local mode, an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder
