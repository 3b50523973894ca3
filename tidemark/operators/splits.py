"""Leakage-safe splits, samples and weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import clip, hash_fraction, split_of
from tidemark.operators.ordered import (
    KeySkew,
    exact_quantiles,
    lookup_join,
    measure_skew,
    micros,
    position,
    prefix_scan,
)
from tidemark.sources.scratch import BROADCAST_ROWS, staged

# Shares of the past window.
HASH_BOUNDS = [("train", 0.75), ("stop", 0.85), ("calib", 0.95)]
ORDER_SALT = "retry_cutoff_v1"


def maturity_filter(df: DataFrame, key: str, ts: str, days: int = 30) -> DataFrame:
    """Rows of keys that started at least ``days`` before the last instant in the data."""
    starts = df.groupBy(key).agg(F.min(ts).alias("__start"))
    last = df.agg(F.max(ts) - F.make_dt_interval(F.lit(days))).scalar()
    mature = starts.filter(F.col("__start") <= last)
    return lookup_join(df, mature, [key], measure_skew(df.select(key, ts), [key], ts), "inner").drop("__start")


def maturity_runway(df: DataFrame, last_seen: str, asof: Column, label_days: int = 90, runway_days: int = 30):
    """Flags of orders whose label is not final or that the end of the data cut short."""
    end = df.agg(F.max(last_seen)).scalar()
    young = F.col(last_seen) > F.date_sub(asof, label_days)
    cut = F.col(last_seen) > F.date_sub(end, runway_days)
    return df.withColumns({"too_young": young, "truncated": cut, "is_mature": ~(young | cut)})


def chrono_quantile_split(df: DataFrame, key: str, ts: str, q: float = 0.85) -> DataFrame:
    """Add ``side``: 'past' for keys that start before the q-quantile of starts, else 'oot'."""
    starts = df.groupBy(key).agg(F.min(micros(ts)).alias("__start"))
    at = exact_quantiles(starts.withColumn("__v", F.col("__start").cast("double")), [], "__v", [q])
    side = starts.withColumn(
        "side", F.when(F.col("__start") < at.select("q").scalar(), "past").otherwise("oot")
    ).drop("__start")
    return lookup_join(df, side, [key], measure_skew(df.select(key, ts), [key], ts), "inner")


def asof_split(df: DataFrame, asof: Column, end: Column) -> DataFrame:
    """Past: rows before ``asof`` of invoices resolved and last seen before it; oot: rows in [asof, end).

    Needs ``resolved_at`` and ``invoice_last_txn``; other rows are dropped.
    """
    ts = F.col("transaction_datetime")
    past = (F.col("resolved_at") < asof) & (F.col("invoice_last_txn") < asof) & (ts < asof)
    side = F.when(past, "past").when((ts >= asof) & (ts < end), "oot")
    return df.withColumn("side", side).filter("side IS NOT NULL")


def hash_split(df: DataFrame, key: str, salt: str = ORDER_SALT, out: str = "split") -> DataFrame:
    """train / stop / calib / random_test by a stable hash of the key; no shuffle."""
    # Two steps, so that the digest is computed once per row.
    hashed = df.withColumn("__hash", hash_fraction(F.col(key), salt))
    return hashed.withColumn(out, split_of(F.col("__hash"), HASH_BOUNDS, "random_test")).drop("__hash")


def row_position_split(df: DataFrame, order: list[str], shares: list[tuple[str, float]], last: str) -> DataFrame:
    """Split by position in time order: the first int(n * share) rows, and so on."""
    ranked = prefix_scan(df, [], order, {"__pos": position()})
    n = df.agg(F.count(F.lit(1))).scalar()
    out = None
    for name, share in shares:
        test = F.col("__pos") <= F.floor(n * F.lit(share))
        out = F.when(test, name) if out is None else out.when(test, name)
    return ranked.withColumn("split", out.otherwise(F.lit(last))).drop("__pos")


def seeded_order(id_column: str, seed: int) -> Column:
    """Pseudo-random sort key that only depends on the id and the seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


# Cells of the first histogram of the hash: its leading bits.
CELL_BITS, LEAD_BITS = 16, 48


def _first_by_hash(df: DataFrame, keys: list[str], id_column: str, seed: int, wanted: Callable[[Column], Column], out: str) -> DataFrame:
    """Flag the first ``wanted(size)`` rows of each group in the seeded order.

    Distributed selection: a histogram of the hash per group finds the cell that holds the cut, the rows of that cell alone
    are ranked, and a filter against the cut flags all rows, which are neither sorted nor moved. Rows that share the
    id of the cut are ranked among themselves, so the number is exact."""
    digest = seeded_order(id_column, seed)
    hashed = df.withColumn("__digest", digest)
    lead = F.conv(F.substring("__digest", 1, LEAD_BITS // 4), 16, 10).cast("long")
    hashed = hashed.withColumn("__cell", F.shiftright(lead, LEAD_BITS - CELL_BITS))
    histogram = staged(hashed.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n")), "hash_cells")
    along = Window.partitionBy(*keys).orderBy("__cell")
    whole = F.sum("__n").over(Window.partitionBy(*keys))
    ranked = histogram.withColumns({"__upto": F.sum("__n").over(along), "__want": wanted(whole).cast("long")})
    edge = ranked.filter((F.col("__upto") >= F.col("__want")) & (F.col("__upto") - F.col("__n") < F.col("__want")))
    edge = edge.select(*keys, F.col("__cell").alias("__edge"), (F.col("__want") - F.col("__upto") + F.col("__n")).alias("__need"))
    inside = _beside(hashed.select(*keys, id_column, "__digest", "__cell"), edge, keys, "inner").filter(F.col("__cell") == F.col("__edge"))
    order = ["__digest", id_column]
    places = prefix_scan(inside, keys, order, {"__pos": position()})
    at = F.struct(*order)
    cut = places.groupBy(*keys).agg(
        F.max(F.when(F.col("__pos") <= F.col("__need"), at)).alias("__cut"), F.max("__need").alias("__need")
    )
    cut = staged(cut, "hash_cuts")
    # Rows of the id at the cut, and how many of them are still wanted.
    ties = _beside(inside.select(*keys, id_column, "__digest"), cut, keys, "inner").groupBy(*keys).agg(
        F.count_if(at < F.col("__cut")).alias("__below"), F.count_if(at == F.col("__cut")).alias("__tied"), F.max("__need").alias("__need")
    )
    left = ties.select(*keys, "__tied", (F.col("__need") - F.col("__below")).alias("__left"))
    cuts = staged(_beside(cut.drop("__need"), left, keys, "inner"), "hash_cuts")
    flagged = _beside(hashed, cuts, keys, "left")
    sure = (at < F.col("__cut")) | ((at == F.col("__cut")) & (F.col("__tied") == F.col("__left")))
    extra = ["__digest", "__cell", "__cut", "__tied", "__left"]
    if cuts.filter("__tied > __left").isEmpty():
        return flagged.withColumn(out, F.coalesce(sure, F.lit(False))).drop(*extra)
    torn = F.coalesce((at == F.col("__cut")) & (F.col("__tied") > F.col("__left")), F.lit(False))
    rest = flagged.filter(~torn).withColumn(out, F.coalesce(sure, F.lit(False)))
    some = prefix_scan(flagged.filter(torn), keys, order, {"__pos": position()})
    some = some.withColumn(out, F.col("__pos") <= F.col("__left")).drop("__pos")
    return rest.drop(*extra).unionByName(some.drop(*extra))


def _beside(rows: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Attach a table of one row per group, broadcast where its rows, counted, are few; without keys it has one row."""
    if not keys:
        row = table.select(F.struct(*table.columns)).first()
        found = {} if row is None else row[0].asDict(recursive=False)
        kinds = {f.name: f.dataType for f in table.schema}
        if row is None and how == "inner":
            return rows.limit(0).withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
        return rows.withColumns({c: _literal(found.get(c), k) for c, k in kinds.items()})
    return lookup_join(rows, F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, keys, KeySkew(list(keys)), how)


def _literal(value, kind) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in kind])
    return F.lit(None if isinstance(kind, T.StructType) else value).cast(kind)


def stratified_split(df: DataFrame, label: str, id_column: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """'val' for the first round(n * share) rows of each label in a seeded order, else 'train'."""
    flagged = _first_by_hash(df, [label], id_column, seed, lambda size: F.round(size * share), "__val")
    return flagged.withColumn("split", F.when(F.col("__val"), "val").otherwise("train")).drop("__val")


def exact_sample(df: DataFrame, id_column: str, share: float | None = None, n: int | None = None, seed: int = 42) -> DataFrame:
    """Flag exactly int(rows * share), or n, rows: ``is_sampled``."""
    def wanted(size: Column) -> Column:
        return F.least(F.lit(n), size) if n is not None else F.floor(size * F.lit(share))

    return _first_by_hash(df, [], id_column, seed, wanted, "is_sampled")


def walk_forward_folds(n_rows: Column, folds: int, test: int, val: int, spark) -> DataFrame:
    """Expanding folds over positions 1..n: (fold, train_end, val_end, test_end). Each ends its test
    window ``test`` rows after its validation window of ``val`` rows."""
    f = spark.range(1, folds + 1).select(F.col("id").cast("int").alias("fold"))
    test_end = n_rows - (F.lit(folds) - F.col("fold")) * test
    return f.select(
        "fold", (test_end - test - val).alias("train_end"), (test_end - test).alias("val_end"), test_end.alias("test_end")
    )


def fold_roles(df: DataFrame, order: list[str], folds: int, test: int, val: int, by: str | None = None) -> DataFrame:
    """Each row once per fold it belongs to, with its role: (fold, role). With ``by`` (a date) the positions are those of
    the distinct dates, so the rows of all series on a day have the same role."""
    if by is not None:
        days = fold_roles(df.select(by).distinct(), [by], folds, test, val)
        return df.join(days, by).select(*df.columns, "fold", "role")
    ranked = prefix_scan(df, [], order, {"__pos": position()})
    n = df.agg(F.count(F.lit(1))).scalar()
    pos = F.col("__pos")
    cells = []
    for f in range(1, folds + 1):
        test_end = n - (folds - f) * test
        role = (
            F.when(pos <= test_end - test - val, "train")
            .when(pos <= test_end - test, "val")
            .when(pos <= test_end, "test")
        )
        cells.append(F.struct(F.lit(f).alias("fold"), role.alias("role")))
    return (
        ranked.withColumn("__f", F.explode(F.array(*cells)))
        .select(*df.columns, "__f.fold", "__f.role")
        .filter("role IS NOT NULL")
    )


def cv_no_shuffle(df: DataFrame, order: list[str], k: int = 3) -> DataFrame:
    """Contiguous folds in time order; the first n mod k folds hold one row more."""
    ranked = prefix_scan(df, [], order, {"__pos": position()})
    n = df.agg(F.count(F.lit(1))).scalar()
    base, extra = F.floor(n / k), n % k
    p = F.col("__pos") - 1
    long_part = extra * (base + 1)
    fold = F.when(p < long_part, F.floor(p / (base + 1))).otherwise(extra + F.floor((p - long_part) / base))
    return ranked.withColumn("fold", (fold + 1).cast("int")).drop("__pos")


def class_weight(df: DataFrame, label: str, keys: list[str] = ()) -> DataFrame:
    """Negatives over positives."""
    positives = F.sum(F.col(label))
    negatives = F.count(F.col(label)) - positives
    return df.groupBy(*keys).agg(
        negatives.alias("negatives"), positives.alias("positives"),
        (negatives / F.greatest(positives, F.lit(1))).alias("scale_pos_weight"),
    )


def linear_recency_weight(df: DataFrame, order: list[str], low: float = 1.0, high: float = 5.0, by: str | None = None) -> DataFrame:
    """Weights evenly spaced from low to high in time order; with ``by`` (a date) over the distinct dates."""
    if by is not None:
        return df.join(linear_recency_weight(df.select(by).distinct(), [by], low, high), by).select(*df.columns, "sample_weight")
    ranked = prefix_scan(df, [], order, {"__pos": position()})
    n = df.agg(F.count(F.lit(1))).scalar()
    step = F.try_divide(F.lit(high - low), (n - 1).cast("double"))
    return ranked.withColumn(
        "sample_weight", F.lit(low) + F.coalesce(step, F.lit(0.0)) * (F.col("__pos") - 1)
    ).drop("__pos")


def exp_recency_weight(df: DataFrame, ts: str, half_life_days: float = 90.0) -> DataFrame:
    """Weights that halve with every half-life of age against the latest instant."""
    last = df.agg(F.max(micros(ts))).scalar()
    age = F.greatest((last - micros(ts)) / F.lit(86_400_000_000.0), F.lit(0.0))
    return df.withColumn("sample_weight", F.exp(-F.log(F.lit(2.0)) / half_life_days * age))


def hard_example_reweight(
    df: DataFrame, score: str, label: str, weight: str, net: float, zone: float
) -> DataFrame:
    """Raise the weights of misplaced and boundary rows, scale to mean 1, then clip to [0.1, 10].

    ``net`` and ``zone`` are percentiles of the score: positives at or below ``net`` get x2.0,
    negatives there x1.2, positives between ``net`` and ``zone`` x1.5.
    """
    cuts = exact_quantiles(df, [], score, [net / 100.0, zone / 100.0]).agg(
        F.struct(F.min("q").alias("net"), F.max("q").alias("zone"))
    ).scalar()
    inside = F.col(score) <= cuts["net"]
    edge = ~inside & (F.col(score) <= cuts["zone"])
    positive = F.col(label) == 1
    # The three factors.
    factor = F.when(inside & positive, 2.0).when(inside, 1.2).when(edge & positive, 1.5).otherwise(1.0)
    raised = df.withColumn("__w", F.col(weight) * factor)
    mean = raised.agg(F.avg("__w")).scalar()
    return raised.withColumn(weight, clip(F.col("__w") / mean, 0.1, 10.0)).drop("__w")


def split_report(df: DataFrame, split: str, label: str, date: str, key: str) -> DataFrame:
    """Rows, keys, positives, base rate and dates per split; too few positives are marked."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(key).alias("n_keys"),
        F.sum(label).alias("positives"),
        F.avg(label).alias("base_rate"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        (F.sum(label) < 20).cast("int").alias("few_positives"),
    )


def late_share(df: DataFrame, last_seen: str, split_date: Column) -> DataFrame:
    """Share of rows still running at the split date."""
    return df.agg(F.avg((F.col(last_seen) >= split_date).cast("double")).alias("late_share"))


def key_disjoint_check(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys found in more than one split; should be none."""
    per_key = df.groupBy(key).agg((F.min(split) != F.max(split)).alias("__shared"))
    return per_key.agg(
        F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.col("__shared").cast("long")), F.lit(0)).alias("shared_keys")
    )


