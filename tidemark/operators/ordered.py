"""Ordered computations that stay parallel when one key holds most of the rows.

A plain window puts all rows of a key into one task. ``prefix_scan`` measures the keys
first. Where every key is small it is a plain window. Otherwise the rows are range-partitioned
by key and the whole order, which cuts large keys into blocks of about equal size whatever
their values are; each block is scanned on its own and the totals of the key's earlier blocks
(a small table) are added. Both give the same result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import hot_blocks
from tidemark.session import hot_rows as session_hot_rows
from tidemark.sources.scratch import staged

# Hot keys that are looked up by broadcast; more of them are joined as usual.
BROADCAST_KEYS = 100_000


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, free of any time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (
        F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000
        + F.hour(ts).cast("long") * 3_600_000_000
        + F.minute(ts).cast("long") * 60_000_000
        + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    )


# --------------------------------------------------------------------------- scans


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` over ``expr``, with or without the current row."""

    kind: str
    expr: Column | None = None
    inclusive: bool = False


def running_sum(expr: Column, inclusive: bool = False) -> Scan:
    return Scan("sum", expr, inclusive)


def running_count(expr: Column | None = None, inclusive: bool = False) -> Scan:
    return Scan("count", F.lit(1) if expr is None else expr, inclusive)


def running_max(expr: Column, inclusive: bool = False) -> Scan:
    return Scan("max", expr, inclusive)


def running_min(expr: Column, inclusive: bool = False) -> Scan:
    return Scan("min", expr, inclusive)


def previous(expr: Column) -> Scan:
    return Scan("previous", expr)


def position() -> Scan:
    return Scan("count", F.lit(1), True)


_FOLD = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class KeySkew:
    """Hot keys of a table: the key columns, the hot keys (None without any), how many blocks to cut
    the table into, and whether the hot keys are few enough to be broadcast."""

    keys: list[str]
    hot: DataFrame | None = field(default=None)
    blocks: int = 1
    few: bool = True


def measure_skew(df: DataFrame, keys: list[str], order: str, hot_rows: int | None = None) -> KeySkew:
    """Find the keys with more rows than one task should sort. Runs one map-side combined count,
    and a second one that writes the list only where there are such keys.

    Measure on the widest, cheapest table that the keyed steps start from (before aggregation, with
    two columns) and hand the result to each of them: too high a count only means more blocks.
    """
    limit = session_hot_rows(df.sparkSession) if hot_rows is None else hot_rows
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total, hot = sizes.agg(F.sum("__n"), F.count_if(F.col("__n") > limit)).first()
    if not hot:
        return KeySkew(keys)
    found = staged(sizes.filter(F.col("__n") > limit).select(*keys, F.lit(1).alias("__one")), "hot_keys")
    return KeySkew(keys, found, hot_blocks(df.sparkSession, total, limit), hot <= BROADCAST_KEYS)


def _key_window(keys: list[str], order: list[Column]):
    return Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy(*order)


def _local(scan: Scan, window) -> Column:
    if scan.kind == "previous":
        return F.lag(scan.expr).over(window)
    last = 0 if scan.inclusive else -1
    return _FOLD[scan.kind](scan.expr).over(window.rowsBetween(Window.unboundedPreceding, last))


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    scans: dict[str, Scan],
    skew: KeySkew | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Add running values per key in the order of ``order`` (last columns break ties).

    ``reverse`` walks from the last row to the first.
    """
    if skew is None:
        skew = measure_skew(df, keys, order[0])
    ordering = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    if skew.hot is None:
        window = _key_window(keys, ordering)
        return df.withColumns({name: _local(s, window) for name, s in scans.items()})
    return _blocked_scan(df, keys, order, ordering, scans, skew.blocks, reverse)


def _blocked_scan(df, keys, order, ordering, scans, blocks, reverse):
    ranged = df.repartitionByRange(blocks, *keys, *order)
    # Written once: block numbers must be the same for the totals and the rows.
    tagged = staged(ranged.withColumn("__block", F.spark_partition_id().cast("long")), "blocks")

    last_of = F.min if reverse else F.max
    row_order = F.struct(*[F.col(c) for c in order])
    folds = []
    for name, s in scans.items():
        if s.kind == "previous":
            folds.append(last_of(F.struct(row_order.alias("o"), s.expr.alias("v"))).alias(f"__c_{name}"))
        else:
            folds.append(_FOLD[s.kind](s.expr).alias(f"__c_{name}"))
    per_block = tagged.groupBy(*keys, "__block").agg(*folds)
    block_order = F.col("__block").desc() if reverse else F.col("__block").asc()
    earlier = _key_window(keys, [block_order])
    carried = {}
    for name, s in scans.items():
        column = F.col(f"__c_{name}")
        if s.kind == "previous":
            carried[f"__c_{name}"] = F.lag(column["v"]).over(earlier)
        else:
            fold = F.sum if s.kind == "count" else _FOLD[s.kind]
            carried[f"__c_{name}"] = fold(column).over(
                earlier.rowsBetween(Window.unboundedPreceding, -1)
            )
    carry = per_block.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__block").alias("__k_block"),
        *[c.alias(n) for n, c in carried.items()],
    )
    window = _key_window([*keys, "__block"], ordering)
    local = tagged.withColumns({f"__l_{n}": _local(s, window) for n, s in scans.items()})
    local = local.withColumn("__first", F.row_number().over(window) == 1)
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys],
        (F.col("__block") == F.col("__k_block")),
    )
    out = local.join(carry, on, "left")
    results = {}
    for name, s in scans.items():
        here, before = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if s.kind == "sum":
            before = before.cast(local.schema[f"__l_{name}"].dataType)
            results[name] = F.when(here.isNull(), before).when(before.isNull(), here).otherwise(here + before)
        elif s.kind == "count":
            results[name] = here + F.coalesce(before, F.lit(0))
        elif s.kind == "max":
            results[name] = F.greatest(here, before)
        elif s.kind == "min":
            results[name] = F.least(here, before)
        else:
            results[name] = F.when(F.col("__first"), before).otherwise(here)
    return out.select(*[F.col(c) for c in df.columns if c not in results], *[c.alias(n) for n, c in results.items()])


# --------------------------------------------------------------------------- lookups


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], skew: KeySkew, how: str = "left") -> DataFrame:
    """Attach a table with one row per key (or per group of one hot key) to rows.

    Where no key is hot, or very many are, this is a plain join, whose skewed partitions Spark splits.
    Otherwise the rows of the hot keys stay where they are and the table's rows for them are
    broadcast, after a count of them. All other rows join as usual.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how {how!r}: expected 'left' or 'inner'")
    if skew.hot is None or not skew.few:
        return _null_safe_join(rows, table, keys, how)
    hot = F.broadcast(skew.hot.select(*[F.col(k).alias(f"__h_{k}") for k in skew.keys]))

    def is_hot():
        return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in skew.keys])

    table_hot = staged(table.join(hot, is_hot(), "left_semi"), "hot_rows")
    if table_hot.count() > BROADCAST_KEYS:
        return _null_safe_join(rows, table, keys, how)
    rest = _null_safe_join(rows.join(hot, is_hot(), "left_anti"), table, keys, how)
    hot_rows = _null_safe_join(rows.join(hot, is_hot(), "left_semi"), F.broadcast(table_hot), keys, how)
    return rest.unionByName(hot_rows)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    right = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return left.join(right, on, how).drop(*[f"__k_{k}" for k in keys])


# --------------------------------------------------------------------------- ranges


@dataclass(frozen=True)
class TimeRange:
    """Rows with time in [t - start, t - end]; ``closed_end=False`` gives [t - start, t - end)."""

    start_us: int
    end_us: int = 0
    closed_end: bool = False


DAY_US = 86_400_000_000
SECOND_US = 1_000_000


def trailing_days(days: int) -> TimeRange:
    """[t - days, t): earlier rows only, rows at the same instant left out."""
    return TimeRange(days * DAY_US)


def range_totals(
    df: DataFrame, keys: list[str], ts: str, value: Column, ranges: dict[str, TimeRange],
    targets: DataFrame | None = None, skew: KeySkew | None = None,
) -> DataFrame:
    """Count and sum of ``value`` over time ranges before given points: (keys, __t, <name>_n, <name>_s).

    ``targets`` (with the same keys and time column) are the rows to answer for; by default
    all rows of ``df``. One row per distinct (keys, instant); ``__t`` is the instant in microseconds.

    The rows are first added up per (key, instant). Each range is the difference of two
    running totals, read at probe points that mark its ends, so the cost does not grow with
    the length of the range and a key that holds most rows is scanned in blocks.
    """
    if skew is None:
        # Every instant brings its own row and two probes per range.
        limit = max(session_hot_rows(df.sparkSession) // (1 + 2 * len(ranges)), 1)
        skew = measure_skew(df, keys, ts, limit)
    points = df.withColumn("__t", micros(ts)).groupBy(*keys, "__t").agg(
        F.count(value).alias("n"), F.sum(value).alias("s")
    )
    kind = points.schema["s"].dataType
    asked = points if targets is None else targets.withColumn("__t", micros(ts)).select(*keys, "__t").distinct()
    ends = []
    for name, r in ranges.items():
        for tag, offset, rank in ((f"{name}<", r.start_us, 0), (f"{name}>", r.end_us, 2 if r.closed_end else 0)):
            ends.append(
                F.struct((F.col("__t") - F.lit(offset)).alias("at"), F.lit(rank).alias("rank"), F.lit(tag).alias("tag"))
            )
    probe = [F.lit(0).cast("long").alias("n"), F.lit(0).cast(kind).alias("s")]
    if targets is None:
        # Points and probes come from the same rows: one pass.
        own = F.struct(F.col("__t").alias("at"), F.lit(1).alias("rank"), F.lit("").alias("tag"))
        marks = points.withColumn("p", F.explode(F.array(own, *ends)))
        data = F.col("p.tag") == ""
        marks = marks.select(
            *keys, "__t", "p.*", F.when(data, F.col("n")).otherwise(F.lit(0)).alias("n"),
            F.when(data, F.col("s")).otherwise(F.lit(0)).cast(kind).alias("s"),
        )
    else:
        data = points.select(
            *keys, "__t", F.col("__t").alias("at"), F.lit(1).alias("rank"), F.lit("").alias("tag"), "n", "s"
        )
        probes = asked.withColumn("p", F.explode(F.array(*ends))).select(*keys, "__t", "p.*", *probe)
        marks = data.unionByName(probes)
    totals = prefix_scan(
        marks, keys, ["at", "rank"],
        {"cn": running_sum(F.col("n"), True), "cs": running_sum(F.col("s"), True)}, skew,
    )
    picks = []
    for name in ranges:
        for out, column in (("n", "cn"), ("s", "cs")):
            upper = F.max(F.when(F.col("tag") == f"{name}>", F.col(column)))
            lower = F.max(F.when(F.col("tag") == f"{name}<", F.col(column)))
            picks.append((F.coalesce(upper, F.lit(0)) - F.coalesce(lower, F.lit(0))).alias(f"{name}_{out}"))
    return totals.filter("tag <> ''").groupBy(*keys, "__t").agg(*picks)


def at_instants(rows: DataFrame, keys: list[str], ts: str, stats: DataFrame) -> DataFrame:
    """Attach a (keys, __t, ...) table to rows by key and instant; keys may be null."""
    stats = stats.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, "__t"]})
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys],
        F.col("__t") == F.col("__k___t"),
    )
    joined = rows.withColumn("__t", micros(ts)).join(stats, on, "left")
    return joined.drop("__t", *[f"__k_{k}" for k in [*keys, "__t"]])


def rolling_ranges(
    df: DataFrame, keys: list[str], ts: str, value: Column, ranges: dict[str, TimeRange], skew: KeySkew | None = None
) -> DataFrame:
    """All rows with count and sum of ``value`` over time ranges before them: ``<name>_n``, ``<name>_s``."""
    return at_instants(df, keys, ts, range_totals(df, keys, ts, value, ranges, skew=skew))


# --------------------------------------------------------------------------- quantiles


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], name: str = "q"
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per (keys, prob).

    Equal values are counted first and ranked by a scan, so no task holds all values.
    """
    given = df.filter(F.col(value).isNotNull())
    counts = given.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    skew = measure_skew(given.select(*keys, value), keys, value)
    ranked = prefix_scan(counts, keys, [value], {"__upto": running_sum(F.col("__c"), True)}, skew)
    if keys:
        sizes = counts.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.sum("__c").alias("__total"))
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
        ranked = ranked.join(sizes, on).drop(*[f"__k_{k}" for k in keys])
    else:
        ranked = ranked.withColumn("__total", counts.agg(F.sum("__c")).scalar())
    ranked = ranked.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    at = F.col("prob") * (F.col("__total") - 1)
    low, high = F.floor(at), F.ceil(at)
    first = F.col("__upto") - F.col("__c")

    def holds(rank):
        return (first <= rank) & (rank < F.col("__upto"))

    picked = ranked.filter(holds(low) | holds(high))
    out = picked.groupBy(*keys, "prob").agg(
        F.max(F.when(holds(low), F.col(value))).alias("__vl"),
        F.max(F.when(holds(high), F.col(value))).alias("__vh"),
        F.max(at - low).alias("__f"),
    )
    return out.select(
        *keys, "prob", (F.col("__vl") + (F.col("__vh") - F.col("__vl")) * F.col("__f")).alias(name)
    )


def quantile_columns(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """``exact_quantiles`` with one named column per probability."""
    long = exact_quantiles(df, keys, value, list(probs.values()))
    cells = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("q"))).alias(n) for n, p in probs.items()]
    return long.groupBy(*keys).agg(*cells)
