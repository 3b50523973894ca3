"""Monthly forecasts of many series at once.

A series has one row per month, so its windows are short; the number of series is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA, BETA, LEVEL_POINTS = 0.8, 0.2, 6


def by_month(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("month")


def monthly_total(
    df: DataFrame, date: str, keys: list[str] = (), known: DataFrame | None = None, override: bool = False
) -> DataFrame:
    """Rows per series and month: (keys, month, y).

    ``known`` adds actuals given by hand: only for months without data, or with ``override`` for all its months.
    """
    keys = list(keys)
    out = df.groupBy(*keys, F.trunc(date, "month").alias("month")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    if known is None:
        return out
    ranked = out.withColumn("__rank", F.lit(1)).unionByName(
        known.select(*keys, "month", F.col("y").cast("double").alias("y"), F.lit(0 if override else 2).alias("__rank"))
    )
    first = F.min_by("y", "__rank").alias("y")
    return ranked.groupBy(*keys, "month").agg(first)


def complete_months(monthly: DataFrame, last_date: Column) -> DataFrame:
    """Leave out the month that ``last_date`` lies in."""
    return monthly.filter(F.col("month") < F.trunc(last_date, "month"))


def month_spine(monthly: DataFrame, keys: list[str] = (), ahead: int = 0, skip: int = 0) -> DataFrame:
    """Months from the first (plus ``skip``) to the last (plus ``ahead``) of each series."""
    ends = monthly.groupBy(*keys).agg(
        F.add_months(F.min("month"), skip).alias("a"), F.add_months(F.max("month"), ahead).alias("b")
    )
    return ends.filter("a <= b").select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))


def centered_trend(monthly: DataFrame, keys: list[str] = (), period: int = 12) -> DataFrame:
    """Two-sided moving average over a year: half weights on the outermost months, null at the ends."""
    w = by_month(list(keys))
    half = period // 2
    inner = F.sum("y").over(w.rowsBetween(-(half - 1), half - 1))
    ends = F.lag("y", half).over(w) + F.lead("y", half).over(w)
    return monthly.withColumn("trend", (inner + ends * 0.5) / period)


def full_trend(monthly: DataFrame, keys: list[str] = (), period: int = 12) -> DataFrame:
    """Trend extended to both ends by a line through the first and last ``period`` trend points."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    df = centered_trend(monthly, keys, period).withColumn("__i", F.row_number().over(by_month(keys)).cast("double"))
    known = F.col("trend").isNotNull()
    df = df.withColumns(
        {"__a": F.min(F.when(known, F.col("__i"))).over(w), "__b": F.max(F.when(known, F.col("__i"))).over(w)}
    )
    out = df
    for side, inside in (("lo", F.col("__i") < F.col("__a") + period), ("hi", F.col("__i") > F.col("__b") - period)):
        y, x = F.when(inside & known, F.col("trend")), F.when(inside & known, F.col("__i"))
        out = out.withColumns(
            {f"__s_{side}": F.regr_slope(y, x).over(w), f"__c_{side}": F.regr_intercept(y, x).over(w)}
        )

    def line(side):
        return F.col(f"__c_{side}") + F.col(f"__s_{side}") * F.col("__i")

    trend = F.when(F.col("__i") < F.col("__a"), line("lo")).when(F.col("__i") > F.col("__b"), line("hi")).otherwise(F.col("trend"))
    return out.select(*keys, "month", "y", trend.alias("trend"))


def seasonal_index(monthly: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Multiplicative factor per calendar month, mean 1: mean of y over trend."""
    keys = list(keys)
    ratio = full_trend(monthly, keys).groupBy(*keys, F.month("month").alias("month_of_year")).agg(
        F.avg(F.try_divide(F.col("y"), F.col("trend"))).alias("__f")
    )
    mean = F.avg("__f").over(Window.partitionBy(*keys))
    return ratio.select(*keys, "month_of_year", (F.col("__f") / mean).alias("factor"))


def ses_level(monthly: DataFrame, keys: list[str] = (), alpha: float = ALPHA, n: int = LEVEL_POINTS) -> DataFrame:
    """Level of exponential smoothing over the last n points up to each month: (keys, month, level, points).

    The first of the n points starts the level. Written as the weighted sum it is, so one window
    gives the level at every possible origin.
    """
    w = by_month(list(keys))
    points = F.least(F.row_number().over(w), F.lit(n))
    level = F.lit(0.0)
    for back in range(n):
        weight = F.when(points - 1 == back, (1 - alpha) ** back).otherwise(alpha * (1 - alpha) ** back)
        level = level + F.when(points > back, weight * F.lag("y", back).over(w)).otherwise(0.0)
    return monthly.withColumns({"level": level, "history": F.row_number().over(w)})


def origin_of(targets: DataFrame, monthly: DataFrame, keys: list[str], lead: int) -> DataFrame:
    """Last month with data that is known ``lead`` months before each target; targets without one drop out."""
    keys = list(keys)
    spine = month_spine(monthly, keys)
    known = F.max("__seen").over(by_month(keys).rowsBetween(Window.unboundedPreceding, 0))
    seen = spine.join(monthly.select(*keys, "month", F.col("month").alias("__seen")), [*keys, "month"], "left")
    origins = seen.select(*keys, F.col("month").alias("__cutoff"), known.alias("origin"))
    last = monthly.groupBy(*keys).agg(F.max("month").alias("__last"))
    joined = targets.join(last, keys) if keys else targets.withColumn("__last", last.scalar())
    joined = joined.withColumn("__cutoff", F.least(F.add_months("month", -lead), F.col("__last")))
    return joined.join(origins, [*keys, "__cutoff"], "left").drop("__cutoff", "__last")


def rolling_origin_join(monthly: DataFrame, targets: DataFrame, keys: list[str] = (), lead: int = 3) -> DataFrame:
    """History known at each target's origin: points, sum and last month, from running totals and one key join."""
    keys = list(keys)
    w = by_month(keys).rowsBetween(Window.unboundedPreceding, 0)
    totals = monthly.select(
        *keys, F.col("month").alias("origin"), F.count("y").over(w).alias("points"), F.sum("y").over(w).alias("total")
    )
    return origin_of(targets, monthly, keys, lead).join(totals, [*keys, "origin"], "left")


def rolling_backtest(
    monthly: DataFrame, keys: list[str] = (), lead: int = 3, ahead: int = 0, min_points: int = 6,
    factors: DataFrame | None = None,
) -> DataFrame:
    """Level known ``lead`` months earlier x seasonal factor, per target month.

    By default the factors come from the full history, which looks ahead of the origin; pass
    factors of an earlier cut to avoid that. Origins with fewer than ``min_points`` months give none.
    """
    keys = list(keys)
    levels = ses_level(monthly, keys).select(*keys, F.col("month").alias("origin"), "level", "history")
    factors = seasonal_index(monthly, keys) if factors is None else factors
    targets = origin_of(month_spine(monthly, keys, ahead), monthly, keys, lead)
    out = targets.join(levels, [*keys, "origin"]).filter(F.col("history") >= min_points)
    out = out.withColumn("month_of_year", F.month("month")).join(factors, [*keys, "month_of_year"])
    actual = monthly.select(*keys, "month", F.col("y").alias("actual"))
    out = out.withColumn("predicted", F.col("level") * F.col("factor")).join(actual, [*keys, "month"], "left")
    return out.select(*keys, "month", "origin", "level", "factor", "predicted", "actual")


def hybrid_forecast_6m(monthly: DataFrame, keys: list[str] = (), months: int = 6) -> DataFrame:
    """Last level x seasonal factor for the months after the data."""
    keys = list(keys)
    last = ses_level(monthly, keys).groupBy(*keys).agg(
        F.max("month").alias("origin"), F.max_by("level", "month").alias("level")
    )
    steps = F.transform(F.sequence(F.lit(1), F.lit(months)), lambda n: F.add_months(F.col("origin"), n))
    future = last.select(*keys, "level", F.explode(steps).alias("month"))
    future = future.withColumn("month_of_year", F.month("month")).join(seasonal_index(monthly, keys), [*keys, "month_of_year"])
    return future.select(*keys, "month", "level", "factor", (F.col("level") * F.col("factor")).alias("forecast"))


def holt_states(monthly: DataFrame, keys: list[str] = (), alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """Level and trend after each month. Starts at the first value with the first difference as trend.

    The fold runs over the months of one series; a series is as long as the calendar.
    """
    keys = list(keys)
    series = monthly.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("month", "y"))).alias("p"))
    state = "struct<month:date,level:double,trend:double,history:int>"
    first = F.col("p")[0]
    start = F.array(
        F.struct(
            first["month"].alias("month"), first["y"].alias("level"),
            (F.coalesce(F.get(F.col("p"), F.lit(1))["y"], first["y"]) - first["y"]).alias("trend"), F.lit(1).alias("history"),
        )
    ).cast(f"array<{state}>")

    def step(acc, x):
        prev = F.element_at(acc, -1)
        level = alpha * x["y"] + (1 - alpha) * (prev["level"] + prev["trend"])
        trend = beta * (level - prev["level"]) + (1 - beta) * prev["trend"]
        now = F.struct(
            x["month"].alias("month"), level.alias("level"), trend.alias("trend"), (prev["history"] + 1).alias("history")
        )
        return F.concat(acc, F.array(now)).cast(f"array<{state}>")

    rest = F.slice(F.col("p"), 2, F.greatest(F.size("p") - 1, F.lit(0)))
    return series.select(*keys, F.explode(F.aggregate(rest, start, step)).alias("s")).select(*keys, "s.*")


def holt_linear(
    monthly: DataFrame, keys: list[str] = (), lead: int = 3, ahead: int = 5, min_points: int = 6,
    adjust: float = 0.90, adjust_from: Column | None = None,
) -> DataFrame:
    """Trend forecast of each target month from ``lead`` months before, times ``adjust`` from a date on."""
    keys = list(keys)
    states = holt_states(monthly, keys).withColumnRenamed("month", "origin")
    targets = origin_of(month_spine(monthly, keys, ahead), monthly, keys, lead)
    out = targets.join(states, [*keys, "origin"]).filter(F.col("history") >= min_points)
    months = (F.year("month") - F.year("origin")) * 12 + F.month("month") - F.month("origin")
    raw = F.col("level") + months * F.col("trend")
    factor = F.lit(1.0) if adjust_from is None else F.when(F.col("month") >= adjust_from, adjust).otherwise(1.0)
    return out.select(*keys, "month", "origin", months.alias("horizon"), raw.alias("raw"), (raw * factor).alias("forecast"))


def quarter_of(month: Column) -> Column:
    return F.concat(F.year(month).cast("string"), F.lit("Q"), F.quarter(month).cast("string"))


def quarter_mape_bias(backtest: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean absolute and mean percentage error per quarter, and over all as quarter 'all'."""
    error = (F.col("predicted") - F.col("actual")) / F.col("actual")
    cells = F.array(quarter_of(F.col("month")), F.lit("all"))
    rows = backtest.filter("actual IS NOT NULL").select(*keys, F.explode(cells).alias("quarter"), error.alias("e"))
    return rows.groupBy(*keys, "quarter").agg(F.avg(F.abs("e")).alias("mape"), F.avg("e").alias("bias"))


def quarter_sum_error(backtest: DataFrame, keys: list[str] = ()) -> DataFrame:
    rows = backtest.filter("actual IS NOT NULL").withColumn("quarter", quarter_of(F.col("month")))
    out = rows.groupBy(*keys, "quarter").agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"))
    return out.withColumn("error_pct", (F.col("predicted") - F.col("actual")) / F.col("actual"))
