"""Call volume: daily feature table on a calendar, half-hour profile, allocation.

Every function takes ``keys``, the columns that name a series (none for a single one). Each series has a calendar of its
own span, its own windows, slots and totals; days of the year, billing days and holidays are the same for all. Tables here
have one row per series and day, or per series, day and slot, after the facts were counted, so the window of one series
is as long as its calendar. Counting itself is a map-side combined aggregate. A null key is a series of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import null_safe_ratio
from tidemark.functions.timefn import (
    day_name,
    in_business_hours,
    is_billing_day,
    month_name,
    slot_minute,
    us_holidays,
)

def by_date(keys: list[str] = ()):
    """One row per day, so the calendar of a series is one small window."""
    return Window.partitionBy(*keys).orderBy("date")


def beside(left: DataFrame, right: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Left join on series and ``on``; null keys meet null keys."""
    if not keys:
        return left.join(right, list(on), "left")
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in (*keys, *on)})
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys] + [F.col(c) == F.col(f"__r_{c}") for c in on]
    return left.join(right, reduce(lambda a, b: a & b, same), "left").drop(*[f"__r_{c}" for c in (*keys, *on)])


def spine(df: DataFrame, date: str, ahead: int = 0, keys: list[str] = ()) -> DataFrame:
    """Every day from the first to the last of each series, and ``ahead`` days more."""
    ends = df.groupBy(*keys).agg(F.min(date).alias("a"), F.date_add(F.max(date), ahead).alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", "b")).alias("date"))


def on_spine(daily: DataFrame, date: str = "date", ahead: int = 0, keys: list[str] = ()) -> DataFrame:
    """Daily rows with the missing days filled in, so that row frames equal days."""
    return beside(spine(daily, date, ahead, keys), daily, keys, ["date"])


def open_range(df: DataFrame, date: str, start: Column | None, end: Column | None) -> DataFrame:
    """Both ends left out."""
    if start is not None:
        df = df.filter(F.col(date) > start)
    if end is not None:
        df = df.filter(F.col(date) < end)
    return df


def calendar_flags(calendar: DataFrame) -> DataFrame:
    """Day and month names, billing days and holidays of a calendar."""
    holidays = us_holidays(calendar.select("date"))  # about a dozen rows per year
    return calendar.join(F.broadcast(holidays), F.col("date") == F.col("holiday_date"), "left").withColumns(
        {
            "day_name": day_name(F.col("date")),
            "day_of_month": F.dayofmonth("date"),
            "month_name": month_name(F.col("date")),
            "is_billing_day": is_billing_day(F.col("date")),
            "is_holiday": F.col("holiday_date").isNotNull().cast("int"),
        }
    ).drop("holiday_date")


def flag_distances(calendar: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Last and next billing day and holiday around each day, the day itself included."""
    past = by_date(keys).rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_date(keys).rowsBetween(0, Window.unboundedFollowing)
    new = {}
    for flag, name in (("is_billing_day", "billing"), ("is_holiday", "holiday")):
        day = F.when(F.col(flag) == 1, F.col("date"))
        new[f"last_{name}_date"] = F.max(day).over(past)
        new[f"next_{name}_date"] = F.min(day).over(ahead)
    return calendar.withColumns(new)


def days_since_until(calendar: DataFrame, near: int = 2) -> DataFrame:
    d = F.col("date")
    since_holiday, until_holiday = F.datediff(d, F.col("last_holiday_date")), F.datediff(F.col("next_holiday_date"), d)
    near_one = F.coalesce(since_holiday <= near, F.lit(False)) | F.coalesce(until_holiday <= near, F.lit(False))
    return calendar.withColumns(
        {
            "is_near_holiday": near_one.cast("int"),
            "days_since_billing_day": F.datediff(d, F.col("last_billing_date")),
            "days_until_billing_day": F.datediff(F.col("next_billing_date"), d),
        }
    )


def gap_average(column: str, rows: int, gap: int, keys: list[str] = ()) -> Column:
    """Mean of ``rows`` days that end ``gap`` days before the current one."""
    return F.avg(column).over(by_date(keys).rowsBetween(-(gap + rows - 1), -gap))


def count_calls(calls: DataFrame, date: str = "call_date", keys: list[str] = ()) -> DataFrame:
    return calls.groupBy(*keys, F.col(date).alias("date")).agg(F.count(F.lit(1)).alias("num_calls"))


def count_transactions(
    rows: DataFrame, date: str, core: str, cascade: str, only: Column | None = None, keys: list[str] = ()
) -> DataFrame:
    """Rows per day without and with a cascade."""
    hit = F.lit(True) if only is None else only
    return rows.groupBy(*keys, F.col(date).alias("date")).agg(
        F.count_if(hit & F.col("cascade_type").isNull()).alias(core),
        F.count_if(hit & F.col("cascade_type").isNotNull()).alias(cascade),
    )


VOLUMES = ["num_core_txn", "num_casc_txn", "num_core_m0", "num_casc_m0"]


def daily_feature_table(
    calls: DataFrame, items: DataFrame, horizon: int = 14, ahead: int = 0,
    start: Column | None = None, end: Column | None = None, keys: list[str] = (),
) -> DataFrame:
    """Calendar, calls and lagged volumes per day, all known ``horizon`` days before.

    With a horizon of 7 the 'weekly' mean covers 8 days. ``ahead`` extends the calendar beyond the data. Volumes are those
    of the series where the transactions carry its keys, else they are shared by all series.
    """
    # 7 days at horizon 14; 8 days at horizon 7.
    week = 8 if horizon == 7 else 7
    own = list(keys) if set(keys) <= set(items.columns) else []
    per_day = count_calls(open_range(calls, "call_date", start, end), keys=keys)
    txn = count_transactions(open_range(items, "transaction_date", start, end), "transaction_date", *VOLUMES[:2], keys=own)
    m0 = count_transactions(open_range(items, "order_date", start, end), "order_date", *VOLUMES[2:], F.col("is_m0") == 1, own)
    days = days_since_until(flag_distances(calendar_flags(spine(per_day, "date", ahead, keys)), keys))
    df = beside(beside(beside(days, per_day, keys, ["date"]), txn, own, ["date"]), m0, own, ["date"])

    new = {f"{c}_{horizon}d_ago": F.lag(c, horizon).over(by_date(keys)) for c in VOLUMES}
    for c in VOLUMES:
        new[f"rolling_avg_{c.removeprefix('num_')}_3d"] = gap_average(c, 3, horizon, keys)
    new[f"calls_{horizon}d_ago"] = F.lag("num_calls", horizon).over(by_date(keys))
    for name, rows in (("3d", 3), ("7d", week), ("30d", 30)):
        new[f"rolling_avg_calls_{name}"] = gap_average("num_calls", rows, horizon, keys)
    if horizon == 14:
        new["dow_historical_ratio_14d"] = dow_ratio(keys)
    return df.withColumns(new).drop(*VOLUMES)


def dow_ratio(keys: list[str] = ()) -> Column:
    """Calls 14 days ago over the mean of the week that ended then."""
    return null_safe_ratio(F.lag("num_calls", 14).over(by_date(keys)), gap_average("num_calls", 7, 14, keys))


def after_the_data(table: DataFrame, calls: DataFrame, date: str = "call_date", keys: list[str] = ()) -> DataFrame:
    """Rows of days after the last call of their series."""
    last = calls.groupBy(*keys).agg(F.max(date).alias("__last"))
    if not keys:
        return table.filter(F.col("date") > last.select("__last").scalar())
    return beside(table, last, keys, []).filter(F.col("date") > F.col("__last")).drop("__last")


def ratio_target(df: DataFrame, plus_one_back: bool = False, keys: list[str] = ()) -> DataFrame:
    """Anchor, ratio target and lagged ratio of the daily model.

    The target divides by anchor + 1 while the forecast multiplies by the anchor alone;
    ``plus_one_back`` marks the symmetric variant for ``ratio_to_calls``.
    """
    anchor = F.col("rolling_avg_calls_7d")
    lagged = F.lag("rolling_avg_calls_7d", 14).over(by_date(keys))
    return df.withColumns(
        {
            "anchor_7d": anchor,
            "target_ratio": F.col("num_calls") / (anchor + 1),
            "historical_ratio_14d": F.col("calls_14d_ago") / (lagged + 1),
            "plus_one_back": F.lit(plus_one_back),
        }
    )


def ratio_to_calls(ratio: Column, anchor: Column, plus_one_back: bool = False) -> Column:
    return ratio * (anchor + 1) if plus_one_back else ratio * anchor


REQUIRED = ["num_calls", "target_ratio", "anchor_7d", "rolling_avg_calls_30d", "historical_ratio_14d"]


def clean_rows(df: DataFrame) -> DataFrame:
    return df.dropna(subset=REQUIRED)


# --------------------------------------------------------------------------- half-hour profile


def slot_shares(log: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Calls per series, day and half hour within opening hours, and their share of the day in percent."""
    d = F.to_date("call_start_at")
    counts = log.groupBy(*keys, d.alias("call_date"), slot_minute(F.col("call_start_at")).alias("slot_minute")).agg(
        F.count_distinct("call_id").alias("calls_count")
    )
    open_slots = counts.filter(in_business_hours(F.col("call_date"), F.col("slot_minute"), include_end=True))
    total = F.sum("calls_count").over(Window.partitionBy(*keys, "call_date"))
    return open_slots.withColumns(
        {
            "day_of_week": day_name(F.col("call_date")),
            "daily_total_calls": total,
            "pct_of_daily_volume": F.col("calls_count") * F.lit(100.0) / total,
        }
    )


def _stats(value: Column, over=None) -> dict[str, Column]:
    out = {}
    for name, fn in (("avg_pct", F.avg), ("min_pct", F.min), ("max_pct", F.max)):
        column = fn(value)
        out[name] = F.round(column.over(over) if over is not None else column, 4)
    return out


def previous_slot_stats(shares: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean, lowest and highest share of the three earlier days with the same weekday and slot."""
    w = Window.partitionBy(*keys, "day_of_week", "slot_minute").orderBy("call_date").rowsBetween(-3, -1)
    return shares.withColumns(
        {"actual_pct_volume": F.round("pct_of_daily_volume", 4), **_stats(F.col("pct_of_daily_volume"), w)}
    )


def latest_slot_stats(shares: DataFrame, n: int = 3, keys: list[str] = ()) -> DataFrame:
    """The same of the last ``n`` days; no more than these are kept per series, weekday and slot."""
    w = Window.partitionBy(*keys, "day_of_week", "slot_minute").orderBy(F.col("call_date").desc())
    latest = shares.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return latest.groupBy(*keys, "day_of_week", "slot_minute").agg(
        *[c.alias(name) for name, c in _stats(F.col("pct_of_daily_volume")).items()]
    )


def future_spine(shares: DataFrame, asof: Column, days: int = 14, keys: list[str] = ()) -> DataFrame:
    """The next days with the slots the series has had so far, within opening hours (closing slot left out).

    At most 48 slots and ``days`` dates: one row per series carries both lists and is exploded.
    """
    lists = shares.groupBy(*keys).agg(
        F.collect_set("slot_minute").alias("slots"),
        F.sequence(F.date_add(F.max(asof), 1), F.date_add(F.max(asof), days)).alias("dates"),
    )
    rows = lists.select(*keys, F.explode("dates").alias("call_date"), "slots").select(*keys, "call_date", F.explode("slots").alias("slot_minute"))
    rows = rows.filter(in_business_hours(F.col("call_date"), F.col("slot_minute"), include_end=False))
    return rows.withColumn("day_of_week", day_name(F.col("call_date")))


def intraday_profile(log: DataFrame, asof: Column, days: int = 14, keys: list[str] = ()) -> DataFrame:
    """Past days with their rolling statistics, then future days with those of the last three
    equal weekdays; the actual share of a future day is null."""
    shares = slot_shares(log, keys)
    columns = [*keys, "call_date", "day_of_week", "slot_minute", "actual_pct_volume", "avg_pct", "min_pct", "max_pct"]
    past = previous_slot_stats(shares, keys).select(*columns)
    future = beside(future_spine(shares, asof, days, keys), latest_slot_stats(shares, keys=keys), keys, ["day_of_week", "slot_minute"])
    future = future.withColumn("actual_pct_volume", F.lit(None).cast("double")).select(*columns)
    return past.unionByName(future)


def intraday_allocate(daily: DataFrame, profile: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Daily forecast spread over the slots of its day: forecast x share x 0.01."""
    daily = daily.withColumn("day_of_week", day_name(F.col("date")))
    slots = profile.select(*keys, F.col("call_date").alias("date"), "day_of_week", "slot_minute", "avg_pct")
    return beside(daily, slots, keys, ["date", "day_of_week"]).withColumn(
        "predicted_calls_30mins", F.col("predicted_calls") * F.col("avg_pct") * 0.01
    )
