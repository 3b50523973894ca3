"""Calendar, clock and time-zone expressions. 'Today' is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def days_between(start: Column, end: Column) -> Column:
    """Calendar days from start to end."""
    return F.datediff(F.to_date(end), F.to_date(start))


def month_boundaries(start: Column, end: Column) -> Column:
    """Number of month starts crossed from start to end."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def day_of_week_sunday0(d: Column) -> Column:
    return F.dayofweek(d) - 1


def day_of_week_monday0(d: Column) -> Column:
    return F.weekday(d)


def day_name(d: Column) -> Column:
    """Three-letter day name, without a locale."""
    names = "Mon Tue Wed Thu Fri Sat Sun".split()
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.weekday(d) + 1)


def month_name(d: Column) -> Column:
    names = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.month(d))


def is_billing_day(d: Column) -> Column:
    """1 on the 1st, 3rd, 15th and on Fridays and Saturdays."""
    return (F.dayofmonth(d).isin(1, 3, 15) | F.weekday(d).isin(4, 5)).cast("int")


def slot_minute(ts: Column, width: int = 30) -> Column:
    """Minute of the day at which the slot holding ``ts`` starts."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (F.floor(minute / width) * width).cast("int")


def slot_text(minute: Column) -> Column:
    return F.concat(
        F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((minute % 60).cast("string"), 2, "0"), F.lit(":00"),
    )


# Opening hours in minutes of the day, weekdays and weekends.
WEEKDAY_HOURS = (300, 1080)
WEEKEND_HOURS = (420, 960)


def in_business_hours(d: Column, minute: Column, include_end: bool) -> Column:
    """Slots of past days include the closing slot, slots of planned days do not."""

    def within(hours):
        start, end = hours
        return (minute >= start) & ((minute <= end) if include_end else (minute < end))

    weekend = F.weekday(d) >= 5
    return (~weekend & within(WEEKDAY_HOURS)) | (weekend & within(WEEKEND_HOURS))


def age_by_birthday(birth: Column, today: Column) -> Column:
    """Full years; one less before the birthday in the year of ``today``."""
    early = (F.month(today) * 100 + F.dayofmonth(today)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return F.year(today) - F.year(birth) - early.cast("int")


def age_by_days(birth: Column, today: Column) -> Column:
    return F.floor(days_between(birth, today) / F.lit(365.25))


def age_by_year(birth_year: Column, today: Column) -> Column:
    return F.year(today) - birth_year


def is_weekend(d: Column) -> Column:
    return (F.weekday(d) >= 5).cast("int")


def is_morning(hour: Column) -> Column:
    return hour.between(5, 11).cast("int")


def is_late_night(hour: Column) -> Column:
    """Hours 21 to 4. Missing hours count as midnight's 0 does: late."""
    hour = F.coalesce(hour, F.lit(-1))
    return ((hour >= 21) | hour.between(0, 4)).cast("int")


# One time zone per state.
_ZONES = {
    "America/New_York": "CT DE FL GA IN ME MD MA MI NH NJ NY NC OH PA RI SC VT VA WV DC",
    "America/Chicago": "AL AR IL IA KS KY LA MN MS MO NE ND OK SD TN TX WI",
    "America/Phoenix": "AZ",
    "America/Denver": "CO ID MT NM UT WY",
    "America/Los_Angeles": "CA NV OR WA",
    "America/Anchorage": "AK",
    "Pacific/Honolulu": "HI",
}
STATE_ZONES = {state: zone for zone, states in _ZONES.items() for state in states.split()}
HOME_ZONE = "America/Los_Angeles"


def zone_of_state(state: Column) -> Column:
    zones = F.create_map(*[F.lit(x) for pair in STATE_ZONES.items() for x in pair])
    return F.coalesce(F.try_element_at(zones, F.upper(state)), F.lit(HOME_ZONE))


def local_time(ts: Column, zone: Column, home: str = HOME_ZONE) -> Column:
    """Wall time in ``zone`` of a wall time at home.

    An hour that happens twice at home is read as summer time; a wall time that the
    spring change skips moves forward to the first instant after the gap.
    """
    home_zone, utc = F.lit(home), F.lit("UTC")
    instant = F.convert_timezone(home_zone, utc, ts)
    back = F.convert_timezone(utc, home_zone, instant)
    # A skipped wall time comes back shifted; the whole hour at or before it ends the gap.
    after_gap = F.convert_timezone(home_zone, utc, F.date_trunc("HOUR", back).cast("timestamp_ntz"))
    instant = F.when(back == ts, instant).otherwise(after_gap)
    return F.convert_timezone(utc, zone, instant)


# --------------------------------------------------------------------------- calendars


def date_range(spark: SparkSession, start: Column, end: Column, name: str = "date") -> DataFrame:
    """One row per day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(start, end)).alias(name))


def _nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """n-th given weekday (Monday 0) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    shift = F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7))
    return F.date_add(first, (shift + 7 * (n - 1)).cast("int"))


def _last_weekday(year: Column, month: int, weekday: int) -> Column:
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)).cast("int"))


def us_holidays(calendar: DataFrame, date: str = "date") -> DataFrame:
    """Federal holidays of the years of a calendar, with the day observed: (holiday_date, holiday_name)."""
    year = F.col("y")

    def fixed(month, day):
        return F.make_date(year, F.lit(month), F.lit(day))

    # The federal holidays and the year each one started.
    rules = [
        ("New Year's Day", fixed(1, 1), 1870, True),
        ("Martin Luther King Jr. Day", _nth_weekday(year, 1, 0, 3), 1986, False),
        ("Washington's Birthday", _nth_weekday(year, 2, 0, 3), 1971, False),
        ("Memorial Day", _last_weekday(year, 5, 0), 1971, False),
        ("Juneteenth National Independence Day", fixed(6, 19), 2021, True),
        ("Independence Day", fixed(7, 4), 1870, True),
        ("Labor Day", _nth_weekday(year, 9, 0, 1), 1894, False),
        ("Columbus Day", _nth_weekday(year, 10, 0, 2), 1971, False),
        ("Veterans Day", fixed(11, 11), 1978, True),
        ("Thanksgiving Day", _nth_weekday(year, 11, 3, 4), 1942, False),
        ("Christmas Day", fixed(12, 25), 1870, True),
    ]
    days = []
    for name, day, since, observed in rules:
        entry = [F.struct(day.alias("d"), F.lit(name).alias("name"))]
        if observed:
            moved = F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1))
            entry.append(F.struct(moved.alias("d"), F.lit(f"{name} (observed)").alias("name")))
        days.append(F.when(year >= since, F.array(*entry)).otherwise(F.array().cast("array<struct<d:date,name:string>>")))
    # The day observed for a New Year's Day can fall into the year before.
    years = calendar.select(F.year(date).alias("y")).distinct()
    years = years.select(F.explode(F.array(F.col("y"), F.col("y") + 1)).alias("y")).distinct()
    found = years.select(F.explode(F.flatten(F.array(*days))).alias("h")).select("h.*").filter("d IS NOT NULL")
    return found.groupBy(F.col("d").alias("holiday_date")).agg(F.min("name").alias("holiday_name"))
