"""Daily call features, half-hour profile and monthly forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import register
from tidemark.catalog.scalars import HOLIDAY_SQL
from tidemark.catalog.windows import FUTURE_AVG, ROLLING_SLOTS, SLOTS
from tidemark.plans import calls, forecast

VOLUME_COLUMNS = "num_core_txn num_casc_txn num_core_m0 num_casc_m0".split()


def daily_sql(h, ahead=0, key=""):
    """The daily table, of every series of ``key`` where it is given."""
    week = 20 if h == 14 else 14
    k, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    same, group = (f"USING ({k}date)", f"GROUP BY {key}" if key else "")
    lags = ", ".join(f"LAG({c}, {h}) OVER o AS {c}_{h}d_ago" for c in VOLUME_COLUMNS)
    gap = f"OVER ({part}ORDER BY date ROWS BETWEEN {{a}} PRECEDING AND {h} PRECEDING)"
    avg = ", ".join(f"AVG({c}) {gap.format(a=h + 2)} AS rolling_avg_{c[4:]}_3d" for c in VOLUME_COLUMNS)
    return f"""(WITH {HOLIDAY_SQL}, s AS (SELECT {k}unnest(days)::DATE AS date FROM (SELECT {k}generate_series(MIN(call_date), MAX(call_date) + {ahead},
        INTERVAL 1 DAY) AS days FROM v_daily_call {group})),
      d AS (SELECT {k}date, strftime(date, '%a') AS day_name, day(date) AS day_of_month, strftime(date, '%b') AS month_name,
        CASE WHEN day(date) IN (1, 3, 15) OR isodow(date) IN (5, 6) THEN 1 ELSE 0 END AS is_billing_day,
        CASE WHEN hol.d IS NULL THEN 0 ELSE 1 END AS is_holiday FROM s LEFT JOIN hol ON hol.d = s.date),
      x AS (SELECT *, MAX(CASE WHEN is_billing_day = 1 THEN date END) OVER p AS lb, MIN(CASE WHEN is_billing_day = 1 THEN date END) OVER f AS nb,
        MAX(CASE WHEN is_holiday = 1 THEN date END) OVER p AS lh, MIN(CASE WHEN is_holiday = 1 THEN date END) OVER f AS nh FROM d
        WINDOW p AS ({part}ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          f AS ({part}ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      c AS (SELECT {k}call_date AS date, COUNT(*) AS num_calls FROM v_daily_call GROUP BY ALL),
      t AS (SELECT transaction_date AS date, COUNT(*) FILTER (cascade_type IS NULL) AS num_core_txn,
        COUNT(*) FILTER (cascade_type IS NOT NULL) AS num_casc_txn FROM v_order_item GROUP BY 1),
      m AS (SELECT order_date AS date, COUNT(*) FILTER (cascade_type IS NULL AND is_m0 = 1) AS num_core_m0,
        COUNT(*) FILTER (cascade_type IS NOT NULL AND is_m0 = 1) AS num_casc_m0 FROM v_order_item GROUP BY 1)
      SELECT {k}date, day_name, day_of_month, month_name, is_billing_day, is_holiday, num_calls, {lags},
        CASE WHEN date - lh <= 2 OR nh - date <= 2 THEN 1 ELSE 0 END AS is_near_holiday, date - lb AS days_since_billing_day,
        nb - date AS days_until_billing_day, {avg}, LAG(num_calls, {h}) OVER o AS calls_{h}d_ago,
        AVG(num_calls) {gap.format(a=h + 2)} AS rolling_avg_calls_3d, AVG(num_calls) {gap.format(a=week)} AS rolling_avg_calls_7d,
        AVG(num_calls) {gap.format(a=h + 29)} AS rolling_avg_calls_30d,
        LAG(num_calls, 14) OVER o / NULLIF(AVG(num_calls) OVER ({part}ORDER BY date ROWS BETWEEN 20 PRECEDING AND 14 PRECEDING), 0) AS dow_historical_ratio_14d
      FROM x LEFT JOIN c {same} LEFT JOIN t USING (date) LEFT JOIN m USING (date) WINDOW o AS ({part}ORDER BY date))"""


def daily_columns(h):
    return (
        "date:D day_name:s day_of_month month_name:s is_billing_day is_holiday num_calls "
        + " ".join(f"{c}_{h}d_ago" for c in VOLUME_COLUMNS)
        + " is_near_holiday days_since_billing_day days_until_billing_day "
        + " ".join(f"rolling_avg_{c[4:]}_3d:d" for c in VOLUME_COLUMNS)
        + f" calls_{h}d_ago rolling_avg_calls_3d:d rolling_avg_calls_7d:d rolling_avg_calls_30d:d"
    )


@register("daily_feature_table", daily_columns(14) + " dow_historical_ratio_14d:d", f"SELECT * FROM {daily_sql(14)}")
def daily_feature_table(i):
    return calls.daily_feature_table(i.daily_call, i.order_item)


@register("daily_feature_table_7", daily_columns(7), f"SELECT * FROM {daily_sql(7)}")
def daily_feature_table_7(i):
    return calls.daily_feature_table(i.daily_call, i.order_item, horizon=7)


@register(
    "future_feature_rows", daily_columns(14) + " dow_historical_ratio_14d:d",
    f"SELECT * FROM {daily_sql(14, ahead=14)} WHERE date > (SELECT MAX(call_date) FROM v_daily_call)",
)
def future_feature_rows(i):
    return calls.after_the_data(calls.daily_feature_table(i.daily_call, i.order_item, ahead=14), i.daily_call)


# The series of the registered queries.
DAILY_KEY, LOG_KEY = ["call_type"], ["line"]


@register(
    "daily_feature_series", "call_type:s " + daily_columns(14) + " dow_historical_ratio_14d:d", f"SELECT * FROM {daily_sql(14, ahead=14, key='call_type')}"
)
def daily_feature_series(i):
    """Every call type on its own calendar, with the days to come."""
    return calls.daily_feature_table(i.daily_call, i.order_item, ahead=14, keys=DAILY_KEY)


@register(
    "future_feature_series", "call_type:s date:D num_core_txn_14d_ago calls_14d_ago rolling_avg_calls_30d:d",
    f"""SELECT * FROM {daily_sql(14, ahead=14, key='call_type')} x WHERE date > (SELECT MAX(call_date) FROM v_daily_call c WHERE c.call_type = x.call_type)""",
)
def future_feature_series(i):
    return calls.after_the_data(daily_feature_series(i), i.daily_call, keys=DAILY_KEY)


@register(
    "ratio_target_series", "call_type:s date:D anchor_7d:d target_ratio:d historical_ratio_14d:d",
    f"""SELECT call_type, date, rolling_avg_calls_7d AS anchor_7d, num_calls / (rolling_avg_calls_7d + 1) AS target_ratio,
        calls_14d_ago / (LAG(rolling_avg_calls_7d, 14) OVER (PARTITION BY call_type ORDER BY date) + 1) AS historical_ratio_14d
        FROM {daily_sql(14, key='call_type')}""",
)
def ratio_target_series(i):
    return calls.ratio_target(calls.daily_feature_table(i.daily_call, i.order_item, keys=DAILY_KEY), keys=DAILY_KEY)


@register(
    "ratio_target", "date:D anchor_7d:d target_ratio:d historical_ratio_14d:d back_to_calls:d",
    f"""SELECT *, target_ratio * anchor_7d AS back_to_calls FROM (SELECT date, rolling_avg_calls_7d AS anchor_7d,
        num_calls / (rolling_avg_calls_7d + 1) AS target_ratio,
        calls_14d_ago / (LAG(rolling_avg_calls_7d, 14) OVER (ORDER BY date) + 1) AS historical_ratio_14d FROM {daily_sql(14)})""",
)
def ratio_target(i):
    table = calls.ratio_target(calls.daily_feature_table(i.daily_call, i.order_item))
    return table.withColumn("back_to_calls", calls.ratio_to_calls(F.col("target_ratio"), F.col("anchor_7d")))


FUTURE = """(SELECT d.call_date, strftime(d.call_date, '%a') AS day_of_week, s.slot_minute FROM (SELECT unnest(generate_series(
    (SELECT CAST(MAX(call_start_at) AS DATE) + 1 FROM v_call_log), (SELECT CAST(MAX(call_start_at) AS DATE) + 14 FROM v_call_log),
    INTERVAL 1 DAY))::DATE AS call_date) d CROSS JOIN (SELECT DISTINCT slot_minute FROM """ + SLOTS + """) s
  WHERE (isodow(d.call_date) <= 5 AND slot_minute >= 300 AND slot_minute < 1080)
     OR (isodow(d.call_date) > 5 AND slot_minute >= 420 AND slot_minute < 960))"""
PROFILE = f"""(SELECT call_date, day_of_week, slot_minute, actual_pct_volume, avg_pct, min_pct, max_pct FROM {ROLLING_SLOTS}
  UNION ALL SELECT f.call_date, f.day_of_week, f.slot_minute, NULL, a.avg_pct, a.min_pct, a.max_pct FROM {FUTURE} f
  LEFT JOIN {FUTURE_AVG} a ON f.day_of_week = a.day_of_week AND f.slot_minute = a.slot_minute)"""


# The same with a series key; days and slots to come are those of each line.
LINE_SHARES = """(SELECT line, call_date, strftime(call_date, '%a') AS day_of_week, slot_minute,
    calls_count * 100.0 / SUM(calls_count) OVER (PARTITION BY line, call_date) AS pct
  FROM (SELECT line, CAST(call_start_at AS DATE) AS call_date, (hour(call_start_at) * 60 + minute(call_start_at)) // 30 * 30 AS slot_minute,
      COUNT(DISTINCT call_id) AS calls_count FROM v_call_log GROUP BY ALL)
  WHERE slot_minute BETWEEN CASE WHEN isodow(call_date) <= 5 THEN 300 ELSE 420 END AND CASE WHEN isodow(call_date) <= 5 THEN 1080 ELSE 960 END)"""
LINE_PROFILE = f"""(WITH sh AS {LINE_SHARES},
    ends AS (SELECT line, MAX(call_date) AS last FROM sh GROUP BY 1),
    past AS (SELECT p.line, p.call_date, p.slot_minute, ROUND(MAX(p.pct), 4) AS actual_pct_volume, ROUND(AVG(e.pct), 4) AS avg_pct,
      ROUND(MIN(e.pct), 4) AS min_pct, ROUND(MAX(e.pct), 4) AS max_pct FROM sh p LEFT JOIN sh e ON e.line = p.line AND e.slot_minute = p.slot_minute
        AND e.day_of_week = p.day_of_week AND e.call_date < p.call_date AND 3 >= (SELECT COUNT(*) FROM sh n WHERE n.line = p.line
          AND n.slot_minute = p.slot_minute AND n.day_of_week = p.day_of_week AND n.call_date < p.call_date AND n.call_date >= e.call_date)
      GROUP BY p.line, p.call_date, p.slot_minute),
    next AS (SELECT f.line, f.call_date, f.slot_minute, NULL::DOUBLE AS actual_pct_volume, ROUND(AVG(e.pct), 4) AS avg_pct, ROUND(MIN(e.pct), 4) AS min_pct,
      ROUND(MAX(e.pct), 4) AS max_pct FROM (SELECT line, last + CAST(n AS INT) AS call_date, slot_minute FROM ends, range(1, 15) t(n),
        (SELECT DISTINCT line AS l, slot_minute FROM sh) WHERE l = line) f LEFT JOIN sh e ON e.line = f.line AND e.slot_minute = f.slot_minute
        AND e.day_of_week = strftime(f.call_date, '%a') AND 3 >= (SELECT COUNT(*) FROM sh n WHERE n.line = f.line AND n.slot_minute = f.slot_minute
          AND n.day_of_week = e.day_of_week AND n.call_date >= e.call_date)
      WHERE f.slot_minute >= CASE WHEN isodow(f.call_date) <= 5 THEN 300 ELSE 420 END AND f.slot_minute < CASE WHEN isodow(f.call_date) <= 5 THEN 1080 ELSE 960 END
      GROUP BY f.line, f.call_date, f.slot_minute)
    SELECT *, strftime(call_date, '%a') AS day_of_week FROM past UNION ALL SELECT *, strftime(call_date, '%a') FROM next)"""


def line_profile(i):
    return calls.intraday_profile(i.call_log, F.to_date("call_date"), keys=LOG_KEY)


@register(
    "intraday_profile_series", "line:s call_date:D day_of_week:s slot_minute actual_pct_volume:f avg_pct:f min_pct:f max_pct:f", f"SELECT * FROM {LINE_PROFILE}"
)
def intraday_profile_series(i):
    return line_profile(i)


@register(
    "intraday_allocate_series", "line:s date:D day_of_week:s slot_minute predicted_calls_30mins:d",
    f"""WITH d AS (SELECT line, CAST(call_start_at AS DATE) + 14 AS date, COUNT(*) AS predicted_calls FROM v_call_log GROUP BY ALL)
        SELECT d.line, date, strftime(date, '%a') AS day_of_week, slot_minute, predicted_calls * avg_pct * 0.01 AS predicted_calls_30mins
        FROM d LEFT JOIN {LINE_PROFILE} p ON p.call_date = d.date AND p.line = d.line""",
)
def intraday_allocate_series(i):
    daily = i.call_log.groupBy("line", F.date_add(F.to_date("call_start_at"), 14).alias("date")).agg(F.count(F.lit(1)).alias("predicted_calls"))
    return calls.intraday_allocate(daily, line_profile(i), LOG_KEY)


def profile(i):
    return calls.intraday_profile(i.call_log, F.to_date("call_date"))


@register(
    "intraday_profile", "call_date:D day_of_week:s slot_minute actual_pct_volume:f avg_pct:f min_pct:f max_pct:f",
    f"SELECT * FROM {PROFILE}",
)
def intraday_profile(i):
    return profile(i)


@register(
    "intraday_allocate", "date:D day_of_week:s slot_minute predicted_calls_30mins:d",
    f"""WITH d AS (SELECT CAST(call_start_at AS DATE) + 14 AS date, COUNT(*) AS predicted_calls FROM v_call_log GROUP BY 1)
        SELECT date, strftime(date, '%a') AS day_of_week, slot_minute, predicted_calls * avg_pct * 0.01 AS predicted_calls_30mins
        FROM d LEFT JOIN {PROFILE} p ON p.call_date = d.date""",
)
def intraday_allocate(i):
    # Calls of two weeks before stand for the daily forecast.
    daily = i.call_log.groupBy(F.date_add(F.to_date("call_start_at"), 14).alias("date")).agg(
        F.count(F.lit(1)).alias("predicted_calls")
    )
    return calls.intraday_allocate(daily, profile(i))


# --------------------------------------------------------------------------- months

KEYS = ["call_type"]
MONTHLY = """(SELECT call_type, CAST(date_trunc('month', call_date) AS DATE) AS month, CAST(COUNT(*) AS DOUBLE) AS y FROM v_daily_call
  WHERE call_date < date_trunc('month', (SELECT MAX(call_date) FROM v_daily_call)) GROUP BY 1, 2)"""


def monthly(i):
    total = forecast.monthly_total(i.daily_call, "call_date", KEYS)
    return forecast.complete_months(total, i.daily_call.agg(F.max("call_date")).scalar())


@register(
    "monthly_total", "month:D y overridden",
    """WITH m AS (SELECT CAST(date_trunc('month', call_date) AS DATE) AS month, COUNT(*) AS y FROM v_daily_call GROUP BY 1),
         l AS (SELECT MAX(month) AS month FROM m)
       SELECT month, y, CASE WHEN month = (SELECT month FROM l) THEN 94665 ELSE y END AS overridden FROM m
       UNION ALL SELECT CAST(month + INTERVAL 1 MONTH AS DATE), 94665, 94665 FROM l""",
)
def monthly_total(i):
    base = forecast.monthly_total(i.daily_call, "call_date")
    known = base.agg(F.max("month").alias("l")).select(
        F.explode(F.array("l", F.add_months("l", 1))).alias("month"), F.lit(94665).alias("y")
    )
    kept = forecast.monthly_total(i.daily_call, "call_date", known=known)
    forced = forecast.monthly_total(i.daily_call, "call_date", known=known, override=True)
    return kept.join(forced.withColumnRenamed("y", "overridden"), "month")


SEASONAL = f"""(WITH m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY call_type ORDER BY month) AS i FROM {MONTHLY}),
    t AS (SELECT m.call_type, m.month, m.y, m.i, CASE WHEN COUNT(*) = 13 THEN SUM(h.y * CASE WHEN abs(h.i - m.i) = 6 THEN 0.5 ELSE 1 END) / 12 END AS t
      FROM m JOIN m h ON h.call_type = m.call_type AND h.i BETWEEN m.i - 6 AND m.i + 6 GROUP BY 1, 2, 3, 4),
    e AS (SELECT call_type, MIN(i) AS a, MAX(i) AS b FROM t WHERE t IS NOT NULL GROUP BY 1),
    lo AS (SELECT t.call_type, regr_slope(t, i) AS s, regr_intercept(t, i) AS c FROM t JOIN e ON t.call_type = e.call_type WHERE i BETWEEN a AND a + 11 GROUP BY 1),
    hi AS (SELECT t.call_type, regr_slope(t, i) AS s, regr_intercept(t, i) AS c FROM t JOIN e ON t.call_type = e.call_type WHERE i BETWEEN b - 11 AND b GROUP BY 1),
    f AS (SELECT t.call_type, t.month, t.y / CASE WHEN i < a THEN lo.c + lo.s * i WHEN i > b THEN hi.c + hi.s * i ELSE t.t END AS r
      FROM t JOIN e ON t.call_type = e.call_type JOIN lo ON lo.call_type = t.call_type JOIN hi ON hi.call_type = t.call_type),
    g AS (SELECT call_type, month(month) AS month_of_year, AVG(r) AS r FROM f GROUP BY 1, 2)
  SELECT call_type, month_of_year, r / AVG(r) OVER (PARTITION BY call_type) AS factor FROM g)"""


@register("seasonal_index", "call_type:s month_of_year factor:d", f"SELECT * FROM {SEASONAL}")
def seasonal_index(i):
    return forecast.seasonal_index(monthly(i), KEYS)


LEVELS = f"""(SELECT a.call_type, a.month AS origin, a.i AS history, SUM(b.y * CASE WHEN a.i - b.i = LEAST(a.i, 6) - 1
    THEN power(0.2, a.i - b.i) ELSE 0.8 * power(0.2, a.i - b.i) END) AS level
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY call_type ORDER BY month) AS i FROM {MONTHLY}) a
  JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY call_type ORDER BY month) AS i FROM {MONTHLY}) b
    ON a.call_type = b.call_type AND b.i BETWEEN a.i - 5 AND a.i GROUP BY 1, 2, 3)"""


@register("ses_level", "call_type:s month:D history level:d", f"SELECT *, origin AS month FROM {LEVELS}")
def ses_level(i):
    return forecast.ses_level(monthly(i), KEYS)


SPINE = f"""(SELECT call_type, unnest(generate_series(a, b + INTERVAL {{ahead}} MONTH, INTERVAL 1 MONTH))::DATE AS month FROM
  (SELECT call_type, MIN(month) AS a, MAX(month) AS b FROM {MONTHLY} GROUP BY 1))"""
ORIGINS = f"""(SELECT t.call_type, t.month, MAX(h.month) AS origin FROM {SPINE} t JOIN {MONTHLY} h ON h.call_type = t.call_type
  AND h.month <= t.month - INTERVAL 3 MONTH GROUP BY 1, 2)"""
BACKTEST = f"""(SELECT o.call_type, o.month, l.level, s.factor, l.level * s.factor AS predicted, m.y AS actual FROM {ORIGINS.format(ahead=0)} o
  JOIN {LEVELS} l ON l.call_type = o.call_type AND l.origin = o.origin
  JOIN {SEASONAL} s ON s.call_type = o.call_type AND s.month_of_year = month(o.month)
  LEFT JOIN {MONTHLY} m ON m.call_type = o.call_type AND m.month = o.month WHERE l.history >= 6)"""


@register("rolling_backtest", "call_type:s month:D level:d factor:d predicted:f actual", f"SELECT * FROM {BACKTEST}")
def rolling_backtest(i):
    return forecast.rolling_backtest(monthly(i), KEYS)


HOLT = f"""(WITH RECURSIVE m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY call_type ORDER BY month) AS i FROM {MONTHLY}),
    r AS (SELECT a.call_type, a.month, a.i, a.y AS level, b.y - a.y AS trend FROM m a JOIN m b ON b.call_type = a.call_type AND b.i = 2 WHERE a.i = 1
      UNION ALL SELECT m.call_type, m.month, m.i, 0.8 * m.y + 0.2 * (r.level + r.trend),
        0.2 * (0.8 * m.y + 0.2 * (r.level + r.trend) - r.level) + 0.8 * r.trend FROM r JOIN m ON m.call_type = r.call_type AND m.i = r.i + 1)
  SELECT * FROM r)"""


@register(
    "holt_linear", "call_type:s month:D horizon raw:f forecast:f",
    f"""SELECT o.call_type, o.month, date_diff('month', origin, o.month) AS horizon, level + date_diff('month', origin, o.month) * trend AS raw,
          (level + date_diff('month', origin, o.month) * trend) * CASE WHEN o.month >= DATE '2001-01-01' THEN 0.9 ELSE 1 END AS forecast
        FROM {ORIGINS.format(ahead=5)} o JOIN {HOLT} h ON h.call_type = o.call_type AND h.month = o.origin WHERE h.i >= 6""",
)
def holt_linear(i):
    return forecast.holt_linear(monthly(i), KEYS, adjust_from=F.lit("2001-01-01").cast("date"))


@register(
    "hybrid_forecast_6m", "call_type:s month:D level:d factor:d forecast:f",
    f"""WITH l AS (SELECT * FROM {LEVELS} QUALIFY ROW_NUMBER() OVER (PARTITION BY call_type ORDER BY origin DESC) = 1),
          t AS (SELECT call_type, level, unnest(generate_series(origin + INTERVAL 1 MONTH, origin + INTERVAL 6 MONTH, INTERVAL 1 MONTH))::DATE AS month FROM l)
        SELECT t.call_type, month, level, factor, level * factor AS forecast FROM t JOIN {SEASONAL} s ON s.call_type = t.call_type
          AND s.month_of_year = month(t.month)""",
)
def hybrid_forecast_6m(i):
    return forecast.hybrid_forecast_6m(monthly(i), KEYS)


QUARTER = "concat(CAST(year(month) AS VARCHAR), 'Q', CAST(quarter(month) AS VARCHAR))"


@register(
    "quarter_mape_bias", "call_type:s quarter:s mape:d bias:d",
    f"""SELECT call_type, quarter, AVG(abs(e)) AS mape, AVG(e) AS bias FROM (SELECT call_type, unnest([{QUARTER}, 'all']) AS quarter,
        (predicted - actual) / actual AS e FROM {BACKTEST} WHERE actual IS NOT NULL) GROUP BY 1, 2""",
)
def quarter_mape_bias(i):
    return forecast.quarter_mape_bias(forecast.rolling_backtest(monthly(i), KEYS), KEYS)


@register(
    "quarter_sum_error", "call_type:s quarter:s actual predicted:f error_pct:d",
    f"""SELECT call_type, {QUARTER} AS quarter, SUM(actual) AS actual, SUM(predicted) AS predicted,
        (SUM(predicted) - SUM(actual)) / SUM(actual) AS error_pct FROM {BACKTEST} WHERE actual IS NOT NULL GROUP BY 1, 2""",
)
def quarter_sum_error(i):
    return forecast.quarter_sum_error(forecast.rolling_backtest(monthly(i), KEYS), KEYS)


