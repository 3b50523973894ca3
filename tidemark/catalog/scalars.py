"""Scalar functions: text, time, bins, JSON, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.registry import register
from tidemark.functions import jsonfn, scalar, text, timefn
from tidemark.operators.evaluation import quantile_buckets
from tidemark.plans import calls
from tidemark.sources.synthetic import USER_AGENTS, agent_of

def today():
    return F.lit("2002-01-15").cast("date")


TODAY_SQL = "DATE '2002-01-15'"


def q(words):
    return words.replace("'", "''")


@register(
    "split_part", "customer_id vertical_type:s",
    "SELECT customer_id, split_part(vertical_type_bin, '_', 1) AS vertical_type FROM v_customer_sales",
)
def split_part(i):
    return i.customer_sales.withColumn("vertical_type", F.split_part("vertical_type_bin", F.lit("_"), F.lit(1)))


@register(
    "first_char", "transaction_id family:s null_family:s",
    "SELECT transaction_id, substring(decline_code, 1, 1) AS family, substring(COALESCE(bank, 'None'), 1, 1) AS null_family FROM v_attempt",
)
def first_char(i):
    return i.attempt.select(
        "transaction_id", text.first_char(F.col("decline_code")).alias("family"),
        text.first_char(F.col("bank"), null_as="None").alias("null_family"),
    )


STATES_SQL = ", ".join(f"'{s}'" for s in text.US_STATES)


@register(
    "state_code", "transaction_id state:s",
    f"""SELECT transaction_id, CASE WHEN upper(left(billing_state, 2)) IN ({STATES_SQL}) THEN upper(left(billing_state, 2))
        ELSE 'others' END AS state FROM v_attempt""",
)
def state_code(i):
    return i.attempt.withColumn("state", text.state_code(F.col("billing_state")))


# Keywords that the given documents hold, next to the classes of the library.
WORD_CLASSES = {"license": "license", "http": "link", "@": "mail", "the ": "english", "der ": "german"}


def _case(column, classes, default="others"):
    cases = " ".join(f"WHEN contains(lower({column}), '{q(w)}') THEN '{n}'" for w, n in classes.items())
    return f"CASE {cases} ELSE '{default}' END"


@register(
    "keyword_class", "doc_id word_class:s bank_class:s residence:s employment:s device:s",
    f"""SELECT doc_id, {_case('text', WORD_CLASSES)} AS word_class, {_case('text', text.BANK_CLASSES)} AS bank_class,
        {_case('text', text.RESIDENCE_CLASSES)} AS residence, {_case('text', text.EMPLOYMENT_CLASSES)} AS employment,
        {_case('text', text.DEVICE_CLASSES)} AS device FROM documents""",
)
def keyword_class(i):
    t = F.col("text")
    return i.documents.select(
        "doc_id", text.keyword_class(t, WORD_CLASSES).alias("word_class"),
        text.keyword_class(t, text.BANK_CLASSES).alias("bank_class"),
        text.keyword_class(t, text.RESIDENCE_CLASSES).alias("residence"),
        text.keyword_class(t, text.EMPLOYMENT_CLASSES).alias("employment"),
        text.keyword_class(t, text.DEVICE_CLASSES).alias("device"),
    )


ALL_FLAGS = {**text.BANK_FLAGS, **text.EMPLOYER_FLAGS}


@register(
    "keyword_flags", "doc_id " + " ".join(ALL_FLAGS),
    "SELECT doc_id, " + ", ".join(f"CAST(regexp_matches(text, '(?i){q(p)}') AS INT) AS {n}" for n, p in ALL_FLAGS.items())
    + " FROM documents",
)
def keyword_flags(i):
    return i.documents.select("doc_id", *[c.alias(n) for n, c in text.pattern_flags(F.col("text"), ALL_FLAGS).items()])


@register(
    "employer_flags", "person_id " + " ".join(text.EMPLOYER_FLAGS),
    "SELECT person_id, " + ", ".join(
        f"CAST(regexp_matches(trim(employer), '(?i){q(p)}') AS INT) AS {n}" for n, p in text.EMPLOYER_FLAGS.items()
    ) + " FROM v_credit_response",
)
def employer_flags(i):
    flags = text.pattern_flags(F.col("employer"), text.EMPLOYER_FLAGS)
    return i.credit_response.select("person_id", *[c.alias(n) for n, c in flags.items()])


UA_VALUES = ", ".join(f"({n}, '{q(u)}')" for n, u in enumerate(USER_AGENTS))
UA_SQL = f"""u AS (SELECT o.o_orderkey AS jluvr, COALESCE(a.ua, 'unknown') AS ua FROM orders o
  LEFT JOIN (VALUES {UA_VALUES}) a(n, ua) ON a.n = o.o_custkey % {len(USER_AGENTS) + 1})"""


def has(p):
    return f"regexp_matches(ua, '(?i){p}')"


@register(
    "user_agent_parse",
    "jluvr device_type:s os_family:s traffic_source:s ios_device_age_proxy:s iphone_wealth_tier:s device_browser_combo:s os_source_combo:s",
    f"""WITH {UA_SQL}, d AS (SELECT jluvr, ua,
          CASE WHEN {has('Mobile|iPhone')} THEN 'Mobile'
            WHEN {has('Tablet|iPad')} OR ({has('Android')} AND NOT {has('Android.*Mobile')}) THEN 'Tablet'
            WHEN {has('Windows NT|Macintosh|X11')} THEN 'Desktop' ELSE 'Unknown_Device' END AS device_type,
          CASE WHEN {has('iPhone|iPad|iPod')} THEN 'iOS' WHEN {has('Android')} THEN 'Android' WHEN {has('Windows')} THEN 'Windows'
            WHEN {has('Mac OS X|Macintosh')} THEN 'Mac' ELSE 'Other/Unknown' END AS os_family,
          CASE WHEN {has('FBAV|FBAN|FBIOS')} THEN 'Facebook_App' WHEN {has('Instagram')} THEN 'Instagram_App'
            WHEN {has('Snapchat')} THEN 'Snapchat_App' WHEN {has('TikTok|Musical_ly')} THEN 'TikTok_App'
            WHEN contains(ua, ' wv)') THEN 'Generic_InApp' WHEN {has('Edg')} THEN 'Edge'
            WHEN {has('SamsungBrowser')} THEN 'Samsung_Internet' WHEN {has('Chrome|CriOS')} THEN 'Chrome'
            WHEN {has('Firefox|FxiOS')} THEN 'Firefox' WHEN {has('Safari')} AND NOT {has('Samsung')} THEN 'Safari'
            ELSE 'Unknown_Browser' END AS traffic_source,
          TRY_CAST(replace(regexp_extract(ua, 'CPU iPhone OS (\\d+(?:_\\d+)?)', 1), '_', '.') AS DOUBLE) AS v,
          TRY_CAST(regexp_extract(ua, 'FBDV/iPhone(\\d+),\\d+', 1) AS INT) AS h FROM u)
        SELECT *, CASE WHEN os_family = 'iOS' AND v < 17 THEN 'Old_Legacy_iOS' WHEN os_family = 'iOS' AND v >= 17 THEN 'Modern_iOS'
            ELSE 'Not_iOS' END AS ios_device_age_proxy,
          CASE WHEN h <= 12 THEN 'Older_Budget_iPhone' WHEN h <= 14 THEN 'Mid_Tier_iPhone' WHEN h >= 15 THEN 'Premium_New_iPhone'
            ELSE 'Not_Detected' END AS iphone_wealth_tier,
          concat(device_type, '_', traffic_source) AS device_browser_combo, concat(os_family, '_', traffic_source) AS os_source_combo FROM d""",
)
def user_agent_parse(i):
    rows = i.orders.select(F.col("o_orderkey").alias("jluvr"), agent_of(F.col("o_custkey")).alias("ua"))
    return rows.withColumns(text.user_agent_columns(F.col("ua")))


@register(
    "regex_extract", "page_id section:s platform:s",
    r"""SELECT page_id, NULLIF(regexp_extract(url, '\.com/([a-z]+)/', 1), '') AS section,
        NULLIF(regexp_extract(html, '\(([^;]+);', 1), '') AS platform FROM pages""",
)
def regex_extract(i):
    return i.pages.select(
        "page_id", text.extract(F.col("url"), r"\.com/([a-z]+)/").alias("section"),
        text.extract(F.col("html"), text.PLATFORM_PATTERN).alias("platform"),
    )


@register(
    "hardware_tier", "jluvr tier:s",
    f"""WITH {UA_SQL} SELECT jluvr, CASE WHEN h <= 12 THEN 'Older_Budget_iPhone' WHEN h <= 14 THEN 'Mid_Tier_iPhone'
        WHEN h >= 15 THEN 'Premium_New_iPhone' ELSE 'Not_Detected' END AS tier
        FROM (SELECT jluvr, TRY_CAST(regexp_extract(ua, 'FBDV/iPhone(\\d+),\\d+', 1) AS INT) AS h FROM u)""",
)
def hardware_tier(i):
    code = text.extract(agent_of(F.col("o_custkey")), r"FBDV/(iPhone\d+,\d+)")
    return i.orders.select(F.col("o_orderkey").alias("jluvr"), text.hardware_tier(code).alias("tier"))


@register(
    "concat_combo", "jluvr combo:s",
    "SELECT jluvr, concat(seller_name, '_morning_', CASE WHEN hour(request_datetime) BETWEEN 5 AND 11 THEN 1 ELSE 0 END) AS combo FROM v_lead",
)
def concat_combo(i):
    morning = timefn.is_morning(F.hour("request_datetime")).cast("string")
    return i.lead.select("jluvr", text.combo(F.col("seller_name"), F.lit("morning"), morning).alias("combo"))


@register(
    "format_checks", "doc_id length_ok first_digit has_mail",
    r"""SELECT doc_id, CASE WHEN length(trim(text)) BETWEEN 40 AND 4000 THEN 1 ELSE 0 END AS length_ok,
       CASE WHEN left(trim(text), 1) IN ('0', '1') THEN 1 ELSE 0 END AS first_digit,
       CAST(regexp_matches(text, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+') AS INT) AS has_mail FROM documents""",
)
def format_checks(i):
    t = F.trim("text")
    return i.documents.select(
        "doc_id", F.length(t).between(40, 4000).alias("length_ok"), F.substring(t, 1, 1).isin("0", "1").alias("first_digit"),
        F.col("text").rlike(r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+").alias("has_mail"),
    )


@register(
    "datediff_day", "transaction_id days",
    "SELECT transaction_id, date_diff('day', TIMESTAMP '2024-01-03 23:00:00', transaction_datetime) AS days FROM v_attempt",
)
def datediff_day(i):
    start = F.lit("2024-01-03 23:00:00").cast("timestamp_ntz")
    return i.attempt.withColumn("days", timefn.days_between(start, F.col("transaction_datetime")))


@register(
    "datediff_month", "jluvr months recent",
    f"""SELECT jluvr, date_diff('month', request_datetime, {TODAY_SQL}) AS months,
        CASE WHEN date_diff('month', request_datetime, {TODAY_SQL}) <= 6 THEN 1 ELSE 0 END AS recent FROM v_lead""",
)
def datediff_month(i):
    months = timefn.month_boundaries(F.col("request_datetime"), today())
    return i.lead.select("jluvr", months.alias("months"), (months <= 6).cast("int").alias("recent"))


@register(
    "date_parts", "call_id sunday0 monday0 iso day_of_month hour_of_day day_name:s month_name:s",
    """SELECT call_id, dayofweek(call_start_at) AS sunday0, isodow(call_start_at) - 1 AS monday0, isodow(call_start_at) AS iso,
       day(call_start_at) AS day_of_month, hour(call_start_at) AS hour_of_day, strftime(call_start_at, '%a') AS day_name,
       strftime(call_start_at, '%b') AS month_name FROM v_call_log""",
)
def date_parts(i):
    at = F.col("call_start_at")
    return i.call_log.select(
        "call_id", timefn.day_of_week_sunday0(at).alias("sunday0"), timefn.day_of_week_monday0(at).alias("monday0"),
        F.extract(F.lit("DAYOFWEEK_ISO"), at).alias("iso"), F.dayofmonth(at).alias("day_of_month"), F.hour(at).alias("hour_of_day"),
        timefn.day_name(at).alias("day_name"), timefn.month_name(at).alias("month_name"),
    )


@register(
    "time_slice_30m", "call_id slot:s",
    "SELECT call_id, strftime(time_bucket(INTERVAL 30 MINUTE, call_start_at), '%H:%M:%S') AS slot FROM v_call_log",
)
def time_slice_30m(i):
    return i.call_log.select("call_id", timefn.slot_text(timefn.slot_minute(F.col("call_start_at"))).alias("slot"))


@register(
    "date_shift", "call_id minus_3:D plus_30:D minus_3_months:D",
    """SELECT call_id, call_date - 3 AS minus_3, call_date + 30 AS plus_30, CAST(call_date - INTERVAL 3 MONTH AS DATE) AS minus_3_months
       FROM v_daily_call""",
)
def date_shift(i):
    d = F.col("call_date")
    return i.daily_call.select(
        "call_id", F.date_sub(d, 3).alias("minus_3"), F.date_add(d, 30).alias("plus_30"), F.add_months(d, -3).alias("minus_3_months")
    )


@register(
    "age_years", "call_id by_birthday by_days by_year",
    f"""SELECT call_id, date_sub('year', call_date, {TODAY_SQL}) AS by_birthday,
        floor(({TODAY_SQL} - call_date) / 365.25) AS by_days, 2002 - year(call_date) AS by_year FROM v_daily_call""",
)
def age_years(i):
    birth = F.col("call_date")
    return i.daily_call.select(
        "call_id", timefn.age_by_birthday(birth, today()).alias("by_birthday"), timefn.age_by_days(birth, today()).alias("by_days"),
        timefn.age_by_year(F.year(birth), today()).alias("by_year"),
    )


@register(
    "days_until", "transaction_id part_id supp_id days",
    "SELECT transaction_id, part_id, supp_id, transaction_date - order_date AS days FROM v_order_item",
)
def days_until(i):
    return i.order_item.withColumn("days", timefn.days_between(F.col("order_date"), F.col("transaction_date")))


FLAGS_SQL = """f AS (SELECT d AS date, CASE WHEN day(d) IN (1, 3, 15) OR isodow(d) IN (5, 6) THEN 1 ELSE 0 END AS b
  FROM (SELECT unnest(generate_series((SELECT MIN(call_date) FROM v_daily_call), (SELECT MAX(call_date) FROM v_daily_call),
    INTERVAL 1 DAY))::DATE AS d))"""


@register(
    "days_since_until", "date:D days_since_billing_day days_until_billing_day",
    f"""WITH {FLAGS_SQL} SELECT date,
        date - MAX(CASE WHEN b = 1 THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS days_since_billing_day,
        MIN(CASE WHEN b = 1 THEN date END) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - date AS days_until_billing_day
        FROM f""",
)
def days_since_until(i):
    spine = calls.spine(i.daily_call, "call_date")
    return calls.days_since_until(calls.flag_distances(calls.calendar_flags(spine)))


HOLIDAY_SQL = """y AS (SELECT unnest(generate_series(1994, 2002)) AS y),
  h AS (SELECT make_date(y, 1, 1) AS d, 'New Year''s Day' AS name, 1 AS o FROM y
    UNION ALL SELECT make_date(y, 7, 4), 'Independence Day', 1 FROM y
    UNION ALL SELECT make_date(y, 11, 11), 'Veterans Day', 1 FROM y
    UNION ALL SELECT make_date(y, 12, 25), 'Christmas Day', 1 FROM y
    UNION ALL SELECT d, name, 0 FROM (SELECT unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY))::DATE AS d FROM y),
      (VALUES ('Martin Luther King Jr. Day', 1, 1, 15, 21), ('Washington''s Birthday', 2, 1, 15, 21), ('Memorial Day', 5, 1, 25, 31),
        ('Labor Day', 9, 1, 1, 7), ('Columbus Day', 10, 1, 8, 14), ('Thanksgiving Day', 11, 4, 22, 28)) r(name, m, w, lo, hi)
      WHERE month(d) = m AND isodow(d) = w AND day(d) BETWEEN lo AND hi),
  a AS (SELECT d, name FROM h UNION ALL SELECT CASE isodow(d) WHEN 6 THEN d - 1 ELSE d + 1 END, concat(name, ' (observed)')
    FROM h WHERE o = 1 AND isodow(d) >= 6),
  hol AS (SELECT d, MIN(name) AS name FROM a GROUP BY 1)"""


@register(
    "holiday_flag", "date:D is_holiday holiday_name:s",
    f"""WITH {HOLIDAY_SQL}, c AS (SELECT DISTINCT call_date AS date FROM v_daily_call)
        SELECT date, CASE WHEN d IS NULL THEN 0 ELSE 1 END AS is_holiday, name AS holiday_name FROM c LEFT JOIN hol ON d = date""",
)
def holiday_flag(i):
    return calls.calendar_flags(i.daily_call.select(F.col("call_date").alias("date")).distinct())


@register(
    "local_time", "jluvr local:t local_hour is_weekend",
    """WITH s AS (SELECT o_orderkey AS jluvr, TIMESTAMP '2024-03-09 00:00:00' + to_seconds((o_orderkey * 7919) % 7776000) AS ts,
           CASE o_custkey % 7 WHEN 0 THEN 'NY' WHEN 1 THEN 'TX' WHEN 2 THEN 'AZ' WHEN 3 THEN 'CO' WHEN 4 THEN 'HI' WHEN 5 THEN 'AK' END AS st
           FROM orders),
         z AS (SELECT *, CASE st WHEN 'NY' THEN 'America/New_York' WHEN 'TX' THEN 'America/Chicago' WHEN 'AZ' THEN 'America/Phoenix'
           WHEN 'CO' THEN 'America/Denver' WHEN 'HI' THEN 'Pacific/Honolulu' WHEN 'AK' THEN 'America/Anchorage' ELSE 'America/Los_Angeles' END AS tz,
           CASE WHEN ts >= TIMESTAMP '2024-03-10 02:00:00' AND ts < TIMESTAMP '2024-03-10 03:00:00'
             THEN TIMESTAMP '2024-03-10 03:00:00' ELSE ts END AS fixed FROM s),
         l AS (SELECT jluvr, timezone(tz, timezone('America/Los_Angeles', fixed)) AS local FROM z)
       SELECT *, hour(local) AS local_hour, CASE WHEN isodow(local) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM l""",
)
def local_time(i):
    seconds = (F.col("o_orderkey") * 7919) % 7776000
    at = F.expr("TIMESTAMP_NTZ '2024-03-09 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    states = ["NY", "TX", "AZ", "CO", "HI", "AK"]
    state = F.get(F.array(*[F.lit(s) for s in states]), (F.col("o_custkey") % 7).cast("int"))
    rows = i.orders.select(F.col("o_orderkey").alias("jluvr"), at.alias("ts"), state.alias("state"))
    local = rows.withColumn("local", timefn.local_time(F.col("ts"), timefn.zone_of_state(F.col("state"))))
    return local.withColumns({"local_hour": F.hour("local"), "is_weekend": timefn.is_weekend(F.col("local"))})


@register(
    "time_flags", "jluvr is_weekend is_morning is_late",
    """SELECT jluvr, CASE WHEN isodow(request_datetime) >= 6 THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN hour(request_datetime) BETWEEN 5 AND 11 THEN 1 ELSE 0 END AS is_morning,
       CASE WHEN hour(request_datetime) >= 21 OR hour(request_datetime) <= 4 THEN 1 ELSE 0 END AS is_late FROM v_lead""",
)
def time_flags(i):
    hour = F.hour("request_datetime")
    return i.lead.select(
        "jluvr", timefn.is_weekend(F.col("request_datetime")).alias("is_weekend"), timefn.is_morning(hour).alias("is_morning"),
        timefn.is_late_night(hour).alias("is_late"),
    )


@register(
    "safe_ratio_eps", "transaction_id ratio:f",
    "SELECT transaction_id, COALESCE(transaction_amount / (retries + 0.001), 0) AS ratio FROM v_attempt",
)
def safe_ratio_eps(i):
    ratio = scalar.safe_ratio_eps(F.col("transaction_amount"), F.col("retries"))
    return i.attempt.select("transaction_id", ratio.alias("ratio"))


@register(
    "weighted_severity", "person_id severity",
    """SELECT person_id, SUM(late_30_count) + 2 * SUM(late_60_count) + 3 * SUM(late_90_count) AS severity FROM v_trade_line GROUP BY 1""",
)
def weighted_severity(i):
    return i.trade_line.groupBy("person_id").agg(
        (F.sum("late_30_count") + 2 * F.sum("late_60_count") + 3 * F.sum("late_90_count")).alias("severity")
    )


@register(
    "flag_thresholds", "jluvr sub_0_80 over_1_05",
    """SELECT jluvr, CAST(seller_minimum_price <= 0.80 AS INT) AS sub_0_80, CAST(seller_minimum_price > 1.05 AS INT) AS over_1_05 FROM v_lead""",
)
def flag_thresholds(i):
    price = F.col("seller_minimum_price")
    return i.lead.select("jluvr", (price <= 0.80).alias("sub_0_80"), (price > 1.05).alias("over_1_05"))


@register(
    "tier_by_cutpoints", "jluvr price_tier:s confidence:s",
    """SELECT jluvr, CASE WHEN p <= 0.80 THEN 'budget_tier' WHEN p <= 1.05 THEN 'standard_tier' WHEN p <= 1.15 THEN 'high_risk_premium'
         ELSE 'extreme_premium' END AS price_tier,
       CASE WHEN r <= 0 THEN NULL WHEN r <= 10 THEN 'Very Low' WHEN r <= 25 THEN 'Low' WHEN r <= 50 THEN 'Medium' WHEN r <= 75 THEN 'High'
         WHEN r <= 100 THEN 'Very High' END AS confidence
       FROM (SELECT jluvr, seller_minimum_price AS p, seller_minimum_price * 50 AS r FROM v_lead)""",
)
def tier_by_cutpoints(i):
    p = F.col("seller_minimum_price")
    return i.lead.select("jluvr", scalar.price_tier(p).alias("price_tier"), scalar.confidence_tier(p * 50).alias("confidence"))


@register(
    "open_bins", "person_id as_is:s fixed:s income:s",
    """SELECT person_id, CASE WHEN a < 30 THEN '30 and under' WHEN a > 30 AND a < 40 THEN '30-40' WHEN a > 40 AND a < 50 THEN '40-50'
         WHEN a > 50 AND a < 60 THEN '50-60' ELSE '60+' END AS as_is,
       CASE WHEN a < 30 THEN '30 and under' WHEN a < 40 THEN '30-40' WHEN a < 50 THEN '40-50' WHEN a < 60 THEN '50-60' ELSE '60+' END AS fixed,
       CASE WHEN c < 3000 THEN '3000 and under' WHEN c > 3000 AND c < 4000 THEN '3000-4000' WHEN c > 4000 AND c < 5000 THEN '4000-5000'
         WHEN c > 5000 AND c < 6000 THEN '5000-6000' ELSE '6000+' END AS income
       FROM (SELECT person_id, 2002 - birth_year AS a, c_acctbal AS c FROM v_credit_response JOIN customer ON c_custkey = person_id)""",
)
def open_bins(i):
    rows = i.credit_response.join(i.customer, F.col("person_id") == F.col("c_custkey"))
    age = timefn.age_by_year(F.col("birth_year"), today())
    return rows.select(
        "person_id", scalar.open_bins(age, scalar.AGE_BOUNDS).alias("as_is"),
        scalar.open_bins(age, scalar.AGE_BOUNDS, strict_gaps=False).alias("fixed"),
        scalar.open_bins(F.col("c_acctbal"), scalar.INCOME_BOUNDS).alias("income"),
    )


@register(
    "quantile_buckets", "o_orderkey bucket_idx bucket_low:m bucket_high:m",
    """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]))) AS q FROM orders),
         b AS (SELECT o_orderkey, q, GREATEST(len(list_filter(q, lambda x: x < o_totalprice)), 1) AS bucket_idx FROM orders CROSS JOIN e)
       SELECT o_orderkey, bucket_idx, q[bucket_idx] AS bucket_low, q[bucket_idx + 1] AS bucket_high FROM b""",
)
def quantile_buckets_query(i):
    return quantile_buckets(i.orders, "o_totalprice", 8)


@register(
    "clip", "c_custkey floored:m capped inside",
    """SELECT c_custkey, GREATEST(c_acctbal, 0) AS floored, LEAST(c_nationkey, 4) AS capped, LEAST(GREATEST(c_nationkey, 2), 10) AS inside
       FROM customer""",
)
def clip(i):
    return i.customer.select(
        "c_custkey", scalar.clip(F.col("c_acctbal"), low=0.0).alias("floored"), scalar.clip(F.col("c_nationkey"), high=4).alias("capped"),
        scalar.clip(F.col("c_nationkey"), 2, 10).alias("inside"),
    )


@register(
    "round_half", "c_custkey half_up:d half_even",
    "SELECT c_custkey, round(c_nationkey / 8.0, 2) AS half_up, round_even(c_nationkey / 2.0, 0) AS half_even FROM customer",
)
def round_half(i):
    n = F.col("c_nationkey")
    return i.customer.select("c_custkey", F.round(n / 8.0, 2).alias("half_up"), F.bround(n / 2.0, 0).alias("half_even"))


@register(
    "json_path", "ping_id k missing:s",
    "SELECT ping_id, CAST(json_extract_string(raw_request_json, '$.k') AS INT) AS k, NULL AS missing FROM v_ping",
)
def json_path(i):
    j = F.col("raw_request_json")
    return i.ping.select(
        "ping_id", jsonfn.json_path(j, "$.k", "int").alias("k"), jsonfn.json_path(j, "$.leadIpAddress").alias("missing")
    )


@register(
    "json_expand", "jluvr lead_amount:d request_datetime:t seller_name:s",
    """SELECT jluvr, CASE WHEN is_m0 = 1 THEN NULL ELSE loan_amount END AS lead_amount,
       CASE WHEN is_m0 = 1 THEN NULL ELSE request_datetime END AS request_datetime, seller_name FROM v_lead""",
)
def json_expand(i):
    body = F.to_json(
        F.struct(
            F.col("loan_amount").alias("leadAmount"),
            F.date_format("request_datetime", "yyyy-MM-dd HH:mm:ss").alias("requestDatetime"),
        )
    )
    rows = i.lead.withColumn("raw", F.when(F.col("is_m0") == 1, F.lit("{broken")).otherwise(body))
    schema = T.StructType([T.StructField("leadAmount", T.DoubleType()), T.StructField("requestDatetime", T.StringType())])
    return jsonfn.json_expand(rows, "raw", schema, dates=("request_datetime",))


APPLICATION = T.StructType(
    [
        T.StructField(
            "leaseApplication",
            T.StructType(
                [
                    T.StructField(
                        "applicants",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("firstName", T.StringType()),
                                    T.StructField(
                                        "addresses", T.ArrayType(T.StructType([T.StructField("ownershipType", T.StringType())]))
                                    ),
                                ]
                            )
                        ),
                    ),
                    T.StructField("property", T.StructType([T.StructField("zipCode", T.StringType())])),
                    T.StructField("expenses", T.StructType([T.StructField("rent", T.DoubleType())])),
                ]
            ),
        )
    ]
)


@register(
    "json_explode_applicants", "order_id first_name:s addresses_ownership_type:s zip_code:s rent:m",
    """SELECT o_orderkey AS order_id, first_name, CASE WHEN first_name IS NOT NULL THEN lower(o_orderstatus) END
         AS addresses_ownership_type, lower(o_orderpriority) AS zip_code, o_totalprice AS rent
       FROM orders LEFT JOIN (VALUES (1, 'anna'), (2, 'anna'), (2, 'bo')) a(n, first_name) ON n = o_custkey % 3""",
)
def json_explode_applicants(i):
    address = F.array(
        F.struct(F.col("o_orderpriority").alias("ownershipType")), F.struct(F.col("o_orderstatus").alias("ownershipType"))
    )
    people = F.slice(F.array(F.lit("Anna"), F.lit("Bo")), 1, (F.col("o_custkey") % 3).cast("int"))
    body = F.struct(
        F.transform(people, lambda p: F.struct(p.alias("firstName"), address.alias("addresses"))).alias("applicants"),
        F.struct(F.col("o_orderpriority").alias("zipCode")).alias("property"),
        F.struct(F.col("o_totalprice").alias("rent")).alias("expenses"),
    )
    rows = i.orders.select(F.col("o_orderkey").alias("order_id"), F.to_json(F.struct(body.alias("leaseApplication"))).alias("raw"))
    return jsonfn.json_explode_applicants(rows, "raw", APPLICATION)


@register(
    "hash_fraction", "order_id fraction:d",
    """SELECT DISTINCT order_id, CAST(('0x' || left(md5(concat('retry_cutoff_v1:', CAST(order_id AS VARCHAR))), 16)) AS UBIGINT)
       / 18446744073709551616.0 AS fraction FROM v_order_item""",
)
def hash_fraction(i):
    fraction = scalar.hash_fraction(F.col("order_id"), "retry_cutoff_v1")
    return i.order_item.select("order_id").distinct().withColumn("fraction", fraction)
