"""Projections, filters, predicates and rule checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import register
from tidemark.functions import scalar, text, timefn
from tidemark.operators import cleaning
from tidemark.plans import calls, leads
from tidemark.sources.synthetic import application_form


def day(d):
    return F.lit(d).cast("date")


@register(
    "filter_open_range", "call_id call_date:D",
    "SELECT * FROM v_daily_call WHERE call_date > DATE '1996-01-01' AND call_date < DATE '1998-01-01'",
)
def filter_open_range(i):
    return calls.open_range(i.daily_call, "call_date", day("1996-01-01"), day("1998-01-01"))


@register(
    "filter_half_open", "o_orderkey o_orderdate:t",
    "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'",
)
def filter_half_open(i):
    at = F.col("o_orderdate")
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1996-01-01", "1997-01-01"))
    return i.orders.filter((at >= start) & (at < end))


@register(
    "filter_disjoint_ranges", "ping_id",
    """SELECT ping_id FROM v_ping WHERE request_datetime < TIMESTAMP '2024-01-10' OR request_datetime > TIMESTAMP '2024-01-20'""",
)
def filter_disjoint_ranges(i):
    at = F.col("request_datetime")
    return i.ping.filter((at < F.lit("2024-01-10").cast("timestamp_ntz")) | (at > F.lit("2024-01-20").cast("timestamp_ntz")))


@register(
    "filter_in_notin", "transaction_id membership_status:s bank:s",
    """SELECT * FROM v_attempt WHERE transaction_type IN ('sale', 'capture')
       AND membership_status NOT IN ('cancelled', 'expired') AND bank NOT IN ('B1', 'B2')""",
)
def filter_in_notin(i):
    # A null bank is kept by neither list.
    return i.attempt.filter(
        F.col("transaction_type").isin("sale", "capture")
        & ~F.col("membership_status").isin("cancelled", "expired")
        & ~F.col("bank").isin("B1", "B2")
    )


@register(
    "filter_like", "transaction_id",
    "SELECT * FROM v_attempt WHERE invoice_type NOT LIKE '%trial%' AND processor_name_original LIKE '%ADYEN%'",
)
def filter_like(i):
    return i.attempt.filter(~F.col("invoice_type").like("%trial%") & F.col("processor_name_original").like("%ADYEN%"))


@register("filter_not_null", "transaction_id", "SELECT * FROM v_attempt WHERE retries IS NOT NULL AND bank IS NOT NULL")
def filter_not_null(i):
    return i.attempt.dropna(subset=["retries", "bank"])


@register("point_lookup", "o_orderkey o_totalprice:m", "SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup(i):
    return i.orders.filter(F.col("o_orderkey") == 7)


HOURS_SQL = """((isodow(d) <= 5 AND m >= 300 AND m {end} 1080) OR (isodow(d) > 5 AND m >= 420 AND m {end} 960))"""


@register(
    "filter_business_hours", "call_id in_history in_plan",
    f"""SELECT call_id, CAST({HOURS_SQL.format(end='<=')} AS INT) AS in_history, CAST({HOURS_SQL.format(end='<')} AS INT) AS in_plan
        FROM (SELECT call_id, CAST(call_start_at AS DATE) AS d,
          floor((hour(call_start_at) * 60 + minute(call_start_at)) / 30) * 30 AS m FROM v_call_log)""",
)
def filter_business_hours(i):
    d, minute = F.to_date("call_start_at"), timefn.slot_minute(F.col("call_start_at"))
    return i.call_log.withColumns(
        {
            "in_history": timefn.in_business_hours(d, minute, include_end=True).cast("int"),
            "in_plan": timefn.in_business_hours(d, minute, include_end=False).cast("int"),
        }
    )


@register(
    "case_value_map", "jluvr mapped_seller_name:s partner_id",
    """SELECT jluvr, CASE seller_name WHEN '1-URGENT' THEN '233 Alpha' WHEN '2-HIGH' THEN '1011 Beta' ELSE seller_name END
         AS mapped_seller_name, CASE order_status WHEN 'success' THEN 948015 WHEN 'failed' THEN 948017 ELSE 999999 END AS partner_id
       FROM v_lead""",
)
def case_value_map(i):
    return i.lead.select(
        "jluvr",
        scalar.map_codes(F.col("seller_name"), {"1-URGENT": "233 Alpha", "2-HIGH": "1011 Beta"}).alias("mapped_seller_name"),
        scalar.map_codes(F.col("order_status"), {"success": 948015, "failed": 948017}, F.lit(999999)).alias("partner_id"),
    )


@register(
    "case_label", "jluvr label:s",
    """SELECT o_orderkey AS jluvr, CASE WHEN COALESCE(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'F' END) = 'F' THEN 'm0' ELSE 'unknown' END AS label FROM orders""",
)
def case_label(i):
    first = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    second = F.when(F.col("o_orderpriority") == "5-LOW", "F")
    label = F.when(F.coalesce(first, second) == "F", "m0").otherwise("unknown")
    return i.orders.select(F.col("o_orderkey").alias("jluvr"), label.alias("label"))


@register(
    "case_outcome_8way", "order_id transaction_id part_id supp_id outcome:s",
    """SELECT *, CASE WHEN order_status = 'success' AND cascade_type IS NULL THEN 'AttrM0'
         WHEN order_status = 'success' AND cascade_type NOT IN ('blacklist') THEN 'casc_m0'
         WHEN order_status = 'success' AND cascade_type IN ('blacklist') THEN 'CasB'
         WHEN order_status = 'failed' AND cascade_type IS NULL THEN 'D0'
         WHEN order_status = 'failed' AND cascade_type IN ('CasD', 'CasB', 'CasP', 'blacklist') THEN 'Casc_Fail'
         WHEN order_status = 'new_order' THEN 'Blacklist' ELSE 'unknown' END AS outcome FROM v_order_item""",
)
def case_outcome_8way(i):
    return i.order_item.withColumn("outcome", scalar.order_outcome(F.col("order_status"), F.col("cascade_type")))


@register(
    "case_processor_type", "transaction_id processor_type:s",
    """SELECT transaction_id, CASE WHEN split_part(processor_name_original, '-', 2) LIKE '%TRX%' THEN 'NMI'
       WHEN split_part(processor_name_original, '-', 2) LIKE '%ADYEN%' THEN 'ADYEN' ELSE 'Others' END AS processor_type FROM v_attempt""",
)
def case_processor_type(i):
    return i.attempt.withColumn("processor_type", scalar.processor_type(F.col("processor_name_original")))


@register(
    "any_column_equals", "person_id has_12 has_63",
    """SELECT person_id, CASE WHEN '12' IN (COALESCE(negative_factor_1, ''), COALESCE(negative_factor_2, ''),
         COALESCE(negative_factor_3, '')) THEN 1 ELSE 0 END AS has_12,
       CASE WHEN COALESCE(negative_factor_3, '') = '63' THEN 1 ELSE 0 END AS has_63 FROM v_credit_response""",
)
def any_column_equals(i):
    factors = [F.col(f"negative_factor_{n}") for n in range(1, 5)]
    return i.credit_response.withColumns(
        {"has_12": scalar.any_column_equals(factors, "12"), "has_63": scalar.any_column_equals(factors, "63")}
    )


@register(
    "billing_day_flag", "call_date:D is_billing_day",
    """SELECT DISTINCT call_date, CASE WHEN day(call_date) IN (1, 3, 15) OR isodow(call_date) IN (5, 6) THEN 1 ELSE 0 END
       AS is_billing_day FROM v_daily_call""",
)
def billing_day_flag(i):
    return i.daily_call.select("call_date", timefn.is_billing_day(F.col("call_date")).alias("is_billing_day")).distinct()


@register(
    "label_to_binary", "jluvr exact contains",
    """SELECT jluvr, CASE WHEN t = 'm0' THEN 1 ELSE 0 END AS exact, CASE WHEN contains(t, 'm0') THEN 1 ELSE 0 END AS contains
       FROM (SELECT jluvr, lower(trim(CASE order_status WHEN 'success' THEN ' M0 ' WHEN 'failed' THEN 'casc_m0' END)) AS t FROM v_lead)""",
)
def label_to_binary(i):
    label = F.when(F.col("order_status") == "success", " M0 ").when(F.col("order_status") == "failed", "casc_m0")
    return i.lead.select(
        "jluvr", scalar.label_to_binary(label).alias("exact"), scalar.label_to_binary(label, contains=True).alias("contains")
    )


@register(
    "impute_coalesce", "transaction_id bank:s card_type:s retries",
    """SELECT transaction_id, COALESCE(bank, 'unknown') AS bank, COALESCE(card_type, 'unknown') AS card_type,
       COALESCE(retries, -1) AS retries FROM v_attempt""",
)
def impute_coalesce(i):
    return cleaning.impute_by_role(i.attempt, ["retries"], ["bank", "card_type"])


@register(
    "impute_by_role", "transaction_id bank:s billing_state:s retries transaction_amount:m",
    """SELECT transaction_id, COALESCE(bank, 'unknown') AS bank, COALESCE(billing_state, 'unknown') AS billing_state,
       COALESCE(retries, -1) AS retries, transaction_amount FROM v_attempt""",
)
def impute_by_role(i):
    df = i.attempt
    keep = ("transaction_id",)
    return cleaning.impute_by_role(df, cleaning.numeric_columns(df, keep), cleaning.text_columns(df))


@register(
    "impute_zero_unknown", "transaction_id bank:s retries",
    "SELECT transaction_id, COALESCE(bank, 'Unknown') AS bank, COALESCE(retries, 0) AS retries FROM v_attempt",
)
def impute_zero_unknown(i):
    df = i.attempt
    return cleaning.impute_by_role(
        df, cleaning.numeric_columns(df, ("transaction_id",)), cleaning.text_columns(df), number=0, text="Unknown"
    )


@register(
    "clean_strings", "transaction_id state:s",
    """SELECT transaction_id, CASE WHEN t IN ('', 'NAN', 'NONE', 'NULL', 'N/A', 'UNKNOWN') THEN NULL ELSE t END AS state
       FROM (SELECT transaction_id, upper(trim(CASE billing_state WHEN 'NY' THEN ' n/a ' WHEN 'TX' THEN 'none' WHEN 'AZ' THEN ''
         ELSE concat(' ', billing_state, ' ') END)) AS t FROM v_attempt)""",
)
def clean_strings(i):
    raw = F.when(F.col("billing_state") == "NY", " n/a ").when(F.col("billing_state") == "TX", "none")
    raw = raw.when(F.col("billing_state") == "AZ", "").otherwise(F.concat(F.lit(" "), "billing_state", F.lit(" ")))
    return i.attempt.select("transaction_id", text.clean_string(raw).alias("state"))


@register(
    "id_as_string", "jluvr person:s price:s",
    """SELECT jluvr, CAST(person_id AS VARCHAR) AS person,
       regexp_replace(concat(CAST(person_id AS VARCHAR), '.0'), '\\.0$', '') AS price FROM v_lead""",
)
def id_as_string(i):
    through_double = F.concat(F.col("person_id").cast("string"), F.lit(".0"))
    return i.lead.select(
        "jluvr", text.id_as_string(F.col("person_id")).alias("person"), text.id_as_string(through_double).alias("price")
    )


DETECT = ["bank", "seen", "billing_state", "mostly"]


def detect_input(i):
    k = F.get_json_object("props", "$.k")
    return i.events.select(
        F.concat(F.lit("B"), k).alias("bank"), F.col("user_id").cast("string").alias("seen"),
        F.lit(None).cast("string").alias("billing_state"),
        F.when(k.cast("int") < 80, k).otherwise(F.concat(F.lit("x"), k)).alias("mostly"),
        F.col("ts").cast("string").alias("happened"),
    )


@register(
    "detect_numeric", "column_name:s n_valid numeric_share:d kind:s",
    """WITH c AS (SELECT concat('B', json_extract_string(props, '$.k')) AS bank, CAST(user_id AS VARCHAR) AS seen,
           CAST(NULL AS VARCHAR) AS billing_state, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 80
           THEN json_extract_string(props, '$.k') ELSE concat('x', json_extract_string(props, '$.k')) END AS mostly,
           CAST(ts AS VARCHAR) AS happened FROM events),
         u AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v FROM c" for c in [*DETECT, 'happened']) + """),
         s AS (SELECT column_name, COUNT(v) AS n_valid, COUNT(TRY_CAST(v AS DOUBLE)) / GREATEST(COUNT(v), 1) AS numeric_share,
           COUNT(TRY_CAST(v AS TIMESTAMP)) / GREATEST(COUNT(v), 1) AS dates FROM u GROUP BY 1)
       SELECT column_name, n_valid, numeric_share, CASE WHEN numeric_share >= 0.8 THEN 'numeric' WHEN dates >= 0.8 THEN 'datetime'
         ELSE 'categorical' END AS kind FROM s""",
)
def detect_numeric(i):
    return cleaning.detect_numeric(detect_input(i), [*DETECT, "happened"], threshold=0.80, dates=True)


@register(
    "coerce_types", "event_id number:d instant:t",
    """SELECT event_id, TRY_CAST(concat(CASE WHEN event_type = 'click' THEN 'x' ELSE '' END, CAST(user_id AS VARCHAR)) AS DOUBLE) AS number,
       TRY_CAST(CASE WHEN event_type = 'view' THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS instant FROM events""",
)
def coerce_types(i):
    raw = i.events.select(
        "event_id",
        F.concat(F.when(F.col("event_type") == "click", "x").otherwise(""), F.col("user_id").cast("string")).alias("number"),
        F.when(F.col("event_type") == "view", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("instant"),
    )
    return cleaning.coerce(raw, ["number"], ["instant"])


@register(
    "invalid_amount_to_null", "c_custkey balance:m",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer",
)
def invalid_amount_to_null(i):
    return i.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))


@register(
    "error_code_to_null", "person_id risk_score:d",
    "SELECT person_id, CASE WHEN risk_score >= 100 THEN risk_score END AS risk_score FROM v_credit_response",
)
def error_code_to_null(i):
    return leads.credit_flags(i.credit_response, day("2002-01-01"))


@register(
    "bool_to_int", "transaction_id flag",
    "SELECT transaction_id, COALESCE(CAST(retries > 3 AS INT), -1) AS flag FROM v_attempt",
)
def bool_to_int(i):
    return cleaning.bool_to_int(i.attempt.select("transaction_id", (F.col("retries") > 3).alias("flag")))


@register(
    "drop_constant_columns", "column_name:s is_constant",
    """WITH c AS (SELECT *, CAST(NULL AS VARCHAR) AS empty,
         CASE WHEN transaction_status = 'accepted' THEN 'x' END AS half FROM v_attempt) """
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CASE WHEN COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1"
        f" THEN 1 ELSE 0 END AS is_constant FROM c"
        for c in ("vertical_type", "bank", "retries", "empty", "half")
    ),
)
def drop_constant_columns(i):
    df = i.attempt.withColumns(
        {"empty": F.lit(None).cast("string"), "half": F.when(F.col("transaction_status") == "accepted", "x")}
    )
    return cleaning.constant_columns(df, ["vertical_type", "bank", "retries", "empty", "half"])


FORM_SQL = """WITH f AS (SELECT *, CAST(o_custkey % 5 AS INT) AS a, CAST(o_custkey % 7 AS INT) AS b FROM orders),
  g AS (SELECT o_orderkey AS jluvr, CAST(o_orderdate AS DATE) AS d,
    CASE a WHEN 0 THEN '' WHEN 1 THEN 'nan' ELSE concat('First', CAST(a AS VARCHAR)) END AS firstName,
    CASE b WHEN 0 THEN '0' WHEN 1 THEN 'many' WHEN 2 THEN NULL ELSE CAST(b * 100 AS VARCHAR) END AS amount,
    CASE a WHEN 0 THEN '123' ELSE concat('12345', CAST(b AS VARCHAR)) END AS accountNumber,
    CASE b WHEN 0 THEN '0123456789' WHEN 1 THEN '555' ELSE '5551234567' END AS homePhone,
    CASE a WHEN 2 THEN 'not-an-address' ELSE concat('user', CAST(b AS VARCHAR), '@example.com') END AS email,
    CASE b WHEN 3 THEN 'Please Choose' ELSE 'checking' END AS accountType,
    CASE a WHEN 3 THEN '01/02/1980' WHEN 4 THEN strftime(o_orderdate - INTERVAL 3000 DAY, '%Y-%m-%d') ELSE '1970-05-17' END AS dob,
    strftime(CAST(o_orderdate AS DATE) + CAST(b * 9 - 5 AS INT), '%Y-%m-%d') AS payDate,
    strftime(CAST(o_orderdate AS DATE) + CAST(a * 20 AS INT), '%Y-%m-%d') AS payDateNext, o_orderstatus FROM f),
  r AS (SELECT jluvr, o_orderstatus, list_filter([
    CASE WHEN accountNumber IS NULL OR trim(accountNumber) IN ('', 'nan', 'None') THEN 'accountNumber: Cannot be empty' END,
    CASE WHEN trim(accountType) IN ('', 'nan', 'None') THEN 'accountType: Cannot be empty' END,
    CASE WHEN amount IS NULL OR trim(amount) IN ('', 'nan', 'None') THEN 'amount: Cannot be empty' END,
    CASE WHEN dob IS NULL THEN 'dob: Cannot be empty' END,
    CASE WHEN email IS NULL THEN 'email: Cannot be empty' END,
    CASE WHEN trim(firstName) IN ('', 'nan', 'None') THEN 'firstName: Cannot be empty' END,
    CASE WHEN TRY_CAST(amount AS DOUBLE) <= 0 THEN 'amount: Must be > 0' END,
    CASE WHEN amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL THEN 'amount: Invalid numeric value' END,
    CASE WHEN length(accountNumber) NOT BETWEEN 4 AND 30 THEN 'accountNumber: Length not 4-30' END,
    CASE WHEN length(homePhone) <> 10 THEN 'homePhone: Length != 10' END,
    CASE WHEN homePhone[1] IN ('0', '1') THEN 'homePhone: Invalid Area Code' END,
    CASE WHEN NOT regexp_matches(email, '^[\\w\\.-]+@[\\w\\.-]+\\.\\w+$') THEN 'email: Invalid format' END,
    CASE WHEN lower(accountType) LIKE '%choose%' THEN 'accountType: Please choose an option' END,
    CASE WHEN TRY_CAST(dob AS DATE) IS NULL THEN 'dob: Invalid format (must be yyyy-mm-dd)' END,
    CASE WHEN (d - TRY_CAST(dob AS DATE)) / 365.25 < 18 THEN 'dob: Under 18' END,
    CASE WHEN (CAST(payDate AS DATE) - d) NOT BETWEEN 0 AND 40 THEN 'payDate: Not 0-40 days in future' END,
    CASE WHEN isodow(CAST(payDate AS DATE)) > 5 THEN 'payDate: Cannot be weekend' END,
    CASE WHEN (CAST(payDateNext AS DATE) - d) >= 71 THEN 'payDateNext: >= 71 days in future' END
    ], lambda x: x IS NOT NULL) AS reasons FROM g)"""


@register(
    "lead_validation", "jluvr is_invalid_leads invalid_reasons:s",
    FORM_SQL + """ SELECT jluvr, CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END AS is_invalid_leads,
      array_to_string(reasons, ' | ') AS invalid_reasons FROM r""",
)
def lead_validation(i):
    return cleaning.lead_validation(application_form(i.orders))


@register(
    "validation_vs_response", "is_invalid_leads response_type:s n",
    FORM_SQL + """ SELECT CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END AS is_invalid_leads, o_orderstatus AS response_type,
      COUNT(*) AS n FROM r GROUP BY 1, 2""",
)
def validation_vs_response(i):
    return cleaning.validation_vs_response(cleaning.lead_validation(application_form(i.orders)))


@register(
    "validation_reasons", "reason:s n",
    FORM_SQL + " SELECT reason, COUNT(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY 1",
)
def validation_reasons(i):
    return cleaning.reason_counts(cleaning.lead_validation(application_form(i.orders)))

