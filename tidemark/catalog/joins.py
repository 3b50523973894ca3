"""Joins, set operations and spines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import register
from tidemark.operators import economics, splits
from tidemark.operators.ordered import lookup_join, measure_skew
from tidemark.plans import attempts, calls, forecast, leads

VISIBLE = "retries IS NOT NULL AND transaction_type IN ('sale', 'capture') AND invoice_type NOT LIKE '%trial%'"


@register(
    "left_join_using", "call_id vertical_type:s",
    """SELECT call_id, split_part(vertical_type_bin, '_', 1) AS vertical_type
       FROM v_daily_call LEFT JOIN v_customer_sales USING (customer_id)""",
)
def left_join_using(i):
    return i.daily_call.join(i.customer_sales, "customer_id", "left").withColumn(
        "vertical_type", F.split_part("vertical_type_bin", F.lit("_"), F.lit(1))
    )


@register(
    "left_join_multi_key", "jluvr order_id",
    """SELECT l.jluvr, o.order_id FROM v_lead l LEFT JOIN (SELECT DISTINCT order_id, bank, order_status FROM v_order_item) o
       ON o.order_id = l.jluvr AND o.bank = l.seller_name AND o.order_status = 'success'""",
)
def left_join_multi_key(i):
    items = i.order_item.filter("order_status = 'success'").select("order_id", "bank").distinct()
    on = (F.col("order_id") == F.col("jluvr")) & (F.col("bank") == F.col("seller_name"))
    return i.lead.join(items, on, "left")


@register(
    "inner_join", "transaction_id part_id supp_id order_date:D",
    "SELECT * FROM v_order_item",
)
def inner_join(i):
    orders = i.orders.select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    return i.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"), F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"), "order_date",
    )


@register(
    "broadcast_dim", "transaction_id bin_tier:s",
    "SELECT transaction_id, bin_tier FROM v_attempt a LEFT JOIN v_bin_tier b ON a.vertical_type_bin = b.vertical_type_bin",
)
def broadcast_dim(i):
    # Spark broadcasts the lookup below spark.sql.autoBroadcastJoinThreshold and shuffles it above.
    return i.attempt.join(
        attempts.unique_dimension(i.bin_tier, "vertical_type_bin", "bin_tier"), "vertical_type_bin", "left"
    )


@register(
    "semi_join", "transaction_id",
    """SELECT transaction_id FROM v_attempt WHERE order_id IN (SELECT order_id FROM v_attempt
       WHERE transaction_status = 'accepted' AND transaction_amount > 300)""",
)
def semi_join(i):
    rich = i.attempt.filter("transaction_status = 'accepted' AND transaction_amount > 300").select("order_id")
    return i.attempt.join(rich, "order_id", "left_semi")


@register(
    "id_list_lookup", "outcome:s cascade_type:s n amount:m",
    """SELECT order_status AS outcome, cascade_type, COUNT(*) AS n, SUM(transaction_amount) AS amount FROM v_order_item
       WHERE order_id IN (SELECT jluvr FROM v_lead WHERE seller_minimum_price > 1.9 AND is_m0 = 1) GROUP BY 1, 2""",
)
def id_list_lookup(i):
    ids = i.lead.filter("seller_minimum_price > 1.9 AND is_m0 = 1").select(F.col("jluvr").alias("order_id"))
    return i.order_item.join(ids, "order_id", "left_semi").groupBy(F.col("order_status").alias("outcome"), "cascade_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("transaction_amount").alias("amount")
    )


TIER = "CASE WHEN part_id % 6 = 5 THEN 'Blacklist' WHEN part_id % 6 = 4 THEN NULL ELSE concat('Tier', CAST(part_id % 6 + 1 AS STRING)) END"
STATS_SQL = f"""(SELECT bank AS partner, order_date AS stat_date, COUNT(*) AS daily_total_count, COUNT(*) FILTER (WHERE is_m0 = 1) AS m0_count,
    COUNT(*) FILTER (WHERE tier = 'Tier1') AS tier1_count, COUNT(*) FILTER (WHERE tier = 'Tier2') AS tier2_count, COUNT(*) FILTER (WHERE tier = 'Tier3') AS tier3_count,
    COUNT(*) FILTER (WHERE tier = 'Tier4') AS tier4_count, COUNT(*) FILTER (WHERE tier = 'Blacklist') AS blacklist_count
  FROM (SELECT *, {TIER} AS tier FROM v_order_item) GROUP BY 1, 2)"""


def partner_stats(i):
    rows = i.order_item.withColumn("tier", F.expr(TIER))
    return leads.daily_partner_stats(rows, "bank", "order_date", "tier", F.col("is_m0") == 1)


@register(
    "range_join_trailing_days", "jluvr days m0 total",
    f"""SELECT p.jluvr, COUNT(d.stat_date) AS days, SUM(d.m0_count) AS m0, SUM(d.daily_total_count) AS total
        FROM v_lead p LEFT JOIN {STATS_SQL} d ON p.seller_name = d.partner
          AND d.stat_date >= CAST(p.request_datetime AS DATE) - 3 AND d.stat_date < CAST(p.request_datetime AS DATE)
        GROUP BY 1""",
)
def range_join_trailing_days(i):
    joined = leads.range_join_trailing_days(
        i.lead.select("jluvr", "seller_name", "request_datetime"), partner_stats(i), "seller_name", F.to_date("request_datetime")
    )
    return joined.groupBy("jluvr").agg(
        F.count("stat_date").alias("days"), F.sum("m0_count").alias("m0"), F.sum("daily_total_count").alias("total")
    )


FIRST_CUT = f"""(SELECT * FROM v_attempt WHERE {VISIBLE} AND success_probability < 0.05
  QUALIFY ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY transaction_datetime, transaction_id) = 1)"""


@register(
    "theta_after_cut", "transaction_id order_id transaction_amount:m",
    f"""SELECT a.transaction_id, a.order_id, a.transaction_amount FROM v_attempt a JOIN {FIRST_CUT} c ON a.order_id = c.order_id
        WHERE a.transaction_status = 'accepted' AND a.transaction_datetime > c.transaction_datetime""",
)
def theta_after_cut(i):
    visible = i.attempt.filter(attempts.extract_filter())
    cuts = economics.first_cuts(visible, {"p": F.col("success_probability") < 0.05}, ("invoice_sequence",))
    return economics.paid_after_cut(i.attempt, cuts)


SPINE_SQL = """(SELECT d.call_date, s.slot_minute FROM (SELECT unnest(generate_series(
    (SELECT CAST(MAX(call_start_at) AS DATE) + 1 FROM v_call_log), (SELECT CAST(MAX(call_start_at) AS DATE) + 14 FROM v_call_log),
    INTERVAL 1 DAY))::DATE AS call_date) d
  CROSS JOIN (SELECT DISTINCT CAST(floor((hour(call_start_at) * 60 + minute(call_start_at)) / 30) * 30 AS INT) AS slot_minute
    FROM v_call_log) s
  WHERE (isodow(d.call_date) <= 5 AND slot_minute >= 300 AND slot_minute < 1080)
     OR (isodow(d.call_date) > 5 AND slot_minute >= 420 AND slot_minute < 960))"""


@register("cross_join_filtered", "call_date:D slot_minute", f"SELECT * FROM {SPINE_SQL}")
def cross_join_filtered(i):
    shares = calls.slot_shares(i.call_log)
    return calls.future_spine(shares, i.call_log.agg(F.to_date(F.max("call_start_at"))).scalar())


MONTHS = """(SELECT CAST(date_trunc('month', call_date) AS DATE) AS month, COUNT(*) AS y FROM v_daily_call GROUP BY 1)"""


@register(
    "rolling_origin_join", "month:D points total:m",
    f"""SELECT t.month, COUNT(h.y) AS points, SUM(h.y) AS total FROM {MONTHS} t
        LEFT JOIN {MONTHS} h ON h.month <= t.month - INTERVAL 3 MONTH GROUP BY 1""",
)
def rolling_origin_join(i):
    monthly = forecast.monthly_total(i.daily_call, "call_date")
    return forecast.rolling_origin_join(monthly, monthly.select("month")).fillna(0, ["points"])


@register(
    "join_indicator", "order_id never_m0",
    """SELECT a.order_id, CASE WHEN c.order_id IS NULL THEN 1 ELSE 0 END AS never_m0
       FROM (SELECT DISTINCT order_id FROM v_attempt) a LEFT JOIN v_order_cltv c ON a.order_id = c.order_id""",
)
def join_indicator(i):
    hit = i.order_cltv.select("order_id", F.lit(1).alias("hit"))
    return i.attempt.select("order_id").distinct().join(hit, "order_id", "left").withColumn(
        "never_m0", F.col("hit").isNull().cast("int")
    )


@register(
    "lookup_back", "transaction_id invoice_start:t invoice_last:t",
    """SELECT transaction_id, MIN(transaction_datetime) OVER (PARTITION BY invoice_id) AS invoice_start,
       MAX(transaction_datetime) OVER (PARTITION BY invoice_id) AS invoice_last FROM v_attempt""",
)
def lookup_back(i):
    times = i.attempt.groupBy("invoice_id").agg(
        F.min("transaction_datetime").alias("invoice_start"), F.max("transaction_datetime").alias("invoice_last")
    )
    skew = measure_skew(i.attempt.select("invoice_id", "transaction_datetime"), ["invoice_id"], "transaction_datetime")
    return lookup_join(i.attempt, times, ["invoice_id"], skew)


@register(
    "outer_align", "segment:s true_negatives false_negatives",
    """WITH t AS (SELECT segment, COUNT(*) AS n FROM v_scored WHERE label = 0 AND score < 0.1 GROUP BY 1),
         f AS (SELECT segment, COUNT(*) AS n FROM v_scored WHERE label = 1 AND score < 0.3 AND amount > 150 GROUP BY 1)
       SELECT COALESCE(t.segment, f.segment) AS segment, COALESCE(t.n, 0) AS true_negatives, COALESCE(f.n, 0) AS false_negatives
       FROM t FULL JOIN f ON t.segment = f.segment""",
)
def outer_align(i):
    t = i.scored.filter("label = 0 AND score < 0.1").groupBy("segment").agg(F.count(F.lit(1)).alias("true_negatives"))
    f = i.scored.filter("label = 1 AND score < 0.3 AND amount > 150").groupBy("segment").agg(
        F.count(F.lit(1)).alias("false_negatives")
    )
    return t.join(f, "segment", "full_outer").fillna(0)


@register(
    "dedupe_before_join", "order_id cltv_360:m cltv_fanned_out:m ecltv_1y:m",
    """WITH e AS (SELECT order_id, MAX(cltv_pred_mean) AS p FROM v_ecltv GROUP BY 1),
         d AS (SELECT a.order_id, SUM(CASE WHEN is_sale = 1 AND within_360 THEN transaction_amount ELSE 0 END) AS v, MAX(p) AS p
               FROM v_attempt a LEFT JOIN e ON a.order_id = e.order_id WHERE is_m0 = 1 GROUP BY 1),
         r AS (SELECT a.order_id, SUM(CASE WHEN is_sale = 1 AND within_360 THEN transaction_amount ELSE 0 END) AS v
               FROM v_attempt a LEFT JOIN v_ecltv e ON a.order_id = e.order_id WHERE is_m0 = 1 GROUP BY 1)
       SELECT d.order_id, d.v AS cltv_360, r.v AS cltv_fanned_out, d.p AS ecltv_1y FROM d JOIN r ON d.order_id = r.order_id""",
)
def dedupe_before_join(i):
    clean = attempts.cltv_per_order(i.attempt, i.ecltv, dedupe=True)
    raw = attempts.cltv_per_order(i.attempt, i.ecltv, dedupe=False).select("order_id", F.col("cltv_360").alias("cltv_fanned_out"))
    return clean.join(raw, "order_id")


@register(
    "key_disjoint_check", "n_keys shared_keys",
    """SELECT COUNT(*) AS n_keys, SUM(CASE WHEN a <> b THEN 1 ELSE 0 END) AS shared_keys FROM (
         SELECT order_id, MIN(s) AS a, MAX(s) AS b FROM (SELECT order_id, CASE WHEN transaction_datetime < TIMESTAMP '2024-01-03'
           THEN 'past' ELSE 'oot' END AS s FROM v_attempt) GROUP BY 1)""",
)
def key_disjoint_check(i):
    late = F.col("transaction_datetime") >= F.lit("2024-01-03").cast("timestamp_ntz")
    return splits.key_disjoint_check(i.attempt.withColumn("split", F.when(late, "oot").otherwise("past")), "order_id", "split")


# --------------------------------------------------------------------------- sets and spines


@register(
    "union_all", "call_date:D day_of_week:s slot_minute actual:f",
    f"""SELECT CAST(call_start_at AS DATE) AS call_date, strftime(call_start_at, '%a') AS day_of_week,
          CAST(floor((hour(call_start_at) * 60 + minute(call_start_at)) / 30) * 30 AS INT) AS slot_minute, COUNT(*) AS actual
        FROM v_call_log GROUP BY 1, 2, 3
        UNION ALL SELECT call_date, strftime(call_date, '%a'), slot_minute, NULL FROM {SPINE_SQL}""",
)
def union_all(i):
    from tidemark.functions.timefn import day_name, slot_minute

    log = i.call_log
    past = log.groupBy(
        F.to_date("call_start_at").alias("call_date"), slot_minute(F.col("call_start_at")).alias("slot_minute")
    ).agg(F.count(F.lit(1)).cast("double").alias("actual"))
    past = past.withColumn("day_of_week", day_name(F.col("call_date")))
    future = calls.future_spine(calls.slot_shares(log), log.agg(F.to_date(F.max("call_start_at"))).scalar())
    return past.unionByName(future.withColumn("actual", F.lit(None).cast("double")))


@register(
    "distinct_rows", "order_id bank:s order_status:s",
    "SELECT DISTINCT order_id, bank, order_status FROM v_order_item",
)
def distinct_rows(i):
    return i.order_item.select("order_id", "bank", "order_status").distinct()


@register(
    "key_intersection", "shared",
    """SELECT COUNT(*) AS shared FROM (SELECT order_id FROM v_attempt WHERE transaction_datetime < TIMESTAMP '2024-01-10'
       INTERSECT SELECT order_id FROM v_attempt WHERE transaction_datetime >= TIMESTAMP '2024-01-10')""",
)
def key_intersection(i):
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    before = i.attempt.filter(F.col("transaction_datetime") < cut).select("order_id")
    after = i.attempt.filter(F.col("transaction_datetime") >= cut).select("order_id")
    return before.intersect(after).agg(F.count(F.lit(1)).alias("shared"))


@register(
    "calendar_spine", "date:D num_calls",
    """SELECT d.date, c.num_calls FROM (SELECT unnest(generate_series((SELECT MIN(call_date) FROM v_daily_call),
         (SELECT MAX(call_date) FROM v_daily_call), INTERVAL 1 DAY))::DATE AS date) d
       LEFT JOIN (SELECT call_date, COUNT(*) AS num_calls FROM v_daily_call GROUP BY 1) c ON c.call_date = d.date""",
)
def calendar_spine(i):
    return calls.on_spine(calls.count_calls(i.daily_call))


@register("future_spine", "call_date:D day_of_week:s slot_minute", f"SELECT *, strftime(call_date, '%a') AS day_of_week FROM {SPINE_SQL}")
def future_spine(i):
    return calls.future_spine(calls.slot_shares(i.call_log), i.call_log.agg(F.to_date(F.max("call_start_at"))).scalar())


@register(
    "month_spine", "month:D",
    f"""SELECT CAST(unnest(generate_series((SELECT MIN(month) FROM {MONTHS}), (SELECT MAX(month) + INTERVAL 6 MONTH FROM {MONTHS}),
        INTERVAL 1 MONTH)) AS DATE) AS month""",
)
def month_spine(i):
    return forecast.month_spine(forecast.monthly_total(i.daily_call, "call_date"), ahead=6)


