"""Payment attempts: point-in-time features of live invoices, invoice outcomes, scored attempts.

Order of rows: invoices by (start, invoice_id); attempts by (time, transaction_id); inside an
invoice by (retries, time, transaction_id). History ends before the current row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import div0, processor_type
from tidemark.functions.timefn import day_of_week_sunday0, days_between
from tidemark.operators.ordered import (
    DAY_US,
    SECOND_US,
    KeySkew,
    TimeRange,
    at_instants,
    measure_skew,
    prefix_scan,
    previous,
    range_totals,
    running_count,
    running_max,
    running_sum,
)
from tidemark.sources.scratch import staged

def accepted() -> Column:
    return F.col("transaction_status") == "accepted"


def money(amount: Column) -> Column:
    """Amounts as decimals: sums are exact, whatever the order of the rows."""
    return amount.cast("decimal(18,6)")


ATTEMPT_ORDER = ["transaction_datetime", "transaction_id"]
# An invoice id may be shared by two orders.
INVOICE = ["order_id", "invoice_id"]
EIGHT_DAYS = TimeRange(8 * DAY_US, SECOND_US, closed_end=True)


def extract_filter() -> Column:
    """Attempts the extract sees: sales and captures with a retry number, trials left out."""
    return F.col("retries").isNotNull() & F.col("transaction_type").isin("sale", "capture") & ~F.col(
        "invoice_type"
    ).like("%trial%")


def live_invoices(fact: DataFrame, asof: Column, since: Column, max_retries: int = 30, days: int = 30) -> DataFrame:
    """Invoices still worth a retry: few retries, a recent attempt, membership not ended."""
    return (
        fact.filter(extract_filter() & ~F.col("membership_status").isin("cancelled", "expired") & (F.col("order_date") >= since))
        .groupBy("invoice_id", "order_id")
        .agg(F.max("retries").alias("max_retries"), F.max("transaction_datetime").alias("last_attempt"))
        .filter((F.col("max_retries") < max_retries) & (F.to_date("last_attempt") >= F.date_sub(asof, days)))
        .select("invoice_id", "order_id")
    )


# What the features read of an attempt.
USED = (
    "order_id invoice_id transaction_id transaction_datetime retries transaction_status transaction_amount offer_amount decline_code invoice_sequence "
    "processor_name_original vertical_type_bin vertical_type super_partner_id_name card_type bank billing_state payment_frequency invoice_type"
).split()


def base_transactions(fact: DataFrame, bin_tier: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """All visible attempts (of the given orders), with the tier of their bin.

    The tier table is one row per bin (see ``unique_dimension``), so it cannot fan out.
    """
    visible = fact.filter(extract_filter()).select(*USED)
    if orders is not None:
        visible = visible.join(orders, "order_id", "left_semi")
    return (
        visible.join(unique_dimension(bin_tier, "vertical_type_bin", "bin_tier"), "vertical_type_bin", "left")
        .withColumn("offer_minus_payment", F.col("offer_amount") - F.col("transaction_amount"))
    )


def unique_dimension(dim: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key, so a lookup cannot multiply rows. Spark broadcasts it below its size threshold."""
    return dim.groupBy(key).agg(F.max(value).alias(value))


def invoice_summary(base: DataFrame) -> DataFrame:
    """Outcome of each whole invoice. Only earlier invoices' outcomes may enter features."""
    return base.groupBy("order_id", "invoice_id").agg(
        F.min("transaction_datetime").alias("invoice_start_time"),
        F.max("retries").alias("invoice_max_retries"),
        F.max(accepted().cast("int")).alias("is_eventually_successful"),
        F.max((accepted() & (F.col("retries") == 0)).cast("int")).alias("is_success_on_retry_0"),
    )


def order_history(invoices: DataFrame, skew: KeySkew | None = None) -> DataFrame:
    """Earlier invoices of the order, before each invoice: counts, sums, last retry count, streak.

    The streak is the number of first-try successes since the last invoice without one. First-try
    successes only grow, so it equals their count before this invoice minus their count at the
    latest failure, a running maximum; no window inside a window.
    """
    order = ["invoice_start_time", "invoice_id"]
    first_try = F.col("is_success_on_retry_0")
    history = prefix_scan(
        invoices, ["order_id"], order,
        {
            "prior_successful_invoices": running_sum(F.col("is_eventually_successful")),
            "last_invoice_retry": previous(F.col("invoice_max_retries")),
            "sum_past_max_retries": running_sum(F.col("invoice_max_retries")),
            "count_past_invoices": running_count(),
            "streak_group_id": running_sum(1 - first_try),
            "__won": running_sum(first_try),
            "__won_incl": running_sum(first_try, inclusive=True),
        },
        skew,
    )
    history = prefix_scan(
        history, ["order_id"], order,
        {"__won_at_loss": running_max(F.when(first_try == 0, F.col("__won_incl")))}, skew,
    )
    won, at_loss = F.coalesce("__won", F.lit(0)), F.coalesce("__won_at_loss", F.lit(0))
    return history.withColumns(
        {"consecutive_success_retry_0": won - at_loss, "streak_group_id": F.coalesce("streak_group_id", F.lit(0))}
    ).drop("__won", "__won_incl", "__won_at_loss")


def attempt_sequence(base: DataFrame, history: DataFrame, skew: KeySkew | None = None) -> DataFrame:
    """Row-by-row features of each attempt: dynamic maximum and average retry, money so far, previous decline."""
    rows = prefix_scan(
        base, ["order_id"], ATTEMPT_ORDER,
        {
            "max_retry_in_order": running_max(F.col("retries"), inclusive=True),
            "historical_collected_amount": running_sum(money(F.when(accepted(), F.col("transaction_amount")).otherwise(0.0))),
        },
        skew,
    )
    rows = prefix_scan(
        rows, INVOICE, ["retries", *ATTEMPT_ORDER],
        {
            "last_failure_datetime": previous(F.col("transaction_datetime")),
            "last_decline_code_raw": previous(F.col("decline_code")),
        },
        measure_skew(base.select(*INVOICE, "retries"), INVOICE, "retries"),
    )
    rows = rows.withColumn("historical_collected_amount", F.coalesce(F.col("historical_collected_amount").cast("double"), F.lit(0.0)))
    # Joined on order and invoice: an invoice id shared by two orders must not multiply rows.
    rows = rows.join(history, ["order_id", "invoice_id"])
    past_sum, past_n = F.coalesce("sum_past_max_retries", F.lit(0)), F.coalesce("count_past_invoices", F.lit(0))
    return rows.withColumn("avg_retry_in_order", (past_sum + F.col("retries")) / (past_n + F.lit(1.0)))


def trial_money(fact: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    trials = fact.filter(F.col("invoice_type").like("%trial%")).select("order_id", "transaction_status", "transaction_amount")
    if orders is not None:
        trials = trials.join(orders, "order_id", "left_semi")
    return (
        trials.groupBy("order_id")
        .agg(F.sum(money(F.when(accepted(), F.col("transaction_amount")).otherwise(0.0))).cast("double").alias("trial_collected_amount"))
    )


def latest_attempt(rows: DataFrame, keys: list[str] = INVOICE) -> DataFrame:
    """The most recent attempt per key. A maximum of (time, id, row) combines on the map side."""
    payload = [c for c in rows.columns if c not in (*keys, *ATTEMPT_ORDER)]
    newest = F.max_by(F.struct(*payload), F.struct(*ATTEMPT_ORDER))
    out = rows.groupBy(*keys).agg(F.max(F.struct(*ATTEMPT_ORDER)).alias("__at"), newest.alias("__row"))
    return out.select(*keys, "__at.*", "__row.*").select(*rows.columns)


# Keys with a trailing success rate and the names of the rates.
RATES = {
    "super_partner_id_name": "super_partner_8d_success_rate",
    "processor_name_original": "processor_8d_success_rate",
    "bank": "bank_8d_success_rate",
}


def success_rates_8d(base: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Accepted share of the attempts of the same partner, processor and bank in the eight days up to
    one second before each target (by default each attempt): (transaction_id, rates).

    The three keys are stacked into one (name, value) key, so all rates take one pass.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).alias("key_value")) for k in RATES])

    def stacked(df: DataFrame) -> DataFrame:
        rows = df.select("transaction_id", "transaction_datetime", accepted().cast("long").alias("won"), F.explode(pairs).alias("p"))
        return rows.select("transaction_id", "transaction_datetime", "won", "p.*")

    key = ["key_name", "key_value"]
    asked = None if targets is None else stacked(targets)
    totals = range_totals(stacked(base), key, "transaction_datetime", F.col("won"), {"r": EIGHT_DAYS}, asked)
    found = at_instants(stacked(base) if asked is None else asked, key, "transaction_datetime", totals)
    rate = F.try_divide("r_s", "r_n")
    return found.groupBy("transaction_id").agg(
        *[F.max(F.when(F.col("key_name") == k, rate)).alias(out) for k, out in RATES.items()]
    )


UNKNOWN = (
    "vertical_type super_partner_id_name bin_tier card_type bank billing_state payment_frequency invoice_type"
).split()


def attempt_states(base: DataFrame, skew: KeySkew) -> DataFrame:
    """Every attempt with what was known at it: running values of its order and invoice, and the order's earlier invoices
    (whose outcomes count as far as the table knows them)."""
    return attempt_sequence(base, order_history(invoice_summary(base), skew), skew)


def attempt_features(fact: DataFrame, bin_tier: DataFrame, asof: Column, since: Column) -> DataFrame:
    """One row per live invoice in a declined state: everything known at its latest attempt."""
    live = staged(live_invoices(fact, asof, since), "live_invoices")
    live_orders = live.select("order_id").distinct()
    # Seven steps below read the attempts of live orders: selected once, read by column after that.
    base = staged(base_transactions(fact, bin_tier, live_orders), "base_transactions")
    states = attempt_states(base, order_skew(base))
    scored = latest_attempt(states.join(live, INVOICE, "left_semi")).filter(~accepted())
    # The rates read the whole history but are only asked for the instants that are scored.
    slim = base.select(*INVOICE, *ATTEMPT_ORDER, "transaction_status", *RATES).join(live, INVOICE, "left_semi")
    asked = latest_attempt(slim).filter(~accepted())
    return feature_table(scored, success_rates_8d(base, asked), trial_money(fact, live_orders))


def training_frame(fact: DataFrame, bin_tier: DataFrame, days: int = 30) -> DataFrame:
    """One row per past decline of a mature invoice: the features of ``attempt_features`` as they stood at that attempt,
    the invoice's start, last attempt and time of resolution, and its final label.

    Mature invoices started ``days`` or more before the last attempt in the data, so their label no longer changes. The states
    are those of every row of the same scans that scoring reads at the latest row; the rates are asked at the declines."""
    base = staged(base_transactions(fact, bin_tier), "base_transactions")
    skew = order_skew(base)
    spans = base.groupBy(*INVOICE).agg(
        F.min("transaction_datetime").alias("invoice_start"), F.max("transaction_datetime").alias("invoice_last_txn"),
        F.min(F.when(accepted(), F.col("transaction_datetime"))).alias("__paid_at"),
    )
    last = base.agg(F.max("transaction_datetime") - F.make_dt_interval(F.lit(days))).scalar()
    late = F.col("invoice_start") + F.make_dt_interval(F.lit(days))
    mature = staged(
        spans.filter(F.col("invoice_start") <= last).withColumn("resolved_at", F.coalesce("__paid_at", late)).drop("__paid_at"), "mature_invoices"
    )
    states = attempt_states(base, skew).filter(~accepted())
    asked = base.select(*INVOICE, *ATTEMPT_ORDER, "transaction_status", *RATES).filter(~accepted()).join(mature, INVOICE, "left_semi")
    frame = feature_table(states.join(mature, INVOICE, "left_semi"), success_rates_8d(base, asked), trial_money(fact))
    return frame.join(mature, INVOICE)


def feature_table(rows: DataFrame, rates: DataFrame, trials: DataFrame) -> DataFrame:
    """The columns that models read, from attempts with their states, rates by transaction and trial money by order."""
    rows = rows.join(rates, "transaction_id", "left").join(trials, "order_id", "left")
    ts = F.col("transaction_datetime")
    minus_one = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0))
        for c in ("offer_amount", "transaction_amount", "offer_minus_payment", "avg_retry_in_order", *RATES.values())
    }
    minus_one.update(
        {c: F.coalesce(F.col(c), F.lit(-1)) for c in ("max_retry_in_order", "last_invoice_retry", "consecutive_success_retry_0")}
    )
    return rows.select(
        "order_id", "invoice_id", "transaction_id", "transaction_datetime",
        F.col("invoice_sequence").alias("invoice_number"), "retries", "transaction_status",
        processor_type(F.col("processor_name_original")).alias("processor_type"),
        *[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in UNKNOWN],
        F.coalesce("last_decline_code_raw", F.lit("unknown")).alias("last_decline_code"),
        *[v.alias(c) for c, v in minus_one.items()],
        F.coalesce("prior_successful_invoices", F.lit(-1)).alias("prior_successful_invoice_count"),
        "historical_collected_amount",
        F.coalesce(days_between(F.col("invoice_start_time"), ts), F.lit(-1)).alias("days_since_initial_failure"),
        F.coalesce(days_between(F.col("last_failure_datetime"), ts), F.lit(-1)).alias("days_since_last_failure"),
        day_of_week_sunday0(ts).alias("retry_day_of_week"),
        F.dayofmonth(ts).alias("retry_day_of_month"),
        F.hour(ts).alias("retry_hour"),
        F.coalesce("trial_collected_amount", F.lit(0.0)).alias("trial_collected_amount"),
        "is_eventually_successful",
    )


def order_skew(attempts: DataFrame) -> KeySkew:
    """Orders with more attempts than one task should sort; one count over two columns."""
    return measure_skew(attempts.select("order_id", "transaction_datetime"), ["order_id"], "transaction_datetime")


def scored_attempts(fact: DataFrame, skew: KeySkew | None = None) -> DataFrame:
    """Visible attempts with the outcome of their invoice and the money collected before them."""
    base = fact.filter(extract_filter())
    label = base.groupBy("order_id", "invoice_id").agg(F.max(accepted().cast("int")).alias("is_eventually_successful"))
    paid = money(F.when(accepted(), F.col("transaction_amount")).otherwise(0.0))
    rows = prefix_scan(base, ["order_id"], ATTEMPT_ORDER, {"__paid": running_sum(paid)}, skew)
    rows = rows.withColumn("historical_collected_amount", F.coalesce(F.col("__paid").cast("double"), F.lit(0.0))).drop("__paid")
    return rows.join(label, ["order_id", "invoice_id"])


def invoice_resolution(attempts: DataFrame, days: int = 30) -> DataFrame:
    """Start, last attempt and time of resolution of each invoice.

    Resolved at the first accepted attempt, or ``days`` after the start when never paid. An invoice
    labelled successful without an accepted attempt has no resolution: see ``resolution_errors``.
    """
    out = attempts.groupBy("invoice_id").agg(
        F.min("transaction_datetime").alias("invoice_start"),
        F.max("transaction_datetime").alias("invoice_last_txn"),
        F.max("is_eventually_successful").alias("is_eventually_successful"),
        F.min(F.when(accepted(), F.col("transaction_datetime"))).alias("__paid_at"),
    )
    late = F.col("invoice_start") + F.make_dt_interval(F.lit(days))
    return out.withColumn(
        "resolved_at", F.when(F.col("is_eventually_successful") == 1, F.col("__paid_at")).otherwise(late)
    ).drop("__paid_at")


def resolution_errors(resolution: DataFrame) -> DataFrame:
    return resolution.agg(F.count_if(F.col("resolved_at").isNull()).alias("unresolved_successes"))


def cltv_per_order(fact: DataFrame, ecltv: DataFrame, dedupe: bool = True) -> DataFrame:
    """Realised value of m0 orders and their projected value.

    Without ``dedupe`` a repeated projection multiplies the realised value, as a plain join would.
    """
    # One row per order either way; how often it would have come is a number, not rows.
    ecltv = ecltv.groupBy("order_id").agg(F.max("cltv_pred_mean").alias("cltv_pred_mean"), F.count(F.lit(1)).alias("__times"))
    rows = fact.filter("is_m0 = 1").join(ecltv, "order_id", "left")
    inside = F.col("within_360")
    sales = F.sum(F.when((F.col("is_sale") == 1) & inside, F.col("transaction_amount")).otherwise(0.0))
    # Per order the distinct count of its own id is 1 when any row is inside the window.
    orders = F.max(F.when(inside, 1).otherwise(0))
    times = F.lit(1) if dedupe else F.coalesce(F.max("__times"), F.lit(1))
    return rows.groupBy("order_id").agg(div0(sales * times, orders).alias("cltv_360"), F.max("cltv_pred_mean").alias("ecltv_1y"))
