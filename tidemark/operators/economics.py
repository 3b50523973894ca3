"""Money reports of a retry cut-off, and audits of the label behind it.

A cut is the first attempt of an order that a policy would stop. It is found by one aggregate
per policy (minimum of (time, id, row)), so a sweep over many thresholds is one pass and an
order that holds most rows is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip
from tidemark.operators.evaluation import join_keys
from tidemark.operators.ordered import (
    KeySkew,
    lookup_join,
    measure_skew,
    prefix_scan,
    previous,
    quantile_columns,
    running_count,
    running_max,
)

# Cost of one retry, value cap, thresholds.
RETRY_COST = 0.1
VALUE_CAP = 20.0
THRESHOLDS = [0.01, 0.02, 0.03, 0.05, 0.10, 0.15, 0.20, 0.30, 0.40]
ORDER = ["transaction_datetime", "transaction_id"]
ROW = (
    "invoice_id", "invoice_sequence", "retries", "attempts_saved", "future_success", "is_eventually_successful",
    "historical_collected_amount", "cltv_360", "ecltv_1y", "success_probability",
)


def attempts_remaining(df: DataFrame, bonus: int = 0, cap: int | None = None, skew: KeySkew | None = None) -> DataFrame:
    """Attempts of the order from this one on, plus a bonus; with ``cap`` an order counts as ``cap`` attempts."""
    if cap is None:
        scanned = prefix_scan(df, ["order_id"], ORDER, {"__left": running_count(inclusive=True)}, skew, reverse=True)
        return scanned.withColumn("attempts_saved", F.col("__left") + bonus).drop("__left")
    scanned = prefix_scan(df, ["order_id"], ORDER, {"__before": running_count()}, skew)
    return scanned.withColumn("attempts_saved", F.lit(cap) - F.col("__before") + bonus).drop("__before")


def future_success(df: DataFrame, skew: KeySkew | None = None) -> DataFrame:
    """1 if an invoice of the order at or after this attempt succeeds."""
    return prefix_scan(df, ["order_id"], ORDER, {"future_success": _success_ahead()}, skew, reverse=True)


def _success_ahead():
    return running_max(F.col("is_eventually_successful"), inclusive=True)


def outlook(df: DataFrame, bonus: int = 0, skew: KeySkew | None = None) -> DataFrame:
    """Attempts left and success ahead in one backward scan."""
    scans = {"__left": running_count(inclusive=True), "future_success": _success_ahead()}
    scanned = prefix_scan(df, ["order_id"], ORDER, scans, skew, reverse=True)
    return scanned.withColumn("attempts_saved", F.col("__left") + bonus).drop("__left")


def cutoff_frame(
    pred: DataFrame, cltv: DataFrame, collected_offset: float = 1.0, bonus: int = 5, skew: KeySkew | None = None
) -> DataFrame:
    """Scored attempts with order values. Orders without a value never signed up: real zeros.
    A missing projection stays null, so such an order is never cut."""
    skew = measure_skew(pred, ["order_id"], ORDER[0]) if skew is None else skew
    df = lookup_join(pred, cltv.withColumn("__hit", F.lit(1)), ["order_id"], skew)
    df = df.withColumn("never_m0", F.col("__hit").isNull())
    df = df.withColumns(
        {
            "cltv_360": F.when(F.col("never_m0"), 0.0).otherwise(F.col("cltv_360")),
            "ecltv_1y": F.when(F.col("never_m0"), 0.0).otherwise(F.col("ecltv_1y")),
            "historical_collected_amount": F.col("historical_collected_amount") + collected_offset,
        }
    ).drop("__hit")
    return outlook(df, bonus, skew)


def cutoff_frame_strict(pred: DataFrame, cltv: DataFrame, skew: KeySkew | None = None) -> DataFrame:
    """Earlier policy: orders without both values are left out."""
    skew = measure_skew(pred, ["order_id"], ORDER[0]) if skew is None else skew
    df = lookup_join(pred, cltv, ["order_id"], skew, "inner").dropna(subset=["cltv_360", "ecltv_1y"])
    return outlook(df, skew=skew)


def first_cuts(frame: DataFrame, policies: dict[str, Column], row: tuple[str, ...] = ROW) -> DataFrame:
    """(policy, order_id, first row) for every policy in one aggregation per order."""
    packed = F.struct(*ORDER, *row)
    names = {f"__p{i}": name for i, name in enumerate(policies)}
    per_order = frame.groupBy("order_id").agg(
        *[F.min(F.when(test, packed)).alias(c) for c, test in zip(names, policies.values())]
    )
    cells = F.array(*[F.struct(F.lit(name).alias("policy"), F.col(c).alias("r")) for c, name in names.items()])
    return (
        per_order.select("order_id", F.explode(cells).alias("x"))
        .select("order_id", "x.policy", "x.r")
        .filter("r IS NOT NULL")
        .select("policy", "order_id", "r.*")
    )


def losses(gate: str = "future") -> tuple[Column, Column]:
    """Loss on the realised and on the projected value.

    'future': projected loss only where a later invoice pays; 'none': both always; 'label': both
    only on successful invoices and not clipped at 0.
    """
    actual = F.col("cltv_360") - F.col("historical_collected_amount")
    projected = F.col("ecltv_1y") - F.col("historical_collected_amount")
    if gate == "label":
        paid = F.col("is_eventually_successful") == 1
        return F.when(paid, actual).otherwise(0.0), F.when(paid, projected).otherwise(0.0)
    actual, projected = clip(actual, low=0.0), clip(projected, low=0.0)
    if gate == "future":
        projected = F.when(F.col("future_success") == 1, projected).otherwise(0.0)
    return actual, projected


def money_report(cuts: DataFrame, gate: str = "future", cost: float = RETRY_COST) -> DataFrame:
    actual, projected = losses(gate)
    gain = F.col("attempts_saved") * cost
    rows = cuts.withColumns({"__g": gain, "__a": actual, "__p": projected})
    lost = F.col("future_success") == 1
    return rows.groupBy("policy").agg(
        F.count(F.lit(1)).alias("orders_cut"),
        F.count_if(lost).alias("false_negatives"),
        F.avg(lost.cast("double")).alias("fn_rate"),
        F.count_if(F.col("cltv_360") == 0).alias("free_cuts"),
        F.sum("__g").alias("total_gain"),
        F.sum("__a").alias("loss_actual"),
        F.sum(F.col("__g") - F.col("__a")).alias("net_actual"),
        F.sum("__p").alias("loss_proj"),
        F.sum(F.col("__g") - F.col("__p")).alias("net_proj"),
    )


def model_policies(thresholds=THRESHOLDS, cap: float = VALUE_CAP) -> dict[str, Column]:
    return {f"{t:.2f}": (F.col("success_probability") < t) & (F.col("ecltv_1y") < cap) for t in thresholds}


def threshold_sweep(frame: DataFrame, thresholds=THRESHOLDS, cap: float = VALUE_CAP, gate: str = "future") -> DataFrame:
    return money_report(first_cuts(frame, model_policies(thresholds, cap)), gate)


def fixed_rule_sweep(frame: DataFrame, retries: list[int], cap: float = VALUE_CAP, gate: str = "future") -> DataFrame:
    """The baseline: cut at retry n whatever the model says."""
    policies = {str(n): (F.col("retries") >= n) & (F.col("ecltv_1y") < cap) for n in retries}
    return money_report(first_cuts(frame, policies), gate)


def gate_check(frame: DataFrame, threshold: float = 0.05, cap: float = VALUE_CAP) -> DataFrame:
    """Cut orders whose realised loss the success gate would hide, and the money in them."""
    cuts = first_cuts(frame, model_policies([threshold], cap))
    loss = clip(F.col("cltv_360") - F.col("historical_collected_amount"), low=0.0)
    hidden = (F.col("is_eventually_successful") != 1) & (loss != 0)
    return cuts.agg(
        F.count(F.lit(1)).alias("orders_cut"),
        F.count_if(hidden).alias("orders_differ"),
        F.coalesce(F.sum(F.when(hidden, loss)), F.lit(0.0)).alias("at_stake"),
    )


# The cumulative policy steps.
ABLATION_STEPS = [
    # name, dedupe, zero for missing, clip, success gate, gain by attempts, count this attempt
    ("0 original", False, True, False, True, False, False),
    ("1 dedupe projections", True, True, False, True, False, False),
    ("2 split missing values", True, False, False, True, False, False),
    ("3 clip loss at 0", True, False, True, True, False, False),
    ("4 drop success gate", True, False, True, False, False, False),
    ("5 count this attempt", True, False, True, False, False, True),
    ("6 order-wide attempts", True, False, True, False, True, True),
]


def ablation_frame(pred: DataFrame, cltv: DataFrame, cltv_raw: DataFrame, skew: KeySkew | None = None) -> DataFrame:
    """Scored attempts with both versions of the realised value and the order's highest retry."""
    skew = measure_skew(pred, ["order_id"], ORDER[0]) if skew is None else skew
    raw = cltv_raw.select("order_id", F.col("cltv_360").alias("cltv_raw"))
    top = pred.groupBy("order_id").agg(F.max("retries").alias("order_max_retry"))
    # One row per order from all three tables, then a single lookup.
    values = top.join(cltv.withColumn("__hit", F.lit(1)), "order_id", "left").join(raw, "order_id", "left")
    df = lookup_join(pred, values, ["order_id"], skew, "inner")
    df = df.withColumn("never_m0", F.col("__hit").isNull()).drop("__hit")
    return outlook(df, skew=skew)


def ablation(frame: DataFrame, threshold: float = 0.05, cap: float = VALUE_CAP) -> DataFrame:
    """Orders cut, gain, loss and net of each cumulative step, and the change from the step before.

    The steps differ in arithmetic and in two ways to treat missing values, so two first-cut
    aggregates and one exploded sum give all of them.
    """
    projected_zero = F.coalesce("ecltv_1y", F.lit(0.0))
    projected_split = F.when(F.col("never_m0"), 0.0).otherwise(F.col("ecltv_1y"))
    low = F.col("success_probability") < threshold
    row = (
        "retries", "attempts_saved", "order_max_retry", "is_eventually_successful",
        "historical_collected_amount", "cltv_360", "cltv_raw", "never_m0",
    )
    cuts = first_cuts(frame, {"zero": low & (projected_zero < cap), "split": low & (projected_split < cap)}, row)
    cells = []
    for name, dedupe, zero, clipped, gate, attempts, plus in ABLATION_STEPS:
        value = F.col("cltv_360") if dedupe else F.col("cltv_raw")
        value = F.coalesce(value, F.lit(0.0)) if zero else F.when(F.col("never_m0"), 0.0).otherwise(value)
        loss = value - F.col("historical_collected_amount")
        loss = clip(loss, low=0.0) if clipped else loss
        loss = F.when(F.col("is_eventually_successful") == 1, loss).otherwise(0.0) if gate else loss
        saved = F.col("attempts_saved") if attempts else F.col("order_max_retry") - F.col("retries") + int(plus)
        cells.append(
            F.when(
                F.col("policy") == ("zero" if zero else "split"),
                F.struct(F.lit(name).alias("step"), (saved * F.lit(RETRY_COST)).alias("gain"), loss.alias("loss")),
            )
        )
    steps = cuts.select(F.explode(F.array_compact(F.array(*cells))).alias("s")).select("s.*")
    out = steps.groupBy("step").agg(
        F.count(F.lit(1)).alias("orders_cut"), F.sum("gain").alias("gain"), F.sum("loss").alias("loss"),
        F.sum(F.col("gain") - F.col("loss")).alias("net"),
    )
    # Seven rows.
    return out.withColumn("delta_net", F.col("net") - F.lag("net").over(Window.partitionBy().orderBy("step")))


def gain_divergence(frame: DataFrame, threshold: float = 0.05, cap: float = VALUE_CAP, top: int = 4) -> DataFrame:
    """Two gain formulas by number of invoices of the order (``top`` and more together)."""
    split = F.when(F.col("never_m0"), 0.0).otherwise(F.col("ecltv_1y"))
    test = (F.col("success_probability") < threshold) & (split < cap)
    cuts = first_cuts(frame, {"p": test}, ("retries", "attempts_saved", "order_max_retry"))
    n = frame.groupBy("order_id").agg(F.count_distinct("invoice_id").alias("__inv"))
    by_max = (F.col("order_max_retry") - F.col("retries")) * RETRY_COST
    by_attempts = F.col("attempts_saved") * RETRY_COST
    return clipped_group(
        cuts.join(n, "order_id").withColumns({"by_max": by_max, "by_attempts": by_attempts}), "__inv", top,
        [
            F.count(F.lit(1)).alias("orders"), F.avg("by_max").alias("mean_by_max"),
            F.avg("by_attempts").alias("mean_by_attempts"), F.sum(F.col("by_attempts") - F.col("by_max")).alias("total_diff"),
            F.try_divide(F.avg("by_attempts"), F.avg("by_max")).alias("ratio"),
        ],
        "n_invoices",
    )


def clipped_group(df: DataFrame, column: str, top: int, measures: list[Column], out: str) -> DataFrame:
    """Group by min(column, top)."""
    return df.groupBy(F.least(F.col(column), F.lit(top)).alias(out)).agg(*measures)


def preflight_counts(pred: DataFrame, cltv: DataFrame, ecltv: DataFrame) -> DataFrame:
    """How many orders each policy step can touch at all."""
    repeated = ecltv.groupBy("order_id").count().filter("count > 1").agg(F.count(F.lit(1))).scalar()
    per_order = pred.groupBy("order_id").agg((F.min("invoice_id") != F.max("invoice_id")).cast("int").alias("multi"))
    joined = per_order.join(cltv.withColumn("__hit", F.lit(1)), "order_id", "left")
    absent = F.col("__hit").isNull()
    return joined.agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(absent).alias("never_m0"),
        F.count_if(~absent & F.col("ecltv_1y").isNull()).alias("no_projection"),
        F.avg("multi").alias("multi_invoice_share"),
    ).withColumn("repeated_projections", repeated)


def top_divergent_orders(frame: DataFrame, threshold: float = 0.10, cap: float = VALUE_CAP, n: int = 50) -> DataFrame:
    """Cut orders whose projected and realised values differ most; only successful ones differ."""
    test = (F.col("success_probability") < threshold) & (F.coalesce("ecltv_1y", F.lit(0.0)) < cap)
    cuts = first_cuts(frame, {"p": test})
    diff = F.coalesce("ecltv_1y", F.lit(0.0)) - F.coalesce("cltv_360", F.lit(0.0))
    diff = F.when(F.col("is_eventually_successful") == 1, diff).otherwise(0.0)
    return (
        cuts.withColumn("actual_minus_proj", diff)
        .withColumn("abs_diff", F.round(F.abs("actual_minus_proj"), 6))
        .orderBy(F.col("abs_diff").desc(), "order_id")
        .limit(n)
    )


def hidden_losses(frame: DataFrame, threshold: float = 0.05, cap: float = VALUE_CAP) -> DataFrame:
    """Cut orders with a failed invoice but a realised loss: what the success gate would hide."""
    cuts = first_cuts(frame, model_policies([threshold], cap))
    loss = clip(F.col("cltv_360") - F.col("historical_collected_amount"), low=0.0)
    return cuts.withColumn("loss", loss).filter((F.col("is_eventually_successful") == 0) & (F.col("loss") > 0))


def audit_hidden_money(fact: DataFrame) -> DataFrame:
    """Accepted money by visibility to the extract and by transaction type, with its share of all money."""
    bucket = (
        F.when(F.col("retries").isNull(), "retries IS NULL")
        .when(~F.col("transaction_type").isin("sale", "capture"), "other transaction_type")
        .otherwise("visible to extract")
    )
    paid = F.col("transaction_status") == "accepted"
    out = bucketed_visibility(fact, bucket, paid)
    total = out.agg(F.sum("accepted_amount")).scalar()
    return out.withColumn("share", F.try_divide(F.col("accepted_amount"), total))


def bucketed_visibility(fact: DataFrame, bucket: Column, paid: Column) -> DataFrame:
    return fact.groupBy(bucket.alias("bucket"), "transaction_type").agg(
        F.count(F.lit(1)).alias("txns"),
        F.count_if(paid).alias("accepted_txns"),
        F.sum(F.when(paid, F.col("transaction_amount")).otherwise(0.0)).alias("accepted_amount"),
    )


def value_gap(pred: DataFrame, cltv: DataFrame) -> DataFrame:
    """Per order with accepted money: realised value minus what the extract shows collected."""
    collected = (
        pred.filter("transaction_status = 'accepted'").groupBy("order_id").agg(F.sum("transaction_amount").alias("collected"))
    )
    return cltv.join(collected, "order_id").withColumn("gap", F.col("cltv_360") - F.col("collected"))


def audit_gap(gaps: DataFrame) -> DataFrame:
    """Distribution of the gap and the share above one cent."""
    quartiles = quantile_columns(gaps, [], "gap", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    stats = gaps.agg(
        F.count("gap").alias("n"), F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("std"),
        F.min("gap").alias("min"), F.max("gap").alias("max"),
        F.avg((F.col("gap") > 0.01).cast("double")).alias("share_above_cent"),
    )
    return join_keys(stats, quartiles, [])


def gap_histogram(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy(F.bround("gap", 0).alias("gap_rounded")).agg(F.count(F.lit(1)).alias("n"))


def paid_after_cut(pred: DataFrame, cuts: DataFrame) -> DataFrame:
    """Accepted attempts later than the cut of their order, with the position of their invoice."""
    at = cuts.select("order_id", F.col("transaction_datetime").alias("cut_at"), F.col("invoice_sequence").alias("cut_invoice"))
    paid = pred.filter("transaction_status = 'accepted'").join(at, "order_id")
    place = (
        F.when(F.col("invoice_sequence") > F.col("cut_invoice"), "later")
        .when(F.col("invoice_sequence") == F.col("cut_invoice"), "same")
        .otherwise("earlier")
    )
    return paid.filter(F.col("transaction_datetime") > F.col("cut_at")).withColumn("invoice_position", place)


def audit_after_cut(pred: DataFrame, cuts: DataFrame) -> DataFrame:
    """Is the claimed loss real? Money collected after the cut against the loss claimed, by invoice position."""
    after = paid_after_cut(pred, cuts)
    claimed = cuts.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"))).scalar()

    def of(place):
        return F.coalesce(
            F.sum(F.when(F.col("invoice_position") == place, F.col("transaction_amount"))), F.lit(0.0)
        ).alias(f"from_{place}")

    out = after.agg(
        F.count_distinct("order_id").alias("orders_with_money"),
        F.coalesce(F.sum("transaction_amount"), F.lit(0.0)).alias("collected_after"),
        of("later"), of("same"), of("earlier"),
    )
    return out.withColumns(
        {
            "orders": claimed["n"],
            "claimed_loss": F.coalesce(claimed["loss"], F.lit(0.0)),
            "ratio": F.col("collected_after") / F.greatest(F.coalesce(claimed["loss"], F.lit(0.0)), F.lit(1e-9)),
        }
    )


def audit_label_truth(fact: DataFrame, visible: Column) -> DataFrame:
    """Invoices that the extract labels failed although the full data shows a payment: one aggregation."""
    paid = F.col("transaction_status") == "accepted"
    per_invoice = fact.groupBy("invoice_id").agg(
        F.bool_or(visible).alias("seen"),
        F.max(F.when(visible, paid.cast("int"))).alias("label"),
        F.max(paid.cast("int")).alias("truth"),
    )
    wrong = (F.col("label") == 0) & (F.col("truth") == 1)
    return per_invoice.filter("seen").agg(
        F.count(F.lit(1)).alias("invoices"), F.count_if(wrong).alias("labelled_fail_but_paid"),
        (F.avg(wrong.cast("double")) * 100).alias("pct"),
    )


def invoice_timeline(pred: DataFrame, skew: KeySkew | None = None) -> DataFrame:
    """Per invoice its span, retries, label and money, and whether it starts before the previous one ended."""
    paid = F.col("transaction_status") == "accepted"
    inv = pred.groupBy("order_id", "invoice_id").agg(
        F.min("transaction_datetime").alias("first_txn"), F.max("transaction_datetime").alias("last_txn"),
        F.max("retries").alias("max_retry"), F.max("is_eventually_successful").alias("label"),
        F.sum(F.when(paid, F.col("transaction_amount")).otherwise(0.0)).alias("collected"),
    )
    inv = prefix_scan(inv, ["order_id"], ["first_txn", "invoice_id"], {"prev_last": previous(F.col("last_txn"))}, skew)
    return inv.withColumn("overlaps_prev", F.coalesce(F.col("first_txn") < F.col("prev_last"), F.lit(False)).cast("int"))


def overlap_share(timeline: DataFrame) -> DataFrame:
    per_order = timeline.groupBy("order_id").agg(
        F.sum("overlaps_prev").alias("s"), F.count(F.lit(1)).alias("n"), F.max("overlaps_prev").alias("any")
    )
    return per_order.agg(
        (F.sum("s") / F.sum("n")).alias("invoice_share"), F.avg("any").alias("order_share")
    )


def audit_never_m0(frame: DataFrame, offset: float = 1.0) -> DataFrame:
    """Orders without a value that collected money all the same (above the offset added to every order)."""
    per_order = frame.filter("never_m0").groupBy("order_id").agg(F.max("historical_collected_amount").alias("collected"))
    return per_order.filter(F.col("collected") > offset)


def never_m0_reasons(fact: DataFrame, orders: DataFrame, start: Column, end: Column) -> DataFrame:
    """Why those orders have no value: m0 at all, and order dates inside the value window."""
    per_order = (
        fact.join(orders.select("order_id"), "order_id", "left_semi")
        .groupBy("order_id")
        .agg(
            F.max("is_m0").alias("m0"), F.min("order_date").alias("lo"), F.max("order_date").alias("hi"),
            F.sum(F.when(F.col("transaction_status") == "accepted", F.col("transaction_amount")).otherwise(0.0)).alias("collected"),
        )
    )
    inside = (F.col("lo") >= start) & (F.col("hi") < end)
    return two_level_crosstab(
        per_order, F.when(F.col("m0") == 1, "m0").otherwise("no m0"), F.when(inside, "inside").otherwise("outside")
    )


def two_level_crosstab(per_key: DataFrame, first: Column, second: Column) -> DataFrame:
    return per_key.groupBy(first.alias("m0_bucket"), second.alias("window_bucket")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("collected").alias("collected")
    )


# Assumed costs of a free cut.
FREE_CUT_COSTS = [0.05, 0.10, 0.13, 0.20, 0.50]


def cost_sensitivity(report: DataFrame, costs=FREE_CUT_COSTS) -> DataFrame:
    """Net of each policy when every free cut costs something after all."""
    rows = report.withColumn("cost_per_cut", F.explode(F.array(*[F.lit(c) for c in costs])))
    net = F.col("net_actual") - F.col("free_cuts") * F.col("cost_per_cut")
    return rows.select("policy", "cost_per_cut", net.alias("net"), (net < 0).cast("int").alias("is_negative"))
