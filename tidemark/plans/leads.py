"""Leads: bureau rollups, partner statistics, seller momentum, lead features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import any_column_equals, div0, price_tier, safe_ratio_eps
from tidemark.functions.timefn import age_by_year, month_boundaries
from tidemark.operators.ordered import rolling_ranges, trailing_days


def trade_line_rollup(lines: DataFrame, today: Column, key: str = "person_id") -> DataFrame:
    """Metrics of all trade lines of a person in one aggregation."""
    c = F.col
    n = F.count(F.lit(1))
    opened = c("account_current_status") == "Open"
    months = month_boundaries(c("account_open_date"), today)
    bad = c("account_status") == "Derogatory"
    open_limit = F.sum(F.when(opened, c("credit_limit")))
    open_payment = F.sum(F.when(opened, c("monthly_payment")))
    unsecured = c("open_account_type") == "Unsecured loan"

    def kinds(column, *values):
        return F.count_if(c(column).isin(*values))

    return lines.groupBy(key).agg(
        n.alias("total_account_count"),
        F.count_if(opened).alias("total_open_account"),
        F.count_if(months <= 6).alias("account_opened_within_6_month"),
        kinds("account_type", "Revolving", "Credit Line", "Open Account", "Mortgage").alias("revolving_account_count"),
        kinds("account_type", "Installment").alias("installment_account_count"),
        # Fixed value: the feed spells it this way.
        kinds("account_type", "Colletion").alias("collection_account_count"),
        F.sum("high_balance").alias("total_high_balance"),
        F.sum("current_balance").alias("total_current_balance"),
        F.avg("credit_limit").alias("credit_limit_avg"),
        open_limit.alias("open_credit_limit_total"),
        # All payments over open limits, as defined.
        div0(F.sum("monthly_payment"), open_limit).alias("credit_utilization_ratio"),
        (F.max(months) / 12.0).alias("earliest_account_open_year"),
        (F.min(months) / 12.0).alias("latest_account_open_year"),
        F.count_if(bad).alias("derogatory_account_count"),
        div0(F.count_if(bad), n).alias("derogatory_account_ratio"),
        div0(F.count_if(bad & (c("account_current_status") == "Closed")), F.count_if(bad)).alias("closed_derogatory_account_ratio"),
        kinds("account_status", "Paid").alias("paid_account_count"),
        kinds("account_status", "Refinanced", "Transferred").alias("transferred_account_count"),
        div0(kinds("payment_status", "Current"), n).alias("on_time_payment_current_ratio"),
        F.count_if(unsecured).alias("unsecured_loan_account_count"),
        kinds("open_account_type", "Secured loan").alias("secured_loan_account_count"),
        kinds("open_account_type", "Educational").alias("educational_account_count"),
        F.count_if(F.lower("open_account_type") == "credit card").alias("credit_card_account_count"),
        kinds("open_account_type", "Charge account").alias("charge_account_count"),
        kinds("creditor_category", "BNPL_Fintech_Advance").alias("fintech_creditor_count"),
        F.count_if(unsecured & (c("creditor_category") == "BNPL_Fintech_Advance")).alias("unsecured_loan_fintech_count"),
        F.count_if(unsecured & (c("creditor_category") == "Personal_Installment_Payday_Loan")).alias("unsecured_loan_ploan_count"),
        open_payment.alias("current_monthly_payment_total"),
        div0(open_payment, F.sum("current_balance")).alias("payment_burden_ratio"),
        F.avg("monthly_payment").alias("historic_monthly_payment_avg"),
        F.avg("month_reviewed").alias("month_reviewed_avg"),
        *[F.sum(f"late_{d}_count").alias(f"late_{d}_total") for d in (30, 60, 90)],
        F.sum("amount_past_due").alias("past_due_amount_total"),
        div0(F.sum("amount_past_due"), F.sum("current_balance")).alias("past_due_to_current_balance_ratio"),
    )


def inquiry_rollup(inquiries: DataFrame, today: Column, key: str = "person_id") -> DataFrame:
    n = F.count(F.lit(1))
    return inquiries.groupBy(key).agg(
        n.alias("inquiry_total"),
        F.count_if(month_boundaries(F.col("inquiry_date"), today) <= 6).alias("inquiry_within_6_month"),
        div0(F.count_if(F.col("industry_code") == "Bank"), n).alias("bank_inquiry_ratio"),
        div0(F.count_if(F.col("industry_code") == "Finance/Personal"), n).alias("personal_inquiry_ratio"),
    )


def public_record_rollup(records: DataFrame, today: Column, key: str = "person_id") -> DataFrame:
    n = F.count(F.lit(1))
    return records.filter("classification = 'Bankruptcy'").groupBy(key).agg(
        n.alias("bankrupcy_total"),
        (F.min(month_boundaries(F.col("public_record_date"), today)) / 12.0).alias("most_recent_record_year"),
        div0(F.count_if(F.col("status") == "Discharged"), n).alias("bankrupty_discharged_ratio"),
    )


# Factor codes turned into flags.
NEGATIVE_FACTORS = ["12", "63", "07", "95", "04"]


def credit_flags(responses: DataFrame, today: Column) -> DataFrame:
    factors = [F.col(f"negative_factor_{n}") for n in range(1, 5)]
    return responses.withColumns(
        {
            "age": age_by_year(F.col("birth_year"), today),
            **{f"has_negative_factor_{f}": any_column_equals(factors, f) for f in NEGATIVE_FACTORS},
            # Scores below 100 are error codes.
            "risk_score": F.when(F.col("risk_score") >= 100, F.col("risk_score")),
        }
    )


TIER_NAMES = ["Tier1", "Tier2", "Tier3", "Tier4", "Blacklist"]


def daily_partner_stats(rows: DataFrame, partner: str, date: str, tier: str, m0: Column) -> DataFrame:
    """Counts per partner and day: all, m0, and by tier."""
    return rows.groupBy(F.col(partner).alias("partner"), F.col(date).alias("stat_date")).agg(
        F.count(F.lit(1)).alias("daily_total_count"),
        F.count_if(m0).alias("m0_count"),
        *[F.count_if(F.col(tier) == t).alias(f"{t.lower()}_count") for t in TIER_NAMES],
    )


def range_join_trailing_days(leads: DataFrame, stats: DataFrame, partner: str, date: Column, days: int = 3) -> DataFrame:
    """Each lead with its partner's daily rows of the ``days`` before it (null when there is none).

    A lead names its dates, so the range becomes an equality join.
    """
    wanted = F.sequence(F.date_sub(date, days), F.date_sub(date, 1))
    asked = leads.withColumn("__day", F.explode(wanted))
    on = (F.col(partner) == F.col("partner")) & (F.col("__day") == F.col("stat_date"))
    return asked.join(stats, on, "left").drop("partner")


def partner_past_3d(leads: DataFrame, stats: DataFrame, key: str, partner: str, date: Column) -> DataFrame:
    """Mean daily m0 and pooled tier shares of the partner in the three days before the lead.

    Statistics depend on (partner, day) only: they are joined to the distinct pairs, then to the leads.
    """
    pairs = leads.select(F.col(partner).alias("__p"), date.alias("__d")).distinct()
    joined = range_join_trailing_days(pairs, stats, "__p", F.col("__d"))
    total = F.sum("daily_total_count")
    past = joined.groupBy("__p", "__d").agg(
        F.avg("m0_count").alias("m0_past_3_days"),
        *[div0(F.sum(f"{t.lower()}_count"), total).alias(f"{t.lower()}_perc_past_3_days") for t in TIER_NAMES],
    )
    rows = leads.withColumn("__day", date)
    on = rows[partner].eqNullSafe(past["__p"]) & rows["__day"].eqNullSafe(past["__d"])
    return rows.join(past, on, "left").drop("__p", "__d", "__day")


def seller_momentum(leads: DataFrame) -> DataFrame:
    """Trailing conversion and volume per seller; the overall rate stands in for an empty past."""
    ranges = {f"r{d}": trailing_days(d) for d in (7, 3, 1)}
    rolled = rolling_ranges(leads, ["seller_name"], "request_datetime", F.col("is_m0").cast("long"), ranges)
    overall = leads.agg(F.avg("is_m0")).scalar()
    out = {f"seller_{d}d_conversion_rate": F.coalesce(F.try_divide(f"r{d}_s", f"r{d}_n"), overall) for d in (7, 3)}
    out.update({f"seller_{d}d_lead_volume": F.col(f"r{d}_n") for d in (7, 3, 1)})
    return rolled.withColumns(out).drop(*[f"r{d}_{x}" for d in (7, 3, 1) for x in "ns"])


def momentum_features(leads: DataFrame) -> DataFrame:
    """Short against long conversion, and a surge when the 3-day pace exceeds 1.5 x the 7-day pace."""
    daily_3d, daily_7d = F.col("seller_3d_lead_volume") / 3, F.col("seller_7d_lead_volume") / 7
    surge = daily_3d / (daily_7d + 1e-6)
    return leads.withColumns(
        {
            "cr_momentum_3d_vs_7d": F.col("seller_3d_conversion_rate") - F.col("seller_7d_conversion_rate"),
            "volume_surge_ratio": surge,
            "is_traffic_surge": (surge > 1.5).cast("int"),
        }
    )


def price_features(leads: DataFrame) -> DataFrame:
    """Price tier, flags and interactions; needs inquiry_total and risk_score."""
    price, inquiries = F.col("seller_minimum_price"), F.coalesce("inquiry_total", F.lit(0))
    premium = price > 1.05
    return leads.withColumns(
        {
            "price_is_sub_0_80": (price <= 0.80).cast("int"),
            "price_is_premium_over_1_05": premium.cast("int"),
            "price_group_tier": price_tier(price),
            "price_per_total_inquiry": price / (inquiries + 1),
            "high_risk_price_heavy_seeker": (premium & (inquiries > 4)).cast("int"),
            "price_to_risk_score_ratio": price / (F.coalesce("risk_score", F.lit(0.0)) + 1),
            "seller_value_index": safe_ratio_eps(price, F.col("seller_7d_conversion_rate")),
        }
    )


def lead_features(
    leads: DataFrame, responses: DataFrame, lines: DataFrame, inquiries: DataFrame, records: DataFrame, today: Column
) -> DataFrame:
    """One row per lead with a usable bureau answer: rollups, seller momentum, price features."""
    scored = credit_flags(responses, today).filter("risk_score IS NOT NULL")
    df = momentum_features(seller_momentum(leads))
    df = df.join(scored, "person_id")
    for rollup in (
        trade_line_rollup(lines, today), inquiry_rollup(inquiries, today), public_record_rollup(records, today)
    ):
        df = df.join(rollup, "person_id", "left")
    severity = F.col("late_30_total") + 2 * F.col("late_60_total") + 3 * F.col("late_90_total")
    df = df.withColumns(
        {
            "late_severity_score": severity,
            "open_accounts_ratio": F.coalesce(F.try_divide("total_open_account", "total_account_count"), F.lit(0.0)),
            "is_thin_file": (F.coalesce("total_account_count", F.lit(0)) == 0).cast("int"),
        }
    )
    return price_features(df)
