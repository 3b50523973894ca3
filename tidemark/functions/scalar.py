"""Arithmetic, binning and hashing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div0(num: Column, den: Column) -> Column:
    """Ratio; 0 where the denominator is 0; null where either side is null."""
    return F.when(den == 0, F.when(num.isNotNull(), F.lit(0.0))).otherwise(
        num.cast("double") / F.when(den != 0, den)
    )


def null_safe_ratio(num: Column, den: Column) -> Column:
    """Ratio; null where the denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def safe_ratio_eps(num: Column, den: Column, eps: float = 0.001, default: float = 0.0) -> Column:
    """num / (den + eps); ``default`` where that is infinite or missing."""
    ratio = F.try_divide(num.cast("double"), den.cast("double") + F.lit(eps))
    return F.coalesce(ratio, F.lit(default))


def hash_fraction(id_column: Column, salt: str) -> Column:
    """Stable fraction in [0, 1): the first 16 hex digits of md5('salt:id') over 2^64.

    Both halves are exact doubles, so their sum is the correctly rounded quotient.
    """
    digest = F.md5(F.concat(F.lit(f"{salt}:"), id_column.cast("string")))

    def part(start: int) -> Column:
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("double")

    return part(1) * F.lit(2.0**-32) + part(9) * F.lit(2.0**-64)


def split_of(fraction: Column, bounds: list[tuple[str, float]], last: str) -> Column:
    """Name of the first bound above the fraction, else ``last``."""
    out = None
    for name, upper in bounds:
        test = fraction < upper
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(F.lit(last))


def cut(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins (edges[i], edges[i+1]]; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((value > lo) & (value <= hi), label).otherwise(out)
    return out


def tiers(value: Column, cuts: list[tuple[float, str]], last: str) -> Column:
    """Label of the first upper bound that is not exceeded."""
    out = None
    for upper, label in cuts:
        out = F.when(value <= upper, label) if out is None else out.when(value <= upper, label)
    return out.otherwise(F.lit(last))


# Price tiers and confidence tiers.
PRICE_TIERS = [(0.80, "budget_tier"), (1.05, "standard_tier"), (1.15, "high_risk_premium")]
CONFIDENCE_EDGES = [0, 10, 25, 50, 75, 100]
CONFIDENCE_LABELS = ["Very Low", "Low", "Medium", "High", "Very High"]


def price_tier(price: Column) -> Column:
    return tiers(price, PRICE_TIERS, "extreme_premium")


def confidence_tier(percentile: Column) -> Column:
    return cut(percentile, CONFIDENCE_EDGES, CONFIDENCE_LABELS)


def open_bins(value: Column, bounds: list[float], strict_gaps: bool = True) -> Column:
    """Groups between bounds. With ``strict_gaps`` a value equal to a lower bound is in no
    group and falls through to the last one; without, groups include their lower bound."""
    names = [f"{a:g}-{b:g}" for a, b in zip(bounds[:-1], bounds[1:])]
    out = F.when(value < bounds[0], f"{bounds[0]:g} and under")
    for (lo, hi), name in zip(zip(bounds[:-1], bounds[1:]), names):
        inside = (value > lo) if strict_gaps else (value >= lo)
        out = out.when(inside & (value < hi), name)
    return out.otherwise(F.lit(f"{bounds[-1]:g}+"))


AGE_BOUNDS = [30, 40, 50, 60]
INCOME_BOUNDS = [3000, 4000, 5000, 6000]


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Keep null; limit the rest."""
    out = value
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def any_column_equals(columns: list[Column], literal: str) -> Column:
    """1 if the literal is in any of the columns, else 0."""
    return F.coalesce(F.array_contains(F.array_compact(F.array(*columns)), literal), F.lit(False)).cast("int")


def map_codes(value: Column, names: dict, otherwise: Column | None = None) -> Column:
    """Names for codes; other values pass through or become ``otherwise``."""
    out = None
    for code, name in names.items():
        out = F.when(value == F.lit(code), F.lit(name)) if out is None else out.when(value == F.lit(code), F.lit(name))
    return out.otherwise(value if otherwise is None else otherwise)


def label_to_binary(label: Column, positive: str = "m0", contains: bool = False) -> Column:
    text = F.lower(F.trim(label))
    hit = F.contains(text, F.lit(positive)) if contains else text == positive
    return F.coalesce(hit, F.lit(False)).cast("int")


def order_outcome(status: Column, cascade: Column) -> Column:
    """Outcome class of an order from its status and its cascade; the first match wins."""
    # Outcome names and cascade codes.
    black = cascade == "blacklist"
    return (
        F.when((status == "success") & cascade.isNull(), "AttrM0")
        .when((status == "success") & ~black, "casc_m0")
        .when((status == "success") & black, "CasB")
        .when((status == "failed") & cascade.isNull(), "D0")
        .when((status == "failed") & cascade.isin("CasD", "CasB", "CasP", "blacklist"), "Casc_Fail")
        .when(status == "new_order", "Blacklist")
        .otherwise("unknown")
    )


def processor_type(name: Column) -> Column:
    """Processor class from the token after the first dash; 'Others' without one."""
    token = F.get(F.split(name, "-"), F.lit(1))
    return F.when(token.like("%TRX%"), "NMI").when(token.like("%ADYEN%"), "ADYEN").otherwise("Others")
