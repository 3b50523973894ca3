"""Text inputs the given tables lack (application forms, user agents, JSON), derived row by row from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(selector: Column, values: list, default=None) -> Column:
    out = None
    for n, v in enumerate(values):
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(selector == n, v) if out is None else out.when(selector == n, v)
    return out if default is None else out.otherwise(default)


def application_form(orders: DataFrame) -> DataFrame:
    """A lead form per order with a known mix of faults."""
    a, b = F.col("o_custkey") % 5, F.col("o_custkey") % 7
    day = F.to_date("o_orderdate")

    def text(c: Column) -> Column:
        return c.cast("string")

    def plus(days: Column) -> Column:
        return F.date_format(F.date_add(day, days.cast("int")), "yyyy-MM-dd")

    return orders.select(
        F.col("o_orderkey").alias("jluvr"),
        F.col("o_orderdate").alias("request_datetime"),
        F.col("o_orderstatus").alias("response_type"),
        _pick(a, ["", "nan"], F.concat(F.lit("First"), text(a))).alias("firstName"),
        _pick(b, ["0", "many", F.lit(None).cast("string")], text(b * 100)).alias("amount"),
        F.when(a == 0, "123").otherwise(F.concat(F.lit("12345"), text(b))).alias("accountNumber"),
        _pick(b, ["0123456789", "555"], F.lit("5551234567")).alias("homePhone"),
        F.when(a == 2, "not-an-address").otherwise(F.concat(F.lit("user"), text(b), F.lit("@example.com"))).alias("email"),
        F.when(b == 3, "Please Choose").otherwise("checking").alias("accountType"),
        F.when(a == 3, "01/02/1980").when(a == 4, plus(F.lit(-3000))).otherwise("1970-05-17").alias("dob"),
        plus(b * 9 - 5).alias("payDate"),
        plus(a * 20).alias("payDateNext"),
    )


# User agents of common devices.
USER_AGENTS = [
    "Mozilla/5.0 (iPhone; CPU iPhone OS 18_7 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.0 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 16_1 like Mac OS X) AppleWebKit/605.1.15 Mobile/20B82 [FBAN/FBIOS;FBAV/390.0;FBDV/iPhone11,8;FBMD/iPhone]",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 Mobile/21C62 [FBAN/FBIOS;FBDV/iPhone14,5]",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17 like Mac OS X) AppleWebKit/605.1.15 CriOS/120.0 Mobile/15E148 Safari/604.1 FBDV/iPhone16,1",
    "Mozilla/5.0 (Linux; Android 13; SM-X200) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (Linux; Android 12; SM-G991U) AppleWebKit/537.36 SamsungBrowser/20.0 Chrome/106.0 Mobile Safari/537.36",
    "Mozilla/5.0 (Linux; Android 11; wv) AppleWebKit/537.36 Version/4.0 Chrome/99.0 Mobile Safari/537.36 Instagram 200.0",
    "Mozilla/5.0 (Linux; Android 10; K; wv) AppleWebKit/537.36 Chrome/110.0 Mobile Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:120.0) Gecko/20100101 Firefox/120.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 Version/17.0 Safari/605.1.15",
    "Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) AppleWebKit/605.1.15 Version/16.6 Safari/604.1",
    "TikTok 26.2.0 rv:262018 (iPad; iOS 15.5; en_US)",
    "curl/8.0",
]


def agent_of(selector: Column) -> Column:
    """User agent by number; null for one number more than the list has."""
    n = selector % (len(USER_AGENTS) + 1)
    return _pick(n, USER_AGENTS)
