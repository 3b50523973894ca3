"""Logical inputs (attempts, leads, calls ...) mapped onto the tables at hand.

Each view is a projection of one table (or one key join) in expressions that Spark and
other SQL engines read alike; ``{KEY}`` and ``{LEADTS}`` stand for the two that differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_TOKENS = {
    "KEY": "CAST(get_json_object(props, '$.k') AS INT)",
    "LEADTS": "o_orderdate + make_dt_interval(0, 0, 0, (o_orderkey * 7919) % 86400)",
}


@dataclass(frozen=True)
class View:
    source: str
    columns: dict[str, str]
    where: str | None = None
    first: dict[str, str] | None = None  # columns the others are built from, computed once
    filtered: bool = False  # columns built from them are filtered on
    join: tuple[str, str] | None = None  # (other table, equality condition)


_K = "k"
_KEY = {"k": "{KEY}"}
_WEEK = "CAST(floor((dayofyear(ts) - 1) / 7) AS BIGINT)"

VIEWS: dict[str, View] = {
    "attempt": View(
        "events",
        {
            "transaction_id": "event_id",
            "order_id": "user_id",
            "invoice_id": f"user_id * 100 + {_WEEK}",
            "invoice_sequence": _WEEK,
            "transaction_datetime": "ts",
            "order_date": "CAST(ts AS DATE)",
            "transaction_status": "CASE WHEN event_type = 'purchase' THEN 'accepted' ELSE 'declined' END",
            "retries": f"CASE WHEN {_K} = 13 THEN NULL WHEN {_K} = 99 THEN 31 ELSE {_K} % 8 END",
            "offer_amount": "value + 10",
            "transaction_amount": "value",
            "decline_code": "event_type",
            "invoice_type": f"CASE WHEN {_WEEK} = 0 THEN 'trial_invoice' ELSE 'renewal_invoice' END",
            "transaction_type": f"CASE WHEN {_K} % 10 = 9 THEN 'refund' WHEN {_K} % 2 = 0 THEN 'sale' ELSE 'capture' END",
            "membership_status": f"CASE WHEN {_K} = 24 THEN 'cancelled' WHEN {_K} = 25 THEN 'expired' ELSE 'active' END",
            "vertical_type": "'credco'",
            "vertical_type_bin": f"concat('V', CAST({_K} % 6 AS STRING))",
            "super_partner_id_name": f"concat('P', CAST({_K} % 7 AS STRING))",
            "processor_name_original": f"CASE {_K} % 4 WHEN 0 THEN 'x-TRX1' WHEN 1 THEN 'y-ADYEN2' WHEN 2 THEN 'z-OTHER' ELSE 'plain' END",
            "bank": f"CASE WHEN {_K} % 11 = 10 THEN NULL ELSE concat('B', CAST({_K} % 11 AS STRING)) END",
            "card_type": f"CASE {_K} % 3 WHEN 0 THEN 'Visa' WHEN 1 THEN 'Mastercard' ELSE NULL END",
            "billing_state": "CASE user_id % 6 WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' WHEN 2 THEN 'TX' WHEN 3 THEN 'AZ' WHEN 4 THEN 'ca-x' ELSE NULL END",
            "payment_frequency": f"CASE {_K} % 2 WHEN 0 THEN 'monthly' ELSE 'weekly' END",
            "is_sale": f"CASE WHEN {_K} % 10 = 9 THEN 0 ELSE 1 END",
            "is_m0": f"CASE WHEN event_type = 'signup' AND {_K} < 5 THEN 1 ELSE 0 END",
            "within_360": f"{_K} < 90",
            "success_probability": f"round(CAST({_K} AS DOUBLE) / 250.0, 4)",
        },
        first=_KEY,
        filtered=True,
    ),
    "bin_tier": View(
        "region",
        {
            "vertical_type_bin": "concat('V', CAST(r_regionkey AS STRING))",
            "bin_tier": "CASE WHEN r_regionkey = 4 THEN 'Blacklist' ELSE concat('Tier', CAST(r_regionkey + 1 AS STRING)) END",
        },
    ),
    "order_cltv": View(
        "customer",
        {
            "order_id": "c_custkey",
            "cltv_360": "round(abs(c_acctbal) / 100, 2)",
            "ecltv_1y": "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE round(abs(c_acctbal) / 250, 2) END",
        },
        where="c_acctbal >= 0",
    ),
    "ecltv": View("orders", {"order_id": "o_custkey", "cltv_pred_mean": "round(o_totalprice / 20000, 2)"}),
    "order_item": View(
        "lineitem",
        {
            "order_id": "l_orderkey",
            "transaction_id": "l_orderkey * 10 + l_linenumber",
            "part_id": "l_partkey",
            "supp_id": "l_suppkey",
            "transaction_date": "CAST(l_shipdate AS DATE)",
            "transaction_amount": "l_extendedprice",
            "quantity": "l_quantity",
            "discount": "l_discount",
            "cascade_type": "CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_discount > 0.08 THEN 'blacklist' ELSE 'CasD' END",
            "label": "CASE WHEN l_returnflag = 'R' AND l_quantity > 48 THEN 1 ELSE 0 END",
            "bank": "o_orderpriority",
            "customer_id": "o_custkey",
            "order_date": "CAST(o_orderdate AS DATE)",
            "order_status": "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'new_order' END",
            "is_m0": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
        },
        join=("orders", "l_orderkey = o_orderkey"),
    ),
    "daily_call": View(
        "orders",
        {
            "call_id": "o_orderkey",
            "call_date": "CAST(o_orderdate AS DATE)",
            "customer_id": "o_custkey",
            "call_type": "o_orderpriority",
        },
    ),
    "customer_sales": View(
        "customer",
        {"customer_id": "c_custkey", "vertical_type_bin": "concat(c_mktsegment, '_', CAST(c_nationkey AS STRING))"},
    ),
    "call_log": View("events", {"call_id": "event_id", "call_start_at": "ts", "customer_id": "user_id", "line": "event_type"}),
    "lead": View(
        "orders",
        {
            "jluvr": "o_orderkey",
            "request_datetime": "{LEADTS}",
            "seller_name": "o_orderpriority",
            "label": "CASE WHEN o_orderstatus = 'F' THEN 'm0' ELSE 'unknown' END",
            "order_status": "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'new_order' END",
            "seller_minimum_price": "round(o_totalprice / 250000, 2)",
            "person_id": "o_custkey",
            "loan_amount": "o_totalprice",
            "is_m0": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
        },
    ),
    "trade_line": View(
        "lineitem",
        {
            "person_id": "o_custkey",
            "account_open_date": "CAST(l_shipdate AS DATE)",
            "account_current_status": "CASE WHEN l_linestatus = 'O' THEN 'Open' ELSE 'Closed' END",
            "account_type": "CASE l_returnflag WHEN 'A' THEN 'Revolving' WHEN 'N' THEN 'Installment' ELSE 'Mortgage' END",
            "account_status": "CASE WHEN l_discount >= 0.09 THEN 'Derogatory' WHEN l_discount <= 0.01 THEN 'Paid' WHEN l_discount <= 0.02 THEN 'Refinanced' ELSE 'Current' END",
            "payment_status": "CASE WHEN l_tax > 0.06 THEN 'Late' ELSE 'Current' END",
            "open_account_type": "CASE l_linenumber WHEN 1 THEN 'Unsecured loan' WHEN 2 THEN 'Secured loan' WHEN 3 THEN 'Educational' WHEN 4 THEN 'Credit Card' ELSE 'Charge account' END",
            "creditor_category": "CASE WHEN l_quantity > 40 THEN 'BNPL_Fintech_Advance' WHEN l_quantity > 30 THEN 'Personal_Installment_Payday_Loan' ELSE 'Other' END",
            "high_balance": "l_extendedprice",
            "credit_limit": "l_extendedprice",
            "current_balance": "l_quantity * 100",
            "monthly_payment": "l_quantity",
            "month_reviewed": "l_linenumber",
            "late_30_count": "CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END",
            "late_60_count": "CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END",
            "late_90_count": "CASE WHEN l_tax > 0.075 THEN 1 ELSE 0 END",
            "amount_past_due": "CASE WHEN l_tax > 0.06 THEN l_quantity ELSE 0 END",
        },
        join=("orders", "l_orderkey = o_orderkey"),
    ),
    "credit_inquiry": View(
        "orders",
        {
            "person_id": "o_custkey",
            "inquiry_date": "CAST(o_orderdate AS DATE)",
            "industry_code": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Bank' WHEN '2-HIGH' THEN 'Finance/Personal' ELSE 'Other' END",
        },
    ),
    "public_record": View(
        "orders",
        {
            "person_id": "o_custkey",
            "public_record_date": "CAST(o_orderdate AS DATE)",
            "status": "CASE WHEN o_orderstatus = 'F' THEN 'Discharged' ELSE 'Filed' END",
            "classification": "CASE WHEN o_totalprice > 250000 THEN 'Bankruptcy' ELSE 'Lien' END",
        },
    ),
    "credit_response": View(
        "customer",
        {
            "person_id": "c_custkey",
            "risk_score": "CASE WHEN c_acctbal < 0 THEN 4 ELSE 300 + c_acctbal / 20 END",
            "birth_year": "1950 + c_nationkey * 2",
            "employer": "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Wal-Mart Stores' WHEN 'BUILDING' THEN 'Self Employed' WHEN 'AUTOMOBILE' THEN 'DoorDash' WHEN 'FURNITURE' THEN 'SSI benefits' ELSE 'Taco Bell' END",
            "negative_factor_1": "CASE WHEN c_nationkey = 12 THEN '12' ELSE '07' END",
            "negative_factor_2": "CASE WHEN c_mktsegment = 'BUILDING' THEN '12' ELSE NULL END",
            "negative_factor_3": "CASE WHEN c_acctbal > 5000 THEN '63' ELSE NULL END",
            "negative_factor_4": "CAST(NULL AS STRING)",
        },
    ),
    "ping": View(
        "events",
        {
            "ping_id": "event_id",
            "jluvr": "user_id",
            "request_datetime": "ts",
            "raw_request_json": "props",
            "accepted": "CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END",
            "response_type": "CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'purchase' THEN 'ACCEPTED' ELSE 'REJECTED' END",
        },
    ),
    "scored": View(
        "events",
        {
            "row_id": "event_id",
            "order_id": "user_id",
            "event_ts": "ts",
            "segment": "event_type",
            "amount": "value",
            "bank": f"CAST({_K} % 5 AS STRING)",
            "label": "CASE WHEN value > 45 THEN 1 ELSE 0 END",
            "score": f"round((CAST({_K} AS DOUBLE) + CASE WHEN value > 45 THEN 30 ELSE 0 END) / 130.0, 4)",
        },
        first=_KEY,
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fill(text: str, tokens: dict[str, str]) -> str:
    for token, value in tokens.items():
        text = text.replace("{" + token + "}", value)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spec = VIEWS[name]
    df = table(spark, sf_dir, spec.source)
    if spec.join:
        other, condition = spec.join
        df = df.join(table(spark, sf_dir, other), F.expr(condition))
    if spec.where:
        df = df.filter(spec.where)
    if spec.first:
        first = {c: F.expr(_fill(e, SPARK_TOKENS)) for c, e in spec.first.items()}
        # Filters are not pushed below a generated row, where each mention of a column would compute it again.
        df = df.select("*", F.inline(F.array(F.struct(*[e.alias(c) for c, e in first.items()])))) if spec.filtered else df.withColumns(first)
    return df.selectExpr(*[f"{_fill(e, SPARK_TOKENS)} AS {c}" for c, e in spec.columns.items()])


def view_sql(name: str, tokens: dict[str, str]) -> str:
    """The same view as text for another engine."""
    spec = VIEWS[name]
    columns = ", ".join(f"{_fill(e, tokens)} AS {c}" for c, e in spec.columns.items())
    source = spec.source
    if spec.first:
        source = "(SELECT *, " + ", ".join(f"{_fill(e, tokens)} AS {c}" for c, e in spec.first.items()) + f" FROM {source})"
    text = f"SELECT {columns} FROM {source}"
    if spec.join:
        text += f" JOIN {spec.join[0]} ON {spec.join[1]}"
    if spec.where:
        text += f" WHERE {spec.where}"
    return text
