"""Point-in-time features where ids are shared."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.plans.attempts import attempt_features

COLUMNS = """order_id long, invoice_id long, transaction_id long, transaction_datetime timestamp_ntz, retries int, transaction_status string,
transaction_type string, invoice_type string, membership_status string, order_date date, offer_amount double, transaction_amount double,
vertical_type_bin string, vertical_type string, super_partner_id_name string, processor_name_original string, bank string, card_type string,
billing_state string, payment_frequency string, decline_code string, invoice_sequence int"""


def attempt(order, invoice, txn, day, retries, status="declined", paid=10.1):
    at = dt.datetime(2024, 2, 1) + dt.timedelta(days=day)
    return (order, invoice, txn, at, retries, status, "sale", "regular", "active", dt.date(2024, 1, 5), 20.0, paid, "b", "v", "p", "x-TRX1", "k", "c", "s", "f", "05", 1)


def test_shared_invoice_ids_keep_every_live_invoice(spark):
    """Invoice 77 is live for order 1 and out of retries for order 2, which lives through 88."""
    rows = [
        attempt(1, 77, 1, 1, 0), attempt(1, 77, 2, 2, 1, paid=0.3), attempt(2, 77, 3, 1, 0, "accepted"), attempt(2, 77, 4, 7, 40),
        attempt(2, 88, 5, 3, 0, "accepted", 0.1), attempt(2, 88, 6, 6, 1), attempt(2, 88, 7, 6, 2),
    ]
    fact = spark.createDataFrame(rows, COLUMNS)
    tier = spark.createDataFrame([("b", "low")], "vertical_type_bin string, bin_tier string")
    out = attempt_features(fact, tier, F.lit("2024-02-10").cast("date"), F.lit("2024-01-01").cast("date")).collect()
    assert sorted((r.order_id, r.invoice_id, r.transaction_id) for r in out) == [(1, 77, 2), (2, 88, 7)]
    by_order = {r.order_id: r for r in out}
    assert by_order[2].historical_collected_amount == 10.2 and by_order[1].historical_collected_amount == 0.0
