"""Text, time, JSON, bins and rules on literal rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.scalars import APPLICATION
from tidemark.functions import jsonfn, scalar, text, timefn
from tidemark.operators import cleaning
from tidemark.sources import tables
from tidemark.sources.synthetic import USER_AGENTS


def one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


def test_user_agents(spark):
    rows = spark.createDataFrame([(n, u) for n, u in enumerate([*USER_AGENTS, None])], "n int, ua string")
    got = {r.n: r for r in rows.withColumns(text.user_agent_columns(F.col("ua"))).collect()}
    assert (got[0].device_type, got[0].os_family, got[0].traffic_source) == ("Mobile", "iOS", "Safari")
    assert (got[0].ios_device_age_proxy, got[0].iphone_wealth_tier) == ("Modern_iOS", "Not_Detected")
    assert (got[1].traffic_source, got[1].ios_device_age_proxy) == ("Facebook_App", "Old_Legacy_iOS")
    assert [got[n].iphone_wealth_tier for n in (1, 2, 3)] == ["Older_Budget_iPhone", "Mid_Tier_iPhone", "Premium_New_iPhone"]
    assert got[4].device_type == "Tablet" and got[5].traffic_source == "Samsung_Internet"
    assert got[6].traffic_source == "Instagram_App" and got[7].traffic_source == "Generic_InApp"
    assert got[8].traffic_source == "Edge" and got[9].device_browser_combo == "Desktop_Firefox"
    assert got[10].os_source_combo == "Mac_Safari" and got[11].device_type == "Tablet"
    assert got[14].device_type == "Unknown_Device" and got[14].ios_device_age_proxy == "Not_iOS"


def test_keywords(spark):
    assert one(spark, "JPMorgan CHASE", "string", lambda c: text.keyword_class(c, text.BANK_CLASSES)) == "chase"
    assert one(spark, "Part time, full benefits", "string", lambda c: text.keyword_class(c, text.EMPLOYMENT_CLASSES)) == "full_time"
    assert one(spark, None, "string", lambda c: text.keyword_class(c, text.BANK_CLASSES)) == "others"
    flags = text.EMPLOYER_FLAGS
    assert one(spark, "IRS", "string", lambda c: text.pattern_flag(c, flags["is_toxic_employer_tier"])) == 1
    assert one(spark, "firs", "string", lambda c: text.pattern_flag(c, flags["is_toxic_employer_tier"])) == 0
    assert one(spark, None, "string", lambda c: text.pattern_flag(c, flags["is_employer_usps"])) == 0
    assert one(spark, "ny-x", "string", text.state_code) == "NY" and one(spark, "zz", "string", text.state_code) == "others"
    assert one(spark, "abc", "string", lambda c: text.extract(c, r"(\d+)")) is None
    assert one(spark, " n/a ", "string", text.clean_string) is None


LA = {  # wall time at home -> wall time in New York
    datetime(2024, 3, 10, 1, 59): datetime(2024, 3, 10, 5, 59),
    datetime(2024, 3, 10, 2, 0): datetime(2024, 3, 10, 6, 0),
    datetime(2024, 3, 10, 2, 30): datetime(2024, 3, 10, 6, 0),
    datetime(2024, 3, 10, 3, 0): datetime(2024, 3, 10, 6, 0),
    datetime(2024, 11, 3, 1, 30): datetime(2024, 11, 3, 3, 30),
    datetime(2024, 11, 3, 2, 30): datetime(2024, 11, 3, 5, 30),
    datetime(2024, 7, 1, 23, 0): datetime(2024, 7, 2, 2, 0),
}


def test_local_time_over_dst(spark):
    rows = spark.createDataFrame([(k,) for k in LA], "t timestamp_ntz")
    got = rows.select("t", timefn.local_time(F.col("t"), F.lit("America/New_York")).alias("l")).collect()
    assert {r.t: r.l for r in got} == LA


def test_zones(spark):
    assert one(spark, "az", "string", timefn.zone_of_state) == "America/Phoenix"
    assert one(spark, "others", "string", timefn.zone_of_state) == "America/Los_Angeles"


def test_holidays(spark):
    days = timefn.date_range(spark, F.lit("2020-12-25").cast("date"), F.lit("2022-12-31").cast("date"))
    got = {r.holiday_date: r.holiday_name for r in timefn.us_holidays(days).collect()}
    assert got[date(2021, 11, 25)] == "Thanksgiving Day" and got[date(2021, 5, 31)] == "Memorial Day"
    assert got[date(2021, 12, 31)] == "New Year's Day (observed)" and got[date(2021, 7, 5)] == "Independence Day (observed)"
    assert got[date(2021, 6, 19)].startswith("Juneteenth") and date(2020, 6, 19) not in got


def test_business_hours_asymmetry(spark):
    row = spark.createDataFrame([(date(2024, 1, 1), 1080)], "d date, m int")
    past, plan = (timefn.in_business_hours(F.col("d"), F.col("m"), e).alias(n) for e, n in ((True, "p"), (False, "f")))
    assert tuple(row.select(past, plan).first()) == (True, False)


def test_ratios(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(scalar.div0(F.col("a"), F.col("b"))).collect()] == [0.0, None, None, 1.5]
    assert [r[0] for r in df.select(scalar.null_safe_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, None, 1.5]


def test_bins(spark):
    ages = [29, 30, 35, 40, 59, 60, 61]
    df = spark.createDataFrame([(a,) for a in ages], "a int")
    strict = [r[0] for r in df.select(scalar.open_bins(F.col("a"), scalar.AGE_BOUNDS)).collect()]
    assert strict == ["30 and under", "60+", "30-40", "60+", "50-60", "60+", "60+"]
    closed = [r[0] for r in df.select(scalar.open_bins(F.col("a"), scalar.AGE_BOUNDS, strict_gaps=False)).collect()]
    assert closed == ["30 and under", "30-40", "30-40", "40-50", "50-60", "60+", "60+"]
    assert [one(spark, v, "double", scalar.confidence_tier) for v in (0.0, 10.0, 10.1, 100.0)] == [None, "Very Low", "Low", "Very High"]


def test_processor_without_dash(spark):
    assert one(spark, "plain", "string", scalar.processor_type) == "Others"
    assert one(spark, None, "string", scalar.processor_type) == "Others"


def test_camel_to_snake():
    assert jsonfn.camel_to_snake("leadIPAddress") == "lead_ip_address"


def test_json(spark):
    rows = spark.createDataFrame(
        [(1, '{"leadAmount": 5.5, "whenAt": "2024-01-02 03:04:05"}', "old"), (2, "{bad", "old"), (3, None, "old")],
        "id int, j string, lead_amount string",
    )
    schema = T.StructType([T.StructField("leadAmount", T.DoubleType()), T.StructField("whenAt", T.StringType())])
    got = jsonfn.json_expand(rows, "j", schema, dates=("when_at",)).orderBy("id").collect()
    assert [r.lead_amount for r in got] == [5.5, None, None]
    assert [r.when_at is not None for r in got] == [True, False, False]


def test_applicants(spark):
    text_ = (
        '{"leaseApplication": {"applicants": [{"firstName": "ANN", "addresses": [{"ownershipType": "Own"}, {"ownershipType": "RENT"}]},'
        ' {"firstName": "Bo"}], "property": {"zipCode": "A1"}, "expenses": {"rent": 3.0}}}'
    )
    rows = spark.createDataFrame([(1, text_), (2, '{"leaseApplication": {"property": {"zipCode": "B2"}}}'), (3, "x")], "id int, raw string")
    got = sorted(tuple(r) for r in jsonfn.json_explode_applicants(rows, "raw", APPLICATION).fillna("-").collect())
    assert got == [(1, "ann", "rent", "a1", 3.0), (1, "bo", "-", "a1", 3.0), (2, "-", "-", "b2", None), (3, "-", "-", "-", None)]


GOOD = {
    "accountABA": "1", "accountLength": "2", "accountNumber": "123456", "accountType": "checking", "amount": "500", "bankName": "b",
    "company": "c", "dob": "1980-01-31", "domain": "d", "driverLicense": "X123", "driverState": "CA", "email": "a.b@example.com",
    "firstName": "f", "homePhone": "5551234567", "income": "4000", "ipAddress": "i", "jobTitle": "j", "lastName": "l", "locality": "x",
    "payDate": "2024-01-12", "payDateNext": "2024-01-26", "postalCode": "p", "region": "r", "SSN": "s", "streetAddress": "a",
    "timeAddress": "3", "userAgent": "u", "workPhone": "w",
}


@pytest.mark.parametrize(
    "change, reasons",
    [
        ({}, ""),
        ({"firstName": " "}, "firstName: Cannot be empty"),
        ({"income": None}, "income: Cannot be empty"),
        ({"amount": "0"}, "amount: Must be > 0"),
        ({"amount": "lots"}, "amount: Invalid numeric value"),
        ({"accountNumber": "123"}, "accountNumber: Length not 4-30"),
        ({"driverLicense": "1"}, "driverLicense: Length not 3-30"),
        ({"homePhone": "155"}, "homePhone: Length != 10 | homePhone: Invalid Area Code"),
        ({"email": "nobody"}, "email: Invalid format"),
        ({"accountType": "Choose one"}, "accountType: Please choose an option"),
        ({"dob": "31/01/1980"}, "dob: Invalid format (must be yyyy-mm-dd)"),
        ({"dob": "2010-01-01"}, "dob: Under 18"),
        ({"payDate": "2024-01-13"}, "payDate: Cannot be weekend"),
        ({"payDate": "2024-03-01"}, "payDate: Not 0-40 days in future"),
        ({"payDate": "soon"}, "payDate: Invalid format (must be yyyy-mm-dd)"),
        ({"payDateNext": "2024-04-01"}, "payDateNext: >= 71 days in future"),
    ],
)
def test_lead_rules(spark, change, reasons):
    form = {**GOOD, **change}
    schema = T.StructType([T.StructField(c, T.StringType()) for c in form])
    row = spark.createDataFrame([tuple(form.values())], schema).withColumn("request_datetime", F.lit("2024-01-08 10:00:00").cast("timestamp"))
    got = cleaning.lead_validation(row).first()
    assert (got.invalid_reasons, got.is_invalid_leads) == (reasons, int(reasons != ""))


def test_rule_count(spark):
    columns = list(GOOD)
    row = spark.createDataFrame([tuple(GOOD.values())], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    rules = cleaning.lead_rules(row.columns, F.current_timestamp())
    assert len(rules) == 27 + 8 + 6 + 6


def test_detect_numeric_threshold(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "c string")
    assert cleaning.detect_numeric(df, ["c"], 0.70).first().kind == "categorical"
    assert cleaning.detect_numeric(df, ["c"], 0.60).first().kind == "numeric"


def test_rare_pool_replays_and_drops_collapsed(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",), (None,)], "c string")
    got = sorted(r.c or "" for r in cleaning.rare_pool(df, ["c"], 2).collect())
    assert got == ["", cleaning.RARE] + ["a"] * 5
    keep = cleaning.kept_levels(cleaning.level_counts(df, ["c"]), 2)
    new = spark.createDataFrame([("z",), ("a",)], "c string")
    assert sorted(r.c for r in cleaning.rare_pool(new, ["c"], keep=keep).collect()) == [cleaning.RARE, "a"]
    assert cleaning.drop_constant_columns(spark.createDataFrame([(1, 2), (1, 3)], "x int, y int"), ["x", "y"]).columns == ["y"]


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("1", 2.5)], "a string, b double")
    schema = T.StructType([T.StructField("b", T.DoubleType()), T.StructField("a", T.LongType())])
    path = str(tmp_path / "t")
    for _ in range(2):
        tables.append_or_replace(rows, path, schema, "replace", "2024-01-01")
    tables.append_or_replace(rows, path, schema, "replace", "2024-01-02")
    tables.append_or_replace(rows, path, schema, "append", "2024-01-02")
    assert spark.read.parquet(path).groupBy("run_date").count().orderBy("run_date").toPandas()["count"].tolist() == [1, 2]
    with pytest.raises(KeyError):
        tables.append_or_replace(rows.drop("b"), path, schema)
    with pytest.raises(ValueError):
        tables.append_or_replace(rows, path, schema, "upsert")
    tables.save_spec(spark, {"threshold": 0.05}, str(tmp_path / "spec"))
    assert tables.load_spec(spark, str(tmp_path / "spec")) == {"threshold": 0.05}
    assert tables.normalise_columns(spark.createDataFrame([(1,)], ["STRING(Brand-Id)"])).columns == ["brand_id"]
    assert tables.column_set_diff(rows, ["a", "c"]) == (["c"], ["b"])
    assert tables.optional_filter(rows, "a", "2").count() == 0 and tables.optional_filter(rows, "a").count() == 1
    stamp = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    assert spark.range(1).select(tables.stamp_run(stamp, "America/Los_Angeles")).first()[0] == "2024-01-01 02:00:00.000000"
