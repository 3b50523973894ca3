"""Date and time attributes of the conversion report against a plain version."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(12)
    out = []
    for n in range(600):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=random.randrange(90 * 86_400))
        text = "junk" if n % 10 == 0 else None if n % 37 == 0 else at.strftime("%Y-%m-%d %H:%M:%S")
        out.append((at, at.date(), text, str(n % 40) if n % 9 else "?", random.choice("ab"), int(random.random() < 0.3), random.choice([1, 2])))
    return spark.createDataFrame(out, "at timestamp_ntz, day date, text string, number string, kind string, y int, partner int").cache()


def test_kinds_are_found_from_the_values(rows):
    frame = rows.withColumns({"none": F.lit(None).cast("string"), "mixed": F.when(F.col("y") == 1, "2024-01-02").otherwise("x")})
    got = ev.attribute_kinds(frame, ["at", "day", "text", "number", "kind", "none", "mixed"])
    assert got == {"at": "datetime", "day": "datetime", "text": "datetime", "number": "numeric", "kind": "categorical", "mixed": "categorical"}


def test_instants_fall_into_equal_shares_named_by_days(rows):
    got = {}
    for r in ev.attributes_report(rows, ["at", "day", "text", "number", "kind"], "y", F.col("partner") == 1, bins=6).collect():
        got.setdefault((r.attribute, r.type), {})[r.bucket] = (r.n, r.m0, r.partner_m0)
    table = rows.toPandas()
    for column in ("at", "day", "text"):
        instant = pd.to_datetime(table[column], errors="coerce")
        us = instant.astype("int64").where(instant.notna()) // (1000 if instant.dtype == "datetime64[ns]" else 1)
        edges = sorted(set(us.dropna().quantile([k / 6 for k in range(7)])))
        want = {}
        for v, y, p in zip(us, table.y, table.partner):
            if pd.isna(v):
                name = "(Missing)"
            else:
                b = max(sum(e < v for e in edges), 1)
                name = " - ".join(str(dt.date(1970, 1, 1) + dt.timedelta(days=int(e // 86_400_000_000))) for e in edges[b - 1 : b + 1])
            n, m, q = want.get(name, (0, 0, 0))
            want[name] = (n + 1, m + y, q + y * (p == 1))
        assert got[column, "datetime"] == want
    assert got["number", "numeric"]["(Missing)"][0] == sum(table.number == "?") and set(got["kind", "categorical"]) == {"a", "b"}


def test_days_do_not_depend_on_the_time_zone(spark, rows):
    before = spark.conf.get("spark.sql.session.timeZone")
    names = set()
    try:
        for zone in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            report = ev.attributes_report(rows, ["at", "text"], "y", F.lit(False)).collect()
            names.add(tuple(sorted((r.attribute, r.bucket, r.n) for r in report)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert len(names) == 1
