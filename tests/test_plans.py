"""What the physical plans must and must not hold."""

import contextlib
import io

import pytest

import __spark_entry__ as registry
from bench import HEADLINE


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(registry.queries()["filter_half_open"](spark, data))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    text = plan(registry.queries()["daily_counts"](spark, data))
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in text


@pytest.mark.parametrize("key", [k for k in HEADLINE if k != "univariate_auc_scan"])
def test_no_cross_join_and_no_python(spark, data, key):
    text = plan(registry.queries()[key](spark, data))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert operator not in text, operator


def test_blocked_scan_has_no_single_key_window(spark, data, hot):
    """The global order is cut into blocks: no window gathers all rows in one task."""
    text = plan(registry.queries()["cv_no_shuffle"](spark, data))
    windows = [line for line in text.splitlines() if line.strip().startswith("Arguments:") and "windowspecdefinition" in line]
    rows = [w for w in windows if "__block" in w]
    assert rows and all("__block" in w for w in windows)
