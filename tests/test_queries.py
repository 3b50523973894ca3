"""Every registered query against its check SQL; flagship and ordered queries also with blocks."""

import pytest

import __spark_entry__ as registry
import check
from tests.conftest import DATA

CHECKED = list(registry.oracle_sql())
LARGER = DATA.replace("sf0.001", "sf0.01")
BLOCKED = [
    "lag1", "cum_before", "gaps_islands_streak", "rolling_rate_8d", "rolling_closed_left_global", "attempts_remaining",
    "row_position_split", "stratified_split", "segment_auc", "max_f1_threshold", "capture_at_rates", "percentile_rank_pct",
    "attempt_features", "ablation", "describe",
]


@pytest.fixture(scope="module")
def con():
    return check.connect(DATA)


@pytest.mark.parametrize("key", CHECKED)
def test_matches_check(spark, con, key):
    message = check.compare(spark, con, key, DATA)
    if message == "EMPTY":  # no rows at this scale: an empty match proves nothing
        message = check.compare(spark, check.connect(LARGER), key, LARGER)
    assert message == "", message


@pytest.mark.parametrize("key", BLOCKED)
def test_matches_check_in_blocks(spark, con, hot, key):
    assert check.compare(spark, con, key, DATA) == ""


def test_registry_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as r; assert set(r.oracle_sql()) <= set(r.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=check.os.path.dirname(check.os.path.abspath(check.__file__)))


def test_entry(spark):
    df = registry.entry(spark)
    assert "historical_collected_amount" in df.columns and df.count() > 0
