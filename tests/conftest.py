import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from tablesense.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, "tests")
    yield session
    session.stop()


MONTHS = ["Feb-24", "Mar-24", "Apr-24", "May-24"]


def _survey():
    """Three stations over four months: 10, 20, 30 and one more each month; each station
    has its ceiling, so that 1, 3 and 3 of its months lie above."""
    rows = []
    for k, (code, label, county, ceiling) in enumerate([
            ("W-A", "mill well", "North", 12.5), ("W-B", "park well", "North", 20.5),
            ("W-C", "dock well", "South", 30.5)], 1):
        for m, month in enumerate(MONTHS):
            rate = 10.0 * k + m
            band = "Red" if rate > ceiling + 2 else "Amber" if rate > ceiling else "Green"
            rows.append((code, label, rate, rate - 1, ceiling, band, county, month))
    return rows


#: Two farms plant two crops in two seasons; a third sows once.
HARVESTS = [
    ("Birch", "rye", 400, 350, "No", "spring"), ("Birch", "oats", 300, 350, "No", "spring"),
    ("Birch", "rye", 500, 450, "Yes", "autumn"), ("Birch", "oats", 200, 250, "Yes", "autumn"),
    ("Heath", "rye", 150, 250, "No", "spring"), ("Heath", "oats", 250, 250, "No", "spring"),
    ("Heath", "rye", 350, 350, "Yes", "autumn"), ("Heath", "oats", 450, 450, "Yes", "autumn"),
    ("Shore", "beans", 120, 250, "No", "spring"),
]
#: A status of several words, and dates as text.
CHECKS = [
    (f"field {i}", i % 4, ("format", "range", "source")[i % 3],
     ("complete", "late amber", "missing red")[i % 3 if i % 4 else 0], f"2024-0{1 + i % 5}-11")
    for i in range(10)
]


@pytest.fixture(scope="session")
def survey(spark):
    return spark.createDataFrame(_survey(), (
        "STATION_CODE string, STATION_NAME string, ACTUAL_FLOW double, PRIOR_FLOW double, "
        "FLOW_THRESHOLD double, ALERT_BAND string, COUNTY string, SURVEY_PERIOD string"))


@pytest.fixture(scope="session")
def harvests(spark):
    return spark.createDataFrame(HARVESTS, (
        "FARM string, CROP string, TONS long, PLAN long, WATERED string, SEASON string"))


@pytest.fixture(scope="session")
def checks(spark):
    return spark.createDataFrame(CHECKS, (
        "FIELD string, MISSES long, ASPECT string, CHECK_STATUS string, CHECK_DATE string"))


@pytest.fixture(scope="session")
def survey_roles(survey):
    from tablesense.operators.roles import table_roles
    return table_roles(survey, source_id="wells")
