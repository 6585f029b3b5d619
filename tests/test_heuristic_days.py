"""Daily ranking: days worked out in one task each against the joins over all days."""

import random

import pytest

from tidegraph.operators import daily, report
from tidegraph.plans.storage import stored

DAY = 86400


@pytest.fixture(scope="module")
def days(spark):
    r = random.Random(5)
    # few and many nodes by turns, so that lists of negatives are walked, full or cut; days without data between
    rows = [(r.randint(0, m), r.randint(0, m), DAY * (2 * d) + r.randint(0, 999), 10**7) for d in range(34) for m in [(4, 12, 60)[d % 3]] for _ in range((12, 60, 40)[d % 3])]
    df = spark.createDataFrame([(a, b, t, s, s / 1e8, s / 1e4) for a, b, t, s in rows if a != b], "src_idx long, dst_idx long, timestamp long, sat long, btc double, usd double")
    return stored(report.daily(df))


@pytest.mark.parametrize("ties, n", [("best", 6), ("mean", 20)])
def test_days_in_tasks_are_those_of_joins(days, monkeypatch, ties, n):
    monkeypatch.setattr(daily, "RANKED_DAYS", 5)
    of = lambda day_pairs: sorted(daily.heuristic_days(days, window=2, n=n, ties=ties, day_pairs=day_pairs).collect())
    joins = of(0)
    assert len(joins) >= 100 and of(10**6) == joins and of(110) == joins


def test_days_in_tasks_take_no_joins_of_candidates(days, monkeypatch):
    """The plan of before met all days' candidates in joins, which the driver's memory didn't hold at size."""
    monkeypatch.setattr(daily, "negatives", None)
    assert daily.heuristic_days(days, window=2, n=4).count() >= 100
