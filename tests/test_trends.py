"""Agreement with people and failures by day, against plain counts."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditlake.operators import trends


def test_agreement_by_plain_counts(spark):
    rng = random.Random(3)
    items = [(f"c{i % 3}", i, rng.choice([True, True, False]), rng.choice([True, False, None])) for i in range(300)]
    verdicts = spark.createDataFrame([r[:3] for r in items] + [("c0", 900, True), ("c0", 901, None)], "check_id string, item int, passed boolean")
    reviews = spark.createDataFrame([(c, i, p) for c, i, _, p in items] + [("c1", 902, True)], "check_id string, item int, passed boolean")
    for row in trends.judge_agreement(verdicts, reviews, ["check_id", "item"]).collect():
        own = [(j, p) for c, _, j, p in items if c == row.check_id and p is not None]
        n = len(own)
        counts = [sum(x == pair for x in own) for pair in ((True, True), (False, False), (True, False), (False, True))]
        assert [row.items, row.both_passed, row.both_failed, row.missed_failures, row.false_alarms] == [n, *counts]
        judged, reviewed = sum(j for j, _ in own) / n, sum(p for _, p in own) / n
        chance = judged * reviewed + (1 - judged) * (1 - reviewed)
        assert row.kappa == pytest.approx(((counts[0] + counts[1]) / n - chance) / (1 - chance))
        assert row.missed_failure_rate == pytest.approx(counts[2] / (counts[2] + counts[1]))


def test_agreement_without_choice_or_items(spark):
    same = spark.createDataFrame([("c", i, True) for i in range(4)], "check_id string, item int, passed boolean")
    row = trends.judge_agreement(same, same, ["check_id", "item"]).first()
    assert (row.agreement, row.kappa, row.missed_failure_rate) == (1.0, None, 0.0)
    assert trends.judge_agreement(same.limit(0), same, ["check_id", "item"]).count() == 0


def test_the_last_review_counts(spark):
    verdicts = spark.createDataFrame([("c", 1, True)], "check_id string, item int, passed boolean")
    reviews = spark.createDataFrame([("c", 1, True, 1), ("c", 1, False, 2), ("c", 1, None, 3)], "check_id string, item int, passed boolean, reviewed_at int")
    assert trends.judge_agreement(verdicts, reviews, ["check_id", "item"]).first().missed_failures == 1


def test_days_without_checks_are_in_the_trend(spark):
    start = datetime(2024, 2, 27, 23, 30)
    rows = [("r", start, False), ("r", start, True), ("r", start + timedelta(days=3), True), ("s", start, True), ("s", None, False)]
    got = trends.failure_trend(spark.createDataFrame(rows, "run_id string, at timestamp, passed boolean"), "at", over=2).orderBy("run_id", "day").collect()
    assert [(r.run_id, r.day, r.checks, r.failures, r.failure_rate, r.rate_over_days) for r in got] == [
        ("r", date(2024, 2, 27), 2, 1, 0.5, 0.5), ("r", date(2024, 2, 28), 0, 0, 0.0, 0.5), ("r", date(2024, 2, 29), 0, 0, 0.0, 0.0),
        ("r", date(2024, 3, 1), 1, 0, 0.0, 0.0), ("s", date(2024, 2, 27), 1, 0, 0.0, 0.0),
    ]


def test_trend_of_hot_and_empty_tables(spark):
    hot = spark.range(20_000).select(F.lit("r").alias("run_id"), F.timestamp_seconds(F.col("id") * 600).alias("at"), (F.col("id") % 4 > 0).alias("passed"))
    rows = trends.failure_trend(hot, "at").collect()
    assert sum(r.checks for r in rows) == 20_000 and {r.failure_rate for r in rows} == {0.25}
    assert trends.failure_trend(hot.limit(0), "at").count() == 0
