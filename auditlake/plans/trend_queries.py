"""Agreement of a judge with the human labels of documents, and the trend of failing events."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import trends
from auditlake.plans import inputs as src


def judge_agreement(spark, sf):
    """A judge that fails texts with runs of signs against people's labels, a check for each language."""
    docs, labels = src.table(spark, sf, "documents"), src.table(spark, sf, "labels")
    verdicts = docs.select(F.col("lang").alias("check_id"), "doc_id", (~F.rlike("text", F.lit("[$&*%#!]{2,}"))).alias("passed"))
    people = docs.select("doc_id", F.col("lang").alias("check_id")).join(labels, "doc_id")
    reviews = people.select("check_id", "doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"))
    return trends.judge_agreement(verdicts, reviews, ["check_id", "doc_id"])


JUDGE_AGREEMENT = """WITH p AS (SELECT lang AS check_id, NOT regexp_matches(text, '[$&*%#!]{2,}') AS judge, quality = 1 AND toxic = 0 AS person
  FROM documents JOIN labels USING (doc_id)),
t AS (SELECT check_id, count(*) AS items, count(*) FILTER (judge AND person) AS both_passed, count(*) FILTER (NOT judge AND NOT person) AS both_failed,
  count(*) FILTER (judge AND NOT person) AS missed_failures, count(*) FILTER (NOT judge AND person) AS false_alarms FROM p GROUP BY ALL),
c AS (SELECT *, (both_passed + both_failed)::DOUBLE / items AS agreement,
  coalesce(missed_failures::DOUBLE / nullif(missed_failures + both_failed, 0), 0) AS missed_failure_rate,
  ((both_passed + missed_failures) * (both_passed + false_alarms)
    + (items - both_passed - missed_failures) * (items - both_passed - false_alarms))::DOUBLE / (items * items) AS chance FROM t)
SELECT * EXCLUDE (chance), (agreement - chance) / nullif(1.0::DOUBLE - chance, 0) AS kappa FROM c"""


def failure_trend(spark, sf):
    """Events as checks, errors failing, a run for each user; days without any stay in the series."""
    e = src.table(spark, sf, "events")
    results = e.select(F.concat(F.lit("run_"), F.col("user_id")).alias("run_id"), "ts", (F.col("event_type") != "error").alias("passed"))
    return trends.failure_trend(results, "ts").withColumn("day", F.col("day").cast("string"))


FAILURE_TREND = """WITH d AS (SELECT 'run_' || user_id AS run_id, ts::DATE AS day, count(*) AS checks, count(*) FILTER (event_type = 'error') AS failures
  FROM events GROUP BY ALL),
s AS (SELECT run_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY run_id),
f AS (SELECT run_id, day, coalesce(checks, 0) AS checks, coalesce(failures, 0) AS failures FROM s LEFT JOIN d USING (run_id, day))
SELECT run_id, strftime(day, '%Y-%m-%d') AS day, checks, failures, coalesce(failures::DOUBLE / nullif(checks, 0), 0) AS failure_rate,
  coalesce((sum(failures) OVER w)::DOUBLE / nullif(sum(checks) OVER w, 0), 0) AS rate_over_days
FROM f WINDOW w AS (PARTITION BY run_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""


QUERIES = {
    "judge_agreement": (judge_agreement, JUDGE_AGREEMENT),
    "failure_trend": (failure_trend, FAILURE_TREND),
}
