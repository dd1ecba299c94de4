"""How far the judge agrees with people, and how failures go from day to day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.metrics import ratio


def judge_agreement(verdicts: DataFrame, reviews: DataFrame, keys: Sequence[str], by: str = "check_id") -> DataFrame:
    """Judge verdicts against human reviews of the same items, one row per check.

    Both have the ``keys``, one of which is ``by``, and ``passed``; the last of several reviews counts where the table has
    ``reviewed_at``, else an item must be reviewed once. Only items with a verdict and a review count; null flags
    are no verdict. ``missed_failures`` passed the judge but not the person, ``false_alarms`` the other way round.
    Kappa is null where both always say the same of every item, since chance explains that.
    """
    keys = list(keys)
    given = reviews.filter(F.col("passed").isNotNull())
    if "reviewed_at" in reviews.columns:
        given = given.groupBy(*keys).agg(F.max_by("passed", F.struct("reviewed_at", "passed")).alias("passed"))
    pairs = (
        verdicts.filter(F.col("passed").isNotNull())
        .select(*keys, F.col("passed").alias("judge"))
        .join(given.select(*keys, F.col("passed").alias("person")), keys)
    )
    judge, person = F.col("judge"), F.col("person")
    table = pairs.groupBy(by).agg(
        F.count("*").alias("items"),
        F.count_if(judge & person).alias("both_passed"),
        F.count_if(~judge & ~person).alias("both_failed"),
        F.count_if(judge & ~person).alias("missed_failures"),
        F.count_if(~judge & person).alias("false_alarms"),
    )
    c = F.col
    agreed = ratio(c("both_passed") + c("both_failed"), c("items"))
    judge_passed, person_passed = c("both_passed") + c("missed_failures"), c("both_passed") + c("false_alarms")
    by_chance = (judge_passed * person_passed + (c("items") - judge_passed) * (c("items") - person_passed)).cast("double") / (c("items") * c("items"))
    return (
        table.withColumn("agreement", agreed)
        .withColumn("missed_failure_rate", ratio(c("missed_failures"), c("missed_failures") + c("both_failed")))
        .withColumn("kappa", F.try_divide(agreed - by_chance, F.lit(1.0) - by_chance))
    )


def failure_trend(results: DataFrame, day: str, keys: Sequence[str] = ("run_id",), over: int = 7) -> DataFrame:
    """Checks, failures and failure rate of every day from the first to the last of each key, days without checks included.

    ``rate_over_days`` is the rate over the last ``over`` days, by counts, not the mean of daily rates. ``results`` has
    the keys, a date or time and ``passed``. Counted per day before anything is shuffled; then a key has a row a day.
    """
    keys = list(keys)
    daily = (
        results.filter(F.col(day).isNotNull())
        .groupBy(*keys, F.to_date(day).alias("day"))
        .agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failures"))
    )
    days = daily.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = days.select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    filled = days.join(daily, [*keys, "day"], "left").fillna(0, ["checks", "failures"])
    last = Window.partitionBy(*keys).orderBy("day").rowsBetween(1 - over, 0)
    return filled.select(
        *keys,
        "day",
        "checks",
        "failures",
        ratio(F.col("failures"), F.col("checks")).alias("failure_rate"),
        ratio(F.sum("failures").over(last), F.sum("checks").over(last)).alias("rate_over_days"),
    )
