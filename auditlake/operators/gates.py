"""Release gates, budget audits and the configuration summary of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import round_half_even
from auditlake.operators.transcripts import MONEY


def gates(metrics: DataFrame, fail_under: float = 0.0, fail_under_weighted: float = 0.0) -> DataFrame:
    """One row per run and gate; a threshold of 0 never fails."""
    checks = F.array(
        *[
            F.struct(
                F.lit(gate).alias("gate"),
                # Gates compare the reported figure, which has four places.
                round_half_even(F.col(gate), 4).alias("value"),
                F.lit(float(threshold)).alias("threshold"),
            )
            for gate, threshold in (("pass_rate", fail_under), ("weighted_score", fail_under_weighted))
        ]
    )
    return (
        metrics.select("run_id", F.explode(checks).alias("g"))
        .select("run_id", "g.gate", F.coalesce("g.value", F.lit(0.0)).alias("value"), "g.threshold")
        .withColumn("ok", (F.col("threshold") == 0) | (F.col("value") >= F.col("threshold")))
    )


def running_total(
    rows: DataFrame, value: Column, order: Sequence[str], block: Column, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Add ``running``, the cumulative sum per key.

    ``block`` must not fall along ``order``. Sums per block are taken first, then each block is summed by
    itself and offset by the blocks before it, so that a key with most of the rows spreads over many tasks.
    """
    keys = list(keys)
    tagged = rows.withColumn("_value", value.cast(MONEY)).withColumn("_block", block)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast(MONEY)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # The in-block window and the join share one partitioning on (keys, block).
    return (
        tagged.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn("running", (F.col("_inside") + F.col("_offset")).cast("decimal(38,9)"))
        .drop("_value", "_block", "_inside", "_offset")
    )


def limit_breaches(
    attempts: DataFrame,
    value: str,
    cap: float,
    order: Sequence[str] = ("seq",),
    block: Column | None = None,
    keys: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Attempts whose own amount, or whose run's amount up to and with them, is above the cap; 0 disables.

    ``block`` defaults to 65536 consecutive numbers of the first order column.
    """
    block = F.floor(F.col(order[0]) / 65536) if block is None else block
    limit = F.lit(str(cap)).cast(MONEY)
    totals = running_total(attempts, F.col(value), order, block, keys)
    breach = (F.lit(cap) != 0) & ((F.col(value).cast(MONEY) > limit) | (F.col("running") > limit))
    return totals.withColumn("breach", breach)


def first_breach(breaches: DataFrame, order: Sequence[str] = ("seq",), keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """The first breaching attempt of each run that has one."""
    rest = [c for c in breaches.columns if c not in (*keys, *order, "breach")]
    return (
        breaches.filter("breach")
        .groupBy(*keys)
        .agg(F.min(F.struct(*order, *rest)).alias("first"))
        .select(*keys, "first.*")
    )


def effective_limit(requested: Column, configured: Column) -> Column:
    """A request may tighten the configured limit, never loosen it; a configured 0 means none."""
    return (
        F.when(requested.isNull(), configured).when(configured == 0, requested).otherwise(F.least(requested, configured))
    )


def run_configuration(
    selected: DataFrame,
    k: int = 1,
    max_cost_usd: float = 0.0,
    max_duration_seconds: float = 0.0,
    suite_version: str = "2026.1",
    prompt_version: str = "2026.1",
    tool_schema_version: str = "2026.1",
) -> DataFrame:
    """Configuration summary per run. ``selected``: run_id, file_name, scenario_id, tags."""
    ids = F.array_sort(F.collect_list(F.struct("file_name", "scenario_id")))
    # One pass over a run's scenarios. A null run has no tags.
    tags = F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_list("tags")))))
    return (
        selected.groupBy("run_id")
        .agg(F.transform(ids, lambda s: s["scenario_id"]).alias("scenario_ids"), F.when(F.col("run_id").isNotNull(), tags).alias("scenario_tags"))
        .select(
            "run_id",
            F.lit(suite_version).alias("suite_version"),
            F.lit(prompt_version).alias("prompt_version"),
            F.lit(tool_schema_version).alias("tool_schema_version"),
            F.lit(k).alias("k"),
            "scenario_ids",
            F.coalesce("scenario_tags", F.array().cast("array<string>")).alias("scenario_tags"),
            F.lit(max_cost_usd).alias("max_cost_usd"),
            F.lit(max_duration_seconds).alias("max_duration_seconds"),
        )
    )
