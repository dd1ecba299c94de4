"""Report tables: what a report, a listing or a dashboard shows, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import round_half_even
from auditlake.schemas import ATTEMPT_KEY
from auditlake.sources.catalog import with_regulation

# Decimal places of the reported metrics.
REPORTED_PLACES = {
    "pass_rate": 4, "violation_detection_rate": 4, "false_positive_rate": 4, "compliance_coverage": 4,
    "pass_at_1": 4, "pass_any": 4, "pass_all_k": 4, "reliability_drop": 4, "weighted_score": 4,
    "p50_latency_ms": 2, "p90_latency_ms": 2, "cost_usd_total": 6, "cost_usd_per_run": 6,
    "judge_cost_usd_total": 6, "judge_latency_ms_total": 2, "latency_ms_total": 2, "latency_ms_per_run": 2,
    "throughput_runs_per_sec": 2,
}


def rounded_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics as reported, rounded."""
    return metrics.withColumns(
        {c: round_half_even(F.col(c), p) for c, p in REPORTED_PLACES.items() if c in metrics.columns}
    )


def violations_table(counts: DataFrame, registry: DataFrame) -> DataFrame:
    """Violations per regulation with its name and authority, most first."""
    named = with_regulation(counts, registry, "regulation")
    return named.select("run_id", "regulation", "name", "authority", "violations").orderBy(
        "run_id", F.desc("violations"), "regulation"
    )


def scenario_table(attempts: DataFrame, results: DataFrame, k: int = 1, keys: Sequence[str] = ATTEMPT_KEY) -> DataFrame:
    """Title, label, PASS or FAIL and the failed checks of every attempt."""
    failed = (
        results.filter(~F.col("passed"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("check_pos", "check_id"))).alias("failed"))
    )
    names = F.array_join(F.transform("failed", lambda c: c["check_id"]), ", ")
    shown = attempts.join(failed, list(keys), "left").select(
        *keys,
        "title",
        "label",
        F.when(F.col("passed"), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("result"),
        F.coalesce(names, F.lit("—")).alias("failed_checks"),
    )
    return shown.withColumn("attempt_no", F.col("attempt") + 1) if k > 1 else shown


def catalog_table(scenarios: DataFrame) -> DataFrame:
    """Catalog listing, in catalog order."""
    return scenarios.orderBy("file_name").select(
        "scenario_id", "title", "label", F.array_join("regulations", ", ").alias("regulations")
    )


def regulation_table(registry: DataFrame) -> DataFrame:
    return registry.orderBy("file_pos").select("id", "name", "authority")


def search_scenarios(attempts: DataFrame, term: str) -> DataFrame:
    """Attempts whose title or scenario id contains the term, whatever the case."""
    wanted = F.lower(F.lit(term))
    return attempts.filter(
        F.contains(F.lower("title"), wanted) | F.contains(F.lower("scenario_id"), wanted)
    )


def tone(value: Column) -> Column:
    """Traffic light of a rate."""
    return F.when(value >= 0.9, F.lit("ok")).when(value >= 0.6, F.lit("warn")).otherwise(F.lit("bad"))


def health_tones(metrics: DataFrame) -> DataFrame:
    """Traffic lights of the headline metrics and the badge of the run history."""
    shown = rounded_metrics(metrics)
    return shown.select(
        "run_id",
        tone(F.col("pass_rate")).alias("pass_rate_tone"),
        F.when(F.col("false_positive_rate") == 0, F.lit("ok")).otherwise(F.lit("bad")).alias("false_positive_tone"),
        tone(F.coalesce("weighted_score", F.lit(1.0))).alias("weighted_score_tone"),
        F.when(F.col("pass_rate") >= 0.9, F.lit("pass"))
        .when(F.col("pass_rate").isNotNull(), F.lit("fail"))
        .otherwise(F.lit("—"))
        .alias("history_badge"),
    )
