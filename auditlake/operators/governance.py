"""Catalog integrity rules, each returning the offending rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import local_table

# Accepted labels, required control families, the tag of adversarial scenarios, the personas.
LABELS = ("violation_expected", "benign_control")
REQUIRED_TAGS = ("prompt_injection", "tool_use", "identity", "fraud", "escalation")
ADVERSARIAL = "adversarial"
PERSONAS = ("compliant", "naive")


def cited_regulations(scenarios: DataFrame, checks: DataFrame) -> DataFrame:
    """Distinct (scenario_id, regulation) cited by a scenario or one of its checks."""
    cited = F.explode("regulations").alias("regulation")
    return scenarios.select("scenario_id", cited).union(checks.select("scenario_id", cited)).distinct()


def unknown_regulations(scenarios: DataFrame, checks: DataFrame, registry: DataFrame) -> DataFrame:
    """Citations the registry does not know."""
    known = registry.select(F.col("id").alias("regulation"))
    return cited_regulations(scenarios, checks).join(known, "regulation", "left_anti")


def unexercised_regulations(checks: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry entries no check cites."""
    exercised = checks.select(F.explode("regulations").alias("id")).distinct()
    return registry.select("id").distinct().join(exercised, "id", "left_anti")


def malformed_scenarios(scenarios: DataFrame, checks: DataFrame) -> DataFrame:
    """Scenarios without checks or with a label outside the accepted ones."""
    with_checks = checks.select("scenario_id").distinct().withColumn("has_checks", F.lit(True))
    return (
        scenarios.select("scenario_id", "label")
        .join(with_checks, "scenario_id", "left")
        .select(
            "scenario_id",
            F.col("has_checks").isNull().alias("no_checks"),
            (~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))).alias("bad_label"),
        )
        .filter("no_checks OR bad_label")
    )


def adversarial_without_scripts(scenarios: DataFrame, scripts: DataFrame) -> DataFrame:
    """Adversarial scenarios lacking a script of one of the personas."""
    has: list[Column] = [F.bool_or(F.col("persona") == p).alias(p) for p in PERSONAS]
    per_scenario = scripts.groupBy("scenario_id").agg(*has)
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(p, F.lit(False)), F.lit(p)) for p in PERSONAS]))
    return (
        scenarios.filter(F.array_contains("tags", ADVERSARIAL))
        .select("scenario_id")
        .join(per_scenario, "scenario_id", "left")
        .select("scenario_id", missing.alias("missing_personas"))
        .filter(F.size("missing_personas") > 0)
    )


def catalog_tags(scenarios: DataFrame) -> DataFrame:
    """Distinct tags of the catalog, sorted."""
    return scenarios.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def missing_tags(spark, scenarios: DataFrame, required: Sequence[str] = REQUIRED_TAGS) -> DataFrame:
    """Required tags that no scenario carries."""
    wanted = local_table(spark, [(t,) for t in required], "tag string")
    present = scenarios.select(F.explode("tags").alias("tag")).distinct()
    return wanted.join(present, "tag", "left_anti")
