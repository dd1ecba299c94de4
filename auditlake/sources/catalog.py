"""Scenario catalogs and the regulation registry, read from JSON files (one object per file or line)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.checks import CHECK_DEFAULTS, CHECK_FIELDS, LIST_FIELDS
from auditlake.schemas import CATALOG_FILE, REGULATIONS


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """All scenario files of a directory; ``file_name`` gives the catalog order."""
    files = spark.read.schema(CATALOG_FILE).option("multiLine", True).json(path)
    return files.withColumn("file_name", F.col("_metadata.file_name"))


def scenarios_of(catalog: DataFrame) -> DataFrame:
    """The scenarios table of a loaded catalog."""
    empty = F.array().cast("array<string>")
    return catalog.select(
        "file_name",
        F.col("id").alias("scenario_id"),
        "title",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("label", F.lit("violation_expected")).alias("label"),
        *[F.coalesce(c, empty).alias(c) for c in ("tags", "regulations")],
        F.coalesce("context", F.lit("{}")).alias("context"),
        F.coalesce("customer_turns", empty).alias("customer_turns"),
    )


def checks_of(catalog: DataFrame) -> DataFrame:
    """The checks table of a loaded catalog, defaults filled in."""
    flat = catalog.select(F.col("id").alias("scenario_id"), F.posexplode("checks").alias("check_pos", "c")).select(
        "scenario_id", "check_pos", F.col("c.id").alias("check_id"), "c.type",
        *[f"c.{f}" for f in CHECK_FIELDS if f not in ("check_pos", "check_id", "type")],
    )
    filled = {f: F.coalesce(F.col(f), F.lit(v)) for f, v in CHECK_DEFAULTS.items()}
    filled |= {f: F.coalesce(F.col(f), F.array().cast("array<string>")) for f in LIST_FIELDS}
    return flat.withColumns(filled)


def scripts_of(catalog: DataFrame) -> DataFrame:
    """Scripted replies per scenario and persona."""
    parts = [
        catalog.select(
            F.col("id").alias("scenario_id"),
            F.lit(persona).alias("persona"),
            F.posexplode(F.col("scripts")[persona]).alias("entry_pos", "e"),
        )
        for persona in ("compliant", "naive")
    ]
    return parts[0].union(parts[1]).select("scenario_id", "persona", "entry_pos", "e.text", "e.tool_calls")


def with_tags(scenarios: DataFrame, wanted: Sequence[str] | None) -> DataFrame:
    """Scenarios carrying at least one wanted tag; no wanted tags keeps all."""
    if not wanted:
        return scenarios
    return scenarios.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in wanted])))


def parse_tags(option: str | None) -> list[str]:
    """The tags of a comma-separated option."""
    return [t.strip() for t in option.split(",")] if option else []


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The regulation registry, one JSON object per line with its position in ``file_pos``."""
    return latest_per_id(spark.read.schema(REGULATIONS).json(path))


def latest_per_id(registry: DataFrame) -> DataFrame:
    """One row per id: the content of its last entry, at the place of its first."""
    rest = [c for c in registry.columns if c not in ("id", "file_pos")]
    return (
        registry.groupBy("id")
        .agg(F.min("file_pos").alias("file_pos"), F.max_by(F.struct(*rest), "file_pos").alias("r"))
        .select("file_pos", "id", *[F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in rest])
    )


def with_regulation(rows: DataFrame, registry: DataFrame, column: str) -> DataFrame:
    """Add name and authority; an unknown id is its own name and has no authority."""
    known = registry.select(F.col("id").alias(column), F.col("name").alias("_name"), F.col("authority").alias("_authority"))
    return rows.join(known, column, "left").select(
        *rows.columns,
        F.coalesce("_name", column).alias("name"),
        F.coalesce("_authority", F.lit("")).alias("authority"),
    )


