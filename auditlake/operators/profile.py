"""Personal-data profile of a corpus."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.pii import DETECTORS, Detector, detect, preview


def findings_of(
    texts: DataFrame,
    text: str,
    keep: Sequence[str],
    types: Iterable[str] | None = None,
    detectors: Iterable[Detector] = DETECTORS,
) -> DataFrame:
    """One row per finding with the kept columns, its kind, value, preview and place in the findings."""
    found = detect(F.col(text), types, detectors)
    return texts.select(*keep, F.posexplode(found).alias("finding_pos", "f")).select(
        *keep, "finding_pos", "f.type", "f.value", preview(F.col("f.type"), F.col("f.value")).alias("preview")
    )


def pii_profile(
    texts: DataFrame, text: str, by: Sequence[str], detectors: Iterable[Detector] = DETECTORS
) -> DataFrame:
    """Findings per kind and group. Only counts are shuffled."""
    found = texts.select(*by, F.explode(detect(F.col(text), detectors=detectors)).alias("f"))
    return found.groupBy(*by, F.col("f.type").alias("type")).agg(F.count("*").alias("findings"))
