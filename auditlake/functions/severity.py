"""Severity names and their weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity weights.
SEVERITY_WEIGHTS = {"info": 0, "low": 1, "medium": 3, "high": 7, "critical": 15}


def severity_weight(severity: Column) -> Column:
    branch = None
    for name, weight in SEVERITY_WEIGHTS.items():
        value = F.lit(weight).cast("bigint")
        branch = F.when(severity == name, value) if branch is None else branch.when(severity == name, value)
    unknown = F.raise_error(F.concat(F.lit("Unknown severity: "), severity)).cast("bigint")
    return branch.when(severity.isNull(), F.lit(None).cast("bigint")).otherwise(unknown)
