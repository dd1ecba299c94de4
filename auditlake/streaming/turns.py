"""Recorded turns as a stream.

A turn can be judged by itself for forbidden phrases, patterns that stay within a line and personal data, so
alerts need no state. Saves of finished runs are appended batch by batch; the history keeps the last save of a
run, and a save carries the number of its batch, so a batch that is delivered again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlake.functions.pii import DETECTORS, Detector, detect, previews
from auditlake.operators.checks import forbidden_in_turns
from auditlake.schemas import ATTEMPT_KEY
from auditlake.sources.history import RunHistory


def pii_alerts(turns: DataFrame, detectors: Iterable[Detector] = DETECTORS) -> DataFrame:
    """Agent turns exposing personal data, with safe previews. A value split over two turns is left to the batch check."""
    found = detect(F.col("content"), detectors=tuple(detectors))
    return (
        turns.filter("role = 'agent'")
        .withColumn("found", found)
        .filter(F.size("found") > 0)
        .select(*ATTEMPT_KEY, "turn", F.array_join(previews(F.col("found")), ", ").alias("evidence"))
    )


def forbidden_alerts(turns: DataFrame, checks: DataFrame, known_patterns: Sequence[str] = ()) -> DataFrame:
    """Forbidden phrases, line-bound patterns and tools in single turns, joined with a static checks table."""
    return forbidden_in_turns(turns, checks, known_patterns)


def save_stream(
    runs: DataFrame, history: RunHistory, checkpoint: str, now=lambda: datetime.now(UTC), name: str = "stream"
) -> StreamingQuery:
    """Append a stream of finished runs to the history, all available data, then stop.

    ``name`` and the batch's number identify a save; streams that save to one history need names of their own.
    """
    return (
        runs.writeStream.foreachBatch(lambda batch, number: history.save(batch, now(), save_id=f"{name}:{number}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
