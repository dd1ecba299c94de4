"""Recorded runs as files: nested JSON or Parquet in, redacted JSON artifacts out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.pii import DETECTORS, Detector
from auditlake.operators.redaction import harvest_turns, redact_recorded
from auditlake.schemas import ATTEMPT_KEY, RECORDED_ATTEMPT


def read_recorded(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Recorded attempts, one object each; ``created_at`` stays text with a timestamp beside it."""
    raw = spark.read.schema(RECORDED_ATTEMPT).format(fmt).load(path)
    return raw.withColumn("created_ts", F.try_to_timestamp("created_at"))


def parse_recorded(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Recorded attempts held as JSON text in a column."""
    return rows.withColumn("r", F.from_json(payload, RECORDED_ATTEMPT)).select("r.*")


def turns_of(recorded: DataFrame) -> DataFrame:
    """The flat turns table of recorded attempts."""
    return recorded.select(*ATTEMPT_KEY, F.posexplode("turns").alias("turn", "t")).select(*ATTEMPT_KEY, "turn", "t.*")


def usage_of(recorded: DataFrame) -> DataFrame:
    """Usage rows of recorded attempts, one for the agent and one for the judge where they are recorded.

    An attempt that records its total alone counts as the agent's.
    """
    split = F.col("agent_usage").isNotNull() | F.col("judge_usage").isNotNull()
    agent = F.when(split, F.col("agent_usage")).otherwise(F.col("usage"))
    parts = F.array(
        F.struct(F.lit("agent").alias("source"), agent.alias("u")), F.struct(F.lit("judge").alias("source"), F.col("judge_usage").alias("u"))
    )
    rows = recorded.select(*ATTEMPT_KEY, F.explode(F.filter(parts, lambda p: p["u"].isNotNull())).alias("p"))
    return rows.select(
        *ATTEMPT_KEY, "p.source", F.lit(None).cast("int").alias("check_pos"),
        "p.u.prompt_tokens", "p.u.completion_tokens", "p.u.cost_usd", "p.u.latency_ms", "p.u.model_calls",
    )


def redacted_artifacts(recorded: DataFrame, detectors: Iterable[Detector] = DETECTORS) -> DataFrame:
    """Recorded attempts with every turn, tool call, title and check message redacted, each run by its own values."""
    return redact_recorded(recorded, harvest_turns(turns_of(recorded)), detectors)


def write_artifacts(recorded: DataFrame, path: str, redact: bool = True) -> None:
    """One JSON object per attempt, a directory per run; runs written before are replaced, other runs stay."""
    out = redacted_artifacts(recorded) if redact else recorded
    out = out.drop("created_ts").withColumn("run", F.col("run_id"))
    out.write.partitionBy("run").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)
