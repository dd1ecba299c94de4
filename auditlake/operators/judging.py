"""Judge work as tables: requests out, responses in, verdicts and usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.judge import JUDGE_SYSTEM, judge_message, marker_judge, parse_verdict
from auditlake.operators.checks import with_check_defaults
from auditlake.operators.transcripts import scripted_usage
from auditlake.schemas import ATTEMPT_KEY


def judge_requests(attempts: DataFrame, checks: DataFrame, keys: Sequence[str] = ATTEMPT_KEY) -> DataFrame:
    """One request per attempt and judged check; always about the agent text, whatever the scope."""
    judged = (
        with_check_defaults(checks)
        .filter("type = 'llm_judge'")
        .select("scenario_id", "check_pos", "check_id", "rubric", "judge_pass_if")
    )
    return attempts.join(judged, "scenario_id").select(
        *keys,
        "check_pos",
        "check_id",
        "judge_pass_if",
        F.lit(JUDGE_SYSTEM).alias("system"),
        judge_message(F.col("rubric"), F.coalesce("agent_text", F.lit(""))).alias("user"),
    )


def write_judge_requests(requests: DataFrame, path: str) -> None:
    """JSON lines for batch inference, one chat request per line."""

    def message(role: str):
        return F.struct(F.lit(role).alias("role"), F.col(role).alias("content"))

    requests.select(
        *[c for c in requests.columns if c not in ("system", "user")],
        F.array(message("system"), message("user")).alias("messages"),
    ).write.mode("errorifexists").json(path)


def answer_by_markers(requests: DataFrame, keys: Sequence[str] = ATTEMPT_KEY) -> DataFrame:
    """Responses of the deterministic marker judge, with their fixed usage."""
    return requests.select(*keys, "check_pos", "check_id", marker_judge(F.col("user")).alias("content"), *scripted_usage("judge"))


def verdicts(requests: DataFrame, responses: DataFrame, keys: Sequence[str] = ATTEMPT_KEY) -> DataFrame:
    """Parsed verdict of every request; one without a response is inconclusive."""
    on = [*keys, "check_pos"]
    return (
        requests.select(*on, "check_id", "judge_pass_if")
        .join(responses.select(*on, "content"), on, "left")
        .withColumn("v", parse_verdict(F.col("content"), F.col("judge_pass_if")))
        .select(*on, "check_id", "v.verdict", "v.parsed", "v.passed", "v.message", F.col("v.reason").alias("evidence"))
    )


def inconclusive_rate(parsed: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Share of verdicts that could not be read."""
    unread = F.count_if(~F.col("parsed"))
    return parsed.groupBy(*keys).agg(
        F.count("*").alias("verdicts"), unread.alias("inconclusive"), (unread / F.count("*")).alias("inconclusive_rate")
    )
