"""Transcript projections: texts, tool calls, usage, attempts, scripted replies.

A flat turns table has one row per turn. A recorded conversation is one record of the data
model, so ``transcript_texts`` may gather its turns; checks that do not need the joined text
(see ``operators.checks.screen_turns``) never do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import join_lines
from auditlake.schemas import ATTEMPT_KEY

# Fixed value: the reply of a persona without a script.
DEFAULT_REPLY = "I'd be happy to help. Could you share a bit more detail?"

# Usage booked per scripted agent reply and per marker-judge answer.
SCRIPTED_USAGE = {
    "agent": {"prompt_tokens": 120, "completion_tokens": 80, "cost_usd": 0.0, "latency_ms": 2.0},
    "judge": {"prompt_tokens": 200, "completion_tokens": 20, "cost_usd": 0.0, "latency_ms": 1.0},
}

USAGE_FIELDS = ["prompt_tokens", "completion_tokens", "cost_usd", "latency_ms", "model_calls"]

# Sums of money and milliseconds are taken in decimals: independent of row order, hence of partitioning.
MONEY = "decimal(28,9)"


# --- nested transcripts: one row per attempt, no shuffle -----------------------------------


def agent_text(turns: Column) -> Column:
    return join_lines(F.transform(F.filter(turns, lambda t: t["role"] == "agent"), lambda t: t["content"]))


def all_text(turns: Column) -> Column:
    return join_lines(F.transform(turns, lambda t: t["content"]))


def target_text(scope: Column, agent: Column, everything: Column) -> Column:
    return F.when(scope == "all", everything).otherwise(agent)


def tool_names(turns: Column) -> Column:
    """Names of all calls of a transcript, any role, in order."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.transform(
                F.coalesce(t["tool_calls"], F.array().cast("array<struct<name:string,arguments:string,result:string>>")),
                lambda c: c["name"],
            ),
        )
    )


# --- flat turns ----------------------------------------------------------------------------


def transcript_texts(turns: DataFrame, keys: Sequence[str] = ATTEMPT_KEY) -> DataFrame:
    """Agent text, whole text and turn count per transcript; a transcript without agent turns has "" ."""
    gathered = turns.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("turns")
    )
    return gathered.select(
        *keys,
        agent_text(F.col("turns")).alias("agent_text"),
        all_text(F.col("turns")).alias("all_text"),
        F.size("turns").alias("n_turns"),
    )


def agent_texts(turns: DataFrame, keys: Sequence[str] = ATTEMPT_KEY) -> DataFrame:
    """Agent text alone: only agent turns enter the shuffle."""
    spoken = F.when(F.col("role") == "agent", F.struct("turn", "content"))
    return (
        turns.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(spoken)).alias("spoken"))
        .select(*keys, join_lines(F.transform("spoken", lambda t: t["content"])).alias("agent_text"))
    )


def tool_calls(turns: DataFrame, keys: Sequence[str] = ATTEMPT_KEY) -> DataFrame:
    """One row per tool call; (turn, call_pos) is its place in the transcript."""
    return turns.select(*keys, "turn", F.posexplode("tool_calls").alias("call_pos", "call")).select(
        *keys, "turn", "call_pos", "call.name", "call.arguments", "call.result"
    )


def called_tools(calls: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """Distinct tool names per transcript with their number of calls. Counted before the shuffle."""
    return calls.groupBy(*keys, F.col(name).alias("tool")).agg(F.count("*").alias("calls"))


# --- usage ---------------------------------------------------------------------------------


def total_usage(usage: DataFrame, keys: Sequence[str] = ATTEMPT_KEY) -> DataFrame:
    """Sums of the five usage fields."""
    return usage.groupBy(*keys).agg(
        *[F.sum(F.col(f).cast(MONEY) if f in ("cost_usd", "latency_ms") else F.col(f)).alias(f) for f in USAGE_FIELDS]
    )


def split_usage(usage: DataFrame, keys: Sequence[str] = ATTEMPT_KEY) -> DataFrame:
    """Agent share, judge share and total of the usage, in one aggregation."""

    def amount(field: str, source: str | None) -> Column:
        value = F.col(field)
        zero = F.lit(0).cast("bigint")
        if field in ("cost_usd", "latency_ms"):
            value, zero = value.cast(MONEY), F.lit(0).cast(MONEY)
        picked = value if source is None else F.when(F.col("source") == source, value).otherwise(zero)
        return F.sum(F.coalesce(picked, zero))

    return usage.groupBy(*keys).agg(
        *[amount(f, None).alias(f) for f in USAGE_FIELDS],
        *[amount(f, "agent").alias(f"agent_{f}") for f in USAGE_FIELDS],
        *[amount(f, "judge").alias(f"judge_{f}") for f in USAGE_FIELDS],
    )


# --- attempts and scripted replies -----------------------------------------------------------


def expand_attempts(scenarios: DataFrame, k: int) -> DataFrame:
    """Each scenario k times, attempts 0..k-1."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return scenarios.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def persona_key(model: Column) -> Column:
    """Script key of a model name such as ``mock/naive-agent``."""
    persona = F.when(F.contains(model, F.lit("/")), F.regexp_extract(model, r"(?s)^[^/]*/(.*)$", 1)).otherwise(
        F.lit("compliant-agent")
    )
    return F.when(F.contains(persona, F.lit("naive")), F.lit("naive")).otherwise(F.lit("compliant"))


def scripted_reply(script: Column, turn_index: Column) -> Column:
    """Entry for a customer turn; past the end the last entry, without a script the default reply."""
    return F.coalesce(F.get(script, F.least(turn_index, F.size(script) - 1)), F.lit(DEFAULT_REPLY))


def replay(customer_turns: DataFrame, scripts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Align customer turns with a script and interleave both sides.

    ``customer_turns``: keys, scenario_id, turn_index (0-based), content.
    ``scripts``: scenario_id, script (array of replies).
    Each customer turn yields a customer row and an agent row.
    """
    aligned = customer_turns.join(scripts, "scenario_id", "left")
    reply = scripted_reply(F.coalesce("script", F.array().cast("array<string>")), F.col("turn_index"))
    # Place 0 of a transcript is the system turn.
    both = F.array(
        F.struct(
            (F.col("turn_index") * 2 + 1).alias("turn"), F.lit("customer").alias("role"), F.col("content").alias("content")
        ),
        F.struct((F.col("turn_index") * 2 + 2).alias("turn"), F.lit("agent").alias("role"), reply.alias("content")),
    )
    return aligned.select(*keys, F.explode(both).alias("t")).select(*keys, "t.turn", "t.role", "t.content")


def system_turns(transcripts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The system turn, place 0, of each transcript (column ``system_prompt``)."""
    return transcripts.select(
        *keys, F.lit(0).alias("turn"), F.lit("system").alias("role"), F.col("system_prompt").alias("content")
    )


def scripted_usage(source: str) -> list[Column]:
    """Usage columns of one scripted response."""
    fixed = SCRIPTED_USAGE[source]
    return [
        F.lit(source).alias("source"),
        F.lit(fixed["prompt_tokens"]).cast("bigint").alias("prompt_tokens"),
        F.lit(fixed["completion_tokens"]).cast("bigint").alias("completion_tokens"),
        F.lit(fixed["cost_usd"]).alias("cost_usd"),
        F.lit(fixed["latency_ms"]).alias("latency_ms"),
        F.lit(1).cast("bigint").alias("model_calls"),
    ]
