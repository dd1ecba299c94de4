"""Queries over transcripts: texts, scopes, tool calls, usage, attempts, scripted replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import transcripts as tr
from auditlake.plans import inputs as src
from auditlake.schemas import ATTEMPT_KEY
from auditlake.sources import transcripts as recorded

K = list(ATTEMPT_KEY)


def agent_text(spark, sf):
    return tr.agent_texts(src.turns(spark, sf))


AGENT_TEXT = f"WITH {src.TEXTS_SQL} SELECT run_id, scenario_id, attempt, agent_text FROM texts"


def all_text(spark, sf):
    return tr.transcript_texts(src.turns(spark, sf)).select(*K, "all_text", "n_turns")


ALL_TEXT = f"""WITH {src.TEXTS_SQL}
SELECT run_id, scenario_id, attempt, all_text,
       (SELECT CAST(count(*) AS INTEGER) FROM turns u WHERE u.run_id = t.run_id AND u.scenario_id = t.scenario_id
        AND u.attempt = t.attempt) AS n_turns
FROM texts t"""


def scoped_text(spark, sf):
    checks = src.rules(spark, ["prohibited_phrase"]).select("scenario_id", "check_id", "scope")
    text = tr.target_text(F.col("scope"), F.col("agent_text"), F.col("all_text"))
    return (
        tr.transcript_texts(src.turns(spark, sf))
        .join(checks, "scenario_id")
        .select(*K, "check_id", "scope", text.alias("target"))
    )


SCOPED_TEXT = f"""WITH {src.TEXTS_SQL}, {src.rules_sql(["prohibited_phrase"])}
SELECT run_id, t.scenario_id, attempt, check_id, scope,
       CASE WHEN scope = 'all' THEN all_text ELSE agent_text END AS target
FROM texts t JOIN rules r ON r.scenario_id = t.scenario_id"""


def tool_calls(spark, sf):
    return tr.tool_calls(src.event_turns(spark, sf))


TOOL_CALLS = """SELECT 'run_' || (user_id % 7) AS run_id, 's' || lpad(CAST(user_id % 16 AS VARCHAR), 2, '0') AS scenario_id,
  CAST(user_id AS INTEGER) AS attempt, CAST(event_id AS INTEGER) AS turn, 0 AS call_pos, event_type AS name,
  props AS arguments, CAST(NULL AS VARCHAR) AS result FROM events"""


def called_tools(spark, sf):
    return tr.called_tools(tr.tool_calls(src.event_turns(spark, sf)), K)


CALLED_TOOLS = """SELECT 'run_' || (user_id % 7) AS run_id, 's' || lpad(CAST(user_id % 16 AS VARCHAR), 2, '0') AS scenario_id,
  CAST(user_id AS INTEGER) AS attempt, event_type AS tool, count(*) AS calls FROM events GROUP BY ALL"""


def _doubles(df):
    money = [c for c in df.columns if c.endswith(("cost_usd", "latency_ms"))]
    return df.withColumns({c: F.col(c).cast("double") for c in money})


def _sum(field: str, alias: str, where: str = "") -> str:
    if field in ("cost_usd", "latency_ms"):
        return f"CAST(coalesce(sum(CAST({field} AS DECIMAL(28, 9))){where}, 0) AS DOUBLE) AS {alias}"
    return f"CAST(coalesce(sum({field}){where}, 0) AS BIGINT) AS {alias}"


def usage_total(spark, sf):
    return _doubles(tr.total_usage(src.usage(spark, sf)))


USAGE_TOTAL = f"""WITH {src.USAGE_SQL} SELECT run_id, scenario_id, attempt,
  {", ".join(_sum(f, f) for f in tr.USAGE_FIELDS)} FROM usage GROUP BY ALL"""


def usage_split(spark, sf):
    return _doubles(tr.split_usage(src.usage(spark, sf)))


SPLIT_COLUMNS_SQL = ", ".join(
    [_sum(f, f) for f in tr.USAGE_FIELDS]
    + [_sum(f, f"{s}_{f}", f" FILTER (WHERE source = '{s}')") for s in ("agent", "judge") for f in tr.USAGE_FIELDS]
)
USAGE_SPLIT = f"WITH {src.USAGE_SQL} SELECT run_id, scenario_id, attempt, {SPLIT_COLUMNS_SQL} FROM usage GROUP BY ALL"


def attempt_expansion(spark, sf):
    return tr.expand_attempts(src.scenarios(spark, sf).select("scenario_id", "label"), 3)


ATTEMPT_EXPANSION = f"""WITH {src.SCENARIOS_SQL}
SELECT scenario_id, label, CAST(unnest(range(3)) AS INTEGER) AS attempt FROM scenarios"""


def _replayed(spark, sf):
    """Customer turns of the conversations answered by numbered replies per scenario."""
    t = src.turns(spark, sf)
    spoken = t.filter("role = 'customer'").select(
        *K, F.floor(F.col("turn") / 2).cast("int").alias("turn_index"), "content"
    )

    def reply(i):
        return F.concat(F.lit("reply "), i.cast("string"), F.lit(" of "), F.col("scenario_id"))

    # Scenarios 12 to 15 have no script; the others one to three replies.
    scripts = (
        t.select("scenario_id")
        .distinct()
        .withColumn("n", F.substring("scenario_id", 2, 2).cast("int"))
        .filter("n < 12")
        .select("scenario_id", F.transform(F.sequence(F.lit(0), F.col("n") % 3), reply).alias("script"))
    )
    prompts = t.filter("role = 'system'").select(*K, F.col("content").alias("system_prompt"))
    return tr.system_turns(prompts, K).unionByName(tr.replay(spoken, scripts, K))


REPLAYED_SQL = f"""{src.TURNS_SQL}, spoken AS (
  SELECT run_id, scenario_id, attempt, turn // 2 AS i, content, CAST(scenario_id[2:3] AS INTEGER) AS n
  FROM turns WHERE role = 'customer'), replayed AS (
  SELECT run_id, scenario_id, attempt, CAST(i * 2 + 1 AS INTEGER) AS turn, 'customer' AS role, content FROM spoken
  UNION ALL SELECT run_id, scenario_id, attempt, 0, 'system', content FROM turns WHERE role = 'system'
  UNION ALL
  SELECT run_id, scenario_id, attempt, CAST(i * 2 + 2 AS INTEGER), 'agent',
         CASE WHEN n < 12 THEN 'reply ' || least(i, n % 3) || ' of ' || scenario_id ELSE {src.sql_value(tr.DEFAULT_REPLY)} END
  FROM spoken)"""


def scripted_replay(spark, sf):
    return _replayed(spark, sf)


SCRIPTED_REPLAY = f"WITH {REPLAYED_SQL} SELECT * FROM replayed"


def scripted_usage(spark, sf):
    replies = _replayed(spark, sf).filter("role = 'agent'").select(*K, *tr.scripted_usage("agent"))
    return _doubles(tr.total_usage(replies))


SCRIPTED_USAGE = f"""WITH {REPLAYED_SQL}
SELECT run_id, scenario_id, attempt, CAST(sum(120) AS BIGINT) AS prompt_tokens, CAST(sum(80) AS BIGINT) AS completion_tokens,
       0.0::DOUBLE AS cost_usd, CAST(sum(2.0) AS DOUBLE) AS latency_ms, count(*) AS model_calls
FROM replayed WHERE role = 'agent' GROUP BY ALL"""


def persona_script(spark, sf):
    """Script key of the agent model of every run."""
    return src.runs(spark, sf).select("run_id", "agent_model", tr.persona_key(F.col("agent_model")).alias("persona"))


PERSONA_SCRIPT = f"""WITH {src.RUNS_SQL} SELECT run_id, agent_model,
  CASE WHEN agent_model LIKE '%naive%' THEN 'naive' ELSE 'compliant' END AS persona FROM runs"""


def recorded_usage(spark, sf):
    """Line items written as recorded attempts with their usage, the judge's on shipped ones only, and read back."""
    used = F.struct(
        F.col("l_quantity").cast("bigint").alias("prompt_tokens"), F.col("l_linenumber").cast("bigint").alias("completion_tokens"),
        F.lit(1).alias("model_calls"), F.col("l_linenumber").cast("double").alias("latency_ms"), F.lit(0.5).alias("cost_usd"),
    )
    written = src.table(spark, sf, "lineitem").select(
        F.to_json(
            F.struct(
                F.col("l_returnflag").alias("run_id"), F.col("l_partkey").cast("string").alias("scenario_id"),
                F.col("l_orderkey").cast("int").alias("attempt"), used.alias("agent_usage"),
                F.when(F.col("l_linestatus") == "F", used).alias("judge_usage"),
            )
        ).alias("payload")
    )
    usage = recorded.usage_of(recorded.parse_recorded(written))
    return usage.groupBy("run_id", "source").agg(
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "model_calls", "latency_ms", "cost_usd")]
    )


RECORDED_USAGE = """WITH u AS (SELECT l_returnflag AS run_id, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n, l_linestatus FROM lineitem),
  p AS (SELECT *, 'agent' AS source FROM u UNION ALL SELECT *, 'judge' FROM u WHERE l_linestatus = 'F')
SELECT run_id, source, CAST(sum(q) AS BIGINT) AS prompt_tokens, CAST(sum(n) AS BIGINT) AS completion_tokens, count(*) AS model_calls,
  CAST(sum(n) AS DOUBLE) AS latency_ms, count(*) * 0.5::DOUBLE AS cost_usd FROM p GROUP BY ALL"""


def parsed_transcripts(spark, sf):
    """Conversations written as recorded-attempt JSON and read back."""
    t = src.turns(spark, sf)
    turn = F.struct("turn", "role", "content")
    rows = t.groupBy(*K).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    payload = rows.select(
        F.to_json(
            F.struct(*K, F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns"))
        ).alias("payload")
    )
    return recorded.turns_of(recorded.parse_recorded(payload)).select(*K, "turn", "role", "content")


PARSED_TRANSCRIPTS = f"""WITH {src.TURNS_SQL} SELECT run_id, scenario_id, attempt,
  CAST(row_number() OVER (PARTITION BY run_id, scenario_id, attempt ORDER BY turn) - 1 AS INTEGER) AS turn, role, content
FROM turns"""


QUERIES = {
    "transcript_agent_text": (agent_text, AGENT_TEXT),
    "transcript_all_text": (all_text, ALL_TEXT),
    "transcript_scoped_text": (scoped_text, SCOPED_TEXT),
    "transcript_tool_calls": (tool_calls, TOOL_CALLS),
    "transcript_called_tools": (called_tools, CALLED_TOOLS),
    "usage_total": (usage_total, USAGE_TOTAL),
    "usage_split_agent_judge": (usage_split, USAGE_SPLIT),
    "attempt_expansion": (attempt_expansion, ATTEMPT_EXPANSION),
    "scripted_replay": (scripted_replay, SCRIPTED_REPLAY),
    "scripted_usage": (scripted_usage, SCRIPTED_USAGE),
    "persona_script": (persona_script, PERSONA_SCRIPT),
    "parsed_transcripts": (parsed_transcripts, PARSED_TRANSCRIPTS),
    "recorded_usage": (recorded_usage, RECORDED_USAGE),
}
