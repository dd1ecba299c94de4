"""Queries for run metrics, gates, budgets and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import pii
from auditlake.functions.severity import SEVERITY_WEIGHTS
from auditlake.operators import checks as ck
from auditlake.operators import gates as gt
from auditlake.operators import metrics as mt
from auditlake.operators import reports as rp
from auditlake.operators import transcripts as tr
from auditlake.plans import check_queries as cq
from auditlake.plans import inputs as src
from auditlake.schemas import ATTEMPT_KEY
from auditlake.session import checkpointed, spread, tasks_for

K = list(ATTEMPT_KEY)

# --- attempts with outcomes -------------------------------------------------------------------


def _label(number):
    return F.when(number % 4 == 3, F.lit("benign_control")).otherwise(F.lit("violation_expected"))


def conversation_attempts(spark, sf):
    """Evaluated conversations with a label per scenario."""
    number = F.substring("scenario_id", 2, 2).cast("int")
    evaluated = ck.with_outcome(cq.evaluated_conversations(spark, sf))
    return evaluated.withColumn("label", _label(number)).withColumn("title", F.concat(F.lit("Scenario "), "scenario_id"))


CONVERSATION_ATTEMPTS_SQL = f"""{cq.OUTCOMES_SQL}, attempts AS (
  SELECT *, CASE WHEN CAST(scenario_id[2:3] AS INTEGER) % 4 = 3 THEN 'benign_control' ELSE 'violation_expected' END AS label,
         'Scenario ' || scenario_id AS title FROM outcomes)"""


def item_attempts(spark, sf):
    """Orders of line items as attempts: outcome and label of each (run, part, order)."""
    # Nearly every row is a group of its own: dealt out by group first, no task holds groups of more rows than its share.
    summary = ck.summarize_results(spread(src.results(spark, sf), *K))
    labels = src.scenarios(spark, sf).select("scenario_id", "label")
    return summary.join(labels, "scenario_id")


ITEM_ATTEMPTS_SQL = f"""{src.RESULTS_SQL}, {src.SCENARIOS_SQL}, summary AS (
  SELECT run_id, scenario_id, attempt, bool_and(passed) AS passed, count(*) FILTER (WHERE NOT passed) AS violations,
    coalesce(sum({src.WEIGHT_SQL}) FILTER (WHERE NOT passed), 0) AS violation_weight, sum({src.WEIGHT_SQL}) AS possible_weight
  FROM results GROUP BY ALL), attempts AS (
  SELECT s.*, c.label FROM summary s JOIN scenarios c ON c.scenario_id = s.scenario_id)"""


def document_attempts(spark, sf):
    """Labelled documents: a document holding personal data violates; toxic ones are expected to."""
    labels = src.table(spark, sf, "labels")
    d = src.texts(spark, sf, "documents").select("doc_id", "lang", "source", F.size(pii.detect(F.col("text"))).alias("found"))
    label = F.when(F.col("toxic") == 1, F.lit("violation_expected")).when(F.col("quality") == 1, F.lit("benign_control"))
    found = F.col("found").cast("bigint")
    return d.join(labels, "doc_id", "left").select(
        F.col("lang").alias("run_id"), F.col("source").alias("scenario_id"), F.col("doc_id").alias("attempt"),
        label.alias("label"), (found == 0).alias("passed"), found.alias("violations"),
        (found * 7).alias("violation_weight"), (found * 7 + 3).alias("possible_weight"),
    )


DOCUMENT_ATTEMPTS_SQL = f"""found AS (
  SELECT d.doc_id, lang, source, len({src.findings_sql('text')}) AS n, quality, toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), attempts AS (
  SELECT lang AS run_id, source AS scenario_id, doc_id AS attempt,
    CASE WHEN toxic = 1 THEN 'violation_expected' WHEN quality = 1 THEN 'benign_control' END AS label,
    n = 0 AS passed, n AS violations, n * 7 AS violation_weight, n * 7 + 3 AS possible_weight FROM found)"""

_OUTCOME_METRICS_SQL = """per_scenario AS (
  SELECT run_id, scenario_id, bool_and(passed) AS all_passed, bool_or(passed) AS any_passed FROM attempts GROUP BY ALL),
reliability AS (
  SELECT run_id, count(*) AS scenarios, count(*) FILTER (WHERE all_passed) / count(*)::DOUBLE AS pass_all_k,
    count(*) FILTER (WHERE any_passed) / count(*)::DOUBLE AS pass_any FROM per_scenario GROUP BY run_id),
totals AS (
  SELECT run_id, count(*) AS total_runs, count(*) FILTER (WHERE passed) AS passed_runs,
    coalesce(count(*) FILTER (WHERE label = 'violation_expected' AND violations > 0)
      / nullif(count(*) FILTER (WHERE label = 'violation_expected'), 0)::DOUBLE, 0.0) AS violation_detection_rate,
    coalesce(count(*) FILTER (WHERE label = 'benign_control' AND violations > 0)
      / nullif(count(*) FILTER (WHERE label = 'benign_control'), 0)::DOUBLE, 0.0) AS false_positive_rate,
    CAST(sum(violations) AS BIGINT) AS total_violations, CAST(sum(violation_weight) AS BIGINT) AS violation_weight,
    CAST(sum(possible_weight) AS BIGINT) AS possible_weight FROM attempts GROUP BY run_id),
outcome AS (
  SELECT t.run_id, scenarios, total_runs, passed_runs, total_runs - passed_runs AS failed_runs,
    passed_runs / total_runs::DOUBLE AS pass_rate, pass_all_k, pass_any AS pass_at_1, pass_any,
    pass_any - pass_all_k AS reliability_drop, violation_detection_rate, false_positive_rate, total_violations,
    violation_weight, possible_weight,
    1.0::DOUBLE - coalesce(violation_weight::DOUBLE / nullif(possible_weight, 0)::DOUBLE, 0.0::DOUBLE) AS weighted_score
  FROM totals t JOIN reliability r ON r.run_id = t.run_id)"""


def _outcomes_of(attempts):
    return lambda spark, sf: mt.outcome_metrics(attempts(spark, sf))


def _outcomes_sql(attempts_sql):
    return f"WITH {attempts_sql}, {_OUTCOME_METRICS_SQL} SELECT * FROM outcome"


# --- violations, coverage ---------------------------------------------------------------------


def by_severity(spark, sf):
    return mt.violations_by_severity(src.results(spark, sf))


_SEVERITY_COLUMNS_SQL = ", ".join(
    f"count(*) FILTER (WHERE NOT passed AND severity = '{s}') AS violations_{s}" for s in SEVERITY_WEIGHTS
)
BY_SEVERITY = f"WITH {src.RESULTS_SQL} SELECT run_id, {_SEVERITY_COLUMNS_SQL} FROM results GROUP BY run_id"

_CITED_SQL = """cited AS (SELECT run_id, unnest(CASE WHEN len(regulations) = 0 THEN ['UNSPECIFIED'] ELSE regulations END) AS regulation
  FROM results WHERE NOT passed), counts AS (SELECT run_id, regulation, count(*) AS violations FROM cited GROUP BY ALL)"""


def by_regulation(spark, sf):
    return mt.violations_by_regulation(src.results(spark, sf))


BY_REGULATION = f"WITH {src.RESULTS_SQL}, {_CITED_SQL} SELECT * FROM counts"


def _registry(spark, sf):
    from auditlake.sources.catalog import latest_per_id

    return latest_per_id(src.registry(spark, sf))


def coverage(spark, sf):
    out = mt.regulation_coverage(src.results(spark, sf), _registry(spark, sf))
    return out.withColumn("regulations_covered", F.array_join("regulations_covered", ","))


_COVERAGE_SQL = """exercised AS (SELECT DISTINCT run_id, regulation FROM (
    SELECT run_id, unnest(regulations) AS regulation FROM results) WHERE regulation IN (SELECT id FROM registry)),
coverage AS (SELECT r.run_id, coalesce(string_agg(regulation, ',' ORDER BY regulation), '') AS regulations_covered,
    (SELECT count(DISTINCT id) FROM registry) AS regulations_total,
    count(regulation) / (SELECT count(DISTINCT id) FROM registry)::DOUBLE AS compliance_coverage
  FROM (SELECT DISTINCT run_id FROM results) r LEFT JOIN exercised e ON e.run_id = r.run_id GROUP BY r.run_id)"""
COVERAGE = f"WITH {src.RESULTS_SQL}, {src.REGISTRY_SQL}, {_COVERAGE_SQL} SELECT * FROM coverage"


# --- latency and usage --------------------------------------------------------------------------


def latency_percentiles(spark, sf):
    """Per run, over single events."""
    return mt.latency_percentiles(src.usage(spark, sf))


LATENCY_PERCENTILES = f"""WITH {src.USAGE_SQL}, l AS (SELECT run_id, list(latency_ms ORDER BY latency_ms) AS v FROM usage GROUP BY run_id)
SELECT run_id, v[len(v) // 2 + 1] AS p50_latency_ms, v[CAST(floor(len(v) * 0.9::DOUBLE) AS BIGINT) + 1] AS p90_latency_ms FROM l"""


def price_percentiles(spark, sf):
    """The same over the prices of all line items, a run per return flag, and over discounts with many equal values."""
    li = src.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "run_id")
    prices = {"p50_price": 0.5, "p90_price": 0.9, "p99_price": 0.99}
    return mt.values_at_fractions(li, {"l_extendedprice": prices, "l_discount": {"p50_discount": 0.5, "p90_discount": 0.9}})


PRICE_PERCENTILES = """WITH l AS (SELECT l_returnflag AS run_id, list(l_extendedprice ORDER BY l_extendedprice) AS p,
  list(l_discount ORDER BY l_discount) AS d FROM lineitem GROUP BY ALL)
SELECT run_id, p[len(p) // 2 + 1] AS p50_price, p[CAST(floor(len(p) * 0.9::DOUBLE) AS BIGINT) + 1] AS p90_price,
  p[CAST(floor(len(p) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99_price, d[len(d) // 2 + 1] AS p50_discount,
  d[CAST(floor(len(d) * 0.9::DOUBLE) AS BIGINT) + 1] AS p90_discount FROM l"""


def usage_metrics(spark, sf):
    return mt.usage_metrics(tr.split_usage(src.usage(spark, sf)))


def _usage_columns_sql() -> str:
    def money(field, alias):
        return f"CAST(sum(CAST({field} AS DECIMAL(28, 9))) AS DOUBLE) AS {alias}"

    def whole(field, alias):
        return f"CAST(sum({field}) AS BIGINT) AS {alias}"

    return ", ".join(
        [
            money("cost_usd", "cost_usd_total"),
            "CAST(sum(CAST(cost_usd AS DECIMAL(28, 9))) AS DOUBLE) / count(*) AS cost_usd_per_run",
            money("latency_ms", "latency_ms_total"),
            "CAST(sum(CAST(latency_ms AS DECIMAL(28, 9))) AS DOUBLE) / count(*) AS latency_ms_per_run",
            whole("prompt_tokens", "tokens_prompt"),
            whole("completion_tokens", "tokens_completion"),
            whole("model_calls", "model_calls"),
            whole("judge_prompt_tokens", "judge_tokens_prompt"),
            whole("judge_completion_tokens", "judge_tokens_completion"),
            money("judge_cost_usd", "judge_cost_usd_total"),
            money("judge_latency_ms", "judge_latency_ms_total"),
            whole("judge_model_calls", "judge_model_calls"),
            "CASE WHEN sum(latency_ms) > 0 THEN count(*) / (CAST(sum(CAST(latency_ms AS DECIMAL(28, 9))) AS DOUBLE) / 1000.0) "
            "ELSE 0.0 END AS throughput_runs_per_sec",
        ]
    )


_SPLIT_SQL = f"split AS (SELECT run_id, scenario_id, attempt, {{}} FROM usage GROUP BY ALL)"
_USAGE_METRICS_SQL = f"usage_metrics AS (SELECT run_id, {_usage_columns_sql()} FROM split GROUP BY run_id)"


def _split_columns() -> str:
    from auditlake.plans.transcript_queries import SPLIT_COLUMNS_SQL

    return SPLIT_COLUMNS_SQL


def _split_sql() -> str:
    return _SPLIT_SQL.format(_split_columns())


USAGE_METRICS = f"WITH {src.USAGE_SQL}, {_split_sql()}, {_USAGE_METRICS_SQL} SELECT * FROM usage_metrics"


# --- everything in one row per run ------------------------------------------------------------------


def _flat(metrics):
    pairs = F.transform("violations_by_regulation", lambda e: F.concat(e["regulation"], F.lit("="), e["violations"].cast("string")))
    return metrics.withColumns(
        {"violations_by_regulation": F.array_join(pairs, ","), "regulations_covered": F.array_join("regulations_covered", ",")}
    )


def run_metrics(spark, sf):
    """All metrics of the evaluated conversations. Their usage is recorded in the events, a hundred for each of them."""
    attempts = checkpointed(conversation_attempts(spark, sf))
    calls = src.conversation_usage(spark, sf)
    usage = attempts.select(*K).join(tr.split_usage(calls), K, "left").fillna(0)
    return _flat(mt.run_metrics(attempts, ck.results_of(attempts), _registry(spark, sf), usage, k=2))


RUN_METRICS = f"""WITH {CONVERSATION_ATTEMPTS_SQL}, {_OUTCOME_METRICS_SQL}, {src.REGISTRY_SQL},
listed AS (SELECT * EXCLUDE (regulations), CASE WHEN regulations = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regulations, ',') END AS regulations FROM results),
severity AS (SELECT run_id, {_SEVERITY_COLUMNS_SQL} FROM results GROUP BY run_id),
{_CITED_SQL.replace('FROM results', 'FROM listed')},
regs AS (SELECT run_id, string_agg(regulation || '=' || violations, ',' ORDER BY violations DESC, regulation) AS violations_by_regulation
  FROM counts GROUP BY run_id),
{_COVERAGE_SQL.replace('FROM results', 'FROM listed')},
{src.CONVERSATION_USAGE_SQL}, called AS (SELECT run_id, scenario_id, attempt, {_split_columns()} FROM usage GROUP BY ALL),
split AS (SELECT a.run_id, COLUMNS(c.* EXCLUDE (run_id, scenario_id, attempt)) FROM attempts a LEFT JOIN called c
  ON c.run_id = a.run_id AND c.scenario_id = a.scenario_id AND c.attempt = a.attempt),
spent AS (SELECT run_id, coalesce(COLUMNS(* EXCLUDE (run_id)), 0) FROM split), {_USAGE_METRICS_SQL.replace("FROM split", "FROM spent")},
latency AS (SELECT run_id, list(latency_ms ORDER BY latency_ms) AS v FROM spent GROUP BY run_id)
SELECT o.*, 2 AS k, violations_info, violations_low, violations_medium, violations_high, violations_critical,
  coalesce(violations_by_regulation, '') AS violations_by_regulation, regulations_covered, regulations_total, compliance_coverage,
  u.* EXCLUDE (run_id), v[len(v) // 2 + 1] AS p50_latency_ms, v[CAST(floor(len(v) * 0.9::DOUBLE) AS BIGINT) + 1] AS p90_latency_ms
FROM outcome o JOIN severity s ON s.run_id = o.run_id LEFT JOIN regs r ON r.run_id = o.run_id
JOIN coverage c ON c.run_id = o.run_id JOIN usage_metrics u ON u.run_id = o.run_id JOIN latency l ON l.run_id = o.run_id"""


def item_run_metrics(spark, sf):
    """All metrics without usage over line items."""
    return _flat(mt.run_metrics(item_attempts(spark, sf), src.results(spark, sf), _registry(spark, sf), k=3))


ITEM_RUN_METRICS = f"""WITH {ITEM_ATTEMPTS_SQL}, {_OUTCOME_METRICS_SQL}, {src.REGISTRY_SQL},
severity AS (SELECT run_id, {_SEVERITY_COLUMNS_SQL} FROM results GROUP BY run_id), {_CITED_SQL},
regs AS (SELECT run_id, string_agg(regulation || '=' || violations, ',' ORDER BY violations DESC, regulation) AS violations_by_regulation
  FROM counts GROUP BY run_id), {_COVERAGE_SQL}
SELECT o.*, 3 AS k, s.* EXCLUDE (run_id), r.violations_by_regulation, c.* EXCLUDE (run_id)
FROM outcome o JOIN severity s ON s.run_id = o.run_id JOIN regs r ON r.run_id = o.run_id JOIN coverage c ON c.run_id = o.run_id"""


# --- gates and budgets ---------------------------------------------------------------------------------

_ROUND_4 = "CAST(round_even(CAST({} AS DECIMAL(38, 18)), 4) AS DOUBLE)"


def gates(spark, sf):
    return gt.gates(mt.outcome_metrics(document_attempts(spark, sf)), fail_under=0.9, fail_under_weighted=0.8)


GATES = f"""WITH {DOCUMENT_ATTEMPTS_SQL}, {_OUTCOME_METRICS_SQL}, g AS (
  SELECT run_id, 'pass_rate' AS gate, {_ROUND_4.format('pass_rate')} AS value, 0.9::DOUBLE AS threshold FROM outcome UNION ALL
  SELECT run_id, 'weighted_score', {_ROUND_4.format('weighted_score')}, 0.8::DOUBLE FROM outcome)
SELECT *, value >= threshold AS ok FROM g"""


def _minute(ts):
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / 60)


def _budget(column, cap):
    def query(spark, sf):
        rows = src.usage(spark, sf).select("run_id", "ts", "event_id", column)
        breaches = gt.limit_breaches(rows, column, cap, ["ts", "event_id"], _minute(F.col("ts")))
        return breaches.select("run_id", "event_id", F.col("running").cast("double").alias("running"), "breach")

    return query


def _budget_sql(column, cap):
    return f"""WITH {src.USAGE_SQL}, r AS (SELECT run_id, event_id, CAST({column} AS DECIMAL(28, 9)) AS own,
  sum(CAST({column} AS DECIMAL(28, 9))) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM usage)
SELECT run_id, event_id, CAST(total AS DOUBLE) AS running, own > {cap} OR total > {cap} AS breach FROM r"""


def first_breach(spark, sf):
    rows = src.usage(spark, sf).select("run_id", "ts", "event_id", "cost_usd")
    breaches = gt.limit_breaches(rows, "cost_usd", 1.5, ["ts", "event_id"], _minute(F.col("ts")))
    first = gt.first_breach(breaches, ["ts", "event_id"])
    return first.select("run_id", "event_id", "cost_usd", F.col("running").cast("double").alias("running"))


FIRST_BREACH = f"""WITH {src.USAGE_SQL}, r AS (SELECT *, sum(CAST(cost_usd AS DECIMAL(28, 9))) OVER
    (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM usage),
b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS n FROM r WHERE cost_usd > 1.5 OR total > 1.5)
SELECT run_id, event_id, cost_usd, CAST(total AS DOUBLE) AS running FROM b WHERE n = 1"""


def effective_limits(spark, sf):
    o = src.table(spark, sf, "orders")
    requested = F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice"))
    configured = F.when(F.col("o_orderkey") % 7 == 0, F.lit(0.0)).otherwise((F.col("o_custkey") * 100).cast("double"))
    return o.select("o_orderkey", gt.effective_limit(requested, configured).alias("effective"))


EFFECTIVE_LIMITS = """WITH l AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END AS requested,
  CASE WHEN o_orderkey % 7 = 0 THEN 0.0::DOUBLE ELSE (o_custkey * 100)::DOUBLE END AS configured FROM orders)
SELECT o_orderkey, CASE WHEN requested IS NULL THEN configured WHEN configured = 0 THEN requested
  ELSE least(requested, configured) END AS effective FROM l"""


def run_configuration(spark, sf):
    """Every order is a run of the parts it holds."""
    items = src.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("scenario_id")
    )
    # Nearly all rows differ: dealt out by run, the hash tables of a task hold its share of the rows, however many there are.
    tasks = tasks_for(items)
    selected = items.repartition(tasks, "run_id").distinct().join(src.scenarios(spark, sf).select("scenario_id", "file_name", "tags"), "scenario_id")
    selected = selected.repartition(tasks, "run_id")
    out = gt.run_configuration(selected, k=3, max_cost_usd=2.5)
    return out.withColumns({c: F.array_join(c, ",") for c in ("scenario_ids", "scenario_tags")})


RUN_CONFIGURATION = f"""WITH {src.SCENARIOS_SQL}, selected AS (
  SELECT DISTINCT l_orderkey AS run_id, scenario_id, file_name, tags FROM lineitem JOIN scenarios ON scenario_id = 'part_' || l_partkey),
ids AS (SELECT run_id, string_agg(scenario_id, ',' ORDER BY file_name) AS scenario_ids FROM selected GROUP BY ALL), t AS (
  SELECT run_id, string_agg(tag, ',' ORDER BY tag) AS scenario_tags
  FROM (SELECT DISTINCT run_id, unnest(tags) AS tag FROM selected) GROUP BY ALL)
SELECT i.run_id, '2026.1' AS suite_version, '2026.1' AS prompt_version, '2026.1' AS tool_schema_version, 3 AS k, scenario_ids,
  scenario_tags, 2.5::DOUBLE AS max_cost_usd, 0.0::DOUBLE AS max_duration_seconds FROM ids i JOIN t ON t.run_id = i.run_id"""


# --- report tables ---------------------------------------------------------------------------------------


def rounded_metrics(spark, sf):
    return rp.rounded_metrics(mt.outcome_metrics(item_attempts(spark, sf)))


ROUNDED_METRICS = f"""WITH {ITEM_ATTEMPTS_SQL}, {_OUTCOME_METRICS_SQL}
SELECT * REPLACE ({", ".join(f"{_ROUND_4.format(c)} AS {c}" for c in ("pass_rate", "pass_all_k", "pass_at_1", "pass_any", "reliability_drop", "violation_detection_rate", "false_positive_rate", "weighted_score"))})
FROM outcome"""


def violations_table(spark, sf):
    return rp.violations_table(mt.violations_by_regulation(src.results(spark, sf)), _registry(spark, sf))


VIOLATIONS_TABLE = f"""WITH {src.RESULTS_SQL}, {_CITED_SQL}, {src.REGISTRY_SQL}
SELECT run_id, regulation, coalesce(name, regulation) AS name, coalesce(authority, '') AS authority, violations
FROM counts LEFT JOIN registry ON id = regulation"""


def scenario_table(spark, sf):
    attempts = checkpointed(conversation_attempts(spark, sf))
    return rp.scenario_table(attempts, ck.results_of(attempts), k=2)


SCENARIO_TABLE = f"""WITH {CONVERSATION_ATTEMPTS_SQL}, failed AS (
  SELECT run_id, scenario_id, attempt, string_agg(check_id, ', ' ORDER BY check_pos) AS failed_checks
  FROM results WHERE NOT passed GROUP BY ALL)
SELECT a.run_id, a.scenario_id, a.attempt, title, label, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS result,
  coalesce(failed_checks, '—') AS failed_checks, a.attempt + 1 AS attempt_no
FROM attempts a LEFT JOIN failed f ON f.run_id = a.run_id AND f.scenario_id = a.scenario_id AND f.attempt = a.attempt"""


def scenario_search(spark, sf):
    found = rp.search_scenarios(src.scenarios(spark, sf), "RED")
    return found.select("scenario_id", "title", "label")


SCENARIO_SEARCH = f"""WITH {src.SCENARIOS_SQL} SELECT scenario_id, title, label FROM scenarios
WHERE contains(lower(title), 'red') OR contains(lower(scenario_id), 'red')"""


def health_tones(spark, sf):
    return rp.health_tones(mt.outcome_metrics(document_attempts(spark, sf)))


_TONE = "CASE WHEN {0} >= 0.9 THEN 'ok' WHEN {0} >= 0.6 THEN 'warn' ELSE 'bad' END"
HEALTH_TONES = f"""WITH {DOCUMENT_ATTEMPTS_SQL}, {_OUTCOME_METRICS_SQL}, shown AS (
  SELECT run_id, {_ROUND_4.format('pass_rate')} AS pass_rate, {_ROUND_4.format('weighted_score')} AS weighted_score,
    {_ROUND_4.format('false_positive_rate')} AS fp FROM outcome)
SELECT run_id, {_TONE.format('pass_rate')} AS pass_rate_tone, CASE WHEN fp = 0 THEN 'ok' ELSE 'bad' END AS false_positive_tone,
  {_TONE.format('weighted_score')} AS weighted_score_tone, CASE WHEN pass_rate >= 0.9 THEN 'pass' ELSE 'fail' END AS history_badge
FROM shown"""


QUERIES = {
    "outcome_metrics_conversations": (_outcomes_of(conversation_attempts), _outcomes_sql(CONVERSATION_ATTEMPTS_SQL)),
    "outcome_metrics_documents": (_outcomes_of(document_attempts), _outcomes_sql(DOCUMENT_ATTEMPTS_SQL)),
    "outcome_metrics_items": (_outcomes_of(item_attempts), _outcomes_sql(ITEM_ATTEMPTS_SQL)),
    "violations_by_severity": (by_severity, BY_SEVERITY),
    "violations_by_regulation": (by_regulation, BY_REGULATION),
    "regulation_coverage": (coverage, COVERAGE),
    "latency_percentiles": (latency_percentiles, LATENCY_PERCENTILES),
    "price_percentiles": (price_percentiles, PRICE_PERCENTILES),
    "usage_metrics": (usage_metrics, USAGE_METRICS),
    "run_metrics": (run_metrics, RUN_METRICS),
    "run_metrics_items": (item_run_metrics, ITEM_RUN_METRICS),
    "gates": (gates, GATES),
    "budget_cost": (_budget("cost_usd", 2.0), _budget_sql("cost_usd", 2.0)),
    "budget_duration": (_budget("latency_ms", 900.0), _budget_sql("latency_ms", 900.0)),
    "budget_first_breach": (first_breach, FIRST_BREACH),
    "effective_limits": (effective_limits, EFFECTIVE_LIMITS),
    "run_configuration": (run_configuration, RUN_CONFIGURATION),
    "report_rounded_metrics": (rounded_metrics, ROUNDED_METRICS),
    "report_violations": (violations_table, VIOLATIONS_TABLE),
    "report_scenarios": (scenario_table, SCENARIO_TABLE),
    "report_scenario_search": (scenario_search, SCENARIO_SEARCH),
    "report_health_tones": (health_tones, HEALTH_TONES),
}
