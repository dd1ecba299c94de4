"""Queries that evaluate checks on conversations, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions.judge import (
    CLEAR_REASON,
    JUDGE_SYSTEM,
    MISLEADING_MARKERS,
    MISLEADING_REASON,
    RESPONSE_HEAD,
    RESPONSE_TAIL,
    RUBRIC_HEAD,
)
from auditlake.functions.pii import Detector, register
from auditlake.operators import checks as ck
from auditlake.operators import judging as jd
from auditlake.operators import transcripts as tr
from auditlake.plans import inputs as src
from auditlake.schemas import ATTEMPT_KEY

K = list(ATTEMPT_KEY)
SHOWN = [*K, "check_pos", "check_id", "type", "passed", "severity", "message", "evidence"]


def _shown(results):
    return results.select(*SHOWN, F.array_join("regulations", ",").alias("regulations"))


# --- conversations, one kind at a time -------------------------------------------------------


def _on_conversations(types):
    def query(spark, sf):
        evaluated = ck.evaluate_turns(
            src.turns(spark, sf),
            src.rules(spark, types),
            check_types=ck.only(*types),
            known_patterns=src.known_patterns() if "regex" in types else (),
        )
        return _shown(ck.results_of(evaluated))

    return query


_TARGET = "CASE WHEN scope = 'all' THEN all_text ELSE agent_text END"
_HAS = "CASE WHEN case_sensitive THEN contains(target, p) ELSE contains(lower(target), lower(p)) END"
_MATCH = "CASE WHEN case_sensitive THEN regexp_matches(target, p) ELSE regexp_matches(target, p, 'i') END"


def _verdict(kind: str, bad: str, good: str, evidence: str, failing: str) -> str:
    """One SELECT over ``judged`` for a kind that lists its evidence when it fails."""
    return f"""SELECT *, NOT ({failing}) AS passed, CASE WHEN {failing} THEN '{bad}' ELSE '{good}' END AS message,
      CASE WHEN {failing} THEN {evidence} ELSE '' END AS evidence FROM judged WHERE type = '{kind}'"""


def _list(test: str) -> str:
    return f"list_filter(patterns, lambda p: {test})"


_PII_FOUND = "list_filter(findings, lambda f: len(pii_types) = 0 OR list_contains(pii_types, f.kind))"
_PII_PREVIEWS = (
    f"array_to_string(list_sort(list_distinct(list_transform({_PII_FOUND}, lambda f: {src.preview_sql('f.kind', 'f.value')}))), ', ')"
)
_LENGTH = f"length(trim(target, {src.WS_SQL}))"

KIND_SQL = {
    "required_phrase": _verdict(
        "required_phrase", "Missing required disclosure(s).", "All required disclosures present.",
        f"array_to_string({_list('NOT ' + _HAS)}, '; ')", f"len({_list('NOT ' + _HAS)}) > 0"),
    "prohibited_phrase": _verdict(
        "prohibited_phrase", "Prohibited statement found.", "No prohibited statements.",
        f"array_to_string({_list(_HAS)}, '; ')", f"len({_list(_HAS)}) > 0"),
    "regex": f"""SELECT *, CASE WHEN must_appear THEN len(missing) = 0 ELSE len(matched) = 0 END AS passed,
      CASE WHEN must_appear THEN CASE WHEN len(missing) = 0 THEN 'Required pattern(s) present.' ELSE 'Required pattern(s) missing.' END
           ELSE CASE WHEN len(matched) = 0 THEN 'No forbidden pattern matched.' ELSE 'Forbidden pattern matched.' END END AS message,
      CASE WHEN must_appear THEN array_to_string(missing, '; ') ELSE array_to_string(matched, '; ') END AS evidence
      FROM (SELECT *, {_list(_MATCH)} AS matched, {_list('NOT ' + _MATCH)} AS missing FROM judged WHERE type = 'regex')""",
    "no_pii_leak": _verdict(
        "no_pii_leak", "Agent exposed protected personal data.", "No PII leak detected in agent output.",
        _PII_PREVIEWS, f"len({_PII_FOUND}) > 0"),
    "min_length": f"""SELECT *, {_LENGTH} >= coalesce(nullif(min_length, 0), 10) AS passed,
      'Response length is ' || {_LENGTH} || ' characters.' AS message,
      'min required: ' || coalesce(nullif(min_length, 0), 10) AS evidence FROM judged WHERE type = 'min_length'""",
    "max_length": f"""SELECT *, {_LENGTH} <= coalesce(nullif(max_length, 0), 1000) AS passed,
      'Response length is ' || {_LENGTH} || ' characters.' AS message,
      'max allowed: ' || coalesce(nullif(max_length, 0), 1000) AS evidence FROM judged WHERE type = 'max_length'""",
    "json_valid": f"""SELECT *, json_valid(trim(target, {src.WS_SQL})) AS passed,
      CASE WHEN json_valid(trim(target, {src.WS_SQL})) THEN 'Valid JSON response.' ELSE 'Invalid JSON response.' END AS message,
      '' AS evidence FROM judged WHERE type = 'json_valid'""",
}


def judged_sql(texts: str, rules: str, pii_kinds=("credit_card", "email", "phone")) -> str:
    """``judged``: attempts with the checks of their scenario and the text each check reads."""
    return f"""{texts}, {rules}, scoped AS (
  SELECT run_id, t.scenario_id, attempt, {_TARGET} AS target, r.* EXCLUDE (scenario_id)
  FROM texts t JOIN rules r ON r.scenario_id = t.scenario_id), judged AS (
  SELECT *, CASE WHEN type = 'no_pii_leak' THEN {src.findings_sql('target', pii_kinds)} END AS findings FROM scoped)"""


def result_rows_sql(kinds) -> str:
    columns = ", ".join(SHOWN) + ", array_to_string(regulations, ',') AS regulations"
    return " UNION ALL ".join(f"SELECT {columns} FROM ({KIND_SQL[k]})" for k in kinds)


def results_sql(texts: str, rules: str, kinds) -> str:
    return f"WITH {judged_sql(texts, rules)} {result_rows_sql(kinds)}"


TEXT_KINDS = list(KIND_SQL)


def screened_turns(spark, sf):
    """Phrase and line-bound pattern checks decided turn by turn."""
    results = ck.screen_turns(
        src.turns(spark, sf),
        src.rules(spark, ["required_phrase", "prohibited_phrase"]),
    )
    return _shown(results)


def forbidden_in_turns(spark, sf):
    """Every turn with the forbidden phrases in it."""
    return ck.forbidden_in_turns(src.turns(spark, sf), src.rules(spark, ["prohibited_phrase"]))


FORBIDDEN_IN_TURNS = f"""WITH {src.TURNS_SQL}, {src.rules_sql(["prohibited_phrase"])}, said AS (
  SELECT run_id, t.scenario_id, attempt, turn, role, content AS target, r.* EXCLUDE (scenario_id)
  FROM turns t JOIN rules r ON r.scenario_id = t.scenario_id WHERE scope = 'all' OR role = 'agent')
SELECT run_id, scenario_id, attempt, turn, check_id, type, severity, unnest({_list(_HAS)}) AS evidence FROM said"""


# --- documents as agent texts, one scenario per language ---------------------------------------


def document_rules() -> list[dict]:
    base = src.rule_rows()[0]
    rows = []
    for i, lang in enumerate(["en", "fr", "de", "es"]):
        common = base | {"scenario_id": lang, "scope": "agent", "severity": src.SEVERITIES[i + 1], "case_sensitive": i % 2 == 0}
        rows += [
            common | {"check_pos": 0, "check_id": "phrases", "type": "prohibited_phrase", "patterns": ["password", "token", "License"]},
            common | {"check_pos": 1, "check_id": "must_match", "type": "regex", "patterns": ["[A-Z][a-z]+ [a-z]+", "[0-9]{3}"]},
            common | {"check_pos": 2, "check_id": "must_not", "type": "regex", "patterns": ["@[a-z]+", "copyright", "[0-9]{4}-[0-9]{4}"], "must_appear": False},
            common | {"check_pos": 3, "check_id": "pii", "type": "no_pii_leak", "patterns": [], "pii_types": [["email"], [], ["credit_card", "phone"], ["phone"]][i]},
            common | {"check_pos": 4, "check_id": "short", "type": "max_length", "patterns": [], "max_length": 500 * i},
        ]
    return rows


def document_attempts(spark, sf):
    d = src.texts(spark, sf, "documents")
    return d.select(
        F.col("source").alias("run_id"), F.col("lang").alias("scenario_id"), F.col("doc_id").cast("int").alias("attempt"),
        F.col("text").alias("agent_text"),
    )


DOCUMENT_TEXTS_SQL = """texts AS (SELECT source AS run_id, lang AS scenario_id, CAST(doc_id AS INTEGER) AS attempt,
  text AS agent_text, text AS all_text FROM documents)"""


def _on_documents(types):
    def query(spark, sf):
        rows = document_rules()
        evaluated = ck.evaluate_attempts(
            document_attempts(spark, sf),
            src.rules(spark, types, rows),
            ck.only(*types),
            known_patterns=src.known_patterns(rows) if "regex" in types else (),
        )
        return _shown(ck.results_of(evaluated))

    return query


# --- events as tool calls, usage and JSON answers -------------------------------------------------


def tool_rules() -> list[dict]:
    base = src.rule_rows()[0]
    rows = []
    for i in range(16):
        common = base | {"scenario_id": f"s{i:02d}", "scope": "agent", "severity": "high"}
        rows += [
            common | {"check_pos": 0, "check_id": "tools", "type": "tool_call_expected", "patterns": ["purchase", "signup", "refund"][: i % 3 + 1]},
            common | {"check_pos": 1, "check_id": "no_tools", "type": "tool_call_forbidden", "patterns": ["error", "view"][i % 2 :]},
        ]
    return rows


def tool_checks(spark, sf):
    return _shown(ck.screen_turns(src.event_turns(spark, sf), src.rules(spark, rows=tool_rules())))


TOOL_CHECKS = f"""WITH {src.rules_sql(rows=tool_rules())}, called AS (
  SELECT 'run_' || (user_id % 7) AS run_id, 's' || lpad(CAST(user_id % 16 AS VARCHAR), 2, '0') AS scenario_id,
         CAST(user_id AS INTEGER) AS attempt, list(DISTINCT event_type) AS tools FROM events GROUP BY ALL),
found AS (
  SELECT run_id, c.scenario_id, attempt, r.* EXCLUDE (scenario_id),
         list_filter(patterns, lambda p: list_contains(tools, p) = (type = 'tool_call_forbidden')) AS bad
  FROM called c JOIN rules r ON r.scenario_id = c.scenario_id)
SELECT run_id, scenario_id, attempt, check_pos, check_id, type, len(bad) = 0 AS passed, severity,
  CASE WHEN type = 'tool_call_expected' THEN
         CASE WHEN len(bad) = 0 THEN 'Required backend tool call(s) made.' ELSE 'Expected backend tool was not called.' END
       ELSE CASE WHEN len(bad) = 0 THEN 'No forbidden tool calls.' ELSE 'Agent invoked a forbidden/unauthorized tool.' END
  END AS message, array_to_string(bad, '; ') AS evidence, array_to_string(regulations, ',') AS regulations FROM found"""


def latency_rules() -> list[dict]:
    base = src.rule_rows()[0]
    rows = []
    for i in range(16):
        common = base | {"scenario_id": f"s{i:02d}", "patterns": [], "scope": "agent"}
        limit = {"type": "max_latency", "max_latency_ms": 250.0 * i}
        rows += [
            common | limit | {"check_pos": 0, "check_id": "fast_before_judges"},
            common | {"check_pos": 1, "check_id": "judge_1", "type": "llm_judge"},
            common | {"check_pos": 2, "check_id": "judge_2", "type": "llm_judge"},
            common | limit | {"check_pos": 3, "check_id": "fast_between"},
            common | {"check_pos": 4, "check_id": "judge_4", "type": "llm_judge"},
            common | limit | {"check_pos": 5, "check_id": "fast_after_judges"},
        ]
    return rows


def latency_checks(spark, sf):
    """Latency limits before, between and after the judge calls of an attempt."""
    u = src.usage(spark, sf)
    agent = u.filter("source = 'agent'").groupBy(*K).agg(F.sum(F.col("latency_ms").cast(tr.MONEY)).cast("double").alias("agent_latency_ms"))
    judge = (
        u.filter("source = 'judge'")
        .groupBy(*K, "check_pos")
        .agg(F.sum(F.col("latency_ms").cast(tr.MONEY)).cast("double").alias("latency_ms"))
        .withColumn("content", F.lit("yes"))
    )
    attempts = agent.join(ck.judge_answers(judge), K, "left")
    results = ck.results_of(ck.evaluate_attempts(attempts, src.rules(spark, rows=latency_rules()), ck.only("max_latency", "llm_judge")))
    return results.filter("type = 'max_latency'").select(*K, "check_pos", "check_id", "passed")


LATENCY_CHECKS = f"""WITH {src.USAGE_SQL}, {src.rules_sql(rows=latency_rules())}, agent AS (
  SELECT run_id, scenario_id, attempt, CAST(sum(CAST(latency_ms AS DECIMAL(28, 9))) AS DOUBLE) AS agent_ms
  FROM usage WHERE source = 'agent' GROUP BY ALL), judge AS (
  SELECT run_id, scenario_id, attempt, check_pos, CAST(sum(CAST(latency_ms AS DECIMAL(28, 9))) AS DOUBLE) AS ms
  FROM usage WHERE source = 'judge' GROUP BY ALL)
SELECT a.run_id, a.scenario_id, a.attempt, r.check_pos, r.check_id,
  agent_ms + coalesce((SELECT sum(ms) FROM judge j WHERE j.run_id = a.run_id AND j.scenario_id = a.scenario_id
    AND j.attempt = a.attempt AND j.check_pos < r.check_pos AND j.check_pos IN (1, 2, 4)), 0)
  <= coalesce(nullif(r.max_latency_ms, 0), 5000) AS passed
FROM agent a JOIN rules r ON r.scenario_id = a.scenario_id WHERE r.type = 'max_latency'"""


def json_answers(spark, sf):
    """Event properties as agent answers, some of them broken."""
    e = src.table(spark, sf, "events")
    p, m = F.col("props"), F.col("event_id") % 6
    text = (
        F.when(m == 0, p)
        .when(m == 1, F.concat(F.lit(" \n"), p, F.lit("\t")))
        .when(m == 2, F.concat(p, F.lit(" x")))
        .when(m == 3, F.concat(p, F.lit(","), p))
        .when(m == 4, F.concat(F.lit('{"a": ['), p, F.lit(", null, "), p, F.lit("]}")))
        .otherwise(F.col("event_id").cast("string"))
    )
    attempts = e.select(
        F.col("event_type").alias("run_id"), F.lit("answers").alias("scenario_id"),
        F.col("event_id").cast("int").alias("attempt"), text.alias("agent_text"),
    )
    rule = src.rule_rows()[0] | {"scenario_id": "answers", "check_pos": 0, "check_id": "json", "type": "json_valid", "scope": "agent"}
    results = ck.results_of(ck.evaluate_attempts(attempts, src.rules(spark, rows=[rule]), ck.only("json_valid")))
    return results.select(*K, "check_id", "passed", "message")


JSON_ANSWERS = """WITH answers AS (SELECT event_type AS run_id, CAST(event_id AS INTEGER) AS attempt,
  CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN ' ' || chr(10) || props || chr(9) WHEN 2 THEN props || ' x'
    WHEN 3 THEN props || ',' || props WHEN 4 THEN '{"a": [' || props || ', null, ' || props || ']}'
    ELSE CAST(event_id AS VARCHAR) END AS t FROM events)
SELECT run_id, 'answers' AS scenario_id, attempt, 'json' AS check_id, json_valid(t) AS passed,
  CASE WHEN json_valid(t) THEN 'Valid JSON response.' ELSE 'Invalid JSON response.' END AS message FROM answers"""


# --- judge ------------------------------------------------------------------------------------------


def _judged_attempts(spark, sf):
    """Agent texts of the conversations; every fourth attempt ends with misleading words."""
    texts = tr.agent_texts(src.turns(spark, sf))
    marked = F.concat("agent_text", F.lit(" This is RISK-FREE."))
    return texts.withColumn("agent_text", F.when(F.substring("scenario_id", 2, 2).cast("int") % 4 == 1, marked).otherwise(F.col("agent_text")))


_JUDGED_SQL = f"""{src.TEXTS_SQL}, {src.rules_sql(["llm_judge"])}, marked AS (
  SELECT run_id, scenario_id, attempt, CASE WHEN CAST(scenario_id[2:3] AS INTEGER) % 4 = 1
    THEN agent_text || ' This is RISK-FREE.' ELSE agent_text END AS agent_text FROM texts), requests AS (
  SELECT run_id, m.scenario_id, attempt, check_pos, check_id, judge_pass_if,
    {src.sql_value(JUDGE_SYSTEM)} AS system,
    {src.sql_value(RUBRIC_HEAD)} || rubric || {src.sql_value(RESPONSE_HEAD)} || agent_text || {src.sql_value(RESPONSE_TAIL)} AS "user"
  FROM marked m JOIN rules r ON r.scenario_id = m.scenario_id)"""

_MARKERS_SQL = " OR ".join(f"contains(graded, {src.sql_value(m)})" for m in MISLEADING_MARKERS)
_ANSWERS_SQL = (
    _JUDGED_SQL
    + rf""", graded AS (
  SELECT *, lower(regexp_extract("user", '(?s)AGENT RESPONSE:\s*"{{3}}\s*(.*?)\s*"{{3}}', 1)) AS graded FROM requests), answers AS (
  SELECT *, CASE WHEN {_MARKERS_SQL} THEN 'no' || chr(10) || '{MISLEADING_REASON}' ELSE 'yes' || chr(10) || '{CLEAR_REASON}' END AS content
  FROM graded)"""
)


def judge_requests(spark, sf):
    return jd.judge_requests(_judged_attempts(spark, sf), src.rules(spark))


JUDGE_REQUESTS = f'WITH {_JUDGED_SQL} SELECT run_id, scenario_id, attempt, check_pos, check_id, judge_pass_if, system, "user" FROM requests'


def marker_judge(spark, sf):
    return jd.answer_by_markers(jd.judge_requests(_judged_attempts(spark, sf), src.rules(spark)))


MARKER_JUDGE = f"""WITH {_ANSWERS_SQL} SELECT run_id, scenario_id, attempt, check_pos, check_id, content, 'judge' AS source,
  200::BIGINT AS prompt_tokens, 20::BIGINT AS completion_tokens, 0.0::DOUBLE AS cost_usd, 1.0::DOUBLE AS latency_ms,
  1::BIGINT AS model_calls FROM answers"""


def _varied_responses(spark, sf):
    """Marker-judge answers in the many forms real judges write them."""
    n = F.col("attempt") + F.substring("scenario_id", 2, 2).cast("int")
    form = (
        F.when(n % 6 == 0, F.upper("content"))
        .when(n % 6 == 1, F.concat(F.lit("\n  "), F.replace("content", F.lit("\n"), F.lit("!.\n"))))
        .when(n % 6 == 2, F.lit("maybe\nhard to say"))
        .when(n % 6 == 3, F.replace("content", F.lit("\n"), F.lit(" .\n")))
        .when(n % 6 == 4, F.lit("No"))
        .otherwise(F.col("content"))
    )
    requests = jd.judge_requests(_judged_attempts(spark, sf), src.rules(spark))
    return requests, jd.answer_by_markers(requests).withColumn("content", form)


_VERDICTS_SQL = (
    _ANSWERS_SQL
    + f""", varied AS (
  SELECT *, CASE n % 6 WHEN 0 THEN upper(content) WHEN 1 THEN chr(10) || '  ' || replace(content, chr(10), '!.' || chr(10))
      WHEN 2 THEN 'maybe' || chr(10) || 'hard to say' WHEN 3 THEN replace(content, chr(10), ' .' || chr(10))
      WHEN 4 THEN 'No' ELSE content END AS answer
  FROM (SELECT *, attempt + CAST(scenario_id[2:3] AS INTEGER) AS n FROM answers)), read AS (
  SELECT *, trim(lower(trim(split_part(trim(answer, {src.WS_SQL}), chr(10), 1), {src.WS_SQL})), '.:!') AS verdict,
    CASE WHEN contains(trim(answer, {src.WS_SQL}), chr(10))
      THEN trim(trim(answer, {src.WS_SQL})[strpos(trim(answer, {src.WS_SQL}), chr(10)) + 1:], {src.WS_SQL}) ELSE '' END AS reason
  FROM varied), parsed AS (
  SELECT *, verdict IN ('yes', 'no') AS parsed, verdict IN ('yes', 'no') AND verdict = lower(trim(judge_pass_if)) AS passed
  FROM read)"""
)


def judge_verdicts(spark, sf):
    return jd.verdicts(*_varied_responses(spark, sf))


JUDGE_VERDICTS = f"""WITH {_VERDICTS_SQL} SELECT run_id, scenario_id, attempt, check_pos, check_id, verdict, parsed, passed,
  CASE WHEN parsed THEN 'LLM-judge verdict: ' || verdict || '.' ELSE 'LLM-judge verdict was inconclusive/unparsed.' END AS message,
  reason AS evidence FROM parsed"""


def judge_inconclusive(spark, sf):
    return jd.inconclusive_rate(jd.verdicts(*_varied_responses(spark, sf)))


JUDGE_INCONCLUSIVE = f"""WITH {_VERDICTS_SQL} SELECT run_id, count(*) AS verdicts, count(*) FILTER (WHERE NOT parsed) AS inconclusive,
  count(*) FILTER (WHERE NOT parsed) / count(*)::DOUBLE AS inconclusive_rate FROM parsed GROUP BY run_id"""


# --- dispatch, outcomes ------------------------------------------------------------------------------


def evaluated_conversations(spark, sf):
    """All check kinds of the rule catalog, the judge answered by markers."""
    t = src.turns(spark, sf)
    rules = src.rules(spark)
    judge = jd.answer_by_markers(jd.judge_requests(tr.agent_texts(t), rules))
    return ck.evaluate_turns(t, rules, judge=judge, known_patterns=src.known_patterns())


def dispatched_checks(spark, sf):
    return _shown(ck.results_of(evaluated_conversations(spark, sf)))


# No conversation holds a misleading marker, so every judge answer is the clear one; the inputs test checks it.
KIND_SQL["llm_judge"] = f"""SELECT *, lower(trim(judge_pass_if)) = 'yes' AS passed, 'LLM-judge verdict: yes.' AS message,
  '{CLEAR_REASON}' AS evidence FROM judged WHERE type = 'llm_judge'"""
ALL_KINDS = [*TEXT_KINDS, "llm_judge"]
DISPATCHED_SQL = f"{judged_sql(src.TEXTS_SQL, src.rules_sql())}, results AS ({result_rows_sql(ALL_KINDS)})"
DISPATCHED_CHECKS = f"WITH {DISPATCHED_SQL} SELECT * FROM results"

OUTCOMES_SQL = f"""{DISPATCHED_SQL}, outcomes AS (
  SELECT t.run_id, t.scenario_id, t.attempt, coalesce(bool_and(passed), TRUE) AS passed,
    count(*) FILTER (WHERE NOT passed) AS violations,
    CAST(coalesce(sum({src.WEIGHT_SQL}) FILTER (WHERE NOT passed), 0) AS BIGINT) AS violation_weight,
    CAST(coalesce(sum(CASE WHEN severity IS NULL THEN 0 ELSE {src.WEIGHT_SQL} END), 0) AS BIGINT) AS possible_weight
  FROM texts t LEFT JOIN results r ON r.run_id = t.run_id AND r.scenario_id = t.scenario_id AND r.attempt = t.attempt
  GROUP BY ALL)"""


def scenario_outcomes(spark, sf):
    return ck.with_outcome(evaluated_conversations(spark, sf)).drop("check_results")


SCENARIO_OUTCOMES = f"WITH {OUTCOMES_SQL} SELECT * FROM outcomes"


def attempt_outcomes(spark, sf):
    """Outcomes of line items as flat result rows; attempts without results pass."""
    r = src.results(spark, sf)
    orders = src.table(spark, sf, "orders").select(F.col("o_orderkey").cast("int").alias("attempt"), F.col("o_orderstatus").alias("status"))
    keyed = r.withColumn("status", F.lit(None)).select("attempt", "passed", "severity")
    return ck.scenario_outcomes(orders, keyed, ["attempt"])


ATTEMPT_OUTCOMES = f"""WITH {src.RESULTS_SQL}
SELECT CAST(o_orderkey AS INTEGER) AS attempt, o_orderstatus AS status, coalesce(bool_and(passed), TRUE) AS passed,
  count(*) FILTER (WHERE NOT passed) AS violations,
  CAST(coalesce(sum({src.WEIGHT_SQL}) FILTER (WHERE NOT passed), 0) AS BIGINT) AS violation_weight,
  CAST(coalesce(sum(CASE WHEN severity IS NULL THEN 0 ELSE {src.WEIGHT_SQL} END), 0) AS BIGINT) AS possible_weight
FROM orders LEFT JOIN results ON attempt = o_orderkey GROUP BY o_orderkey, o_orderstatus"""


def violations(spark, sf):
    return _shown(ck.violations_of(ck.results_of(evaluated_conversations(spark, sf))))


VIOLATIONS = f"WITH {DISPATCHED_SQL} SELECT * FROM results WHERE NOT passed"


def severity_weights(spark, sf):
    r = src.results(spark, sf)
    return r.groupBy("severity").agg(
        F.count("*").alias("checks"), F.sum(ck.severity_weight(F.col("severity"))).alias("weight")
    )


SEVERITY_WEIGHTS = f"""WITH {src.RESULTS_SQL} SELECT severity, count(*) AS checks,
  CAST(sum({src.WEIGHT_SQL}) AS BIGINT) AS weight FROM results GROUP BY severity"""


# --- extensions ----------------------------------------------------------------------------------------


def ends_with_period(check, seen):
    """A check kind of its own: the text must end with a period."""
    ok = F.endswith(seen.target(check), F.lit("."))
    return F.struct(ok.alias("passed"), F.lit("Last character checked.").alias("message"), F.right(seen.target(check), F.lit(1)).alias("evidence"))


def custom_check_type(spark, sf):
    types = ck.register_check_type("ends_with_period", ends_with_period, ck.only("json_valid"))
    rule = src.rule_rows()[0] | {"check_pos": 0, "check_id": "period", "type": "ends_with_period", "patterns": [], "scope": "agent"}
    rows = [rule | {"scenario_id": lang} for lang in ("en", "fr", "de", "es")]
    evaluated = ck.evaluate_attempts(document_attempts(spark, sf), src.rules(spark, rows=rows), types)
    return ck.results_of(evaluated).select(*K, "check_id", "passed", "evidence")


CUSTOM_CHECK_TYPE = f"""WITH {DOCUMENT_TEXTS_SQL} SELECT run_id, scenario_id, attempt, 'period' AS check_id,
  ends_with(agent_text, '.') AS passed, right(agent_text, 1) AS evidence FROM texts"""


SECRET = Detector("secret_token", r'token = "([0-9a-f]+)"', group=1, needs=lambda t: F.contains(t, F.lit("token")))


def custom_detector(spark, sf):
    from auditlake.operators.profile import findings_of

    found = findings_of(src.texts(spark, sf, "documents"), "text", ["doc_id"], ["secret_token"], register(SECRET))
    return found.select("doc_id", "type", "value", "preview")


CUSTOM_DETECTOR = f"""WITH hits AS (SELECT DISTINCT doc_id, 'secret_token' AS type,
  unnest(regexp_extract_all(text, 'token = "([0-9a-f]+)"', 1)) AS value FROM documents)
SELECT doc_id, type, value, {src.preview_sql('type', 'value')} AS preview FROM hits"""


QUERIES = {
    f"check_{kind}": (_on_conversations([kind]), results_sql(src.TEXTS_SQL, src.rules_sql([kind]), [kind]))
    for kind in TEXT_KINDS
}
QUERIES |= {
    "check_phrases_turn_by_turn": (
        screened_turns,
        results_sql(src.TEXTS_SQL, src.rules_sql(["required_phrase", "prohibited_phrase"]), ["required_phrase", "prohibited_phrase"]),
    ),
    **{
        f"documents_{kind}": (
            _on_documents([kind]),
            results_sql(DOCUMENT_TEXTS_SQL, src.rules_sql([kind], document_rules()), [kind]),
        )
        for kind in ("prohibited_phrase", "regex", "no_pii_leak", "max_length")
    },
    "forbidden_in_turns": (forbidden_in_turns, FORBIDDEN_IN_TURNS),
    "check_tool_calls": (tool_checks, TOOL_CHECKS),
    "check_max_latency": (latency_checks, LATENCY_CHECKS),
    "check_json_answers": (json_answers, JSON_ANSWERS),
    "judge_requests": (judge_requests, JUDGE_REQUESTS),
    "judge_markers": (marker_judge, MARKER_JUDGE),
    "judge_verdicts": (judge_verdicts, JUDGE_VERDICTS),
    "judge_inconclusive": (judge_inconclusive, JUDGE_INCONCLUSIVE),
    "checks_dispatched": (dispatched_checks, DISPATCHED_CHECKS),
    "scenario_outcomes": (scenario_outcomes, SCENARIO_OUTCOMES),
    "attempt_outcomes": (attempt_outcomes, ATTEMPT_OUTCOMES),
    "violations": (violations, VIOLATIONS),
    "severity_weights": (severity_weights, SEVERITY_WEIGHTS),
    "custom_check_type": (custom_check_type, CUSTOM_CHECK_TYPE),
    "custom_detector": (custom_detector, CUSTOM_DETECTOR),
}
