"""The driver's tables seen as transcripts, catalogs, usage and run history.

Every view exists twice: as a DataFrame for the operators and as a SQL common table expression for the check
against DuckDB. Views are computed from whole tables and grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import configure, local_table, spread

SEVERITIES = ["info", "low", "medium", "high", "critical"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are scanned, on all cores."""
    return spread(table(spark, sf_dir, name))


# --- conversations as turns ------------------------------------------------------------------
# 3 runs of 16 scenarios; conversations with the same remainders are repeated attempts.


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = texts(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("run_"), (F.col("conv_id") % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("s"), F.lpad((F.col("conv_id") % 16).cast("string"), 2, "0")).alias("scenario_id"),
        F.floor(F.col("conv_id") / 48).cast("int").alias("attempt"),
        F.col("turn").cast("int").alias("turn"),
        F.when(F.col("role") == "user", F.lit("customer"))
        .when(F.col("role") == "assistant", F.lit("agent"))
        .otherwise(F.col("role"))
        .alias("role"),
        F.col("text").alias("content"),
    )


TURNS_SQL = """turns AS (
  SELECT 'run_' || (conv_id % 3) AS run_id, 's' || lpad(CAST(conv_id % 16 AS VARCHAR), 2, '0') AS scenario_id,
         CAST(conv_id // 48 AS INTEGER) AS attempt, CAST(turn AS INTEGER) AS turn,
         CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'agent' ELSE role END AS role, text AS content
  FROM conversations)"""

TEXTS_SQL = (
    TURNS_SQL
    + """, texts AS (
  SELECT run_id, scenario_id, attempt,
         coalesce(string_agg(content, chr(10) ORDER BY turn) FILTER (WHERE role = 'agent'), '') AS agent_text,
         string_agg(content, chr(10) ORDER BY turn) AS all_text
  FROM turns GROUP BY ALL)"""
)


# --- a rule catalog for the conversations ----------------------------------------------------

_WORDS = ["the", "tion", "ing", "und", "que", "schen", "por", "leaux", "sch", "ou", "er", "ha"]
_PATTERNS = ["th[aeiou]n", "e(?:re|st|nd) ", "[0-9]{2}", "z[aeiou]", "qu[aei]", "[A-Z][a-z]+ing", r"on\.\s[A-Z]", "ich$"]
_REGULATIONS = [f"NATION_{i}" for i in range(0, 30, 2)]


def rule_rows() -> list[dict]:
    """Checks of the 16 conversation scenarios, one dict per check."""
    rows = []
    for i in range(16):
        scenario = f"s{i:02d}"

        def add(kind: str, pos: int, **fields):
            rows.append(
                {
                    "scenario_id": scenario,
                    "check_pos": pos,
                    "check_id": f"{kind}_{pos}",
                    "type": kind,
                    "severity": SEVERITIES[(i + pos) % 5],
                    "regulations": [] if (i + pos) % 7 == 0 else [_REGULATIONS[(i * 3 + pos) % 15], _REGULATIONS[i % 15]],
                    "patterns": [],
                    "case_sensitive": False,
                    "must_appear": True,
                    "scope": "all" if (i + pos) % 4 == 0 else "agent",
                    "pii_types": [],
                    "rubric": "",
                    "judge_pass_if": "yes",
                    "min_length": 0,
                    "max_length": 100000,
                    "max_latency_ms": 0.0,
                }
                | fields
            )

        if i == 15:
            continue  # a scenario without checks always passes
        words = [_WORDS[i % 12], _WORDS[(i + 3) % 12].capitalize()]
        add("required_phrase", 0, patterns=words, case_sensitive=i % 3 == 0)
        add("prohibited_phrase", 1, patterns=[_WORDS[(i + 5) % 12], _WORDS[(i + 7) % 12]], case_sensitive=i % 2 == 1)
        add("regex", 2, patterns=[_PATTERNS[i % 8], _PATTERNS[(i + 1) % 8]], case_sensitive=i % 2 == 0)
        add("regex", 3, patterns=[_PATTERNS[(i + 2) % 8], _PATTERNS[(i + 5) % 8]], must_appear=False)
        add("min_length", 4, min_length=0 if i % 4 == 0 else 60 * i)
        add("max_length", 5, max_length=0 if i % 4 == 1 else 80 * (i + 1))
        add("json_valid", 6)
        add("no_pii_leak", 7, pii_types=[] if i % 2 else ["email", "phone"])
        add("llm_judge", 8, rubric=f"Scenario {i}: the agent must be clear.", judge_pass_if="yes" if i % 5 else " No ")
    return rows


RULE_TYPES = (
    "scenario_id string, check_pos int, check_id string, type string, severity string, regulations array<string>, "
    "patterns array<string>, case_sensitive boolean, must_appear boolean, scope string, pii_types array<string>, "
    "rubric string, judge_pass_if string, min_length int, max_length int, max_latency_ms double"
)
_RULE_FIELDS = [part.split()[0] for part in RULE_TYPES.split(", ")]


def rules(spark: SparkSession, types: list[str] | None = None, rows: list[dict] | None = None) -> DataFrame:
    chosen = [r for r in (rows if rows is not None else rule_rows()) if types is None or r["type"] in types]
    return local_table(spark, [tuple(r[f] for f in _RULE_FIELDS) for r in chosen], RULE_TYPES)


def known_patterns(rows: list[dict] | None = None) -> list[str]:
    rows = rule_rows() if rows is None else rows
    return sorted({p for r in rows if r["type"] == "regex" for p in r["patterns"]})


def sql_value(value) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, list):
        return "CAST([" + ", ".join(sql_value(v) for v in value) + "] AS VARCHAR[])"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def rules_sql(types: list[str] | None = None, rows: list[dict] | None = None) -> str:
    chosen = [r for r in (rows if rows is not None else rule_rows()) if types is None or r["type"] in types]
    values = ",\n    ".join("(" + ", ".join(sql_value(r[f]) for f in _RULE_FIELDS) + ")" for r in chosen)
    return f"rules({', '.join(_RULE_FIELDS)}) AS (VALUES\n    {values})"


# --- events as tool calls and usage ------------------------------------------------------------
# A user is one attempt; events of kind error and signup stand for judge calls.


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    judged = F.col("event_type").isin("error", "signup")
    return e.select(
        F.concat(F.lit("run_"), (F.col("user_id") % 7).cast("string")).alias("run_id"),
        F.concat(F.lit("s"), F.lpad((F.col("user_id") % 16).cast("string"), 2, "0")).alias("scenario_id"),
        F.col("user_id").cast("int").alias("attempt"),
        F.when(judged, F.lit("judge")).otherwise(F.lit("agent")).alias("source"),
        F.when(judged, (F.col("event_id") % 5).cast("int")).alias("check_pos"),
        (F.col("event_id") % 1000).alias("prompt_tokens"),
        F.get_json_object("props", "$.k").cast("bigint").alias("completion_tokens"),
        (F.col("value") / 1000).alias("cost_usd"),
        F.col("value").alias("latency_ms"),
        F.lit(1).cast("bigint").alias("model_calls"),
        "ts",
        "event_id",
    )


USAGE_SQL = """usage AS (
  SELECT 'run_' || (user_id % 7) AS run_id, 's' || lpad(CAST(user_id % 16 AS VARCHAR), 2, '0') AS scenario_id,
         CAST(user_id AS INTEGER) AS attempt,
         CASE WHEN event_type IN ('error', 'signup') THEN 'judge' ELSE 'agent' END AS source,
         CASE WHEN event_type IN ('error', 'signup') THEN CAST(event_id % 5 AS INTEGER) END AS check_pos,
         event_id % 1000 AS prompt_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS completion_tokens,
         value / 1000 AS cost_usd, value AS latency_ms, 1 AS model_calls, ts, event_id
  FROM events)"""


def conversation_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of the conversations, a hundred events being the model calls of one: errors and sign-ups are the judge's."""
    e = table(spark, sf_dir, "events").withColumn("conv_id", F.floor(F.col("event_id") / 100))
    return e.select(
        F.concat(F.lit("run_"), (F.col("conv_id") % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("s"), F.lpad((F.col("conv_id") % 16).cast("string"), 2, "0")).alias("scenario_id"),
        F.floor(F.col("conv_id") / 48).cast("int").alias("attempt"),
        F.when(F.col("event_type").isin("error", "signup"), F.lit("judge")).otherwise(F.lit("agent")).alias("source"),
        (F.col("event_id") % 1000).alias("prompt_tokens"),
        F.get_json_object("props", "$.k").cast("bigint").alias("completion_tokens"),
        (F.col("value") / 1000).alias("cost_usd"),
        F.col("value").alias("latency_ms"),
        F.lit(1).cast("bigint").alias("model_calls"),
    )


CONVERSATION_USAGE_SQL = """usage AS (
  SELECT 'run_' || (event_id // 100 % 3) AS run_id, 's' || lpad(CAST(event_id // 100 % 16 AS VARCHAR), 2, '0') AS scenario_id,
         CAST(event_id // 100 // 48 AS INTEGER) AS attempt,
         CASE WHEN event_type IN ('error', 'signup') THEN 'judge' ELSE 'agent' END AS source,
         event_id % 1000 AS prompt_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS completion_tokens,
         value / 1000 AS cost_usd, value AS latency_ms, 1 AS model_calls
  FROM events)"""


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as agent turns with one tool call each."""
    e = table(spark, sf_dir, "events")
    call = F.struct(
        F.col("event_type").alias("name"), F.col("props").alias("arguments"), F.lit(None).cast("string").alias("result")
    )
    return e.select(
        F.concat(F.lit("run_"), (F.col("user_id") % 7).cast("string")).alias("run_id"),
        F.concat(F.lit("s"), F.lpad((F.col("user_id") % 16).cast("string"), 2, "0")).alias("scenario_id"),
        F.col("user_id").cast("int").alias("attempt"),
        F.col("event_id").cast("int").alias("turn"),
        F.lit("agent").alias("role"),
        F.lit("").alias("content"),
        F.array(call).alias("tool_calls"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user, summarised from its events."""
    e = table(spark, sf_dir, "events")
    errors = F.count_if(F.col("event_type") == "error")
    return e.groupBy("user_id").agg(
        F.max("ts").cast("timestamp").alias("created_at"),
        (F.lit(1.0) - errors / F.count("*")).alias("pass_rate"),
        F.count("*").alias("total_runs"),
        errors.alias("violations"),
    ).select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
        "created_at",
        F.when(F.col("user_id") % 2 == 0, F.lit("mock/naive-agent")).otherwise(F.lit("mock/compliant-agent")).alias("agent_model"),
        F.lit("mock/judge").alias("judge_model"),
        "pass_rate",
        "total_runs",
        "violations",
    )


RUNS_SQL = """runs AS (
  SELECT 'run_' || user_id AS run_id, max(ts) AS created_at,
         CASE WHEN user_id % 2 = 0 THEN 'mock/naive-agent' ELSE 'mock/compliant-agent' END AS agent_model,
         'mock/judge' AS judge_model,
         1.0::DOUBLE - count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE AS pass_rate,
         count(*) AS total_runs, count(*) FILTER (WHERE event_type = 'error') AS violations
  FROM events GROUP BY user_id)"""


# --- parts as a scenario catalog, line items as its checks and their results ---------------------


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("file_name"),
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("scenario_id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 10 == 0, F.lit("unlabelled"))
        .when(F.col("p_size") % 2 == 0, F.lit("benign_control"))
        .otherwise(F.lit("violation_expected"))
        .alias("label"),
        F.concat(
            F.split("p_name", " "),
            F.array(F.lower("p_type")),
            F.when(F.col("p_size") % 3 == 0, F.array(F.lit("adversarial"))).otherwise(F.array().cast("array<string>")),
        ).alias("tags"),
        F.array(F.concat(F.lit("NATION_"), (F.col("p_partkey") % 27).cast("string"))).alias("regulations"),
        "p_brand",
    )


SCENARIOS_SQL = """scenarios AS (
  SELECT lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS file_name, 'part_' || p_partkey AS scenario_id, p_name AS title,
         CASE WHEN p_size % 10 = 0 THEN 'unlabelled' WHEN p_size % 2 = 0 THEN 'benign_control'
              ELSE 'violation_expected' END AS label,
         string_split(p_name, ' ') || [lower(p_type)] ||
           CASE WHEN p_size % 3 = 0 THEN ['adversarial'] ELSE CAST([] AS VARCHAR[]) END AS tags,
         ['NATION_' || (p_partkey % 27)] AS regulations, p_brand
  FROM part)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as registry entries: many entries per nation, of which the last counts."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("file_pos"),
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("authority of "), F.col("s_name")).alias("authority"),
    )


REGISTRY_SQL = """registry AS (
  SELECT min(s_suppkey) AS file_pos, 'NATION_' || s_nationkey AS id, arg_max(s_name, s_suppkey) AS name,
         'authority of ' || arg_max(s_name, s_suppkey) AS authority
  FROM supplier GROUP BY s_nationkey)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as check results: a run per return flag, an attempt per order."""
    li = table(spark, sf_dir, "lineitem")
    sev = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    supplier = F.concat(F.lit("NATION_"), (F.col("l_suppkey") % 28).cast("string"))
    part = F.concat(F.lit("NATION_"), (F.col("l_partkey") % 9).cast("string"))
    return li.select(
        F.concat(F.lit("run_"), F.col("l_returnflag")).alias("run_id"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("scenario_id"),
        F.col("l_orderkey").cast("int").alias("attempt"),
        F.col("l_linenumber").cast("int").alias("check_pos"),
        F.concat(F.lit("check_"), F.col("l_linenumber").cast("string")).alias("check_id"),
        (F.col("l_quantity") > 5).alias("passed"),
        sev.alias("severity"),
        F.when(F.col("l_suppkey") % 11 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(supplier, part))
        .alias("regulations"),
    )


RESULTS_SQL = """results AS (
  SELECT 'run_' || l_returnflag AS run_id, 'part_' || l_partkey AS scenario_id, CAST(l_orderkey AS INTEGER) AS attempt,
         CAST(l_linenumber AS INTEGER) AS check_pos, 'check_' || l_linenumber AS check_id, l_quantity > 5 AS passed,
         ['info', 'low', 'medium', 'high', 'critical'][CAST(l_linenumber % 5 + 1 AS INTEGER)] AS severity,
         CASE WHEN l_suppkey % 11 = 0 THEN CAST([] AS VARCHAR[])
              ELSE ['NATION_' || (l_suppkey % 28), 'NATION_' || (l_partkey % 9)] END AS regulations
  FROM lineitem)"""

WEIGHT_SQL = "CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 3 WHEN 'high' THEN 7 ELSE 15 END"


# --- orders as messages with personal data of every kind -----------------------------------------


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = texts(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def digits(number, n: int):
        return F.lpad(number.cast("string"), n, "0")

    ssn = F.concat_ws("-", digits(key * 7919 % 1000, 3), digits(cust % 50, 2), digits(key * 13 % 9000, 4))
    card = F.concat(F.lit("4"), digits(key * 982451653 % 1000000000000000, 15))
    text = F.concat(
        F.lit("Order "), key.cast("string"), F.lit(": SSN "), ssn,
        F.lit(", born "), F.date_format("o_orderdate", "MM/dd/yyyy"),
        F.lit(", routing number "), digits(key * 104729 % 1000000000, 9),
        F.lit(", Account no. "), digits(key * 15485863 % 100000000000, 12),
        F.lit(", card "), card,
        F.lit(", mail user"), cust.cast("string"), F.lit("@mail"), (key % 9).cast("string"), F.lit(".example.com"),
        F.lit(", call (415) 555-"), digits(key % 10000, 4), F.lit("."),
    )
    return o.select(key.alias("order_id"), F.col("o_orderpriority").alias("source"), text.alias("text"))


MESSAGES_SQL = """messages AS (
  SELECT o_orderkey AS order_id, o_orderpriority AS source,
         'Order ' || o_orderkey || ': SSN ' || lpad(CAST(o_orderkey * 7919 % 1000 AS VARCHAR), 3, '0') || '-' ||
         lpad(CAST(o_custkey % 50 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey * 13 % 9000 AS VARCHAR), 4, '0') ||
         ', born ' || strftime(o_orderdate, '%m/%d/%Y') ||
         ', routing number ' || lpad(CAST(o_orderkey * 104729 % 1000000000 AS VARCHAR), 9, '0') ||
         ', Account no. ' || lpad(CAST(o_orderkey * 15485863 % 100000000000 AS VARCHAR), 12, '0') ||
         ', card 4' || lpad(CAST(o_orderkey * 982451653 % 1000000000000000 AS VARCHAR), 15, '0') ||
         ', mail user' || o_custkey || '@mail' || (o_orderkey % 9) || '.example.com' ||
         ', call (415) 555-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '.' AS text
  FROM orders)"""


# --- the detectors in DuckDB -----------------------------------------------------------------------

WS_SQL = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)"


def luhn_sql(value: str) -> str:
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    digit = f"CAST({d}[i] AS INTEGER)"
    return (
        f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
        f"CASE WHEN (i - 1) % 2 = length({d}) % 2 THEN CASE WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END "
        f"ELSE {digit} END)) % 10 = 0)"
    )


# RE2 has no look-ahead: the social security number is matched broadly and its digits are tested.
_SSN_OK = (
    "NOT (regexp_replace(v, '[^0-9]', '', 'g')[1:3] IN ('000', '666') OR regexp_replace(v, '[^0-9]', '', 'g')[1:1] = '9' "
    "OR regexp_replace(v, '[^0-9]', '', 'g')[4:5] = '00' OR regexp_replace(v, '[^0-9]', '', 'g')[6:9] = '0000')"
)

# Fixed values, written out apart from the library's so that a wrong pattern there shows.
# kind: (pattern, group, options, test of a value)
_KINDS_SQL = {
    "ssn": (r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", 0, "", _SSN_OK),
    "credit_card": (r"\b(?:\d[ -]?){13,19}\b", 0, "", luhn_sql("v")),
    "routing_number": (r"\b(?:routing|aba|rtn)\D{0,12}(\d{9})\b", 1, "i", None),
    "bank_account": (r"\b(?:account|acct|a/c)\D{0,12}(\d{8,17})\b", 1, "i", None),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0, "", None),
    "phone": (r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 0, "", None),
    "dob": (r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b", 0, "", None),
}


def findings_sql(text: str, kinds=tuple(_KINDS_SQL)) -> str:
    """A DuckDB list of distinct structs (kind, value) in detector order."""
    parts = []
    for kind in kinds:
        pattern, group, options, test = _KINDS_SQL[kind]
        values = (
            f"list_transform(regexp_extract_all({text}, '{pattern}', {group}, '{options}'), lambda v: trim(v, {WS_SQL}))"
        )
        if test:
            values = f"list_filter({values}, lambda v: {test})"
        parts.append(f"list_transform({values}, lambda v: {{'kind': '{kind}', 'value': v}})")
    joined = "(" + " || ".join(parts) + ")"
    return f"list_filter({joined}, lambda x, i: list_position({joined}, x) = i)"


def preview_sql(kind: str, value: str) -> str:
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    return f"{kind} || ':****' || CASE WHEN length({d}) >= 4 THEN right({d}, 4) ELSE '' END"


def redact_sql(text: str, findings: str) -> str:
    """Replace the findings, longest first, in DuckDB."""
    ordered = (
        f"list_sort(list_transform({findings}, lambda f, i: {{'k': -length(f.value), 'i': i, 'kind': f.kind, 'value': f.value}}))"
    )
    return (
        f"list_reduce(list_transform({ordered}, lambda s: [s.value, '[REDACTED:' || upper(s.kind) || ']']), "
        f"lambda acc, s: [replace(acc[1], s[1], s[2])], [{text}])[1]"
    )
