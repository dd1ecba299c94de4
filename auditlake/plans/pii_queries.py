"""Queries that detect and redact personal data in documents, pages, orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import pii
from auditlake.functions import redact as rd
from auditlake.operators import leaks, profile, redaction
from auditlake.plans import inputs as src
from auditlake.sources.transcripts import redacted_artifacts as redacted_run

# --- one detector at a time -----------------------------------------------------------------


def _kind_on_messages(kind):
    def query(spark, sf):
        found = profile.findings_of(src.messages(spark, sf), "text", ["order_id"], [kind])
        return found.select("order_id", "type", "value", "preview")

    return query


def _kind_on_messages_sql(kind):
    return f"""WITH {src.MESSAGES_SQL}, hits AS (
  SELECT order_id, unnest({src.findings_sql('text', (kind,))}) AS f FROM messages)
SELECT order_id, f.kind AS type, f.value AS value, {src.preview_sql('f.kind', 'f.value')} AS preview FROM hits"""


def luhn(spark, sf):
    """Check-digit test of numbers of 12 to 20 digits made from order keys."""
    o = src.table(spark, sf, "orders")
    body = F.lpad((F.col("o_orderkey") * 982451653 % 1000000000000).cast("string"), 12, "0")
    number = F.concat(body, F.substring(F.lit("79927398"), F.lit(1), (F.col("o_orderkey") % 9).cast("int")))
    return o.select("o_orderkey", number.alias("number")).withColumn("valid", pii.luhn_valid(F.col("number")))


LUHN = f"""WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 982451653 % 1000000000000 AS VARCHAR), 12, '0') ||
  left('79927398', CAST(o_orderkey % 9 AS INTEGER)) AS number FROM orders)
SELECT o_orderkey, number, coalesce({src.luhn_sql('number')}, FALSE) AS valid FROM n"""


def all_kinds(spark, sf):
    """Findings of every kind in the order messages."""
    found = profile.findings_of(src.messages(spark, sf), "text", ["order_id"])
    return found.select("order_id", "finding_pos", "type", "value")


ALL_KINDS = f"""WITH {src.MESSAGES_SQL}, hits AS (SELECT order_id, {src.findings_sql('text')} AS fs FROM messages),
rows AS (SELECT order_id, unnest(range(len(fs))) AS finding_pos, unnest(fs) AS f FROM hits)
SELECT order_id, CAST(finding_pos AS INTEGER) AS finding_pos, f.kind AS type, f.value AS value FROM rows"""


def documents(spark, sf):
    found = profile.findings_of(src.texts(spark, sf, "documents"), "text", ["doc_id"])
    return found.select("doc_id", "type", "value")


DOCUMENTS = f"""WITH hits AS (SELECT doc_id, unnest({src.findings_sql('text')}) AS f FROM documents)
SELECT doc_id, f.kind AS type, f.value AS value FROM hits"""


def pages(spark, sf):
    found = profile.findings_of(src.texts(spark, sf, "pages"), "html", ["page_id"])
    return found.select("page_id", "type", "value", "preview")


PAGES = f"""WITH hits AS (SELECT page_id, unnest({src.findings_sql('html')}) AS f FROM pages)
SELECT page_id, f.kind AS type, f.value AS value, {src.preview_sql('f.kind', 'f.value')} AS preview FROM hits"""


def previews(spark, sf):
    """Safe previews per document, sorted."""
    d = src.texts(spark, sf, "documents").withColumn("found", pii.detect(F.col("text")))
    return d.filter(F.size("found") > 0).select("doc_id", F.array_join(pii.previews(F.col("found")), ", ").alias("previews"))


PREVIEWS = f"""WITH hits AS (SELECT doc_id, unnest({src.findings_sql('text')}) AS f FROM documents),
p AS (SELECT DISTINCT doc_id, {src.preview_sql('f.kind', 'f.value')} AS preview FROM hits)
SELECT doc_id, string_agg(preview, ', ' ORDER BY preview) AS previews FROM p GROUP BY doc_id"""


def document_profile(spark, sf):
    return profile.pii_profile(src.texts(spark, sf, "documents"), "text", ["source", "lang"])


DOCUMENT_PROFILE = f"""WITH hits AS (SELECT source, lang, unnest({src.findings_sql('text')}) AS f FROM documents)
SELECT source, lang, f.kind AS type, count(*) AS findings FROM hits GROUP BY ALL"""


def message_profile(spark, sf):
    return profile.pii_profile(src.messages(spark, sf), "text", ["source"])


MESSAGE_PROFILE = f"""WITH {src.MESSAGES_SQL}, hits AS (SELECT source, unnest({src.findings_sql('text')}) AS f FROM messages)
SELECT source, f.kind AS type, count(*) AS findings FROM hits GROUP BY ALL"""


# --- redaction ---------------------------------------------------------------------------------


def redacted_documents(spark, sf):
    d = src.texts(spark, sf, "documents")
    return redaction.redact_columns(d.select("doc_id", "text"), ["doc_id"], ["text"])


REDACTED_DOCUMENTS = f"""WITH found AS (SELECT doc_id, text, {src.findings_sql('text')} AS fs FROM documents)
SELECT doc_id, CASE WHEN len(fs) = 0 THEN text ELSE {src.redact_sql('text', 'fs')} END AS text FROM found"""


def redacted_messages(spark, sf):
    return redaction.redact_columns(src.messages(spark, sf), ["order_id"], ["text"])


REDACTED_MESSAGES = f"""WITH {src.MESSAGES_SQL}, found AS (SELECT *, {src.findings_sql('text')} AS fs FROM messages)
SELECT order_id, source, CASE WHEN len(fs) = 0 THEN text ELSE {src.redact_sql('text', 'fs')} END AS text FROM found"""


def leak_audit(spark, sf):
    """Documents with findings before redaction, and the findings left after it."""
    d = src.texts(spark, sf, "documents").select("doc_id", "text")
    marked = redaction.redact_columns(d.withColumn("clean", F.col("text")), ["doc_id"], ["clean"])
    return marked.select(
        F.size(pii.detect(F.col("text"))).alias("before"), F.size(pii.detect(F.col("clean"))).alias("after")
    ).agg(F.count_if(F.col("before") > 0).alias("leaking_before"), F.count_if(F.col("after") > 0).alias("leaking_after"))


LEAK_AUDIT = f"""WITH found AS (SELECT text, {src.findings_sql('text')} AS fs FROM documents), clean AS (
  SELECT fs, CASE WHEN len(fs) = 0 THEN text ELSE {src.redact_sql('text', 'fs')} END AS clean FROM found)
SELECT count(*) FILTER (WHERE len(fs) > 0) AS leaking_before,
       count(*) FILTER (WHERE len({src.findings_sql('clean')}) > 0) AS leaking_after FROM clean"""


def leak_paths(spark, sf):
    """Every finding in the tool results of customers, held as JSON within calls, with its path."""
    call = F.struct(F.col("c_custkey").alias("number"), F.struct(F.col("doc").alias("body"), F.lit("none").alias("state")).alias("result"))
    rows = _records(spark, sf).select("c_custkey", F.array(F.struct(F.lit(0).cast("bigint").alias("number"), F.lit(None).cast("struct<body:string,state:string>").alias("result")), call).alias("calls"))
    found = leaks.leak_paths(rows, ["c_custkey"])
    return found.groupBy("path", "type").agg(F.count("*").alias("found"), F.min("preview").alias("first_preview"))


# The account number is announced by the name of its field, so it is found in the object as a whole.
LEAK_PATHS = """WITH f AS (SELECT c_custkey, unnest(['email', 'phone', 'bank_account']) AS type FROM customer)
SELECT 'calls[1].result.body' || CASE type WHEN 'email' THEN ':$.secret.hint' WHEN 'phone' THEN ':$.note' ELSE '' END AS path, type, count(*) AS found,
  min(CASE type WHEN 'email' THEN 'email:****' ELSE type || ':****' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END) AS first_preview
FROM f GROUP BY ALL"""


# Field names, some of them sensitive, to be combined with table values.
FIELD_NAMES = [
    "account_id", "to_account", "pin", "spinner", "prompt_tokens", "api key", "API-KEY", "access_token", "tokens",
    "recovery_code", "recovery", "card number", "cardinal", "routing", "rerouting", "dob", "ssn_last4", "cvv2", "note",
]


def sensitive_keys(spark, sf):
    """Field names made of a fixed name and the market segment of a customer."""
    c = src.table(spark, sf, "customer")
    name = F.element_at(F.array(*[F.lit(n) for n in FIELD_NAMES]), (F.col("c_custkey") % len(FIELD_NAMES) + 1).cast("int"))
    joint = F.element_at(F.array(*[F.lit(j) for j in ("_", "-", " ", "", ".")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    key = F.concat(name, joint, F.lower("c_mktsegment"))
    return c.select("c_custkey", key.alias("field")).withColumn("sensitive", rd.is_sensitive_key(F.col("field")))


SENSITIVE_KEYS = f"""WITH k AS (SELECT c_custkey, {src.sql_value(FIELD_NAMES)}[CAST(c_custkey % {len(FIELD_NAMES)} + 1 AS INTEGER)] ||
  ['_', '-', ' ', '', '.'][CAST(c_custkey % 5 + 1 AS INTEGER)] || lower(c_mktsegment) AS field FROM customer)
SELECT c_custkey, field, regexp_matches(field, '{rd.SENSITIVE_KEY}', 'i') AS sensitive FROM k"""


def _records(spark, sf):
    """Customers as nested tool results; a run per market segment."""
    c = src.texts(spark, sf, "customer")
    number = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    doc = F.concat(
        F.lit('{"profile": {"name": "'), F.col("c_name"), F.lit('", "account_id": "AC-'), number,
        F.lit('", "limits": [1, 2.5, true]}, "passcode": ["P'), number, F.lit('", '), F.col("c_custkey").cast("string"),
        F.lit(', null], "secret": {"pin": "N'), number, F.lit('", "hint": "mail user'), F.col("c_custkey").cast("string"),
        F.lit('@mail.example.com now"}, "note": "call 415-555-'), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"),
        F.lit('"}'),
    )
    return c.select(F.col("c_mktsegment").alias("run_id"), "c_custkey", doc.alias("doc"))


def harvested_values(spark, sf):
    return redaction.harvest(_records(spark, sf), ["doc"])


HARVESTED_VALUES = """SELECT DISTINCT c_mktsegment AS run_id, unnest(['AC-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'),
  'P' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), CAST(c_custkey AS VARCHAR),
  'N' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')]) AS value FROM customer"""


def redacted_json(spark, sf):
    """Nested tool results with sensitive fields and found personal data masked."""
    return rd.redact_json(_records(spark, sf).select("c_custkey", "doc"), "doc")


REDACTED_JSON = """SELECT c_custkey, '{"profile": {"name": "' || c_name || '", "account_id": "[REDACTED:SENSITIVE]", ' ||
  '"limits": [1, 2.5, true]}, "passcode": "[REDACTED:SENSITIVE]", "secret": "[REDACTED:SENSITIVE]", ' ||
  '"note": "call [REDACTED:PHONE]"}' AS doc FROM customer"""


def redacted_flat_json(spark, sf):
    """Event properties with a PIN and a contact added, as a flat object."""
    e = src.texts(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    doc = F.concat(
        F.lit('{"k": '), k, F.lit(', "pin": "'), k, F.lit('", "contact": "user'), F.col("user_id").cast("string"),
        F.lit('@mail.example.com", "kind": "'), F.col("event_type"), F.lit('"}'),
    )
    out = e.select("event_id", doc.alias("doc"))
    return out.select(
        "event_id", rd.redact_flat_json(F.col("doc")).alias("doc"),
        F.array_join(rd.flat_sensitive_values(F.col("doc")), ",").alias("harvested"),
    )


REDACTED_FLAT_JSON = """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') ||
  ',"pin":"[REDACTED:SENSITIVE]","contact":"[REDACTED:EMAIL]","kind":"' || event_type || '"}' AS doc,
  json_extract_string(props, '$.k') AS harvested FROM events"""


def _account_turns(spark, sf):
    """Orders as agent turns that name accounts; the tool call of the turn holds the customer's account.

    A run is a customer group, so that one run holds the accounts of many customers; the account of the next
    customer of the group is named too, whose own tool call may be in any other attempt of the run.
    """
    o = src.texts(spark, sf, "orders")
    run = F.concat(F.lit("group_"), (F.col("o_custkey") % 5).cast("string"))

    def account(number):
        return F.concat(F.lit("ACME"), F.lpad(number.cast("string"), 7, "0"))

    mine, other = account(F.col("o_custkey")), account(F.col("o_custkey") + 5)
    call = F.struct(
        F.lit("get_account").alias("name"),
        F.lit("{}").alias("arguments"),
        F.concat(F.lit('{"account_id": "'), mine, F.lit('", "status": "'), F.col("o_orderstatus"), F.lit('"}')).alias("result"),
    )
    return o.select(
        run.alias("run_id"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("scenario_id"),
        F.lit(0).alias("attempt"), F.lit(1).alias("turn"), F.lit("agent").alias("role"),
        F.concat(F.lit("See "), mine, F.lit("/"), other, F.lit(", mail a@b.example.com")).alias("content"),
        F.array(call).alias("tool_calls"),
    )


def redacted_turns(spark, sf):
    """Turns of runs that hold many sensitive values: matched by equality on cut texts."""
    clean = redaction.redact_turns(_account_turns(spark, sf), limit=16)
    return clean.select(
        "run_id", "scenario_id", "content", F.col("tool_calls")[0]["name"].alias("tool"), F.col("tool_calls")[0]["result"].alias("result")
    )


def redacted_turns_by_array(spark, sf):
    """The same with the values of each run carried as an array."""
    small = _account_turns(spark, sf).withColumn("run_id", F.concat("run_id", F.lit("_"), F.substring("content", 12, 3)))
    clean = redaction.redact_turns(small)
    return clean.select("run_id", "scenario_id", "content")


def redacted_artifacts(spark, sf):
    """Orders as recorded attempts whose evidence names accounts of other attempts, as they leave for a report."""
    t = _account_turns(spark, sf).withColumn("run_id", F.concat("run_id", F.lit("_"), F.substring("content", 12, 3)))
    evidence = F.concat(F.lit("said: "), F.col("content"))
    result = F.struct(
        F.lit(0).alias("check_pos"), F.lit("c").alias("check_id"), F.lit("regex").alias("type"), F.lit(False).alias("passed"),
        F.lit("high").alias("severity"), F.array(F.lit("R")).alias("regulations"), F.lit("Found.").alias("message"),
        evidence.alias("evidence"),
    )
    run = t.select(
        "run_id", "scenario_id", "attempt", F.concat(F.lit("About "), F.substring("content", 5, 11)).alias("title"),
        F.array(F.struct("role", "content", "tool_calls")).alias("turns"), F.array(result).alias("check_results"),
    )
    clean = redacted_run(run)
    return clean.select(
        "run_id", "scenario_id", "title", F.col("turns")[0]["content"].alias("content"),
        F.col("turns")[0]["tool_calls"][0]["result"].alias("result"), F.col("check_results")[0]["evidence"].alias("evidence"),
    )


_ACCOUNTS_SQL = """accounts AS (
  SELECT 'group_' || (o_custkey % 5) AS run_id, 'order_' || o_orderkey AS scenario_id, o_orderstatus,
         'ACME' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS mine,
         'ACME' || lpad(CAST(o_custkey + 5 AS VARCHAR), 7, '0') AS other FROM orders)"""

_CLEAN_SQL = """'See [REDACTED:SENSITIVE]/' || CASE WHEN EXISTS (SELECT 1 FROM accounts b WHERE b.run_id = a.run_id AND b.mine = a.other)
    THEN '[REDACTED:SENSITIVE]' ELSE other END || ', mail [REDACTED:EMAIL]' AS content"""

REDACTED_TURNS = f"""WITH {_ACCOUNTS_SQL} SELECT run_id, scenario_id, {_CLEAN_SQL}, 'get_account' AS tool,
  '{{"account_id":"[REDACTED:SENSITIVE]","status":"' || o_orderstatus || '"}}' AS result FROM accounts a"""

_SMALL_RUNS_SQL = _ACCOUNTS_SQL.replace("AS run_id", "|| '_' || substr(lpad(CAST(o_custkey AS VARCHAR), 7, '0'), 4, 3) AS run_id")
REDACTED_TURNS_BY_ARRAY = f"""WITH {_SMALL_RUNS_SQL}
SELECT run_id, scenario_id, {_CLEAN_SQL} FROM accounts a"""


REDACTED_ARTIFACTS = f"""WITH {_SMALL_RUNS_SQL}, c AS (SELECT *, {_CLEAN_SQL} FROM accounts a)
SELECT run_id, scenario_id, 'About [REDACTED:SENSITIVE]' AS title, content,
  '{{"account_id":"[REDACTED:SENSITIVE]","status":"' || o_orderstatus || '"}}' AS result, 'said: ' || content AS evidence FROM c"""


QUERIES = {
    **{f"pii_{d.name}": (_kind_on_messages(d.name), _kind_on_messages_sql(d.name)) for d in pii.DETECTORS},
    "pii_luhn": (luhn, LUHN),
    "pii_all_kinds": (all_kinds, ALL_KINDS),
    "pii_documents": (documents, DOCUMENTS),
    "pii_pages": (pages, PAGES),
    "pii_previews": (previews, PREVIEWS),
    "pii_document_profile": (document_profile, DOCUMENT_PROFILE),
    "pii_message_profile": (message_profile, MESSAGE_PROFILE),
    "redacted_documents": (redacted_documents, REDACTED_DOCUMENTS),
    "redacted_messages": (redacted_messages, REDACTED_MESSAGES),
    "redaction_leak_audit": (leak_audit, LEAK_AUDIT),
    "redaction_leak_paths": (leak_paths, LEAK_PATHS),
    "sensitive_keys": (sensitive_keys, SENSITIVE_KEYS),
    "sensitive_values": (harvested_values, HARVESTED_VALUES),
    "redacted_json": (redacted_json, REDACTED_JSON),
    "redacted_flat_json": (redacted_flat_json, REDACTED_FLAT_JSON),
    "redacted_turns": (redacted_turns, REDACTED_TURNS),
    "redacted_artifacts": (redacted_artifacts, REDACTED_ARTIFACTS),
    "redacted_turns_by_array": (redacted_turns_by_array, REDACTED_TURNS_BY_ARRAY),
}
