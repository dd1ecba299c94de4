"""Queries over run history and audit events, runs and saves being derived from events and orders."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from itertools import pairwise

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.operators import metrics as mt
from auditlake.plans import inputs as src
from auditlake.plans import metric_queries as mq
from auditlake.schemas import RECORDED_ATTEMPT, TOOL_CALL
from auditlake.session import shared_folder
from auditlake.sources import history as hs

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
STAMP_SQL = "%Y-%m-%d %H:%M:%S.%f"


def _texted(df):
    return df.withColumn("created_at", F.date_format("created_at", STAMP))


# --- saves and upserts -----------------------------------------------------------------------


def _saves(spark, sf):
    """Every event is one save of the run of its user."""
    e = src.table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("agent_model"),
        F.lit("mock/judge").alias("judge_model"),
        (F.col("value") / 1000).alias("pass_rate"),
        F.col("event_id").alias("total_runs"),
        F.get_json_object("props", "$.k").cast("bigint").alias("violations"),
        F.struct("ts", "event_id").alias("saved_at"),
    )


def upserted_runs(spark, sf):
    """The last of all saves of each run."""
    return _texted(hs.latest_saves(_saves(spark, sf)).drop("saved_at"))


UPSERTED_RUNS = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT 'run_' || user_id AS run_id, strftime(ts, '{STAMP_SQL}') AS created_at, event_type AS agent_model, 'mock/judge' AS judge_model,
  value / 1000 AS pass_rate, event_id AS total_runs, CAST(json_extract_string(props, '$.k') AS BIGINT) AS violations FROM r WHERE n = 1"""


def upsert(spark, sf):
    """Runs of the first half of the month upserted with those of the second half."""
    saves = _saves(spark, sf)
    half = F.lit("2024-01-16 00:00:00").cast("timestamp")
    old = hs.latest_saves(saves.filter(F.col("created_at") < half)).drop("saved_at")
    new = hs.latest_saves(saves.filter(F.col("created_at") >= half)).drop("saved_at")
    return _texted(hs.upsert(old, new))


def run_summaries(spark, sf):
    """History summaries computed from the metrics of the item runs."""
    runs = src.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("run_"), "l_returnflag").alias("run_id")).agg(
        F.max("l_shipdate").cast("timestamp").alias("created_at")
    )
    metrics = mt.outcome_metrics(mq.item_attempts(spark, sf))
    rows = _texted(hs.summarize_runs(runs, metrics))
    return rows.withColumn("payload", F.get_json_object("payload", "$.possible_weight").cast("bigint"))


RUN_SUMMARIES = f"""WITH {mq.ITEM_ATTEMPTS_SQL}, {mq._OUTCOME_METRICS_SQL}, runs AS (
  SELECT 'run_' || l_returnflag AS run_id, max(l_shipdate) AS created_at FROM lineitem GROUP BY ALL)
SELECT r.run_id, strftime(created_at, '{STAMP_SQL}') AS created_at, {mq._ROUND_4.format('pass_rate')} AS pass_rate, total_runs,
  total_violations AS violations, possible_weight AS payload FROM runs r LEFT JOIN outcome o ON o.run_id = r.run_id"""


# --- listings ------------------------------------------------------------------------------------


def list_runs(spark, sf):
    return _texted(hs.list_runs(src.runs(spark, sf), 20))


_LISTED = f"run_id, strftime(created_at, '{STAMP_SQL}') AS created_at, agent_model, judge_model, pass_rate, total_runs, violations"
LIST_RUNS = f"WITH {src.RUNS_SQL} SELECT {_LISTED} FROM (SELECT * FROM runs ORDER BY runs.created_at DESC, run_id LIMIT 20)"


def get_run(spark, sf):
    return _texted(hs.get_run(src.runs(spark, sf), "run_7"))


GET_RUN = f"WITH {src.RUNS_SQL} SELECT {_LISTED} FROM runs WHERE run_id = 'run_7'"


def latest_run(spark, sf):
    return _texted(hs.latest_run(src.runs(spark, sf)))


LATEST_RUN = f"WITH {src.RUNS_SQL} SELECT {_LISTED} FROM (SELECT * FROM runs ORDER BY runs.created_at DESC, run_id LIMIT 1)"

CUTOFF = datetime(2024, 1, 30, 12, tzinfo=UTC)


def kept_runs(spark, sf):
    return _texted(hs.split_by_age(src.runs(spark, sf), CUTOFF)[0])


KEPT_RUNS = f"WITH {src.RUNS_SQL} SELECT {_LISTED} FROM runs WHERE created_at >= TIMESTAMP '2024-01-30 12:00:00'"


def purged_count(spark, sf):
    return hs.split_by_age(src.runs(spark, sf), CUTOFF)[1].agg(F.count("*").alias("purged"))


PURGED_COUNT = f"WITH {src.RUNS_SQL} SELECT count(*) AS purged FROM runs WHERE created_at < TIMESTAMP '2024-01-30 12:00:00'"


def retained_saves(spark, sf):
    """Saves left by a retention of ten days counted from a fixed clock."""
    cutoff = hs.retention_cutoff(10, datetime(2024, 1, 31, 6, 30, tzinfo=UTC))
    kept = hs.split_by_age(_saves(spark, sf), cutoff)[0]
    return kept.groupBy("run_id").agg(F.count("*").alias("saves"), F.min("total_runs").alias("first_event"))


RETAINED_SAVES = """SELECT 'run_' || user_id AS run_id, count(*) AS saves, min(event_id) AS first_event FROM events
WHERE ts >= TIMESTAMP '2024-01-21 06:30:00' GROUP BY user_id"""


def _run_scenarios(spark, sf):
    """A run's scenarios: the parts numbered like the properties of its events."""
    e = src.table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
        F.concat(F.lit("part_"), F.get_json_object("props", "$.k")).alias("scenario_id"),
    ).distinct()


def tagged_runs(spark, sf):
    return _texted(hs.runs_with_tag(src.runs(spark, sf), _run_scenarios(spark, sf), src.scenarios(spark, sf), "promo", 40))


def tagged_runs_filter_first(spark, sf):
    return _texted(
        hs.runs_with_tag(src.runs(spark, sf), _run_scenarios(spark, sf), src.scenarios(spark, sf), "promo", 40, filter_first=True)
    )


_HAVING_SQL = f"""{src.RUNS_SQL}, {src.SCENARIOS_SQL}, having_tag AS (
  SELECT DISTINCT 'run_' || user_id AS run_id FROM events
  WHERE 'part_' || json_extract_string(props, '$.k') IN (SELECT scenario_id FROM scenarios WHERE list_contains(tags, 'promo')))"""
TAGGED_RUNS = f"""WITH {_HAVING_SQL} SELECT {_LISTED} FROM (SELECT * FROM runs ORDER BY runs.created_at DESC, run_id LIMIT 40)
WHERE run_id IN (SELECT run_id FROM having_tag)"""
TAGGED_RUNS_FILTER_FIRST = f"""WITH {_HAVING_SQL} SELECT {_LISTED} FROM (SELECT * FROM runs
  WHERE run_id IN (SELECT run_id FROM having_tag) ORDER BY runs.created_at DESC, run_id LIMIT 40)"""


# --- audit events ------------------------------------------------------------------------------------


def _audit(spark, sf):
    """Orders as audit events whose details hold a password and a contact."""
    o = src.texts(spark, sf, "orders")
    details = F.create_map(
        F.lit("run_id"), F.concat(F.lit("run_"), F.col("o_custkey").cast("string")),
        F.lit("password"), F.col("o_orderpriority"),
        F.lit("contact"), F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@mail.example.com")),
    )
    return o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("event_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.concat(F.lit("status_"), "o_orderstatus").alias("event_type"),
        hs.sorted_json(details).alias("details"),
    )


def audit_rows(spark, sf):
    return _texted(hs.audit_rows(_audit(spark, sf)))


_AUDIT_SQL = f"""audit AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS event_id, strftime(o_orderdate, '{STAMP_SQL}') AS created_at,
  'status_' || o_orderstatus AS event_type, 'run_' || o_custkey AS run FROM orders)"""
AUDIT_ROWS = f"""WITH {_AUDIT_SQL} SELECT event_id, created_at, event_type,
  '{{"contact": "[REDACTED:EMAIL]", "password": "[REDACTED:SENSITIVE]", "run_id": "' || run || '"}}' AS details FROM audit"""


def list_audit_events(spark, sf):
    newest = _audit(spark, sf).orderBy(F.desc("created_at"), F.desc("event_id")).limit(25)
    listed = _texted(hs.list_audit_events(hs.audit_rows(newest), 25))
    return listed.select(
        "event_id", "created_at", "event_type", F.col("details")["run_id"].alias("run"), F.col("details")["password"].alias("password")
    )


LIST_AUDIT_EVENTS = f"""WITH {_AUDIT_SQL} SELECT event_id, created_at, event_type, run, '[REDACTED:SENSITIVE]' AS password
FROM audit ORDER BY created_at DESC, event_id DESC LIMIT 25"""


def saved_payloads(spark, sf):
    """Every document as the payload of a run, with a password of its own, as a save stores it."""
    secret = F.concat(F.lit('s"'), F.col("doc_id").cast("string"), F.lit("\\x"))
    result = F.struct(secret.alias("password"), F.concat(F.lit("it is "), secret, F.lit(".")).alias("note"), F.col("n_chars").alias("chars"))
    runs = src.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("run_id"), secret.alias("secret"), F.to_json(F.struct("lang", result.alias("result"))).alias("payload")
    )
    stored = hs.redacted_payloads(runs).withColumn("r", F.from_json("payload", "lang string, result struct<password:string,note:string,chars:bigint>"))
    left = F.contains(F.col("payload"), F.concat(F.lit('s\\"'), F.col("run_id"), F.lit("\\\\x")))
    return stored.select("run_id", "r.lang", F.col("r.result.password").alias("password"), F.col("r.result.note").alias("note"), F.col("r.result.chars").alias("chars"), left.alias("leak"))


SAVED_PAYLOADS = """SELECT CAST(doc_id AS VARCHAR) AS run_id, lang, '[REDACTED:SENSITIVE]' AS password,
  'it is [REDACTED:SENSITIVE].' AS note, n_chars AS chars, false AS leak FROM documents"""


# --- the store on files --------------------------------------------------------------------------------


def _store(spark):
    return hs.RunHistory(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")


def stored_runs(spark, sf):
    """Runs saved in three parts of the month, each save replacing the one before, and purged by age."""
    history, saves = _store(spark), _saves(spark, sf).withColumn("payload", F.lit(None).cast("string"))
    borders = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-03-01"]
    for i, (first, end) in enumerate(pairwise(borders)):
        part = saves.filter((F.col("created_at") >= F.lit(first).cast("timestamp")) & (F.col("created_at") < F.lit(end).cast("timestamp")))
        history.save(hs.latest_saves(part).drop("saved_at"), datetime(2024, 3, 1, i, tzinfo=UTC), redact=False)
    history.purge(CUTOFF, datetime(2024, 3, 2, tzinfo=UTC))
    return _texted(history.runs().drop("payload"))


STORED_RUNS = f"SELECT * FROM ({UPSERTED_RUNS}) WHERE created_at >= '2024-01-30 12:00:00'"


def stored_attempts(spark, sf):
    """Conversations stored as the attempts of four runs, two of them saved again without their system turns."""
    turn = F.struct("turn", "role", F.col("text").alias("content"), F.array().cast(f"array<{TOOL_CALL}>").alias("tool_calls"))
    recorded = (
        src.table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .select(F.concat(F.lit("run_"), F.col("conv_id") % 4).alias("run_id"), F.col("conv_id").cast("string").alias("scenario_id"), "turns")
        .withColumn("turns", F.transform("turns", lambda t: t.dropFields("turn")))
    )
    whole = recorded.select(*[_or_null(recorded, f) for f in StructType.fromDDL(RECORDED_ATTEMPT)])
    history = _store(spark)
    history.save_attempts(whole, datetime(2024, 3, 1, tzinfo=UTC), redact=False)
    spoken = whole.withColumn("turns", F.filter("turns", lambda t: t["role"] != "system"))
    history.save_attempts(spoken.filter("run_id in ('run_1', 'run_3')"), datetime(2024, 3, 2, tzinfo=UTC), redact=False)
    both = history.get_attempts("run_0").unionByName(history.get_attempts("run_1"))
    said = F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["content"])), "\n")
    return both.select("run_id", F.col("scenario_id").cast("bigint").alias("conv_id"), F.size("turns").alias("n_turns"), F.md5(said).alias("turns_md5"))


def _or_null(rows, field):
    return F.col(field.name) if field.name in rows.columns else F.lit(None).cast(field.dataType).alias(field.name)


STORED_ATTEMPTS = """SELECT 'run_' || conv_id % 4 AS run_id, conv_id, CAST(count(text) FILTER (kept) AS INTEGER) AS n_turns,
  md5(coalesce(string_agg(role || ':' || text, chr(10) ORDER BY turn) FILTER (kept), '')) AS turns_md5
FROM (SELECT *, conv_id % 4 = 0 OR role <> 'system' AS kept FROM conversations WHERE conv_id % 4 < 2) GROUP BY conv_id"""


QUERIES = {
    "history_stored_runs": (stored_runs, STORED_RUNS),
    "history_stored_attempts": (stored_attempts, STORED_ATTEMPTS),
    "history_saved_payloads": (saved_payloads, SAVED_PAYLOADS),
    "history_latest_saves": (upserted_runs, UPSERTED_RUNS),
    "history_upsert": (upsert, UPSERTED_RUNS),
    "history_run_summaries": (run_summaries, RUN_SUMMARIES),
    "history_list_runs": (list_runs, LIST_RUNS),
    "history_get_run": (get_run, GET_RUN),
    "history_latest_run": (latest_run, LATEST_RUN),
    "history_kept_runs": (kept_runs, KEPT_RUNS),
    "history_purged_count": (purged_count, PURGED_COUNT),
    "history_retention": (retained_saves, RETAINED_SAVES),
    "history_runs_with_tag": (tagged_runs, TAGGED_RUNS),
    "history_runs_with_tag_first": (tagged_runs_filter_first, TAGGED_RUNS_FILTER_FIRST),
    "audit_rows": (audit_rows, AUDIT_ROWS),
    "audit_list": (list_audit_events, LIST_AUDIT_EVENTS),
}
