"""Physical plans: what is shuffled, broadcast and pushed down."""

import re

import pytest
from pyspark.sql import functions as F
from tables import check_table, turns_table

from auditlake.operators import checks as ck
from auditlake.operators import redaction
from auditlake.plans import check_queries, history_queries, metric_queries
from auditlake.schemas import RUNS
from auditlake.sources import catalog as ct
from auditlake.sources import history as hs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(df):
    """The lines of the plan just below its shuffles: what is written to them."""
    lines = plan(df).split("\n")
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("turns"))
    turns_table(spark, [("agent", "hello"), ("customer", "bye")]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_catalog_files_are_broadcast_and_texts_stay(spark, catalog_dir):
    checks = ct.checks_of(ct.load_catalog(spark, catalog_dir))
    documents = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("lang").alias("scenario_id"), F.col("text").alias("agent_text"))
    p = plan(ck.evaluate_attempts(documents, checks, judge_free()))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert not any("agent_text" in line for line in p.split("\n") if "Exchange" in line)


def judge_free():
    return {k: v for k, v in ck.CHECK_TYPES.items() if k != "llm_judge"}


def test_turn_by_turn_checks_shuffle_no_text(spark, turns):
    checks = check_table(spark, {"type": "required_phrase", "patterns": ["hello"]}, {"type": "regex", "patterns": ["h.l"]})
    written = [line for line in shuffled(ck.screen_turns(turns, checks)) if "hit" in line]
    assert written and not any("content" in line for line in written)


def test_checks_are_evaluated_once(spark, turns):
    p = plan(ck.results_of(ck.evaluate_turns(turns, check_table(spark, {"type": "json_valid"}), check_types=ck.only("json_valid"))))
    assert not re.search(r"Filter.*Valid JSON", p)


def test_scans_read_only_the_columns_needed(spark):
    p = plan(metric_queries.QUERIES["violations_by_severity"][0](spark, SF))
    assert re.search(r"ReadSchema: struct<l_linenumber:int,l_quantity:double,l_returnflag:string>", p)


def test_run_id_filter_reaches_the_files(spark, tmp_path):
    from datetime import UTC, datetime

    history = hs.RunHistory(spark, str(tmp_path))
    row = [("r", datetime(2026, 7, 1), "a", "j", 1.0, 1, 0, "{}")]
    history.save(spark.createDataFrame(row, RUNS), datetime(2026, 7, 2, tzinfo=UTC))
    assert "EqualTo(run_id,r)" in plan(hs.get_run(history.runs(), "r"))
    assert "payload" not in plan(hs.list_runs(history.summaries()))


def test_listing_takes_the_first_rows_only(spark):
    assert "TakeOrderedAndProject" in plan(history_queries.list_runs(spark, SF))


def test_sensitive_arrays_beyond_the_broadcast_size_are_salted(spark, monkeypatch):
    texts = spark.createDataFrame([("r", i, f"x v{i} y") for i in range(50)], "run_id string, i int, text string")
    values = spark.createDataFrame([("r", f"v{i}") for i in range(0, 50, 7)], "run_id string, value string")
    small = redaction.redact_columns(texts, ["i"], ["text"], values)
    monkeypatch.setattr(redaction, "BROADCAST_CHARACTERS", 0)
    salted = redaction.redact_columns(texts, ["i"], ["text"], values)
    assert "_salt" in plan(salted) and "_salt" not in plan(small)
    assert sorted(salted.collect()) == sorted(small.collect())


def test_screened_documents_shuffle_nothing(spark):
    p = plan(check_queries.QUERIES["documents_no_pii_leak"][0](spark, SF))
    assert "SortMergeJoin" not in p
