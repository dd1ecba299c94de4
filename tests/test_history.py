"""Run history, audit log and streams on files."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditlake.schemas import RUNS, TURNS
from auditlake.sources import history as hs
from auditlake.streaming import turns as st


def runs(spark, *rows):
    """(run_id, created_at, pass_rate)."""
    data = [(i, datetime.fromisoformat(at), "mock/compliant-agent", "mock/judge", rate, 11, 0, "{}") for i, at, rate in rows]
    return spark.createDataFrame(data, RUNS)


NOW = datetime(2026, 7, 4, tzinfo=UTC)


@pytest.fixture
def history(spark, tmp_path):
    return hs.RunHistory(spark, str(tmp_path / "store"))


def test_empty_store(spark, history):
    assert history.runs().count() == 0 and history.audit_events().count() == 0 and history.purge(NOW, NOW) == 0
    assert hs.latest_run(history.runs()).count() == 0


def test_save_list_get_latest(spark, history):
    history.save(runs(spark, ("run-old", "2026-07-01T10:00:00", 1.0), ("run-new", "2026-07-03T10:00:00", 0.5)), NOW)
    listed = hs.list_runs(history.summaries()).collect()
    assert [r.run_id for r in listed] == ["run-new", "run-old"] and "payload" not in listed[0]
    assert hs.list_runs(history.summaries(), 1).count() == 1
    assert hs.get_run(history.runs(), "run-old").first().pass_rate == 1.0
    assert hs.get_run(history.runs(), "missing").count() == 0
    assert hs.latest_run(history.runs()).first().run_id == "run-new"
    assert {r.event_type for r in history.audit_events().collect()} == {"run_saved"}


def test_saving_again_replaces(spark, history):
    history.save(runs(spark, ("run-1", "2026-07-03T10:00:00", 1.0)), NOW)
    history.save(runs(spark, ("run-1", "2026-07-03T10:00:00", 0.5)), NOW + timedelta(seconds=1))
    assert [r.pass_rate for r in history.runs().collect()] == [0.5]


def test_purge(spark, history):
    history.save(runs(spark, ("old", "2020-01-01T00:00:00", 1.0), ("kept", "2030-01-01T00:00:00", 1.0)), NOW)
    assert history.purge(datetime(2025, 1, 1, tzinfo=UTC), NOW) == 1
    assert [r.run_id for r in history.runs().collect()] == ["kept"]
    stored = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(history.root + "/runs/data")
    assert [r.run_id for r in stored.collect()] == ["kept"]
    event = history.audit_events().filter("event_type = 'runs_purged'").first()
    assert json.loads(event.details) == {"before": "2025-01-01T00:00:00+00:00", "count": 1}
    assert history.purge(datetime(2025, 1, 1, tzinfo=UTC), NOW) == 0
    assert history.audit_events().filter("event_type = 'runs_purged'").count() == 1


def test_purge_does_not_bring_back_a_replaced_save(spark, history):
    history.save(runs(spark, ("r", "2030-01-01T00:00:00", 1.0)), NOW)
    history.save(runs(spark, ("r", "2020-01-01T00:00:00", 0.5)), NOW + timedelta(seconds=1))
    assert history.purge(datetime(2025, 1, 1, tzinfo=UTC), NOW) == 1 and history.runs().count() == 0


def test_files_without_a_version_are_no_part_of_the_table(spark, history):
    history.save(runs(spark, ("r", "2026-07-01T00:00:00", 1.0)), NOW)
    history.run_log.write(runs(spark, ("lost", "2026-07-01T00:00:00", 1.0)).withColumn("saved_at", F.lit(NOW)))
    assert [r.run_id for r in history.runs().collect()] == ["r"]


def test_naive_cutoff_is_an_error(spark, history):
    with pytest.raises(ValueError, match="timezone-aware"):
        history.purge(datetime(2025, 1, 1), NOW)


def test_retention(spark, history):
    removed = history.save(runs(spark, ("old", "2026-06-01T00:00:00", 1.0), ("new", "2026-07-03T00:00:00", 1.0)), NOW, retention_days=30)
    assert removed == 1 and [r.run_id for r in history.runs().collect()] == ["new"]
    assert history.audit_events().filter("event_type = 'runs_retention_purged'").count() == 1
    for days in (0, -1, 1.5, True):
        with pytest.raises(ValueError, match="at least 1"):
            hs.retention_cutoff(days, NOW)


def test_audit_events_are_redacted_and_newest_first(spark, history):
    rows = [("e1", NOW, "first", '{"password": "do-not-store", "z": 1}'), ("e2", NOW + timedelta(hours=1), "second", '{"run_id": "run-2"}')]
    history.append_audit(spark.createDataFrame(rows, "event_id string, created_at timestamp, event_type string, details string"))
    listed = hs.list_audit_events(history.audit_events()).collect()
    assert [r.event_type for r in listed] == ["second", "first"]
    assert listed[1].details["password"] == "[REDACTED:SENSITIVE]"
    assert hs.list_audit_events(history.audit_events(), 1).count() == 1


def test_latest_save_of_many(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("run_id"), F.col("id").alias("saved_at"), (F.col("id") * 2).alias("v"))
    assert [tuple(r) for r in hs.latest_saves(rows).collect()] == [("hot", 4999, 9998)]


def test_rows_of_the_history_come_from_the_metrics(spark, history):
    metrics = spark.createDataFrame([("r", 1 / 3, 3, 2, 0.5)], "run_id string, pass_rate double, total_runs bigint, total_violations bigint, weighted_score double")
    plain = runs(spark, ("r", "2026-07-01T00:00:00", 0.0)).select("run_id", "created_at", "agent_model", "judge_model")
    history.save(hs.summarize_runs(plain, metrics), NOW)
    row = history.runs().first()
    assert (row.pass_rate, row.total_runs, row.violations, json.loads(row.payload)["weighted_score"]) == (0.3333, 3, 2, 0.5)


def test_saving_computes_the_runs_once(spark, history):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = runs(spark, ("a", "2026-07-01T00:00:00", 1.0), ("b", "2026-07-01T00:00:00", 1.0))
    history.save(rows.mapInArrow(count, rows.schema), NOW)
    assert seen.value == 2 and history.audit_events().count() == 2


def test_stream_of_runs_is_saved_once_per_run(spark, history, tmp_path):
    inbox = str(tmp_path / "inbox")
    runs(spark, ("a", "2026-07-01T00:00:00", 1.0), ("b", "2026-07-02T00:00:00", 0.4)).write.json(inbox)
    clock = iter(NOW + timedelta(minutes=i) for i in range(9))
    for _ in range(2):
        source = spark.readStream.schema(RUNS).json(inbox)
        st.save_stream(source, history, str(tmp_path / "checkpoint"), lambda: next(clock)).awaitTermination()
        runs(spark, ("b", "2026-07-02T00:00:00", 0.8)).write.mode("append").json(inbox)
    st.save_stream(spark.readStream.schema(RUNS).json(inbox), history, str(tmp_path / "checkpoint"), lambda: next(clock)).awaitTermination()
    assert {(r.run_id, r.pass_rate) for r in history.runs().collect()} == {("a", 1.0), ("b", 0.8)}


def test_stream_of_turns_reports_what_is_forbidden(spark, tmp_path):
    from tables import check_table

    inbox = str(tmp_path / "turns")
    rows = [("r", "s", 0, 0, "customer", "too old", []), ("r", "s", 0, 1, "agent", "Too OLD, act now", [("pay", "{}", None)]), ("r", "t", 0, 0, "agent", "too old", [])]
    spark.createDataFrame(rows, TURNS).write.parquet(inbox)
    checks = check_table(
        spark,
        {"type": "required_phrase", "patterns": ["too old"]},
        {"type": "prohibited_phrase", "patterns": ["young", "too old"], "severity": "high"},
        {"type": "regex", "patterns": ["act +now"], "must_appear": False},
        {"type": "regex", "patterns": ["act now"]},
        {"type": "tool_call_forbidden", "patterns": ["pay"]},
    )
    alerts = st.forbidden_alerts(spark.readStream.schema(TURNS).parquet(inbox), checks)
    query = alerts.writeStream.format("memory").queryName("forbidden").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.turn, r.check_id, r.severity, r.evidence) for r in spark.table("forbidden").collect()) == [
        (1, "c1", "high", "too old"), (1, "c2", "medium", "act +now"), (1, "c4", "medium", "pay")
    ]


def test_stream_of_turns_raises_alerts(spark, tmp_path):
    inbox = str(tmp_path / "turns")
    rows = [("r", "s", 0, 0, "customer", "my SSN is 412-55-9931", []), ("r", "s", 0, 1, "agent", "SSN 412-55-9931", []), ("r", "s", 0, 2, "agent", "fine", [])]
    spark.createDataFrame(rows, TURNS).write.parquet(inbox)
    alerts = st.pii_alerts(spark.readStream.schema(TURNS).parquet(inbox))
    query = alerts.writeStream.format("memory").queryName("alerts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.turn, r.evidence) for r in spark.table("alerts").collect()] == [(1, "ssn:****9931")]


def _saved_run(spark, payload, run_id="r1", created=None):
    from datetime import UTC, datetime

    when = created or datetime(2024, 5, 1, tzinfo=UTC)
    return spark.createDataFrame([(run_id, when, "a", "j", 1.0, 1, 0, payload)], RUNS_SCHEMA)


RUNS_SCHEMA = (
    "run_id string, created_at timestamp, agent_model string, judge_model string, pass_rate double, total_runs bigint, violations bigint, payload string"
)


def test_saved_payloads_hold_no_secrets(spark, tmp_path):
    import json
    from datetime import UTC, datetime

    from auditlake.sources.history import RunHistory

    now = datetime(2024, 6, 1, tzinfo=UTC)
    payload = json.dumps({"note": "mail a.b@example.com, ssn 123-45-6789, code pa\"ss", "args": {"password": 'pa"ss'}, "n": 3})
    history = RunHistory(spark, str(tmp_path / "h"))
    history.save(_saved_run(spark, payload), now)
    stored = history.runs().first().payload
    assert "example.com" not in stored and "6789" not in stored and 'pa\\"ss' not in stored and json.loads(stored)["n"] == 3
    raw = RunHistory(spark, str(tmp_path / "raw"))
    raw.save(_saved_run(spark, payload), now, redact=False)
    assert raw.runs().first().payload == payload


def test_a_batch_delivered_again_adds_no_audit_event(spark, tmp_path):
    from datetime import UTC, datetime

    from auditlake.sources.history import RunHistory

    history = RunHistory(spark, str(tmp_path / "h"))
    for minute in (0, 5):
        history.save(_saved_run(spark, "{}"), datetime(2024, 6, 1, 0, minute, tzinfo=UTC), save_id="stream:7")
    assert history.audit_events().count() == 1 and history.runs().count() == 1
    history.save(_saved_run(spark, "{}"), datetime(2024, 6, 2, tzinfo=UTC), save_id="stream:8")
    assert history.audit_events().count() == 2


def test_runs_without_a_date_survive_a_purge_and_the_count_is_a_number(spark, tmp_path):
    import json
    from datetime import UTC, datetime

    from auditlake.sources.history import RunHistory

    now = datetime(2024, 6, 1, tzinfo=UTC)
    history = RunHistory(spark, str(tmp_path / "h"))
    old = _saved_run(spark, "{}", "old", datetime(2020, 1, 1, tzinfo=UTC))
    undated = spark.createDataFrame([("none", None, "a", "j", 1.0, 1, 0, "{}")], RUNS_SCHEMA)
    history.save(old.union(undated).union(_saved_run(spark, "{}", "new")), now)
    assert history.purge(datetime(2023, 1, 1, tzinfo=UTC), now) == 1
    assert {r.run_id for r in history.runs().collect()} == {"none", "new"}
    event = history.audit_events().where("event_type = 'runs_purged'").first()
    assert json.loads(event.details)["count"] == 1


# --- the log of the table's files ---------------------------------------------------------------


def paths_of(log):
    return {r.path for r in log.live().select("path").collect()}


def test_a_purge_leaves_files_without_purged_runs_as_they_are(spark, history):
    for year in range(2018, 2026):
        history.save(runs(spark, *[(f"run-{year}-{i}", f"{year}-03-01T00:00:00", 1.0) for i in range(6)]), NOW + timedelta(minutes=year))
    before = paths_of(history.run_log)
    assert history.purge(datetime(2020, 1, 1, tzinfo=UTC), NOW) == 12
    after = paths_of(history.run_log)
    old = {r.path for r in history.run_log.live(8).filter("least_time < '2020-01-01'").select("path").collect()}
    assert before - old <= after and not old & after and len(before - old) > 10
    assert history.runs().count() == 36


def test_bytes_of_a_run_saved_a_hundred_times_stay_bounded(spark, tmp_path):
    from auditlake.sources.tablelog import TableLog

    log = TableLog(spark, str(tmp_path / "t"), hs.SAVES, "run_id", "created_at", grace=0)
    row = runs(spark, ("r", "2026-07-01T00:00:00", 1.0)).coalesce(1)
    sizes = []
    for i in range(30):
        added = log.append(row.withColumn("saved_at", F.lit(NOW + timedelta(minutes=i))))
        log.compact([f["bucket"] for f in added], hs.latest_saves)
        sizes.append(log.live().agg(F.sum("rows")).first()[0])
    assert max(sizes) <= 8 and hs.latest_saves(log.read()).first().saved_at == (NOW + timedelta(minutes=29)).replace(tzinfo=None)
    # Replaced files go from the disk as well, and so do the versions before a snapshot.
    assert spark.read.option("recursiveFileLookup", True).parquet(log.root + "/data").count() < 20
    assert len([n for n in log._names("_log") if n.endswith(".json")]) < 20


def test_a_merge_leaves_the_files_of_readers(spark, tmp_path):
    from auditlake.sources.tablelog import TableLog

    log = TableLog(spark, str(tmp_path / "t"), hs.SAVES, "run_id", "created_at")
    for i in range(8):
        added = log.append(runs(spark, ("r", "2026-07-01T00:00:00", float(i))).coalesce(1).withColumn("saved_at", F.lit(NOW + timedelta(minutes=i))))
    reader = log.read()
    assert log.compact([f["bucket"] for f in added], hs.latest_saves) == 8
    assert reader.count() == 8 and log.read().count() == 1


def test_two_writers_do_not_lose_each_others_saves(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from auditlake.sources.tablelog import TableLog

    logs = [TableLog(spark, str(tmp_path / "t"), hs.SAVES, "run_id", "created_at") for _ in range(2)]

    def write(n):
        for i in range(6):
            logs[n].append(runs(spark, (f"w{n}-{i}", "2026-07-01T00:00:00", 1.0)).coalesce(1).withColumn("saved_at", F.lit(NOW)))

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, range(2)))
    assert {r.run_id for r in logs[0].read().collect()} == {f"w{n}-{i}" for n in range(2) for i in range(6)}
    assert logs[0].version() == 12


def test_a_change_of_files_another_writer_replaced_is_a_conflict(spark, history):
    from auditlake.sources.tablelog import Conflict

    history.save(runs(spark, ("a", "2020-01-01T00:00:00", 1.0), ("b", "2026-07-01T00:00:00", 1.0)), NOW)
    log = history.run_log
    held, version = sorted(paths_of(log)), log.version()
    log.replace(held[:1], log.open([]))
    with pytest.raises(Conflict):
        log.commit([], held[:1])
    assert log.read(version=log.version()).count() == 1 and log.live(version).count() == len(held)
    # A purge that meets such a conflict begins anew.
    calls = []
    real = history._purge_runs
    history._purge_runs = lambda before: calls.append(1) or (real(before) if len(calls) > 1 else (_ for _ in ()).throw(Conflict("first")))
    assert history.purge(datetime(2025, 1, 1, tzinfo=UTC), NOW) in (0, 1) and len(calls) == 2


def test_a_reader_begins_at_a_snapshot_and_ignores_an_unfinished_one(spark, tmp_path):
    from auditlake.sources import tablelog

    log = tablelog.TableLog(spark, str(tmp_path / "t"), hs.SAVES, "run_id", "created_at")
    for i in range(tablelog.SNAPSHOT + 1):
        log.commit([{"path": f"data/x/{i}.parquet", "bucket": i % 3, "buckets": 3, "rows": 1, "bytes": 10, "least_key": "a", "greatest_key": "z", "least_time": None, "greatest_time": None}])
    assert log.live().count() == tablelog.SNAPSHOT + 1
    spark.range(1).write.parquet(f"{log.root}/_snapshots/{tablelog.SNAPSHOT + 1}/part")
    assert log.live().count() == tablelog.SNAPSHOT + 1
    log.commit([], ["data/x/0.parquet"])
    assert log.live().count() == tablelog.SNAPSHOT


def test_a_run_is_read_whole_from_its_bucket(spark, history, tmp_path):
    from auditlake.sources import transcripts as tr

    def attempt(run, n, text):
        turns = [{"role": "agent", "content": text, "tool_calls": [{"name": "get", "arguments": "{}", "result": '{"pin": "zz81"}'}]}]
        return {"run_id": run, "scenario_id": f"s{n}", "attempt": 0, "title": "t", "passed": True, "turns": turns, "check_results": [], "usage": {"prompt_tokens": n}}

    inbox = tmp_path / "in"
    inbox.mkdir()
    lines = [attempt(f"run-{i}", n, f"the pin is zz81, mail a@b.co {n}") for i in range(40) for n in range(3)]
    (inbox / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    history.save(runs(spark, *[(f"run-{i}", "2026-07-01T00:00:00", 1.0) for i in range(40)]), NOW)
    history.save_attempts(tr.read_recorded(spark, str(inbox)), NOW)
    got = history.get_attempts("run-7")
    rows = got.orderBy("scenario_id").collect()
    assert [r.turns[0].content for r in rows] == [f"the pin is [REDACTED:SENSITIVE], mail [REDACTED:EMAIL] {n}" for n in range(3)]
    assert [r.usage.prompt_tokens for r in rows] == [0, 1, 2]
    assert len(got.inputFiles()) == 1 < history.attempt_log.live().count() and history.get_run("run-7").first().pass_rate == 1.0
    assert history.get_attempts("none").count() == 0 and history.get_run("none").count() == 0
    # Saving a run again replaces its attempts; a purge takes them along.
    (inbox / "a.json").write_text(json.dumps(attempt("run-7", 5, "again")))
    history.save_attempts(tr.read_recorded(spark, str(inbox)), NOW + timedelta(minutes=1))
    assert [r.turns[0].content for r in history.get_attempts("run-7").collect()] == ["again"]
    assert history.purge(datetime(2030, 1, 1, tzinfo=UTC), NOW) == 40 and history.attempts().count() == 0
