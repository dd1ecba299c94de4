"""Catalog files, replay, judging and the whole evaluation end to end."""

import json

import pytest
from pyspark.sql import functions as F
from tables import turns_table

from auditlake.functions import judge as jf
from auditlake.operators import checks as ck
from auditlake.operators import governance as gv
from auditlake.operators import judging as jd
from auditlake.operators import metrics as mt
from auditlake.operators import reports as rp
from auditlake.operators import transcripts as tr
from auditlake.operators.redaction import harvest_turns, redact_recorded
from auditlake.schemas import ATTEMPT_KEY
from auditlake.sources import catalog as ct
from auditlake.sources import transcripts as recorded

K = list(ATTEMPT_KEY)


@pytest.fixture(scope="module")
def catalog(spark, catalog_dir):
    return ct.load_catalog(spark, catalog_dir)


@pytest.fixture(scope="module")
def registry(spark, registry_path):
    return ct.load_registry(spark, registry_path)


def test_catalog_in_file_order_with_defaults(spark, catalog):
    assert [r.scenario_id for r in rp.catalog_table(ct.scenarios_of(catalog)).collect()] == ["card_fee", "secret_readback", "opening_hours"]
    checks = {r.check_id: r for r in ct.checks_of(catalog).collect()}
    assert len(checks) == 7
    c = checks["mentions_delivery"]
    assert (c.check_pos, c.severity, c.case_sensitive, c.must_appear, c.scope, c.max_length, c.judge_pass_if) == (1, "medium", False, True, "agent", 100000, "yes")
    assert checks["no_pii"].pii_types == ["ssn"] and checks["no_pii"].patterns == []


def test_tag_filter(spark, catalog):
    s = ct.scenarios_of(catalog)

    def kept(option):
        return sorted(r.scenario_id for r in ct.with_tags(s, ct.parse_tags(option)).collect())

    assert kept("privacy, benign") == ["opening_hours", "secret_readback"]
    assert kept("nothing") == [] and len(kept(None)) == 3 and len(kept("")) == 3


def test_registry_keeps_the_last_entry(spark, registry):
    rows = {r.id: r for r in registry.collect()}
    assert (rows["SERVICE"].name, rows["SERVICE"].authority) == ("Service rule, revised", "New office")
    assert [r.id for r in rp.regulation_table(registry).collect()] == ["FEES", "SERVICE", "FAIR", "PRIVACY", "UNUSED"]
    cited = spark.createDataFrame([("FAIR",), ("NEW",)], "regulation string")
    assert {tuple(r) for r in ct.with_regulation(cited, registry, "regulation").collect()} == {("FAIR", "Fairness rule", "Fair office"), ("NEW", "NEW", "")}


def test_catalog_integrity(spark, catalog, registry):
    s, c = ct.scenarios_of(catalog), ct.checks_of(catalog)
    assert gv.unknown_regulations(s, c, registry).count() == 0
    assert [r.id for r in gv.unexercised_regulations(c, registry).collect()] == ["UNUSED"]
    assert gv.malformed_scenarios(s, c).count() == 0
    assert gv.adversarial_without_scripts(s, ct.scripts_of(catalog)).count() == 0
    assert [r.tag for r in gv.catalog_tags(s).collect()] == ["adversarial", "benign", "cards", "core", "fees", "privacy"]
    assert sorted(r.tag for r in gv.missing_tags(spark, s, ["cards", "fraud", "escalation"]).collect()) == ["escalation", "fraud"]
    broken = s.withColumn("regulations", F.array(F.lit("GONE")))
    assert {r.regulation for r in gv.unknown_regulations(broken, c, registry).collect()} == {"GONE"}
    bad = gv.malformed_scenarios(s.withColumn("label", F.lit("other")), c.filter("scenario_id <> 'card_fee'")).collect()
    assert {(r.scenario_id, r.no_checks, r.bad_label) for r in bad} == {("card_fee", True, True), ("secret_readback", False, True), ("opening_hours", False, True)}
    lacking = gv.adversarial_without_scripts(s, ct.scripts_of(catalog).filter("persona = 'compliant'")).collect()
    assert [(r.scenario_id, r.missing_personas) for r in lacking] == [("secret_readback", ["naive"])]


# --- replay and judge ----------------------------------------------------------------------------


def test_scripted_replies(spark):
    rows = [(["a", "b"], 0, "a"), (["a", "b"], 1, "b"), (["a", "b"], 9, "b"), ([], 0, tr.DEFAULT_REPLY)]
    df = spark.createDataFrame(rows, "script array<string>, i int, expected string")
    assert df.filter(tr.scripted_reply(F.col("script"), F.col("i")) != F.col("expected")).count() == 0


def test_personas(spark):
    rows = [("mock/naive-agent", "naive"), ("mock/compliant-agent", "compliant"), ("naive", "compliant"), ("x/y/naive", "naive")]
    df = spark.createDataFrame(rows, "m string, expected string")
    assert df.filter(tr.persona_key(F.col("m")) != F.col("expected")).count() == 0


def test_marker_judge(spark):
    def content(rubric, text):
        row = spark.range(1).select(jf.marker_judge(jf.judge_message(F.lit(rubric), F.lit(text))).alias("c")).first()
        return row.c.split("\n")[0]

    assert content("never say risk-free", "clear words") == "yes"
    assert content("x", "It is RISK-FREE today") == "no"
    # The graded text ends at its first triple quote, here as with the recorded judge.
    assert content("x", 'fine """ risk-free') == "yes"
    bare = spark.range(1).select(jf.marker_judge(F.lit("no block, 100% safe")).alias("c")).first().c
    assert bare.startswith("no\n")


VERDICTS = [
    ("yes", "yes", True, True, ""), ("YES!", "yes", True, True, ""), ("No.\nwhy\n more ", "yes", True, False, "why\n more"),
    ("maybe", "yes", False, False, ""), ("", "yes", False, False, ""), (None, "yes", False, False, ""), ("yes .", "yes", False, False, ""),
    ("no", " NO ", True, True, ""), ("\n yes:\n", "yes", True, True, ""), (" **yes**", "yes", False, False, ""),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, v[0], v[1]) for i, v in enumerate(VERDICTS)], "i int, c string, p string")
    rows = df.withColumn("v", jf.parse_verdict(F.col("c"), F.col("p"))).orderBy("i").collect()
    assert [(r.v.parsed, r.v.passed, r.v.reason) for r in rows] == [v[2:] for v in VERDICTS]
    assert rows[3].v.message == "LLM-judge verdict was inconclusive/unparsed." and rows[1].v.message == "LLM-judge verdict: yes."


def test_judge_requests_file(spark, catalog, tmp_path):
    attempts = spark.createDataFrame([("r", "card_fee", 0, "It costs $5."), ("r", "opening_hours", 0, "Nine.")], "run_id string, scenario_id string, attempt int, agent_text string")
    requests = jd.judge_requests(attempts, ct.checks_of(catalog))
    jd.write_judge_requests(requests, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 1 and lines[0]["check_id"] == "fair_wording" and [m["role"] for m in lines[0]["messages"]] == ["system", "user"]
    assert 'AGENT RESPONSE:\n"""\nIt costs $5.\n"""' in lines[0]["messages"][1]["content"]
    parsed = jd.verdicts(requests, jd.answer_by_markers(requests).filter("false"))
    assert jd.inconclusive_rate(parsed).first().inconclusive_rate == 1.0


# --- transcripts ------------------------------------------------------------------------------------


def test_texts(spark):
    t = turns_table(spark, [("system", "S"), ("customer", "c1"), ("agent", "a1"), ("customer", "c2"), ("agent", "a2")])
    row = tr.transcript_texts(t).first()
    assert (row.agent_text, row.all_text, row.n_turns) == ("a1\na2", "S\nc1\na1\nc2\na2", 5)
    assert tr.agent_texts(t).first().agent_text == "a1\na2"
    assert tr.agent_texts(t.filter("role <> 'agent'")).first().agent_text == ""


def test_usage(spark):
    rows = [("r", "s", 0, "agent", 10, 5, 0.1, 2.0, 1), ("r", "s", 0, "judge", 20, 2, 0.2, 1.0, 1), ("r", "s", 0, "agent", 1, 1, 0.0, 0.5, 1)]
    u = spark.createDataFrame(rows, "run_id string, scenario_id string, attempt int, source string, prompt_tokens bigint, completion_tokens bigint, cost_usd double, latency_ms double, model_calls bigint")
    s = tr.split_usage(u).first()
    assert (s.prompt_tokens, s.agent_prompt_tokens, s.judge_prompt_tokens, float(s.cost_usd), float(s.agent_latency_ms), s.model_calls) == (31, 11, 20, 0.3, 2.5, 3)
    t = tr.total_usage(u).first()
    assert (t.completion_tokens, float(t.latency_ms)) == (8, 3.5)


# --- end to end ----------------------------------------------------------------------------------------


def evaluated(spark, catalog, persona, k=1):
    """Replay every scenario k times with one persona, judge by markers, evaluate all checks."""
    scenarios = ct.scenarios_of(catalog)
    attempts = tr.expand_attempts(scenarios, k).withColumn("run_id", F.lit(persona))
    customer = attempts.select(*K, F.posexplode("customer_turns").alias("turn_index", "content"))
    ordered = F.array_sort(F.collect_list(F.struct("entry_pos", "text")))
    scripts = ct.scripts_of(catalog).filter(F.col("persona") == persona).groupBy("scenario_id").agg(F.transform(ordered, lambda e: e["text"]).alias("script"))
    calls = ct.scripts_of(catalog).filter(F.col("persona") == persona).select("scenario_id", "entry_pos", "tool_calls")
    turns = tr.replay(customer, scripts, K).join(calls, ["scenario_id"], "left").filter("entry_pos = 0 OR entry_pos IS NULL")
    shape = "array<struct<name:string,arguments:string,result:string>>"
    none = F.array().cast(shape)
    made = F.transform("tool_calls", lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"), F.lit(None).cast("string").alias("result")))
    turns = turns.withColumn("tool_calls", F.when((F.col("role") == "agent") & (F.col("turn") == 2), made).otherwise(none)).select(*K, "turn", "role", "content", "tool_calls")
    checks = ct.checks_of(catalog)
    requests = jd.judge_requests(tr.agent_texts(turns), checks)
    judge = jd.answer_by_markers(requests)
    done = ck.with_outcome(ck.evaluate_turns(turns, checks, judge=judge))
    return done.join(scenarios.select("scenario_id", "label", "title"), "scenario_id"), turns


@pytest.mark.parametrize("persona, expected", [("compliant", {}), ("naive", {"card_fee": 3, "secret_readback": 3})])
def test_personas_end_to_end(spark, catalog, registry, persona, expected):
    attempts, _ = evaluated(spark, catalog, persona, k=2)
    attempts = attempts.checkpoint()
    assert {r.scenario_id: r.violations for r in attempts.filter("attempt = 1 AND violations > 0").collect()} == expected
    m = mt.run_metrics(attempts, ck.results_of(attempts), registry, k=2).first()
    flagged = persona == "naive"
    assert (m.violation_detection_rate, m.false_positive_rate) == (1.0 if flagged else 0.0, 0.0)
    assert m.pass_all_k == m.pass_at_1 and m.total_runs == 6
    assert (m.compliance_coverage, m.regulations_covered) == (0.8, ["FAIR", "FEES", "PRIVACY", "SERVICE"])


def test_recorded_runs_round_trip_and_leave_redacted(spark, catalog, tmp_path):
    attempts, turns = evaluated(spark, catalog, "naive")
    said = turns.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "tool_calls"))).alias("s"))
    drop_turn = F.transform("s", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"), t["tool_calls"].alias("tool_calls")))
    run = attempts.join(said.select(*K, drop_turn.alias("turns")), K).select(
        "run_id", F.lit("2026-07-03T10:00:00+00:00").alias("created_at"), F.lit("mock/naive-agent").alias("agent_model"),
        F.lit("mock/judge").alias("judge_model"), "scenario_id", "title", "label", "attempt", "passed", "turns", "check_results",
    )
    path = str(tmp_path / "raw")
    recorded.write_artifacts(run, path, redact=False)
    back = recorded.read_recorded(spark, path)
    assert {r.scenario_id: r.turns for r in back.collect()} == {r.scenario_id: r.turns for r in run.collect()}
    assert back.first().created_ts.isoformat() == "2026-07-03T10:00:00"
    clean = str(tmp_path / "clean")
    for _ in range(2):  # writing a run again replaces it
        recorded.write_artifacts(back, clean)
    text = "\n".join(r.value for r in spark.read.text(clean).collect())
    assert "412-55-9931" not in text and "[REDACTED:SSN]" in text
    assert '"to_account\\":\\"[REDACTED:SENSITIVE]' in text and "X-1" not in text
    assert "412-55-9931" in str([r.turns for r in back.collect()])
    values = harvest_turns(recorded.turns_of(back))
    by_array, by_lookup = (redact_recorded(back, values, limit=n).orderBy("scenario_id").collect() for n in (512, 0))
    assert by_array == by_lookup
    bare = redact_recorded(back.withColumn("check_results", F.lit(None).cast(back.schema["check_results"].dataType)), values, limit=0)
    assert [r.turns for r in bare.orderBy("scenario_id").collect()] == [r.turns for r in by_array]
    again = recorded.read_recorded(spark, clean)
    assert sorted((r.scenario_id, len(r.turns), len(r.check_results)) for r in again.collect()) == sorted(
        (r.scenario_id, len(r.turns), len(r.check_results)) for r in back.collect()
    )
