"""Cases in which two paths, or a path and Python, must agree."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from tables import check_table, turns_table

from auditlake.functions.redact import flat_sensitive_values, json_sensitive_values
from auditlake.functions.severity import severity_weight
from auditlake.functions.text import has_pattern
from auditlake.operators import checks, metrics, redaction
from auditlake.schemas import RECORDED_ATTEMPT, TURNS
from auditlake.sources import transcripts


def test_redaction_does_not_depend_on_the_number_of_values(spark):
    rng = random.Random(5)
    odd = ['pa"ss-word9', "back\\slash7", "line\nbreak5", "Zürich漢字8", "ZZTOPQ", "SENS", "]x", "[", "E", "REDACTED", "tab\there", "😀k"]
    rows = []
    for run in range(3):
        secrets = odd + [f"v{rng.randrange(10**5)}" for _ in range(6)]
        for turn in range(12):
            some = rng.sample(secrets, 4)
            text = " ".join(x for s in some for x in (s, "word" + str(turn))) + " code ZZTOPQ]x"
            calls = [("tool", json.dumps({"password": some[0], "note": f"see {some[1]} and {some[0]}!"}, ensure_ascii=turn % 2 == 0), json.dumps([some[2], {"n": 1}]))]
            rows.append((f"r{run}", "s", 0, turn, "agent", text, calls))
    turns = spark.createDataFrame(rows, TURNS)
    results = [sorted(map(str, redaction.redact_turns(turns, limit=n).collect())) for n in (256, 0, 5)]
    assert results[0] == results[1] == results[2]
    assert not any('pa\\"ss-word9' in str(r) for r in results[1])


def test_percentiles_of_close_and_of_shifted_values(spark):
    rng = random.Random(3)
    for base, width in ((0.0, 1e-4), (1e9, 1.0), (-5.0, 10.0), (0.0, 0.0)):
        values = [base + rng.random() * width for _ in range(3001)] + [base] * 5
        rows = spark.createDataFrame([("r", v) for v in values], "run_id string, x double")
        got = metrics.value_at_fraction(rows, "x", {"p50": 0.5, "p90": 0.9, "first": 0.0}).first()
        ordered = sorted(values)
        assert (got.p50, got.p90, got.first) == (ordered[3006 // 2], ordered[int(3006 * 0.9)], ordered[0])


def test_close_values_do_not_meet_in_one_part(spark):
    rows = spark.range(100_000).select((F.lit(1e-6) + F.col("id") * 1e-9).alias("v"))
    buckets = rows.groupBy(metrics.order_bucket(F.col("v")).alias("b")).count()
    assert buckets.agg(F.max("count")).first()[0] < 2000


PATTERNS = [r"x{,3}y", r"(?P<a>b+)-(?P=a)", r"a[[]b", r"{name}", r"end\Z", r"[^[]z", r"a{2}b{1,}", r"\{x"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_mean_what_they_mean_in_python(spark, pattern):
    texts = ["xxy", "y", "xxxxy", "bb-bb", "b-c", "a[b", "ab", "{name}", "name", "the end", "end.", "qz", "[z", "aabb", "aab", "{x", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for known in ((), (pattern,)):
        hit = has_pattern(F.col("t"), F.lit(pattern), F.lit(True), known)
        assert [r.h for r in rows.select(hit.alias("h")).collect()] == [re.search(pattern, t) is not None for t in texts]


def test_the_last_judge_response_counts(spark):
    rows = [("r", "s", 0, 1, "yes\nfirst", 5.0, 1), ("r", "s", 0, 1, "no\nsecond", 4.0, 2)]
    judge = spark.createDataFrame(rows, "run_id string, scenario_id string, attempt int, check_pos int, content string, latency_ms double, received_at int")
    assert checks.judge_answers(judge).first().judge[1].content == "no\nsecond"
    assert checks.judge_answers(judge.drop("received_at")).first().judge[1].content == "yes\nfirst"


def test_unknown_severities_are_refused(spark):
    row = spark.createDataFrame([("odd",)], "s string")
    with pytest.raises(Exception, match="Unknown severity: odd"):
        row.select(severity_weight(F.col("s"))).collect()


def test_a_replaced_kind_sees_the_text(spark):
    def longer(check, seen):
        text = seen.target(check)
        return F.struct((F.length(text) > 3).alias("passed"), text.alias("message"), F.lit("").alias("evidence"))

    kinds = checks.register_check_type("prohibited_phrase", longer)
    turns = turns_table(spark, [("agent", "hello there")])
    table = check_table(spark, {"type": "prohibited_phrase", "patterns": ["x"]})
    result = checks.evaluate_turns(turns, table, check_types=kinds).first().check_results[0]
    assert result.passed and result.message == "hello there"


def test_truth_values_are_harvested_alike(spark):
    doc = '{"password": true, "pin": 12, "ssn": "x", "cvv": null, "note": false}'
    row = spark.createDataFrame([(doc,)], "d string").select(flat_sensitive_values(F.col("d")).alias("flat"), json_sensitive_values(F.col("d")).alias("any")).first()
    assert sorted(row.flat) == sorted(row.any) == ["12", "True", "x"]


def test_usage_configuration_and_metrics_survive_a_round_trip(spark, tmp_path):
    used = {"prompt_tokens": 5, "completion_tokens": 2, "model_calls": 1, "cost_usd": 0.5, "latency_ms": 3.0}
    whole = {"run_id": "r", "scenario_id": "s", "attempt": 0, "turns": [], "check_results": [], "agent_usage": used, "judge_usage": used, "configuration": '{"k":3}', "metrics": '{"pass_rate":1.0}', "model": "m"}
    recorded = transcripts.parse_recorded(spark.createDataFrame([(json.dumps(whole),)], "payload string"))
    transcripts.write_artifacts(recorded, str(tmp_path / "a"))
    back = transcripts.read_recorded(spark, str(tmp_path / "a")).first()
    assert (back.agent_usage.prompt_tokens, back.judge_usage.cost_usd, json.loads(back.configuration), json.loads(back.metrics), back.model) == (5, 0.5, {"k": 3}, {"pass_rate": 1.0}, "m")
    secret = json.dumps({**whole, "turns": [{"role": "agent", "content": "x", "tool_calls": [{"name": "t", "arguments": '{"password":"hush1"}'}]}], "agent_model": "m-hush1", "configuration": '{"note":"hush1"}'})
    shown = transcripts.redacted_artifacts(transcripts.parse_recorded(spark.createDataFrame([(secret,)], "payload string"))).first()
    assert "hush1" not in str(shown.agent_model) + str(shown.configuration) and shown.run_id == "r"
    usage = transcripts.usage_of(transcripts.read_recorded(spark, str(tmp_path / "a")))
    assert {(r.source, r.prompt_tokens) for r in usage.collect()} == {("agent", 5), ("judge", 5)}
    assert "agent_usage" in RECORDED_ATTEMPT
