"""Metrics, percentiles, gates, budgets and report tables on hand-made runs."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import checks as ck
from auditlake.operators import gates as gt
from auditlake.operators import metrics as mt
from auditlake.operators import reports as rp

RESULT = (
    "run_id string, scenario_id string, attempt int, check_pos int, check_id string, passed boolean, severity string, "
    "regulations array<string>"
)


def run_of(spark, rows, registry=("UDAAP", "DORA", "GLBA_SAFEGUARDS", "SR_11_7"), usage=None, k=1):
    """rows: (scenario, attempt, label, [(passed, severity, regulations)])."""
    results = [
        ("r", s, a, i, f"c{i}", ok, sev, regs) for s, a, _, checks in rows for i, (ok, sev, regs) in enumerate(checks)
    ]
    attempts = spark.createDataFrame([("r", s, a, label) for s, a, label, _ in rows], "run_id string, scenario_id string, attempt int, label string")
    res = spark.createDataFrame(results, RESULT)
    reg = spark.createDataFrame([(r,) for r in registry], "id string")
    use = usage and spark.createDataFrame([("r", *u) for u in usage], USAGE)
    return mt.run_metrics(ck.scenario_outcomes(attempts, res), res, reg, use, k)


USAGE = (
    "run_id string, cost_usd double, latency_ms double, prompt_tokens bigint, completion_tokens bigint, model_calls bigint, "
    "judge_cost_usd double, judge_latency_ms double, judge_prompt_tokens bigint, judge_completion_tokens bigint, judge_model_calls bigint"
)


def one(ok, severity="medium", regs=("UDAAP",)):
    return [(ok, severity, list(regs))]


def test_empty_run_has_no_row(spark):
    assert run_of(spark, []).count() == 0


def test_detection_and_false_positives(spark):
    m = run_of(spark, [("a", 0, "violation_expected", one(False)), ("b", 0, "violation_expected", one(True)),
                       ("c", 0, "benign_control", one(False)), ("d", 0, "benign_control", one(True))]).first()
    assert (m.violation_detection_rate, m.false_positive_rate, m.pass_rate) == (0.5, 0.5, 0.5)
    assert (m.total_runs, m.passed_runs, m.failed_runs, m.scenarios) == (4, 2, 2, 4)


def test_rates_without_labelled_attempts_are_zero(spark):
    m = run_of(spark, [("a", 0, "violation_expected", one(True))]).first()
    assert (m.false_positive_rate, m.violation_detection_rate) == (0.0, 0.0)


def test_coverage(spark):
    m = run_of(spark, [("a", 0, "violation_expected", one(True, regs=["UDAAP", "DORA"])),
                       ("b", 0, "violation_expected", one(True, regs=["GLBA_SAFEGUARDS", "NOT_A_REG"]))]).first()
    assert m.regulations_covered == ["DORA", "GLBA_SAFEGUARDS", "UDAAP"]
    assert (m.regulations_total, m.compliance_coverage) == (4, 0.75)
    assert run_of(spark, [("a", 0, "benign_control", one(True))], registry=[]).first().compliance_coverage == 0.0


def test_coverage_of_a_run_without_checks(spark):
    m = run_of(spark, [("a", 0, "benign_control", [])]).first()
    assert (m.regulations_covered, m.regulations_total, m.compliance_coverage, m.weighted_score, m.pass_rate) == ([], 4, 0.0, 1.0, 1.0)


def test_reliability(spark):
    rows = [("flaky", 0, "violation_expected", one(True)), ("flaky", 1, "violation_expected", one(False)),
            ("stable", 0, "violation_expected", one(True)), ("stable", 1, "violation_expected", one(True))]
    m = run_of(spark, rows, k=2).first()
    assert (m.pass_at_1, m.pass_any, m.pass_all_k, m.reliability_drop, m.k) == (1.0, 1.0, 0.5, 0.5, 2)


def test_weighted_score(spark):
    m = run_of(spark, [("a", 0, "violation_expected", [(False, "critical", ["X"]), (True, "medium", [])])]).first()
    assert (m.possible_weight, m.violation_weight, m.weighted_score) == (18, 15, 1 - 15 / 18)
    assert rp.rounded_metrics(run_of(spark, [("a", 0, "x", [(False, "critical", []), (True, "medium", [])])])).first().weighted_score == 0.1667
    assert run_of(spark, [("a", 0, "violation_expected", one(True, "info"))]).first().weighted_score == 1.0


def test_violation_counts(spark):
    checks = [(False, "high", ["A", "B", "A"]), (False, "low", []), (True, "high", ["C"]), (False, "high", ["B"])]
    m = run_of(spark, [("a", 0, "violation_expected", checks)]).first()
    assert (m.total_violations, m.violations_high, m.violations_low, m.violations_medium) == (3, 2, 1, 0)
    assert [(e.regulation, e.violations) for e in m.violations_by_regulation] == [("A", 2), ("B", 2), ("UNSPECIFIED", 1)]


def test_usage(spark):
    usage = [(0.01, 500.0, 100, 50, 2, 0.0, 0.0, 0, 0, 0), (0.03, 1500.0, 100, 50, 1, 0.01, 10.0, 20, 5, 1)]
    m = run_of(spark, [("a", 0, "benign_control", one(True)), ("b", 0, "benign_control", one(True))], usage=usage).first()
    assert (m.cost_usd_total, m.cost_usd_per_run, m.latency_ms_total, m.latency_ms_per_run) == (0.04, 0.02, 2000.0, 1000.0)
    assert (m.tokens_prompt, m.tokens_completion, m.model_calls, m.throughput_runs_per_sec) == (200, 100, 3, 1.0)
    assert (m.judge_cost_usd_total, m.judge_latency_ms_total, m.judge_tokens_prompt, m.judge_tokens_completion, m.judge_model_calls) == (0.01, 10.0, 20, 5, 1)
    assert (m.p50_latency_ms, m.p90_latency_ms) == (1500.0, 1500.0)


def test_no_latency_means_no_throughput(spark):
    m = run_of(spark, [("a", 0, "benign_control", one(True))], usage=[(0.0, 0.0, 0, 0, 0, 0.0, 0.0, 0, 0, 0)]).first()
    assert m.throughput_runs_per_sec == 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_order_statistics_by_brute_force(spark, seed):
    rng = random.Random(seed)
    data = {f"r{n}": [rng.choice([rng.uniform(0, 1e6), 2.0, rng.uniform(0, 1e-6), -rng.uniform(0, 50), 0.0]) for _ in range(n)] for n in (1, 2, 3, 10, 16, 999)}
    rows = spark.createDataFrame([(run, v) for run, vs in data.items() for v in vs], "run_id string, latency_ms double")
    got = {r.run_id: (r.p50_latency_ms, r.p90_latency_ms) for r in mt.latency_percentiles(rows).collect()}
    assert got == {run: (sorted(vs)[len(vs) // 2], sorted(vs)[int(len(vs) * 0.9)]) for run, vs in data.items()}


def test_buckets_keep_the_order(spark):
    rng = random.Random(5)
    values = sorted(rng.choice([-1, 1]) * rng.uniform(0, 10 ** rng.randint(-8, 15)) for _ in range(3000))
    buckets = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").orderBy("v").select(mt.order_bucket(F.col("v")).alias("b")).collect()]
    assert buckets == sorted(buckets)


# --- gates and budgets -----------------------------------------------------------------------------


def test_gates(spark):
    m = spark.createDataFrame([("a", 0.5, 0.9), ("b", 0.99996, 1.0)], "run_id string, pass_rate double, weighted_score double")
    rows = {(r.run_id, r.gate): r.ok for r in gt.gates(m, fail_under=1.0, fail_under_weighted=0.95).collect()}
    assert rows == {("a", "pass_rate"): False, ("a", "weighted_score"): False, ("b", "pass_rate"): True, ("b", "weighted_score"): True}
    assert all(r.ok for r in gt.gates(m).collect())


def test_budget_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(run, seq, round(rng.uniform(0, 2), 3)) for run in ("a", "b") for seq in range(500)]
    df = spark.createDataFrame(rows, "run_id string, seq bigint, cost double")
    for block in (None, F.floor(F.col("seq") / 7)):
        out = gt.limit_breaches(df, "cost", 20.0, block=block)
        total, expected = {"a": 0, "b": 0}, {}
        for run, seq, cost in rows:
            total[run] += round(cost * 1000)
            expected[run, seq] = (total[run], cost > 20.0 or total[run] > 20000)
        assert {(r.run_id, r.seq): (round(float(r.running) * 1000), r.breach) for r in out.collect()} == expected
        first = {r.run_id: r.seq for r in gt.first_breach(out).collect()}
        assert first == {run: min(s for (x, s), (_, b) in expected.items() if x == run and b) for run in ("a", "b")}


def test_limits_are_strict_and_zero_disables(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 0.5)], "run_id string, seq bigint, cost double")
    assert [r.breach for r in gt.limit_breaches(df, "cost", 2.0).orderBy("seq").collect()] == [False, False, True]
    assert [r.breach for r in gt.limit_breaches(df, "cost", 0.9).orderBy("seq").collect()] == [True, True, True]
    assert not any(r.breach for r in gt.limit_breaches(df, "cost", 0.0).collect())


def test_effective_limit(spark):
    rows = [(None, 5.0, 5.0), (3.0, 0.0, 3.0), (3.0, 5.0, 3.0), (9.0, 5.0, 5.0), (None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "requested double, configured double, expected double")
    assert df.filter(gt.effective_limit(F.col("requested"), F.col("configured")) != F.col("expected")).count() == 0


def test_run_configuration(spark):
    df = spark.createDataFrame([("r", "02", "b", ["y", "x"]), ("r", "01", "c", ["x"]), ("q", "01", "c", [])], "run_id string, file_name string, scenario_id string, tags array<string>")
    rows = {r.run_id: r for r in gt.run_configuration(df, k=2, max_cost_usd=1.5).collect()}
    assert (rows["r"].scenario_ids, rows["r"].scenario_tags, rows["r"].k, rows["r"].max_cost_usd) == (["c", "b"], ["x", "y"], 2, 1.5)
    assert rows["q"].scenario_tags == []


# --- report tables -------------------------------------------------------------------------------------


def test_report_tables(spark):
    registry = spark.createDataFrame([(0, "A", "Rule A", "Office A")], "file_pos bigint, id string, name string, authority string")
    counts = spark.createDataFrame([("r", "A", 1), ("r", "B", 5)], "run_id string, regulation string, violations bigint")
    rows = [(r.regulation, r.name, r.authority) for r in rp.violations_table(counts, registry).collect()]
    assert rows == [("B", "B", ""), ("A", "Rule A", "Office A")]
    attempts = spark.createDataFrame([("r", "s", 0, "T", "x", False), ("r", "s", 1, "T", "x", True)], "run_id string, scenario_id string, attempt int, title string, label string, passed boolean")
    results = spark.createDataFrame([("r", "s", 0, 1, "late", False), ("r", "s", 0, 0, "first", False), ("r", "s", 1, 0, "first", True)],
                                    "run_id string, scenario_id string, attempt int, check_pos int, check_id string, passed boolean")
    shown = rp.scenario_table(attempts, results, k=2).orderBy("attempt").collect()
    assert [(r.result, r.failed_checks, r.attempt_no) for r in shown] == [("FAIL", "first, late", 1), ("PASS", "—", 2)]
    assert rp.search_scenarios(attempts, "t").count() == 2 and rp.search_scenarios(attempts, "zz").count() == 0


def test_tones(spark):
    m = spark.createDataFrame([("a", 0.9, 0.0, 0.59), ("b", 0.6, 0.01, 1.0)], "run_id string, pass_rate double, false_positive_rate double, weighted_score double")
    rows = {r.run_id: (r.pass_rate_tone, r.false_positive_tone, r.weighted_score_tone, r.history_badge) for r in rp.health_tones(m).collect()}
    assert rows == {"a": ("ok", "ok", "bad", "pass"), "b": ("warn", "bad", "ok", "fail")}
