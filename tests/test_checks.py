"""Every check kind on tiny transcripts, by both ways of evaluation."""

import json
import re

import pytest
from pyspark.sql import functions as F
from tables import check_table, turns_table

from auditlake.operators import checks as ck
from auditlake.operators import judging as jd
from auditlake.operators import transcripts as tr
from auditlake.schemas import ATTEMPT_KEY, TURNS


def evaluate(spark, turns, *checks, **kw):
    """Results of flat turns; attempts holding their texts must give the same."""
    t, c = turns_table(spark, turns), check_table(spark, *checks)
    # Building only the kinds in use keeps the tests quick.
    kinds = {k["type"] for k in checks}
    kw.setdefault("check_types", ck.only(*kinds) if kinds <= set(ck.CHECK_TYPES) else None)
    flat = ck.results_of(ck.evaluate_turns(t, c, **kw)).orderBy("check_pos").collect()
    if set(kw) == {"check_types"} and kw["check_types"]:
        texts = tr.transcript_texts(t)
        tools = t.groupBy(*ATTEMPT_KEY).agg(F.flatten(F.collect_list(F.transform("tool_calls", lambda x: x["name"]))).alias("tools"))
        whole = ck.results_of(ck.evaluate_attempts(texts.join(tools, ATTEMPT_KEY), c, kw["check_types"])).orderBy("check_pos").collect()
        assert [r.asDict() for r in whole] == [r.asDict() for r in flat]
    return flat


def passed(rows):
    return [r.passed for r in rows]


def test_required_phrase(spark):
    check = {"type": "required_phrase", "patterns": ["finance charge", "payoff"]}
    both = evaluate(spark, [("agent", "The Finance Charge and"), ("customer", "ok"), ("agent", "the payoff")], check)
    one = evaluate(spark, [("agent", "the finance charge"), ("customer", "payoff")], check)
    assert passed(both) == [True] and both[0].evidence == "" and both[0].message == "All required disclosures present."
    assert passed(one) == [False] and one[0].evidence == "payoff"


def test_required_phrase_without_patterns_passes(spark):
    assert passed(evaluate(spark, [("agent", "x")], {"type": "required_phrase"})) == [True]


def test_prohibited_phrase(spark):
    rows = evaluate(spark, [("agent", "you might be too old")], {"type": "prohibited_phrase", "patterns": ["young", "too old", "old"]})
    assert passed(rows) == [False] and rows[0].evidence == "too old; old"


def test_phrase_over_a_turn_break(spark):
    rows = evaluate(
        spark,
        [("agent", "first part"), ("customer", "no"), ("agent", "second part")],
        {"type": "required_phrase", "patterns": ["part\nsecond"]},
        {"type": "required_phrase", "patterns": ["part\nno"], "scope": "all"},
        {"type": "required_phrase", "patterns": ["part second"]},
    )
    assert passed(rows) == [True, True, False]


def test_case_sensitivity(spark):
    rows = evaluate(
        spark,
        [("agent", "the apr is free")],
        {"type": "required_phrase", "patterns": ["APR"], "case_sensitive": True},
        {"type": "required_phrase", "patterns": ["APR"]},
        {"type": "prohibited_phrase", "patterns": ["FREE"], "case_sensitive": True},
        {"type": "regex", "patterns": ["A[P]R"], "case_sensitive": True},
        {"type": "regex", "patterns": ["A[P]R"]},
    )
    assert passed(rows) == [False, True, True, False, True]


def test_regex(spark):
    must, must_not = {"type": "regex", "patterns": [r"\$\s?\d+"]}, {"type": "regex", "patterns": ["guarantee[ds]?"], "must_appear": False}
    assert passed(evaluate(spark, [("agent", "a $35 fee")], must)) == [True]
    missing = evaluate(spark, [("agent", "a fee")], must)
    assert passed(missing) == [False] and missing[0].evidence == r"\$\s?\d+"
    found = evaluate(spark, [("agent", "it is guaranteed")], must_not)
    assert passed(found) == [False] and found[0].evidence == "guarantee[ds]?" and found[0].message == "Forbidden pattern matched."


PATTERNS = [
    r"\$\s?\d+", r"a\W+b", "x[^y]z", r"^two", r"one$", "(?s)one.two", r"\Bne\b", "one\ntwo", "a.b", r"\bone\b",
    "(?:on|of)e", r"\S+e", "z*", r"(?P<word>t)wo", r"two\Z", r"\\Z",
]
PARTS = [["cost is $", "5 a", "b xx", "zone"], ["one", "two"], ["a", "b"], ["x", "z"], ["someone", "tw"], ["", ""]]


def test_patterns_over_a_turn_break_match_as_in_the_joined_text(spark):
    """Patterns are tested turn by turn only where that cannot differ; Python's re on the joined text decides."""
    turns = spark.createDataFrame(
        [("r", "s", n, i, "agent", p, []) for n, parts in enumerate(PARTS) for i, p in enumerate(parts)], TURNS
    )
    checks = check_table(spark, *[{"type": "regex", "patterns": [p], "case_sensitive": True} for p in PATTERNS])
    results = ck.results_of(ck.evaluate_turns(turns, checks, check_types=ck.only("regex"))).collect()
    got = {(r.attempt, r.check_pos): r.passed for r in results}
    for n, parts in enumerate(PARTS):
        for i, pattern in enumerate(PATTERNS):
            assert got[n, i] == (re.search(pattern, "\n".join(parts)) is not None), (pattern, parts)


def test_line_bound_patterns_are_recognised(spark):
    safe = ["a.b", r"\bone\b", "(?:on|of)e", r"\S+e", "[a-z]{2}", r"\$ ?\d+", r"fee\."]
    unsafe = [r"\s", r"\D", r"\W", "[^a]", "^a", "a$", "(?s)a.b", "(?!a)b", "a\nb", r"\Ba", r"a\n", r"[\s]", r"\x0a"]
    c = check_table(spark, *[{"type": "regex", "patterns": [p]} for p in safe + unsafe])
    local = ck.with_check_defaults(c).withColumn("local", ck.turn_local()).orderBy("check_pos").collect()
    assert [r.local for r in local] == [True] * len(safe) + [False] * len(unsafe)


def test_scope_all_sees_every_turn(spark):
    turns = [("system", "be polite"), ("customer", "you are too old"), ("agent", "no")]
    rows = evaluate(
        spark,
        turns,
        {"type": "prohibited_phrase", "patterns": ["too old"], "scope": "all"},
        {"type": "prohibited_phrase", "patterns": ["too old"]},
        {"type": "regex", "patterns": ["pol.te"], "scope": "all"},
    )
    assert passed(rows) == [False, True, True]


def test_tool_calls(spark):
    turns = [("agent", "done", [("log_reasoning", "{}", "{}")]), ("tool", "", [("initiate_transfer", "{}", None)])]
    rows = evaluate(
        spark,
        turns,
        {"type": "tool_call_expected", "patterns": ["log_reasoning"]},
        {"type": "tool_call_expected", "patterns": ["get_account", "log_reasoning", "get_account"]},
        {"type": "tool_call_forbidden", "patterns": ["initiate_transfer", "other"]},
        {"type": "tool_call_forbidden", "patterns": ["update_record"]},
    )
    assert passed(rows) == [True, False, False, True]
    assert rows[1].evidence == "get_account; get_account" and rows[2].evidence == "initiate_transfer"


def test_no_pii_leak(spark):
    turns = [("customer", "mail a@b.example.com"), ("agent", "SSN 412-55-9931, again 412-55-9931, card 4111 1111 1111 1111")]
    rows = evaluate(
        spark,
        turns,
        {"type": "no_pii_leak"},
        {"type": "no_pii_leak", "pii_types": ["email"]},
        {"type": "no_pii_leak", "pii_types": ["email"], "scope": "all"},
        {"type": "no_pii_leak", "pii_types": ["credit_card", "ssn"]},
    )
    assert passed(rows) == [False, True, False, False]
    assert rows[3].evidence == "credit_card:****1111, ssn:****9931"


def test_pii_split_over_turns(spark):
    rows = evaluate(spark, [("agent", "routing number"), ("customer", "x"), ("agent", "021000021")], {"type": "no_pii_leak", "pii_types": ["routing_number"]})
    assert passed(rows) == [False]


def test_lengths(spark):
    text = "   twelve chars\n "
    rows = evaluate(
        spark,
        [("agent", text)],
        {"type": "min_length", "min_length": 20},
        {"type": "min_length", "min_length": 12},
        {"type": "min_length"},
        {"type": "max_length", "max_length": 10},
        {"type": "max_length", "max_length": 0},
    )
    assert passed(rows) == [False, True, True, False, True]
    assert rows[0].message == "Response length is 12 characters." and rows[0].evidence == "min required: 20"
    assert rows[2].evidence == "min required: 10" and rows[4].evidence == "max allowed: 1000"


def test_length_counts_code_points(spark):
    rows = evaluate(spark, [("agent", "😀" * 11)], {"type": "max_length", "max_length": 10})
    assert rows[0].message == "Response length is 11 characters."


def latency(spark, agent_ms, judge_ms, *checks):
    usage = spark.createDataFrame(
        [("r", "s", 0, "agent", None, 1, 1, 0.0, agent_ms, 1)],
        "run_id string, scenario_id string, attempt int, source string, check_pos int, prompt_tokens bigint, "
        "completion_tokens bigint, cost_usd double, latency_ms double, model_calls bigint",
    )
    judge = spark.createDataFrame(
        [("r", "s", 0, pos, f"c{pos}", "yes\nfine", ms) for pos, ms in judge_ms.items()],
        "run_id string, scenario_id string, attempt int, check_pos int, check_id string, content string, latency_ms double",
    )
    return evaluate(spark, [("agent", "x")], *checks, usage=usage, judge=judge)


def test_latency(spark):
    limit = {"type": "max_latency", "max_latency_ms": 100.0}
    assert passed(latency(spark, 50.0, {}, limit)) == [True]
    slow = latency(spark, 150.0, {}, limit)
    assert passed(slow) == [False]
    assert slow[0].message == "Total latency is 150.0ms." and slow[0].evidence == "max allowed: 100.0ms"
    assert passed(latency(spark, 5000.0, {}, {"type": "max_latency"})) == [True]
    assert passed(latency(spark, 5000.1, {}, {"type": "max_latency"})) == [False]


def test_latency_counts_earlier_judge_calls_only(spark):
    limit = {"type": "max_latency", "max_latency_ms": 12.0}
    rows = latency(spark, 10.0, {1: 5.0}, limit, {"type": "llm_judge", "rubric": "r"}, limit)
    assert passed(rows) == [True, True, False]


JSON_CASES = [
    '{"status": "ok"}', "not json", '{"a":1} x', "1,2", '{"a":1}]', '{"a":1,"a":2}', " 12 ", '"x"', "null", "", "01",
    '{"a":1,}', "[1,2,[3]]", "1],[2", "{'a':1}", '"a\nb"', '{"a": "b\\u00e9"}', "NaN", "-Infinity", "1e5", "{} {}", "tru",
]


def test_json_valid(spark):
    def valid(text):
        try:
            json.loads(text.strip())
            return True
        except ValueError:
            return False

    rows = [(t, valid(t)) for t in JSON_CASES]
    from auditlake.functions.text import json_valid

    df = spark.createDataFrame(rows, "t string, expected boolean").withColumn("got", json_valid(F.col("t")))
    assert [(r.t, r.got) for r in df.collect()] == rows
    assert passed(evaluate(spark, [("agent", '{"a":'), ("customer", "?"), ("agent", "1}")], {"type": "json_valid"})) == [True]


def test_judge_needs_responses(spark):
    with pytest.raises(Exception, match="needs judge responses"):
        evaluate(spark, [("agent", "x")], {"type": "llm_judge", "rubric": "r"})


def test_unknown_type_is_an_error(spark):
    with pytest.raises(Exception, match="Unknown check type: mystery"):
        evaluate(spark, [("agent", "x")], {"type": "mystery"})


def test_judged_checks(spark):
    t = turns_table(spark, [("agent", "This is risk-free, guaranteed approval")])
    c = check_table(spark, {"type": "llm_judge", "rubric": "clear"}, {"type": "llm_judge", "rubric": "x", "judge_pass_if": "no"})
    judge = jd.answer_by_markers(jd.judge_requests(tr.agent_texts(t), c))
    rows = ck.results_of(ck.evaluate_turns(t, c, judge=judge)).orderBy("check_pos").collect()
    assert passed(rows) == [False, True]
    assert rows[0].message == "LLM-judge verdict: no." and rows[0].evidence.startswith("Detected misleading")


def test_results_keep_catalog_order_and_fields(spark):
    rows = evaluate(
        spark,
        [("agent", "hello")],
        {"type": "json_valid", "regulations": ["A", "B"], "severity": "low"},
        {"type": "required_phrase", "patterns": ["hello"]},
        {"type": "min_length"},
    )
    assert [(r.check_id, r.severity, r.regulations) for r in rows] == [("c0", "low", ["A", "B"]), ("c1", "medium", []), ("c2", "medium", [])]


def test_outcome_of_attempts(spark):
    t = turns_table(spark, [("agent", "hi")])
    c = check_table(spark, {"type": "required_phrase", "patterns": ["bye"], "severity": "critical"}, {"type": "json_valid", "severity": "low"},
                    {"type": "prohibited_phrase", "patterns": ["bye"], "severity": "high"})
    out = ck.with_outcome(ck.evaluate_turns(t, c)).first()
    assert (out.passed, out.violations, out.violation_weight, out.possible_weight) == (False, 2, 16, 23)
    none = ck.with_outcome(ck.evaluate_turns(t, c.filter("scenario_id = 'other'"))).first()
    assert (none.passed, none.violations, none.possible_weight) == (True, 0, 0)
    flat = ck.scenario_outcomes(t.select(*ATTEMPT_KEY).distinct(), ck.results_of(ck.evaluate_turns(t, c))).first()
    assert (flat.passed, flat.violations, flat.violation_weight) == (False, 2, 16)


def test_screened_turns_agree_with_joined_text(spark):
    turns = [("customer", "The fee"), ("agent", "The FEE is $5"), ("agent", "Payoff now")]
    checks = [
        {"type": "required_phrase", "patterns": ["fee", "payoff"]},
        {"type": "prohibited_phrase", "patterns": ["FEE"], "case_sensitive": True},
        {"type": "regex", "patterns": ["[0-9]", "now"]},
    ]
    screened = ck.screen_turns(turns_table(spark, turns), check_table(spark, *checks)).orderBy("check_pos").collect()
    assert [r.asDict() for r in screened] == [r.asDict() for r in evaluate(spark, turns, *checks)]


def test_transcript_without_agent_turn(spark):
    rows = evaluate(
        spark,
        [("customer", "hello")],
        {"type": "required_phrase", "patterns": ["hello"]},
        {"type": "required_phrase", "patterns": [""]},
        {"type": "regex", "patterns": ["x*"]},
        {"type": "min_length"},
    )
    assert passed(rows) == [False, True, True, False]


def test_nested_transcripts(spark):
    t = turns_table(spark, [("agent", "Hello", [("log", "{}", None)]), ("customer", "x")])
    nested = t.groupBy(*ATTEMPT_KEY).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "tool_calls"))).alias("turns"))
    c = check_table(spark, {"type": "required_phrase", "patterns": ["hello"]}, {"type": "tool_call_expected", "patterns": ["log"]})
    assert passed(ck.results_of(ck.evaluate_attempts(ck.nested_attempts(nested), c)).collect()) == [True, True]


def test_custom_check_type(spark):
    def shout(check, seen):
        ok = F.upper(seen.target(check)) != seen.target(check)
        return F.struct(ok.alias("passed"), F.lit("no shouting").alias("message"), F.lit("").alias("evidence"))

    types = ck.register_check_type("no_shouting", shout)
    rows = evaluate(spark, [("agent", "HELLO")], {"type": "no_shouting"}, {"type": "min_length"}, check_types=types)
    assert passed(rows) == [False, False]


def test_reduced_turns_decide_as_the_joined_text(spark):
    """Personal data and lengths come from shortened turns and turn lengths; Python on the joined text decides."""
    import random

    from test_pii import python_findings

    rng = random.Random(11)
    pieces = ["account", "acct no", "routing number", "aba", "12345678", "021000021", "412-55", "9931", "a@b.co", "415", "555-0134",
              " ", "\n", "\t", "", "word " * 9, "x" * 40, "account " + "y" * 12, "account " + "y" * 11, ":", "(", "+1", "04/12/", "1985",
              " ", "\x1c", "é"]
    attempts = []
    for n in range(400):
        turns = [(rng.choice(["agent", "agent", "customer"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 3)))) for _ in range(rng.randint(1, 6))]
        attempts.append(turns)
    table = spark.createDataFrame(
        [("r", "s", n, i, role, text, []) for n, turns in enumerate(attempts) for i, (role, text) in enumerate(turns)], TURNS
    )
    checks = check_table(
        spark,
        {"type": "no_pii_leak"},
        {"type": "no_pii_leak", "scope": "all"},
        {"type": "min_length", "min_length": 30},
        {"type": "max_length", "max_length": 30, "scope": "all"},
    )
    results = ck.results_of(ck.evaluate_turns(table, checks, check_types=ck.only("no_pii_leak", "min_length", "max_length"))).collect()
    got = {(r.attempt, r.check_pos): r for r in results}
    assert len(got) == 4 * len(attempts)
    for n, turns in enumerate(attempts):
        agent = "\n".join(t for role, t in turns if role == "agent")
        everything = "\n".join(t for _, t in turns)
        for pos, text in ((0, agent), (1, everything)):
            assert got[n, pos].passed == (python_findings(text) == []), repr(text)
        assert got[n, 2].message == f"Response length is {len(agent.strip())} characters.", repr(agent)
        assert got[n, 2].passed == (len(agent.strip()) >= 30)
        assert got[n, 3].message == f"Response length is {len(everything.strip())} characters.", repr(everything)
