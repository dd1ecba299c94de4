"""Checks with very many phrases or tools: one walk per turn, the same results as phrase by phrase."""

import random
import time

import pytest
from tables import check_table

from auditlake.operators import checks as ck
from auditlake.schemas import ATTEMPT_KEY, TURNS


def some_turns(spark, rng, n, words):
    rows = []
    for i in range(n):
        for t in range(3):
            text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
            calls = [(rng.choice(words), "{}", None) for _ in range(rng.randint(0, 2))]
            rows.append(("r", "s" if i % 3 else "other", i, t, rng.choice(["agent", "customer"]), rng.choice([text, text.upper(), None]), calls))
    return spark.createDataFrame(rows, TURNS)


def by_phrase(spark, turns, checks, monkeypatch):
    monkeypatch.setattr(ck, "WIDE", 10**9)
    rows = ck.results_of(ck.evaluate_turns(turns, checks)).collect()
    monkeypatch.undo()
    return sorted(map(str, rows))


def test_wide_checks_give_the_results_of_phrase_by_phrase(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abΣς é") for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["refund", "Now"]
    many = [rng.choice(words) + rng.choice(["", "x", "X"]) for _ in range(120)] + ["", "refund", "refund"]
    lines = [*many, "two\nlines"]
    checks = check_table(
        spark,
        {"type": "prohibited_phrase", "patterns": many},
        {"type": "required_phrase", "patterns": many, "scope": "all"},
        {"type": "required_phrase", "patterns": ["refund"] * 70, "case_sensitive": True, "scope": "all"},
        {"type": "prohibited_phrase", "patterns": [p.upper() for p in many], "case_sensitive": True, "scope": "all"},
        {"type": "tool_call_forbidden", "patterns": many},
        {"type": "tool_call_expected", "patterns": words[:20]},
        {"type": "prohibited_phrase", "patterns": lines},
        {"type": "prohibited_phrase", "patterns": ["now", "refund"]},
        {"type": "min_length", "min_length": 5},
    )
    turns = some_turns(spark, rng, 40, words)
    got = sorted(map(str, ck.results_of(ck.evaluate_turns(turns, checks)).collect()))
    assert got == by_phrase(spark, turns, checks, monkeypatch) and len(got) == 26 * 9
    screened = sorted(map(str, ck.screen_turns(turns, checks).collect()))
    local = [r for r in got if "check_pos=6" not in r and "check_pos=8" not in r]
    assert screened == local


def test_registered_kinds_see_wide_checks_themselves(spark):
    own = ck.register_check_type("prohibited_phrase", lambda check, seen: ck.required_phrase(check, seen))
    checks = check_table(spark, {"type": "prohibited_phrase", "patterns": [f"p{i}" for i in range(100)]})
    turns = spark.createDataFrame([("r", "s", 0, 0, "agent", " ".join(f"p{i}" for i in range(100)), [])], TURNS)
    assert ck.results_of(ck.evaluate_turns(turns, checks, check_types=own)).first().passed


def plan_of(turns, checks):
    frame = ck.screen_turns(turns, checks)
    return frame._jdf.queryExecution().optimizedPlan().toString(), frame


def test_plan_and_time_do_not_grow_with_the_phrases(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    turns = spark.createDataFrame(
        [("r", "s", i, 0, "agent", " ".join(rng.choice(words) for _ in range(40)), []) for i in range(4000)], TURNS
    ).repartition(4)
    seconds, sizes = [], []
    for n in (100, 10_000):
        checks = check_table(spark, {"type": "prohibited_phrase", "patterns": [f"phrase number {i} of many" for i in range(n - 1)] + [words[0]]})
        plan, frame = plan_of(turns, checks)
        sizes.append(len(plan.split("\n")))
        frame.count()
        start = time.time()
        assert frame.filter("not passed").count() > 0
        seconds.append(time.time() - start)
    assert sizes[0] == sizes[1]
    # A hundred times the phrases; phrase by phrase that took a hundred times as long.
    assert seconds[1] < 5 * seconds[0] + 2


@pytest.mark.parametrize("keys", [ATTEMPT_KEY])
def test_wide_checks_on_empty_tables(spark, keys):
    checks = check_table(spark, {"type": "prohibited_phrase", "patterns": [f"p{i}" for i in range(100)]})
    none = spark.createDataFrame([], TURNS)
    assert ck.results_of(ck.evaluate_turns(none, checks)).count() == 0
    some = spark.createDataFrame([("r", "s", 0, 0, "agent", None, None)], TURNS)
    assert ck.results_of(ck.evaluate_turns(some, checks)).first().passed
