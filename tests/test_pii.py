"""Detectors, redaction and the lookup of sensitive values, against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from tables import turns_table

from auditlake.functions import pii
from auditlake.functions import redact as rd
from auditlake.operators import redaction
from auditlake.operators.profile import findings_of, pii_profile
from auditlake.schemas import ATTEMPT_KEY

CASES = [
    ("My SSN is 412-55-9931", [("ssn", "412-55-9931", "ssn:****9931")]),
    ("card 4111 1111 1111 1111", [("credit_card", "4111 1111 1111 1111", "credit_card:****1111")]),
    ("card 1234 5678 9012 3456", []),
    ("Your account number is 1234567800124321.", [("bank_account", "1234567800124321", "bank_account:****4321")]),
    ("Your balance is $2,450.18.", []),
    ("jane.doe+bank@example.co.uk", [("email", "jane.doe+bank@example.co.uk", "email:****")]),
    ("(415) 555-0134", [("phone", "415) 555-0134", "phone:****0134")]),
    ("415-555-0134", [("phone", "415-555-0134", "phone:****0134")]),
    ("+1 415 555 0134", [("phone", "1 415 555 0134", "phone:****0134")]),
    ("415.555.0134", [("phone", "415.555.0134", "phone:****0134")]),
    ("born 04/12/1985", [("dob", "04/12/1985", "dob:****1985")]),
    ("the code 987-654-321 alone", []),
    ("twice 412-55-9931 and 412-55-9931", [("ssn", "412-55-9931", "ssn:****9931")]),
    ("000-12-3456, 666-12-3456, 901-22-3333, 123-00-1234, 123-45-0000", []),
    ("412 55 9931", [("ssn", "412 55 9931", "ssn:****9931")]),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    rows = findings_of(df, "text", ["i"]).collect()
    return {i: [(r.type, r.value, r.preview) for r in sorted(rows, key=lambda r: r.finding_pos) if r.i == i] for i in range(len(CASES))}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(found, i):
    assert found[i] == CASES[i][1]


def test_routing_number_needs_its_context(spark):
    df = spark.createDataFrame([(0, "routing number is 021000021"), (1, "987654321")], "i int, text string")
    rows = findings_of(df, "text", ["i"], ["routing_number", "bank_account"]).collect()
    assert [(r.i, r.type, r.value) for r in rows] == [(0, "routing_number", "021000021")]


def test_kinds_and_preview_of_short_values(spark):
    df = spark.createDataFrame([("x",)], "t string")
    row = df.select(
        F.size(pii.detect(F.lit("412-55-9931 a@b.example.com"), ["email"])).alias("n"),
        pii.preview(F.lit("ssn"), F.lit("123")).alias("p"),
    ).first()
    assert (row.n, row.p) == (1, "ssn:****")


# The detectors as Python patterns, for comparison.
PYTHON = [(d.name, re.compile(d.pattern, re.IGNORECASE if d.ignore_case else 0), d.group) for d in pii.DETECTORS]


def python_findings(text):
    def luhn(v):
        d = [int(c) for c in re.sub("[^0-9]", "", v)]
        doubled = [sum(divmod(2 * x, 10)) if (len(d) - i) % 2 == 0 else x for i, x in enumerate(d)]
        return 13 <= len(d) <= 19 and sum(doubled) % 10 == 0

    out = []
    for name, pattern, group in PYTHON:
        for m in pattern.finditer(text):
            v = m.group(group).strip()
            if (name != "credit_card" or luhn(v)) and (name, v) not in out:
                out.append((name, v))
    return out


def random_texts(n):
    rng = random.Random(7)
    pieces = ["412-55-9931", "4111 1111 1111 1111", "415-555-0134", "a@b.co", "account no ", "12345678", "routing: ", "021000021",
              "04/12/1985", "\n", " ", " ", "x", ".", "-", "9", "é", "ß1", "٣", "(415) 555 0134", "+1", "ABA", "\r\n", " "]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_random_texts_match_python(spark):
    texts = random_texts(1500)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", pii.detect(F.col("text")).alias("f")).collect()
    for r in got:
        assert [(f.type, f.value) for f in r.f] == python_findings(texts[r.i]), repr(texts[r.i])


def test_documents_match_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in docs.withColumn("f", pii.detect(F.col("text"))).collect():
        assert [(f.type, f.value) for f in r.f] == python_findings(r.text)


def test_luhn_over_many_numbers(spark):
    rows = spark.range(2000).select((F.col("id") * 7919 + 4111111111111111).cast("string").alias("n"))
    good = rows.filter(pii.luhn_valid(F.col("n"))).count()
    assert good == sum(1 for i in range(2000) if any(n == "credit_card" for n, _ in python_findings(str(i * 7919 + 4111111111111111))))


def test_profile_counts(spark):
    df = spark.createDataFrame([("a", "412-55-9931 a@b.co"), ("a", "x@y.org"), ("b", "none")], "source string, text string")
    assert {(r.source, r.type): r.findings for r in pii_profile(df, "text", ["source"]).collect()} == {("a", "ssn"): 1, ("a", "email"): 2}


def test_registered_detector(spark):
    extra = pii.register(pii.Detector("badge", r"\bB-\d{4}\b"))
    row = spark.createDataFrame([("badge B-1234, a@b.co",)], "t string").select(pii.detect(F.col("t"), detectors=extra).alias("f")).first()
    assert [f.type for f in row.f] == ["email", "badge"]
    replaced = pii.register(pii.Detector("email", "never"))
    assert [d.name for d in replaced] == [d.name for d in pii.DETECTORS]


# --- redaction ---------------------------------------------------------------------------------


def python_redact(text, values=()):
    for v in sorted(sorted(set(values)), key=len, reverse=True):
        if v:
            text = text.replace(v, "[REDACTED:SENSITIVE]")
    for name, v in sorted(python_findings(text), key=lambda f: len(f[1]), reverse=True):
        text = text.replace(v, f"[REDACTED:{name.upper()}]")
    return text


def test_redaction_matches_python(spark):
    texts = random_texts(600)
    values = [["x", "9931"], [], ["", "a@b.co", "412"], ["٣"]]
    df = spark.createDataFrame([(i, t, values[i % 4]) for i, t in enumerate(texts)], "i int, text string, v array<string>")
    rows = df.select("i", rd.redact_text(F.col("text")).alias("plain"), rd.redact_text(F.col("text"), F.col("v")).alias("masked")).collect()
    for r in rows:
        assert r.plain == python_redact(texts[r.i])
        assert r.masked == python_redact(texts[r.i], values[r.i % 4]), repr(texts[r.i])


KEYS = {
    "account_id": True, "to_account": True, "pin": True, "PIN": True, "user pin code": True, "spinner": False, "prompt_tokens": False,
    "api_key": True, "API-key": True, "apikey": True, "access token": True, "token": False, "recovery_code": True, "recovery": True,
    "accounting": False, "my-secret": True, "secretary": False, "card number": True, "cvv": True, "": False,
}


def test_sensitive_keys(spark):
    rows = spark.createDataFrame(list(KEYS.items()), "k string, expected boolean").withColumn("got", rd.is_sensitive_key(F.col("k"))).collect()
    assert {r.k: r.got for r in rows} == KEYS


NESTED = {
    "account": {"account_id": "AC-1", "limits": [1, 2.5, True, None], "pin": {"value": "zz", "passcode": 77}},
    "secret": ["s1", ["s2", False], {"note": "n1", "cvv": 1.5}],
    "note": "mail a@b.co", "n": 412559931, "list": [{"text": "call 415-555-0134"}, "412-55-9931"], "none": None,
}


def test_nested_json(spark):
    docs = [json.dumps(NESTED), '"text 412-55-9931"', "12", "null", "no json 412-55-9931", "[]", None]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string")
    out = {r.i: r.doc for r in rd.redact_json(df, "doc").collect()}
    assert json.loads(out[0]) == {
        "account": "[REDACTED:SENSITIVE]", "secret": "[REDACTED:SENSITIVE]", "note": "mail [REDACTED:EMAIL]", "n": 412559931,
        "list": [{"text": "call [REDACTED:PHONE]"}, "[REDACTED:SSN]"], "none": None,
    }
    assert [out[i] for i in range(1, 7)] == ['"text [REDACTED:SSN]"', "12", "null", "no json [REDACTED:SSN]", "[]", None]
    values = redaction.harvest(df.withColumn("run_id", F.lit("r")), ["doc"]).collect()
    # Lists inherit their key; objects use the keys of their fields.
    assert {r.value for r in values} == {"AC-1", "77", "s1", "s2", "False", "1.5"}


def account_turns(spark):
    rows = []
    for run in ("r1", "r2"):
        for n in range(40):
            code = f"R-{run}-{n:03d}"
            result = json.dumps({"recovery_code": code, "plain": f"P{n}"})
            text = f"Code {code}, next R-{run}-{n + 1:03d}, other R-r1-{n:03d}, short ab{n}"
            rows.append((run, "s", n, 0, "agent", text, [("get", json.dumps({"pin": f"ab{n}"}), result)]))
    return spark.createDataFrame(rows, turns_table(spark, [("agent", "x")]).schema)


@pytest.mark.parametrize("limit", [10, 1000])
def test_runs_with_many_and_few_values_are_redacted_alike(spark, limit):
    """Both ways against brute force: values of the own run only, in every text of the run."""
    t = account_turns(spark)
    values = {run: {f"R-{run}-{n:03d}" for n in range(40)} | {f"ab{n}" for n in range(40)} for run in ("r1", "r2")}
    expected = {(r.run_id, r.attempt): python_redact(r.content, values[r.run_id]) for r in t.collect()}
    clean = redaction.redact_turns(t, limit=limit).collect()
    assert {(r.run_id, r.attempt): r.content for r in clean} == expected
    assert all(json.loads(r.tool_calls[0].result)["recovery_code"] == "[REDACTED:SENSITIVE]" for r in clean)
    assert all(json.loads(r.tool_calls[0].arguments) == {"pin": "[REDACTED:SENSITIVE]"} for r in clean)
    assert [r.attempt for r in t.filter("content LIKE '%REDACTED%'").collect()] == []


def test_values_in_texts_by_brute_force(spark):
    rng = random.Random(3)
    values = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(150)})
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    t = spark.createDataFrame([("r", i, x) for i, x in enumerate(texts)], "run_id string, i int, text string")
    v = spark.createDataFrame([("r", x) for x in values], "run_id string, value string")
    got = {r.i: set(r.sensitive) for r in redaction.values_in_texts(t, ["i"], ["text"], v).collect()}
    assert got == {i: s for i, x in enumerate(texts) if (s := {w for w in values if w in x})}


def test_tool_arguments_that_are_no_json_survive(spark):
    t = turns_table(spark, [("agent", 'say "hi" \\ 412-55-9931', [('od"d\\name', "plain 412-55-9931", None)])])
    call = redaction.redact_turns(t).first().tool_calls[0]
    assert call.name == 'od"d\\name' and json.loads(call.arguments) == "plain [REDACTED:SSN]" and call.result == "null"


def test_no_leak_remains(spark):
    t = account_turns(spark).withColumn("content", F.concat("content", F.lit(" 412-55-9931 a@b.co")))
    assert redaction.remaining_leaks(redaction.redact_turns(t), ["content"]).count() == 0
    assert redaction.remaining_leaks(t, ["content"]).count() == t.count()
    assert t.select(*ATTEMPT_KEY).distinct().count() == 80


def test_values_of_scenario_contexts_on_request(spark):
    t = turns_table(spark, [("agent", "The code is R-8291-4492, short 7")])
    scenarios = spark.createDataFrame([("s", '{"account": {"recovery_code": "R-8291-4492", "pin": 7}}'), ("other", '{"pin": "code"}')], "scenario_id string, context string")
    assert redaction.redact_turns(t).first().content == "The code is R-8291-4492, short 7"
    values = redaction.harvest_contexts(t, scenarios)
    assert {tuple(r) for r in values.collect()} == {("r", "R-8291-4492"), ("r", "7")}
    both = redaction.harvest_turns(t).union(values)
    assert redaction.redact_turns(t, values=both).first().content == "The code is [REDACTED:SENSITIVE], short [REDACTED:SENSITIVE]"
    longer = redaction.harvest_contexts(t, scenarios, min_len=3)
    assert redaction.redact_turns(t, values=longer).first().content == "The code is [REDACTED:SENSITIVE], short 7"
