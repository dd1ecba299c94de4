"""Strings of a large set in texts, against plain substring tests; redaction of runs with very many values."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions.lookup import occurrences
from auditlake.operators import redaction

ALPHABET = "abÄ😀[]\n"


def rows_of(spark, texts, values):
    t = spark.createDataFrame(texts, "id int, run_id string, strings array<string>")
    v = spark.createDataFrame(values, "run_id string, value string")
    return t, v


def test_occurrences_by_brute_force(spark):
    rng = random.Random(5)

    def some(most):
        return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))

    values = [(f"r{rng.randrange(3)}", some(20)) for _ in range(400)] + [("r0", None), (None, "a"), ("r1", "ab" * 400)]
    texts = [(i, f"r{rng.randrange(4)}", [some(60) for _ in range(rng.randrange(4))] + [None]) for i in range(300)]
    texts += [(900, "r1", ["x" + "ab" * 2000, ""]), (901, "r0", None), (902, None, ["a"])]
    t, v = rows_of(spark, texts, values)
    got = sorted((r.id, r.run_id, r.value) for r in occurrences(t, ["id"], "run_id", "strings", v).collect())
    assert got == sorted({(i, g, w) for i, g, own in texts for h, w in values if g == h and g and w and any(w in s for s in own or [] if s)})


def test_nothing_to_look_up(spark):
    t, v = rows_of(spark, [(1, "r", ["abc"])], [])
    assert occurrences(t, ["id"], "run_id", "strings", v).count() == 0
    t, v = rows_of(spark, [], [("r", "abc")])
    assert occurrences(t, ["id"], "run_id", "strings", v).count() == 0


def test_no_position_of_a_text_leaves_the_scan_without_a_hit(spark):
    t, v = rows_of(spark, [(i, "r", [f"text number {i} of many"]) for i in range(200)], [("r", f"secret-{i:09d}") for i in range(1000)])
    found = occurrences(t, ["id"], "run_id", "strings", v)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0


def test_values_over_the_edge_of_a_marker(spark):
    """Values that occur only once others are masked, in every order of masking, by both ways."""
    rng = random.Random(9)
    marker = "[REDACTED:SENSITIVE]"
    values = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(40)}
    values |= {"".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randint(0, 2))) + marker[: rng.randint(1, 20)] for _ in range(25)}
    values |= {marker[rng.randint(0, 19) :] + "".join(rng.choice(["a", "b"]) for _ in range(rng.randint(0, 2))) for _ in range(25)}
    texts = ["".join(rng.choice("abcdRE[]") for _ in range(rng.randint(0, 30))) for _ in range(150)]
    t = spark.createDataFrame([("r", i, x, x[::-1]) for i, x in enumerate(texts)], "run_id string, i int, text string, other string")
    v = spark.createDataFrame([("r", x) for x in values], "run_id string, value string")
    by_array, by_lookup = (
        sorted(map(tuple, redaction.redact_columns(t, ["i"], ["text", "other"], v, limit=n).collect())) for n in (10_000, 0)
    )
    assert by_array == by_lookup

    def plain(text):
        for value in sorted(sorted(values), key=len, reverse=True):
            text = text.replace(value, marker)
        return text

    assert [r[2] for r in by_lookup] == [plain(x) for x in texts]


@pytest.mark.parametrize("n", [100_000])
def test_a_run_with_very_many_values(spark, n):
    secret = F.concat(F.lit("sk-"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 24))
    values = spark.range(n).select(F.lit("r").alias("run_id"), secret.alias("value"))
    texts = spark.range(3000).select(F.lit("r").alias("run_id"), F.col("id").alias("i"), F.concat(F.lit("the code is "), F.when(F.col("id") % 3 == 0, secret).otherwise(F.lit("sk-none")), F.lit(" today")).alias("text"))
    clean = redaction.redact_columns(texts, ["i"], ["text"], values)
    assert clean.groupBy("text").count().orderBy("count").collect() == [("the code is [REDACTED:SENSITIVE] today", 1000), ("the code is sk-none today", 2000)]
