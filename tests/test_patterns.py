"""Patterns mean in Java what they mean in Python."""

import random
import re
import warnings

import pytest
from pyspark.sql import functions as F
from tables import check_table, turns_table

from auditlake.functions.patterns import PatternError, pattern_error, to_java
from auditlake.functions.text import has_pattern
from auditlake.operators import checks as ck

PATTERNS = [
    r"(?P<first_name>\w+) x", r"(a)?(?(1)b|c)", r"(?P<n>a)?b(?(n)c|d)$", r"^(<)?\w+(?(1)>)$", r"(?a)\w", r"(?a:\w+)é", r"(?i:ab)c", r"(?i)a(?-i:B)c", r"[a&&b]", r"[a\-\-b]",
    r"[[a]", r"[]a]", r"[^]a]", r"[^\W\d_]+", r"[\d\-x]", r"\bfoo\b", r"\Bo", r"^a$", r"(?m)^a$", r"(?s)a.b", r"a.b", r"a\Z", r"\Aa", r"(?x) a  b # c", r"(?<=a)b", r"(?<!a)b",
    r"(?=.*\d)(?!.*x)[a-z\d]+$", r"(?>a+)ab", r"a++b", r"x{,2}y", r"x{2}", r"x{1,}?y", r"{name}", r"a{", r"(?P<a>b+)-(?P=a)", r"(a)(b)\2\1", r"(a|b)*c", r"(?:(a)|b)+(?(1)c|d)",
    r"\s", r"[\s]x", r"\S\s\S", r"\d+", r"[^\d]$", r"½", r"\w²", r"é", r"(?i)É", r"(?i)straße", r"\u20ac|\x41|\101", r"\N{EURO SIGN}", r"a|", r"()", r"(?i)k", r"[a-fA-F0-9]{4,6}", r"\\Q\$",
    r"(?:)", r"(?!)", r"\Z", r"(?#note)a", r"^\s*$", r"(?im)^B$", r"😀+", r"[😀-😂]", r"\.\*\+\?\|\(\)\[\]", r"(?u)\w", r"((a)(?(2)b|c))+d",
]
TEXTS = [
    "", "a", "b", "c", "ab", "ac", "bc", "abc", "bd", "cc", "aab", "aac", "abd", "xxy", "y", "x", "John_1 x", "<a>", "<a", "a>", "é", "É", "aé", "Abc", "aBc", "ABc", "&", "a&", "-", "[", "]", "^",
    "foo", "foo bar", "xfoo", "foo\n", "a\nb", "\na\n", "a\n\n", "b\nB", "a.b", "ab1", "x1", "{name}", "name", "a{", "bb-bb", "b-bb", "abba", "²", "a²", "½", "٣", "_", "¼x", "\u00a0", "\u2028", "\x1c",
    "\x85x", " x", "a a", "STRASSE", "Straße", "€", "A", "K", "\u212a", "dead", "DEADBE", "\\Q$", ".*+?|()[]", "😀😀", "😁", "abab", "abacd", "abcd", "e\u0301", "\u200d", "‿",
]


def searched(spark, pattern, exact=True):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").coalesce(1)
    return [r.h for r in rows.select(F.rlike("t", F.lit(to_java(pattern, exact))).alias("h")).collect()]


@pytest.mark.parametrize("exact", [True, False])
def test_patterns_find_what_they_find_in_python(spark, exact):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").coalesce(1)
    hits = rows.select(*[F.rlike("t", F.lit(to_java(p, exact))).alias(f"p{i}") for i, p in enumerate(PATTERNS)]).collect()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for i, pattern in enumerate(PATTERNS):
            want = [re.search(pattern, t, 0 if exact else re.IGNORECASE) is not None for t in TEXTS]
            got = [r[i] for r in hits]
            assert got == want, (pattern, to_java(pattern, exact), [t for t, g, w in zip(TEXTS, got, want) if g != w])


def test_random_patterns(spark):
    rng, made = random.Random(2), []

    def some(depth):
        kind = rng.randrange(9 if depth else 4)
        if kind < 4:
            return rng.choice(["a", "b", "c", ".", r"\w", r"\d", r"\s", "[ab]", "[^a]", r"[^\w]", r"\b", "^", "$", "é", " "])
        if kind == 4:
            return some(depth - 1) + some(depth - 1)
        if kind == 5:
            return f"({some(depth - 1)}|{some(depth - 1)})"
        if kind == 6:
            return f"(?:{some(depth - 1)}){rng.choice(['*', '+', '?', '{2}', '{1,2}', '*?'])}"
        if kind == 7:
            return f"(?{rng.choice('=!')}{some(depth - 1)})"
        # A condition whose group matches in one way; where it may be taken back, engines differ.
        return f"(?:({rng.choice('abc')})|{some(0)})(?(1){some(depth - 1)}|{some(depth - 1)})"

    while len(made) < 150:
        pattern = some(3)
        try:
            to_java(pattern)
        except PatternError:
            continue
        made.append(pattern)
    texts = ["".join(rng.choice("abcé 1\n_") for _ in range(rng.randint(0, 6))) for _ in range(120)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    hits = rows.select(*[F.rlike("t", F.lit(to_java(p))).alias(f"p{i}") for i, p in enumerate(made)]).collect()
    for i, pattern in enumerate(made):
        for text, row in zip(texts, hits):
            assert row[i] == (re.search(pattern, text) is not None), (pattern, to_java(pattern), text)


def test_checks_with_patterns_java_does_not_know(spark):
    checks = [
        {"type": "regex", "patterns": [r"(?P<first_name>\w+) x"]}, {"type": "regex", "patterns": [r"^(a)?(?(1)b|c)$"], "must_appear": False},
        {"type": "regex", "patterns": [r"(?a)\w", "[a&&b]"]}, {"type": "regex", "patterns": ["NAME", None], "case_sensitive": True},
    ]
    turns = turns_table(spark, [("agent", "name x"), ("customer", "é"), ("agent", "ab")])
    for patterns in ((), ("NAME",)):
        rows = ck.results_of(ck.evaluate_turns(turns, check_table(spark, *checks), known_patterns=patterns)).orderBy("check_pos").collect()
        assert [r.passed for r in rows] == [True, True, True, False]
        assert rows[3].evidence == "NAME"


def test_a_pattern_that_is_none_names_its_check(spark):
    bad = check_table(spark, {"check_id": "refund-7", "type": "regex", "patterns": ["a(b"]})
    with pytest.raises(Exception, match="refund-7.*missing \\)"):
        ck.evaluate_turns(turns_table(spark, [("agent", "x")]), bad).collect()
    with pytest.raises(PatternError, match="ends later"):
        to_java("(?:(?(1)a|b)(c))*")


def test_errors_of_patterns_as_a_table(spark):
    rows = spark.createDataFrame([("a(b",), ("ok",), (None,), ("*",)], "p string").select(pattern_error(F.col("p")).alias("e")).collect()
    assert [r.e is None for r in rows] == [False, True, True, False] and "missing )" in rows[0].e


def test_a_pattern_of_a_column_without_translation(spark):
    rows = spark.createDataFrame([("ab", r"(?P<x_y>a)b"), ("c", "(a)?(?(1)b|c)")], "t string, p string")
    assert [r.h for r in rows.select(has_pattern(F.col("t"), F.col("p"), F.lit(True)).alias("h")).collect()] == [True, True]
