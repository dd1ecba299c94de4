"""Column helpers for text: trimming, phrase and pattern search, JSON validity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.patterns import java_patterns, to_java

# The characters Python's str.strip() removes.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Java regex flags that give \d \s \b and "." the meaning they have in Python:
# U = Unicode classes, d = only \n ends a line, i = ignore case.
UNICODE_FLAGS = "(?Ud)"
UNICODE_FLAGS_NOCASE = "(?Uid)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    Catalyst copies a projected expression into the lambda that refers to it, so an
    expensive one would run again for every array element. A lambda variable does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every Unicode whitespace character from both ends."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def has_phrase(text: Column, folded: Column, phrase: Column, case_sensitive: Column) -> Column:
    """Substring test; ``folded`` is the lower-cased ``text``."""
    return F.when(case_sensitive, F.contains(text, phrase)).otherwise(F.contains(folded, F.lower(phrase)))


def has_pattern(
    text: Column, pattern: Column, case_sensitive: Column, known: Sequence[str] = (), compiled: Column | None = None
) -> Column:
    """Search for a pattern of Python's. Patterns listed in ``known`` are compiled once per task; any other one as it is
    met, from ``compiled``, its form for Java's engine (see ``functions.patterns``)."""
    if compiled is None:
        compiled = F.get(java_patterns(F.array(pattern), case_sensitive, F.lit("")), F.lit(0))
    search, branch = F.rlike(text, compiled), None
    for p in known:
        exact, folded = (F.rlike(text, F.lit(to_java(p, case))) for case in (True, False))
        hit = F.when(case_sensitive, exact).otherwise(folded)
        branch = F.when(pattern == p, hit) if branch is None else branch.when(pattern == p, hit)
    return search if branch is None else branch.otherwise(search)


def json_valid(text: Column) -> Column:
    """True when the text is exactly one JSON value (scalars allowed, repeated keys allowed).

    The two wrappings rule out trailing input that a lenient parser would skip.
    Needs ``spark.sql.variant.allowDuplicateKeys`` (see ``session.configure``).
    """

    def one_value(t: Column) -> Column:
        in_list = F.concat(F.lit("["), t, F.lit("]"))
        in_object = F.concat(F.lit('{"v":'), t, F.lit("}"))
        return (
            F.try_parse_json(in_list).isNotNull()
            & (F.coalesce(F.json_array_length(in_list), F.lit(0)) == 1)
            & F.try_parse_json(in_object).isNotNull()
            & (F.coalesce(F.size(F.json_object_keys(in_object)), F.lit(0)) == 1)
        ) | t.isin("NaN", "Infinity", "-Infinity")

    return F.coalesce(let(strip(text), one_value), F.lit(False))


def join_lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")
