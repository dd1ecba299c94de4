"""Personal-data detection with JVM regular expressions, no Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import UNICODE_FLAGS, UNICODE_FLAGS_NOCASE, let, strip

FINDINGS_TYPE = "array<struct<type:string,value:string>>"


@dataclass(frozen=True)
class Detector:
    """One kind of personal data.

    ``needs`` is a cheap test that every match passes; texts failing it are not scanned. ``reach`` is a number of
    characters at the end of a text failing it, outside of which no match over the next line can begin; such a
    text, if longer, must also be too long for a match to pass through. None: not known.
    """

    name: str
    pattern: str
    group: int = 0
    ignore_case: bool = False
    valid: Callable[[Column], Column] | None = None
    needs: Callable[[Column], Column] | None = None
    reach: int | None = None

    def values(self, text: Column) -> Column:
        flags = UNICODE_FLAGS_NOCASE if self.ignore_case else UNICODE_FLAGS
        found = F.transform(F.regexp_extract_all(text, F.lit(flags + self.pattern), F.lit(self.group)), strip)
        return F.filter(found, self.valid) if self.valid else found

    def findings(self, text: Column) -> Column:
        return F.transform(
            self.values(text),
            lambda v: F.struct(F.lit(self.name).alias("type"), v.alias("value")),
        )


def luhn_valid(value: Column) -> Column:
    """Check-digit test over the ASCII digits of the value, 13 to 19 of them."""

    def valid(digits: Column) -> Column:
        n = F.length(digits)

        def contribution(char: Column, i: Column) -> Column:
            d = char.cast("int")
            doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
            return F.when(i % 2 == n % 2, doubled).otherwise(d)

        total = F.aggregate(F.transform(F.split(digits, ""), contribution), F.lit(0), lambda acc, d: acc + d)
        return F.when(n.between(13, 19), total % 10 == 0).otherwise(F.lit(False))

    # Else the digits would be taken out again for each of them.
    return let(F.regexp_replace(value, "[^0-9]", ""), valid)


def _has_digit(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?U)\d"))


def _has_at_sign(text: Column) -> Column:
    return F.contains(text, F.lit("@"))


# Detector names, patterns and their order.
SSN = r"\b(?!000|666|9\d\d)\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b"
CREDIT_CARD = r"\b(?:\d[ -]?){13,19}\b"
ROUTING_NUMBER = r"\b(?:routing|aba|rtn)\D{0,12}(\d{9})\b"
BANK_ACCOUNT = r"\b(?:account|acct|a/c)\D{0,12}(\d{8,17})\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
DOB = r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b"

# The longest match over a line break that begins in a text without digits is a keyword of 7 letters and 12
# other characters before the digits, well within the reach of 32.
DETECTORS: tuple[Detector, ...] = (
    Detector("ssn", SSN, needs=_has_digit, reach=32),
    Detector("credit_card", CREDIT_CARD, valid=luhn_valid, needs=_has_digit, reach=32),
    Detector("routing_number", ROUTING_NUMBER, group=1, ignore_case=True, needs=_has_digit, reach=32),
    Detector("bank_account", BANK_ACCOUNT, group=1, ignore_case=True, needs=_has_digit, reach=32),
    Detector("email", EMAIL, needs=_has_at_sign, reach=32),
    Detector("phone", PHONE, needs=_has_digit, reach=32),
    Detector("dob", DOB, needs=_has_digit, reach=32),
)


def register(
    detector: Detector, detectors: Iterable[Detector] = DETECTORS
) -> tuple[Detector, ...]:
    """A detector list with one more kind at its end; a kind of the same name is replaced in place."""
    current = list(detectors)
    names = [d.name for d in current]
    if detector.name in names:
        current[names.index(detector.name)] = detector
    else:
        current.append(detector)
    return tuple(current)


def reach(detectors: Iterable[Detector]) -> int | None:
    """The longest reach of the detectors; None when one of them does not know its own, as any but the built-in ones."""
    reaches = [d.reach if d.needs and d in DETECTORS else None for d in detectors]
    return None if None in reaches else max(reaches, default=0)


def may_match(text: Column, detectors: Iterable[Detector]) -> Column:
    """Whether the text passes the cheap test of any detector."""
    tests = list(dict.fromkeys(d.needs for d in detectors))
    if None in tests:
        return F.lit(True)
    passes = F.lit(False)
    for test in tests:
        passes = passes | test(text)
    return passes


def detect(text: Column, types: Iterable[str] | None = None, detectors: Iterable[Detector] = DETECTORS) -> Column:
    """Findings in detector order, then text order, each (type, value) once.

    ``types`` empty or None scans for every kind.
    """
    wanted = set(types or ())
    chosen = [d for d in detectors if not wanted or d.name in wanted]
    nothing = F.array().cast(FINDINGS_TYPE)
    if not chosen:
        return nothing
    # Detectors sharing a precondition are guarded together, so that the test runs once for them.
    groups: list[tuple[Callable | None, list[Detector]]] = []
    for d in chosen:
        if groups and groups[-1][0] is d.needs:
            groups[-1][1].append(d)
        else:
            groups.append((d.needs, [d]))
    parts = []
    for needs, members in groups:
        found = F.concat(*[m.findings(text) for m in members]).cast(FINDINGS_TYPE)
        parts.append(F.when(needs(text), found).otherwise(nothing) if needs else found)
    return F.array_distinct(F.coalesce(F.concat(*parts), nothing))


def preview(kind: Column, value: Column) -> Column:
    """A safe-to-log form: the last four digits at most."""
    digits = F.regexp_replace(value, r"(?U)\D", "")
    masked = F.concat(kind, F.lit(":****"))
    return F.when(F.length(digits) >= 4, F.concat(masked, F.right(digits, F.lit(4)))).otherwise(masked)


def previews(findings: Column) -> Column:
    """Sorted distinct previews of a findings array."""
    return F.array_sort(F.array_distinct(F.transform(findings, lambda f: preview(f["type"], f["value"]))))
