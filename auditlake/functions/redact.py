"""Redaction of text and JSON values."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.pii import DETECTORS, Detector, detect
from auditlake.functions.text import let
from auditlake.session import remembered

# The marker and the pattern for names of secret or financial fields.
SENSITIVE_MARK = "[REDACTED:SENSITIVE]"
SENSITIVE_KEY = (
    r"(?:^|[_ -])(?:api[-_ ]?key|authorization|cookie|password|passcode|secret|"
    r"access[-_ ]?token|refresh[-_ ]?token|credit[-_ ]?card|card[-_ ]?number|"
    r"cvv|pin|routing|account|ssn|dob|recovery(?:[-_ ]?code)?)(?:$|[_ -])"
)


def is_sensitive_key(key: Column) -> Column:
    return F.coalesce(F.rlike(key, F.lit("(?i)" + SENSITIVE_KEY)), F.lit(False))


def _longest_first(values: Column, text_of) -> Column:
    """Order by length, longest first; equal lengths keep their order."""
    keyed = F.transform(
        values,
        lambda v, i: F.struct((-F.length(text_of(v))).alias("k"), i.alias("i"), v.alias("v")),
    )
    return F.transform(F.sort_array(keyed), lambda s: s["v"])


def mask_values(text: Column, values: Column) -> Column:
    """Replace every occurrence of the given values, longest first, by the sensitive marker."""
    usable = F.filter(F.array_sort(F.array_distinct(values)), lambda v: F.length(v) > 0)
    return F.aggregate(
        _longest_first(usable, lambda v: v), text, lambda acc, v: F.replace(acc, v, F.lit(SENSITIVE_MARK))
    )


def masking_steps(text: Column, values: Column) -> Column:
    """What the text is after each replacement of ``mask_values``."""
    usable = F.filter(F.array_sort(F.array_distinct(values)), lambda v: F.length(v) > 0)
    start = F.array().cast("array<string>")

    def step(done: Column, value: Column) -> Column:
        before = F.when(F.size(done) == 0, text).otherwise(F.element_at(done, -1))
        return F.concat(done, F.array(F.replace(before, value, F.lit(SENSITIVE_MARK))))

    return F.aggregate(_longest_first(usable, lambda v: v), start, step)


def mask_findings(text: Column, findings: Column) -> Column:
    """Replace every finding value, longest first, by a marker naming its kind."""
    return F.aggregate(
        _longest_first(findings, lambda f: f["value"]),
        text,
        lambda acc, f: F.replace(acc, f["value"], F.concat(F.lit("[REDACTED:"), F.upper(f["type"]), F.lit("]"))),
    )


def redact_text(
    text: Column, sensitive_values: Column | None = None, detectors: Iterable[Detector] = DETECTORS
) -> Column:
    """Mask the run's sensitive values, then whatever the detectors find in the result."""
    if sensitive_values is None:
        return mask_findings(text, detect(text, detectors=detectors))
    masked = F.when(F.coalesce(F.size(sensitive_values), F.lit(0)) > 0, mask_values(text, sensitive_values)).otherwise(
        text
    )
    return let(masked, lambda t: mask_findings(t, detect(t, detectors=detectors)))


def redacted_column(name: str, sensitive_values: str | None = None, detectors: Iterable[Detector] = DETECTORS) -> Column:
    """The same for a column, given by name as its run's sensitive values are; built once per JVM."""
    detectors = tuple(detectors)
    values = F.col(sensitive_values) if sensitive_values else None
    return remembered(("redacted", name, sensitive_values, detectors), lambda: redact_text(F.col(name), values, detectors))


# --- JSON objects without nesting: native -------------------------------------------------


def redact_flat_json(
    doc: Column, sensitive_values: Column | None = None, detectors: Iterable[Detector] = DETECTORS
) -> Column:
    """Redact a JSON object whose values are scalars; numbers and booleans stay as they are."""
    fields = F.from_json(doc, "map<string,variant>")

    def redacted(key: Column, value: Column) -> Column:
        string = redact_text(value.cast("string"), sensitive_values, detectors)
        return (
            F.when(is_sensitive_key(key), F.lit(SENSITIVE_MARK).cast("variant"))
            .when(F.schema_of_variant(value) == "STRING", string.cast("variant"))
            .otherwise(value)
        )

    return F.to_json(F.transform_values(fields, redacted))


def flat_sensitive_values(doc: Column) -> Column:
    """Scalars held under sensitive keys of a JSON object without nesting."""
    fields = F.map_filter(F.from_json(doc, "map<string,variant>"), lambda k, v: is_sensitive_key(k) & v.cast("string").isNotNull())

    def text(value: Column) -> Column:
        # A truth value reads True or False, as from nested JSON.
        return F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(value.cast("string"))).otherwise(value.cast("string"))

    return F.coalesce(
        F.transform(F.map_values(fields), text),
        F.array().cast("array<string>"),
    )


# --- JSON of any depth: Python walks the structure, Spark redacts the strings ---------------


@lru_cache(maxsize=1)
def _json_walkers():
    """Pandas UDFs over JSON text: its sensitive values, its open strings, and the text with those exchanged.

    Everything they call is local, so they travel to executors that do not have this package.
    """
    sensitive_key = re.compile(SENSITIVE_KEY, re.IGNORECASE)
    mark = SENSITIVE_MARK

    def is_sensitive(key):
        return key is not None and sensitive_key.search(key) is not None

    def load(doc):
        """The JSON value and True; text that is no JSON counts as one plain string."""
        try:
            return json.loads(doc), True
        except ValueError:
            return doc, False

    def scalars(value, key=None):
        # Lists inherit the key they stand under, objects use the keys of their own fields.
        if isinstance(value, dict):
            for name, item in value.items():
                yield from scalars(item, name)
        elif isinstance(value, list):
            for item in value:
                yield from scalars(item, key)
        elif value is not None and is_sensitive(key):
            yield str(value)

    def exchange(value, change, key=None):
        # Whole values under sensitive keys are masked; every other string goes through ``change``.
        if is_sensitive(key):
            return mark
        if isinstance(value, str):
            return change(value)
        if isinstance(value, list):
            return [exchange(item, change) for item in value]
        if isinstance(value, dict):
            return {name: exchange(item, change, name) for name, item in value.items()}
        return value

    def sensitive_values(doc):
        return [] if doc is None else list(dict.fromkeys(scalars(load(doc)[0])))

    def open_strings(doc):
        if doc is None:
            return None
        found = []
        exchange(load(doc)[0], lambda s: found.append(s) or s)
        return found

    def with_strings(doc, strings):
        if doc is None:
            return None
        rest = iter(strings)
        value, is_json = load(doc)
        changed = exchange(value, lambda _: next(rest))
        return json.dumps(changed, ensure_ascii=False) if is_json else changed

    def values_of(docs: pd.Series) -> pd.Series:
        return docs.map(sensitive_values)

    def strings_of(docs: pd.Series) -> pd.Series:
        return docs.map(open_strings)

    def rebuilt(docs: pd.Series, strings: pd.Series) -> pd.Series:
        return pd.Series([with_strings(d, s) for d, s in zip(docs, strings)], dtype="object")

    return (
        F.pandas_udf(values_of, "array<string>"),
        # Declared nondeterministic so that Spark keeps what is computed from the strings out of the arguments of
        # the last UDF, where it does not reliably recognise the lambdas again.
        F.pandas_udf(strings_of, "array<string>").asNondeterministic(),
        F.pandas_udf(rebuilt, "string"),
    )


def json_sensitive_values(doc: Column) -> Column:
    """Distinct scalars under sensitive keys, at any depth."""
    return _json_walkers()[0](doc)


def json_strings(doc: Column) -> Column:
    """The strings that redaction searches, unescaped: all that stand under no sensitive key."""
    return F.coalesce(_json_walkers()[1](doc), F.array().cast("array<string>"))


def redact_json(
    rows: DataFrame,
    column: str,
    sensitive_values: str | None = None,
    detectors: Iterable[Detector] = DETECTORS,
) -> DataFrame:
    """The rows with the JSON values of ``column``, of any depth, redacted; ``sensitive_values`` names a column of them."""
    _, open_strings, with_strings = _json_walkers()
    detectors = tuple(detectors)
    values = F.col(sensitive_values) if sensitive_values else None
    safe = remembered(
        ("redacted JSON", column, sensitive_values, detectors),
        lambda: F.transform(open_strings(column), lambda s: redact_text(s, values, detectors)),
    )
    return rows.withColumn("_safe", safe).withColumn(column, with_strings(column, "_safe")).drop("_safe")
