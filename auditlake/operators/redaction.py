"""Redaction of recorded runs.

Values found under sensitive keys of a run's tool data are masked in every text of that run. Runs with few
such values carry them as an array; for a run with more, fingerprints of all values are looked up in one walk over
each text and the hits are joined with the values, so that neither the run's values nor its texts meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.pii import DETECTORS, Detector, detect
from auditlake.functions.lookup import occurrences
from auditlake.functions.redact import (
    SENSITIVE_MARK,
    json_sensitive_values,
    json_strings,
    masking_steps,
    redact_json,
    redact_text,
    redacted_column,
)
from auditlake.functions.text import let
from auditlake.schemas import ATTEMPT_KEY
from auditlake.session import checkpointed, remembered

# A run with at most this many sensitive values carries them along with its texts.
VALUES_PER_RUN = 256

# Value arrays of at most this many characters in all are broadcast; larger ones are joined over salted keys.
BROADCAST_CHARACTERS = 32 * 1024 * 1024
SALTS = 32

# Large runs whose ids are broadcast.
BROADCAST_ROWS = 200_000


def harvest(tool_data: DataFrame, columns: Sequence[str], run: str = "run_id", min_len: int = 1) -> DataFrame:
    """Distinct (run, value) of the scalars under sensitive keys in the given JSON columns."""
    found = F.concat(*[json_sensitive_values(F.col(c)) for c in columns])
    return (
        tool_data.select(run, F.explode(F.array_distinct(found)).alias("value"))
        .filter(F.length("value") >= min_len)
        .distinct()
    )


def harvest_turns(turns: DataFrame, run: str = "run_id", min_len: int = 1) -> DataFrame:
    """The same from the tool calls of a turns table, kept in the checkpoint folder because redaction reads it often."""
    calls = turns.select(run, F.explode("tool_calls").alias("call"))
    return checkpointed(harvest(calls.select(run, "call.arguments", "call.result"), ["arguments", "result"], run, min_len))


def harvest_contexts(run_scenarios: DataFrame, scenarios: DataFrame, min_len: int = 1) -> DataFrame:
    """Distinct (run_id, value) of the sensitive values in the contexts of a run's scenarios.

    Not part of the default harvest; unite it with ``harvest_turns`` to mask secrets no tool call returned.
    """
    contexts = run_scenarios.select("run_id", "scenario_id").distinct().join(scenarios.select("scenario_id", "context"), "scenario_id")
    return harvest(contexts, ["context"], min_len=min_len)


def _strings(texts: DataFrame, columns: Sequence[str]) -> Column:
    """The strings of the columns, each of which holds one string or an array of them."""
    none = F.array().cast("array<string>")
    one = [F.array(c) if texts.schema[c].dataType.simpleString() == "string" else F.coalesce(F.col(c), none) for c in columns]
    return F.concat(*one)


def values_in_texts(
    texts: DataFrame, keys: Sequence[str], columns: Sequence[str], values: DataFrame, run: str = "run_id"
) -> DataFrame:
    """Per text row the values of its run that masking meets in it: (keys, sensitive).

    The texts are walked once, whatever the number of values (see ``functions.lookup``). A value with a bracket, or that
    is a part of the marker, may first occur once another one is masked: rows with a hit are masked step by step and
    every step is looked up again, until nothing new is found.
    """
    keys = list(keys)
    carried = list(dict.fromkeys([*keys, run]))
    whole = texts.select(*carried, _strings(texts, columns).alias("strings"))
    found = checkpointed(occurrences(whole, keys, run, "strings", values))
    marked = values.filter(_may_meet_a_marker(F.col("value")))
    fresh = found
    while not marked.isEmpty() and not fresh.isEmpty():
        known = found.join(fresh.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.collect_set("value").alias("known"))
        steps = F.flatten(F.transform("strings", lambda s: masking_steps(s, F.col("known"))))
        again = whole.join(known, keys).select(*carried, steps.alias("strings"))
        fresh = checkpointed(occurrences(again, keys, run, "strings", marked).join(found, [*carried, "value"], "left_anti"))
        found = found.unionByName(fresh)
    return found.groupBy(*keys).agg(F.collect_list("value").alias("sensitive"))


def _with_run_arrays(texts: DataFrame, keys: Sequence[str], columns: Sequence[str], arrays: DataFrame, size: int, run: str) -> DataFrame:
    """The texts with ``sensitive``, what masking may meet in them of their run's array, empty for a run without one.

    The array is narrowed by one search per value and row, so that masking sorts and replaces only values that occur.
    """
    if size <= BROADCAST_CHARACTERS:
        joined = texts.join(F.broadcast(arrays), run, "left")
    else:
        # A run may hold most of the texts: its array is copied to every salt, its texts are dealt out over them.
        salted = arrays.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")
        joined = texts.withColumn("_salt", salt).join(salted, [run, "_salt"], "left").drop("_salt")
    occurring = let(F.array_join(_strings(texts, columns), "\n"), lambda t: F.filter("_plain", lambda v: F.contains(t, v)))
    narrowed = F.coalesce(F.concat(occurring, F.col("_marked")), F.array().cast("array<string>"))
    return joined.withColumn("sensitive", narrowed).drop("_plain", "_marked")


def _may_meet_a_marker(value: Column) -> Column:
    """Values that may occur in a text only once another value in it is masked: parts of the marker or over its edge."""
    return F.contains(F.lit(SENSITIVE_MARK), value) | F.contains(value, F.lit("[")) | F.contains(value, F.lit("]"))


def with_sensitive_values(
    texts: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    values: DataFrame,
    run: str = "run_id",
    limit: int = VALUES_PER_RUN,
    prepare: Callable[[DataFrame], DataFrame] = lambda texts: texts,
) -> DataFrame:
    """Add ``sensitive``: the run's values that may occur in the row's texts.

    ``values`` is read several times, first to measure it: runs with at most ``limit`` values carry them as an
    array, which is broadcast if all arrays together are small. Values of other runs are looked up in the texts; a value
    that masking does not meet changes nothing, so redaction gives one result whatever the limit. ``columns`` hold the
    strings, or arrays of strings, as they are redacted, not escaped; ``prepare`` adds those that are derived, once the
    texts of large runs and of others are told apart.
    """
    none = F.array().cast("array<string>")
    counts = values.groupBy(run).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("size"))
    few = F.col("n") <= limit
    total = counts.agg(
        F.coalesce(F.sum(F.when(few, F.col("size") + 16 * F.col("n"))), F.lit(0)).alias("size"), F.count_if(~few).alias("large")
    ).first()
    listed = F.collect_list("value")
    arrays = (
        values.join(counts.filter(few).select(run), run, "left_semi")
        .groupBy(run)
        .agg(listed.alias("_all"))
        .select(run, F.filter("_all", lambda v: ~_may_meet_a_marker(v)).alias("_plain"), F.filter("_all", _may_meet_a_marker).alias("_marked"))
    )
    if not total["large"]:
        return _with_run_arrays(prepare(texts), keys, columns, arrays, total["size"], run)
    # Only the texts of the large runs are shuffled; the others are read apart from them.
    large = counts.filter(~few).select(run)
    large = F.broadcast(large) if total["large"] <= BROADCAST_ROWS else large
    others = _with_run_arrays(prepare(texts.join(large, run, "left_anti")), keys, columns, arrays, total["size"], run)
    busy = prepare(texts.join(large, run, "left_semi"))
    found = values_in_texts(busy, keys, columns, values.join(large, run, "left_semi"), run)
    busy = busy.join(found, list(keys), "left").withColumn("sensitive", F.coalesce("sensitive", none))
    return others.unionByName(busy)


def redact_columns(
    texts: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    values: DataFrame | None = None,
    run: str = "run_id",
    detectors: Iterable[Detector] = DETECTORS,
    limit: int = VALUES_PER_RUN,
) -> DataFrame:
    """A copy with the text columns redacted; ``values`` are the sensitive values per run."""
    detectors = tuple(detectors)
    if values is None:
        return texts.withColumns({c: redacted_column(c, None, detectors) for c in columns})
    marked = with_sensitive_values(texts, keys, columns, values, run, limit)
    return marked.withColumns({c: redacted_column(c, "sensitive", detectors) for c in columns}).drop("sensitive")


# Tool calls read back from JSON: arguments and results may be anything.
_CALLS = "array<struct<name:string,arguments:variant,result:variant>>"


def _calls_from_json(calls: Column) -> Column:
    return F.transform(
        calls,
        lambda c: F.struct(
            c["name"].alias("name"), F.to_json(c["arguments"]).alias("arguments"), F.to_json(c["result"]).alias("result")
        ),
    )


def _calls_as_json(calls: Column) -> Column:
    """Tool calls as one JSON text; arguments that are no JSON become a JSON string."""

    def as_json(text: Column) -> Column:
        quoted = F.to_json(F.array(text))
        inner = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
        return F.when(text.isNull(), F.lit("null")).when(F.try_parse_json(text).isNotNull(), text).otherwise(inner)

    def one(call: Column) -> Column:
        return F.concat(
            F.lit('{"name":'), as_json(F.concat(F.lit('"'), F.regexp_replace(call["name"], r'(["\\])', r"\\$1"), F.lit('"'))),
            F.lit(',"arguments":'), as_json(call["arguments"]),
            F.lit(',"result":'), as_json(call["result"]),
            F.lit("}"),
        )

    return F.concat(F.lit("["), F.array_join(F.transform(calls, one), ","), F.lit("]"))


def redact_turns(
    turns: DataFrame,
    detectors: Iterable[Detector] = DETECTORS,
    values: DataFrame | None = None,
    limit: int = VALUES_PER_RUN,
) -> DataFrame:
    """Redacted copy of a turns table: contents and tool calls.

    ``values`` (run_id, value) are the sensitive values; by default those in the tool calls of each whole run.
    Others, for instance from scenario contexts, can be united with ``harvest_turns(turns)``.
    """
    values = harvest_turns(turns) if values is None else values
    keys = [*ATTEMPT_KEY, "turn"]

    def with_calls(own: DataFrame) -> DataFrame:
        calls = own.withColumn("_calls", _calls_as_json(F.coalesce("tool_calls", F.array())))
        return calls.withColumn("_open", json_strings(F.col("_calls")))

    marked = with_sensitive_values(turns, keys, ["content", "_open"], values, limit=limit, prepare=with_calls)
    return (
        redact_json(marked, "_calls", "sensitive", detectors)
        .withColumn("content", redacted_column("content", "sensitive", detectors))
        .withColumn("tool_calls", _calls_from_json(F.from_json("_calls", _CALLS)))
        .select(*turns.columns)
    )


def redact_recorded(
    recorded: DataFrame, values: DataFrame, detectors: Iterable[Detector] = DETECTORS, limit: int = VALUES_PER_RUN
) -> DataFrame:
    """Redacted copy of recorded attempts: every string but the keys, which are the ids of run, scenario, attempt and
    check. The arrays are redacted in place; nothing is exploded or shuffled."""
    detectors = tuple(detectors)
    plain = [c for c in ("title", "label", "agent_model", "judge_model", "model") if c in recorded.columns]
    open_ended = [c for c in ("configuration", "metrics") if c in recorded.columns]
    calls = F.transform("turns", lambda t: _calls_as_json(F.coalesce(t["tool_calls"], F.array())))
    contents = F.transform("turns", lambda t: t["content"])
    none = F.array().cast("array<string>")
    findings = F.flatten(F.transform("check_results", lambda r: F.array(r["message"], r["evidence"])))
    said = F.concat(F.array(*plain).cast("array<string>"), F.coalesce(contents, none), F.coalesce(findings, none))

    def with_strings(own: DataFrame) -> DataFrame:
        rows = own.withColumn(
            "_calls", F.concat(F.lit("["), F.array_join(F.coalesce(calls, none), ","), F.lit("]"))
        ).withColumn("_said", said)
        return rows.withColumn("_open", F.concat(*[json_strings(F.col(c)) for c in ("_calls", *open_ended)]))

    marked = with_sensitive_values(recorded, ATTEMPT_KEY, ["_said", "_open"], values, limit=limit, prepare=with_strings)
    marked = marked.drop("_said", "_open")
    for column in open_ended:
        marked = redact_json(marked, column, "sensitive", detectors)

    def safe(text: Column) -> Column:
        return redact_text(text, F.col("sensitive"), detectors)

    redacted = redact_json(marked, "_calls", "sensitive", detectors).withColumn(
        "_calls", F.from_json("_calls", f"array<{_CALLS}>")
    )

    def safe_turns() -> Column:
        return F.transform(
            "turns",
            lambda t, i: F.struct(
                t["role"].alias("role"),
                safe(t["content"]).alias("content"),
                _calls_from_json(F.get("_calls", i)).alias("tool_calls"),
            ),
        )

    def safe_results() -> Column:
        return F.transform(
            "check_results", lambda r: r.withField("message", safe(r["message"])).withField("evidence", safe(r["evidence"]))
        )

    turns = remembered(("recorded turns", detectors), safe_turns)
    results = remembered(("recorded results", detectors), safe_results)
    texts = {c: redacted_column(c, "sensitive", detectors) for c in plain}
    return redacted.withColumns({**texts, "turns": turns, "check_results": results}).select(*recorded.columns)


def remaining_leaks(
    redacted: DataFrame, columns: Sequence[str], detectors: Iterable[Detector] = DETECTORS
) -> DataFrame:
    """Rows of a redacted table in which a detector still finds something."""
    found = F.concat(*[detect(F.col(c), detectors=tuple(detectors)) for c in columns])
    return redacted.withColumn("leaks", found).filter(F.size("leaks") > 0)
