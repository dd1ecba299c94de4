"""Compliance checks: eleven kinds, dispatched per attempt against the checks of its scenario.

Two ways to the same results:

``evaluate_attempts``  one row per attempt that already holds its texts; a projection.
``screen_turns``       flat turns; phrases and patterns that cannot reach over a line break are
                       tested turn by turn, and only the numbers of the hits are shuffled.
``evaluate_turns``     flat turns; the first two combined: lengths come from the lengths of the turns, and
                       text is gathered only as far as a check of the scenario needs the joined text.

The catalog is joined on scenario_id without a hint: Spark broadcasts it when its size, which it knows
of files and of local tables, is below the session's threshold, so that no transcript text is
shuffled; above it Spark shuffles and splits skewed scenarios.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.judge import parse_verdict
from auditlake.functions.lookup import occurrences
from auditlake.functions.patterns import java_patterns
from auditlake.functions.pii import DETECTORS, FINDINGS_TYPE, Detector, detect, may_match, previews, reach
from auditlake.functions.severity import severity_weight
from auditlake.functions.text import STRIP_CHARS, has_pattern, has_phrase, json_valid, let, strip
from auditlake.operators.transcripts import MONEY, agent_text, all_text, tool_names
from auditlake.schemas import ATTEMPT_KEY, CHECK_RESULT
from auditlake.session import remembered

CHECK_FIELDS = [
    "check_pos", "check_id", "type", "severity", "regulations", "patterns", "case_sensitive", "must_appear", "scope",
    "pii_types", "rubric", "judge_pass_if", "min_length", "max_length", "max_latency_ms",
]

# What a catalog entry means where it leaves a field out.
CHECK_DEFAULTS = {
    "severity": "medium", "case_sensitive": False, "must_appear": True, "scope": "agent", "rubric": "",
    "judge_pass_if": "yes", "min_length": 0, "max_length": 100000, "max_latency_ms": 0.0,
}
LIST_FIELDS = ("regulations", "patterns", "pii_types")

# Thresholds that stand in for a configured 0.
MIN_LENGTH_IF_ZERO = 10
MAX_LENGTH_IF_ZERO = 1000
MAX_LATENCY_MS_IF_ZERO = 5000.0


def with_check_defaults(checks: DataFrame) -> DataFrame:
    """Fill absent columns and nulls of a checks table with their defaults."""
    missing = [f for f in (*CHECK_DEFAULTS, *LIST_FIELDS) if f not in checks.columns]
    for name in missing:
        checks = checks.withColumn(name, F.lit(None))
    filled = {name: F.coalesce(F.col(name), F.lit(value)).alias(name) for name, value in CHECK_DEFAULTS.items()}
    filled |= {
        name: F.coalesce(F.col(name).cast("array<string>"), F.array().cast("array<string>")).alias(name)
        for name in LIST_FIELDS
    }
    return checks.select("scenario_id", *[filled.get(f, F.col(f)) for f in CHECK_FIELDS])


# Kinds decided without the text of an attempt, and by the lengths of its turns alone.
TEXT_FREE_TYPES = ("tool_call_expected", "tool_call_forbidden", "max_latency", "llm_judge")
LENGTH_TYPES = ("min_length", "max_length")
TOOL_TYPES = ("tool_call_expected", "tool_call_forbidden")
PHRASE_TYPES = ("required_phrase", "prohibited_phrase")

# A pattern made of these pieces alone can neither match a line break nor look past one: no \s, \D, \W,
# no negated class, no anchors, no inline flags, no control characters.
WITHIN_LINE = r"(?:\\[dwbS]|\\[^A-Za-z0-9\x00-\x1f]|\((?!\?)|\(\?:|\[(?!\^)|[^\\^$(\[\x00-\x1f])*+"


def turn_local() -> Column:
    """Whether a check can be decided turn by turn, as a column over the checks table.

    The joined text of an attempt puts a line break between turns, so a phrase or pattern that cannot
    reach over one is in the joined text exactly when it is in some turn.
    """
    one_line = F.forall("patterns", lambda p: ~F.contains(p, F.lit("\n")))
    simple = F.forall("patterns", lambda p: F.rlike(p, F.lit(rf"\A{WITHIN_LINE}\z")))
    return (
        F.col("type").isin(*TOOL_TYPES)
        | (F.col("type").isin(*PHRASE_TYPES) & one_line)
        | ((F.col("type") == "regex") & simple)
    )


def replaced_kinds(check_types: dict[str, Evaluator] | None) -> list[str]:
    """Built-in kinds that a table evaluates otherwise. What those read is unknown, so they get the whole text."""
    given = check_types or {}
    return [name for name in given if name in CHECK_TYPES and given[name] is not CHECK_TYPES[name]]


def checks_by_scenario(checks: DataFrame, replaced: Sequence[str] = (), regex: bool = True) -> DataFrame:
    """One row per scenario: its checks in catalog order, and what they need of the turns beyond the hits.

    The patterns of regex checks are translated here, once per check; a pattern Python would not compile stops the
    query with the id of its check. ``regex`` is off where no such check is evaluated.

    ``needs_text``, ``needs_pii`` and ``needs_length`` are structs of flags for agent turns and for all turns.
    """
    kind = F.col("type")
    own = kind.isin(*replaced)

    def text() -> Column:
        return own | (~F.col("local") & ~kind.isin(*TEXT_FREE_TYPES, *LENGTH_TYPES, "no_pii_leak"))

    def needed(what: Column, name: str) -> Column:
        everywhere = F.col("scope") == "all"
        return F.struct(
            F.bool_or(what & ~everywhere).alias("agent"), F.bool_or(what & everywhere).alias("everything")
        ).alias(name)

    def at_empty() -> Column:
        """Positions of the patterns that empty text satisfies, found once per check."""
        places = F.sequence(F.lit(0), F.size("patterns"))
        by_phrase = F.filter(places, lambda i: F.get("patterns", i) == "")
        by_pattern = F.filter(places, lambda i: F.rlike(F.lit(""), F.get("compiled", i)))
        return F.when(kind.isin(*PHRASE_TYPES), by_phrase).when(kind == "regex", by_pattern)

    def translated() -> Column:
        if not regex:
            return F.lit(None).cast("array<string>")
        return java_patterns(F.when(kind == "regex", F.col("patterns")), F.col("case_sensitive"), F.col("check_id"))

    made = {
        "local": lambda: turn_local() & ~own,
        "compiled": translated,
        "at_empty": lambda: F.coalesce(at_empty(), F.array().cast("array<int>")),
        "checks": lambda: F.array_sort(F.collect_list(F.struct(*CHECK_FIELDS, "local", "compiled", "at_empty"))).alias("checks"),
        "needs_text": lambda: needed(text(), "needs_text"),
        "needs_pii": lambda: needed(kind == "no_pii_leak", "needs_pii"),
        "needs_length": lambda: needed(kind.isin(*LENGTH_TYPES), "needs_length"),
    }
    part = {name: remembered(("catalog", name, tuple(replaced), regex), build) for name, build in made.items()}
    rows = with_check_defaults(checks)
    for name in ("local", "compiled", "at_empty"):
        rows = rows.withColumn(name, part[name])
    return rows.groupBy("scenario_id").agg(*[part[n] for n in ("checks", "needs_text", "needs_pii", "needs_length")])


# The message of a passed and of a failed check, by kind.
MESSAGES = {
    "required_phrase": ("All required disclosures present.", "Missing required disclosure(s)."),
    "prohibited_phrase": ("No prohibited statements.", "Prohibited statement found."),
    "regex, must appear": ("Required pattern(s) present.", "Required pattern(s) missing."),
    "regex, must not appear": ("No forbidden pattern matched.", "Forbidden pattern matched."),
    "no_pii_leak": ("No PII leak detected in agent output.", "Agent exposed protected personal data."),
    "tool_call_expected": ("Required backend tool call(s) made.", "Expected backend tool was not called."),
    "tool_call_forbidden": ("No forbidden tool calls.", "Agent invoked a forbidden/unauthorized tool."),
    "json_valid": ("Valid JSON response.", "Invalid JSON response."),
}


# --- what a check can see of an attempt ---------------------------------------------------


@dataclass(frozen=True)
class Evidence:
    """Columns of one attempt, already evaluated, plus the patterns present per check."""

    present: Callable[[Column], Column]
    target: Callable[[Column], Column] | None = None
    length: Callable[[Column], Column] | None = None
    findings: Callable[[Column], Column] | None = None
    latency_before: Callable[[Column], Column] | None = None
    judge_answer: Callable[[Column], Column] | None = None


def _outcome(kind: str, passed: Column, evidence: Column) -> Column:
    good, bad = MESSAGES[kind]
    return F.struct(
        passed.alias("passed"),
        F.when(passed, F.lit(good)).otherwise(F.lit(bad)).alias("message"),
        F.when(passed, F.lit("")).otherwise(evidence).alias("evidence"),
    )


def _without_hits(kind: str, hits: Column) -> Column:
    """Passes when the list is empty; the list is the evidence."""
    return let(hits, lambda found: _outcome(kind, F.size(found) == 0, F.array_join(found, "; ")))


def _missing(check: Column, seen: Evidence) -> Column:
    present = seen.present(check)
    # Whether any is missing is a matter of hashing; which, in order and with repetitions, is looked up only then.
    none = F.array().cast("array<string>")
    some = F.size(F.array_except(check["patterns"], present)) > 0
    return F.when(some, F.filter(check["patterns"], lambda p: ~F.array_contains(present, p))).otherwise(none)


def required_phrase(check: Column, seen: Evidence) -> Column:
    return _without_hits("required_phrase", _missing(check, seen))


def prohibited_phrase(check: Column, seen: Evidence) -> Column:
    return _without_hits("prohibited_phrase", seen.present(check))


def regex(check: Column, seen: Evidence) -> Column:
    return F.when(check["must_appear"], _without_hits("regex, must appear", _missing(check, seen))).otherwise(
        _without_hits("regex, must not appear", seen.present(check))
    )


def tool_call_expected(check: Column, seen: Evidence) -> Column:
    return _without_hits("tool_call_expected", _missing(check, seen))


def tool_call_forbidden(check: Column, seen: Evidence) -> Column:
    return _without_hits("tool_call_forbidden", seen.present(check))


def no_pii_leak(check: Column, seen: Evidence) -> Column:
    wanted = F.filter(
        seen.findings(check),
        lambda f: (F.size(check["pii_types"]) == 0) | F.array_contains(check["pii_types"], f["type"]),
    )
    return let(
        wanted, lambda found: _outcome("no_pii_leak", F.size(found) == 0, F.array_join(previews(found), ", "))
    )


def _length_outcome(length: Column, limit: Column, passed: Column, words: str) -> Column:
    return F.struct(
        passed.alias("passed"),
        F.concat(F.lit("Response length is "), length.cast("string"), F.lit(" characters.")).alias("message"),
        F.concat(F.lit(words), limit.cast("string")).alias("evidence"),
    )


def min_length(check: Column, seen: Evidence) -> Column:
    limit = F.coalesce(F.nullif(check["min_length"], F.lit(0)), F.lit(MIN_LENGTH_IF_ZERO))
    return let(seen.length(check), lambda n: _length_outcome(n, limit, n >= limit, "min required: "))


def max_length(check: Column, seen: Evidence) -> Column:
    limit = F.coalesce(F.nullif(check["max_length"], F.lit(0)), F.lit(MAX_LENGTH_IF_ZERO))
    return let(seen.length(check), lambda n: _length_outcome(n, limit, n <= limit, "max allowed: "))


def _tenths(ms: Column) -> Column:
    return F.bround(ms.cast("decimal(38,12)"), 1).cast("decimal(38,1)").cast("string")


def max_latency(check: Column, seen: Evidence) -> Column:
    limit = F.coalesce(F.nullif(check["max_latency_ms"], F.lit(0.0)), F.lit(MAX_LATENCY_MS_IF_ZERO))
    return let(
        seen.latency_before(check),
        lambda ms: F.struct(
            (ms <= limit).alias("passed"),
            F.concat(F.lit("Total latency is "), _tenths(ms), F.lit("ms.")).alias("message"),
            F.concat(F.lit("max allowed: "), _tenths(limit), F.lit("ms")).alias("evidence"),
        ),
    )


def json_response(check: Column, seen: Evidence) -> Column:
    return let(json_valid(seen.target(check)), lambda ok: _outcome("json_valid", ok, F.lit("")))


def llm_judge(check: Column, seen: Evidence) -> Column:
    if seen.judge_answer is None:
        text = F.concat(F.lit("Check '"), check["check_id"], F.lit("' needs judge responses but none were given."))
        return F.raise_error(text).cast("struct<passed:boolean,message:string,evidence:string>")
    return let(
        parse_verdict(seen.judge_answer(check), check["judge_pass_if"]),
        lambda v: F.struct(v["passed"], v["message"], v["reason"].alias("evidence")),
    )


Evaluator = Callable[[Column, Evidence], Column]

CHECK_TYPES: dict[str, Evaluator] = {
    "required_phrase": required_phrase,
    "prohibited_phrase": prohibited_phrase,
    "regex": regex,
    "no_pii_leak": no_pii_leak,
    "tool_call_expected": tool_call_expected,
    "tool_call_forbidden": tool_call_forbidden,
    "min_length": min_length,
    "max_length": max_length,
    "max_latency": max_latency,
    "json_valid": json_response,
    "llm_judge": llm_judge,
}


def only(*names: str) -> dict[str, Evaluator]:
    """The check-type table cut to the kinds a catalog is known to hold; any other kind is then unknown."""
    return {name: CHECK_TYPES[name] for name in names}


def register_check_type(
    name: str, evaluator: Evaluator, check_types: dict[str, Evaluator] | None = None
) -> dict[str, Evaluator]:
    """A check-type table with one more kind. The evaluator gets the check struct and the evidence and
    returns struct(passed, message, evidence); it may be built on a pandas UDF."""
    return {**(CHECK_TYPES if check_types is None else check_types), name: evaluator}


def _dispatch(check: Column, seen: Evidence, check_types: dict[str, Evaluator]) -> Column:
    unknown = F.raise_error(F.concat(F.lit("Unknown check type: "), check["type"]))
    branch = None
    for name, evaluator in check_types.items():
        outcome = evaluator(check, seen)
        branch = F.when(check["type"] == name, outcome) if branch is None else branch.when(check["type"] == name, outcome)
    outcome = branch.otherwise(unknown.cast("struct<passed:boolean,message:string,evidence:string>"))
    return let(
        outcome,
        lambda o: F.struct(
            check["check_pos"].alias("check_pos"),
            check["check_id"].alias("check_id"),
            check["type"].alias("type"),
            o["passed"].alias("passed"),
            check["severity"].alias("severity"),
            check["regulations"].alias("regulations"),
            o["message"].alias("message"),
            o["evidence"].alias("evidence"),
        ),
    )


def _wants(checks: Column, kinds: Sequence[str], scope: str) -> Column:
    return F.exists(checks, lambda c: c["type"].isin(*kinds) & (c["scope"] == scope))


# --- attempts that hold their texts --------------------------------------------------------


def evaluate_attempts(
    attempts: DataFrame,
    checks: DataFrame,
    check_types: dict[str, Evaluator] | None = None,
    detectors: Iterable[Detector] = DETECTORS,
    known_patterns: Sequence[str] = (),
) -> DataFrame:
    """Add ``check_results``, an array in catalog order, to each attempt.

    ``attempts`` needs scenario_id and any of: agent_text, all_text, tools (array of names),
    agent_latency_ms, judge (map check_pos -> struct(content, latency_ms)); from ``_screened`` also hits and turns.
    ``known_patterns`` lists regexes of the catalog that are worth compiling once per task.
    """
    check_types = CHECK_TYPES if check_types is None else check_types
    detectors = tuple(detectors)
    have = set(attempts.columns)
    catalog_rows = checks_by_scenario(checks, replaced_kinds(check_types), "regex" in check_types)
    joined = attempts.join(catalog_rows, "scenario_id", "left")
    known_patterns = tuple(known_patterns)
    key = ("check_results", frozenset(have & _READ), tuple(check_types.items()), detectors, known_patterns)
    evaluated = remembered(key, lambda: _check_results(have, check_types, detectors, known_patterns))
    return joined.withColumn("check_results", evaluated).drop("checks", "needs_text", "needs_pii", "needs_length")


# Columns of an attempt that the checks read where it has them.
_READ = {"agent_text", "all_text", "tools", "agent_latency_ms", "judge", "hits", "turns"}


def _check_results(
    have: set[str], check_types: dict[str, Evaluator], detectors: Sequence[Detector], known_patterns: Sequence[str]
) -> Column:
    """The results of an attempt that has these columns, for the checks of its scenario."""
    empty = F.lit("")
    has_judge = "judge" in have
    has_hits = "hits" in have
    has_parts = "turns" in have and "hits" in have
    catalog = F.col("checks")
    agent = F.coalesce(F.col("agent_text"), empty) if "agent_text" in have else empty
    everything = F.coalesce(F.col("all_text"), empty) if "all_text" in have else empty
    no_findings = F.array().cast(FINDINGS_TYPE)

    def findings() -> Column:
        """Findings of the agent text and of the whole text; of neither when no check asks for them."""
        if "no_pii_leak" not in check_types:
            return F.array(no_findings, no_findings)
        scanned = F.array(
            *[F.when(_wants(catalog, ("no_pii_leak",), s), t) for s, t in (("agent", agent), ("all", everything))]
        )
        return F.transform(scanned, lambda t: F.when(t.isNull(), no_findings).otherwise(detect(t, detectors=detectors)))

    row = F.struct(
        agent.alias("agent"),
        everything.alias("everything"),
        F.when(_wants(catalog, PHRASE_TYPES, "agent"), F.lower(agent)).alias("agent_folded"),
        F.when(_wants(catalog, PHRASE_TYPES, "all"), F.lower(everything)).alias("everything_folded"),
        findings().alias("findings"),
        (F.col("tools") if "tools" in have else F.array().cast("array<string>")).alias("tools"),
        (F.col("agent_latency_ms") if "agent_latency_ms" in have else F.lit(0.0)).cast("double").alias("latency"),
    )

    def results(r: Column) -> Column:
        def by_scope(check: Column, agent_side: str, all_side: str) -> Column:
            return F.when(check["scope"] == "all", r[all_side]).otherwise(r[agent_side])

        def present(check: Column) -> Column:
            text = by_scope(check, "agent", "everything")
            folded = by_scope(check, "agent_folded", "everything_folded")
            phrase = F.filter(check["patterns"], lambda p: has_phrase(text, folded, p, check["case_sensitive"]))
            pattern = F.filter(
                check["patterns"],
                lambda p, i: has_pattern(text, p, check["case_sensitive"], known_patterns, F.get(check["compiled"], i)),
            )
            tool = F.filter(check["patterns"], lambda p: F.array_contains(r["tools"], p))
            by_text = (
                F.when(check["type"].isin(*TOOL_TYPES), tool).when(check["type"] == "regex", pattern).otherwise(phrase)
            )
            return F.when(check["local"], _present_by_hits(check, F.col("hits"))).otherwise(by_text) if has_hits else by_text

        def latency_before(check: Column) -> Column:
            # Judge calls made for earlier checks of the same attempt count.
            if not has_judge:
                return r["latency"]
            earlier = F.filter(
                catalog, lambda c: (c["check_pos"] < check["check_pos"]) & (c["type"] == "llm_judge")
            )
            return F.aggregate(
                earlier,
                r["latency"],
                lambda acc, c: acc + F.coalesce(F.col("judge")[c["check_pos"]]["latency_ms"], F.lit(0.0)),
            )

        def length(check: Column) -> Column:
            if has_parts:
                in_scope = F.filter("turns", lambda t: (check["scope"] == "all") | (t["role"] == "agent"))
                return stripped_length(in_scope)
            return F.length(strip(by_scope(check, "agent", "everything")))

        def evaluate(check: Column) -> Column:
            # The patterns present are found once per check and bound, whichever evaluator reads them.
            return let(
                present(check),
                lambda bound: _dispatch(
                    check,
                    Evidence(
                        present=lambda _: bound,
                        target=lambda c: by_scope(c, "agent", "everything"),
                        length=length,
                        findings=lambda c: F.get(r["findings"], F.when(c["scope"] == "all", F.lit(1)).otherwise(F.lit(0))),
                        latency_before=latency_before,
                        judge_answer=(lambda c: F.col("judge")[c["check_pos"]]["content"]) if has_judge else None,
                    ),
                    check_types,
                ),
            )

        return F.transform(catalog, evaluate)

    none = F.array().cast(f"array<{CHECK_RESULT}>")
    return F.coalesce(let(row, results).cast(f"array<{CHECK_RESULT}>"), none)


def nested_attempts(transcripts: DataFrame) -> DataFrame:
    """Texts and tool names of nested transcripts (column ``turns``), without a shuffle."""
    return (
        transcripts.withColumn("agent_text", agent_text(F.col("turns")))
        .withColumn("all_text", all_text(F.col("turns")))
        .withColumn("tools", F.array_distinct(tool_names(F.col("turns"))))
    )


def results_of(attempts: DataFrame, keys: Sequence[str] = ATTEMPT_KEY) -> DataFrame:
    """One row per check result of attempts holding ``check_results``.

    Outer, with the empty row dropped behind: for a plain generator Spark infers a filter on the array and
    evaluates all checks a second time in it.
    """
    return attempts.select(*keys, F.inline_outer("check_results")).filter(F.col("check_pos").isNotNull())


# --- flat turns ----------------------------------------------------------------------------

HIT = "struct<check_pos:int,pattern_pos:int>"

# Phrases or tools of a check above which they are looked up all at once.
WIDE = 64


def _is_wide() -> Column:
    return turn_local() & F.col("type").isin(*PHRASE_TYPES, *TOOL_TYPES) & (F.size("patterns") > WIDE)


def _wide_hits(turns: DataFrame, wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits (keys, hit) of checks with many phrases or tools.

    Each turn is walked once, whatever the number of phrases of its scenario (see ``functions.lookup``); what is found is
    joined with the phrases by equality. Tools called are joined with the tools named.
    """
    numbered = F.posexplode("patterns").alias("pattern_pos", "pattern")
    named = wide.select("scenario_id", "check_pos", "type", "scope", "case_sensitive", numbered)
    spoken, tools = named.filter(~F.col("type").isin(*TOOL_TYPES)), named.filter(F.col("type").isin(*TOOL_TYPES))

    def group(exact: Column) -> Column:
        return F.concat(F.when(exact, F.lit("exact:")).otherwise(F.lit("folded:")), F.col("scenario_id"))

    value = F.when(F.col("case_sensitive"), F.col("pattern")).otherwise(F.lower("pattern"))
    spoken = spoken.withColumns({"group": group(F.col("case_sensitive")), "value": value})
    ways = F.array(*[F.struct(F.lit(e).alias("exact"), t.alias("text")) for e, t in ((True, F.col("content")), (False, F.lower("content")))])
    texts = (
        turns.join(wide.select("scenario_id").distinct(), "scenario_id", "left_semi")
        .select(*keys, "role", F.explode(ways).alias("way"), "scenario_id")
        .select(*keys, "role", group(F.col("way.exact")).alias("group"), F.array("way.text").alias("strings"))
    )
    said = occurrences(texts, [*keys, "role"], "group", "strings", spoken.select("group", "value")).join(
        spoken.drop("scenario_id"), ["group", "value"]
    )
    said = said.filter((F.col("scope") == "all") | (F.col("role") == "agent"))
    hit = F.struct("check_pos", "pattern_pos").cast(HIT).alias("hit")
    if "tool_calls" not in turns.columns:
        return said.select(*keys, hit)
    called = turns.select(*dict.fromkeys([*keys, "scenario_id"]), F.explode("tool_calls.name").alias("pattern"))
    used = called.join(tools, ["scenario_id", "pattern"])
    return said.select(*keys, hit).unionByName(used.select(*keys, hit))

def _turn_hits(known_patterns: Sequence[str]) -> Column:
    """Numbers of the (check, pattern) pairs that one turn satisfies."""

    def hits(r: Column) -> Column:
        def of_check(check: Column) -> Column:
            in_scope = (check["scope"] == "all") | r["is_agent"]
            numbered = F.transform(check["patterns"], lambda p, i: F.struct(p.alias("p"), i.alias("i")))
            met = F.filter(
                numbered,
                lambda n: F.when(check["type"].isin(*TOOL_TYPES), F.array_contains(r["tools"], n["p"]))
                .when(~in_scope, F.lit(False))
                .when(
                    check["type"] == "regex",
                    has_pattern(r["text"], n["p"], check["case_sensitive"], known_patterns, F.get(check["compiled"], n["i"])),
                )
                .otherwise(has_phrase(r["text"], r["folded"], n["p"], check["case_sensitive"])),
            )
            return F.transform(met, lambda n: F.struct(check["check_pos"].alias("check_pos"), n["i"].alias("pattern_pos")))

        return F.flatten(F.transform(F.filter("checks", lambda c: c["local"]), of_check))

    row = F.struct(
        F.col("content").alias("text"),
        F.lower("content").alias("folded"),
        (F.col("role") == "agent").alias("is_agent"),
        F.col("tools").alias("tools"),
    )
    return let(row, hits).cast(f"array<{HIT}>")


def _present_by_hits(check: Column, hits: Column) -> Column:
    """Patterns of the check that some turn satisfies, or that empty text satisfies; from the hits, not pattern by pattern."""
    own = F.transform(F.filter(hits, lambda h: h["check_pos"] == check["check_pos"]), lambda h: h["pattern_pos"])
    return F.transform(F.array_sort(F.array_union(own, check["at_empty"])), lambda i: F.get(check["patterns"], i))


def stripped_length(parts: Column) -> Column:
    """Length of the stripped text that the parts, joined by line breaks, would make.

    Each part has its ``length`` and the number of whitespace characters it begins (``lead``) and ends with
    (``trail``). Whole parts of whitespace at either end are stripped with the line breaks next to them.
    """

    def measure(solid: Column) -> Column:
        first, last = F.get(solid, F.lit(0)), F.get(solid, F.size(solid) - 1)
        inside = F.filter(parts, lambda p: p["turn"].between(first["turn"], last["turn"]))
        total = F.aggregate(inside, F.lit(-1), lambda acc, p: acc + p["length"] + 1)
        return F.when(F.size(solid) == 0, F.lit(0)).otherwise(total - first["lead"] - last["trail"])

    return let(F.filter(parts, lambda p: p["lead"] < p["length"]), measure)


def _tested(
    turns: DataFrame, checks: DataFrame, known_patterns: Sequence[str], replaced: Sequence[str] = (), regex: bool = True
) -> DataFrame:
    """Turns with the checks of their scenario and the hits of those that are decided turn by turn."""
    no_tools = F.array().cast("array<string>")
    tools = F.coalesce(F.transform("tool_calls", lambda c: c["name"]), no_tools) if "tool_calls" in turns.columns else no_tools
    return (
        turns.withColumn("content", F.coalesce(F.col("content"), F.lit("")))
        .withColumn("tools", tools)
        .join(checks_by_scenario(checks, replaced, regex), "scenario_id", "left")
        .withColumn("hits", remembered(("turn hits", tuple(known_patterns)), lambda: _turn_hits(known_patterns)))
    )


def forbidden_in_turns(
    turns: DataFrame, checks: DataFrame, known_patterns: Sequence[str] = (), keys: Sequence[str] = ATTEMPT_KEY
) -> DataFrame:
    """One row per turn and forbidden phrase, line-bound pattern or tool in it. Without a shuffle, so for streams too."""
    kind = F.col("type")
    forbidding = kind.isin("prohibited_phrase", "tool_call_forbidden") | ((kind == "regex") & ~F.col("must_appear"))
    chosen = with_check_defaults(checks).filter(turn_local() & forbidding)
    check = F.get(F.filter("checks", lambda c: c["check_pos"] == F.col("hit")["check_pos"]), F.lit(0))
    return (
        _tested(turns, chosen, known_patterns)
        .select(*keys, "turn", "checks", F.explode_outer("hits").alias("hit"))
        .filter(F.col("hit").isNotNull())
        .select(*keys, "turn", check.alias("c"), F.col("hit.pattern_pos").alias("pattern_pos"))
        .select(*keys, "turn", "c.check_id", "c.type", "c.severity", F.get("c.patterns", F.col("pattern_pos")).alias("evidence"))
    )


def _screened(
    turns: DataFrame,
    checks: DataFrame,
    known_patterns: Sequence[str],
    keys: Sequence[str],
    detectors: Sequence[Detector] = (),
    with_turns: bool = True,
    replaced: Sequence[str] = (),
    regex: bool = True,
) -> DataFrame:
    """Hits per attempt and, where its checks need it, the turns with their lengths and texts. One shuffle.

    Text enters the shuffle only where it is needed: in full for checks on the whole text, and for personal data
    in full if the turn holds anything a detector looks for, else only its end, where a match may begin.
    """
    kept = [*keys]
    measures = [F.collect_set("hit").alias("hits")]
    if with_turns:
        is_agent = F.col("role") == "agent"

        def needed(name: str) -> Column:
            return F.coalesce(F.col(name)["everything"] | (F.col(name)["agent"] & is_agent), F.lit(False))

        content = F.col("content")
        # Without digits and the like a turn takes part in a match by its end at most.
        tail = reach(detectors)
        for_pii = content if tail is None else F.when(may_match(content, detectors), content).otherwise(F.right(content, F.lit(tail)))
        text = F.when(needed("needs_text"), content).when(needed("needs_pii"), for_pii)
        body = F.length(F.ltrim(content, F.lit(STRIP_CHARS)))
        part = F.struct(
            "turn",
            "role",
            text.alias("content"),
            F.length(content).alias("length"),
            (F.length(content) - body).alias("lead"),
            (F.length(content) - F.length(F.rtrim(content, F.lit(STRIP_CHARS)))).alias("trail"),
        )
        kept.append(F.when(needed("needs_text") | needed("needs_pii") | needed("needs_length"), part).alias("part"))
        # A turn with several hits appears several times; its part is taken from the first.
        measures.append(F.array_sort(F.collect_list(F.when(F.coalesce("n", F.lit(0)) == 0, F.col("part")))).alias("turns"))
    given = with_check_defaults(checks)
    wide = given.filter(_is_wide() & ~F.col("type").isin(*replaced))
    has_wide = given.agg(F.coalesce(F.max(F.size("patterns")), F.lit(0)) > WIDE).first()[0] and not wide.isEmpty()
    tested = _tested(turns, given.filter(~_is_wide() | F.col("type").isin(*replaced)) if has_wide else checks, known_patterns, replaced, regex)
    rows = tested.select(*kept, F.posexplode_outer("hits").alias("n", "hit"))
    if has_wide:
        rows = rows.unionByName(_wide_hits(turns, wide, keys).withColumn("n", F.lit(1)), allowMissingColumns=True)
    return rows.groupBy(*keys).agg(*measures)


def screen_turns(
    turns: DataFrame, checks: DataFrame, known_patterns: Sequence[str] = (), keys: Sequence[str] = ATTEMPT_KEY
) -> DataFrame:
    """Results of the checks that can be decided turn by turn, one row per attempt and check.

    Hits are merged before the shuffle, so an attempt costs at most a few small rows per task,
    however many turns it has.
    """
    local = with_check_defaults(checks).filter(turn_local())
    hits = _screened(turns, local, known_patterns, keys, with_turns=False)
    kinds = only("regex", *PHRASE_TYPES, *TOOL_TYPES)
    return results_of(evaluate_attempts(hits, local, kinds, known_patterns=known_patterns), keys)


def evaluate_turns(
    turns: DataFrame,
    checks: DataFrame,
    usage: DataFrame | None = None,
    judge: DataFrame | None = None,
    check_types: dict[str, Evaluator] | None = None,
    detectors: Iterable[Detector] = DETECTORS,
    known_patterns: Sequence[str] = (),
    keys: Sequence[str] = ATTEMPT_KEY,
) -> DataFrame:
    """``check_results`` per attempt of a flat turns table, all check kinds.

    ``usage``: usage rows, for latency checks. ``judge``: judge responses with latency_ms.
    """
    detectors = tuple(detectors)
    attempts = (
        _screened(
            turns, checks, known_patterns, keys, detectors,
            replaced=replaced_kinds(check_types), regex=check_types is None or "regex" in check_types,
        )
        .withColumn("agent_text", agent_text(F.col("turns")))
        .withColumn("all_text", all_text(F.col("turns")))
    )
    if usage is not None:
        agent_ms = (
            usage.filter("source = 'agent'")
            .groupBy(*keys)
            .agg(F.sum(F.col("latency_ms").cast(MONEY)).cast("double").alias("agent_latency_ms"))
        )
        attempts = attempts.join(agent_ms, list(keys), "left").fillna(0.0, ["agent_latency_ms"])
    if judge is not None:
        attempts = attempts.join(judge_answers(judge, keys), list(keys), "left")
    evaluated = evaluate_attempts(attempts, checks, check_types, detectors, known_patterns)
    return evaluated.select(*keys, "check_results")


def judge_answers(judge: DataFrame, keys: Sequence[str] = ATTEMPT_KEY) -> DataFrame:
    """Judge responses of an attempt as a map from check_pos.

    Of several responses to one request the last counts: by ``received_at`` if the table has that column, else the one
    of the largest latency and content, whatever their order.
    """
    given = F.struct("content", "latency_ms")
    order = F.struct(*(["received_at"] if "received_at" in judge.columns else []), "latency_ms", "content")
    judge = judge.groupBy(*keys, "check_pos").agg(F.max_by(given, order).alias("answer"))
    answer = F.struct("check_pos", "answer")
    return judge.groupBy(*keys).agg(F.map_from_entries(F.collect_list(answer)).alias("judge"))


# --- results to attempts -------------------------------------------------------------------


def summarize_results(results: DataFrame, keys: Sequence[str] = ATTEMPT_KEY) -> DataFrame:
    """Pass flag, violation count and weights per attempt, from result rows."""
    failed = ~F.col("passed")
    weight = severity_weight(F.col("severity"))
    zero = F.lit(0).cast("bigint")
    return results.groupBy(*keys).agg(
        F.bool_and("passed").alias("passed"),
        F.count_if(failed).alias("violations"),
        F.coalesce(F.sum(F.when(failed, weight)), zero).alias("violation_weight"),
        F.coalesce(F.sum(weight), zero).alias("possible_weight"),
    )


def scenario_outcomes(attempts: DataFrame, results: DataFrame, keys: Sequence[str] = ATTEMPT_KEY) -> DataFrame:
    """Outcome of every attempt; one without checks passes with weight 0."""
    zero = F.lit(0).cast("bigint")
    return attempts.join(summarize_results(results, keys), list(keys), "left").select(
        *[F.col(c) for c in attempts.columns],
        F.coalesce("passed", F.lit(True)).alias("passed"),
        *[F.coalesce(c, zero).alias(c) for c in ("violations", "violation_weight", "possible_weight")],
    )


def with_outcome(attempts: DataFrame) -> DataFrame:
    """The same from ``check_results`` arrays, without a shuffle."""
    failed = F.filter("check_results", lambda r: ~r["passed"])
    zero = F.lit(0).cast("bigint")

    def weight(results: Column) -> Column:
        return F.aggregate(results, zero, lambda acc, r: acc + F.coalesce(severity_weight(r["severity"]), zero))

    return (
        attempts.withColumn("passed", F.forall("check_results", lambda r: r["passed"]))
        .withColumn("violations", F.size(failed).cast("bigint"))
        .withColumn("violation_weight", weight(failed))
        .withColumn("possible_weight", weight(F.col("check_results")))
    )


def violations_of(results: DataFrame) -> DataFrame:
    """Failed checks only."""
    return results.filter(~F.col("passed"))
