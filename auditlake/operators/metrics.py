"""Run metrics.

``attempts``: run_id, scenario_id, attempt, label, passed, violations, violation_weight, possible_weight.
``results``: one row per check result. ``usage``: per attempt, as ``transcripts.split_usage`` gives it.
Every aggregation merges before its shuffle, so a run holding most of the rows is no slower than many.
Ratios are left unrounded; ``reports.rounded_metrics`` rounds them for display.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.severity import SEVERITY_WEIGHTS
from auditlake.operators.transcripts import MONEY
from auditlake.session import checkpointed

# Fixed value: name under which failed checks without a regulation are counted.
UNSPECIFIED = "UNSPECIFIED"

RUN = ["run_id"]


def ratio(part: Column, whole: Column, if_empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(if_empty))


def outcome_metrics(attempts: DataFrame) -> DataFrame:
    """Pass rates, reliability over repeated attempts, detection, false positives, weighted score (M1-M9)."""
    flagged = F.col("violations") > 0
    tempting = F.col("label") == "violation_expected"
    benign = F.col("label") == "benign_control"
    by_scenario = attempts.groupBy(*RUN, "scenario_id").agg(
        F.count("*").alias("n"),
        F.count_if("passed").alias("n_passed"),
        F.bool_and("passed").alias("all_passed"),
        F.bool_or("passed").alias("any_passed"),
        F.count_if(tempting).alias("tempting"),
        F.count_if(tempting & flagged).alias("detected"),
        F.count_if(benign).alias("benign"),
        F.count_if(benign & flagged).alias("false_alarms"),
        F.sum("violations").alias("violations"),
        F.sum("violation_weight").alias("violation_weight"),
        F.sum("possible_weight").alias("possible_weight"),
    )
    totals = by_scenario.groupBy(*RUN).agg(
        F.sum("n").alias("total_runs"),
        F.sum("n_passed").alias("passed_runs"),
        F.count("*").alias("scenarios"),
        F.count_if("all_passed").alias("all_passed"),
        F.count_if("any_passed").alias("any_passed"),
        *[F.sum(c).alias(c) for c in ("tempting", "detected", "benign", "false_alarms")],
        F.sum("violations").alias("total_violations"),
        F.sum("violation_weight").alias("violation_weight"),
        F.sum("possible_weight").alias("possible_weight"),
    )
    c = F.col
    pass_any = ratio(c("any_passed"), c("scenarios"))
    pass_all = ratio(c("all_passed"), c("scenarios"))
    return totals.select(
        *RUN,
        "scenarios",
        "total_runs",
        "passed_runs",
        (c("total_runs") - c("passed_runs")).alias("failed_runs"),
        ratio(c("passed_runs"), c("total_runs")).alias("pass_rate"),
        pass_all.alias("pass_all_k"),
        # Named after the first attempt in reports, but true when any attempt passes; kept under both names.
        pass_any.alias("pass_at_1"),
        pass_any.alias("pass_any"),
        (pass_any - pass_all).alias("reliability_drop"),
        ratio(c("detected"), c("tempting")).alias("violation_detection_rate"),
        ratio(c("false_alarms"), c("benign")).alias("false_positive_rate"),
        "total_violations",
        "violation_weight",
        "possible_weight",
        (F.lit(1.0) - ratio(c("violation_weight"), c("possible_weight"))).alias("weighted_score"),
    )


def tally(results: DataFrame) -> DataFrame:
    """Equal results counted: run, severity, passed, regulations and n. As many rows per run as its catalog has kinds
    of outcome; the functions below take it in place of the results, which several of them would read again."""
    return results.groupBy(*RUN, "severity", "passed", "regulations").agg(F.count("*").alias("n"))


def _times(results: DataFrame) -> Column:
    return F.col("n") if "n" in results.columns else F.lit(1).cast("bigint")


def violations_by_severity(results: DataFrame) -> DataFrame:
    """One column of failed checks per severity (M10)."""
    times, none = _times(results), F.lit(0).cast("bigint")
    return results.groupBy(*RUN).agg(
        *[
            F.sum(F.when(~F.col("passed") & (F.col("severity") == s), times).otherwise(none)).alias(f"violations_{s}")
            for s in SEVERITY_WEIGHTS
        ]
    )


def violations_by_regulation(results: DataFrame) -> DataFrame:
    """Failed checks per regulation entry; without an entry they count as unspecified (M11)."""
    cited = F.when(F.size("regulations") > 0, F.col("regulations")).otherwise(F.array(F.lit(UNSPECIFIED)))
    return (
        results.filter(~F.col("passed"))
        .select(*RUN, _times(results).alias("n"), F.explode(cited).alias("regulation"))
        .groupBy(*RUN, "regulation")
        .agg(F.sum("n").alias("violations"))
    )


def regulations_exercised(results: DataFrame, registry: DataFrame) -> DataFrame:
    """(run, regulation) pairs of all checks, passed or not, that the registry knows."""
    known = registry.select(F.col("id").alias("regulation")).distinct()
    return (
        results.select(*RUN, F.explode("regulations").alias("regulation"))
        .distinct()
        .join(known, "regulation", "left_semi")
        .select(*RUN, "regulation")
    )


def with_coverage(runs: DataFrame, results: DataFrame, registry: DataFrame) -> DataFrame:
    """Add covered regulations, registry size and their ratio to a table of runs (M12, M13)."""
    covered = (
        regulations_exercised(results, registry)
        .groupBy(*RUN)
        .agg(F.array_sort(F.collect_list("regulation")).alias("regulations_covered"))
    )
    total = registry.agg(F.count_distinct("id")).scalar()
    none = F.array().cast("array<string>")
    return (
        runs.join(covered, RUN, "left")
        .withColumn("regulations_covered", F.coalesce("regulations_covered", none))
        .withColumn("regulations_total", total)
        .withColumn("compliance_coverage", ratio(F.size("regulations_covered"), F.col("regulations_total")))
    )


def regulation_coverage(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Coverage of the runs that have check results."""
    return with_coverage(results.select(*RUN).distinct(), results, registry)


# Values are put in buckets that keep their order, 4096 per doubling of their size; the bucket of a wanted place is
# cut again into equal parts between its own smallest and largest value.
_BUCKETS_PER_DOUBLING = 4096
_PARTS = 65_536
_DOUBLINGS = 1100  # more than a double has below 1


def order_bucket(value: Column) -> Column:
    """A number that never falls as the value rises."""
    size = F.floor(F.log2(F.abs(value)) * _BUCKETS_PER_DOUBLING) + _DOUBLINGS * _BUCKETS_PER_DOUBLING
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * size).cast("bigint")


def _located(counts: DataFrame, keys: list[str], at: str, carried: list[str]) -> DataFrame:
    """Of counts (keys, name, place, at, n, ..) the rows in which the place lies; place then counts from their start."""
    upto = F.sum("n").over(Window.partitionBy(*keys, "name").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return (
        counts.withColumn("upto", upto)
        .filter((F.col("place") >= F.col("upto") - F.col("n")) & (F.col("place") < F.col("upto")))
        .select(*keys, "name", at, (F.col("place") - F.col("upto") + F.col("n")).alias("place"), *carried)
    )


def value_at_fraction(
    rows: DataFrame, value: str, fractions: dict[str, float], keys: Sequence[str] = RUN
) -> DataFrame:
    """Exact order statistics per key: the element at 0-based place int(n * fraction) of the sorted values."""
    return values_at_fractions(rows, {value: fractions}, keys)


def values_at_fractions(
    rows: DataFrame, wanted: dict[str, dict[str, float]], keys: Sequence[str] = RUN
) -> DataFrame:
    """The same for several columns of one type at once: ``wanted`` names the fractions of each column.

    Two passes over the rows, whatever the number of columns and fractions. The first counts per order-keeping bucket, merged
    before its shuffle, and locates the bucket of each wanted place; the second counts the equal values of those
    buckets alone, which are kept, cut into equal parts, and ranked within the part of the place. Values that lie close
    together, small ones or ones with a common offset, share a bucket but spread over its parts.
    """
    keys, columns = list(keys), list(wanted)
    given = rows.select(*keys, F.lit(columns[0]).alias("column"), F.col(columns[0]).alias("v"))
    if len(columns) > 1:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])
        given = rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    given = given.filter(F.col("v").isNotNull()).withColumn("bucket", order_bucket(F.col("v")))
    asked = [(c, n, f) for c, fractions in wanted.items() for n, f in fractions.items()]
    all_asked = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(n).alias("name"), F.lit(f).alias("fraction")) for c, n, f in asked])
    own = [*keys, "column"]
    buckets = (
        given.groupBy(*own, "bucket")
        .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*own)))
        .withColumn("w", F.explode(F.filter(all_asked, lambda w: w["column"] == F.col("column"))))
        .select(*own, "bucket", "n", "low", "high", "w.name", F.floor(F.col("total") * F.col("w.fraction")).alias("place"))
    )
    bucket = _located(buckets, own, "bucket", ["low", "high"])
    width = F.col("high").cast("double") - F.col("low").cast("double")
    offset = F.col("v").cast("double") - F.col("low").cast("double")
    part = F.when(width > 0, F.floor(offset / width * _PARTS)).otherwise(F.lit(0)).cast("bigint")
    # One row for each key and place on the other side: rows of other buckets leave with the join.
    inside = checkpointed(
        given.join(bucket, [*own, "bucket"])
        .withColumn("part", part)
        .groupBy(*own, "name", "part", "v")
        .agg(F.count("*").alias("n"), F.first("place").alias("place"))
    )
    parts = inside.groupBy(*own, "name", "part").agg(F.sum("n").alias("n"), F.first("place").alias("place"))
    found = _located(parts, own, "part", [])
    values = inside.drop("place").join(found, [*own, "name", "part"])
    picked = _located(values, own, "v", [])
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for _, n, _ in asked])


def latency_percentiles(usage: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Upper median and 90 % latency, not interpolated (M14, M15)."""
    latencies = usage.select(*RUN, F.col(latency).cast("double").alias("ms"))
    return value_at_fraction(latencies, "ms", {"p50_latency_ms": 0.5, "p90_latency_ms": 0.9})


def usage_metrics(usage: DataFrame) -> DataFrame:
    """Cost, latency, tokens, judge share and throughput (M16-M20). ``usage`` has one row per attempt."""

    def exact(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name).cast(MONEY)), F.lit(0).cast(MONEY)).cast("double")

    def whole(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0).cast("bigint"))

    n = F.count("*")
    cost, latency = exact("cost_usd"), exact("latency_ms")
    return usage.groupBy(*RUN).agg(
        cost.alias("cost_usd_total"),
        (cost / n).alias("cost_usd_per_run"),
        latency.alias("latency_ms_total"),
        (latency / n).alias("latency_ms_per_run"),
        whole("prompt_tokens").alias("tokens_prompt"),
        whole("completion_tokens").alias("tokens_completion"),
        whole("model_calls").alias("model_calls"),
        whole("judge_prompt_tokens").alias("judge_tokens_prompt"),
        whole("judge_completion_tokens").alias("judge_tokens_completion"),
        exact("judge_cost_usd").alias("judge_cost_usd_total"),
        exact("judge_latency_ms").alias("judge_latency_ms_total"),
        whole("judge_model_calls").alias("judge_model_calls"),
        F.when(latency > 0, n / (latency / 1000.0)).otherwise(F.lit(0.0)).alias("throughput_runs_per_sec"),
    )


_COUNTED = "array<struct<regulation:string,violations:bigint>>"


def result_metrics(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Violations by severity and by regulation, and the known regulations covered, in one row per run (M10-M12).

    The results are read once. Equal ones are counted, what each count says of a severity or a regulation is added up, and the
    sums of a run, as many as its catalog has severities and regulations, make its row.
    """
    counted = results if "n" in results.columns else tally(results)
    failures = F.when(F.col("passed"), F.lit(0)).otherwise(F.col("n")).cast("bigint")

    def said(what: str, names: Column, n: Column) -> Column:
        return F.transform(names, lambda name: F.struct(F.lit(what).alias("what"), name.alias("name"), n.alias("n")))

    cited = F.when(F.size("regulations") > 0, F.col("regulations")).otherwise(F.array(F.lit(UNSPECIFIED)))
    no = F.lit(0).cast("bigint")
    statements = F.concat(
        said("severity", F.array("severity"), failures), said("cited", cited, failures), said("covered", F.col("regulations"), no)
    )
    sums = counted.select(*RUN, F.explode(statements).alias("s")).groupBy(*RUN, "s.what", "s.name").agg(F.sum("s.n").alias("n"))
    known = registry.select(F.col("id").alias("name"), F.lit(True).alias("known")).distinct()
    is_ = F.col("what") == "cited"
    return (
        sums.join(known, "name", "left")
        .groupBy(*RUN)
        .agg(
            *[
                F.coalesce(F.sum(F.when((F.col("what") == "severity") & (F.col("name") == s), F.col("n"))), no).alias(f"violations_{s}")
                for s in SEVERITY_WEIGHTS
            ],
            F.array_sort(
                F.collect_list(F.when(is_ & (F.col("n") > 0), F.struct((-F.col("n")).alias("k"), F.col("name"), F.col("n"))))
            ).alias("violations_by_regulation"),
            F.array_sort(F.collect_list(F.when((F.col("what") == "covered") & F.col("known"), F.col("name")))).alias("regulations_covered"),
        )
        .withColumn("violations_by_regulation", F.transform("violations_by_regulation", lambda e: F.struct(e["name"], e["n"])).cast(_COUNTED))
    )


def run_metrics(
    attempts: DataFrame, results: DataFrame, registry: DataFrame, usage: DataFrame | None = None, k: int = 1
) -> DataFrame:
    """All metrics of each run in one row (M22). A run without attempts has no row.

    The results are read once, for a tally that the counts of severities and regulations and the coverage share.
    """
    outcome = outcome_metrics(attempts).withColumn("k", F.lit(k))
    total = registry.agg(F.count_distinct("id")).scalar()
    joined = (
        outcome.join(result_metrics(results, registry), RUN, "left")
        .fillna({f"violations_{s}": 0 for s in SEVERITY_WEIGHTS})
        .withColumn("violations_by_regulation", F.coalesce("violations_by_regulation", F.array().cast(_COUNTED)))
        .withColumn("regulations_covered", F.coalesce("regulations_covered", F.array().cast("array<string>")))
        .withColumn("regulations_total", total)
        .withColumn("compliance_coverage", ratio(F.size("regulations_covered"), F.col("regulations_total")))
    )
    if usage is None:
        return joined
    return joined.join(usage_metrics(usage), RUN, "left").join(latency_percentiles(usage), RUN, "left")
