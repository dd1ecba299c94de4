"""Queries over a scenario catalog made of parts, line items and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import governance as gv
from auditlake.operators import metrics as mt
from auditlake.operators import reports as rp
from auditlake.plans import inputs as src
from auditlake.sources import catalog as ct

# --- loading ---------------------------------------------------------------------------------


def _nested_catalog(spark, sf):
    """Parts with their line items as nested catalog entries, as a catalog directory would yield them."""
    parts = src.scenarios(spark, sf)
    li = src.table(spark, sf, "lineitem")
    # A part's checks: its line numbers and flags, each pair once, numbered in order.
    kinds = li.select(
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("scenario_id"), "l_linenumber", "l_returnflag"
    ).distinct()
    check = F.struct(
        "l_linenumber",
        "l_returnflag",
        F.struct(
            F.concat(F.lit("check_"), F.col("l_linenumber").cast("string"), "l_returnflag").alias("id"),
            F.when(F.col("l_returnflag") == "A", F.lit("min_length")).when(F.col("l_returnflag") == "R", F.lit("json_valid"))
            .otherwise(F.lit("required_phrase")).alias("type"),
            F.when(F.col("l_linenumber") % 2 == 0, F.lit("high")).alias("severity"),
            F.lit(None).cast("array<string>").alias("regulations"),
            F.array(F.concat(F.lit("phrase "), F.col("l_linenumber").cast("string"))).alias("patterns"),
            F.lit(None).cast("boolean").alias("case_sensitive"),
            F.lit(None).cast("boolean").alias("must_appear"),
            F.lit(None).cast("string").alias("scope"),
            F.lit(None).cast("array<string>").alias("pii_types"),
            F.lit(None).cast("string").alias("rubric"),
            F.lit(None).cast("string").alias("judge_pass_if"),
            F.lit(None).cast("int").alias("min_length"),
            F.when(F.col("l_linenumber") == 3, F.lit(500)).alias("max_length"),
            F.lit(None).cast("double").alias("max_latency_ms"),
        ).alias("c"),
    )
    checks = kinds.groupBy("scenario_id").agg(F.transform(F.array_sort(F.collect_list(check)), lambda s: s["c"]).alias("checks"))
    none = F.lit(None)
    reply = F.struct(
        F.concat(F.lit("About "), F.col("title")).alias("text"),
        F.array().cast("array<struct<name:string,arguments:string>>").alias("tool_calls"),
    )
    naive = F.when(F.col("label") != "unlabelled", F.array(reply, reply))
    return parts.join(checks, "scenario_id", "left").select(
        F.col("scenario_id").alias("id"), "title", none.cast("string").alias("description"),
        F.when(F.col("label") != "violation_expected", F.col("label")).alias("label"), "tags", "regulations",
        none.cast("string").alias("context"), F.array(F.concat(F.lit("Tell me about "), "title")).alias("customer_turns"),
        "checks", F.struct(F.array(reply).alias("compliant"), naive.alias("naive")).alias("scripts"), "file_name",
    )


def catalog_scenarios(spark, sf):
    s = ct.scenarios_of(_nested_catalog(spark, sf))
    return s.withColumns({c: F.array_join(c, ",") for c in ("tags", "regulations", "customer_turns")})


CATALOG_SCENARIOS = f"""WITH {src.SCENARIOS_SQL} SELECT file_name, scenario_id, title, '' AS description, label,
  array_to_string(tags, ',') AS tags, array_to_string(regulations, ',') AS regulations, '{{}}' AS context,
  'Tell me about ' || title AS customer_turns FROM scenarios"""


def catalog_checks(spark, sf):
    c = ct.checks_of(_nested_catalog(spark, sf))
    return c.select(
        "scenario_id", "check_pos", "check_id", "type", "severity", F.size("regulations").alias("n_regulations"),
        F.array_join("patterns", ";").alias("patterns"), "case_sensitive", "must_appear", "scope",
        F.size("pii_types").alias("n_pii_types"), "rubric", "judge_pass_if", "min_length", "max_length", "max_latency_ms",
    )


CATALOG_CHECKS = """WITH kinds AS (SELECT DISTINCT l_partkey, l_linenumber, l_returnflag FROM lineitem)
SELECT 'part_' || l_partkey AS scenario_id,
  CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_returnflag) - 1 AS INTEGER) AS check_pos,
  'check_' || l_linenumber || l_returnflag AS check_id,
  CASE l_returnflag WHEN 'A' THEN 'min_length' WHEN 'R' THEN 'json_valid' ELSE 'required_phrase' END AS type,
  CASE WHEN l_linenumber % 2 = 0 THEN 'high' ELSE 'medium' END AS severity, 0 AS n_regulations,
  'phrase ' || l_linenumber AS patterns, FALSE AS case_sensitive, TRUE AS must_appear, 'agent' AS scope, 0 AS n_pii_types,
  '' AS rubric, 'yes' AS judge_pass_if, 0 AS min_length, CASE WHEN l_linenumber = 3 THEN 500 ELSE 100000 END AS max_length,
  0.0::DOUBLE AS max_latency_ms FROM kinds"""


def catalog_scripts(spark, sf):
    return ct.scripts_of(_nested_catalog(spark, sf)).select("scenario_id", "persona", "entry_pos", "text", F.size("tool_calls").alias("n_calls"))


CATALOG_SCRIPTS = f"""WITH {src.SCENARIOS_SQL}, e AS (
  SELECT scenario_id, title, 'compliant' AS persona, 0 AS entry_pos FROM scenarios UNION ALL
  SELECT scenario_id, title, 'naive', CAST(unnest(range(2)) AS INTEGER) FROM scenarios WHERE label <> 'unlabelled')
SELECT scenario_id, persona, entry_pos, 'About ' || title AS text, 0 AS n_calls FROM e"""


def tagged_scenarios(spark, sf):
    kept = ct.with_tags(src.scenarios(spark, sf), ct.parse_tags("red, promo,adversarial"))
    return kept.select("scenario_id", "title", "label")


TAGGED_SCENARIOS = f"""WITH {src.SCENARIOS_SQL} SELECT scenario_id, title, label FROM scenarios
WHERE list_has_any(tags, ['red', 'promo', 'adversarial'])"""


def registry(spark, sf):
    return ct.latest_per_id(src.registry(spark, sf))


REGISTRY = f"WITH {src.REGISTRY_SQL} SELECT * FROM registry"


def regulation_lookup(spark, sf):
    cited = src.scenarios(spark, sf).select("scenario_id", F.explode("regulations").alias("regulation"))
    return ct.with_regulation(cited, registry(spark, sf), "regulation")


REGULATION_LOOKUP = f"""WITH {src.SCENARIOS_SQL}, {src.REGISTRY_SQL}, c AS (
  SELECT scenario_id, unnest(regulations) AS regulation FROM scenarios)
SELECT scenario_id, regulation, coalesce(name, regulation) AS name, coalesce(authority, '') AS authority
FROM c LEFT JOIN registry ON id = regulation"""


# --- integrity -------------------------------------------------------------------------------------


def _checks(spark, sf):
    return src.results(spark, sf).select("scenario_id", "regulations")


def unknown_regulations(spark, sf):
    return gv.unknown_regulations(src.scenarios(spark, sf), _checks(spark, sf), registry(spark, sf))


UNKNOWN_REGULATIONS = f"""WITH {src.SCENARIOS_SQL}, {src.RESULTS_SQL}, {src.REGISTRY_SQL}, c AS (
  SELECT scenario_id, unnest(regulations) AS regulation FROM scenarios UNION
  SELECT scenario_id, unnest(regulations) FROM results)
SELECT scenario_id, regulation FROM c WHERE regulation NOT IN (SELECT id FROM registry)"""


def unexercised_regulations(spark, sf):
    """All regulations of all checks against a registry that has entries by parts too, more than checks cite."""
    by_part = src.table(spark, sf, "part").select(F.concat(F.lit("NATION_"), (F.col("p_partkey") % 40).cast("string")).alias("id"))
    return gv.unexercised_regulations(_checks(spark, sf), registry(spark, sf).select("id").unionByName(by_part))


UNEXERCISED_REGULATIONS = f"""WITH {src.RESULTS_SQL}, {src.REGISTRY_SQL}, entries AS (
  SELECT id FROM registry UNION SELECT 'NATION_' || p_partkey % 40 FROM part)
SELECT id FROM entries WHERE id NOT IN (SELECT unnest(regulations) FROM results WHERE regulations IS NOT NULL)"""


def malformed_scenarios(spark, sf):
    """A line item is a check of its part's scenario if its discount is high, else of none."""
    part = F.concat(F.lit("part_"), F.col("l_partkey").cast("string"))
    checks = src.table(spark, sf, "lineitem").select(F.when(F.col("l_discount") >= 0.1, part).otherwise("none").alias("scenario_id"))
    return gv.malformed_scenarios(src.scenarios(spark, sf), checks)


MALFORMED_SCENARIOS = f"""WITH {src.SCENARIOS_SQL}, s AS (
  SELECT scenario_id, scenario_id NOT IN (SELECT CASE WHEN l_discount >= 0.1 THEN 'part_' || l_partkey ELSE 'none' END FROM lineitem) AS no_checks,
    label NOT IN ('violation_expected', 'benign_control') AS bad_label FROM scenarios)
SELECT * FROM s WHERE no_checks OR bad_label"""


def adversarial_without_scripts(spark, sf):
    many, flag = F.col("l_quantity") >= 45, F.col("l_returnflag")
    scripts = src.table(spark, sf, "lineitem").select(
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("scenario_id"),
        F.when(many & (flag == "A"), F.lit("compliant")).when(many & (flag == "R"), F.lit("naive")).alias("persona"),
    )
    out = gv.adversarial_without_scripts(src.scenarios(spark, sf), scripts)
    return out.withColumn("missing_personas", F.array_join("missing_personas", ","))


ADVERSARIAL_WITHOUT_SCRIPTS = f"""WITH {src.SCENARIOS_SQL}, p AS (
  SELECT scenario_id,
    CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE 'part_' || l_partkey = scenario_id AND l_quantity >= 45 AND l_returnflag = 'A')
      THEN NULL ELSE 'compliant' END AS c,
    CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE 'part_' || l_partkey = scenario_id AND l_quantity >= 45 AND l_returnflag = 'R')
      THEN NULL ELSE 'naive' END AS n
  FROM scenarios WHERE list_contains(tags, 'adversarial'))
SELECT scenario_id, concat_ws(',', c, n) AS missing_personas FROM p WHERE c IS NOT NULL OR n IS NOT NULL"""


def catalog_tags(spark, sf):
    return gv.catalog_tags(src.scenarios(spark, sf))


CATALOG_TAGS = f"WITH {src.SCENARIOS_SQL} SELECT DISTINCT unnest(tags) AS tag FROM scenarios ORDER BY tag"

REQUIRED = ["red", "promo", "adversarial", "prompt_injection", "escalation", "economy"]


def missing_tags(spark, sf):
    return gv.missing_tags(spark, src.scenarios(spark, sf), REQUIRED)


MISSING_TAGS = f"""WITH {src.SCENARIOS_SQL}, r AS (SELECT unnest({src.sql_value(REQUIRED)}) AS tag)
SELECT tag FROM r WHERE tag NOT IN (SELECT unnest(tags) FROM scenarios)"""


# --- listings ------------------------------------------------------------------------------------------


def catalog_table(spark, sf):
    return rp.catalog_table(src.scenarios(spark, sf))


CATALOG_TABLE = f"""WITH {src.SCENARIOS_SQL} SELECT scenario_id, title, label, array_to_string(regulations, ', ') AS regulations
FROM scenarios ORDER BY file_name"""


def regulation_table(spark, sf):
    return rp.regulation_table(registry(spark, sf))


REGULATION_TABLE = f"WITH {src.REGISTRY_SQL} SELECT id, name, authority FROM registry ORDER BY file_pos"


def regulations_exercised(spark, sf):
    return mt.regulations_exercised(src.results(spark, sf), registry(spark, sf))


REGULATIONS_EXERCISED = f"""WITH {src.RESULTS_SQL}, {src.REGISTRY_SQL}, e AS (
  SELECT DISTINCT run_id, unnest(regulations) AS regulation FROM results)
SELECT run_id, regulation FROM e WHERE regulation IN (SELECT id FROM registry)"""


QUERIES = {
    "catalog_scenarios": (catalog_scenarios, CATALOG_SCENARIOS),
    "catalog_checks": (catalog_checks, CATALOG_CHECKS),
    "catalog_scripts": (catalog_scripts, CATALOG_SCRIPTS),
    "catalog_tag_filter": (tagged_scenarios, TAGGED_SCENARIOS),
    "regulation_registry": (registry, REGISTRY),
    "regulation_lookup": (regulation_lookup, REGULATION_LOOKUP),
    "regulations_exercised": (regulations_exercised, REGULATIONS_EXERCISED),
    "unknown_regulations": (unknown_regulations, UNKNOWN_REGULATIONS),
    "unexercised_regulations": (unexercised_regulations, UNEXERCISED_REGULATIONS),
    "malformed_scenarios": (malformed_scenarios, MALFORMED_SCENARIOS),
    "adversarial_without_scripts": (adversarial_without_scripts, ADVERSARIAL_WITHOUT_SCRIPTS),
    "catalog_tags": (catalog_tags, CATALOG_TAGS),
    "missing_tags": (missing_tags, MISSING_TAGS),
    "catalog_table": (catalog_table, CATALOG_TABLE),
    "regulation_table": (regulation_table, REGULATION_TABLE),
}
