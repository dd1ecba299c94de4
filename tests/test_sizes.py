"""Work per task that does not grow with the input."""

import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from auditlake import session
from auditlake.functions import lookup, pii
from auditlake.functions import redact as rd
from auditlake.operators import gates, redaction
from auditlake.plans import inputs, metric_queries, pii_queries


def orders(spark, folder, n):
    rows = spark.range(n).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        F.lit("2024-01-02").cast("timestamp").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"),
    )
    rows.coalesce(1).write.parquet(f"{folder}/orders.parquet")


def rows_of_tasks(df):
    return [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_tasks_of_heavy_work_are_bounded_whatever_the_rows(spark, tmp_path):
    orders(spark, tmp_path, 450_000)
    assert max(rows_of_tasks(inputs.texts(spark, str(tmp_path), "orders"))) <= session.ROWS_PER_TASK
    assert max(rows_of_tasks(inputs.messages(spark, str(tmp_path)))) <= session.ROWS_PER_TASK


def test_records_are_searched_on_all_cores(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit("s").alias("c_mktsegment"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert len(rows_of_tasks(pii_queries._records(spark, str(tmp_path)))) == 4


@pytest.mark.parametrize("number", ["4111111111111111", "4111111111111112", "4111 1111-1111 1111", "", None, "12", "79927398713" * 2])
def test_check_digits_are_those_of_a_plain_sum(spark, number):
    digits = [int(c) for c in number or "" if c.isdigit()]
    doubled = [sum(divmod(d * 2, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
    expected = 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    assert spark.createDataFrame([(number,)], "v string").select(pii.luhn_valid(F.col("v"))).collect()[0][0] == expected


def test_a_row_carries_only_values_that_occur_in_it(spark):
    texts = spark.createDataFrame([(i, "r", f"see v{i:03d}, not [x]", [f"w{i:03d}"]) for i in range(200)] + [(900, "s", "v001", None), (901, "r", None, None)], "id int, run_id string, text string, more array<string>")
    values = spark.createDataFrame([("r", f"{c}{i:03d}") for c in "vw" for i in range(100)] + [("r", "DACT"), ("r", "t [RED")], "run_id string, value string")
    rows = {r.id: sorted(r.sensitive) for r in redaction.with_sensitive_values(texts, ["id"], ["text", "more"], values).collect()}
    # Those that may occur once another one is masked stay.
    assert rows[7] == ["DACT", "t [RED", "v007", "w007"] and rows[150] == rows[901] == ["DACT", "t [RED"] and rows[900] == []
    clean = {}
    for limit in (1, 256):
        clean[limit] = sorted(tuple(r) for r in redaction.redact_columns(texts, ["id"], ["text"], values, limit=limit).select("id", "text").collect())
    every = values.groupBy("run_id").agg(F.collect_list("value").alias("all"))
    plain = texts.join(every, "run_id", "left").select("id", rd.redact_text(F.col("text"), F.col("all")))
    assert clean[1] == clean[256] == sorted(tuple(r) for r in plain.collect())


def test_scan_for_many_values_needs_no_package_on_executors(tmp_path):
    with open(tmp_path / "scan", "wb") as f:
        cloudpickle.dump(lookup._in_table, f)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    load = f"import pickle; pickle.load(open({str(tmp_path / 'scan')!r}, 'rb'))"
    assert subprocess.run([sys.executable, "-c", load], env=env, cwd=tmp_path).returncode == 0


def test_groups_of_items_are_dealt_out_before_they_are_held(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    items = spark.range(200).select(
        (F.col("id") % 40).alias("l_orderkey"), (F.col("id") % 7).alias("l_partkey"), (F.col("id") % 5).alias("l_suppkey"),
        (F.col("id") % 3).cast("int").alias("l_linenumber"), F.lit(6.0).alias("l_quantity"), F.lit("N").alias("l_returnflag"),
    )
    parts = spark.range(7).select(F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit("T").alias("p_type"), F.lit(3).alias("p_size"), F.lit("B").alias("p_brand"))
    for name, df in (("lineitem", items), ("part", parts)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (metric_queries.item_attempts, metric_queries.run_configuration):
        df = query(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        lowest = plan[plan.rindex("HashAggregate") :]
        assert ", 20), REPARTITION_BY_NUM" in lowest
        assert df.count() > 0


def test_configuration_lists_each_tag_once_and_none_for_a_null_run(spark):
    given = [(1, "b", "s1", ["x", None, "a"]), (1, "a", "s2", ["x"]), (2, "a", "s2", None), (None, "a", "s2", ["x"])]
    rows = gates.run_configuration(spark.createDataFrame(given, "run_id int, file_name string, scenario_id string, tags array<string>"))
    got = {r.run_id: (r.scenario_ids, r.scenario_tags) for r in rows.collect()}
    assert got == {1: (["s2", "s1"], ["a", "x"]), 2: (["s2"], []), None: (["s2"], [])}
