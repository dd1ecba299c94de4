"""Spark session settings the operators rely on."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession

# Run-time settings: time zone for timestamp text, adaptive execution for skewed
# joins, and duplicate JSON keys accepted by the JSON validity test.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session the caller owns."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "auditlake", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call sites in error messages cost several round trips per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_expressions: dict[tuple, tuple[object, Column]] = {}


def remembered(key: tuple, build: Callable[[], Column]) -> Column:
    """An expression over names alone, built once per JVM.

    Building a large one takes thousands of calls from Python to the JVM, seconds in all, which an application that
    evaluates batch after batch need not repeat. The key must say all that the expression depends on.
    """
    gateway = SparkContext._gateway
    try:
        known = _expressions.get((id(gateway), *key))
    except TypeError:  # a part of the key that cannot be compared
        return build()
    if known is None:
        if len(_expressions) >= 256:
            _expressions.clear()
        known = _expressions[(id(gateway), *key)] = gateway, build()
    return known[1]


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names, set for this session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            # Sensitive values pass through here: never a folder of one machine of a cluster.
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="auditlake-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the checkpoint folder the cluster names.

    For results that several aggregations read, such as evaluated attempts: without it each of them would scan
    the transcripts again. The files outlive lost executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


# Rows of a table that one task of heavy work takes, such as pattern search or a hash table of nearly all of them.
ROWS_PER_TASK = 100_000


def tasks_for(df: DataFrame) -> int:
    """Tasks for heavy work on a table as read: one or more per core, as its rows grow. Counts from the files' footers."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores * max(1, -(-df.count() // (cores * ROWS_PER_TASK)))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal the rows of a table as read out to tasks of bounded size, for heavy work on them.

    An input file is split only between its row groups, so without it one core may get all rows of a small file, and
    the rows of a task grow with the input. Tables of as many splits are left as they are. With `by`, rows equal in these
    columns meet in one task.
    """
    tasks = tasks_for(df)
    return df.repartition(tasks, *by) if by or df.rdd.getNumPartitions() < tasks else df


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table whose size Spark knows, so that it can decide on a broadcast."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), struct)
