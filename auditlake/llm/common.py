"""What the operators share: durable intermediate tables, Arrow batches of texts, files in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a batch that are turned into Python objects at a time.
ROWS_AT_A_TIME = 512
BITS = 1 << 26  # of the table that says which keys may be in a set: 8 MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    On a local master without that setting a temporary folder is chosen once and set; on a cluster its absence
    is an error, since a machine's own folder would be lost with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="auditlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return qualified(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: computed once, read as often as needed, safe from lost executors."""
    spark = df.sparkSession
    path = folder or new_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parted(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among `keys`, of one column, and those whose key is not.

    A table of BITS bits, however many keys there are, goes to every task, so that rows are parted where they are read
    and the others need not be shuffled to be joined with the keys.
    """
    place = lambda column: F.pmod(F.xxhash64(column), F.lit(BITS))
    at = place(keys.columns[0])
    table = keys.groupBy(F.bitmap_bucket_number(at).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    marked = rows.join(F.broadcast(saved(table, "key-bits")), F.bitmap_bucket_number(place(key)) == F.col("_part"), "left")
    bit = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    among = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))
    return marked.where(among).drop("_part", "_bits"), marked.where(~among).drop("_part", "_bits")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as Spark understands the path; without a scheme that is Spark's default one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def open_filesystem(uri: str):
    """pyarrow's file system and path for a qualified folder (see `qualified`).

    Folders that only Spark's own connectors reach are refused: files would have to go elsewhere, unseen by others.
    """
    import pyarrow.fs as pafs

    scheme, colon, path = uri.partition(":")
    if not colon:
        raise ValueError(f"{uri} has no file system; qualify it with Spark first")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + path.lstrip("/")
    names = {"s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs"}
    if scheme not in names:
        raise ValueError(f"files cannot be written to {scheme} folders; give a folder of {', '.join(['file', *names])}")
    return pafs.FileSystem.from_uri(names[scheme] + ":" + path)


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under the names doc_id and text; a null text counts as empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sliced_by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many bytes in one column, of one row where that row alone has more."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype="i8")
        at = 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, until - at)
            at = until


def by_rows(df: DataFrame, ddl: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """Map batches of columns to batches of columns in Python.

    `make` is called once per task and returns the function from {column: values} to {column: values}, as lists or as
    Arrow arrays of the wanted type; the order of the output columns is that of `ddl`. Batches are short, so that long texts do not add up.
    """
    schema = arrow_schema(ddl)

    def run(batches):
        step = make()
        for batch in sliced(batches):
            out = step(batch.to_pydict())
            columns = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in schema]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.mapInArrow(run, ddl)
