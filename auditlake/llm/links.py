"""Links between rows: comparing the members of buckets, and the components that links make.

A bucket is a set of rows that may be linked. Large buckets are cut into blocks by a hash of the member, and every
pair of blocks is compared by itself, so no task holds more than two blocks of one bucket. A comparison never emits
its pairs: each member gets the number of its links and the smallest member it reaches within the comparison, which
is enough to count links and to join components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_schema, discard, new_folder, saved

BLOCK = 512


def in_blocks(members: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """`members` (bucket, id, ..) with `sizes` (bucket, n): a row for each pair of blocks that a member is part of.

    Adds left and right, the two blocks of the pair, and side, the member's own block. Where `sizes` also has `before` and
    m, the m members of a bucket whose `first` is `before` are paired with one another elsewhere: they lie in blocks of their
    own, which meet only the blocks of the others.
    """
    rows = members.join(sizes, "bucket")
    blocks = lambda n: F.ceil(n / block).cast("int")
    part = F.xxhash64("id", "bucket")
    if "before" in sizes.columns:
        m, paired = F.coalesce("m", F.lit(0)), F.coalesce(F.col("first") == F.col("before"), F.lit(False))
        others, theirs = blocks(F.col("n") - m), blocks(m)
        rows = rows.withColumn("side", F.when(paired, others + F.pmod(part, theirs)).otherwise(F.pmod(part, others)).cast("int"))
        rows = rows.withColumn("meets", F.when(paired, others).otherwise(others + theirs)).where("meets > 0").drop("before", "m", "first")
    else:
        rows = rows.withColumn("side", F.pmod(part, blocks(F.col("n"))).cast("int")).withColumn("meets", blocks(F.col("n")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    return rows.withColumn("left", F.least("side", "other")).withColumn("right", F.greatest("side", "other")).drop("other", "meets", "n")


def by_group(rows: DataFrame, keys: list[str], ddl: str, compare: Callable[[pa.Table], dict[str, object] | None]) -> DataFrame:
    """Call `compare` with the rows of each group of `keys`, one group at a time; it returns columns or None.

    Groups come sorted through a task's batches, so a task holds one group.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.Table] = []
        key = None
        out: list[dict] = []
        count = 0

        def made(final: bool):
            nonlocal out, count
            if out and (final or count > 20_000):
                columns = [pa.array(np.concatenate([np.asarray(o[f.name]) for o in out]), f.type) for f in schema]
                out, count = [], 0
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        def close():
            nonlocal held, count
            if held:
                result = compare(pa.concat_tables(held) if len(held) > 1 else held[0])
                held = []
                if result is not None:
                    out.append(result)
                    count += len(next(iter(result.values())))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            values = [table[k].to_numpy() for k in keys]
            cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
            starts = [0, *cuts.tolist()]
            for start, end in zip(starts, [*starts[1:], table.num_rows]):
                own = tuple(v[start] for v in values)
                if own != key:
                    close()
                    yield from made(False)
                    key = own
                held.append(table.slice(start, end - start))
        close()
        yield from made(True)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


def reached(adjacent: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member the smallest id in its component of a symmetric boolean matrix."""
    low = ids.copy()
    largest = np.iinfo(np.int64).max
    while True:
        # Only rows that have links can change.
        new = np.minimum(low, np.where(adjacent, low[None, :], largest).min(1, initial=largest))
        if (new == low).all():
            return low
        low = new


def components(edges: DataFrame) -> DataFrame:
    """node, component over undirected `edges` (a, b): the smallest node that each node reaches.

    Nodes without an edge are not among the rows; edges with a null end are left out, repeated edges and loops do no
    harm. Every round takes the neighbours' smallest label and then the label's own label, and is written to shared
    storage; rounds end when no label changes.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    both = saved(edges.union(edges.select("b", "a")).distinct(), "edges")
    folder = new_folder(spark, "labels")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels", folder)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        onward = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = hooked.join(onward, "component", "left").select("node", "old", F.least("component", "next").alias("component"))
        new_folder_ = new_folder(spark, "labels")
        new = saved(moved, "labels", new_folder_)
        changed = new.where("old <> component").limit(1).count()
        labels = new.select("node", "component")
        discard(spark, folder)
        folder = new_folder_
        if not changed:
            return labels
