"""Near-duplicate embeddings: balanced binary codes, multi-index Hamming tables, reranking with the vectors.

Iterative quantisation learns on a bounded sample a rotation after which the signs of the components lose least. Every
vector gets a code of 64 bits in eight parts. Two codes that differ in at most 15 bits have a part in which they
differ in at most one bit; a table for each part and each masked bit brings such codes into one bucket. Candidates
within the radius are then compared by cosine with the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_schema, saved
from auditlake.llm.links import by_group, components, in_blocks, reached

BITS = 64
PART = 8
RADIUS = 15  # 2 * BITS / PART - 1: what the tables find without fail
SAMPLE = 20_000  # vectors of each length that a rotation is learned from, at most
ROUNDS = 30
BLOCK = 128  # members; rows are short, and small blocks spread a large group of copies over many tasks


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension x bits) for unit vectors; short vectors get several rotations side by side."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    centred = x - mean
    _, _, axes = np.linalg.svd(centred.T @ centred + 1e-9 * np.eye(x.shape[1]))
    parts, left, rng = [], bits, np.random.default_rng(seed)
    while left:
        width = min(left, x.shape[1])
        basis = axes[:width].T
        v = centred @ basis
        rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds if len(x) else 0):
            u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        parts.append(basis @ rotation)
        left -= width
    return mean, np.concatenate(parts, 1)


def _usable(embedding) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square is lost or too large."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _parts(codes: np.ndarray) -> np.ndarray:
    return codes.view("u1").reshape(len(codes), -1)


def _owners(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs the table in which they count: the first part that differs in at most one bit, and that bit."""
    apart = _parts(codes)[i] ^ _parts(codes)[j]
    near = np.bitwise_count(apart) <= 1
    part = near.argmax(1)
    bit = np.log2(np.maximum(apart[np.arange(len(i)), part], 1)).astype(int)
    return np.where(near.any(1), part * PART + bit, -1)


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    radius: int = RADIUS,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of equal label are linked when their cosine, in double precision, is at least `threshold`. Vectors that
    are null, empty, zero or hold null or non-finite components, rows without label and rows without id have no links;
    vectors of different length are never linked. n_links counts other rows linked directly, component_id is the
    smallest id reachable, kept says whether that is the row's own; a row without id has a null component and is kept.
    Rows repeated with one id, label and vector count as one. An empty table gives an empty result. Equal vectors
    are compared once, with the number of their rows as weight.
    """
    label = vectors[label_col].cast("string") if label_col else F.lit("")
    own = vectors[vector_col]
    # Single-precision components stay as they are; anything else is compared in double precision as it is.
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":
        own = own.cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), label.alias("label"), own.alias("vector"))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector"))).distinct()
    # Equal vectors of one label become one: its smallest id and the number of rows.
    classes = usable.groupBy("label", "vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"))
    classes = saved(classes, "vector-classes")
    codes = saved(_coded(classes), "vector-codes")
    vectors_of = classes.select(F.col("first").alias("id"), "weight", "vector", "label")
    links = saved(_linked(codes, vectors_of, threshold, radius), "vector-links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    reach = components(links.where("low <> id").select(F.col("id").alias("a"), F.col("low").alias("b")))
    # What a class knows comes together first, so that a class of very many rows is joined once and can be split.
    known = classes.join(counts.withColumnRenamed("id", "first"), "first", "left")
    known = saved(known.join(reach.withColumnRenamed("node", "first"), "first", "left"), "class-links")
    members = usable.join(known, ["label", "vector"]).select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id")
    )
    # An id that stands on several rows has the links of all of them.
    members = members.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("id").join(members, "id", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _coded(classes: DataFrame) -> DataFrame:
    """id, label, length, code of every class, by a rotation learned on a bounded sample of each length."""
    lengths = classes.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()  # distinct lengths only
    models = {}
    for length, n in lengths:
        share = int(min(1.0, 1.2 * SAMPLE / n) * (1 << 20))
        some = classes.where((F.size("vector") == length) & (F.pmod(F.xxhash64("first"), F.lit(1 << 20)) <= share))
        some = some.select("first", "vector").limit(SAMPLE).toArrow()
        x = np.array(some["vector"].to_pylist(), float).reshape(some.num_rows, length)[np.argsort(some["first"].to_numpy())]
        models[length] = learn_rotation(_unit(x))
    ddl = "id long, label string, length int, code long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            lengths = np.array([len(v) for v in batch["vector"]], np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                part = batch.take(pa.array(at))
                x = part["vector"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)
                mean, projection = models[int(length)]
                bits = (_unit(x) - mean) @ projection >= 0
                code = np.packbits(bits, axis=1).view("<i8").reshape(-1)
                yield pa.RecordBatch.from_arrays([part["first"], part["label"], pa.array(np.full(len(at), length, np.int32)), pa.array(code)], schema=schema)

    return classes.select("first", "label", "vector").mapInArrow(run, ddl)


def _linked(codes: DataFrame, vectors: DataFrame, threshold: float, radius: int) -> DataFrame:
    """id, links, low: for members of a bucket the weight of those linked there, and the smallest reached."""
    tables = BITS // PART * PART
    # The part's byte with one bit masked, the table's number, label and length make the bucket.
    bucket = []
    for table in range(tables):
        part, bit = divmod(table, PART)
        byte = F.shiftright("code", 8 * part).bitwiseAND(F.lit(0xFF & ~(1 << bit)))
        bucket.append(F.struct(F.lit(table).cast("long").alias("table"), byte.alias("byte")))
    rows = codes.withColumn("t", F.explode(F.array(*bucket)))
    rows = rows.select("id", "code", F.col("t.table").alias("table"), F.xxhash64("label", "length", "t.table", "t.byte").alias("bucket"))
    sizes = saved(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "hamming-sizes")

    def candidates(group):
        """Members that have a candidate counted in this bucket."""
        code, side = group["code"].to_numpy().astype("<i8"), group["side"].to_numpy()
        if len(code) < 2:
            return None
        left, right = group["left"][0].as_py(), group["right"][0].as_py()
        apart = np.bitwise_count((code[:, None] ^ code[None, :]).view("<u8")) <= radius
        apart &= (side == left)[:, None] & (side == right)[None, :]
        i, j = np.nonzero(np.triu(apart, 1) if left == right else apart)
        own = _owners(code, i, j) == group["table"][0].as_py()
        some = np.unique(np.concatenate([i[own], j[own]]))
        if not len(some):
            return None
        return {name: group[name].to_numpy()[some] for name in ("bucket", "left", "right", "side", "table", "id", "code")}

    ddl = "bucket long, left int, right int, side int, table long, id long, code long"
    found = saved(by_group(in_blocks(rows, sizes, BLOCK), ["bucket", "left", "right"], ddl, candidates), "hamming-candidates")
    # Vectors travel only to the comparisons that have a candidate.
    carried = found.join(vectors.select("id", "weight", "vector", "label"), "id")

    def compare(group):
        code, side = group["code"].to_numpy().astype("<i8"), group["side"].to_numpy()
        ids, weight = group["id"].to_numpy(), group["weight"].to_numpy()
        left, right = group["left"][0].as_py(), group["right"][0].as_py()
        labels, lengths = group["label"].to_pylist(), [len(v) for v in group["vector"]]
        same = np.unique([f"{n}:{x}" for n, x in zip(lengths, labels)], return_inverse=True)[1]
        linked = np.zeros((len(ids), len(ids)), bool)
        vectors = group["vector"].combine_chunks()
        for kind in np.unique(same):  # one, unless two buckets share a hash
            at = np.flatnonzero(same == kind)
            x = _unit(np.array(vectors.take(at).to_pylist(), float))
            linked[np.ix_(at, at)] = x @ x.T >= threshold
        linked &= np.bitwise_count((code[:, None] ^ code[None, :]).view("<u8")) <= radius
        linked &= (side == left)[:, None] & (side == right)[None, :]
        i, j = np.nonzero(np.triu(linked, 1) if left == right else linked)
        own = _owners(code, i, j) == group["table"][0].as_py()
        i, j = i[own], j[own]
        if not len(i):
            return None
        linked[:] = False
        linked[i, j] = linked[j, i] = True
        at = np.flatnonzero(linked.any(1))
        linked, ids = linked[np.ix_(at, at)], ids[at]
        return {"id": ids, "links": linked @ weight[at], "low": reached(linked, ids)}

    return by_group(carried, ["bucket", "left", "right"], "id long, links long, low long", compare)
