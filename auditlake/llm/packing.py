"""Packing by powers of two: every document is cut into pieces whose lengths are powers of two.

A piece is a sequence of its own. Sequences of one length form a bucket, a batch is taken from one bucket, and so
no sequence crosses documents and none is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import by_rows, documents_of, saved
from auditlake.llm.encoding import encoder

LONGEST = 1024


def pieces_of(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: as many longest ones as fit, then the binary digits of the rest."""
    out = [(at, longest) for at in range(0, n - longest + 1, longest)]
    at, size = len(out) * longest, longest >> 1
    while size:
        if n - at >= size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    longest: int = LONGEST,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids where asked for.

    `longest` must be a power of two. Ids of sequences count from 0, longest bucket first, without gaps. Null texts
    count as empty and hold the end id alone; null ids and repeated rows stay, each a document of its own; an empty
    table gives no rows. Numbering needs only the number of pieces by length and task.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, place long" + (
        ", ids array<long>" if with_ids else ""
    )

    def make():
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), {}

        def step(rows):
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"] + ["ids"] * with_ids
            out = {name: [] for name in names}
            for doc_id, raw in zip(rows["doc_id"], encode(rows["text"])):
                raw += end
                n = len(raw) // 4
                for start, length in pieces_of(n, longest):
                    place = seen.get(length, 0)
                    seen[length] = place + 1
                    piece = raw[4 * start : 4 * (start + length)]
                    values = (doc_id, start, length, zlib.crc32(piece), n, part, place)
                    for name, value in zip(names, values):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(np.frombuffer(piece, "<u4"))
            return out

        return step

    pieces = saved(by_rows(documents_of(docs, id_col, text_col), ddl, make), "pieces")
    # A row for each length and task.
    counts = saved(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(first, ["length", "part"]).withColumn("sequence_id", F.col("first") + F.col("place"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    return numbered.select(*columns, F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))
