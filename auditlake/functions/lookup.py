"""Which strings of a large set occur in which texts, in one pass over the texts whatever the number of strings.

Every string leaves two fingerprints in a bit table of bounded size: one of its first characters and one of the whole.
Rolling hashes of a text give the fingerprint of each window in constant time, so a text is walked once for each length
up to ``HEAD`` that begins a string; only windows whose beginning is in the table are looked at further, and only those
whose whole is in it leave the scan. What leaves is compared exactly, by an equality join with the strings: the table
may let a wrong window through, never lose a right one.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Characters of a string that decide whether a window is looked at; shorter strings count whole.
HEAD = 8

# Bits of the table for each fingerprint, and its size in bits (as powers of two): 16 MB at most.
BITS_PER_FINGERPRINT = 32
SMALLEST, LARGEST = 16, 27

# Odd multipliers of the rolling hash, of its mix with group and length, and of the three probes.
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_GROUP, _LENGTH = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_PROBES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xE7037ED1A0B428DB)


class _Windows:
    """Rolling hashes of the windows of several texts laid end to end."""

    def __init__(self, texts: Sequence[str], groups: np.ndarray):
        codes = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
        sizes = np.array([len(c) for c in codes], "i8")
        self.ends = np.cumsum(sizes)
        self.text_of = np.repeat(np.arange(len(texts)), sizes)
        self.starts = self.ends - sizes
        self.room = np.repeat(self.ends, sizes) - np.arange(int(sizes.sum()))  # characters left in the own text
        self.groups = groups.astype("u8")
        n = int(sizes.sum()) + 1
        powers, self.undo = np.empty(n, "u8"), np.empty(n, "u8")
        for out, factor in ((powers, _BASE), (self.undo, _UNBASE)):
            out[0], out[1:] = 1, factor
            np.cumprod(out, out=out)
        whole = np.concatenate([*codes, np.zeros(0, "<u4")]).astype("u8") + np.uint64(1)
        self.sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(whole * powers[:-1], dtype="u8")])

    def fingerprints(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of the windows of this length that begin at the given places, mixed with their group and length."""
        rolled = (self.sums[at + length] - self.sums[at]) * self.undo[at]
        mixed = rolled + self.groups[self.text_of[at]] * np.uint64(_GROUP) + np.uint64(length * _LENGTH & (1 << 64) - 1)
        mixed ^= mixed >> np.uint64(29)
        return mixed * np.uint64(_BASE)


def _places(fingerprints: np.ndarray, probe: int, bits: int) -> np.ndarray:
    mixed = fingerprints * np.uint64(_PROBES[probe])
    return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(_GROUP)) >> np.uint64(64 - bits)


def _in_table(table: np.ndarray, bits: int, fingerprints: np.ndarray) -> np.ndarray:
    """Which fingerprints are in the table, as indices."""
    left = np.arange(len(fingerprints))
    for probe in range(len(_PROBES)):
        place = _places(fingerprints[left], probe, bits)
        left = left[(table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return left


def _marks(values: DataFrame, bits: int) -> np.ndarray:
    """The bit table of the values (columns group, value), as 64-bit words."""

    def run(batches):
        for batch in batches:
            texts, groups = batch.column("value").to_pylist(), batch.column("group").to_numpy(zero_copy_only=False)
            for at in range(0, len(texts), 4096):
                own = texts[at : at + 4096]
                windows = _Windows(own, groups[at : at + 4096])
                lengths = np.array([len(t) for t in own])
                places = []
                for length in np.unique(lengths):
                    chosen = windows.starts[lengths == length]
                    for size in {int(length), min(int(length), HEAD)}:
                        marks = windows.fingerprints(chosen, size)
                        places += [_places(marks, probe, bits) for probe in range(len(_PROBES))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places).astype("i8"))], names=["place"])

    places = values.mapInArrow(run, "place long")
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << bits - 6, "u8")
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view("u8")
    return table


def occurrences(texts: DataFrame, keys: Sequence[str], group: str, strings: str, values: DataFrame) -> DataFrame:
    """Distinct (keys, group, value) where the value occurs in a text of its group.

    ``texts`` has the key columns, the group and an array of strings, each searched by itself; ``values`` has the columns
    group and value. Empty values, and nulls on either side, occur nowhere. The strings' lengths and the
    bit table go to every task; both are bounded, whatever the number of values, which are joined by equality.
    """
    spark = texts.sparkSession
    carried = list(dict.fromkeys([*keys, group]))
    wanted = values.select(group, "value").filter(F.length("value") > 0).distinct()
    lengths = [r[0] for r in wanted.select(F.length("value").alias("n")).distinct().collect()]
    count = wanted.count()
    bits = min(LARGEST, max(SMALLEST, (2 * BITS_PER_FINGERPRINT * count).bit_length()))
    hashed = F.xxhash64(F.col(group)).alias("group")
    table = spark.sparkContext.broadcast(_marks(wanted.select(hashed, "value"), bits))
    heads = sorted({min(n, HEAD) for n in lengths})
    longer = sorted(n for n in lengths if n > HEAD)
    whole_head = HEAD in lengths
    out = StructType([texts.schema[c] for c in carried] + [StructField("value", StringType())])
    arrow = to_arrow_schema(out)

    def found(windows: _Windows, marks: np.ndarray):
        """(place, length) of the windows whose fingerprints are in the table."""
        for head in heads:
            at = np.flatnonzero(windows.room >= head)
            at = at[_in_table(marks, bits, windows.fingerprints(at, head))]
            if head < HEAD or whole_head:
                yield at, head
            if head == HEAD:
                for length in longer:
                    fits = at[windows.room[at] >= length]
                    yield fits[_in_table(marks, bits, windows.fingerprints(fits, length))], length

    def scan(rows: pa.RecordBatch, marks: np.ndarray) -> pa.RecordBatch:
        strings, groups = rows.column("_strings").to_pylist(), rows.column("_group").to_numpy(zero_copy_only=False)
        flat = [(i, t) for i, own in enumerate(strings) if own for t in own if t]
        windows = _Windows([t for _, t in flat], groups[[i for i, _ in flat]] if flat else groups[:0])
        hits = set()
        for places, length in found(windows, marks):
            for place in places:
                row, text = flat[windows.text_of[place]]
                start = place - windows.starts[windows.text_of[place]]
                hits.add((row, text[start : start + length]))
        hits = sorted(hits)
        kept = [rows.column(c).take(pa.array([i for i, _ in hits], pa.int64())) for c in carried]
        return pa.RecordBatch.from_arrays([*kept, pa.array([v for _, v in hits], pa.string())], schema=arrow)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield scan(batch.slice(at, 256), table.value)

    offered = texts.select(*carried, F.col(strings).alias("_strings"), F.xxhash64(F.col(group)).cast(LongType()).alias("_group"))
    return offered.mapInArrow(run, out).join(wanted, [group, "value"], "left_semi").distinct()


# The scan travels with the queries, to executors that do not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
