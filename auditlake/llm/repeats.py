"""Removal of repeated byte strings by merging the sorted suffixes of shards.

Suffixes are taken at anchors only. An anchor is the place of the smallest hashed 8-byte gram among the first grams of
a window, so that two equal windows have equal anchors at equal distances, and every window of the wanted length belongs
to one anchor. Each task is a shard: it gives for its anchors the suffix's beginning, as a fingerprint, the bytes that
follow it, and the bytes that precede the anchor, which are what a Burrows-Wheeler transform holds at the suffix.

Merging puts anchors with one beginning into one block. Blocks of several different contexts are refined the way shard
transforms are interleaved: each round tells the rows of a block apart by one more byte, to the right on one side and
by the preceding byte on the other, and only numbers of blocks are compared, never suffixes. A window that starts `a`
bytes before its anchor is repeated exactly when another row shares its block after `a` rounds to the left and its
block after the remaining rounds to the right.

Strings of two lengths are found in one pass: the anchors are those of the shorter one, and a longer window belongs to
the anchor of its beginning, with more rounds to the right.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_schema, by_rows, discard, new_folder, parted, saved, text_or_empty
from auditlake.llm.shingles import mixed

LENGTH = 400
PASSAGE = 240  # bytes of about forty words
GRAM = 8
TOGETHER = 20_000  # rows that one round of refinement works on at a time
LARGE = 20_000  # contexts of one beginning that a single task refines
SPANS = "array<struct<length: int, start: int, end: int>>"  # bytes that repeated strings of a length cover


def reach_of(length: int) -> int:
    """Grams at the start of a window among which its anchor is: about half of the window."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of less than {2 * GRAM} bytes are not supported")
    return max(1, (length - GRAM) // 2)


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window start, last window start) of the anchors of a text; each window start has one anchor."""
    n, reach = len(data), reach_of(length)
    if n < length:
        return (np.empty(0, np.int64),) * 3
    grams = np.ndarray((n - GRAM + 1,), "<u8", data, 0, (1,))
    low = np.uint64(0xFFFFFFFF)
    # The smallest hash first and, among equal ones, the rightmost place.
    rank = (mixed(grams) & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    width = 1
    while 2 * width <= reach:
        rank = np.minimum(rank[:-width], rank[width:])
        width *= 2
    starts = n - length + 1
    if width < reach:
        rank = np.minimum(rank[: len(rank) - (reach - width)], rank[reach - width :])
    place = (low - (rank[:starts] & low)).astype(np.int64)
    cuts = np.flatnonzero(place[1:] != place[:-1])
    first, last = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [starts - 1]))
    return place[first], first, last


def _two_longs(number: int) -> tuple[int, int]:
    return (number >> 64) - (1 << 63), (number & ((1 << 64) - 1)) - (1 << 63)


def core_of(length: int) -> int:
    """Bytes from an anchor on that all of its windows hold: the beginning."""
    return length - reach_of(length) + 1


def refine_all(
    group: np.ndarray, left: np.ndarray, right: np.ndarray, nearest: dict[int, np.ndarray], farthest: np.ndarray, times: np.ndarray
) -> dict[int, np.ndarray]:
    """`refine` for windows of several lengths: `nearest`, and the result, for each number of bytes beside the beginning."""
    number = lambda blocks: np.unique(blocks, return_inverse=True)[1].astype(np.int64)
    to_right = [group.astype(np.int64)]
    for i in range(right.shape[1]):
        to_right.append(number(to_right[-1] * 257 + right[:, i]))
    repeated = {rounds: np.zeros((len(group), left.shape[1] + 1), bool) for rounds in nearest}
    to_left = group.astype(np.int64)
    for distance in range(left.shape[1] + 1):
        for rounds, least in nearest.items():
            rows = np.flatnonzero((least <= distance) & (distance <= farthest))
            if len(rows):
                pair = to_left[rows] * (len(group) + 1) + to_right[rounds - distance][rows]
                _, where, n = np.unique(pair, return_inverse=True, return_counts=True)
                repeated[rounds][rows, distance] = (n[where] > 1) | (times[rows] > 1)
        if distance < left.shape[1]:
            to_left = number(to_left * 257 + left[:, distance])
    return repeated


def refine(group: np.ndarray, left: np.ndarray, right: np.ndarray, nearest: np.ndarray, farthest: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Which windows are repeated: a row for each context, a column for each distance of a window's start to the anchor.

    `group` numbers the blocks of equal beginnings, `left[:, i]` is the i-th byte before the anchor, `right[:, i]` the
    i-th after the beginning, both filled up with 256; windows start `nearest` to `farthest` bytes before the anchor;
    `times` is how often the context occurs.
    """
    rounds = right.shape[1]
    return refine_all(group, left, right, {rounds: nearest}, farthest, times)[rounds]


def spans_of(repeated: np.ndarray, length: int) -> list[dict[str, int]]:
    """The bytes that repeated windows cover, relative to the anchor: runs of distances make one span each."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], repeated.astype(np.int8), [0]))))
    return [{"length": length, "start": -int(b - 1), "end": length - int(a)} for a, b in zip(edges[::2], edges[1::2])]


def removed(n: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(max(0, a), min(n, b)) for a, b in out]


def _contexts(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """The anchors whose beginnings are repeated: fingerprints of beginning (c1, c2) and context (x1, x2), and its reach.

    Windows of the shortest length start `nearest` to `farthest` bytes before the anchor; `ahead` is how many bytes the
    context has after the beginning, fewer at the end of a text, where longer windows start farther from the anchor.
    """
    core = core_of(lengths[0])

    def make():
        def step(batch):
            names = ("key", "place", "c1", "c2", "x1", "x2", "nearest", "farthest", "ahead")
            out = {name: [] for name in names}
            for key, data, wanted in zip(batch["key"], batch["body"], batch["places"]):
                place, first, last = anchors(data, lengths[0])
                for i in np.flatnonzero(np.isin(place, wanted)).tolist():
                    p, nearest, farthest = int(place[i]), int(place[i] - last[i]), int(place[i] - first[i])
                    right = data[p + core : p + lengths[-1] - nearest]
                    around = data[p - farthest : p] + right
                    context = xxhash.xxh3_128_intdigest(bytes([nearest & 255, nearest >> 8, farthest & 255, farthest >> 8]) + around)
                    values = (key, p, *_two_longs(xxhash.xxh3_128_intdigest(data[p : p + core])), *_two_longs(context), nearest, farthest, len(right))
                    for name, value in zip(names, values):
                        out[name].append(value)
            return out

        return step

    return by_rows(rows, "key long, place int, c1 long, c2 long, x1 long, x2 long, nearest int, farthest int, ahead int", make)


def _all_windows(length: int, core: int) -> Column:
    """What all windows of a context cover; less than the length where the text ends before the first one does."""
    nearest = F.greatest(F.col("nearest"), length - core - F.col("ahead"))
    return F.struct(F.lit(length).alias("length"), (-F.col("farthest")).alias("start"), (length - nearest).alias("end"))


def _with_bytes(classes: DataFrame, texts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Contexts with the bytes around their beginnings, cut out of the text of one of their places."""
    core = core_of(lengths[0])
    names = ("c1", "c2", "x1", "x2", "times", "nearest", "farthest", "ahead", "m")

    def make():
        def step(batch):
            out = {name: [] for name in (*names, "left", "right")}
            for data, wanted in zip(batch["body"], batch["wanted"]):
                for row in wanted:
                    p = row["place"]
                    out["left"].append(data[p - row["farthest"] : p])
                    out["right"].append(data[p + core : p + lengths[-1] - row["nearest"]])
                    for name in names:
                        out[name].append(row[name])
            return out

        return step

    wanted = classes.select(F.col("at.key").alias("key"), F.struct(F.col("at.place").alias("place"), *names).alias("w"))
    wanted = wanted.groupBy("key").agg(F.collect_list("w").alias("wanted"))
    ddl = "c1 long, c2 long, x1 long, x2 long, times long, nearest int, farthest int, ahead int, m long, left binary, right binary"
    return by_rows(texts.select("key", "body").join(wanted, "key").select("body", "wanted"), ddl, make)


def _padded(column: list[bytes], width: int, backwards: bool) -> np.ndarray:
    out = np.full((len(column), width), 256, np.int64)
    for i, data in enumerate(column):
        values = np.frombuffer(data, "u1")
        out[i, : len(data)] = values[::-1] if backwards else values
    return out


def _refined(classes: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """c1, c2, x1, x2, spans of contexts, refined in one task for each beginning."""
    ddl = f"c1 long, c2 long, x1 long, x2 long, spans {SPANS}"
    schema, core = arrow_schema(ddl), core_of(lengths[0])

    def flush(table: pa.Table):
        c1, c2 = table["c1"].to_numpy(), table["c2"].to_numpy()
        group = np.concatenate(([0], np.cumsum((c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]))))
        nearest, farthest = table["nearest"].to_numpy(), table["farthest"].to_numpy()
        left = _padded(table["left"].to_pylist(), lengths[0] - core, True)
        right = _padded(table["right"].to_pylist(), lengths[-1] - core, False)
        ahead = table["ahead"].to_numpy()
        least = {length - core: np.maximum(nearest, length - core - ahead) for length in lengths}
        repeated = refine_all(group, left, right, least, farthest, table["times"].to_numpy())
        spans = [[span for length in lengths for span in spans_of(repeated[length - core][i], length)] for i in range(len(group))]
        columns = [table[c].combine_chunks() for c in ("c1", "c2", "x1", "x2")] + [pa.array(spans, schema.field("spans").type)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held:
                table = pa.concat_tables([*held, table])
            held = [table]
            if table.num_rows >= TOGETHER:
                # Whole blocks only; the last one may go on in the next batch.
                c1, c2 = table["c1"].to_numpy(), table["c2"].to_numpy()
                same = (c1 == c1[-1]) & (c2 == c2[-1])
                cut = table.num_rows - int(same.sum())
                if cut:
                    yield flush(table.slice(0, cut))
                    held = [table.slice(cut)]
        if held and held[0].num_rows:
            yield flush(held[0])

    return classes.repartition("c1", "c2").sortWithinPartitions("c1", "c2").mapInArrow(run, ddl)


def _counted(classes: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """The same for beginnings of very many contexts: windows are counted by their fingerprints, over all tasks."""
    core = core_of(lengths[0])

    def make():
        def step(batch):
            names = ("c1", "c2", "x1", "x2", "times", "length", "distance", "w1", "w2")
            out = {name: [] for name in names}
            for i, (left, right) in enumerate(zip(batch["left"], batch["right"])):
                for length in lengths:
                    for distance in range(max(batch["nearest"][i], length - core - len(right)), batch["farthest"][i] + 1):
                        rest = right[: length - core - distance]
                        window = _two_longs(xxhash.xxh3_128_intdigest(left[len(left) - distance :] + rest))
                        values = (*(batch[c][i] for c in ("c1", "c2", "x1", "x2", "times")), length, distance, *window)
                        for name, value in zip(names, values):
                            out[name].append(value)
            return out

        return step

    ddl = "c1 long, c2 long, x1 long, x2 long, times long, length int, distance int, w1 long, w2 long"
    windows = saved(by_rows(classes, ddl, make), "windows")
    keys = ["c1", "c2", "length", "distance", "w1", "w2"]
    often = saved(windows.groupBy(*keys).agg(F.sum("times").alias("n")).where("n > 1").select(*keys), "window-counts")
    found = windows.join(often, keys).groupBy("c1", "c2", "x1", "x2").agg(F.collect_list(F.struct("length", "distance")).alias("starts"))

    def make_spans():
        def step(batch):
            out = {name: batch[name] for name in ("c1", "c2", "x1", "x2")} | {"spans": []}
            for starts in batch["starts"]:
                spans = []
                for length in lengths:
                    flags = np.zeros(reach_of(lengths[0]), bool)
                    flags[[s["distance"] for s in starts if s["length"] == length]] = True
                    spans += spans_of(flags, length)
                out["spans"].append(spans)
            return out

        return step

    return by_rows(found, f"c1 long, c2 long, x1 long, x2 long, spans {SPANS}", make_spans)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("body"))


def _cut(keyed: DataFrame, lengths: tuple[int, ...], with_text: bool, large: int) -> DataFrame:
    """key, n_removed, n_spans, digest of the texts that lose bytes, and the kept text where asked for.

    Of two ascending lengths the last one's strings are removed; those of the first are counted in n_repeated and n_passages.
    """
    core = core_of(lengths[0])
    spark, folders = keyed.sparkSession, {}

    def for_now(rows: DataFrame, name: str) -> DataFrame:
        folders[name] = new_folder(spark, name)
        return saved(rows, name, folders[name])

    def done(*names: str) -> None:
        """Remove tables after their last reader, so that they do not add up on disk."""
        discard(spark, *[folders.pop(name) for name in names])

    def make():
        def step(batch):
            out = {"key": batch["key"], "places": [], "cores": []}
            for data in batch["body"]:
                place = anchors(data, lengths[0])[0]
                out["places"].append(place)
                out["cores"].append([xxhash.xxh3_64_intdigest(data[p : p + core]) - (1 << 63) for p in place.tolist()])
            return out

        return step

    long_enough = keyed.where(F.octet_length("body") >= lengths[0])
    found = for_now(by_rows(long_enough.select("key", "body"), "key long, places array<int>, cores array<long>", make), "anchors")
    found = found.select("key", F.explode(F.arrays_zip("places", "cores")).alias("a")).select("key", "a.places", "a.cores")
    often = for_now(found.groupBy("cores").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cores"), "beginnings")
    places = for_now(found.join(often, "cores").groupBy("key").agg(F.collect_set("places").alias("places")), "places")
    done("anchors", "beginnings")
    # Texts without a repeated beginning stay where they are read.
    may, _ = parted(long_enough.select("key", "body"), F.col("key"), places.select("key"))
    texts = for_now(may.join(places, "key"), "repeating-texts")
    done("places")
    contexts = for_now(_contexts(texts, lengths), "contexts")

    names = ["c1", "c2", "x1", "x2"]
    # Bytes travel only for blocks that hold different contexts, of each context once.
    classes = contexts.groupBy(*names).agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "place")).alias("at"), *[F.first(c).alias(c) for c in ("nearest", "farthest", "ahead")]
    )
    classes = for_now(classes, "context-classes")
    blocks = classes.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("m"), F.min("times").alias("least"))
    blocks = for_now(blocks.where("m > 1 and least = 1").select("c1", "c2", "m"), "mixed-blocks")
    mixed_ = for_now(_with_bytes(classes.join(blocks, ["c1", "c2"]), texts, lengths), "mixed-contexts")
    spans = _refined(mixed_.where(F.col("m") <= large), lengths).union(_counted(mixed_.where(F.col("m") > large), lengths))
    # A context that occurs twice has all its windows repeated.
    whole = F.array(*[_all_windows(length, core) for length in lengths])
    whole = F.filter(whole, lambda s: s["end"] - s["start"] >= s["length"])
    whole = classes.where("times > 1").select(*names, whole.alias("spans"))
    once = classes.where("times = 1").select(*names)
    spans = for_now(spans.join(once, names, "left_semi").union(whole).where(F.size("spans") > 0), "spans")
    done("context-classes", "mixed-blocks", "mixed-contexts")

    covered = contexts.select("key", "place", *names).join(spans, names)
    covered = covered.select("key", F.explode("spans").alias("s"), "place")
    at = [(F.col("place") + F.col(f"s.{c}")).alias(c) for c in ("start", "end")]
    covered = covered.groupBy("key").agg(F.collect_set(F.struct("s.length", *at)).alias("spans"))

    def make_cut():
        def step(batch):
            out = {"key": batch["key"], "n_removed": [], "n_spans": [], "digest": []} | ({"kept": []} if with_text else {})
            out |= {"n_repeated": [], "n_passages": []} if lengths[1:] else {}
            for data, spans in zip(batch["body"], batch["spans"]):
                *shorter, runs = [removed(len(data), [(s["start"], s["end"]) for s in spans if s["length"] == length]) for length in lengths]
                edges = [0, *(x for run in runs for x in run), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out["n_removed"].append(len(data) - len(kept))
                out["n_spans"].append(len(runs))
                out["digest"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["kept"].append(kept.decode("utf-8", "replace"))
                for passages in shorter:
                    out["n_repeated"].append(sum(b - a for a, b in passages))
                    out["n_passages"].append(len(passages))
            return out

        return step

    ddl = "key long, n_removed long, n_spans long, digest string" + (", kept string" if with_text else "")
    ddl += ", n_repeated long, n_passages long" if lengths[1:] else ""
    cut = by_rows(texts.dropDuplicates(["key"]).select("key", "body").join(covered, "key"), ddl, make_cut)
    cut = saved(cut, "cut-texts")
    done(*list(folders))
    return cut


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE, passage: int | None = None
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `passage` also n_repeated, n_passages.

    Every byte is removed that a string of `length` bytes covers which also starts anywhere else, in the same text or
    another; strings overlap, and all are judged on the input. Texts are UTF-8 bytes and strings do not cross texts;
    n_spans counts the maximal removed runs. Null texts count as empty; texts shorter than `length` lose
    nothing; null ids and repeated rows stay, and rows repeated with their text are two texts with equal strings.
    Other columns are not read; an empty table gives an empty result. Beginnings and contexts are compared by
    128-bit fingerprints, the rounds between them by bytes.

    `passage` is a smaller number of bytes: n_repeated counts the bytes, n_passages the maximal runs, that strings of so
    many bytes cover which also start anywhere else. They tell of passages too short to be removed and change nothing else.
    """
    if passage is not None and passage >= length:
        raise ValueError(f"passages of {passage} bytes are not shorter than the strings to remove, of {length}")
    keyed = _keyed(docs, id_col, text_col)
    cut = _cut(keyed, (length,) if passage is None else (passage, length), False, large)
    # Texts without a repeat never leave the scan; only their size and digest are joined.
    rows = keyed.select("doc_id", "key", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("whole"))
    rows = rows.join(cut, "key", "left")
    count = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return rows.select(
        "doc_id",
        "n_bytes",
        count("n_removed"),
        count("n_spans"),
        F.coalesce("digest", "whole").alias("kept_sha256"),
        *([] if passage is None else [count("n_repeated"), count("n_passages")]),
    )


def replace_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """The rows of `docs` with all their columns, the text without the bytes that remove_repeats counts.

    A character that loses some of its bytes becomes U+FFFD. Texts that lose nothing stay as they are, null ones too.
    """
    cut = _cut(_keyed(docs, id_col, text_col), (length,), True, large).select("key", "kept")
    key = F.xxhash64(docs[id_col].cast("long"), text_or_empty(docs[text_col])).alias("key")
    may, rest = parted(docs.select(key, F.struct("*").alias("row")), F.col("key"), cut.select("key"))
    rows = may.join(cut, "key", "left").unionByName(rest.withColumn("kept", F.lit(None).cast("string")))
    text = F.coalesce(F.col("kept"), F.col("row")[text_col]).alias(text_col)
    return rows.select(*[text if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
