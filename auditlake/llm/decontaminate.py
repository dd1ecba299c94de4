"""Benchmark decontamination: rare n-gram seeds, then local alignment of the passages they point to.

Word n-grams of test items are looked for in every text. A bit table of fixed size, made from the items' n-grams, lets
the scan pass on only texts and places that may hold one; a join then says which. The places of an item in a text, from
the rarest n-gram in the corpus to the commonest, make windows, and Smith-Waterman alignment of words scores each window,
so that passages with replaced, dropped or added words still count: for a share of the item, or for the length of what
is held of a long one.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import by_rows, documents_of, saved
from auditlake.llm.licenses import words_of
from auditlake.llm.shingles import mixed, word_hashes

SEED = 4  # words of a seed; an item of fewer words is one seed
BITS = 26  # the scan's bit table has 2 ** BITS bits, 8 MB
THRESHOLD = 0.5
RUN = 13  # words; a passage that scores as so many in a row counts whatever the item's length
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of `size` words, in order."""
    n = len(hashes) - size + 1
    if size < 1 or n < 1:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = mixed(total + hashes[k : k + n])
    return total


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two word sequences, and the place in the window after its last word."""
    places = np.arange(len(window) + 1) * -GAP
    row, best, end = np.zeros(len(window) + 1), 0.0, 0
    for word in item:
        step = np.zeros(len(window) + 1)
        step[1:] = np.maximum(row[:-1] + np.where(window == word, MATCH, MISMATCH), 0)
        step = np.maximum(step, row + GAP)
        # A gap in the item: the best earlier place of the row, less the words between.
        row = np.maximum.accumulate(step + places) - places
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
    return best, end


def best_passage(item: np.ndarray, words: np.ndarray, diagonals: list[int]) -> tuple[float, int, int]:
    """(score from 0 to 1, first word, word after the last) of the best passage near the diagonals, rarest first."""
    pad, windows = max(8, len(item) // 2), []
    for diagonal in diagonals:
        if not any(a <= diagonal - pad // 2 and diagonal + len(item) + pad // 2 <= b for a, b in windows):
            windows.append((diagonal - pad, diagonal + len(item) + pad))
    best = (0.0, 0, 0)
    for a, b in windows:
        a, b = max(0, a), min(len(words), b)
        score, end = align(item, words[a:b])
        if score > best[0]:
            back, length = align(item[::-1], words[a : a + end][::-1])
            best = (score, a + end - length, a + end)
    return best[0] / (MATCH * len(item)), best[1], best[2]


def _seeds(items: DataFrame, size: int) -> DataFrame:
    """item_id, seed, place of every n-gram, and the item's words."""

    def make():
        def step(rows):
            out = {"item_id": [], "words": [], "seeds": [], "size": []}
            for item_id, text in zip(rows["doc_id"], rows["text"]):
                hashes = word_hashes(words_of(text))
                if item_id is not None and len(hashes):
                    out["item_id"].append(item_id)
                    out["words"].append(hashes.view(np.int64))
                    out["size"].append(min(size, len(hashes)))
                    out["seeds"].append(grams(hashes, min(size, len(hashes))).view(np.int64))
            return out

        return step

    return by_rows(items, "item_id long, words array<long>, seeds array<long>, size int", make).dropDuplicates(["item_id", "words"])


def _bit_table(seeds: DataFrame, bits: int) -> np.ndarray:
    """One bit for each seed's leading bits; at most 2 ** (bits - 6) numbers come to the driver."""
    slot = F.shiftrightunsigned("seed", 64 - bits)
    rows = seeds.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(seed, " + str(64 - bits) + ") & 63 as int))")).alias("bits"))
    table = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    found = rows.toArrow()
    table[found["at"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    seed_words: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    bits: int = BITS,
    run_words: int = RUN,
) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, score, first_word, end_word, rarest.

    Words are lower-cased runs of letters, digits and characters outside ASCII. The score is that of the best local
    alignment (match 2, mismatch and gap -1) against the score of the whole item; rows have `threshold` or more, or
    hold a part of a longer item that scores as `run_words` of its words in a row, with edits as many more. The words
    of the passage run from first_word up to end_word; rarest is the number of places of its rarest seed in the corpus. A
    passage is found if it holds a run of `seed_words` words of the item (the whole of a shorter item). Null and
    empty texts and items give nothing; rows or items without an id cannot be named and are left out; repeated rows
    give one result for each id and item, the best. Other columns are not read; an empty table on either side gives an
    empty result. No seed is dropped for being common, and no candidate for being one of many.
    """
    docs, items = documents_of(docs, id_col, text_col), documents_of(items, item_id_col, item_text_col)
    items = saved(_seeds(items, seed_words), "items")
    seeds = items.select("item_id", "words", "size", F.posexplode("seeds").alias("place", "seed"))
    table = _bit_table(seeds.select("seed"), bits)
    sizes = [r.size_ for r in items.select(F.col("size").alias("size_")).distinct().collect()]  # at most seed_words numbers

    def find():
        part, seen = TaskContext.get().partitionId() << 40, [0]

        def step(rows):
            out = {"row": [], "doc_id": [], "text": [], "hits": []}
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                seen[0] += 1
                if doc_id is None:
                    continue
                hashes, hits = word_hashes(words_of(text)), []
                for size in sizes:
                    found = grams(hashes, size)
                    slot = found >> np.uint64(64 - bits)
                    at = np.flatnonzero((table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                    hits += [{"seed": s, "at": p} for s, p in zip(found[at].view(np.int64).tolist(), at.tolist())]
                if hits:
                    for name, value in (("row", part + seen[0]), ("doc_id", doc_id), ("text", text), ("hits", hits)):
                        out[name].append(value)
            return out

        return step

    hit = saved(by_rows(docs, "row long, doc_id long, text string, hits array<struct<seed: long, at: int>>", find), "seed-hits")
    places = hit.select("row", F.explode("hits").alias("h")).select("row", "h.seed", "h.at")
    known = seeds.select("seed", "item_id", "place")
    common = places.join(known.select("seed").distinct(), "seed", "left_semi").groupBy("seed").agg(F.count(F.lit(1)).alias("common"))
    known = saved(known.join(common, "seed"), "seeds")
    diagonals = places.join(known, "seed").groupBy("row", "item_id", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.min("common").alias("common"))
    pairs = diagonals.groupBy("row", "item_id").agg(F.array_sort(F.collect_list(F.struct("common", "diagonal"))).alias("diagonals"))
    pairs = pairs.join(items.select("item_id", "words"), "item_id")
    of_row = saved(pairs.groupBy("row").agg(F.collect_list(F.struct("item_id", "words", "diagonals")).alias("pairs")), "candidates")

    def score():
        def step(rows):
            names = ("doc_id", "item_id", "score", "first_word", "end_word", "rarest")
            out = {name: [] for name in names}
            for doc_id, text, pairs in zip(rows["doc_id"], rows["text"], rows["pairs"]):
                words = word_hashes(words_of(text)).view(np.int64)
                for pair in pairs:
                    item = np.array(pair["words"], np.int64)
                    share, first, end = best_passage(item, words, [d["diagonal"] for d in pair["diagonals"]])
                    if share >= threshold or share * len(item) >= run_words - 1e-9:
                        values = (doc_id, pair["item_id"], share, first, end, pair["diagonals"][0]["common"])
                        for name, value in zip(names, values):
                            out[name].append(value)
            return out

        return step

    ddl = "doc_id long, item_id long, score double, first_word long, end_word long, rarest long"
    found = by_rows(hit.select("row", "doc_id", "text").join(of_row, "row").select("doc_id", "text", "pairs"), ddl, score)
    best = F.max_by(F.struct("score", "first_word", "end_word", "rarest"), F.struct("score", -F.col("first_word"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no test item; rows without an id are not searched and stay."""
    found = contaminated(docs, items, threshold, id_col=id_col, text_col=text_col)
    leaks = saved(found.select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, docs[id_col].cast("long") == F.col("_leak"), "left_anti")
