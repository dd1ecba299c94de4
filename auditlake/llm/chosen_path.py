"""Similarity join of texts by Jaccard of their word shingles, along chosen paths.

Every set chooses shingles at random, each by its own hash, so that a set of n shingles chooses about c / t of them
at threshold t. Sets that share a chosen shingle meet in a bucket; two sets above the threshold choose at least
c shingles together on average. A bucket that is too large splits again by other shingles of its members, which every
bucket chooses anew from a pool of each member's, unless one of these keeps more than half of it: such a bucket holds
copies of one another and is compared as it is, as are buckets at the last depth. Runs with new hashes are added until
pairs at the threshold meet with the target probability even if every bucket that they share splits at every depth. Buckets are
compared in blocks, first by small sketches and by which bucket a pair counts in, the largest one, then exactly, with the sets of
those members only that have a pair left. Copies share many large buckets; pairs that one larger bucket has are left out of the blocks
of the others.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import by_rows, documents_of, parted, saved
from auditlake.llm.links import BLOCK, by_group, components, in_blocks, reached
from auditlake.llm.shingles import WORDS, mixed, shingle_set

THRESHOLD = 0.8
RECALL = 0.9999  # of pairs at the threshold; more similar pairs meet more often
CHOSEN = 2.0  # shingles that a pair at the threshold chooses together in a run, on average
LARGE = 256  # members of a bucket that is compared without splitting
DEPTH = 3
ONWARD = 4.0  # shingles by which a pair at the threshold goes on together from a bucket that splits, on average
POOL = 40.0  # shingles of a pair at the threshold from which each bucket that splits chooses those, on average
POOLED = 1 << 32  # salt of the pool
BINS = 64  # of a sketch; each holds a byte of the smallest hash that falls into it, 0 where none does
BROADCAST = 500_000  # classes whose ids go to every task that reads texts, some 20 MB; more are joined by a shuffle
DEVIATIONS = 8  # by which the share of equal bins may fall below the threshold for a pair that is compared exactly


def alike(threshold: float) -> float:
    """Share of equal bins from which a pair is compared exactly; 0 for all pairs."""
    return max(0.0, threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / BINS))


def missed(shared: float, splits: int = DEPTH - 1) -> float:
    """Probability that a pair at the threshold meets in no bucket that is compared.

    It shares this many buckets on average, all of them split this many times, and its pool is as small as chance
    makes it: a pool of n sends it on by n * ONWARD / POOL shingles on average, in each bucket anew. With Poisson's
    numbers in place of binomial ones, which are less often small.
    """
    total, chance = 0.0, math.exp(-POOL)
    for n in range(1, int(4 * POOL)):
        lost = 0.0  # probability that a bucket with the pair ends without it
        for _ in range(splits):
            lost = math.exp(-(n - 1) * ONWARD / POOL * (1 - lost))
        total += chance * math.exp(-shared * (1 - lost))
        chance *= POOL / n
    return total


def runs_for(recall: float, chosen: float = CHOSEN, splits: int = DEPTH - 1) -> int:
    """Runs after which a pair at the threshold has met with this probability, whatever splits."""
    runs = max(1, math.ceil(-math.log(1 - recall) / chosen))
    while missed(runs * chosen, splits) > 1 - recall:
        runs += 1
        if runs > 1000:
            raise ValueError(f"the pool is too small for a recall of {recall}")
    return runs


def chosen(tokens: np.ndarray, size: int, salt: int, share: float) -> np.ndarray:
    """The tokens whose hash under a salt falls below share / size."""
    if share >= size:
        return tokens
    limit = np.uint64(int(share / size * 2**64))
    return tokens[mixed(tokens ^ mixed(np.array([salt], np.uint64))) < limit]


def sketch(tokens: np.ndarray) -> bytes:
    """One-permutation sketch: of each sixty-fourth of the hashes a byte of the smallest one."""
    hashes = np.sort(mixed(tokens ^ np.uint64(0x9E3779B97F4A7C15)))
    part = (hashes >> np.uint64(58)).astype(int)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    out = np.zeros(BINS, np.uint8)
    out[part[first]] = 1 + (hashes[first] >> np.uint64(20)) % np.uint64(255)
    return out.tobytes()


def _described(docs: DataFrame, words: int, threshold: float, runs: int) -> DataFrame:
    """Identity of each text's set, its size, the shingles it chooses in any run, and its pool for splits."""

    def make():
        def step(rows):
            out = {"doc_id": rows["doc_id"], "high": [], "low": [], "size": [], "first": [], "pool": [], "sketch": []}
            for text in rows["text"]:
                tokens = shingle_set(text, words)
                whole = xxhash.xxh3_128_intdigest(tokens.tobytes())
                out["high"].append((whole >> 64) - (1 << 63))
                out["low"].append((whole & ((1 << 64) - 1)) - (1 << 63))
                out["size"].append(len(tokens))
                out["sketch"].append(sketch(tokens))
                picks = [chosen(tokens, len(tokens), run, CHOSEN / threshold) for run in range(runs)] if len(tokens) else []
                out["first"].append(np.unique(np.concatenate(picks)).view(np.int64) if picks else np.empty(0, np.int64))
                out["pool"].append(chosen(tokens, len(tokens), POOLED, POOL / threshold).view(np.int64))
            return out

        return step

    return by_rows(docs, "doc_id long, high long, low long, size long, first array<long>, pool array<long>, sketch binary", make)


def _bucketed(members: DataFrame, large: int) -> DataFrame:
    """Sizes of the buckets with at least two members.

    Of buckets with the same members that are compared as they are, one stays. Large ones all stay: each splits by
    other shingles, and a pair that one of them parts meets in another.
    """
    who = [F.sum(F.xxhash64("id", F.lit(i)) % (1 << 40)).alias(f"who{i}") for i in range(2)]
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *who).where("n > 1")
    again = F.when(F.col("n") > large, F.col("bucket"))
    return sizes.groupBy("n", "who0", "who1", again.alias("own")).agg(F.min("bucket").alias("bucket")).select("bucket", "n")


def _onward(threshold: float, level: int):
    """Shingles by which a member goes on from a bucket whose path has `level` of them.

    Of its pool without the path, those whose hash with the bucket falls below a share. The share falls with the size,
    so that a pair goes on by what the larger one's share leaves, ONWARD on average; small sets go on by all.
    """
    left = F.least(F.lit(POOL), threshold * F.col("size")) - level
    share = F.when(left <= ONWARD, 1.0).otherwise(ONWARD / left) * (1 << 20)
    pool = F.array_except("pool", "path")
    onward = F.filter(pool, lambda t: F.pmod(F.xxhash64("bucket", t), F.lit(1 << 20)) < share)
    if level * (1 - threshold) < threshold:
        return onward
    # Sets so small that a similar one may share nothing beyond the path stay together.
    return F.when(threshold * F.col("size") <= level, F.array_append(onward, F.lit(0).cast("long"))).otherwise(onward)


def _mostly(per_child: DataFrame, parent: str) -> DataFrame:
    """The buckets of which a child has most of the members."""
    return per_child.groupBy(parent).agg(F.max(F.col("m") / F.col("n")).alias("most")).where("most > 0.5").select(parent)


def _split(members: DataFrame, sizes: DataFrame, classes: DataFrame, depth: int, large: int, threshold: float, level: int = 1) -> DataFrame:
    """Members (bucket, id) of the buckets that are compared, after splitting large ones.

    `members` has the path of a bucket, the `level` shingles chosen so far.
    """
    kept = members.join(sizes.where(F.col("n") <= large).select("bucket"), "bucket").select("bucket", "id")
    big = members.join(sizes.where(F.col("n") > large), "bucket")
    if depth == 0:
        return kept.union(big.select("bucket", "id"))
    big = big.join(classes.select("id", "size", "pool"), "id").select("bucket", "id", "path", "n", _onward(threshold, level).alias("onward"))
    big = saved(big, "large-buckets")
    if not big.take(1):
        return kept
    # A child that keeps most of its parent says that splitting does not help. Where most members are alike, most have one
    # shingle that hashes least among those they go on by, and the bucket is known before its children are made.
    least = F.array_min(F.transform("onward", lambda t: F.xxhash64("bucket", t)))
    per_child = big.groupBy("bucket", "n", least.alias("least")).agg(F.count(F.lit(1)).alias("m")).where("least is not null")
    alike_ = saved(_mostly(per_child, "bucket"), "alike-buckets")
    onward = F.explode("onward").alias("t")
    children = big.join(F.broadcast(alike_), "bucket", "left_anti").select("id", "path", "n", F.col("bucket").alias("parent"), onward)
    children = saved(children.select("id", "parent", "n", F.xxhash64("parent", "t").alias("bucket"), F.array_append("path", F.col("t")).alias("path")), "child-buckets")
    per_child = children.groupBy("parent", "n", "bucket").agg(F.count(F.lit(1)).alias("m"))
    whole = saved(_mostly(per_child, "parent"), "whole-buckets")
    kept = kept.union(big.join(alike_.union(whole.withColumnRenamed("parent", "bucket")), "bucket").select("bucket", "id"))
    below = saved(children.join(whole, "parent", "left_anti").select("bucket", "id", "path"), "buckets-below")
    return kept.union(_split(below, saved(_bucketed(below, large), "bucket-sizes"), classes, depth - 1, large, threshold, level + 1))


def _own_pairs(group, threshold: float) -> np.ndarray:
    """The pairs of the group's two blocks that count in this bucket, as a matrix: none numbered before it holds both."""
    bucket, left, right = (group[k][0].as_py() for k in ("bucket", "left", "right"))
    ids, side, size = (group[k].to_numpy() for k in ("id", "side", "size"))
    pairs = (side == left)[:, None] & (side == right)[None, :]
    pairs = np.triu(pairs, 1) if left == right else pairs
    pairs &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :])
    own = group["buckets"].combine_chunks()
    numbers, owner = own.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(own.offsets.to_numpy()))
    before = numbers < bucket
    if before.any():
        known, column = np.unique(numbers[before], return_inverse=True)
        member = np.zeros((len(ids), len(known)), np.float32)
        member[owner[before], column] = 1
        pairs &= ~(member @ member.T > 0)
    return pairs


def _candidates(threshold: float):
    """Members of a pair of blocks that have a pair which counts here and whose sketches are alike."""

    def compare(group):
        if group.num_rows < 2:
            return None
        pairs = _own_pairs(group, threshold)
        if not pairs.any():
            return None
        some = np.flatnonzero(pairs.any(0) | pairs.any(1))
        pairs = pairs[np.ix_(some, some)]
        sketches = np.frombuffer(b"".join(group["sketch"].combine_chunks().take(some).to_pylist()), np.uint8).reshape(len(some), BINS)
        equal = np.zeros(pairs.shape, np.uint8)
        for column in sketches.T:
            equal += (column[:, None] == column[None, :]) & (column > 0)[:, None]
        empty = (sketches == 0).astype(np.float32)
        pairs &= equal >= alike(threshold) * (BINS - empty @ empty.T) - 1e-9
        at = some[pairs.any(0) | pairs.any(1)]
        return {k: group[k].to_numpy()[at] for k in ("bucket", "left", "right", "side", "id")} if len(at) else None

    return compare


def _compare(threshold: float):
    """Comparison of the members of a pair of blocks: links counted in the first bucket that a pair shares."""

    def shared_counts(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
        column = np.cumsum(new) - 1
        often = np.bincount(column) > 1  # a token of one member is shared by no pair
        number = np.cumsum(often) - 1
        keep = often[column]
        column, owner = number[column[keep]], owner[keep]
        shared = np.zeros((len(lengths), len(lengths)), np.float64)
        width = 4096
        cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + width + 1, width))
        for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                dense = np.zeros((len(lengths), width), np.float32)
                dense[owner[a:b], column[a:b] - part * width] = 1
                shared += dense @ dense.T
        return shared

    def compare(group):
        # Rows repeated with an id and a set come several times.
        group = group.take(np.unique(group["id"].to_numpy(), return_index=True)[1])
        ids, weight, size = (group[k].to_numpy() for k in ("id", "weight", "size"))
        pairs = _own_pairs(group, threshold)
        if not pairs.any():
            return None
        some = np.flatnonzero(pairs.any(0) | pairs.any(1))
        tokens = group["tokens"].combine_chunks().take(some)
        shared = shared_counts(tokens.flatten().to_numpy(), np.diff(tokens.offsets.to_numpy()))
        pairs, size, ids, weight = pairs[np.ix_(some, some)], size[some], ids[some], weight[some]
        linked = pairs & (shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9)
        linked |= linked.T
        at = np.flatnonzero(linked.any(1))
        if not len(at):
            return None
        linked, ids = linked[np.ix_(at, at)], ids[at]
        return {"id": ids, "links": linked @ weight[at], "low": reached(linked, ids)}

    return compare


def similar_texts(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
    large: int = LARGE,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per id: doc_id, class_id, n_links.

    Texts are sets of runs of `words` words, words being cut at ASCII white space; a shorter text is one run. Two
    documents are linked when the Jaccard similarity of their sets is at least `threshold`; n_links counts the other
    documents linked directly, class_id is the smallest id reachable by links. Null and empty texts have no run and
    are linked to nothing, not to each other either. Rows without an id are left out, as they cannot be named; rows
    repeated with one id and one set count once, and an id with several sets has the links of all. Other columns are
    not read; an empty table gives an empty result. Documents of one set are one member with their number as weight.
    No link is reported that is not there; pairs at the threshold are found with probability `recall` or more.
    """
    docs = documents_of(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    described = saved(_described(docs, words, threshold, runs_for(recall, splits=depth - 1)), "described")
    members = described.select("doc_id", "high", "low", "size").distinct()
    first = described.where("size > 0").groupBy("high", "low", "size").agg(F.min("doc_id").alias("id"), F.countDistinct("doc_id").alias("weight"), F.first("first").alias("first"), F.first("pool").alias("pool"), F.first("sketch").alias("sketch"))
    classes = saved(first, "set-classes")
    buckets = classes.select("id", F.explode("first").alias("bucket"))
    sizes = saved(_bucketed(buckets, large), "bucket-sizes")
    buckets = buckets.join(sizes.select("bucket"), "bucket").select("bucket", "id", F.array("bucket").alias("path"))
    compared = saved(_split(saved(buckets, "buckets"), sizes, classes, depth - 1, large, threshold).distinct(), "compared-buckets")
    links = saved(_links(docs, compared, classes, threshold, words), "links")

    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    reach = components(links.where("low <> id").select(F.col("id").alias("a"), F.col("low").alias("b")))
    # What a class knows comes together first, so that a class of very many documents is joined once and can be split.
    known = classes.select("high", "low", "size", "id", "weight").join(counts, "id", "left")
    known = saved(known.join(reach.select(F.col("node").alias("id"), "component"), "id", "left"), "class-links")
    found = members.join(known, ["high", "low", "size"], "left").select(
        "doc_id",
        F.coalesce("component", "id", "doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"),
    )
    return found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").cast("long").alias("n_links"))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, weight, size, tokens of the classes in `wanted`; their texts are read again, the others' sets are not kept."""

    def make():
        def step(rows):
            out = {"id": [], "weight": [], "size": [], "tokens": []}
            for i, text in enumerate(rows["text"]):
                tokens = shingle_set(text, words)
                whole = xxhash.xxh3_128_intdigest(tokens.tobytes())
                if ((whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)) == (rows["high"][i], rows["low"][i]):
                    out["id"].append(rows["id"][i])
                    out["weight"].append(rows["weight"][i])
                    out["size"].append(len(tokens))
                    out["tokens"].append(tokens.view(np.int64))
            return out

        return step

    rows = docs.withColumnRenamed("doc_id", "id").join(wanted, "id").select("id", "weight", "high", "low", "text")
    return by_rows(rows, "id long, weight long, size long, tokens array<long>", make)


def _numbered(sizes: DataFrame) -> DataFrame:
    """`sizes` (bucket, n) with the number of each bucket: those beyond a block come first, the largest one first."""
    large = -F.least("n", F.lit((1 << 21) - 1)) * (1 << 41) + F.pmod("bucket", F.lit(1 << 41))
    return sizes.withColumn("number", F.when(F.col("n") > BLOCK, large).otherwise(F.pmod("bucket", F.lit(1 << 62))))


def _paired_before(members: DataFrame) -> DataFrame:
    """bucket, before, m of buckets beyond a block: the first bucket of so many members that they are paired in already."""
    firsts = members.where((F.col("n") > BLOCK) & (F.col("first") < F.col("bucket"))).groupBy("bucket", "first").agg(F.count(F.lit(1)).alias("m"))
    return firsts.groupBy("bucket").agg(F.max_by("first", F.struct("m", "first")).alias("before"), F.max("m").alias("m"))


def _links(docs: DataFrame, compared: DataFrame, classes: DataFrame, threshold: float, words: int) -> DataFrame:
    """id, links, low: for members of a bucket the documents linked there, and the smallest member reached."""
    keys = ["bucket", "left", "right"]
    sizes = saved(_numbered(compared.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")), "compared-sizes")
    numbered = saved(compared.join(sizes, "bucket").select(F.col("number").alias("bucket"), "n", "id"), "numbered-buckets")
    own = saved(numbered.groupBy("id").agg(F.array_sort(F.collect_list("bucket")).alias("buckets")), "own-buckets")
    members = own.join(classes.select("id", "size", "sketch"), "id").withColumn("first", F.col("buckets")[0])
    members = saved(numbered.join(members, "id"), "bucket-members")
    sizes = sizes.select(F.col("number").alias("bucket"), "n").join(F.broadcast(saved(_paired_before(members), "paired-before")), "bucket", "left")
    rows = in_blocks(members.drop("n"), sizes)
    left = by_group(rows, keys, "bucket long, left int, right int, side int, id long", _candidates(threshold))
    left = saved(left, "candidates")
    wanted = left.select("id").distinct().join(classes.select("id", "weight", "high", "low"), "id")
    wanted = saved(wanted, "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    sets = saved(_sets(docs, wanted, words), "sets")
    rows = left.join(own, "id").join(sets, "id")
    return by_group(rows, keys, "id long, links long, low long", _compare(threshold))


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with all their columns, but of each class of similar texts only that with the smallest id.

    Of rows with one id a single row stays; rows without an id cannot be named and all stay.
    """
    classes = saved(similar_texts(docs, threshold, id_col=id_col, text_col=text_col), "classes")
    # Any other column may have the name of ours, so the id is compared under a name of its own.
    others = classes.where("class_id <> doc_id").select(F.col("doc_id").alias("_other"))
    # Only rows that may go are shuffled, not every text.
    may, rest = parted(docs, docs[id_col].cast("long"), others)
    kept = may.join(others, may[id_col].cast("long") == F.col("_other"), "left_anti").union(rest)
    again = saved(kept.select(kept[id_col].alias("_again")).groupBy("_again").count().where("count > 1 and _again is not null").select("_again"), "repeated-ids")
    if not again.take(1):
        return kept
    repeated = kept.join(again, kept[id_col] == F.col("_again"), "left_semi").dropDuplicates([id_col])
    return kept.join(again, kept[id_col] == F.col("_again"), "left_anti").union(repeated)
