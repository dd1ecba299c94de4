import hashlib
import random
from collections import Counter
from string import ascii_lowercase

import numpy as np
import pytest
from corpus import documents, edge_texts, texts
from pyspark.sql import functions as F

from auditlake.llm import chosen_path, common, decontaminate, hamming, links, queries, repeats

# components


def plain_components(edges):
    low = {x: x for e in edges for x in e}
    while True:
        new = dict(low)
        for a, b in edges:
            m = min(new[a], new[b])
            new[a] = new[b] = m
        if new == low:
            return low
        low = new


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(9, i) for i in range(30)], [(1, 5), (5, 6), (2, 6), (8, 8), (8, 9), (9, 8)], []])
def test_components(spark, edges):
    rows = links.components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == plain_components(edges)


# chosen path


def shingle_set(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_join(given, threshold=0.8):
    sets = [shingle_set(t) for t in given]
    pairs = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9
    ]
    n = Counter(x for p in pairs for x in p)
    low = plain_components(pairs)
    return [(i, low.get(i, i), n[i]) for i in range(len(given))]


@pytest.mark.parametrize("large,depth", [(256, 3), (4, 3), (4, 1), (2, 2)])
def test_join_is_that_of_all_pairs(spark, large, depth):
    given = texts() + edge_texts()
    rows = chosen_path.similar_texts(documents(spark, given), large=large, depth=depth).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == plain_join(given)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 7)
    original = links.in_blocks
    monkeypatch.setattr(chosen_path, "in_blocks", lambda members, sizes: original(members, sizes, 7))
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    given = []
    for _ in range(60):
        own = list(base)
        own[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        given.append(" ".join(own))
    given += given[:10]
    rows = chosen_path.similar_texts(documents(spark, given), large=8).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == plain_join(given)


def test_pairs_of_copies_are_compared_in_one_of_their_buckets(spark, monkeypatch):
    made, original, kept = {}, links.in_blocks, chosen_path.saved

    def in_blocks(members, sizes):
        rows = original(members, sizes, 16)
        made["blocks"] = rows.count()
        return rows

    def saved(rows, name, *folder):
        out = kept(rows, name, *folder)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(chosen_path, "BLOCK", 16, raising=False)
    monkeypatch.setattr(chosen_path, "in_blocks", in_blocks)
    monkeypatch.setattr(chosen_path, "saved", saved)
    rng = random.Random(23)
    given = []
    for _ in range(160):
        own = [f"w{i}" for i in range(120)]
        own[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        given.append(" ".join(own))
    given += texts()
    rows = chosen_path.similar_texts(documents(spark, given), large=24).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == plain_join(given)
    # Ten blocks of the largest bucket meet; the nine others of the copies have few pairs of their own.
    assert made["blocks"] < 160 * 10 * 4
    assert made["child-buckets"] < made["large-buckets"]


def test_runs_reach_the_recall():
    assert chosen_path.runs_for(0.9999) * chosen_path.CHOSEN >= 9.2


def test_runs_reach_the_recall_after_all_splits():
    for recall in (0.99, 0.999, 0.9999):
        for splits in (0, 1, 2, 5):
            assert chosen_path.missed(chosen_path.runs_for(recall, splits=splits) * chosen_path.CHOSEN, splits) <= 1 - recall


def test_pairs_of_frequent_passages_meet_after_splits(spark):
    # Every passage is in a fifth of the texts, so nearly all shared buckets hold far more than 16 and none is whole.
    rng = random.Random(17)
    passages = [[f"f{p}x{i}" for i in range(70)] for p in range(60)]
    given = []
    for _ in range(500):
        own = [passages[p] for p in rng.sample(range(60), 12)]
        near = [list(p) for p in own]
        for p in rng.sample(range(24), 15):
            near[p % 12][20 + p // 12 * 20] = f"e{rng.randrange(10**9)}"
        del near[rng.randrange(12)][50:]
        given += [" ".join(w for p in text for w in p) for text in (own, near)]
    sets = [shingle_set(t) for t in given]
    pairs = [i for i in range(0, len(sets), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(pairs) > 400
    found = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.similar_texts(documents(spark, given), large=16).collect()}
    assert [i for i in pairs if found[i + 1] != (i, 1)] == []


def test_pairs_at_a_lower_threshold_pass_the_sketches(spark):
    rng = random.Random(5)
    given = []
    for i in range(300):
        own = [f"s{i}x{k}" for k in range(300)]
        given += [" ".join(own), " ".join(own[:204] + [f"t{rng.randrange(10**9)}" for _ in range(96)])]
    rows = chosen_path.similar_texts(documents(spark, given), threshold=0.5).collect()
    assert sorted(r.doc_id for r in rows if r.n_links != 1) == []


def test_join_of_odd_rows(spark):
    docs = documents(spark, ["a b c", "a b c", "a b c", None, "", "a b c"], [1, 1, 2, 3, 4, None])
    rows = chosen_path.similar_texts(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]
    assert chosen_path.similar_texts(documents(spark, [])).count() == 0
    kept = chosen_path.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0 for r in kept.collect())) == [0, 1, 3, 4]


def test_rows_are_parted_by_keys(spark):
    rows = spark.createDataFrame([(i - 50,) for i in range(20_000)] + [(None,)], "id long")
    keys = spark.createDataFrame([(7 * i - 70,) for i in range(500)] + [(None,)], "k long")
    may, rest = common.parted(rows, F.col("id"), keys)
    wanted = {7 * i - 70 for i in range(500)} & {r.id for r in rows.collect()}
    assert may.columns == rest.columns == ["id"] and may.count() + rest.count() == rows.count()
    assert wanted <= {r.id for r in may.collect()} and may.count() < len(wanted) + 20
    may, rest = common.parted(rows, F.col("id"), keys.limit(0))
    assert (may.count(), rest.count()) == (0, rows.count())


@pytest.mark.parametrize("cut", [chosen_path.keep_one_of_each, repeats.replace_repeats])
def test_texts_that_stay_as_they_are_are_not_shuffled(spark, monkeypatch, cut):
    # Every exchange that is planned with the text has been narrowed to rows that may change.
    seen = []
    for module in (chosen_path, repeats):
        original = common.parted
        monkeypatch.setattr(module, "parted", lambda *a: seen.append(original(*a)) or seen[-1], raising=False)
    given = texts(n=24)
    docs = documents(spark, given + [given[0] + " " + " ".join(f"own{i}" for i in range(400))])
    result = cut(docs)
    assert result.columns == docs.columns and result.count() >= 24
    assert seen and seen[-1][1].count() > 0 and seen[-1][0].count() + seen[-1][1].count() == docs.count()


# repeats


def plain_repeats(given, length):
    data = [(t or "").encode() for t in given]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        covered = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = [True] * length
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(c and not p for c, p in zip(covered, [False, *covered]))
        out.append((len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [40, 100, 400])
@pytest.mark.parametrize("large", [repeats.LARGE, 1])
def test_repeats_are_those_of_all_windows(spark, length, large):
    given = texts(n=24) + edge_texts() + ["abcab" * 300, "is " * 400 + "end", "ab" * 250]
    rows = repeats.remove_repeats(documents(spark, given).repartition(4), length, large=large).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == plain_repeats(given, length)


@pytest.mark.parametrize("length, passage", [(100, 40), (400, 240)])
@pytest.mark.parametrize("large", [repeats.LARGE, 1])
def test_shorter_passages_are_counted_beside_what_is_removed(spark, length, passage, large):
    given = texts(n=24) + edge_texts() + ["abcab" * 300, "is " * 400 + "end", "ab" * 250, "xy" * 130]
    given += [t[: len(t) - 150] for t in given if t and len(t) > 600][:6]
    rows = repeats.remove_repeats(documents(spark, given).repartition(4), length, large=large, passage=passage).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in rows] == plain_repeats(given, length)
    assert [(r.n_repeated, r.n_passages) for r in rows] == [t[1:3] for t in plain_repeats(given, passage)]
    with pytest.raises(ValueError):
        repeats.remove_repeats(documents(spark, given), length, passage=length)


def test_op4_tells_texts_that_share_a_passage_of_over_fifty_words(spark, tmp_path):
    rng = random.Random(3)
    own = lambda n: " ".join("".join(rng.choice(ascii_lowercase) for _ in range(rng.randrange(2, 8))) for _ in range(n))
    passages = [own(n) for n in (51, 55, 60) for _ in range(4)]
    assert all(repeats.PASSAGE <= len(p) < 400 for p in passages)
    given = [f"{own(80)} {p} {own(80)}" for p in passages for _ in range(2)] + [own(200) for _ in range(24)]
    documents(spark, given).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op4_repeated_strings(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in rows] == plain_repeats(given, 400)
    assert [r.n_repeated > 0 for r in rows] == [i < 24 for i in range(48)]
    assert [r.n_passages for r in rows] == [int(i < 24) for i in range(48)]


def test_rounds_agree_with_comparing_contexts():
    rng = np.random.default_rng(2)
    rows, rounds = 60, 9
    group = np.sort(rng.integers(0, 6, rows))
    left, right = rng.integers(0, 2, (rows, rounds)), rng.integers(0, 2, (rows, rounds))
    nearest, farthest, times = rng.integers(0, 4, rows), rng.integers(4, 10, rows), np.ones(rows, int)
    got = repeats.refine(group, left, right, nearest, farthest, times)
    for d in range(rounds + 1):
        keys = {i: (group[i], *left[i, :d], "|", *right[i, : rounds - d]) for i in range(rows) if nearest[i] <= d <= farthest[i]}
        n = Counter(keys.values())
        assert [bool(x) for x in got[:, d]] == [i in keys and n[keys[i]] > 1 for i in range(rows)]


def test_repeats_of_odd_rows(spark):
    long_text = "z9 " * 10 + "".join(chr(97 + i * 7 % 26) + str(i) for i in range(300))
    docs = documents(spark, [long_text, long_text, long_text, None, "x"], [1, 1, None, 2, 3])
    rows = sorted(repeats.remove_repeats(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_bytes))
    assert [(r.doc_id, r.n_removed, r.n_spans) for r in rows] == [(None, len(long_text), 1), (1, len(long_text), 1), (1, len(long_text), 1), (2, 0, 0), (3, 0, 0)]
    assert repeats.remove_repeats(documents(spark, [])).count() == 0
    cut = repeats.replace_repeats(docs)
    assert cut.columns == docs.columns and sorted("null" if r.text is None else r.text for r in cut.collect()) == ["", "", "", "null", "x"]
    with pytest.raises(ValueError):
        repeats.reach_of(10)


# decontamination


def plain_alignment(item, words):
    best, row = 0.0, [0.0] * (len(words) + 1)
    for a in item:
        new = [0.0]
        for j, b in enumerate(words):
            new.append(max(0.0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 1))
            best = max(best, new[-1])
        row = new
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(5)
    for _ in range(200):
        item, words = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 25))
        assert decontaminate.align(item, words)[0] == plain_alignment(item, words)


def test_exact_edited_and_clean_documents(spark):
    rng = random.Random(9)
    item = [f"q{i}" for i in range(40)]
    prose = lambda n: [f"p{rng.randrange(3000)}" for _ in range(n)]
    edited = list(item)
    for i in (5, 14, 23, 31):
        edited[i] = "other"
    del edited[18]
    given = [
        " ".join(prose(100) + item + prose(30)),
        " ".join(prose(20) + edited + prose(50)).upper(),
        " ".join(prose(150)),
        " ".join(prose(40) + item[:6] + prose(40)),
        "tiny item",
        None,
        "",
    ]
    items = spark.createDataFrame([(7, " ".join(item)), (8, "Tiny, item!"), (9, None), (10, ""), (None, "p1 p2 p3 p4")], "item_id long, text string")
    rows = decontaminate.contaminated(documents(spark, given), items, bits=12).orderBy("doc_id", "item_id").collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(0, 7), (1, 7), (4, 8)]
    assert rows[0].score == 1 and (rows[0].first_word, rows[0].end_word) == (100, 140) and 0.6 < rows[1].score < 1
    clean = decontaminate.keep_clean(documents(spark, given, [0, 1, 2, 3, None, 5, 6]), items)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in clean.collect()) == [-1, 2, 3, 5, 6]


def test_parts_of_long_items_count_by_their_length(spark):
    rng = random.Random(21)
    common = [f"c{i}" for i in range(60)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else f"p{rng.randrange(4000)}" for _ in range(n)]
    long, longer = [[rng.choice(common) if i % 3 == 0 else f"{name}{i}" for i in range(n)] for name, n in (("l", 100), ("m", 300))]
    edited = longer[100:200]
    for i in range(9, 100, 10):
        edited[i] = "other"
    parts = [long[30:79], longer[:140], longer[200:], long[67:], edited, long[50:63], longer[-13:], long[:6], longer[150:158]]
    given = [" ".join(prose(80) + part + prose(80)) for part in parts] + [" ".join(prose(400)) for _ in range(60)]
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(longer))], "item_id long, text string")
    rows = decontaminate.contaminated(documents(spark, given), items).orderBy("doc_id").collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(0, 1), (1, 2), (2, 2), (3, 1), (4, 2), (5, 1), (6, 2)]
    assert all(r.score < 0.5 for r in rows) and rows[0].first_word <= 80 and rows[0].end_word >= 129
    assert {r.doc_id for r in decontaminate.keep_clean(documents(spark, given), items).collect()} == set(range(7, len(given)))


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "item_id long, text string")
    docs = documents(spark, ["x a b c d e f", "a b c d e f", *edge_texts()], [1, 1, *range(10, 10 + len(edge_texts()))])
    rows = decontaminate.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in rows) == [(1, 1, 1.0), (1, 2, 1.0)]
    assert decontaminate.contaminated(documents(spark, []), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


# embeddings


def vectors(seed=1, n=150, dimension=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dimension))
    near = x[:40] / np.linalg.norm(x[:40], axis=1, keepdims=True) + rng.normal(size=(40, dimension)) * rng.choice([0.01, 0.035, 0.05], (40, 1))
    return np.concatenate([x, near, x[:5], 3 * x[5:8]]).astype(np.float32)


def plain_links(x, labels, threshold=0.93):
    x = x.astype(float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    pairs = list(zip(*np.nonzero(np.triu(linked))))
    low = plain_components(pairs)
    return linked, [int(low.get(i, i)) for i in range(len(x))]


@pytest.mark.parametrize("dimension", [16, 64, 96])
def test_near_duplicates_are_found(spark, dimension):
    x = vectors(dimension=dimension)
    labels = np.arange(len(x)) % 150 % 3
    labels[190:] = labels[:8]
    labels[150:190] = labels[:40]
    given = spark.createDataFrame([(i, v.tolist(), int(k), "t") for i, (v, k) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int, code string")
    rows = hamming.near_duplicates(given).orderBy("vec_id").collect()
    linked, low = plain_links(x, labels)
    found, there = sum(r.n_links for r in rows), int(linked.sum())
    assert found <= there and found >= 0.9 * there
    assert all(r.n_links <= n for r, n in zip(rows, linked.sum(1)))
    if found == there:
        assert [r.component_id for r in rows] == low and all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_vectors_that_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1),
        (8, [1.0, float("nan"), 3.0], 1), (9, [1.0, float("inf"), 3.0], 1), (10, [], 1), (11, [1.0, 2.0], 1), (None, v, 1),
    ]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = hamming.near_duplicates(given).collect()
    assert len(out) == len(rows)
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in out}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)} | {(i, 0, i, True) for i in range(3, 12)}
    assert hamming.near_duplicates(given.limit(0)).count() == 0


def test_double_components_keep_their_range(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [1e39, 2e39], 1), (3, [1e-60, 2e-60], 1), (4, [1e-300, 2e-300], 1), (5, [1e300, 2e300], 1), (6, [2.0, -1.0], 1)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hamming.near_duplicates(given).collect()}
    assert got == {i: (4, 1) for i in range(1, 6)} | {6: (0, 6)}


def test_codes_within_the_radius_always_share_a_table():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 62, 2000).astype("<i8")
    flips = np.array([sum(1 << int(b) for b in rng.choice(63, hamming.RADIUS, replace=False)) for _ in a], "<i8")
    codes = np.concatenate([a, a ^ flips])
    own = hamming._owners(codes, np.arange(2000), np.arange(2000) + 2000)
    assert (own >= 0).all()
