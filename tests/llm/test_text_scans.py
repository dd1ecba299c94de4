import random
import zlib

import numpy as np
import pytest
from corpus import documents, edge_texts, texts

from auditlake.llm import encoding, licenses, lm, packing, quality, token_files
from auditlake.llm.common import open_filesystem
from auditlake.llm.encoding import Encoder
from auditlake.llm.queries import tokenizer_file

WORD, BYTE = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")


def direct(path, given, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [np.array([*x.ids, end], "<u4") for x in tokenizer.encode_batch([t or "" for t in given], add_special_tokens=False)]


# licenses


def test_phrases_of_random_words_are_those_of_a_plain_comparison():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE_PHRASES, 3, 8, 0.75)
    rng = random.Random(4)
    some = "gnu general public license apache cc by mit x the under version 3 all rights é9".split()
    for _ in range(3000):
        text = rng.choice((" ", "-", ". ")).join(rng.choice(some) for _ in range(rng.randint(0, 25)))
        assert sorted(scanner.scan(text)[1]) == licenses.brute_force(text)


def test_matching_statistics_are_the_longest_runs_of_any_template():
    sequences = [[1, 2, 3, 1, 2, 4], [2, 3, 5], [1, 2, 3, 1, 2, 5, 1]]
    automaton = licenses.Automaton(sequences)
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    rng = random.Random(2)
    for _ in range(300):
        text = [rng.randint(1, 6) for _ in range(12)]
        state = length = 0
        for i, token in enumerate(text):
            while state and token not in automaton.next[state]:
                state = automaton.link[state]
                length = automaton.length[state]
            state = automaton.next[state].get(token, 0)
            length = length + 1 if state else 0
            assert length == max([k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in runs], default=0)


def test_spans_cover_an_edited_notice(spark):
    notice = licenses.TEMPLATES["mit"][1].replace("free of charge", "at no charge at all")
    given = [f"intro words here. {notice} and more", "Licensed under CC BY-NC 4.0.", "released under the mit license", None, ""]
    rows = licenses.scan_licenses(documents(spark, given)).orderBy("doc_id").collect()
    assert [sorted({s.label for s in r.spans}) for r in rows] == [["mit"], ["cc-by-nc-4.0"], ["mit"], [], []]
    span = max(rows[0].spans, key=lambda s: s.end - s.start)
    assert span.start == 3 and 0.75 <= span.coverage < 1
    assert [r.n_words for r in rows][3:] == [0, 0] and [r.score for r in rows][1:] == [1.0, 1.0, 0.0, 0.0]


def test_license_scan_of_odd_rows(spark):
    given = edge_texts() + ["mit license"] * 2
    rows = licenses.scan_licenses(documents(spark, given, [None, *range(1, len(given) - 1), 5])).collect()
    assert len(rows) == len(given) and sum(r.doc_id is None for r in rows) == 1
    assert sum(len(r.base) for r in rows) == 2
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


# token ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_ids_of_the_whole_text(path):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "ab", "Cd", "é", "Àx", "'ll", "'S", "!", "$", "9", "12", "ß", "İ", "Σ", "ς", "漢", "😀", "́", "<|endoftext|>"]
    given = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [t or "" for t in edge_texts()] + texts()
    encoder = Encoder(path)
    assert encoder.kind
    end = np.array([7], "<u4").tobytes()
    assert [x + end for x in encoder.encode(given)] == [x.tobytes() for x in direct(path, given, 7)]


def test_a_piece_that_comes_again_is_made_once_however_many_others_pass():
    made = []
    table = encoding._Table(lambda piece: made.append(piece) or piece.encode(), 10)
    for i in range(1000):
        assert table["again"] == b"again" and table[f"other {i}"] == f"other {i}".encode()
        assert len(table) <= 10
    assert made.count("again") == 1 and len(made) == 1001


def test_other_white_space_between_known_words_is_seen():
    words, rng = ["a", "b,", "Über", "c's", "x1"], random.Random(9)
    gaps = [" ", "\n", "  ", "\n\n", " \n", "\n ", "\t", "\t\n", "\x1c", "\u3000", "\n\t\n"]
    regular = [" ".join(rng.choices(words, k=9)).replace(" a", "\na") for _ in range(50)]
    odd = ["".join(x for _ in range(6) for x in (rng.choice(words), rng.choice(gaps))) for _ in range(2000)]
    odd += [gap + text for gap in gaps for text in ("", "a b", "\na")]
    assert Encoder(BYTE).encode(regular + odd + regular) == [x.tobytes()[:-4] for x in direct(BYTE, regular + odd + regular, 7)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_strings_of_special_tokens(path):
    given = ["a <|endoftext|> b", "a<|startoftext|>b <| x", "<|endoftext|>" * 2000, "<|EndOfText|>"]
    end = np.array([7], "<u4").tobytes()
    assert [x + end for x in Encoder(path).encode(given)] == [x.tobytes() for x in direct(path, given, 7)]
    as_text = Encoder(path, special_as_text=True).encode(given)
    assert all(len(x) > len(y) for x, y in zip(as_text[2:3], Encoder(path).encode(given[2:3])))
    assert max(np.frombuffer(as_text[0], "<u4")) < 49406


def test_token_files_round_trip(spark):
    given = texts() + edge_texts()
    order = list(range(len(given)))
    random.Random(5).shuffle(order)
    docs = documents(spark, [given[i] for i in order], order).repartition(5)
    folder = token_files.write_tokens(docs, WORD, end_id=2)
    rows = token_files.read_tokens(spark, folder, with_ids=True).orderBy("doc_id").collect()
    want, start = direct(WORD, given, 2), 0
    for row, ids in zip(rows, want, strict=True):
        assert (row.start, row.n_tokens, row.ids_crc32, row.ids) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)


def test_token_files_give_single_documents_and_refuse_another_dictionary(spark):
    folder = token_files.write_tokens(documents(spark, texts()), WORD, end_id=2)
    filesystem, base = open_filesystem(folder)
    dictionary = filesystem.open_input_stream(f"{base}/dictionary").read()
    name = spark.read.parquet(f"{folder}/_manifest").orderBy("place").first().shard
    reader = token_files.ShardReader(filesystem, f"{base}/{name}", dictionary)
    assert reader.ids(3).tolist() == direct(WORD, [texts()[reader.doc_ids[3]]], 2)[0].tolist()
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.ShardReader(filesystem, f"{base}/{name}", dictionary + b"x")


def test_token_files_of_odd_rows(spark):
    docs = documents(spark, ["b c", None, "b c", "a"], [None, 4, 4, 1])
    rows = token_files.read_tokens(spark, token_files.write_tokens(docs, WORD, end_id=2)).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 4, 4] and sorted(r.n_tokens for r in rows[2:]) == [1, 3]
    assert token_files.read_tokens(spark, token_files.write_tokens(documents(spark, []), WORD, end_id=2)).count() == 0


# packing


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_pieces_are_powers_of_two_and_cover(n):
    pieces = packing.pieces_of(n, 1024)
    assert sum(size for _, size in pieces) == n and [s for s, _ in pieces] == [sum(z for _, z in pieces[:i]) for i in range(len(pieces))]
    assert all(size & (size - 1) == 0 and size <= 1024 for _, size in pieces)


def test_packing_holds_every_id_once(spark):
    given = texts() + edge_texts()
    rows = packing.pack(documents(spark, given).repartition(3), BYTE, end_id=0, with_ids=True).orderBy("doc_id", "start").collect()
    want = direct(BYTE, given, 0)
    for i, ids in enumerate(want):
        own = [r for r in rows if r.doc_id == i]
        assert [x for r in own for x in r.ids] == ids.tolist() and {r.doc_tokens for r in own} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by_number = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by_number] == sorted((r.length for r in rows), reverse=True)
    assert packing.pack(documents(spark, []), BYTE, end_id=0).count() == 0
    assert packing.pack(documents(spark, ["a", "a", None], [None, 1, 1]), BYTE, end_id=0).count() == 3
    with pytest.raises(ValueError):
        packing.pack(documents(spark, []), BYTE, end_id=0, longest=1000)


# quality


def labelled(spark, n=400):
    rng = random.Random(8)
    given, labels = [], []
    for i in range(n):
        prose = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 90)))
        bad = i % 4 == 0
        given.append((prose.upper() + "!! $$") if bad and i % 8 else (" ".join([prose.split()[0]] * 30) if bad else prose + "."))
        labels.append((i, 0 if bad else 1))
    return documents(spark, given), spark.createDataFrame(labels + [(None, 1), (3, None), (99999, 1)], "doc_id long, quality int")


def test_rules_learn_what_held_out_labels_say(spark):
    from pyspark.sql import functions as F

    docs, labels = labelled(spark)
    scored = quality.score_quality(docs, labels, usable=F.col("doc_id") % 3 != 0)
    rows = scored.join(labels.dropna(), "doc_id").collect()
    held = [r for r in rows if r.doc_id % 3 == 0]
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 290 <= kept.count() <= 310


def test_compiled_rules_score_as_the_model_does(spark):
    docs, labels = labelled(spark, 120)
    measured = quality.with_statistics(docs)
    rows = measured.orderBy("doc_id").collect()
    x = np.array([r[1:] for r in rows], float)
    model = quality.fit(x, np.array([r.doc_id % 4 != 0 for r in rows], float))
    assert 0 < len(model.rules) < 200
    got = [r.s for r in measured.select("doc_id", model.column().alias("s")).orderBy("doc_id").collect()]
    assert np.allclose(got, model.score(x))


def test_quality_of_odd_rows(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, edge_texts(), [None, 1, 1, *range(3, len(edge_texts()))])
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.score_quality(docs, none).collect()
    assert len(rows) == len(edge_texts()) and all(r.score > 0.99 for r in rows)
    one_class = spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, quality int")
    assert len({r.score for r in quality.score_quality(docs, one_class).collect()}) == 1
    assert quality.score_quality(documents(spark, []), none, F.lit(True)).count() == 0
    assert quality.keep_good(docs, none).count() == len(edge_texts())


# language model


def test_one_step_is_that_of_a_plain_comparison_with_the_expected_noise():
    rng = np.random.default_rng(6)
    model = lm.LogBilinear.fresh(np.array([*range(90, 79, -1), *[3] * lm.KINDS], float))
    before, targets = rng.integers(0, 18, (300, lm.CONTEXT)).astype(np.int32), rng.integers(0, 17, 300)
    learners = [lm.Learner(model, seed) for seed in (1, 2)]
    for learner in learners:
        learner.learn(before, targets)
    for x, y in zip(*(learner.model.parameters for learner in learners)):  # no draw of noise tells them apart
        assert np.allclose(x, y, atol=1e-5)
    hidden = sum(model.contexts[k][before[:, k]].astype(float) for k in range(lm.CONTEXT))
    back, groups = np.zeros((300, lm.WIDTH)), len(model.tops) - lm.KINDS
    top = np.where(targets < 11, targets // model.group, targets - 11 + groups)
    sets = [(1, np.arange(len(model.tops)), np.arange(300), top)]
    for g in range(groups):
        sets.append((3, np.arange(11)[g * model.group : (g + 1) * model.group], np.flatnonzero(top == g), targets))
    moved = lambda old, g: old + lm.RATE * g / np.sqrt(0.1 + g * g)
    for which, members, rows, own in sets:
        vectors, biases = model.parameters[which][members].astype(float), model.parameters[which + 1][members]
        noise = lm.NOISE * (model.top_noise if which == 1 else model.inner_noise)[members]
        is_data = 1 / (1 + np.exp(np.log(noise) - hidden[rows] @ vectors.T - biases))
        wanted = (own[rows][:, None] == members) * (1 - is_data) - noise * is_data
        back[rows] += wanted @ vectors
        assert np.allclose(learners[0].model.parameters[which][members], moved(vectors, wanted.T @ hidden[rows]), atol=1e-4)
        assert np.allclose(learners[0].model.parameters[which + 1][members], moved(biases, wanted.sum(0)), atol=1e-4)
    for k in range(lm.CONTEXT):
        gradient = np.zeros((18, lm.WIDTH))
        np.add.at(gradient, before[:, k], back)
        assert np.allclose(learners[0].contexts[k], moved(model.contexts[k], gradient), atol=1e-4)


def test_base_scores_are_those_of_plain_counts_whatever_is_frequent(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    given = texts() + edge_texts()
    count, tokens = Counter(), []
    for i, text in enumerate(given):
        tokens.append((text or "").encode().lower().split() + [b""])
        if i % 3:
            count.update(tokens[-1])
    n, v = sum(count.values()), len(count)
    for frequent in (10, 100_000):
        rows = lm.score_texts(documents(spark, given), F.col("doc_id") % 3 != 0, head=5, frequent=frequent).orderBy("doc_id").collect()
        for row, own in zip(rows, tokens, strict=True):
            want = sum(np.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
            assert (row.n_tokens, row.n_known, row.train_tokens) == (len(own), sum(count[t] > 0 for t in own), n)
            assert row.base_score == pytest.approx(want) and row.score <= 0


def learned_model(steps=60):
    """Classes 0 to 10 follow each other in a ring; kinds do not occur."""
    rng = np.random.default_rng(1)
    learner = lm.Learner(lm.LogBilinear.fresh(np.array([400.0] * 11 + [0] * lm.KINDS)), seed=1)
    for _ in range(steps):
        starts = rng.integers(0, 11, 40)
        learner.learn(*lm._contexts([(start + np.arange(12)) % 11 for start in starts], 17))
    return learner.model


def test_class_probabilities_sum_to_one_and_learn_the_order():
    model, rng = learned_model(), np.random.default_rng(2)
    before = np.concatenate((rng.integers(0, 18, (50, lm.CONTEXT)), [[(c - k) % 11 for k in range(lm.CONTEXT)] for c in range(11)]))
    logs = np.stack([model.log_probabilities(before, np.full(len(before), c)) for c in range(17)], 1)
    assert np.allclose((10**logs).sum(1), 1, atol=1e-5)
    assert (logs[50:].argmax(1) == (np.arange(11) + 1) % 11).all() and (10 ** logs[50:].max(1) > 0.5).all()


def test_log_probabilities_are_those_of_a_plain_recomputation():
    model = learned_model(steps=3)
    texts = [np.array([3, 16, 0]), np.array([0]), np.array([5, 5, 5, 11, 7, 2, 0])]
    want = []
    for text in texts:
        row = [17] * lm.CONTEXT + text.tolist()
        for at in range(lm.CONTEXT, len(row)):
            hidden = sum(model.contexts[k][row[at - 1 - k]].astype(float) for k in range(lm.CONTEXT))
            tops = np.exp(model.tops.astype(float) @ hidden + model.top_biases)
            group, within = divmod(row[at], model.group)
            if row[at] >= 11:
                want.append(np.log10(tops[-lm.KINDS :][row[at] - 11] / tops.sum()))
                continue
            members = range(group * model.group, min(11, (group + 1) * model.group))
            inner = np.exp([model.inner[m].astype(float) @ hidden + model.inner_biases[m] for m in members])
            want.append(np.log10(tops[group] / tops.sum() * inner[within] / inner.sum()))
    assert np.allclose(model.log_probabilities(*lm._contexts(texts, 17)), want, atol=1e-5)


def test_words_of_the_model_grow_and_every_training_token_is_learned_from(spark):
    from pyspark.sql import functions as F

    for copies in (1, 9):
        docs = documents(spark, texts() * copies).repartition(3)
        vocabulary = lm._vocabulary(lm.count_words(docs.select("text")), None, 1000)
        total = sum(len(lm.tokens_of(t)) + 1 for t in texts()) * copies
        assert vocabulary.tokens == total and vocabulary.size == 1 + min(int((total // 4) ** 0.5), vocabulary.distinct - 1) + lm.KINDS
        blocks = lm._summed  # what arrives is weighted by the tokens each parameter was used for
        seen = []

        def kept(rows, keys, ddl, blocks=blocks, seen=seen):
            out = blocks(rows, keys, ddl)
            if keys == ["number"]:
                seen.append(out)
            return out

        lm._summed = kept
        try:
            model = lm.train(docs.select(F.coalesce("text", F.lit("")).alias("text")), vocabulary)
        finally:
            lm._summed = blocks
        place = model.contexts.size // lm.PIECE, model.contexts.size % lm.PIECE  # the first component of the groups' outputs
        learned = 0
        for out in seen:
            row = out.where(F.col("number") == place[0]).first()
            learned += np.frombuffer(row.uses, "f4")[place[1]]
        assert learned == total


def test_model_beats_counts_on_held_out_text(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    nouns = [f"noun{i}" for i in range(40)]
    given = [" ".join(f"the {rng.choice(nouns)} of a {rng.choice(nouns)} is in the {rng.choice(nouns)} ." for _ in range(12)) for _ in range(150)]
    rows = lm.score_texts(documents(spark, given), F.col("doc_id") % 5 != 1).where("doc_id % 5 = 1").collect()
    assert sum(r.score for r in rows) > 0.75 * sum(r.base_score for r in rows)


def test_scoring_odd_rows(spark):
    from pyspark.sql import functions as F

    given = edge_texts()
    rows = lm.score_texts(documents(spark, given, [None, 1, 1, *range(3, len(given))]), F.lit(False)).collect()
    assert len(rows) == len(given) and {r.train_tokens for r in rows} == {0} and all(abs(r.base_score) < 1e-9 for r in rows)
    assert lm.score_texts(documents(spark, []), F.lit(True)).count() == 0


def test_frequent_classes_of_any_number_are_learned():
    # More classes than two bytes hold; the noise's and the texts' shares are of any size.
    counts = np.ones(70_000 + lm.KINDS)
    model = lm.LogBilinear.fresh(counts)
    learner = lm.Learner(model, 3)
    targets = np.array([1, 69_999, 4_463, 1, 70_001] * 40)
    before = np.stack([np.roll(targets, k) for k in range(1, lm.CONTEXT + 1)], 1).astype(np.int32)
    was = model.log_probabilities(before, targets).sum()
    for _ in range(5):
        learner.learn(before, targets)
    assert learner.used[0][0][69_999] == 5 * 40 and learner.used[0][0][4_463] == 5 * 40
    assert learner.model.log_probabilities(before, targets).sum() > was


@pytest.mark.parametrize("shift", [0, 50, 90, -200])
def test_log_softmax_of_any_scores(shift):
    scores = np.random.default_rng(1).normal(0, 12, (50, 7)) + shift
    own = np.arange(50) % 7
    wanted = scores[np.arange(50), own] - scores.max(1) - np.log(np.exp(scores - scores.max(1, keepdims=True)).sum(1))
    assert np.allclose(lm._log_softmax_at(scores.astype(np.float32), own), wanted, atol=1e-4)
