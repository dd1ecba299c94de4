"""The pipeline's stages on a small corpus, each against what plain Python says of its input."""

import random

import corpus_pipeline
import pytest
from corpus import words
from test_copies import plain_join, plain_repeats

from auditlake.llm import queries


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("sf")
    prose = [" ".join(words(rng, rng.randint(60, 120), 5000)) for _ in range(60)]
    item, passage = " ".join(words(rng, 40, 5000)), " ".join(words(rng, 80, 5000))
    given = prose + prose[:5]
    given += [p + " changed" for p in prose[5:9]]
    given += [prose[10 + i][:200] + " " + passage for i in range(3)]
    given += [" ".join(words(rng, 60, 5000)) + " " + item]
    given += [" ".join(words(rng, 40, 5000)).upper() + "!! $$ !!" for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(given)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not t.endswith("!!")), 0) for i, t in enumerate(given) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = (before, sorted(docs.collect(), key=lambda r: r.doc_id))
        assert name == "packing" or docs.columns == columns
    before, after = seen["quality"]
    assert {r.doc_id for r in after} == {b[0] for b in before if not b[1].endswith("!!")}
    before, after = seen["near_duplicates"]
    classes = plain_join([b[1] for b in before])
    assert [r.doc_id for r in after] == [before[i][0] for i, low, _ in classes if i == low]
    before, after = seen["repeats"]
    sizes = plain_repeats([b[1] for b in before], corpus_pipeline.REPEATED_BYTES)
    left = {b[0]: n - gone for b, (n, gone, *_) in zip(before, sizes)}
    assert {r.doc_id: len(r.text.encode()) for r in after} == {i: n for i, n in left.items() if n}
    assert any(gone for _, gone, *_ in sizes) and all(r.n_chars == len(r.text) for r in after)
    before, after = seen["decontamination"]
    assert {b[0] for b in before} - {r.doc_id for r in after} == {72}
    before, after = seen["packing"]
    assert {b[0] for b in before} == {r.doc_id for r in after}


def test_run_gives_the_last_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count()


def test_a_query_for_each_operator(spark):
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
