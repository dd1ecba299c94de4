"""A pipeline over `documents` for training text; each stage works on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import chosen_path, decontaminate, packing, quality, repeats
from auditlake.llm.common import discard, new_folder, saved, table
from auditlake.llm.queries import tokenizer_file

# Passages repeated across documents are cut from about forty words on.
REPEATED_BYTES = 240


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents whose score is below 0.7 go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of similar texts the document with the smallest id stays."""
    return chosen_path.keep_one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: repeated passages are cut out; a document that was nothing else goes."""
    cut = repeats.replace_repeats(docs, length=REPEATED_BYTES)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).where("text is null or text <> ''")


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of power-of-two length, each a sequence of its own."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality", good_text),
    ("near_duplicates", one_of_each),
    ("repeats", without_repeats),
    ("decontamination", clean_of_benchmark),
    ("packing", packed),
]

# The stages learn, search and cut token sequences, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before it is written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        docs = saved(stage(spark, docs, sf_dir), name, folder)
        if before:
            discard(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
