"""From raw documents to packed sequences: five stages, each written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, neardup, packing, quality, substrings, tokens
from marginalia.llm.common import stored, table

TOKENIZER, CAPACITY, END_TOKEN = "word_bpe_49k.json", 4096, 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group at 0.8 similarity of five-word shingles."""
    return neardup.keep_one(docs, words=5, percent=80)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document of smaller doc_id has; ``n_chars`` follows."""
    left = substrings.without_repeats(docs, 50)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), 10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in sequences of 4096."""
    import public_tokenizers

    pieces = tokens.cut_documents(docs, public_tokenizers.path(TOKENIZER), CAPACITY, END_TOKEN)
    return packing.pack(pieces, CAPACITY)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated substrings", repeated_substrings),
    ("benchmark passages", benchmark_passages),
    ("packing", packed),
]
# Token ids and packing have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
