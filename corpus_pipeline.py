"""A corpus pipeline of five stages; each works on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import bpe, decontaminate, dedup, jaccard, quality
from weft.llm.common import durable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicate stage: words in a shingle, and the similarity from which documents link.
SHINGLE_WORDS, SIMILARITY = 5, (4, 5)
VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it is trained on labelled rows of documents."""
    everything = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(everything, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs.select(*COLUMNS), model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, keep the one with the largest id."""
    return dedup.drop_copies(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, keep the one with the smallest id."""
    num, den = SIMILARITY
    return jaccard.keep_one(docs.select(*COLUMNS), SHINGLE_WORDS, num, den)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each document: doc_id, ids (little-endian unsigned 32-bit), n_tokens and hashes."""
    import public_tokenizers

    return bpe.encode(docs.select(*COLUMNS), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokenize),
]

#: Trained models, word runs and merges can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
