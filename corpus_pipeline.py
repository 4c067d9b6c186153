"""The corpus pipeline: toxicity, exact dedup, near-dedup, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, exact_dedup, fm_index, simhash_bk, toxicity_zstd
from quarry.llm.common import materialize, table
from quarry.llm.queries import held_out, vocabulary_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.3 or more go; the rest stay as they are."""
    model = toxicity_zstd.fit_toxicity(docs, table(spark, sf_dir, "labels"), where=~held_out())
    return toxicity_zstd.drop_toxic(docs, model, threshold=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, the row with the smallest doc_id stays."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8), the row with the smallest doc_id stays."""
    return simhash_bk.drop_near(docs, shingle_words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go."""
    return fm_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, with the digest of what they decode to."""
    return bpe.tokenize(docs, vocabulary_path())


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", decontaminate), ("BPE encoding", encode)]

#: Compression distances, fingerprints and merges have no SQL form; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name.replace(' ', '-')}")
    return docs
