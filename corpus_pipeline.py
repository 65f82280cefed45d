"""A corpus pipeline of five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs; all but the last return the columns of `documents`. With a null or empty text a document passes
toxicity (unless empty texts score as toxic), is its own component, and has nothing to cut; a document that
substring deduplication leaves without words goes, as does one that the mix takes no times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnworks.llm import chunk_dedup, mixing, sentencepiece_backend, sigtree, toxicity
from cairnworks.llm.common import WORD, free_names, materialise, read


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores below its threshold."""
    return toxicity.toxic_filter(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each component under 5-word Jaccard of 0.75."""
    return sigtree.keep_one(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that stand in an earlier one; those left without words go."""
    (report,) = free_names(docs, "_cut")
    cut = chunk_dedup.deduplicated(docs, together=True, report=report)
    removed = F.col(f"{report}.removed_words")
    rows = cut.filter((removed == 0) | F.col("text").rlike(WORD))
    return rows.withColumn("n_chars", F.when(removed > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).drop(report)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, as repeated rows."""
    return mixing.mixed_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its SentencePiece ids, their checksum, and whether they decode to the text again."""
    import public_tokenizers

    return sentencepiece_backend.with_ids(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("jaccard_join", one_of_each_group),
    ("chunk_dedup", without_repeated_passages),
    ("mixing", mixed),
    ("sentencepiece", tokenised),
]

#: The stages train a model, contract components and run tokenizers, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
