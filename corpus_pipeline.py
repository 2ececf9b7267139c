"""The corpus pipeline: five stages over ``documents``, each by one operator.

``run`` applies the stages in order; what a stage returns is written below the
shared checkpoint folder and read again as the next one's documents.  All but
the last stage return the columns of ``documents``.  Every stage works on all
rows that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gridframe.llm.bpe import encode_documents
from gridframe.llm.common import ARROW_BATCH, staged, table
from gridframe.llm.decontaminate import remove_contaminated
from gridframe.llm.minhash import keep_representatives
from gridframe.llm.queries import vocabulary
from gridframe.llm.suffix_dedup import remove_repeated_words
from gridframe.llm.toxicity import remove_toxic

#: Words of a repeated passage that goes: over 50.
REPEAT_WORDS = 51
#: Rows that pass between the JVM and Python at once: whole texts are wide, and
#: both sides of each task hold a batch.
BATCH_ROWS = 1000


def _stage(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with batches of ``BATCH_ROWS``, also where its result is read."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(ARROW_BATCH, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples say that they are not toxic."""
    return remove_toxic(docs, table(spark, sf_dir, "labels"))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8)."""
    return keep_representatives(docs, words=5, num=80, den=100, repeated_rows=False)


@_stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages of over 50 words that occur elsewhere as well."""
    return remove_repeated_words(docs, REPEAT_WORDS)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, their number, and the text they decode to."""
    coded = encode_documents(docs, vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: SQL can express none of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: what the last one returns."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
