"""Corpus pipeline: quality classifier, exact, near-duplicate and passage de-duplication, packing.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir), works
on all rows that the stage before it kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. ``run`` applies them
to the documents table.

Odd rows: a null text counts as empty (the classifier scores it like any other text, packing gives it
its end id alone); rows with a null id are kept by the near-duplicate stage, come after all others in the passage stage and
lose to any id in the exact stage; rows repeated under one id are one document in the exact stage, which returns one of
them; of ties the smallest id stays; texts are read whole at any length; a text that the passage stage leaves without a
word goes; an empty table gives an empty one; extra columns pass through all stages but packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowdetect.llm import exact_dedup, minhash, packing, quality_classifier, substring_dedup
from flowdetect.llm.common import read_table, stored
from flowdetect.llm.queries import PACKING_VOCABULARY, vocabulary


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows whose quality score is below the threshold go."""
    stats = stored(quality_classifier.document_statistics(docs), "statistics")
    model = quality_classifier.fit(stats, read_table(spark, sf_dir, "labels"))
    return quality_classifier.accepted_rows(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one row of each group of equal texts stays."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each near-duplicate group stays (shingles of five words, similarity 0.8)."""
    return minhash.keep_one_of_each(docs, size=5)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: later copies of repeated passages are cut out of the texts."""
    return substring_dedup.remove_passages(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the place of every piece in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs, vocabulary(PACKING_VOCABULARY)))


STAGES = [
    ("quality", drop_low_quality),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("passages", cut_passages),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
