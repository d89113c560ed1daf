"""Exact de-duplication against a persistent digest index (operator 4).

The index is a table of (digest, keep_id, group_size), bucketed and sorted by
digest. New rows are grouped by digest (one row per digest leaves each task),
anti-joined with the index bucket by bucket (sort-merge, the index is not
shuffled) and the new digests are appended.

Texts are equal when identical after each run of white space (space, U+0009 to
U+000D) is replaced by one space; null counts as empty.

Defined cases: of equal texts in one batch the smallest id stays, and a text
that an earlier batch indexed keeps the id indexed then, and with it the group_size of the
batch that brought it (the index is only appended to; rows of later batches are not added to it); a null id loses to
any other id, and a group of null ids only keeps a null; rows repeated under
one id are one document and share its decision (``keep_rows`` returns one of
them); extra columns pass through ``keep_rows`` and are not read elsewhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowdetect.llm.common import release_shuffles, stored
from flowdetect.session import scratch_path

SPACES = r"[\x20\x09-\x0D]+"
BUCKETS = 64
INDEX_SCHEMA = "digest binary, keep_id long, group_size long"


def text_digest(text) -> F.Column:
    """SHA-256 (binary) of the text with each run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256))


class DigestIndex:
    """The persistent index: a bucketed table with its files under ``path``."""

    def __init__(self, spark: SparkSession, path: str, table: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex[:12]}"
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
            )

    def add(self, batch: DataFrame) -> DataFrame:
        """Index the digests of ``batch`` (doc_id, digest) that are new; returns their index rows, written."""
        groups = batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        known = self.spark.table(self.table).select("digest")
        new = stored(groups.join(known.hint("merge"), "digest", "left_anti"), "digests-new")
        new.repartition(self.buckets, "digest").write.mode("append").insertInto(self.table)
        release_shuffles(self.spark)
        return new

    def entries(self) -> DataFrame:
        """All index rows, read by path: a join then shuffles both sides, which lets Spark split a hot digest."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.read.schema(INDEX_SCHEMA).parquet(self.path)

    def drop_entry(self) -> None:
        """Remove the catalog entry; the files stay for the next session, which passes the same path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    index = index or DigestIndex(spark, scratch_path(spark, "digest-index"))
    rows = stored(digests(docs, id_col, text_col), "digests")
    index.add(rows)
    return rows.join(index.entries(), "digest").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one for each text that is new to the index."""
    spark, columns = docs.sparkSession, docs.columns
    index = index or DigestIndex(spark, scratch_path(spark, "digest-index"))
    new = index.add(digests(docs, id_col, text_col))
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), F.col(id_col).cast("long").alias("_id"), text_digest(F.col(text_col)).alias("_digest"))
    winner = new.select(F.col("digest").alias("_digest"), F.coalesce(F.col("keep_id"), F.lit(0)).alias("_id"), F.col("keep_id").isNull().alias("_none"))
    named = named.withColumn("_none", F.col("_id").isNull()).withColumn("_id", F.coalesce("_id", F.lit(0)))
    return (
        named.join(winner, ["_digest", "_id", "_none"], "left_semi")
        .dropDuplicates(["_digest", "_id", "_none"])
        .select("_row.*")
    )
