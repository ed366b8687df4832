"""Exact dedup against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lookup

#: the characters that don't count when texts are compared: [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest(text: Column) -> Column:
    """SHA-256 of the text without blanks, 64 lower-case hex digits; null counts as empty."""
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """A parquet table of digests, clustered by digest into buckets that are sorted by it.

    It outlives the session: a new session that names the same location finds
    the same digests.  `new_rows` is a sort-merge anti-join in which only the
    new side is exchanged; `append` writes into the same buckets.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.location, self.buckets = spark, location, buckets
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, location).hex}"
        if not re.fullmatch(r"[^'\\]+", location):
            raise ValueError("the location can't hold quotes or backslashes")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id {id_type}, n_chars BIGINT, group_in_batch BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def new_rows(self, digests: DataFrame) -> DataFrame:
        """Rows of digests (with a column `digest`) that the index doesn't hold."""
        return digests.join(self.table().hint("merge"), "digest", "left_anti")

    def append(self, digests: DataFrame) -> None:
        rows = digests.select("digest", "keep_id", "n_chars", "group_in_batch")
        rows.repartition(self.buckets, "digest").write.mode("append").insertInto(self.name)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars in code points, digest) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), digest(F.col(text_col)).alias("digest"))


def batch_winners(prints: DataFrame) -> DataFrame:
    """A row per digest: the row that stays (most code points, then smallest id, null last) and the group's size."""
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    return prints.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_in_batch")).select(
        "digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("n_chars"), "group_in_batch"
    )


def dedup_batch(docs: DataFrame, index: DigestIndex, scratch: Scratch) -> DataFrame:
    """Dedup one batch against the index and within itself; append what is new.

    Returns a row per input row: doc_id, n_chars, digest, keep_id, group_in_batch (equal
    texts in this batch, earlier ones not counted), kept.  Ids may be of any type that can be ordered.  Within the batch the row with the most code points stays, then the
    smallest doc_id; a text that the index already holds stays nowhere in the
    batch: its keep_id is that of the earlier batch.  Null texts are empty
    texts; a null doc_id sorts behind all others and is never kept where another
    row is there; rows that repeat a doc_id and text are all marked kept alike.
    An empty batch appends nothing.  Other columns of docs aren't read.

    A group is one row per task before the exchange, so its size doesn't
    matter there; the answer goes back to the rows through `lookup`, which splits the
    heaviest groups.
    """
    prints = scratch.keep(fingerprints(docs))
    winners = scratch.keep(batch_winners(prints))
    index.append(index.new_rows(winners))
    held = index.table().select("digest", F.col("keep_id").alias("held_id"))
    answers = winners.select("digest", "group_in_batch").join(held.hint("merge"), "digest").withColumnRenamed("held_id", "keep_id")
    out = lookup(prints, answers, "digest", "group_in_batch", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, scratch: Scratch, buckets: int = 64) -> DataFrame:
    """`dedup_batch` of one batch against an index of its own in the shared folder."""
    index = DigestIndex(scratch.spark, f"{scratch.root}/index", buckets, docs.schema["doc_id"].dataType.simpleString())
    return dedup_batch(docs, index, scratch)
