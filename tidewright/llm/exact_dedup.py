"""Exact deduplication against a persistent digest index.

The index is a table of text digests, bucketed and sorted by digest, in the shared folder (``bucketed``). A batch is
reduced to one row a digest (with map-side aggregation), anti-joined with the index in a sort-merge join that does not
shuffle the index, and what is new is appended to the same buckets. A table is fed to the index in batches of ascending doc_id, so
that the smallest doc_id of a text is the one that stays. Only DataFrame functions are used.

Defined results: a null text counts as the empty text, and all such rows form one group; repeated rows of one
doc_id are rows of one group like any other; a null doc_id stays only where a group has no other id; ties do
not arise, as the smallest doc_id stays and rows with that id are the same document; an empty batch changes
nothing and returns no rows. Only doc_id and text are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.common import Scratch, spread_join
from tidewright.llm.bucketed import BucketStore
from tidewright.llm.line_dedup import in_batches

SPACE = r"[\x20\x09-\x0D]+"


def digested(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the text with each run of ASCII white space made one space."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


class DigestIndex:
    """An index is opened by its name, or made. ``buckets`` is fixed when it is made: choose it so that one bucket of
    the expected index sorts in a task's memory (a digest and its owner take 40 bytes; 4,096 buckets hold 10^11
    documents at 1 GB each)."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 48):
        self.store = BucketStore(spark, ["digest"], "digest BINARY, keep_id BIGINT", buckets, name)
        self.name = self.store.name
        if not self.store.tables:
            self.store.create()
            self.store.record()

    def table(self) -> DataFrame:
        return self.store.table(next(iter(self.store.tables)))

    def add(self, groups: DataFrame) -> None:
        """Appends the digests of ``groups`` (digest, own: the smallest doc_id) that the index has not."""
        new = groups.join(self.table().hint("merge"), "digest", "left_anti").select("digest", F.col("own").alias("keep_id"))
        # Dealt by bucket, so each bucket gets one file a batch however many tasks there are.
        n = self.store.buckets
        self.store.append(next(iter(self.store.tables)), new.repartition(n, F.pmod(F.hash("digest"), F.lit(n))))

    def ingest(self, docs: DataFrame, batches: int = 1) -> DataFrame:
        """Adds the rows; for each of them: doc_id, digest, keep_id, group_size (among these rows), kept."""
        scratch = Scratch(docs.sparkSession, f"exact-{uuid.uuid4().hex[:8]}")
        d = scratch.save(digested(docs), "digests")
        for i, part in enumerate(in_batches(d, batches)):
            self.add(scratch.save(part.groupBy("digest").agg(F.min("doc_id").alias("own")), f"groups-{i}"))
        sizes = d.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        found = sizes.join(self.table().hint("merge"), "digest").select("digest", "keep_id", "group_size", F.col("group_size").alias("weight"))
        found = scratch.save(found, "found")
        total = found.agg(F.sum("group_size")).first()[0] or 0
        out = spread_join(d, found, "digest", "weight", total)
        return out.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))

    def drop(self) -> None:
        self.store.drop()


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """Without an ``index``, one of its own, which goes as soon as every row has its group."""
    own = index or DigestIndex(docs.sparkSession)
    out = own.ingest(docs, batches)
    if index is None:
        own.drop()
    return out
