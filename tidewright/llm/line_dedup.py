"""Line deduplication by levelled sorted runs of line hashes.

A run is a table of line hashes with the document that keeps each line, bucketed and sorted by hash. A batch of
documents is hashed line by line and reduced to one row a hash (with map-side aggregation); these meet every run in
a merge join that does not shuffle the run, and the hashes that no run has become a new run of level 0.
A level that has reached ``fanout`` runs is merged into one run of the next level, so there are at most ``fanout``
runs a level and each hash is rewritten once a level. A line that is in very many documents makes one row in
the runs, and is broadcast rather than dealt out when these are joined back to the documents. The runs live in the
shared folder with a manifest (``bucketed``): opened again by name, in any session, they go on where they were.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased, hashed to 128 bits. Keys
of at least ``min_chars`` code points are shared; of the documents that hold a key, in the first batch that has
it, the one with the smallest doc_id keeps all its lines of that key, and every other line of it goes.

Defined results: a null or empty text is one empty line; a null doc_id counts as one document after all others;
repeated rows of a doc_id are one document and keep the same lines; very long texts are handled as arrays of
lines, in time linear in their length; an empty table gives an empty result. Other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.common import Scratch, col, spread_join
from tidewright.llm.bucketed import BucketStore

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def folded(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """r1, r2, doc_id, pos, h1, h2: a row for each line that is long enough to be shared; r1, r2 stand for the document row."""
    row = [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit("row"), "doc_id", "text").alias("r2")]
    lines = docs.select(*row, "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("r1", "r2", "doc_id", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("r1", "r2", "doc_id", "pos", folded(F.col("key")).alias("key")).select("r1", "r2", "doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """The persistent runs, made or opened by name. ``buckets`` is fixed when they are made: so many that a bucket of
    the highest level sorts in a task's memory (24 bytes a line)."""

    def __init__(self, spark: SparkSession, name: str | None = None, fanout: int = 2, buckets: int | None = None):
        self.fanout = fanout
        schema = "h1 BIGINT, h2 BIGINT, owner BIGINT, shared BOOLEAN, n BIGINT, known BOOLEAN"
        self.store = BucketStore(spark, KEY, schema, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), name)
        self.name = self.store.name

    @property
    def levels(self) -> list[list[str]]:
        """The tables of each level, oldest first."""
        of = self.store.tables
        return [[t for t, k in of.items() if k == level] for level in range(max(of.values(), default=-1) + 1)]

    def run(self, name: str) -> DataFrame:
        """A table also holds what its batch found in older runs, marked as known; that is no part of the run."""
        return self.store.table(name).where("not known").select(*KEY, "owner")

    def add(self, keys: DataFrame) -> DataFrame:
        """Adds (h1, h2, owner, shared, n) of a batch; returns (h1, h2, owner, n) of the lines that some document must lose."""
        older = [t for level in self.levels for t in level]
        for i, t in enumerate(older):
            keys = keys.join(self.run(t).withColumnRenamed("owner", f"owner{i}").withColumn(f"in{i}", F.lit(True)).hint("merge"), KEY, "left")
        known, owner = F.lit(False), F.col("owner")
        for i in range(len(older)):
            known, owner = known | F.coalesce(F.col(f"in{i}"), F.lit(False)), F.when(F.col(f"in{i}"), F.col(f"owner{i}")).otherwise(owner)
        table = self.store.create()
        self.store.append(table, keys.select(*KEY, owner.alias("owner"), "shared", "n", known.alias("known")))
        self.store.record()
        return self.store.table(table).where("shared or known").select(*KEY, "owner", "n")

    def compact(self) -> None:
        """Merges each level that is full into the next. No hash is in two runs."""
        level = 0
        while level < len(self.levels):
            tables = self.levels[level]
            if len(tables) >= self.fanout:
                merged = self.run(tables[0])
                for t in tables[1:]:
                    merged = merged.unionByName(self.run(t))
                merged = merged.select(*KEY, "owner", F.lit(False).alias("shared"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("known"))
                self.store.append(self.store.create(level + 1), merged.repartition(self.store.buckets, *KEY))
                for t in tables:
                    del self.store.tables[t]
                self.store.record()
                self.store.remove(tables)
            level += 1

    def drop(self) -> None:
        self.store.drop()


def dedup_batch(docs: DataFrame, runs: LineRuns, scratch: Scratch, min_chars: int = 10, counts: bool = True) -> DataFrame:
    """The batch's rows and columns, with ``text`` left by the lines that go, then, if asked, ``__lines`` and ``__dropped``.

    Adds the batch's own lines to the runs.
    """
    name = f"batch-{uuid.uuid4().hex[:8]}"
    full = F.coalesce("text", F.lit(""))
    lines = scratch.save(line_keys(docs.select("doc_id", full.alias("text")), min_chars), f"{name}/lines")
    ids = F.count("doc_id")
    shared = (F.max("doc_id") > F.min("doc_id")) | ((ids > 0) & (ids < F.count(F.lit(1))))
    lost = runs.add(lines.groupBy(*KEY).agg(F.min("doc_id").alias("owner"), F.coalesce(shared, F.lit(False)).alias("shared"), F.count(F.lit(1)).alias("n")))
    total = lost.agg(F.sum("n")).first()[0] or 0
    gone = spread_join(lines, lost, KEY, "n", total).where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    gone = scratch.save(gone.groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone")), f"{name}/gone")
    scratch.drop(f"{name}/lines")
    runs.compact()
    own = F.struct(*[col(c) for c in docs.columns if c != "text"]).alias("own")
    row = [F.xxhash64("doc_id", full).alias("r1"), F.xxhash64(F.lit("row"), "doc_id", full).alias("r2")]
    parts = docs.select(own, F.split(full, "\n").alias("parts"), *row)
    # One plan at every size: the texts are dealt out once and merged with the positions that go.
    out = parts.join(gone.hint("merge"), ["r1", "r2"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.col("parts")[i]), "\n").alias("text")
    columns = [kept if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, *[F.size("parts").cast("long").alias("__lines"), F.size("gone").cast("long").alias("__dropped")][: 2 * counts])


def in_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """``docs`` as ranges of doc_id of about equal size, in ascending order; rows without an id are in the last."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    if not cuts:
        return [docs]
    middle = [docs.where((F.col("doc_id") > a) & (F.col("doc_id") <= b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [docs.where(F.col("doc_id") <= cuts[0]), *middle, docs.where(F.col("doc_id").isNull() | (F.col("doc_id") > cuts[-1]))]


def line_dedup(docs: DataFrame, runs: LineRuns | None = None, min_chars: int = 10, batches: int = 2, counts: bool = True) -> DataFrame:
    """The whole table, fed to the runs as ``batches`` ranges of doc_id in ascending order. Without ``runs``, some of
    its own, which go as soon as every line has its owner."""
    spark = docs.sparkSession
    own, scratch = runs or LineRuns(spark), Scratch(spark, "lines")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    out = None
    for part in in_batches(docs, batches):
        part = dedup_batch(part, own, scratch, min_chars, counts)
        out = part if out is None else out.unionByName(part)
    if runs is None:
        own.drop()
    return out
