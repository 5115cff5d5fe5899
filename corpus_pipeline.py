"""A training corpus from the documents table: toxicity, quality, line and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; all but the last have the columns of
documents. Line dedup shortens texts and counts n_chars anew; the last stage returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.common import Scratch, release, scratches, table
from tidewright.llm.line_dedup import line_dedup
from tidewright.llm.near_copies import near_dedup
from tidewright.llm.packing import pack
from tidewright.llm.quality import keep_good
from tidewright.llm.toxicity import drop_toxic, learn


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the learned lexicon nor the packing: the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What a stage has stored for itself goes as soon as its rows are written."""
    docs = table(spark, sf_dir, "documents")
    stages = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        mark = scratches()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stages.save(docs, f"stage-{i}")
            release(mark)
            if i:
                stages.drop(f"stage-{i - 1}")
    return docs
