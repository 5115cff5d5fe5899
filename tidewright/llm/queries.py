"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.common import Scratch, table
from tidewright.llm.exact_dedup import exact_dedup
from tidewright.llm.fixity import audit, damaged, digest, merkle_tree, placed, warc_records
from tidewright.llm.html_text import extract
from tidewright.llm.licenses import license_scan
from tidewright.llm.line_dedup import line_dedup
from tidewright.llm.packing import pack
from tidewright.llm.pieces import encode_pieces
from tidewright.llm.quality import quality_rules
from tidewright.llm.simhash import simhash_classes
from tidewright.llm.toxicity import held_out, learn, score_toxicity


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record in the archive, and whether the audit of a damaged replica finds it corrupt there."""
    pages = table(spark, sf_dir, "pages")
    # One reading of the pages gives both replicas' digests: the drill damages records in place.
    both = warc_records(pages).select("page_id", "salt", F.length("record").cast("long").alias("length"), digest(F.col("record")).alias("digest"), digest(damaged(F.col("record"))).alias("other"))
    index = Scratch(spark, "replica").save(placed(both, pages.count()).drop("salt"), "index")
    tree = merkle_tree(index)
    found = audit(tree, merkle_tree(index.withColumn("digest", F.col("other"))))
    rows = index.select("file", "seq", "page_id", "offset", "length").join(tree[0].select("file", F.col("node").alias("seq"), F.lower(F.hex("hash")).alias("leaf")), ["file", "seq"])
    bad = found.select("file", F.col("node").alias("seq"), F.lit(True).alias("bad"))
    return rows.join(bad, ["file", "seq"], "left").select("page_id", "file", "offset", "length", "leaf", F.coalesce("bad", F.lit(False)).alias("corrupt"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_license_scan": op4_license_scan,
    "op5_fixity_audit": op5_fixity_audit,
    "op6_packing": op6_packing,
    "op7_html_text": op7_html_text,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES = {
    "op9_line_dedup": r"""
        WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM parts),
             k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
             o AS (SELECT line_key, min(doc_id) AS owner FROM k WHERE length(line_key) >= 10 GROUP BY line_key),
             f AS (SELECT k.doc_id, k.pos, k.line, o.owner IS NULL OR o.owner = k.doc_id AS stays FROM k LEFT JOIN o ON k.line_key = o.line_key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
        FROM f GROUP BY doc_id""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
        FROM d JOIN g ON d.text_sha256 = g.text_sha256""",
}
