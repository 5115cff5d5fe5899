"""WARC records and the Merkle audit against plain hashing."""

import hashlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewright.common import Scratch
from tidewright.llm import fixity as X
from tidewright.llm.queries import QUERIES


def test_whole_table(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    df = spark.read.parquet(f"{sf}/pages.parquet")
    index = X.write_archives(df, f"file://{tmp_path}")
    fetched = {r.page_id: r for r in X.fetch(index, f"file://{tmp_path}").collect()}
    assert sorted(fetched) == sorted(pages) and sum(f.stat().st_size for f in tmp_path.iterdir()) == sum(len(r.record) for r in fetched.values())
    by_file, leaf = defaultdict(list), {}
    for r in fetched.values():
        fields, block = X.parsed(bytes(r.record))
        assert block.split(b"\r\n\r\n", 1)[1].decode() == pages[r.page_id]["html"] and fields["WARC-Target-URI"] == pages[r.page_id]["url"]
        by_file[r.file].append((r.offset, r.length))
        leaf[r.page_id] = hashlib.sha256(f"{r.offset}+{r.length}:".encode() + hashlib.sha256(bytes(r.record)).digest()).hexdigest()
    for spans in by_file.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
    got = QUERIES["op5_fixity_audit"](spark, sf).collect()
    assert {r.page_id: r.leaf for r in got} == leaf
    drill = X.warc_records(df).select("page_id", "record", X.damaged(F.col("record")).alias("other")).collect()
    bad = {r.page_id for r in drill if r.record != r.other}
    assert bad and {r.page_id for r in got if r.corrupt} == bad
    assert all(len(r.record) == len(r.other) for r in drill)


def test_a_damaged_archive_is_found_by_its_bytes(spark, tmp_path):
    df = spark.createDataFrame([(i * 10_000_019, f"http://x/{i}", f"<p>{i}</p>" * (1 + i % 9)) for i in range(2000)], "page_id long, url string, html string")
    index = X.write_archives(df, f"file://{tmp_path}", per_file=128)
    sizes = [r[1] for r in index.groupBy("file").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 220  # sparse ids make no small files
    assert [tuple(r) for r in X.warc_index(df, 128).orderBy("file", "seq").collect()] == [tuple(r) for r in index.orderBy("file", "seq").collect()]
    files = sorted(tmp_path.iterdir())
    raw = bytearray(files[3].read_bytes())
    hit = index.where(F.col("file") == files[3].name).orderBy("seq").collect()
    raw[hit[5].offset + hit[5].length - 6] ^= 1
    files[3].write_bytes(raw)
    files[7].write_bytes(files[7].read_bytes()[:-40])
    files[9].unlink()
    now = X.fetch(index, f"file://{tmp_path}").withColumn("digest", X.digest(F.coalesce("record", F.lit(b""))))
    found = {(r.file, r.node) for r in X.audit(X.merkle_tree(index), X.merkle_tree(Scratch(spark, "t").save(now.drop("record"), "now"))).collect()}
    last = index.where(F.col("file") == files[7].name).agg(F.max("seq")).first()[0]
    gone = {(r.file, r.seq) for r in index.where(F.col("file") == files[9].name).collect()}
    assert found == {(files[3].name, 5), (files[7].name, last)} | gone
    with pytest.raises(ValueError, match="bad record"):
        X.parsed(bytes(raw[hit[5].offset : hit[5].offset + hit[5].length]))


@pytest.mark.parametrize("fanout", [2, 3])
def test_the_walk_finds_each_fault_and_reads_only_below_it(spark, fanout):
    rows = [("f", i, i, 10 * i, 10, bytes([i]) * 10) for i in range(20)] + [("g", i, i, 10 * i, 10, bytes([99 - i]) * 10) for i in range(3)]
    schema = "file string, seq int, page_id long, offset long, length long, digest binary"
    other = [r for r in rows if r[:2] != ("g", 2)]
    other[7] = (*other[7][:5], b"broken one")
    a, b = X.merkle_tree(spark.createDataFrame(rows, schema), fanout, "a"), X.merkle_tree(spark.createDataFrame(other, schema), fanout, "b")
    assert a[-1].groupBy("file").count().where("count > 1").count() == 0
    found = sorted((r.file, r.node, r.missing) for r in X.audit(a, b, fanout).collect())
    assert found == [("f", 7, ""), ("g", 2, "second")]
    assert X.audit(a, a, fanout).collect() == []


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "u\nv", "", 2)] + [(7, "u", "x" * 3_000_000, 3)] + [(5, "same", "same", 4)] * 1500
    df = spark.createDataFrame(rows, "page_id long, url string, html string, seq int").repartition(3)
    index = Scratch(spark, "t").save(X.warc_index(df, per_file=100), "r")
    assert index.count() == len(rows) and index.groupBy("file").count().agg({"count": "max"}).first()[0] < 250
    tree = X.merkle_tree(index)
    assert X.audit(tree, X.merkle_tree(index.where("page_id = 1 or page_id = 7"))).where("missing = 'second'").count() == 1501
    empty = X.merkle_tree(X.warc_index(spark.createDataFrame([], "page_id long, url string, html string")))
    assert X.audit(empty, empty).collect() == []
