"""WARC archives and a Merkle fixity audit of replicas.

Pages become WARC response records, laid end to end in archive files of about ``per_file`` records each; a record's
offset is the sum of the lengths before it. Records are dealt to files by hash, so files are even whatever the page_ids
are and however often a row comes again. Where a record stands is worked out from its length and digest alone: its
bytes are moved only when archives are written (``write_archives``), and are fetched again by offset (``fetch``).

A file's tree hashes each record's digest with its offset range, then each ``fanout`` neighbouring nodes with the range they
span, up to one root. Two replicas are compared at the roots, and only below nodes that differ is the next level
looked at, so locating c bad records in n takes c times log n nodes; replicas that agree are settled by their roots.
Trees and audit are DataFrame functions; the levels of a tree are rows of one table each.

Defined results: a null url or html is an empty one; a null page_id sorts first within its file; repeated rows are
records of their own; long pages are hashed whole; a record that only one replica has is reported as missing there;
an empty table gives no files and no findings. Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.common import Scratch

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def record_bytes(url: Column, html: Column) -> Column:
    """A WARC/1.1 response record with its HTTP head, as bytes."""
    page = F.coalesce(html, F.lit("")).cast("binary")
    url = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]+", "%20")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.length(page).cast("string"), F.lit(CRLF * 2))
    block = F.concat(head.cast("binary"), page)
    sha = F.sha1(block)
    uuid = F.concat_ws("-", F.substring(sha, 1, 8), F.substring(sha, 9, 4), F.concat(F.lit("5"), F.substring(sha, 14, 3)), F.concat(F.lit("a"), F.substring(sha, 18, 3)), F.substring(sha, 21, 12))
    fields = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:uuid:"),
        uuid,
        F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "),
        url,
        F.lit(f"{CRLF}WARC-Block-Digest: sha1:"),
        sha,
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.length(block).cast("string"),
        F.lit(CRLF * 2),
    )
    return F.concat(fields.cast("binary"), block, F.lit(CRLF * 2).cast("binary"))


def warc_records(pages: DataFrame) -> DataFrame:
    """page_id, record (bytes) and salt, a number that keeps repeated rows apart."""
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    # The salt is made as the pages are read, before anything is dealt out, so a retried task makes the same.
    return pages.select(F.col("page_id").cast("long").alias("page_id"), record_bytes(url, html).alias("record"), F.monotonically_increasing_id().alias("salt"))


def digest(record: Column) -> Column:
    return F.unhex(F.sha2(record, 256))


def placed(records: DataFrame, n: int, per_file: int = 512) -> DataFrame:
    """The rows (with page_id, length, digest, salt), ``n`` in all, and file, seq and offset of each."""
    number = F.pmod(F.xxhash64("digest", "salt"), F.lit(max(1, -(-n // per_file))))
    w = W.partitionBy("file").orderBy(F.asc_nulls_first("page_id"), "digest", "salt")
    dealt = records.withColumn("file", F.format_string("pages-%08d.warc", number))
    return dealt.withColumns({"seq": F.row_number().over(w) - 1, "offset": F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})


def warc_index(pages: DataFrame, per_file: int = 512, replica: DataFrame | None = None) -> DataFrame:
    """file, seq, page_id, offset, length and digest of every page's record; no record is moved."""
    records = warc_records(pages) if replica is None else replica
    rows = records.select("page_id", "salt", F.length("record").cast("long").alias("length"), digest(F.col("record")).alias("digest"))
    return placed(rows, pages.count(), per_file).select("file", "seq", "page_id", "offset", "length", "digest")


def write_archives(pages: DataFrame, folder: str, per_file: int = 512) -> DataFrame:
    """Writes the archives into ``folder`` (a URI that the workers reach) and returns their index as stored.

    A file gets its name once it is whole, so a retried task leaves one copy.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    rows = warc_records(pages).withColumns({"length": F.length("record").cast("long"), "digest": digest(F.col("record"))})
    order = placed(rows, pages.count(), per_file).repartition("file").sortWithinPartitions("file", "seq")
    names = ["file", "seq", "page_id", "offset", "length", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, part, out = None, "", None
        for batch in batches:
            for file, record in zip(batch.column(0).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if file != name:
                    if out:
                        out.close()
                        system.move(part, f"{root}/{name}")
                    name, part = file, f"{root}/.{file}.{uuid.uuid4().hex[:8]}"
                    out = system.open_output_stream(part)
                out.write(record)
            yield batch.select(names)
        if out:
            out.close()
            system.move(part, f"{root}/{name}")

    return scratch.save(order.select(*names, "record").mapInArrow(run, "file string, seq int, page_id long, offset long, length long, digest binary"), "index")


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """The rows of ``index`` (file, seq, page_id, offset, length) with the bytes that stand there in the archives of
    ``folder``: fewer than ``length`` at the end of a file cut short, null if the file is not there."""
    rows = index.select("file", "seq", "page_id", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = FileSystem.from_uri(folder)
        name, source = None, None
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                found = []
                for file, offset, length in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                    if file != name:
                        name = file
                        there = system.get_file_info(f"{root}/{file}").is_file
                        source = system.open_input_file(f"{root}/{file}") if there else None
                    if source:
                        source.seek(min(offset, source.size()))
                    found.append(source.read(length) if source else None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "record"])

    return rows.mapInArrow(run, "file string, seq int, page_id long, offset long, length long, record binary")


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and block; an error if it is not whole or its block's digest is another."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError(f"bad record {fields.get('WARC-Record-ID')}")
    return fields, block


def leaves(index: DataFrame) -> DataFrame:
    """file, level 0, node, first and end offset, hash (bytes)."""
    span = F.concat(F.col("offset").cast("string"), F.lit("+"), F.col("length").cast("string"), F.lit(":"))
    own = F.unhex(F.sha2(F.concat(span.cast("binary"), F.col("digest")), 256)).alias("hash")
    return index.select("file", F.lit(0).alias("level"), F.col("seq").cast("long").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("end"), own)


def _above(nodes: DataFrame, fanout: int) -> DataFrame:
    """The next level: a node for each ``fanout`` of this one, in order."""
    child = F.struct("node", "first", "end", F.hex("hash").alias("hash"))
    groups = nodes.groupBy("file", F.floor(F.col("node") / fanout).alias("parent")).agg(F.array_sort(F.collect_list(child)).alias("c"), F.max("level").alias("level"))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(" ", x["first"], x["end"], x["hash"])), "\n")
    return groups.select("file", (F.col("level") + 1).alias("level"), F.col("parent").alias("node"), F.array_min(F.transform("c", lambda x: x["first"])).alias("first"), F.array_max(F.transform("c", lambda x: x["end"])).alias("end"), F.unhex(F.sha2(text, 256)).alias("hash"))


def merkle_tree(index: DataFrame, fanout: int = 8, name: str = "tree") -> list[DataFrame]:
    """The levels, leaves first, up to roots; each a stored table (file, level, node, first, end, hash)."""
    scratch = Scratch(index.sparkSession, name)
    levels = [scratch.save(leaves(index), "level-0")]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        levels.append(scratch.save(_above(levels[-1], fanout), f"level-{len(levels)}"))
    return levels


def audit(first: list[DataFrame], second: list[DataFrame], fanout: int = 8) -> DataFrame:
    """Leaves that differ: file, node, first, end (as the first replica has them), missing ('', 'first', 'second')."""
    scratch = Scratch(first[0].sparkSession, "audit")
    # A taller tree's upper levels have no counterpart: the walk begins at the height both have.
    suspects = None
    for level in range(min(len(first), len(second)) - 1, -1, -1):
        a, b = first[level], second[level]
        if suspects is not None:
            a, b = (x.join(suspects, (x["file"] == suspects["f"]) & (F.floor(x["node"] / fanout) == suspects["up"]), "left_semi") for x in (a, b))
        a = a.select("file", "node", "first", "end", F.col("hash").alias("one"))
        b = b.select(F.col("file").alias("file2"), F.col("node").alias("node2"), F.col("first").alias("first2"), F.col("end").alias("end2"), F.col("hash").alias("two"))
        both = a.join(b, (F.col("file") == F.col("file2")) & (F.col("node") == F.col("node2")), "full_outer").where(~F.col("one").eqNullSafe(F.col("two")))
        missing = F.when(F.col("one").isNull(), "first").when(F.col("two").isNull(), "second").otherwise("")
        found = both.select(F.coalesce("file", "file2").alias("file"), F.coalesce("node", "node2").alias("node"), F.coalesce("first", "first2").alias("first"), F.coalesce("end", "end2").alias("end"), missing.alias("missing"))
        found = scratch.save(found, f"differ-{level}")
        if level and not found.limit(1).count():
            # The nodes agree, so nothing below them is read.
            return found
        suspects = found.select(F.col("file").alias("f"), F.col("node").alias("up"))
    return found


def damaged(record: Column, every: int = 97) -> Column:
    """The record in a replica for drills: in one of ``every`` (by its hash) the last byte of the page is another one."""
    hit = F.pmod(F.xxhash64(record), F.lit(every)) == 0
    n = F.length(record)
    bad = F.concat(F.substring(record, F.lit(1), n - 5), F.lit(b"\x00"), F.substring(record, n - 3, F.lit(4)))
    return F.when(hit, bad).otherwise(record)
