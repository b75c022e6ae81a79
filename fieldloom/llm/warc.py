"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

A record is one string, and the line separator is the blank pair of lines that
ends a record, so the sink's files are WARC files on whatever store Spark can
write. A payload that an earlier page has too becomes a revisit.

Reading finds every place that looks like a record's start, inside payloads
too. Each such candidate points to where its record ends. Pointers are
shortened within blocks of a file first, then by pointer jumping between
blocks; only what can be reached from the start of a file is a record.

Defined results: a null html counts as empty; a null url is written as an empty
one; a row without page_id is written as a response and read back with a null
id; rows that repeat the page_id of a response are responses too; an empty
table gives no rows; extra columns are ignored. A file must fit binaryFile's
limit of 2 GB, and a task of the reader holds one file: ours hold FILE_BYTES of
records, or one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, shared_dir, stage_table

END = "\r\n\r\n"
#: Bytes of records that a file holds at most, unless one record alone has more.
FILE_BYTES = 128 << 20
#: Records are written by classes of size; a file of a class holds as many as fit FILE_BYTES at the class's largest size.
LARGEST = [32 << 10, 512 << 10, 8 << 20]
BLOCK = 4 << 20
#: A table of repeated payloads of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: 20 bits at a time, in base 32, with the standard letters."""
    h = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), HEX32, BASE32)


def _own(pages: DataFrame) -> DataFrame:
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return own.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))


def first_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """(digest, bytes, first): the smallest page_id of each payload of at least so many bytes that several rows have."""
    own = _own(pages).where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    return own.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")


def records(pages: DataFrame, firsts: DataFrame) -> DataFrame:
    """One string per page: its WARC record without the separator; firsts says what it revisits."""
    own = _own(pages)
    side = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    rows = own.join(side, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("first") != F.col("page_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "+")
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
            F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
            F.lit("\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nWARC-Target-URI: "), uri,
            F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
            F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"))).otherwise(""),
            F.lit("\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string")), F.lit(END),
            F.when(revisit, "").otherwise(F.col("html")),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    firsts = stage_table(first_pages(pages, least), "warc-firsts")
    # A head takes under a kilobyte besides the url.
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) + 1024
    of = F.lit(len(LARGEST))
    for k in range(len(LARGEST) - 1, -1, -1):
        of = F.when(size <= LARGEST[k], k).otherwise(of)
    # There are at most len(LARGEST) + 1 classes; an empty table is written as one empty archive.
    for k, n in sorted(tuple(r) for r in pages.select(of.alias("k")).groupBy("k").count().collect()) or [(0, 0)]:
        most = FILE_BYTES // LARGEST[k] if k < len(LARGEST) else 1
        # No more tasks than files: what a task writes is what a file may hold.
        rows = records(pages.where(of == k), firsts).coalesce(max(1, -(-n // most)))
        rows.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", most).text(path)
    release(pages.sparkSession, firsts)


CANDIDATES = "path string, at long, next long, leaves long, type string, page_id long, refers_to long, payload_bytes long, payload_digest string"


def parse_head(data: bytes, at: int) -> tuple[int, dict[str, str]] | None:
    """Where a candidate's block starts and its fields; None if this is no head."""
    fields, place = {}, data.find(b"\r\n", at)
    # The first line without a colon ends it, so a candidate is read up to the next one at most.
    while place >= 0:
        start, place = place + 2, data.find(b"\r\n", place + 2)
        if place == start:
            return (start + 2, fields) if fields.get("content-length", "").isdigit() else None
        key, colon, value = data[start : max(start, place)].partition(b":")
        if not colon:
            return None
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    return None


def _page(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(m[1]) if m else None


def candidates_of(data: bytes, block: int = BLOCK) -> list[list]:
    """Every place of a file that reads as a record's head, with its successor."""
    out = []
    for m in MAGIC.finditer(data):
        if (head := parse_head(data, m.start())) is None:
            continue
        start, fields = head
        size = int(fields["content-length"])
        stop = start + size
        if data[stop : stop + 4] != b"\r\n\r\n":
            continue
        kind = fields.get("warc-type", "")
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        length = size
        if kind == "revisit":
            length = int(fields.get("x-payload-length", "0"))
        else:
            digest = base64.b32encode(hashlib.sha1(memoryview(data)[start:stop]).digest()).decode()
        out.append([m.start(), stop + 4, stop + 4, kind, _page(fields.get("warc-record-id", "")), _page(fields.get("warc-refers-to", "")), length, digest])
    # Within a block, pointers are followed to where they leave it.
    place = {c[0]: i for i, c in enumerate(out)}
    for c in reversed(out):
        if c[1] // block == c[0] // block and c[1] in place:
            c[2] = out[place[c[1]]][2]
    return out


def read_archives(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """The records of all files under a path: page_id, payload_bytes, payload_digest, record_type, refers_to, path, at."""

    def scan(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = candidates_of(content.as_buffer().to_pybytes(), block)
                for i in range(0, len(rows), 10_000):
                    part = [[name, *r] for r in rows[i : i + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=[c.split()[0] for c in CANDIDATES.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    cand = stage_table(files.mapInArrow(scan, CANDIDATES), "warc-candidates")
    reached = jump_chains(cand.select("path", "at", F.col("leaves").alias("to")))
    # From where a chain enters a block, it is followed to the block's end.
    number = F.floor(F.col("at") / block)
    entries = reached.select("path", number.alias("block"), F.col("at").alias("entry"))
    inside = cand.withColumn("block", number).join(entries, ["path", "block"])

    def follow(frame):
        frame = frame.sort_values("at")
        nexts, at, keep = dict(zip(frame["at"], frame["next"], strict=True)), frame["entry"].iloc[0], set()
        while at in nexts:
            keep.add(at)
            at = nexts[at]
        return frame.loc[frame["at"].isin(keep), ["path", "at"]]

    kept = inside.select("path", "block", "at", "next", "entry").groupBy("path", "block").applyInPandas(follow, "path string, at long")
    ids = kept.join(cand, ["path", "at"])
    out = stage_table(ids.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "path", "at"), "warc-records")
    release(spark, cand, reached)
    return out


def jump_chains(pointers: DataFrame) -> DataFrame:
    """(path, at) of what can be reached from at = 0 of each path by pointers (path, at, to).

    Every round doubles the length of the pointers and of the reached part of
    each chain, so the rounds grow with the logarithm of a chain's length.
    pointers are read anew in every round, so give a written table.
    """
    spark = pointers.sparkSession
    places = jumps = pointers
    reached = stage_table(jumps.where("at = 0").select("path", "at"), "warc-reached")
    count = reached.count()
    while True:
        more = reached.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at"))
        known = more.join(places.select("path", "at"), ["path", "at"], "left_semi")
        new_reached = stage_table(reached.unionByName(known).distinct(), "warc-reached")
        new_count = new_reached.count()
        release(spark, reached)
        reached = new_reached
        if new_count == count:
            if jumps is not places:
                release(spark, jumps)
            return reached
        count = new_count
        ahead = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("then"))
        new_jumps = stage_table(jumps.join(ahead, ["path", "to"]).select("path", "at", F.col("then").alias("to")), "warc-jumps")
        if jumps is not places:
            release(spark, jumps)
        jumps = new_jumps


def archive_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def delete_archives(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
