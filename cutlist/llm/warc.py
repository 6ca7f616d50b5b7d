"""WARC archives with revisit records: written by Spark, read back, and resolved.

Headers are shuffled by payload digest. Of records with equal payloads of at
least ``REVISIT_BYTES`` bytes the one with the largest id is the response; the
others become revisit records that refer to it and hold no payload. A record is
one string, as payloads are UTF-8, and Spark's text writer ends each with the
two line breaks that part records; the archives can be in any store that Spark
writes. They are read back record by record, each cut at its Content-Length, so
payloads may hold any text.

Defined results: a null html is an empty payload; a null url is written as
``urn:x:none``; rows that share both the largest id and the payload are all
responses, with one of them as target; in a group whose ids are all null every
row is a response; an empty table gives an empty archive folder and reads as an
empty table; a page of any size is one record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialize

REVISIT_BYTES = 1000
#: Bytes of an archive file, which one task reads whole, and of the smallest class of payloads.
FILE_BYTES = 128 << 20
FIRST_CLASS = 32 << 10
#: Fixed value: the profile of revisits with equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def _lines(*parts) -> Column:
    return F.concat(*[x for p in parts for x in ((F.lit(p) if isinstance(p, str) else p), F.lit(_END))])


def _rows(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("urn:x:none")).alias("url"), html.alias("html"))
    return rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))


def headers(pages: DataFrame) -> DataFrame:
    """page_id, digest, bytes of each row of ``pages``, written: what is known of it without its payload."""
    return materialize(_rows(pages).select("page_id", "digest", "bytes"))


def originals(heads: DataFrame) -> DataFrame:
    """_digest, _to, _n, written: for each payload that several headers have, the id of its response and their number."""
    known = heads.filter(F.col("bytes") >= REVISIT_BYTES).groupBy(F.col("digest").alias("_digest"))
    return materialize(known.agg(F.max("page_id").alias("_to"), F.count("*").alias("_n")).filter("_n > 1"))


def records(pages: DataFrame, original: DataFrame, total: int, date: str | None = None) -> DataFrame:
    """One column, ``record``: a WARC record with fresh headers for each row of ``pages`` (page_id, url, html).

    ``original`` is that of ``originals`` and ``total`` the number of all pages.
    A payload may be that of a third of all pages. ``date`` is that of the
    records; the present time, if none is given.
    """
    rows = join_counted(_rows(pages), original, {"digest": "_digest"}, "_n", total, by=("page_id", "url"))
    rows = rows.withColumn("_to", F.when(F.col("bytes") >= REVISIT_BYTES, F.col("_to")))
    when = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_to"))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string")), "")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    refers = F.when(revisit, _lines(F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("_to").cast("string"), F.lit(">")), f"WARC-Profile: {PROFILE}")).otherwise("")
    head = F.concat(
        _lines(
            "WARC/1.1",
            F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
            F.concat(F.lit("WARC-Date: "), when),
            F.concat(F.lit("WARC-Target-URI: "), uri),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        ),
        refers,
        _lines("Content-Type: application/http; msgtype=response", F.concat(F.lit("Content-Length: "), F.octet_length("_block").cast("string")), ""),
    )
    return rows.withColumn("_block", block).select(F.concat(head, F.col("_block"), F.lit(_END)).alias("record"))


def write_archives(pages: DataFrame, path: str) -> str:
    """Write the records of ``pages`` as archive files into folders of ``path``.

    Each folder holds pages of one class of size, and its files so many records
    that none has more than about ``FILE_BYTES``, but for a single record that has.
    """
    heads = headers(pages)
    original, total = originals(heads), heads.count()
    classes = [r["c"] for r in heads.select(_class(F.col("bytes")).alias("c")).distinct().collect()]  # a handful
    for c in sorted(classes) or [0]:
        some = pages.filter(_class(F.octet_length(F.coalesce("html", F.lit(""))).cast("long")) == c)
        limit = max(1, FILE_BYTES // (FIRST_CLASS << (4 * c)))
        out = records(some, original, total).write.option("lineSep", _END).option("maxRecordsPerFile", limit)
        out.text(f"{path}/size={c}")
    return path


def _class(size: Column) -> Column:
    """0 for payloads of up to ``FIRST_CLASS`` bytes, 1 for up to 16 times as many, and so on."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) / F.lit(FIRST_CLASS)) / 4)).cast("int")


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)
SCHEMA = "page_id bigint, record_type string, payload_digest string, http_bytes bigint, body_sha1 string, body_bytes bigint, refers bigint"


def _parsed(data: bytes) -> Iterator[tuple]:
    """Records of one archive. The payload's digest and length are taken from the bytes that are there."""
    import hashlib

    at = 0
    while m := _HEAD.match(data, at):
        head = dict(x.split(b": ", 1) for x in m.group(1).split(b"\r\n"))
        body = memoryview(data)[m.end() : m.end() + int(head[b"Content-Length"])]
        at = m.end() + len(body) + 4
        cut = bytes(body[:4096]).index(b"\r\n\r\n") + 4
        declared = int(re.search(rb"Content-Length: (\d+)", bytes(body[:cut])).group(1))
        payload = body[cut:]
        page = head[b"WARC-Record-ID"][len("<urn:page:") : -1]
        to = head.get(b"WARC-Refers-To")
        yield (
            None if page == b"none" else int(page),
            head[b"WARC-Type"].decode(),
            head[b"WARC-Payload-Digest"].split(b":", 1)[1].decode(),
            declared,
            hashlib.sha1(payload).hexdigest(),
            len(payload),
            int(to[len("<urn:page:") : -1]) if to else None,
        )
    if at < len(data):
        raise ValueError(f"no WARC record at byte {at}")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives in ``path``, in ``SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                columns = list(zip(*_parsed(data.as_py()), strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(run, SCHEMA)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take their payload from their response.

    Length and digest of a response are those of its bytes. A revisit's come
    from the response that it is joined to by digest and id; one whose response
    is not in the archives keeps what its own headers say.
    """
    rows = materialize(read_archives(spark, path))
    known = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("_page"), F.col("body_sha1").alias("_sha1")).agg(F.max("body_bytes").alias("_bytes"))
    asked = rows.filter("record_type = 'revisit'").groupBy(F.col("refers").alias("_page"), F.col("payload_digest").alias("_sha1")).agg(F.count("*").alias("_n"))
    known = materialize(asked.join(known, ["_page", "_sha1"]).withColumn("_digest", F.col("_sha1")))
    joined = join_counted(rows, known, {"refers": "_page", "payload_digest": "_sha1"}, "_n", rows.count())
    own = F.col("record_type") == "response"
    return joined.select(
        "page_id",
        F.when(own, F.col("body_bytes")).otherwise(F.coalesce("_bytes", "http_bytes")).alias("payload_bytes"),
        F.when(own, F.col("body_sha1")).otherwise(F.coalesce("_digest", "payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers").alias("refers_to"),
    )
