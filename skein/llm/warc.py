"""WARC archives: writing captures as records, and assembling transactions when reading them back.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record that
name the response in WARC-Concurrent-To. Archives are written by Spark's text writer with the end of a
record as the line separator, compressed, and read as whole files of bounded size, record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._work import each_copy, new_dir, settle, store

CRLF = "\r\n"
#: Records of one archive file at most.
MAX_RECORDS = 9_000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, "
    "payload_bytes long, page_id string, payload binary"
)


def base32_sha1(raw: Column) -> Column:
    """Upper-case base32 of SHA-1: eight groups of 20 bits, four letters each."""
    hexa = F.sha1(raw)
    groups = [F.lpad(F.conv(F.substring(hexa, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str, record_id: Column, uri: Column, content_type: str, block: Column, *more: Column) -> Column:
    """One record without the two line ends that close it."""
    lines = [
        F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri), F.lit(f"Content-Type: {content_type}"), *more,
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def _text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _html() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def _key(*more: Column) -> Column:
    """The order of captures: by page id, null last, then by url."""
    return F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.coalesce("url", F.lit("")).alias("url"), *more)


def capture_table(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row per capture without its payload: key, url, digest, n, copy, and `first`, the key of the capture it repeats.

    Of equal payloads of at least `min_bytes` bytes the smallest page_id (a null one last; of these the smallest url)
    is the response, and of rows that agree in all of these, copy 0; all others revisit it, which `again` tells.
    Smaller payloads are all responses.
    """
    rows = pages.select(F.col("page_id"), F.col("url"), base32_sha1(_html().cast("binary")).alias("digest"), F.octet_length(_html()).cast("long").alias("n"))
    rows = rows.groupBy("page_id", "url", "digest", "n").agg(F.count("*").alias("copies")).withColumn("key", _key(F.col("url").isNull().alias("no_url")))
    rows = settle(rows)
    # Written, so that the join has plain exchanges on both sides and the rows of a payload with very many copies can be split.
    first = settle(rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("key").alias("first")))
    joined = each_copy(rows.join(first, "digest", "left"), "copies", "copy")
    again = F.col("first").isNotNull() & ((F.col("key") != F.col("first")) | (F.col("copy") > 0))
    return joined.select("page_id", "url", "digest", "n", "key", "copy", "first", again.alias("again"))


def responses(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The captures that are responses, with their payloads: key, copy, digest, n, url, html. Of equal payloads one is shuffled per task."""
    no_url = F.col("url").isNull().alias("no_url")
    rows = pages.select(F.col("page_id"), F.col("url"), _html().alias("html")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "key": _key(no_url)})
    large = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min_by(F.struct("key", "url", "n", "html"), "key").alias("r"))
    large = large.select("r.key", F.lit(0).cast("long").alias("copy"), "digest", "r.n", "r.url", "r.html")
    if min_bytes <= 0:
        return large
    small = rows.where(F.col("n") < min_bytes).groupBy("page_id", "url", "html", "digest", "n", "key").agg(F.count("*").alias("copies"))
    return large.unionByName(each_copy(small, "copies", "copy").select("key", "copy", "digest", "n", "url", "html"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, max_records: int = MAX_RECORDS) -> None:
    """Write request, response or revisit, and metadata records of every row below `path`.

    A null html is an empty payload, a null url a name made of the page id; a null page id isn't written. Record ids
    are made of what a capture is and its copy number, never of where it was read. Other columns aren't read.
    """
    own = lambda kind, key, digest, copy: _uuid(F.lit(kind), F.to_json(key), digest, copy.cast("string"))
    capture = own("response", F.col("key"), F.col("digest"), F.col("copy"))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), _text_of(F.col("key.page_id")))), r"[\x00-\x20\x7f]", "_")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    payload = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    kind = "application/http; msgtype=response"
    response = responses(pages, min_bytes).select(_record("response", capture, uri, kind, F.concat(head, F.col("html")), payload).alias("value"))
    origin = F.concat(F.lit("WARC-Refers-To: "), own("response", F.col("first"), F.col("digest"), F.lit(0)))
    revisit = _record("revisit", capture, uri, kind, head, payload, F.lit(f"WARC-Profile: {REVISIT_PROFILE}"), origin)
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), capture)
    of_key = (F.col("key"), F.col("digest"), F.col("copy"))
    request = _record("request", own("request", *of_key), uri, "application/http; msgtype=request", F.lit(f"GET / HTTP/1.1{CRLF}{CRLF}"), concurrent)
    fields = F.coalesce(F.concat(F.lit("pageId: "), F.to_json(F.struct(F.col("page_id"))), F.lit(CRLF)), F.lit(""))
    metadata = _record("metadata", own("metadata", *of_key), uri, "application/warc-fields", F.when(F.col("page_id").isNull(), "").otherwise(fields), concurrent)
    others = capture_table(pages, min_bytes).select(F.explode(F.array(request, metadata, F.when(F.col("again"), revisit))).alias("value")).where("value is not null")
    for rows in (response, others):
        rows.write.mode("append").options(lineSep=CRLF * 2, compression="gzip", maxRecordsPerFile=max_records).text(path)


def parse_records(content: bytes, payloads: bool = True) -> Iterator[dict]:
    """The records of one archive, by their lengths."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        head = dict(line.split(b": ", 1) for line in content[at:end].split(b"\r\n")[1:])
        start = end + 4
        block = content[start : start + int(head[b"Content-Length"])]
        at = start + len(block) + 4
        kind = head[b"WARC-Type"].decode()
        text = lambda k: head[k].decode() if k in head else None
        row = {"record_type": kind, "record_id": text(b"WARC-Record-ID"), "concurrent_to": text(b"WARC-Concurrent-To"), "refers_to": text(b"WARC-Refers-To"), "target_uri": text(b"WARC-Target-URI")}
        row |= {"payload_digest": None, "payload_bytes": None, "page_id": None, "payload": None}
        if kind == "response":
            body = block[block.index(b"\r\n\r\n") + 4 :]
            row |= {"payload": body if payloads else None, "payload_bytes": len(body), "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode()}
        elif kind == "revisit":
            row["payload_digest"] = text(b"WARC-Payload-Digest").removeprefix("sha1:")
        elif kind == "metadata":
            fields = dict(line.split(b": ", 1) for line in block.split(b"\r\n") if line)
            row["page_id"] = fields[b"pageId"].decode() if b"pageId" in fields else None
        yield row


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records below `path`; without `payloads` that column is null."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")

    def run(batches):
        import pyarrow as pa

        types = [pa.int64() if k == "payload_bytes" else pa.binary() if k == "payload" else pa.string() for k in names]
        for batch in batches:
            for content in batch.column(0):
                records = parse_records(gzip.decompress(content.as_py()), payloads)
                while rows := list(islice(records, 1000)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types)], names)

    names = [f.strip().split(" ")[0] for f in RECORDS.split(",")]
    return files.mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata concurrent to it.

    A missing request or metadata record is null; records concurrent to nothing known are left out.
    """
    part = lambda kind, *own: records.where(F.col("record_type") == kind).select(F.col("concurrent_to").alias("capture"), F.struct("record_id", "target_uri", *own).alias(kind))
    answer = records.where(F.col("record_type").isin("response", "revisit"))
    answer = answer.select(F.col("record_id").alias("capture"), F.struct("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload").alias("response"))
    return answer.join(part("request"), "capture", "left").join(part("metadata", "page_id"), "capture", "left")


def captures(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Per capture: page id (of the given type), payload size and digest, record type, and the page it refers to."""
    records = store(read_archives(spark, path, payloads=False).drop("payload"), "warc-records").withColumn("payload", F.lit(None).cast("binary"))
    page = F.from_json("metadata.page_id", f"page_id {id_type}")["page_id"]
    whole = settle(
        assemble(records).select("capture", page.alias("page_id"), "response.record_type", F.col("response.refers_to").alias("origin"), "response.payload_bytes", "response.payload_digest")
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    answers = whole.where("record_type = 'response'")
    known = answers.select(F.col("capture").alias("origin"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"))
    again = whole.where("record_type = 'revisit'").join(known, "origin", "left").withColumn("payload_bytes", F.col("n"))
    return answers.select(*columns, F.lit(None).cast(id_type).alias("refers_to")).unionByName(again.select(*columns, "refers_to"))


def report(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    path = new_dir(pages.sparkSession, "warc")
    write_archives(pages, path)
    return captures(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString())
