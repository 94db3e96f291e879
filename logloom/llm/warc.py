"""WARC: archives written and read by Spark, and transactions assembled from their records.

Archives are written through the text sink (record text, line separator CRLF) and read as whole
binary files, so they can live in any store that Spark reaches.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_type, joined_by, map_arrow, materialise, shared_dir

#: Payloads shorter than this are never revisits.
LEAST_PAYLOAD = 100
#: An archive file holds about this many bytes at most, or one capture.
FILE_BYTES = 32 * 1024 * 1024
#: Pages from these sizes on are written apart from smaller ones.
SIZE_CLASSES = (64 * 1024, 1024 * 1024)
#: Fixed values of the format.
VERSION, CRLF = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(*parts: Column) -> Column:
    """A urn:uuid that follows from the parts (version 8: an own hash)."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def record(kind: Column | str, identifier: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """The text of a record without its last line end, which the sink adds; headers with null values are left out."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", F.concat(F.lit("<"), identifier, F.lit(">"))), line("WARC-Date", F.lit(DATE)),
        *[line(n, v) for n, v in headers], line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block, F.lit(CRLF),
    )


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAYLOAD, file_bytes: int = FILE_BYTES) -> None:
    """Write a request, a response or revisit, and a metadata record for each row, as gzip files under path.

    Of rows with equal payloads of at least least bytes, those with the smallest id are responses
    and the others revisits, which hold the HTTP head only and name the response. A null payload
    is empty; a null id counts as the largest; a null url becomes urn:page:<id>. Repeated rows
    give repeated records; an empty table gives an empty archive; other columns are ignored.
    """
    page, body = F.col("page"), F.col("body")
    rows = pages.select(F.col(id_col).alias("page"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), r"[\x00-\x20\x7F]", "%20").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("body"))
    rows = rows.withColumns({"digest": F.sha2(body, 256), "bytes": F.octet_length(body)})
    first = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page").alias("first_page"), F.count("*").alias("copies")).where("copies > 1")
    # Digests that occur more than once are next to the bodies: broadcast if they are few, else only those of very many pages.
    rows = joined_by(rows, materialise(first, "warc-first"), "digest", "copies")
    revisit = F.col("first_page").isNotNull() & (page.isNull() | (page != F.col("first_page")))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    own = record_id(F.lit("response"), page, F.col("url"), F.col("digest"))
    at = F.concat(F.lit("<"), own, F.lit(">"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    reply = record(
        F.when(revisit, "revisit").otherwise("response"), own,
        [("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", digest), ("WARC-Profile", F.when(revisit, F.lit(PROFILE))), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(head, F.when(revisit, "").otherwise(body)),
    )
    request = record(
        "request", record_id(F.lit("request"), page, F.col("url"), F.col("digest")),
        [("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", at), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), F.lit(" HTTP/1.1" + CRLF + "Host: "), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1), F.lit(CRLF + CRLF)),
    )
    fields = F.concat(F.coalesce(F.concat(F.lit("pageId: "), F.url_encode(page.cast("string")), F.lit(CRLF)), F.lit("")), F.coalesce(F.when(revisit, F.concat(F.lit("refersToPageId: "), F.url_encode(F.col("first_page").cast("string")), F.lit(CRLF))), F.lit("")))
    about = record("metadata", record_id(F.lit("metadata"), page, F.col("url"), F.col("digest")), [("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", at), ("Content-Type", F.lit("application/warc-fields"))], fields)
    records = rows.select("bytes", F.explode(F.array(request, reply, about)).alias("value"))
    # Captures are written by size class, so that one very long page doesn't make all files small; a class that is empty costs nothing.
    size = F.col("bytes")
    edges = [0, *SIZE_CLASSES]
    classes = pages.agg(*[F.max(F.when((F.coalesce(F.octet_length(html_col), F.lit(0)) >= low) & (F.coalesce(F.octet_length(html_col), F.lit(0)) < (edges[k + 1] if k + 1 < len(edges) else 1 << 62)), F.coalesce(F.octet_length(html_col), F.lit(0)))).alias(f"c{k}") for k, low in enumerate(edges)]).first()
    for k, low in enumerate(edges):
        if classes[k] is not None or k == 0:
            inside = (size >= low) & (size < edges[k + 1]) if k + 1 < len(edges) else size >= low
            per_file = 3 * max(1, file_bytes // ((classes[k] or 0) + 2048))
            records.where(inside).select("value").write.mode("append").option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


HEADER_END = re.compile(rb"\r\n\r\n")


def unpacked(content: bytes) -> bytes:
    """The bytes of a file: plain, or gzip of one or many members."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        content = member.unused_data.lstrip(b"\x00")
    return b"".join(parts)


def head_fields(head: bytes) -> dict[str, str]:
    """Named fields of a head, names in lower case; folded lines are joined."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, s, v in (x.partition(b":") for x in lines) if s}


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by Content-Length alone."""
    data, at = unpacked(content), 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = HEADER_END.search(data, at)
        if not data.startswith(b"WARC/", at) or not end:
            raise ValueError(f"no WARC record at byte {at}")
        fields = head_fields(data[at : end.start()].partition(b"\r\n")[2])
        stop = end.end() + int(fields["content-length"])
        if stop > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, data[end.end() : stop]
        at = stop


RECORD = "type string, record_id string, concurrent_to string, target_uri string, date string, digest string, http string, payload_bytes long, payload_digest string, fields map<string,string>"


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row a record. Of a revisit, length and digest are those its heads state of the full payload.

    payload: also the payload itself (binary; null for revisits).
    """
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payload
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())] + [pa.binary()] * payload
    bare = lambda x: x.strip("<>") if x else None

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for content in batch.column(0).to_pylist():
                for head, block in parse(content):
                    kind, body, http, fields = head.get("warc-type"), block, None, {}
                    if head.get("content-type", "").startswith("application/http"):
                        http_head, _, body = block.partition(b"\r\n\r\n")
                        http, fields = http_head.partition(b"\r\n")[0].decode("utf-8", "replace"), head_fields(http_head.partition(b"\r\n")[2])
                    elif head.get("content-type") == "application/warc-fields":
                        fields, body = head_fields(block), b""
                    stated = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    again = kind == "revisit"
                    length = int(fields.get("content-length", 0)) if again else len(body)
                    rows.append((kind, bare(head.get("warc-record-id")), bare(head.get("warc-concurrent-to")), head.get("warc-target-uri"), head.get("warc-date"), stated, http, length, stated if again else hashlib.sha256(body).hexdigest(), list(fields.items()), *([None if again else body] if payload else [])))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

        return each

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_arrow(files, make, RECORD + ", payload binary" * payload)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, request, response (or revisit), metadata, responses.

    Request and metadata records join the response that their WARC-Concurrent-To names. A
    response read several times gives as many rows; records whose response is missing give a row
    without it, so that nothing is lost.
    """
    columns = [c for c in records.columns if c not in ("fields", "concurrent_to")]
    whole = F.struct(*columns, F.to_json("fields").alias("fields"))
    kind = F.when(F.col("type") == "revisit", "response").otherwise(F.col("type"))
    found = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(*[F.max(F.when(kind == k, whole)).alias(k) for k in ("request", "response", "metadata")], F.count_if(kind == "response").alias("responses"))
    again = F.explode(F.sequence(F.lit(1), F.greatest(F.col("responses"), F.lit(1))))
    return found.withColumn("copy", again).drop("copy")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", payload: bool = False) -> DataFrame:
    """Write pages as archives into the shared folder, read them back and assemble the captures."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/logloom/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, html_col)
    return assemble(read_records(spark, path, payload))


def capture_digest(captures: DataFrame, pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Per capture: the page's id, length and digest of the full payload, record type, and which page a revisit refers to."""
    field = lambda name: F.url_decode(F.get_json_object("metadata.fields", f"$.{name}")).cast(id_type(pages, id_col))
    return captures.select(field("pageid").alias(id_col), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), field("referstopageid").alias("refers_to"))
