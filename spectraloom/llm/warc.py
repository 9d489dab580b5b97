"""WARC: archives written and read with Spark, and transactions assembled from their records.

Each page is a capture of three records: a response (or a revisit, where a response with an equal payload exists),
a request and a metadata record, tied by WARC-Concurrent-To. Archives are gzip files of WARC/1.1
records, written by Spark's text writer (one record a row, the record end as line separator) and read
as binary files, record by record by Content-Length. Assembly joins requests and metadata to
captures on the identifier they are concurrent to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import NO_ID, map_arrow, materialize, own_id, shared_dir

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file ends with the record that takes it past this many bytes, which bounds what a reading task holds compressed.
FILE_BYTES = 32 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: RFC 4122's name space of URLs


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, record_id: str, uri: str, block: bytes, media_type: str, more: dict[str, str]) -> str:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": "2025-01-01T00:00:00Z", "WARC-Target-URI": uri, "Content-Type": media_type, "Content-Length": str(len(block))} | more
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n" + block.decode()


def _urn(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def capture(page_id: int, url: str | None, html: str, keeper: int) -> list[str]:
    """Records of one page; keeper is the largest page_id with an equal payload."""
    data = html.encode()
    uri = "".join((url or "about:blank").split())
    host, digest = (uri.split("//", 1)[-1].split("/", 1)[0] or "localhost"), digest32(data)
    own = _urn(page_id, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(data)
    marks = {"WARC-Payload-Digest": f"sha1:{digest}"}
    if keeper == page_id:
        main = _record("response", own, uri, http + data, "application/http; msgtype=response", marks)
    else:
        main = _record("revisit", own, uri, http, "application/http; msgtype=response", marks | {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(keeper, digest)})
    tie = {"WARC-Concurrent-To": own}
    ask = f"GET {uri} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    fields = f"pageId: {page_id}\r\npayloadLength: {len(data)}\r\n".encode() + (f"refersToPage: {keeper}\r\n".encode() if keeper != page_id else b"")
    return [
        main,
        _record("request", f"<urn:uuid:{uuid.uuid4()}>", uri, ask, "application/http; msgtype=request", tie),
        _record("metadata", f"<urn:uuid:{uuid.uuid4()}>", uri, fields, "application/warc-fields", tie),
    ]


def write(pages: DataFrame, path: str) -> None:
    """Write all rows of pages (page_id, url, html; a null html is empty) as archives under path.

    Of rows with equal payloads those with the largest page_id are responses, the others revisit
    them. The largest is found by a pre-aggregated group-by and joined back from a
    written table, so that AQE can split a payload that many pages share.
    """
    rows = pages.select(F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload", F.sha1(F.col("html").cast("binary")))
    last = materialize(rows.groupBy("payload").agg(F.max("page_id").alias("keeper")), "keepers")

    def records(batches: Iterator[dict]) -> Iterator[dict]:
        written = 0
        for cols in batches:
            for at in range(0, len(cols["page_id"]), 200):
                value = [r for x in zip(*(cols[c][at : at + 200] for c in ("page_id", "url", "html", "keeper")), strict=True) for r in capture(*x)]
                part = []
                for r in value:
                    part.append(written // FILE_BYTES)
                    written += len(r.encode())
                yield {"value": value, "part": part}

    out = map_arrow(rows.join(last, "payload"), ["page_id", "url", "html", "keeper"], "value string, part long", records)
    out.write.partitionBy("part").option("lineSep", END).option("compression", "gzip").text(path)


def _read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if line.rstrip(b"\r\n") == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


RECORD = "type string, record_id string, concurrent_to string, refers_to string, uri string, declared_digest string, payload_digest string, payload_bytes long, fields map<string,string>, block binary"


def read(spark: SparkSession, path: str, with_block: bool = False) -> DataFrame:
    """One row a record of the archives under path; payload facts are worked out from the bytes read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for cols in batches:
            for content in cols["content"]:
                part: list[tuple] = []
                for head, block in _read_records(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    kind = head["warc-type"]
                    data = block.partition(END.encode())[2] if kind == "response" else None
                    pairs = [x.partition(": ")[::2] for x in block.decode().split("\r\n") if ": " in x] if kind == "metadata" else []
                    declared = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    own = (digest32(data), len(data)) if data is not None else (None, None)
                    part.append((kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), declared, *own, pairs, block if with_block else None))
                    if len(part) == 500:
                        yield dict(zip(names, map(list, zip(*part, strict=True)), strict=True))
                        part = []
                if part:
                    yield dict(zip(names, map(list, zip(*part, strict=True)), strict=True))

    return map_arrow(files, ["content"], RECORD, rows)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: record_id, and structs main, request and metadata (null where absent).

    Captures with one identifier (repeated rows) are numbered, and so are the records concurrent to it: the n-th goes
    with the n-th.
    """
    numbered = lambda df, key: df.withColumn("copy", F.row_number().over(Window.partitionBy(key).orderBy("uri", "record_id")))
    keys = ["record_id", "copy"]
    main = numbered(records.where("type in ('response', 'revisit')"), "record_id")
    out = main.select(*keys, F.struct("type", "refers_to", "uri", "declared_digest", "payload_digest", "payload_bytes", "block").alias("main"))
    for kind in ("request", "metadata"):
        side = numbered(records.where(F.col("type") == kind).where("concurrent_to is not null"), "concurrent_to")
        side = side.select(F.col("concurrent_to").alias("record_id"), "copy", F.struct(F.col("record_id").alias("id"), "fields", "block").alias(kind))
        out = out.join(side, keys, "left")
    return out


def page_archive(pages: DataFrame) -> DataFrame:
    """Write pages as archives, read these back and return a row a capture (see the columns)."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    captures = assemble(materialize(read(spark, path), "records"))
    field = lambda k: F.element_at("metadata.fields", F.lit(k)).cast("long")
    return captures.select(
        field("pageId").alias("page_id"),
        F.coalesce("main.payload_bytes", field("payloadLength")).alias("payload_bytes"),
        F.coalesce("main.payload_digest", "main.declared_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        F.when(F.col("main.type") == "revisit", F.nullif(field("refersToPage"), F.lit(NO_ID))).alias("refers_to"),
        F.col("main.uri").alias("uri"),
        F.col("record_id"),
    ).withColumn("page_id", own_id("page_id"))
