"""WARC archives with revisit records for repeated payloads.

Headers alone are shuffled by payload digest to find, for each payload, the page that keeps it: the one with the largest
id. The archives are then written with fresh headers, a response for that page and revisits that refer to it for the
others. A file holds about file_bytes of compressed records (one record more at most), each a gzip member of its own after
one of a warcinfo record, and its name ends in .warc.gz. Files are written through Spark's own text writer, a row of bytes
to a file, so any file system that Spark reaches will do, and the commit protocol covers lost executors; that writer's line
end is an empty gzip member, which readers pass over. Reading goes from member to member, so a task holds a file as it is
stored and one record of it. The few payloads that hold a large part of all pages (at most 1,000) are looked up in a
broadcast, so no join deals their pages to one task.

Null html is an empty payload, null ids are less than any other; rows with one id and one payload are all responses if
that id is the largest. An empty table gives an empty folder and no rows; other columns than the three named are ignored."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, hadoop_path, lookup, shared_dir, small_batches

CRLF = "\r\n"
END = CRLF * 2
#: Compressed bytes at which a file ends.
FILE_BYTES = 32 << 20
#: Fixed, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"


def member(data: bytes = b"") -> bytes:
    """A gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str | None) -> str:
    """A header's value on one line of ASCII."""
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def record_id(page: object, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page} {payload_digest}')}>"


def information(first: str) -> str:
    """The warcinfo record of the file whose first record has that id."""
    body = f"software: strataform{CRLF}format: WARC File Format 1.1{CRLF}"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, first)}>", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return CRLF.join(head) + END + body


def record(page: object, url: str | None, payload: str, payload_digest: str, refers_to: object) -> str:
    """A WARC record without its end; refers_to: the page of the response that a revisit repeats."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
    body = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, payload_digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest}", f"Page-ID: {'' if page is None else page}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, payload_digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body.encode())}"]
    return CRLF.join(head) + END + body


def members(data: bytes | memoryview, step: int = 1 << 15) -> Iterator[bytes]:
    """What each gzip member of a file holds, but for empty ones; step: bytes that are looked at together."""
    data, at = memoryview(data), 0
    while at < len(data):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("open gzip member")
            piece = data[at : at + step]
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        if any(out):
            yield b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (with names in lower case) and content of each record in the bytes."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = stop + 4
        at = start + int(head["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at byte {at}")
        yield head, data[start:at]
        at += 4


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest and payload_bytes of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            payloads = [(x.as_py() or "").encode() for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([digest(x) for x in payloads], pa.string()), pa.array([len(x) for x in payloads], pa.int64())], names=["page_id", "payload_digest", "payload_bytes"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, payload_digest string, payload_bytes long")


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """payload_digest, original (its largest page id) and n, the pages, of payloads that several pages have."""
    groups = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
    return groups.agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("payload_bytes")


def write(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives of all pages as files under path."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    originals = cut_lineage(resolve(headers(pages), min_bytes))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest((x.as_py() or "").encode()) for x in batch.column("html")], pa.string())], names=["page_id", "url", "html", "payload_digest"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema)
    rows = lookup(pages.mapInArrow(keyed, f"{kinds}, payload_digest string"), originals, "payload_digest", "n")
    rows = rows.select("page_id", "url", "html", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")).alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[bytes] = []
        size = 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(own)], pa.binary())], names=["value"])

        for batch in small_batches(batches, "html"):
            for p, u, h, d, r in zip(*(c.to_pylist() for c in batch.columns)):
                if not own:
                    own.append(member((information(record_id(p, d)) + END).encode()))
                own.append(member((record(p, u, h or "", d, r) + END).encode()))
                size += len(own[-1])
                if size >= file_bytes:
                    yield file()
                    own, size = [], 0
        if own:
            yield file()

    out = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", member().decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 1).mode("overwrite").text(path)
    fs, folder = hadoop_path(pages.sparkSession, path)
    for status in fs.listStatus(folder):
        own = status.getPath()
        if own.getName().endswith(".txt"):
            fs.rename(own, hadoop_path(pages.sparkSession, f"{path}/{own.getName().removesuffix('.txt')}.warc.gz")[1])


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The records of the archives under path, revisits joined to the responses that they refer to: page_id, url,
    payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("content"):
                rows = []
                for head, content in (x for data in members(file.as_buffer()) for x in parse(data)):
                    if head["warc-type"] == "warcinfo":
                        continue
                    own, response = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "response"
                    size = None
                    if response:
                        body = content.partition(b"\r\n\r\n")[2]
                        size = len(body)
                        if digest(body) != own:
                            raise ValueError(f"the payload of {head['warc-record-id']} doesn't have its digest")
                    rows.append({"page_id": head["page-id"] or None, "url": head["warc-target-uri"], "payload_bytes": size, "payload_digest": own, "record_type": head["warc-type"], "_id": head["warc-record-id"], "_to": head.get("warc-refers-to")})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=out)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("_id", pa.string()), ("_to", pa.string())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    rows = files.mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, _id string, _to string")
    rows = cut_lineage(rows.withColumn("page_id", F.col("page_id").cast(id_type)))
    wanted = rows.where("_to is not null").groupBy("_to").agg(F.count(F.lit(1)).alias("_n"))
    # a response that rows with one id and payload repeat counts once
    first = rows.where("record_type = 'response'").groupBy(F.col("_id").alias("_to")).agg(F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"))
    joined = lookup(rows, cut_lineage(first.join(wanted, "_to")), "_to", "_n")
    return joined.select("page_id", "url", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("_page").alias("refers_to"))


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", **options) -> DataFrame:
    """pages written as archives into the shared folder and read back from them; the archives go afterwards."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes, id_col=id_col, **options)
    out = read(spark, path, pages.schema[id_col].dataType.simpleString())
    fs, folder = hadoop_path(spark, path)
    fs.delete(folder, True)  # the rows have been written to a checkpoint
    return out
