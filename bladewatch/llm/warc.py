"""WARC archives written from and read into a chunked record table.

A payload is never handled whole outside its table cell: it becomes rows (record id, chunk number, bytes), each with
the digest of everything up to and including that chunk. A chunk becomes a WARC record; the second and later chunks of
a payload are the format's own ``continuation`` segments. Archives are gzipped text files with the record end
``CRLF CRLF`` as separator, written and read by Spark's text source, so that any store Spark reaches will do, failed
writers leave nothing behind and no file is held in memory. The reader is a byte-stream parser that follows
Content-Length, so payloads may hold any bytes, the separator included.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bladewatch.session import scratch_path

CHUNK_BYTES = 64 << 10
END = "\r\n\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
WRITTEN = "1970-01-01T00:00:00Z"  # no capture time is known; a constant keeps reruns equal


def record_types(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                 payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, record_type, refers_to): among equal payloads of at least ``least_bytes`` bytes the
    largest id is the response and the others revisit it. Payloads are equal if length and SHA-1 are.

    A null payload is empty. Rows with equal id and payload: the first written is the response only by its id, so
    all of them are responses. Rows without an id are responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keyed = rows.withColumns({"_bytes": F.octet_length("payload").cast("long"), "_sha1": F.sha1("payload")})
    groups = keyed.filter(F.col("_bytes") >= least_bytes).groupBy("_sha1", "_bytes").agg(
        F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    marked = keyed.join(groups, ["_sha1", "_bytes"], "left")
    revisit = F.col("page_id") < F.col("_last")
    return marked.select(
        "page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_last")).alias("refers_to"))


def chunk_table(typed: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk: page_id, url, record_type, refers_to, chunk_no, chunks, payload_bytes, chunk, digest.

    ``digest`` is the base32 SHA-1 of the payload up to the end of the chunk, so that of the last chunk is the
    payload's. An empty payload has one empty chunk.
    """
    count = F.greatest(F.ceil(F.octet_length("payload") / F.lit(chunk_bytes)).cast("int"), F.lit(1))
    rows = typed.withColumn("chunks", count).withColumn(
        "chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    part = F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})")
    cut = rows.select(
        "page_id", "url", "record_type", "refers_to", "chunk_no", "chunks",
        F.octet_length("payload").cast("long").alias("payload_bytes"), part.alias("chunk"))
    schema = "page_id long, url string, record_type string, refers_to long, chunk_no int, chunks int, " \
             "payload_bytes long, chunk binary, digest string"

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = hashlib.sha1()  # chunks of a payload follow each other, in batches of any size
        for batch in batches:
            out = []
            for number, chunk in zip(batch.column("chunk_no").to_pylist(), batch.column("chunk")):
                if number == 0:
                    state = hashlib.sha1()
                state.update(chunk.as_buffer())
                out.append(base64.b32encode(state.digest()).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "digest"])

    return cut.mapInArrow(digests, schema)


def _record_id(page_id, chunk_no: int, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{chunk_no}/{url}')}>"


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = []
        for r in batch.drop_columns(["chunk"]).to_pylist():
            first, whole = r["chunk_no"] == 0, r["chunks"] == 1
            url = (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
            kind = r["record_type"] if first else "continuation"
            head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {WRITTEN}",
                    f"WARC-Record-ID: {_record_id(r['page_id'], r['chunk_no'], url)}", f"WARC-Target-URI: {url}"]
            if r["page_id"] is not None:
                head.append(f"X-Page-Id: {r['page_id']}")
            if r["record_type"] == "revisit":
                head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                         f"X-Refers-To-Page: {r['refers_to']}", f"X-Payload-Length: {r['payload_bytes']}",
                         f"WARC-Payload-Digest: sha1:{r['digest']}", "Content-Length: 0"]
            else:
                if not whole:
                    head.append(f"WARC-Segment-Number: {r['chunk_no'] + 1}")
                if not whole and not first:
                    head.append(f"WARC-Segment-Origin-ID: {_record_id(r['page_id'], 0, url)}")
                if r["chunk_no"] == r["chunks"] - 1:
                    head += [f"WARC-Payload-Digest: sha1:{r['digest']}"] + (
                        [] if whole else [f"WARC-Segment-Total-Length: {r['payload_bytes']}"])
                head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {r['length']}"]
            lines.append("\r\n".join(head) + END)
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), batch.column("chunk")], ["head", "chunk"])


def write_archives(chunks: DataFrame, path: str) -> None:
    """Writes the chunk table as WARC files below ``path``; a revisit keeps its last chunk's digest and no payload.

    Each task writes one file, whose size follows Spark's partition size; segments of a payload stay in one file.
    """
    kept = chunks.filter("record_type <> 'revisit' OR chunk_no = chunks - 1")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("chunk"))
    rows = kept.withColumn("chunk", body).withColumn("length", F.octet_length("chunk"))
    rows = rows.withColumns({
        "chunk_no": F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("chunk_no")),
        "chunks": F.when(F.col("record_type") == "revisit", 1).otherwise(F.col("chunks"))})
    texts = rows.mapInArrow(_heads, "head string, chunk binary").select(
        F.concat(F.col("head"), F.col("chunk").cast("string")).alias("value"))
    texts.write.option("lineSep", END).option("compression", "gzip").text(path)


class _Parser:
    """Follows a stream of archive bytes and gives (head fields, chunk) per record; holds one record at most."""

    def __init__(self) -> None:
        self.buffer, self.fields, self.need = bytearray(), None, 0

    def feed(self, data: bytes):
        self.buffer += data
        while True:
            if self.fields is None:
                at = self.buffer.find(b"\r\n\r\n")
                if at < 0:
                    return
                lines = bytes(self.buffer[:at]).decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
                self.fields = dict(line.split(": ", 1) for line in lines[1:])
                self.need = int(self.fields["Content-Length"])
                del self.buffer[:at + 4]
            if len(self.buffer) < self.need + 4:
                return
            yield self.fields, bytes(self.buffer[:self.need])
            del self.buffer[:self.need + 4]
            self.fields = None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of the archives, in the order of the files: page_id, url, record_type, refers_to, chunk_no,
    last, payload_bytes and digest (of the payload; only in its last chunk), chunk.

    A gzipped file is one stream and not split, so each reader sees whole files from their start.
    """
    schema = "page_id long, url string, record_type string, refers_to long, chunk_no int, last boolean, " \
             "payload_bytes long, digest string, chunk binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, names = _Parser(), [f.split()[0] for f in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            out = []
            for value in batch.column(0):
                for f, chunk in parser.feed(value.as_py() + b"\r\n\r\n"):
                    digest = f.get("WARC-Payload-Digest")
                    total = f.get("X-Payload-Length") or f.get("WARC-Segment-Total-Length") or len(chunk)
                    out.append((
                        int(f["X-Page-Id"]) if "X-Page-Id" in f else None, f["WARC-Target-URI"], f["WARC-Type"],
                        int(f["X-Refers-To-Page"]) if "X-Refers-To-Page" in f else None,
                        int(f.get("WARC-Segment-Number", 1)) - 1, digest is not None, int(total),
                        digest and digest.removeprefix("sha1:"), chunk))
            columns = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    lines = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(parse, schema)


def verified_records(read: DataFrame) -> DataFrame:
    """One row per record from its chunk rows: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are computed from the bytes that were read, chunk by chunk, and must equal those written; the
    head of a revisit is taken as it is. Rows of one payload follow each other, as ``read_archives`` gives them.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size = hashlib.sha1(), 0
        for batch in batches:
            out = []
            heads = batch.drop_columns(["chunk", "url"]).to_pylist()
            for r, chunk in zip(heads, batch.column("chunk")):
                if r["record_type"] == "revisit":
                    out.append((r["page_id"], r["payload_bytes"], r["digest"], "revisit", r["refers_to"]))
                    continue
                if r["chunk_no"] == 0:
                    state, size = hashlib.sha1(), 0
                data = chunk.as_buffer()
                state.update(data)
                size += data.size
                if r["last"]:
                    digest = base64.b32encode(state.digest()).decode()
                    if digest != r["digest"] or size != r["payload_bytes"]:
                        raise ValueError(f"page {r['page_id']}: the payload read is not the one written")
                    out.append((r["page_id"], size, digest, "response", None))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read.mapInArrow(check, schema)


def archive_round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 0,
                       chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes all pages as archives below ``path`` (a new folder of the shared scratch space if none is given) and
    returns the records read back. No rows give no rows; extra columns are left out."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(chunk_table(record_types(pages, least_bytes), chunk_bytes), path)
    return verified_records(read_archives(spark, path))
