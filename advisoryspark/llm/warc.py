"""WARC archives written and read as a chunked record table (free style: hashlib inside tasks).

Writing: payloads are hashed, equal payloads are found by digest, and every page
becomes one record, response or revisit.  A payload beyond `chunk_bytes` goes out
as segments: the response and its continuation records.  All records of a page are
one row, which Spark's text writer lays down in real WARC/1.1 files; a file rolls
over between rows, so the segments of a payload always lie in one file.

Reading streams a file line by line, so neither a file nor a record is ever held
whole: a payload comes out as rows (record, chunk number, bytes) with the digest
and length of the payload up to that chunk.  A file is read by one task, which
writing bounds with gzip parts of `max_records` pages.

Defined cases: a null payload is empty; a null page id gets a record id of its
own kind and reads back as null; rows that repeat a page id and payload are
records of the same kind; an empty table gives archives without records; other
columns are ignored.
"""

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_CHUNKS = ("record_id string, chunk_no long, record_type string, target_uri string, refers_to string, data binary, "
           "payload_bytes long, payload_digest string, last boolean, intact boolean")
_URN, _NULL_URN = "urn:page:", "urn:page-without-id:"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url",
                 revisits_from: int = 0) -> DataFrame:
    """Pages with `refers_to`, the page a revisit points to (null for a response).

    Payloads of at least `revisits_from` bytes count as equal by SHA-1.  Digests
    are reduced to one row each before the shuffle, so a hot payload costs a row
    per task; the join splits its pages where they are skewed.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"),
                        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = (rows.where(F.octet_length("payload") >= revisits_from).groupBy("digest")
             .agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > 1).select("digest", "response"))
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    return (rows.join(first, "digest", "left")
            .select("id", "uri", "payload", "digest", F.when(revisit, F.col("response")).alias("refers_to")))


def record_id(page_id) -> str:
    return _NULL_URN if page_id is None else f"{_URN}{page_id}"


def _records(row: dict, chunk_bytes: int):
    """The WARC records of one page: head, payload slice."""
    payload, name = memoryview(row["payload"]), record_id(row["id"])
    digest = base32_sha1(bytes.fromhex(row["digest"]))
    head = [f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', row['uri'] or '')}"]
    whole = [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if row["refers_to"] is not None:
        yield ["WARC-Type: revisit", *head, *whole, f"WARC-Refers-To: <{record_id(row['refers_to'])}>",
               "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"], payload[:0]
        return
    parts = range(0, max(1, len(payload)), chunk_bytes)
    for n, at in enumerate(parts, 1):
        extra = [] if len(parts) == 1 else [f"WARC-Segment-Number: {n}"]
        if len(parts) > 1 and n == len(parts):
            extra.append(f"WARC-Segment-Total-Length: {len(payload)}")
        if n == 1:
            yield ["WARC-Type: response", *head, *whole, *extra], payload[at:at + chunk_bytes]
        else:
            yield ["WARC-Type: continuation", f"WARC-Record-ID: <{name}:{n}>", *head[1:], *extra,
                   f"WARC-Segment-Origin-ID: <{name}>"], payload[at:at + chunk_bytes]


def write(planned: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, max_records: int = 20_000) -> None:
    """Write the planned records as gzip WARC files of at most `max_records` pages under `path`.

    A row takes as many bytes as the payload it was made from, and headers.
    """
    def build(batches):
        for batch in batches:
            out, size = [], 0
            for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                parts = []
                for head, part in _records(row, chunk_bytes):
                    text = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(part)}", "", ""])
                    parts += text.encode(), part, b"\r\n\r\n"
                # The writer ends each row with the last \n of the two empty lines behind a record.
                parts[-1] = b"\r\n\r"
                out.append(b"".join(parts))
                size += len(out[-1])
                if size > 8 << 20:
                    yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    (planned.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path))


class _Reader:
    """State of one file: the open record and the running digest of its payload."""

    def __init__(self, chunk_bytes: int):
        self.chunk_bytes = chunk_bytes
        self.origin = self.digest = None
        self.head: dict[str, str] | None = None
        self.left = -1
        self.rows: list[tuple] = []

    def line(self, raw: bytes):
        """Take a line without its \\n."""
        if self.left < 0:
            text = raw.rstrip(b"\r")
            if self.head is None:
                if text.startswith(b"WARC/"):
                    self.head = {}
            elif text:
                name, _, value = text.decode("utf-8", "replace").partition(":")
                self.head[name.strip().lower()] = value.strip()
            else:
                self._open()
            return
        part = raw + b"\n"
        take = min(self.left, len(part))
        self.parts.append(part[:take])
        self.held += take
        self.left -= take
        if self.held >= self.chunk_bytes or not self.left:
            self._chunk()

    def _open(self):
        head = self.head
        name = head.get("warc-segment-origin-id", head.get("warc-record-id", "")).strip("<>")
        if head.get("warc-type") != "continuation":
            self.digest, self.total, self.number, self.declared = hashlib.sha1(), 0, 0, head
        elif name != self.origin:  # its start is in another file: only its own bytes are known
            self.digest, self.total, self.number, self.declared = hashlib.sha1(), 0, 0, {}
        self.origin = name
        self.left, self.parts, self.held = int(head["content-length"]), [], 0
        if not self.left:
            self._chunk()

    def _chunk(self):
        data = b"".join(self.parts)
        self.digest.update(data)
        self.total += len(data)
        head, declared = self.head, self.declared
        segmented = "warc-segment-number" in head
        last = not self.left and (not segmented or "warc-segment-total-length" in head)
        digest, total = base32_sha1(self.digest.digest()), self.total
        kind = declared.get("warc-type")
        want = declared.get("warc-payload-digest", "").rpartition(":")[2]
        intact = None
        if kind == "revisit":  # names the whole payload without holding it
            digest, total = want, int(declared.get("warc-payload-length", 0))
        elif last and want:
            intact = want == digest
        self.rows.append((self.origin, self.number, kind, declared.get("warc-target-uri"),
                          declared.get("warc-refers-to", "").strip("<>") or None, data, total, digest, last, intact))
        self.number += 1
        self.parts, self.held = [], 0
        if not self.left:
            self.left, self.head = -1, None


def read(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of all records in the gzip WARC files under `path` (plain files would be split inside records).

    payload_bytes and payload_digest are those of the payload up to and with the
    chunk (of the whole payload for a revisit, which has one empty chunk); `last`
    marks the final chunk and `intact` says there whether the digest holds.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"))
    fields = ["record_id", "chunk_no", "record_type", "target_uri", "refers_to", "data", "payload_bytes",
              "payload_digest", "last", "intact"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(),
             pa.bool_(), pa.bool_()]

    def parse(batches):
        reader, file = None, None
        for batch in batches:
            files = batch.column("file").dictionary_encode()
            names, codes = files.dictionary.to_pylist(), files.indices.to_pylist()
            for code, raw in zip(codes, batch.column("line").to_pylist()):
                if names[code] != file:
                    held = reader.rows if reader else []
                    reader, file = _Reader(chunk_bytes), names[code]
                    reader.rows = held
                reader.line(raw)
                if len(reader.rows) >= 256:
                    yield flush(reader)
        if reader and reader.rows:
            yield flush(reader)

    def flush(reader):
        rows, reader.rows = reader.rows, []
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=fields)

    return lines.mapInArrow(parse, _CHUNKS)


def page_id(name: str) -> Column:
    """The page id in the record id column `name`, null where the page had none."""
    return F.when(F.col(name).startswith(_URN), F.substring(F.col(name), len(_URN) + 1, 64).cast("long"))
