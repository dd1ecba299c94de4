"""Web archives: one gzip member per record, written and read one record after the other.

The reader inflates a member at a time with zlib as bytes come in, frames each block by its Content-Length, and
checks block and payload digests while the bytes pass; it holds one read buffer, not a record. Records whose payload
another record already holds are written as revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_schema, new_folder, open_filesystem, qualified, saved, sliced, text_or_empty

# Fixed values of the format.
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"

LEVEL = 6
ARCHIVE = 256 << 20  # bytes after which a task begins its next archive
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "archive string, records long, bytes long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value without characters that would end the line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE, level: int = LEVEL) -> bytes:
    """The gzip member of one record; a record that refers to another is a revisit and leaves the payload out."""
    name = PAGE + ("none" if page_id is None else str(page_id))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
        ("WARC-Page-ID", name),
        ("WARC-Date", date),
        ("WARC-Target-URI", _line(url) if url else name),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        refers = PAGE + str(refers_to)
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, refers)}>"),
            ("WARC-Refers-To-Page-ID", refers),
        ]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


class Members:
    """Inflated bytes of one gzip member after the other from a stream."""

    def __init__(self, stream, chunk: int = 1 << 16):
        self.stream, self.chunk = stream, chunk
        self.raw = b""
        self.inflate = None
        self.ready = b""

    def begin(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        if self.inflate is not None and not self.inflate.eof:
            raise ValueError("a record ended before its member")
        if not self.raw:
            self.raw = self.stream.read(self.chunk)
        if not self.raw:
            return False
        self.inflate, self.ready = zlib.decompressobj(31), b""
        return True

    def more(self) -> bytes:
        """Some further bytes of the member; empty at its end."""
        if self.ready:
            out, self.ready = self.ready, b""
            return out
        while not self.inflate.eof:
            if not self.raw:
                self.raw = self.stream.read(self.chunk)
                if not self.raw:
                    raise ValueError("the archive ends within a member")
            out = self.inflate.decompress(self.raw, 1 << 18)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                return out
        return b""

    def back(self, data: bytes) -> None:
        self.ready = data + self.ready


def _until_blank(members: Members) -> bytes:
    """Bytes up to and with the first empty line; what follows stays in the stream."""
    held = b""
    while (at := held.find(b"\r\n\r\n")) < 0:
        more = members.more()
        if not more:
            raise ValueError("headers without an end")
        held += more
    members.back(held[at + 4 :])
    return held[: at + 4]


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _is_http(head: dict[str, str]) -> bool:
    return head.get("content-type", "").replace(" ", "").lower().startswith("application/http")


class _Digest:
    """A stated digest and the hash of the bytes that shall have it; algorithms this Python lacks are not checked."""

    def __init__(self, stated: str | None):
        name, _, value = (stated or "").rpartition(":")
        self.value, self.hash = value, None
        if stated and (name or "sha1").lower() in hashlib.algorithms_available:
            self.hash = hashlib.new((name or "sha1").lower())

    def update(self, data: bytes) -> None:
        if self.hash:
            self.hash.update(data)

    def fits(self) -> bool:
        if not self.hash:
            return True
        raw = self.hash.digest()
        return self.value.upper().rstrip("=") in (base64.b32encode(raw).decode().rstrip("="), raw.hex().upper())


def _length(value: str | None) -> int | None:
    return int(value) if value and value.strip().isdigit() else None


def records(stream, with_payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order; ValueError where framing or a stated digest is wrong.

    Any WARC/1.x archive with a gzip member per record, whoever wrote it: a block is framed by Content-Length. Of a block
    of HTTP the payload begins after the message's headers, of any other it is the block. Records without the
    page id of this library have a null page_id; digests are checked where the record states them.
    """
    members = Members(stream)
    while members.begin():
        raw = _until_blank(members)
        if not raw.startswith(VERSIONS):
            raise ValueError("not a WARC record")
        head = _headers(raw)
        left = _length(head.get("content-length"))
        if left is None or "warc-type" not in head:
            raise ValueError("a record without type or Content-Length")
        revisit = head["warc-type"] == "revisit"
        stated = head.get("warc-payload-digest")
        block, payload = _Digest(head.get("warc-block-digest")), _Digest(None if revisit else stated)
        own, kept, size = hashlib.sha1(), [], 0
        http = b"" if _is_http(head) else None  # the message's headers so far; None once the payload is reached
        message = {}
        while left > 0:
            data = members.more()
            if not data:
                raise ValueError("a block is shorter than its Content-Length")
            if len(data) > left:
                members.back(data[left:])
                data = data[:left]
            left -= len(data)
            block.update(data)
            if http is not None:
                http += data
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    continue
                message, data, http = _headers(http[:at]), http[at + 4 :], None
            size += len(data)
            own.update(data)
            payload.update(data)
            if with_payload:
                kept.append(data)
        end = b""
        while more := members.more():
            end += more
        if end != b"\r\n\r\n":
            raise ValueError("a block is longer than its Content-Length")
        if not block.fits():
            raise ValueError("a block does not have its digest")
        if not payload.fits():
            raise ValueError("a payload does not have its digest")
        page, refers = head.get("warc-page-id", "").removeprefix(PAGE), head.get("warc-refers-to-page-id", "").removeprefix(PAGE)
        short = (stated or "").rpartition(":")[2]
        yield {
            "page_id": _length(page) if not page.startswith("-") else -_length(page[1:]),
            "url": head.get("warc-target-uri"),
            "payload_bytes": _length(message.get("content-length")) if revisit else size,
            "payload_digest": short if revisit else base64.b32encode(own.digest()).decode(),
            "record_type": head["warc-type"],
            "refers_to": int(refers) if refers else None,
            "payload": b"".join(kept) if with_payload else None,
        }


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0
) -> str:
    """Write a record per row and return the folder.

    Of rows with equal payloads of at least `min_revisit` bytes that with the smallest id is a response and the
    others revisit it; shorter payloads are all responses. Null html is an empty payload. Rows without an id revisit
    the smallest id with their payload, or are responses where there is none; rows repeated with id and payload are
    all responses. Other columns are not read; an empty table gives no archive. Payloads are compared by SHA-1 and
    length before anything is shuffled; only payloads that occur twice are joined back, an archive gets its name when
    it is complete.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder) if folder else new_folder(spark, "warc")
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), text_or_empty(pages[html_col]).cast("binary").alias("payload")
    ).select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    equal = rows.where(F.col("size") >= min_revisit).groupBy("digest", "size")
    equal = equal.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    # As a table of its own, so that a hot payload can be split in the join.
    equal = saved(equal.select("digest", "size", "first"), "payloads")
    rows = rows.join(equal, ["digest", "size"], "left").select(
        "page_id", "url", "payload", F.expr("case when page_id <=> first then null else first end").alias("refers_to")
    )
    filesystem, base = open_filesystem(folder)
    filesystem.create_dir(base, recursive=True)
    schema = arrow_schema(MANIFEST)

    def write(batches):
        filesystem, base = open_filesystem(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        file, at, n, done = None, 0, 0, []

        def close():
            name = f"part-{part:06d}-{len(done):04d}.warc.gz"
            file.close()
            filesystem.move(f"{base}/_{part}-{attempt}", f"{base}/{name}")
            done.append((name, n, at))

        for batch in sliced(batches, 256):
            for row in batch.to_pylist():
                if file is None:
                    # pyarrow would compress a file named .gz by itself.
                    file, at, n = filesystem.open_output_stream(f"{base}/_{part}-{attempt}", compression=None), 0, 0
                data = member(row["page_id"], row["url"], row["payload"], row["refers_to"])
                file.write(data)
                at, n = at + len(data), n + 1
                if at >= ARCHIVE:
                    close()
                    file = None
        if file is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/_manifest")
    return folder


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the archives of a folder: of its manifest or, where another program wrote it, all files *.warc.gz.

    Of a listing only the names are read, by Spark's file source.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("archive")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"))


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for.

    A revisit's payload_bytes and payload_digest are those stated for the payload it stands for; its payload is null here.
    Archives of other programs are read as well (see `records`); their page_id and refers_to are null.
    """
    folder = qualified(spark, folder)
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (
        ", payload binary" if with_payload else ""
    )
    schema = arrow_schema(ddl)

    def read(batches):
        filesystem, base = open_filesystem(folder)
        for batch in batches:
            for name in batch.to_pydict()["archive"]:
                with filesystem.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    held, size = [], 0
                    for record in records(stream, with_payload):
                        if record["record_type"] == "revisit":
                            record["payload"] = None
                        held.append(record)
                        size += len(record["payload"] or b"")
                        if len(held) >= 1024 or size >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return archives_in(spark, folder).repartition(max(1, spark.sparkContext.defaultParallelism * 4), "archive").mapInArrow(read, ddl)
