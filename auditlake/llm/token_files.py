"""Token ids as binary files: one zstandard frame per document under a shared dictionary, found by an offset index.

The dictionary is trained on serialized id arrays of a bounded sample of documents. A shard file is

    magic | header length (u32) | header (JSON) | frames | index | index offset (u64) | documents (u64) | magic

with the header naming the SHA-256 of the dictionary, the width of an id and the end id, and the index holding
doc_id (i64), whether it is set (u8), the frame's offset (u64, one more than documents) and the number of ids (u64).
A short document is read by its index entry and one frame; nothing else of the shard is touched.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_schema, documents_of, new_folder, open_filesystem, qualified, saved, sliced
from auditlake.llm.encoding import encoder

MAGIC = b"TOKENID1"
SAMPLE = 512  # documents that the dictionary is trained on, at most
SAMPLE_CHARS = 16_384  # longer texts are not taken into the sample
DICTIONARY = 65_536  # bytes
LEVEL = 3
SHARD = 64 << 20  # bytes of frames after which a task begins its next shard

MANIFEST = "shard string, place long, documents long, ids long, bytes long"


def train_dictionary(arrays: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary for serialized id arrays; empty where the sample is too small to train one."""
    if sum(map(len, arrays)) < 8 * size:
        size = max(1024, sum(map(len, arrays)) // 16)
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


class ShardWriter:
    def __init__(self, file, header: dict):
        self.file, self.at = file, 0
        self.ids, self.offsets, self.counts = [], [], []
        head = json.dumps(header, sort_keys=True).encode()
        self._put(MAGIC + struct.pack("<I", len(head)) + head)

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, frame: bytes, count: int) -> None:
        self.ids.append(doc_id)
        self.offsets.append(self.at)
        self.counts.append(count)
        self._put(frame)

    def close(self) -> None:
        index = self.at
        self._put(np.array([x or 0 for x in self.ids], "<i8").tobytes())
        self._put(np.array([x is not None for x in self.ids], "u1").tobytes())
        self._put(np.array([*self.offsets, index], "<u8").tobytes())
        self._put(np.array(self.counts, "<u8").tobytes())
        self._put(struct.pack("<QQ", index, len(self.ids)) + MAGIC)
        self.file.close()


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, filesystem, path: str, dictionary: bytes):
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        index, n, magic = struct.unpack("<QQ8s", self.file.read_at(24, size - 24))
        head = self.file.read_at(12, 0)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        self.header = json.loads(self.file.read_at(struct.unpack("<I", head[8:])[0], 12))
        if self.header["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{path} was written with another dictionary")
        raw = self.file.read_at(size - 24 - index, index)
        has = np.frombuffer(raw, "u1", n, 8 * n)
        self.doc_ids = [int(x) if h else None for x, h in zip(np.frombuffer(raw, "<i8", n), has)]
        self.offsets = np.frombuffer(raw[9 * n :], "<u8", n + 1)
        self.counts = np.frombuffer(raw[17 * n + 8 :], "<u8", n)
        self.frames = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        """The ids of the shard's i-th document, its end id last."""
        start, end = int(self.offsets[i]), int(self.offsets[i + 1])
        raw = self.frames.decompress(self.file.read_at(end - start, start))
        out = np.frombuffer(raw, f"<u{self.header['width']}").astype("<u4")
        if len(out) != self.counts[i]:
            raise ValueError("a frame and the index disagree")
        return out

    def close(self) -> None:
        self.file.close()


def _sample(docs: DataFrame, path: str, end_id: int, width: int) -> bytes:
    """The dictionary from a bounded sample of whole documents, chosen by a hash of id and text."""
    total = docs.count()
    share = min(1.0, 2 * SAMPLE / max(total, 1))
    chosen = docs.where(F.length("text") <= SAMPLE_CHARS).where(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) <= int(share * (1 << 20))
    )
    texts = [r.text for r in chosen.select("text").limit(SAMPLE).collect()]
    end = np.array([end_id], "<u4").tobytes()
    return train_dictionary([np.frombuffer(x + end, "<u4").astype(f"<u{width}").tobytes() for x in encoder(path).encode(texts)])


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Write the ids of all documents, each ended by `end_id`, in ascending id order; the folder is returned.

    Null texts count as empty and have the end id alone; rows without an id come first; repeated rows and ids
    stay, each as its own document; an empty table gives a folder without shards. The folder must be one that pyarrow
    reaches as well as Spark (local or mounted, HDFS, S3, GCS); any other is refused. A task streams its range of ids
    and holds one slice of rows. A shard gets its name when it is complete, so a task that runs again replaces it.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder) if folder else new_folder(spark, "tokens")
    docs = documents_of(docs, id_col, text_col)
    width = 2 if max(encoder(tokenizer).size, end_id + 1) <= 1 << 16 else 4
    dictionary = _sample(docs, tokenizer, end_id, width)
    header = {"dictionary": hashlib.sha256(dictionary).hexdigest(), "width": width, "end_id": end_id}
    filesystem, base = open_filesystem(folder)
    filesystem.create_dir(base, recursive=True)
    with filesystem.open_output_stream(f"{base}/dictionary") as file:
        file.write(dictionary)
    schema = arrow_schema(MANIFEST)

    def write(batches):
        filesystem, base = open_filesystem(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_checksum=False)
        end, encode = np.array([end_id], "<u4").tobytes(), encoder(tokenizer).encode
        shard, done = None, []

        def close():
            name = f"shard-{part:06d}-{len(done):04d}"
            bytes_ = shard.at
            shard.close()
            filesystem.move(f"{base}/_{part}-{attempt}", f"{base}/{name}")
            done.append((name, (part << 32) + len(done), len(shard.ids), sum(shard.counts), bytes_))

        for batch in sliced(batches, 256):
            rows = batch.to_pydict()
            for doc_id, raw in zip(rows["doc_id"], encode(rows["text"])):
                if shard is None:
                    shard = ShardWriter(filesystem.open_output_stream(f"{base}/_{part}-{attempt}"), header)
                raw += end
                ids = raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes()
                shard.add(doc_id, compress.compress(ids), len(raw) // 4)
                if shard.at >= SHARD:
                    close()
                    shard = None
        if shard is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/_manifest")
    return folder


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, and the ids where asked for.

    `start` counts the ids of all documents before it. Each shard is read by its index, one frame at a time.
    """
    folder = qualified(spark, folder)
    filesystem, base = open_filesystem(folder)
    with filesystem.open_input_stream(f"{base}/dictionary") as file:
        dictionary = file.read()
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    schema = arrow_schema(ddl)

    def read(batches):
        filesystem, base = open_filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                reader, at = ShardReader(filesystem, f"{base}/{row['shard']}", dictionary), row["first"]
                for low in range(0, len(reader), 512):
                    out = []
                    for i in range(low, min(low + 512, len(reader))):
                        ids = reader.ids(i)
                        out.append((reader.doc_ids[i], at, len(ids), zlib.crc32(ids.tobytes()), *([ids] if with_ids else [])))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                reader.close()

    return saved(shards, "shards").repartition(max(1, spark.sparkContext.defaultParallelism * 4), "shard").mapInArrow(read, ddl)
