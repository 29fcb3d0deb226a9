"""Token files: documents as separately compressed id arrays with a shared, trained Zstandard dictionary.

Layout of a file: magic; header (JSON: id bytes, dictionary hash); one frame per document; an index of
keys, key validity, frame offsets and token offsets; the index's place; magic again. The dictionary lies
beside the files once, named by its hash. A document is read with the index and its own frame alone.

Documents are ordered by key over all files: rows are dealt by ranges of (key, text hash), so that equal
keys can be split, too, and every task encodes, compresses and writes one file as its rows stream by. A
task's file has a name of its own attempt, and only the files of the manifest, which Spark's committer
writes, belong to the result; a lost executor's half-written file is never read.

Defined results: a null text is an empty one and holds only the end id; null keys come first; rows that
repeat are separate documents, in the order of their texts' hashes; an empty table has no file.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deflow.llm import common
from deflow.llm.tokens import encoder

MAGIC = b"DFTOKEN1"
DICTIONARY = 65536      # bytes of the trained dictionary
TRAIN_ROWS = 2000       # documents it is trained on: the documented bound of the sample
TRAIN_TEXT = 2048       # code points of each of them
LEVEL = 3
MANIFEST = "part int, file string, documents long, tokens long"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary from serialized id arrays; raw content where there is too little to train on."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 32 else b"".join(samples)[:size]
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _codec(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


class FileWriter:
    def __init__(self, uri: str, dictionary: bytes, id_bytes: int):
        system, path = place(uri)
        self.out = system.open_output_stream(path)
        self.pack = _codec(dictionary)[0]
        self.id_bytes = id_bytes
        header = json.dumps({"id_bytes": id_bytes, "dictionary": hashlib.sha256(dictionary).hexdigest()}).encode()
        self.at = self._put(MAGIC + struct.pack("<I", len(header)) + header)
        self.keys: list[int | None] = []
        self.frames, self.tokens = [self.at], [0]

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def add(self, key: int | None, ids: bytes) -> None:
        self.at += self._put(self.pack.compress(ids))
        self.keys.append(key)
        self.frames.append(self.at)
        self.tokens.append(self.tokens[-1] + len(ids) // self.id_bytes)

    def close(self) -> None:
        n = len(self.keys)
        self._put(np.array([k or 0 for k in self.keys], "<i8").tobytes() + np.array([k is not None for k in self.keys], "u1").tobytes()
                  + np.array(self.frames, "<u8").tobytes() + np.array(self.tokens, "<u8").tobytes()
                  + struct.pack("<QQ", self.at, n) + MAGIC)
        self.out.close()


@dataclass
class FileReader:
    """Random access to one file; only the index and the frames asked for are read."""

    uri: str
    dictionaries: str

    def __post_init__(self) -> None:
        system, path = place(self.uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, n, magic = struct.unpack("<QQ8s", self.file.read_at(24, size - 24))
        (length,) = struct.unpack("<I", self.file.read_at(4, 8))
        header = json.loads(self.file.read_at(length, 12))
        if magic != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{self.uri} is not a whole token file")
        index = self.file.read_at(size - 24 - at, at)
        keys, valid = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n)
        self.keys = [int(k) if v else None for k, v in zip(keys, valid)]
        self.frames = np.frombuffer(index, "<u8", n + 1, 9 * n)
        self.tokens = np.frombuffer(index, "<u8", n + 1, 9 * n + 8 * (n + 1)).astype(np.int64)
        self.dtype = np.dtype(f"<u{header['id_bytes']}")
        with place(f"{self.dictionaries}/{header['dictionary']}.zdict")[0].open_input_stream(place(f"{self.dictionaries}/{header['dictionary']}.zdict")[1]) as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != header["dictionary"]:
            raise ValueError("the dictionary is not the one the file was written with")
        self.unpack = _codec(dictionary)[1]

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.frames[i]), int(self.frames[i + 1])
        return np.frombuffer(self.unpack.decompress(self.file.read_at(b - a, a)), self.dtype)

    def run(self, first: int, last: int) -> list[np.ndarray]:
        """Documents first to last - 1 with one read."""
        a = int(self.frames[first])
        data = self.file.read_at(int(self.frames[last]) - a, a)
        at = (self.frames[first:last + 1].astype(np.int64) - a).tolist()
        return [np.frombuffer(self.unpack.decompress(data[x:y]), self.dtype) for x, y in zip(at, at[1:])]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write token files of all rows of ``docs`` below ``folder``; the manifest: part, file, documents, tokens."""
    spark = docs.sparkSession
    rows = docs.select(docs[key].cast("long").alias("k"), F.coalesce(docs[text], F.lit("")).alias("t"))
    stretch = rows.select(F.lit("all").alias("g"), F.xxhash64("k", "t").alias("h"), common.window_of(F.col("t"), F.col("k"), TRAIN_TEXT).alias("t"))
    sample = common.hash_sample(stretch, "g", F.col("h"), TRAIN_ROWS).select("t").collect()
    codec = encoder(tokenizer_path)
    dictionary = train(codec.encode(sorted(r["t"] for r in sample)))
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{hashlib.sha256(dictionary).hexdigest()}.zdict") as f:
        f.write(dictionary)
    end = np.array([end_id], codec.dtype).tobytes()
    held = spark.sparkContext.broadcast(dictionary)  # DICTIONARY bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()    # what earlier stages left
        enc, out = encoder(tokenizer_path), None
        part = TaskContext.get().partitionId()
        for b in common.batches_of(batches, 64):
            if out is None:
                name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
                out = FileWriter(f"{folder}/{name}", held.value, enc.dtype.itemsize)
            for k, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                out.add(k, ids + end)
        common.release()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([len(out.keys)], pa.int64()), pa.array([out.tokens[-1]], pa.int64())],
                names=["part", "file", "documents", "tokens"])

    # Rows equal in key and text are dealt by where they were read, so that very many of them are several files.
    dealt = rows.withColumn("h", F.xxhash64("t")).withColumn("p", F.spark_partition_id()).repartitionByRange("k", "h", "p")
    dealt = dealt.sortWithinPartitions("k", "h", "t").select("k", "t")
    common.on_workers(dealt).mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit), file by file."""
    manifest = read_manifest(spark, folder)
    files = max(1, manifest.count())
    # One row per file: the running sum is over files, not documents.
    starts = manifest.withColumn("start", F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = FileReader(f"{folder}/{name}", folder)
                for at in range(0, len(r.keys), 256):
                    last = min(at + 256, len(r.keys))
                    ids = [x.astype("<u4").tobytes() for x in r.run(at, last)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.keys[at:last], pa.int64()), pa.array(start + r.tokens[at:last]), pa.array(np.diff(r.tokens[at:last + 1])), pa.array(ids, pa.binary())],
                        names=["key", "start", "n_tokens", "ids"])

    return common.on_workers(starts).select("file", "start").repartition(files, "file").mapInArrow(run, "key long, start long, n_tokens long, ids binary")


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or common.shared_path(spark, "tokens")
    write(docs, folder, tokenizer_path, end_id)
    return read(spark, folder).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
