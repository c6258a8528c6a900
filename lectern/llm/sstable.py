"""Sorted-string-table shards of token ids.

A shard holds documents in ascending order of identifier. Keys are prefix-
compressed inside blocks, with a full key at every RESTART-th entry; a sparse
index has the last key and place of each block, a Bloom filter has all keys, and
a footer of fixed size at the end says where they are. A lookup reads the footer,
asks the filter, searches the index by halves, then the restarts of one block.

File: blocks | index | filter | JSON facts | footer (6 little-endian uint64: place
and size of index, filter, facts; 8 bytes MAGIC). Block: zstd frame of entries,
then the uint32 offsets of restarts and their number. Entry: varint shared, varint
rest, varint bytes of value, rest of key, value (ids, little-endian, 2 bytes where
the vocabulary has at most 65,536 ids, else 4).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import memory, scratch, tokens

MAGIC = b"LECSST01"
RESTART = 16
BLOCK_BYTES = 64 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 0
#: Memo entries and bytes of text at a time of a writing task, which has its executor to itself.
MEMO, GROUP_CHARS = 1_500_000, 16_000_000


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do, null first."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(key: bytes, size: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % size for i in range(BLOOM_HASHES)]


class Writer:
    def __init__(self, out, width: int):
        self.out, self.width, self.place = out, width, 0
        self.squeeze = zstandard.ZstdCompressor(level=1)
        self.block, self.restarts, self.last, self.n = bytearray(), [], b"", 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.facts = {"docs": 0, "tokens": 0, "width": width}

    def add(self, key: bytes, ids: np.ndarray) -> None:
        """Keys come in ascending order; a repeated key is kept as often as it comes."""
        shared = 0
        if self.n % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        self.keys.append(key)
        self.facts["docs"] += 1
        self.facts["tokens"] += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.place += len(data)
        return self.place - len(data), len(data)

    def _flush(self) -> None:
        if self.n:
            tail = np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
            self.index.append((self.last, *self._put(self.squeeze.compress(bytes(self.block) + tail))))
            self.block, self.restarts, self.n = bytearray(), [], 0

    def close(self) -> dict:
        self._flush()
        size = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray(size // 8 + 1)
        for key in self.keys:
            for bit in _bits(key, size):
                bloom[bit >> 3] |= 1 << (bit & 7)
        self.facts["bloom_bits"] = size
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        places = [*self._put(index), *self._put(bytes(bloom)), *self._put(json.dumps(self.facts).encode())]
        self._put(struct.pack("<6Q", *places) + MAGIC)
        return self.facts


class Reader:
    """Reads a shard from any seekable file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        tail = self._get(size - 56, 56)
        if tail[-8:] != MAGIC:
            raise ValueError("not a shard of this format")
        a, an, b, bn, c, cn = struct.unpack("<6Q", tail[:48])
        self.facts = json.loads(self._get(c, cn))
        self.bloom, index, at = self._get(b, bn), self._get(a, an), 0
        self.blocks: list[tuple[bytes, int, int]] = []
        while at < len(index):
            n, at = _read_varint(index, at)
            key, at = index[at : at + n], at + n
            place, at = _read_varint(index, at)
            length, at = _read_varint(index, at)
            self.blocks.append((key, place, length))

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, i: int) -> tuple[bytes, np.ndarray]:
        data = zstandard.ZstdDecompressor().decompress(self._get(*self.blocks[i][1:]))
        n = struct.unpack("<I", data[-4:])[0]
        return data[: -4 * (n + 1)], np.frombuffer(data[-4 * (n + 1) : -4], "<u4")

    def _entries(self, data: bytes, at: int = 0) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{self.facts['width']}", size // self.facts["width"], at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self._entries(self._block(i)[0])

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[bit >> 3] >> (bit & 7) & 1 for bit in _bits(key, self.facts["bloom_bits"]))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry with this key."""
        found: list[np.ndarray] = []
        if not self.may_have(key):
            return found
        i = bisect_left(self.blocks, key, key=lambda b: b[0])
        while i < len(self.blocks):
            data, restarts = self._block(i)
            lo, hi = 0, len(restarts) - 1
            while lo < hi:  # the last restart whose key is smaller
                mid = (lo + hi + 1) // 2
                if next(self._entries(data, int(restarts[mid])))[0] < key:
                    lo = mid
                else:
                    hi = mid - 1
            for k, ids in self._entries(data, int(restarts[lo])):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
            i += 1
        return found


def _open(path: str, how: str):
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    if how == "r":
        return system.open_input_file(inside)
    system.create_dir(inside.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inside)


def write(docs: DataFrame, vocabulary: str, path: str, spaced: bool = True, end_id: int = END_ID) -> DataFrame:
    """Writes shards of the documents' ids under path; returns the manifest, one row for each shard.

    docs: doc_id, text (null: empty); other columns are ignored. Rows are dealt to
    shards by ranges of (doc_id, hash of text), so that a doc_id held by very many
    rows spreads too; rows with equal doc_id follow each other by text. A lost
    task's file is never named in the manifest. An empty table gives no shard.
    """
    spark = docs.sparkSession
    text = spark.sparkContext.broadcast(vocabulary)
    shards = f"{path}/shards"

    def shard(batches):
        enc = tokens.encoder(text.value, spaced, MEMO)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 65_536 else 4
        k, out, writer = TaskContext.get().partitionId(), None, None
        end = np.array([end_id], "<u4")
        first = key = None
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in tokens.groups(texts, GROUP_CHARS):
                ids, at = enc.encode(texts.slice(a, b - a))
                for i in range(b - a):
                    if writer is None:
                        name = f"{shards}/shard-{k:06d}-{uuid.uuid4().hex[:12]}.sst"
                        out = _open(name, "w")
                        writer = Writer(out, width)
                    key = key_of(ids_of[a + i])
                    first = first or key
                    writer.add(key, np.concatenate((ids[at[i] : at[i + 1]], end)))
        if writer is not None:
            facts = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int64()), "file": [name], "docs": pa.array([facts["docs"]], pa.int64()), "tokens": pa.array([facts["tokens"]], pa.int64()), "first_key": pa.array([first], pa.binary()), "last_key": pa.array([key], pa.binary())})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("__h"))
    dealt = rows.repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h", "text").select("doc_id", "text")
    schema = "shard long, file string, docs long, tokens long, first_key binary, last_key binary"
    dealt.mapInArrow(memory.tidy(shard), schema).write.parquet(f"{path}/manifest")
    return spark.read.schema(schema).parquet(f"{path}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens, ids_crc32."""
    n = max(1, manifest.count())
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def scan(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with _open(file, "r") as source:
                    for key, ids in Reader(source):
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(n, "shard").select("file", "base").mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of each wanted doc_id (a column of that name) that the shards hold, by binary search.

    A shard gets the wanted ids between its first and last key; the manifest has
    one row for each shard. Repeated documents come as often as they were written.
    """
    spans = manifest.select("file", F.hex("first_key").alias("__a"), F.hex("last_key").alias("__b"))
    biased = F.expr("CASE WHEN doc_id IS NULL THEN '00' ELSE concat('01', lpad(hex(doc_id ^ -9223372036854775808L), 16, '0')) END")
    asked = wanted.select("doc_id", biased.alias("__k")).distinct()

    def find(batches):
        for batch in batches:
            rows = []
            asked = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda x: x[0])
            file = source = reader = None
            for name, doc_id in asked:
                if name != file:
                    if source is not None:
                        source.close()
                    source = _open(name, "r")
                    file, reader = name, Reader(source)
                rows += [(doc_id, ids.tolist()) for ids in reader.get(key_of(doc_id))]
            if source is not None:
                source.close()
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "ids": pa.array([r[1] for r in rows], pa.list_(pa.int64()))})

    pairs = asked.join(spans, F.col("__k").between(F.col("__a"), F.col("__b"))).select("file", "doc_id")
    return pairs.repartition("file").mapInArrow(find, "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(write(docs, text, scratch.place(spark, "sstable")))
