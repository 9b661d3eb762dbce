"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order::

    block*  index  bloom  footer

* block: zstd-compressed entries; a key is stored as the length it shares with the key before it
  and its rest (varints), the value as its byte length and the ids, little-endian.
* index: for each block its first key, offset, stored and raw length, CRC-32 and entries.
* bloom: bits of a Bloom filter over the keys, ten a key, seven probes.
* footer: offsets and lengths of index and bloom, probes, width of an id, counts, CRC-32 and magic.

A reader finds a key with the filter, a binary search in the index and one block.
Keys are bytes that sort as their identifiers do: a null identifier before all others, then
64-bit integers. Repeated identifiers are kept, each with its value.
"""

from __future__ import annotations

import bisect
import heapq
import pickle
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder

MAGIC = b"IBSSTAB1"
FOOTER = struct.Struct("<QIQIBBQQI8s")
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & (1 << 64) - 1).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % (1 << 64) % bits for i in range(BLOOM_PROBES)]


class Writer:
    """Writes one shard; keys have to come in ascending order."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes, self.pos = out, id_bytes, 0
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self.n_ids = 0
        self.zstd = zstandard.ZstdCompressor(level=1)
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.first, self.last, self.entries = bytearray(), None, b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys are not in order")
        shared_len = 0
        for x, y in zip(key, self.last, strict=False):
            if x != y:
                break
            shared_len += 1
        self.block += _varint(shared_len) + _varint(len(key) - shared_len) + _varint(len(value)) + key[shared_len:] + value
        self.first = key if self.first is None else self.first
        self.last, self.entries = key, self.entries + 1
        self.keys.append(key)
        self.n_ids += len(value) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            data = self.zstd.compress(bytes(self.block))
            self.out.write(data)
            self.index.append(_varint(len(self.first)) + self.first + struct.pack("<QIIII", self.pos, len(data), len(self.block), zlib.crc32(data), self.entries))
            self.pos += len(data)
            self._new_block()

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        tail = index + bloom
        self.out.write(tail)
        head = FOOTER.pack(self.pos, len(index), self.pos + len(index), len(bloom), BLOOM_PROBES, self.id_bytes, len(self.keys), self.n_ids, zlib.crc32(tail), MAGIC)
        self.out.write(head)


class Runs:
    """Entries to be sorted: in memory up to a bound, beyond it in sorted runs in scratch files."""

    def __init__(self, most: int = 64 << 20):
        self.most, self.held = most, 0
        self.rows: list[tuple[bytes, bytes]] = []
        self.files: list = []

    def add(self, key: bytes, value: bytes) -> None:
        self.rows.append((key, value))
        self.held += len(value) + 100
        if self.held >= self.most:
            f = tempfile.TemporaryFile()
            for row in sorted(self.rows):
                pickle.dump(row, f)
            f.seek(0)
            self.files.append(f)
            self.rows, self.held = [], 0

    def in_order(self) -> Iterator[tuple[bytes, bytes]]:
        def read(f):
            while True:
                try:
                    yield pickle.load(f)
                except EOFError:
                    f.close()
                    return

        return heapq.merge(*map(read, self.files), sorted(self.rows))


class Reader:
    """Reads a shard from a file that can seek."""

    def __init__(self, f):
        self.f = f
        size = f.seek(0, 2)
        if size < FOOTER.size:
            raise ValueError("too short for a shard")
        f.seek(size - FOOTER.size)
        at, n_index, bloom_at, n_bloom, _, self.id_bytes, self.n_keys, self.n_ids, crc, magic = FOOTER.unpack(f.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        f.seek(at)
        tail = f.read(n_index + n_bloom)
        if zlib.crc32(tail) != crc:
            raise ValueError("index or filter is damaged")
        self.bloom, self.bits = tail[n_index:], max(64, self.n_keys * BLOOM_BITS)
        self.first: list[bytes] = []
        self.blocks: list[tuple] = []
        pos = 0
        while pos < n_index:
            n, pos = _read_varint(tail, pos)
            self.first.append(tail[pos : pos + n])
            self.blocks.append(struct.unpack_from("<QIIII", tail, pos + n))
            pos += n + 24
        self.dtype = np.dtype(f"<u{self.id_bytes}")

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, stored, raw, crc, entries = self.blocks[i]
        self.f.seek(at)
        data = self.f.read(stored)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        buf = zstandard.ZstdDecompressor().decompress(data, max_output_size=raw)
        pos, key = 0, b""
        for _ in range(entries):
            same, pos = _read_varint(buf, pos)
            more, pos = _read_varint(buf, pos)
            n, pos = _read_varint(buf, pos)
            key = key[:same] + buf[pos : pos + more]
            pos += more
            yield key, np.frombuffer(buf, self.dtype, n // self.id_bytes, pos)
            pos += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        out = []
        for i in range(max(0, bisect.bisect_left(self.first, key) - 1), len(self.first)):
            if self.first[i] > key:
                break
            out += [v for k, v in self.block(i) if k == key]
        return out


MANIFEST = "shard int, path string, n_docs long, n_tokens long, first_id long, last_id long"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, directory: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, append ``end_id`` to each and write shards into ``directory``.

    Documents are dealt by ranges of their identifier, so shard numbers ascend as identifiers do;
    equal identifiers are ordered by their shard (a hash of the text), then their ids. Null texts are empty: only ``end_id``. A null
    identifier sorts first. Returns the manifest, one row for each shard. A task that runs again
    writes a file of its own; the manifest names those of the tasks that were committed.
    """
    spark = docs.sparkSession
    shared.ready(spark)

    def run(batches):
        ctx, enc = TaskContext.get(), encoder(tokenizer)
        dtype = enc.dtype if end_id <= np.iinfo(enc.dtype).max else np.dtype("<u4")
        end = np.array([end_id], dtype).tobytes()
        runs = Runs()
        for b in shared.slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                runs.add(key_of(doc_id), enc.ids(text).astype(dtype, copy=False).tobytes() + end)
        if not runs.rows and not runs.files:
            return
        path = f"{directory}/shard-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.sst"
        store, name = fs.FileSystem.from_uri(path)
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(name, compression=None) as out:
            writer = Writer(out, dtype.itemsize)
            for key, value in runs.in_order():
                writer.add(key, value)
            writer.close()
        row = [ctx.partitionId(), path, len(writer.keys), writer.n_ids, id_of(writer.keys[0]), id_of(writer.keys[-1])]
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["shard", "path", "n_docs", "n_tokens", "first_id", "last_id"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))  # many equal ids don't fall to one task
    return shared.written(dealt.mapInArrow(run, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document in the shards.

    ``start`` counts the ids of all documents before it, over all shards in order.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("path", before.alias("before"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    reader = Reader(f)
                    for i in range(len(reader.blocks)):
                        rows = []
                        for key, ids in reader.block(i):
                            rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
