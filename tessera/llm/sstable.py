"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order.  Its data blocks store keys without the prefix
they share with the key before and are compressed on their own; a sparse index names each block's
first key, a Bloom filter answers most lookups of absent documents, and a footer of fixed size at
the end locates both.  A lookup reads the footer, the filter and the index, finds one block by
binary search and opens that block alone.

Layout: blocks | index | filter | footer.  Integers are little-endian; varints are LEB128.

* block: zstd of entries (varint shared, varint own, varint value length, own key bytes, value)
* index: zstd of, for each block, varint first key length, first key, varint length, varint rows,
  crc32 of the compressed block
* filter: number of bits, number of probes, the bits, crc32 of all that
* footer: ``FOOTER``, which also holds the index's crc32, the number of rows and ids and the bytes an id takes

What doesn't have its checksum raises ``ValueError``.

A key is eight bytes of the document's id (big-endian, sign bit flipped, so that bytes sort as
numbers) behind 0x01, or 0x00 for a null id, then eight bytes that tell rows with one id apart.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, row_mark
from tessera.llm.tokens import encoder, vocabulary_file

BLOCK = 64 << 10
BITS_PER_KEY, PROBES = 10, 7
FOOTER = struct.Struct("<QIQIQIQQB7s")  # index at, length, filter at, length, blocks, index crc32, rows, ids, id bytes, magic
MAGIC = b"TSSTv2\n"
MANIFEST = "path string, first_key binary, rows long, ids long, bytes long"


def key_of(doc_id: int | None, mark: int = 0) -> bytes:
    head = b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))
    return head + struct.pack(">Q", mark + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


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


def _probes(head: bytes, bits: int, k: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(head)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(k)]


class Writer:
    """Writes one shard to a binary stream; keys must come in ascending order."""

    def __init__(self, stream, width: int, block: int = BLOCK) -> None:
        self.stream, self.width, self.block = stream, width, block
        self.at = self.rows = self.ids = 0
        self.entries, self.size, self.first, self.last, self.n = [], 0, None, b"", 0
        self.index: list[bytes] = []
        self.blocks = 0
        self.heads: list[bytes] = []
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first, self.last = key, b""
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        value = ids.tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.entries.append(entry)
        self.size += len(entry)
        self.last, self.n = key, self.n + 1
        if not self.heads or self.heads[-1] != key[:9]:
            self.heads.append(key[:9])
        self.rows, self.ids = self.rows + 1, self.ids + len(ids)
        if self.size >= self.block:
            self._flush()

    def _flush(self) -> None:
        if self.first is None:
            return
        data = self.pack(b"".join(self.entries))
        self.stream.write(data)
        self.index.append(_varint(len(self.first)) + self.first + _varint(len(data)) + _varint(self.n) + struct.pack("<I", zlib.crc32(data)))
        self.at += len(data)
        self.blocks += 1
        self.entries, self.size, self.first, self.last, self.n = [], 0, None, b"", 0

    def finish(self) -> int:
        """Write what remains, index, filter and footer; returns the shard's bytes."""
        self._flush()
        index = self.pack(b"".join(self.index))
        bits = max(64, BITS_PER_KEY * len(self.heads))
        marks = np.zeros((bits + 7) // 8, np.uint8)
        for head in self.heads:
            for p in _probes(head, bits, PROBES):
                marks[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<QB", bits, PROBES) + marks.tobytes()
        bloom += struct.pack("<I", zlib.crc32(bloom))
        self.stream.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.blocks, zlib.crc32(index), self.rows, self.ids, self.width, MAGIC))
        return self.at + len(index) + len(bloom) + FOOTER.size


class Shard:
    """Reads one shard: whole in key order, or a document by its id."""

    def __init__(self, path: str) -> None:
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        foot = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if foot[-1] != MAGIC:
            raise ValueError(f"not a shard: {path}")
        self.rows, self.ids, self.kind = foot[6], foot[7], np.dtype(f"<u{foot[8]}")
        self._filter_at, self._filter_len = foot[2], foot[3]
        self._bloom: tuple[int, int, bytes] | None = None
        index = self._checked(self.file.read_at(foot[1], foot[0]), foot[5])
        data, at, offset = zstandard.ZstdDecompressor().decompress(index) if foot[4] else b"", 0, 0
        self.firsts: list[bytes] = []
        self.spans: list[tuple[int, int]] = []
        self._sums: list[int] = []
        for _ in range(foot[4]):
            n, at = _read_varint(data, at)
            self.firsts.append(data[at : at + n])
            length, at = _read_varint(data, at + n)
            _, at = _read_varint(data, at)
            self._sums.append(*struct.unpack_from("<I", data, at))
            at += 4
            self.spans.append((offset, length))
            offset += length

    @staticmethod
    def _checked(data: bytes, crc: int) -> bytes:
        if zlib.crc32(data) != crc:
            raise ValueError("a part of the shard is damaged")
        return data

    def close(self) -> None:
        self.file.close()

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, length = self.spans[i]
        data, at, key = zstandard.ZstdDecompressor().decompress(self._checked(self.file.read_at(length, offset), self._sums[i])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, self.kind, n // self.kind.itemsize, at)
            at += n

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.spans)):
            yield from self.block(i)

    def may_hold(self, doc_id: int | None) -> bool:
        if self._bloom is None:
            data = self.file.read_at(self._filter_len, self._filter_at)
            self._checked(data[:-4], *struct.unpack("<I", data[-4:]))
            self._bloom = (*struct.unpack_from("<QB", data), data[9:-4])
        bits, k, marks = self._bloom
        return all(marks[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id)[:9], bits, k))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this document id; [] if there is none."""
        if not self.may_hold(doc_id):
            return []
        head, out = key_of(doc_id)[:9], []
        for i in range(max(0, bisect.bisect_left(self.firsts, head) - 1), len(self.spans)):
            if self.firsts[i][:9] > head:
                break
            out += [ids.copy() for key, ids in self.block(i) if key[:9] == head]
        return out


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every document and write shards under ``folder``; returns the manifest, a row per shard.

    Shards hold disjoint ascending ranges of keys.  Texts are dealt by ranges of (id, text hash),
    so rows that repeat one id still spread; null ids come first, a null text is the end id alone;
    repeated rows stay, texts of any length are encoded whole, extra columns are ignored, whatever
    their names, and no rows give no shards.
    A shard's name is its attempt's own and counts only once its manifest row exists, so a task
    that is run again leaves no half shard behind in the table.  Executors write through
    ``pyarrow.fs``, so ``folder`` may be any store it supports.
    """
    tokenizer = tokenizer or vocabulary_file("byte_bpe_50k.json")

    def run(batches):
        coder = encoder(tokenizer)
        end = np.array([end_id], coder.kind)
        stream = writer = first = None
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                coded = coder.encode(part.column(2).to_pylist())
                for doc_id, mark, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), coded, strict=True):
                    if writer is None:
                        path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tsst"
                        fs, name = pafs.FileSystem.from_uri(path)
                        fs.create_dir(name.rpartition("/")[0], recursive=True)
                        stream = fs.open_output_stream(name, compression=None)
                        writer, first = Writer(stream, coder.kind.itemsize), key_of(doc_id, mark)
                    writer.add(key_of(doc_id, mark), np.concatenate([ids, end]))
        if writer is not None:
            size = writer.finish()
            stream.close()
            row = ([path], [first], [writer.rows], [writer.ids], [size])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], MANIFEST.replace(",", "").split()[::2])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_mark(text).alias("mark"), F.col(text).alias("text"))
    return rows.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark").mapInArrow(run, MANIFEST)


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids of every row with this document id, [] if there is none.

    The manifest's first keys name the shards that may hold it (one, unless its rows span several);
    of each only footer, filter, index and the blocks in question are read.
    """
    head = key_of(doc_id)[:9]
    low, high = F.lit(bytearray(head)), F.lit(bytearray(head + b"\xff" * 8))
    before = manifest.where(F.col("first_key") < low).orderBy(F.desc("first_key")).limit(1)
    within = manifest.where(F.col("first_key").between(low, high))
    out = []
    for row in before.unionByName(within).orderBy("first_key").select("path").collect():
        shard = Shard(row.path)
        out += shard.get(doc_id)
        shard.close()
    return out


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read shards back, one task each: id, ``start`` (ids of all rows before), ``n_tokens``, ``ids_crc32``.

    ``manifest`` is a written table; it has a row per shard, so its running sum is a small job.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = max(1, manifest.count())

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard, out = Shard(path), []
                for key, ids in shard.scan():
                    out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield batch(out)
                        out = []
                shard.close()
                if out:
                    yield batch(out)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [id_col, "start", "n_tokens", "ids_crc32"])

    placed = manifest.select("path", before.alias("start")).repartition(shards)
    return placed.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the documents' ids to shards in the shared folder and describe what the shards hold."""
    scratch = Scratch(docs.sparkSession, "sstable")
    manifest = scratch.save(write(docs, f"{scratch.path}/shards", tokenizer, id_col=id_col, text=text), "manifest")
    return read(manifest, id_col)
