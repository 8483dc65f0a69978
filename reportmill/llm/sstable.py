"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending order of ``doc_id`` (nulls first)::

    block*  index  bloom  footer(64 bytes)

A block is zstd-compressed; inside, each entry is ``shared, rest, count, width`` (a byte, a byte, 4
bytes and a byte), the part of the key that differs from the previous entry's, and ``count`` ids of
``width`` bytes, little-endian. A key is 0x01, the id with its sign bit flipped in 8 big-endian bytes, and 4 bytes
that number the rows of one id; a null id has 0x00 in front. Keys sort as ids do. The sparse index has the
first key, offset, length, entry count and running token count of each block, so one document costs a binary search and one
range read. The Bloom filter spares that read for most absent ids.

Shards are ranges of ``doc_id``, as many as the size of the texts asks for, so a shard, its index and its filter stay as large as the data grow. Texts move once, to their shard; they are encoded there and their blocks are streamed out, so a task holds a
block at a time, and the index and hashes of its shard. Only the shard list (a row per file, written as a table) leaves the tasks, and only tasks read it. Files of lost attempts are never listed.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportmill.llm import _common as c
from reportmill.llm import _files as files
from reportmill.llm._ids import encoder

MAGIC = b"RMSSTBL1"
_ENTRY, _INDEX, _FOOTER = struct.Struct("<BBIB"), struct.Struct("<13sQIIQ"), struct.Struct("<QQQQQQQ8s")
MANIFEST = "part long, path string, documents long, tokens long, first_key binary, last_key binary"


def key_of(doc_id: int | None, number: int = 0) -> bytes:
    """13 bytes that sort as (doc_id, number) does, null first."""
    head = b"\x00" + bytes(8) if doc_id is None else b"\x01" + ((int(doc_id) + (1 << 63)) & (2**64 - 1)).to_bytes(8, "big")
    return head + number.to_bytes(4, "big")


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else int.from_bytes(key[1:9], "big") - (1 << 63)


def bloom_bits(key: bytes, bits: int, hashes: int = 7) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key[:9])
    a, b = h & (2**64 - 1), (h >> 64) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Writes one shard; entries must come in ascending order of key."""

    def __init__(self, stream, block_bytes: int = 1 << 18):
        self.stream, self.block_bytes, self.zip = stream, block_bytes, zstandard.ZstdCompressor(level=1)
        self.at = self.documents = self.tokens = self.block_tokens = 0
        self.block, self.held, self.first, self.last, self.count = [], 0, b"", b"", 0
        self.index, self.hashed = [], array("Q")
        self.low = b""

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids``: unsigned 32-bit integers."""
        if self.count and self.held >= self.block_bytes:
            self._flush()
        shared = 0
        if self.count:
            while shared < len(key) and self.last[shared] == key[shared]:
                shared += 1
        else:
            self.first = key
        wide = np.frombuffer(ids, "<u4")
        width = 2 if not len(wide) or int(wide.max()) < 1 << 16 else 4
        body = wide.astype("<u2").tobytes() if width == 2 else ids
        self.block += [_ENTRY.pack(shared, len(key) - shared, len(wide), width), key[shared:], body]
        self.held += len(body)
        self.count += 1
        self.documents += 1
        self.tokens += len(wide)
        if not self.documents - 1:
            self.low = key
        if key[:9] != self.last[:9]:
            h = xxhash.xxh3_128_intdigest(key[:9])
            self.hashed.extend((h & (2**64 - 1), (h >> 64) | 1))
        self.last = key

    def _flush(self) -> None:
        data = self.zip.compress(b"".join(self.block))
        self.stream.write(data)
        self.index.append(_INDEX.pack(self.first, self.at, len(data), self.count, self.block_tokens))
        self.at, self.block_tokens = self.at + len(data), self.tokens
        self.block, self.held, self.count = [], 0, 0

    def close(self) -> None:
        if self.count:
            self._flush()
        index = b"".join(self.index)
        pairs = np.frombuffer(self.hashed, np.uint64).reshape(-1, 2)
        bits = max(64, 10 * len(pairs) // 64 * 64 + 64)
        bloom = np.zeros(bits, np.bool_)
        with np.errstate(over="ignore"):
            for i in range(7):
                # as bloom_bits(), whose sum does not wrap
                bloom[((pairs[:, 0] % bits) + (i * (pairs[:, 1] % bits)) % bits) % bits] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.stream.write(index + packed)
        self.stream.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), bits, self.documents, self.tokens, MAGIC))


class ShardReader:
    """Reads one shard by ranges: footer, sparse index and filter first, then blocks on demand."""

    def __init__(self, path: str, reader: files.RangeReader):
        self.path, self.reader, self.unzip = path, reader, zstandard.ZstdDecompressor()
        size = reader.size(path)
        at, length, self.bloom_at, self.bloom_length, self.bits, self.documents, self.tokens, magic = _FOOTER.unpack(reader.read(path, size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.blocks = [*_INDEX.iter_unpack(reader.read(path, at, length))]
        self.firsts = [b[0] for b in self.blocks]
        self._bloom: bytes | None = None
        self._held: tuple[int, list] = (-1, [])

    def block(self, n: int) -> Iterator[tuple[bytes, np.ndarray]]:
        """(key, ids) of one block's entries."""
        _, at, length, count, _ = self.blocks[n]
        data, p, key = self.unzip.decompress(self.reader.read(self.path, at, length)), 0, b""
        for _ in range(count):
            shared, rest, n_ids, width = _ENTRY.unpack_from(data, p)
            p += _ENTRY.size
            key = key[:shared] + data[p : p + rest]
            p += rest
            yield key, np.frombuffer(data, f"<u{width}", n_ids, p).astype("<u4")
            p += n_ids * width

    def may_hold(self, doc_id: int | None) -> bool:
        if self._bloom is None:
            self._bloom = self.reader.read(self.path, self.bloom_at, self.bloom_length)
        return all(self._bloom[b >> 3] >> (b & 7) & 1 for b in bloom_bits(key_of(doc_id), self.bits))

    def _block_from(self, n: int) -> list[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, ids) of one block; the last one read is kept, as sorted ids ask for it again."""
        if self._held[0] != n:
            rows, at = [], self.blocks[n][4]
            for key, ids in self.block(n):
                rows.append((key, at, ids))
                at += len(ids)
            self._held = n, rows
        return self._held[1]

    def find(self, doc_id: int | None) -> list[tuple[int, np.ndarray]]:
        """(ids before it in the shard, ids) of every row of one document: filter, then binary search, then one or two range reads."""
        found: list[tuple[int, np.ndarray]] = []
        if not self.blocks or not self.may_hold(doc_id):
            return found
        want = key_of(doc_id)
        n = max(0, bisect.bisect_right(self.firsts, want) - 1)
        while n < len(self.blocks) and self.firsts[n][:9] <= want[:9]:
            rows = self._block_from(n)
            i = bisect.bisect_left(rows, want, key=lambda x: x[0])
            while i < len(rows) and rows[i][0][:9] == want[:9]:
                found.append(rows[i][1:])
                i += 1
            n += 1
        return found

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        return [ids for _, ids in self.find(doc_id)]


class ShardList:
    """The shard list, as a task reads it: ranges of keys and the ids before each shard."""

    def __init__(self, listed: list[str], reader: files.RangeReader):
        self.rows = sorted((x for f in listed for x in files.read_table(f).to_pylist()), key=lambda x: x["part"])
        self.lasts, self.reader, self.open = [x["last_key"] for x in self.rows], reader, (None, None)
        self.before = np.cumsum([0] + [x["tokens"] for x in self.rows]).tolist()

    def find(self, doc_id: int | None) -> list[tuple[int, np.ndarray]]:
        """(ids of all documents before it, ids) of every row of one document, from the one or few shards that can hold it."""
        want, found = key_of(doc_id), []
        n = bisect.bisect_left(self.lasts, want)
        while n < len(self.rows) and self.rows[n]["first_key"][:9] <= want[:9]:
            path = self.rows[n]["path"]
            if self.open[0] != path:
                self.open = path, ShardReader(path, self.reader)
            found += [(self.before[n] + at, ids) for at, ids in self.open[1].find(doc_id)]
            n += 1
        return found


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, space_leads: bool = True, shards: int | None = None, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encodes whole texts and writes the shards under ``path``; returns the shard list, in order of ids.

    Null or empty text has the end id alone. Rows with one ``doc_id`` are numbered in order of their
    text, so equal rows come out equal whatever their order. An empty table makes no shard.
    """
    spark = docs.sparkSession
    n = shards or c.file_count(docs, shard_bytes)
    # The hash spreads one id that has very many rows over its neighbours' ranges; they stay sorted by id.
    dealt = c.pick(docs, "doc_id", "text").withColumn("salt", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "salt").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "salt")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        encode, end = encoder(tokenizer_path, space_leads).encode_many, int(end_id).to_bytes(4, "little")
        out = stream = None
        last, number = object(), 0
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                if out is None:
                    store, folder = files.open_store(path)
                    store.create_dir(folder, recursive=True)
                    name = files.attempt_name("shard", ".sst")
                    stream = store.open_output_stream(f"{folder}/{name}")
                    out = ShardWriter(stream)
                number = number + 1 if doc_id == last else 0
                last = doc_id
                out.add(key_of(doc_id, number), data + end)
        if out is not None:
            from pyspark import TaskContext

            out.close()
            stream.close()
            context = TaskContext.get()
            yield [[context.partitionId() if context else 0], [f"{path}/{name}"], [out.documents], [out.tokens], [out.low], [out.last]]

    return c.cut(c.map_batches(dealt.select("doc_id", "text"), write, MANIFEST, encodes=True), "shard-list")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the listed shards: doc_id, start, n_tokens, ids_crc32, in order of ids within a shard."""
    before = F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        reader = files.RangeReader()
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, at = ShardReader(path, reader), start
                for n in range(len(shard.blocks)):
                    rows = []
                    for key, ids in shard.block(n):
                        rows.append((id_of(key), at, len(ids), zlib.crc32(ids)))
                        at += len(ids)
                    yield [*zip(*rows)]
        reader.close()

    listed = manifest.select("path", before.alias("before"))
    listed = listed.repartition(c.part_count(manifest.sparkSession), "path")
    return c.map_batches(listed, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _fetch(manifest: DataFrame, ids: DataFrame, ddl: str, made) -> DataFrame:
    """Rows made of each found (doc_id, start, ids); wanted ids are sorted first, so a task reads neighbouring blocks, each once."""
    wanted = ids.select("doc_id").distinct()
    wanted = wanted.repartitionByRange(c.file_count(wanted, 64 << 20), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    listed = c.table_files(manifest)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        reader, shards = files.RangeReader(), None
        for batch in batches:
            shards = shards or ShardList(listed, reader)
            rows, held = [], 0
            for doc_id in batch.column(0).to_pylist():
                for start, got in shards.find(doc_id):
                    rows.append(made(doc_id, start, got))
                    held += len(got)
                if held > 1 << 20:
                    yield [*zip(*rows)]
                    rows, held = [], 0
            if rows:
                yield [*zip(*rows)]
        reader.close()

    return c.map_batches(wanted, fetch, ddl)


def lookup(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """Token ids of the documents in ``ids`` (a column doc_id): doc_id, ids. Shards are chosen by binary search in the
    shard list, then each is read through its filter and sparse index alone."""
    return _fetch(manifest, ids, "doc_id long, ids array<long>", lambda doc_id, start, ids: (doc_id, ids.tolist()))


def lookup_digests(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """``lookup``, with doc_id, start, n_tokens and ids_crc32 of each row found."""
    return _fetch(manifest, ids, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda doc_id, start, ids: (doc_id, start, len(ids), zlib.crc32(ids)))
