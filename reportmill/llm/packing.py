"""Best-fit decreasing packing of documents into token windows.

Documents are encoded where they lie; only one row per piece (id, start, length, checksum) moves on.
A document longer than a window is first cut into full windows and a rest. Pieces are dealt at random under a fixed
seed to shards of a bounded number of tokens, so a shard fits one task whatever the input's size, and
each shard is packed by itself: longest piece first, each into the open window with the least
room that still takes it, found by a segment tree over remaining capacities. The packing of a shard depends on its
rows alone, not on their order, so a lost task repeats with the same result.

Rows: null or empty text is one piece with the end id alone; a null id stays null and a repeated row is
packed as often as it occurs; columns other than ``doc_id`` and ``text`` are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportmill.llm import _common as c
from reportmill.llm._ids import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Counts of open windows by remaining capacity, as a segment tree: the least capacity that is at
    least ``need`` is found, added or taken in log(capacity) steps."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int = 1) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of an open window that is ``need`` or more."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of each length; lengths must be in descending order."""
    tree, by_room, placed, opened = CapacityTree(window), {}, [], 0
    for length in lengths:
        room = tree.tightest(length)
        if room is None:
            at, room, opened = opened, window, opened + 1
        else:
            at = by_room[room].pop()
            tree.add(room, -1)
        placed.append((at, window - room))
        if room > length:
            by_room.setdefault(room - length, []).append(at)
            tree.add(room - length)
    return placed


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, space_leads: bool = False) -> DataFrame:
    """Encodes whole texts, appends ``end_id`` and cuts into full windows and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        encode, end = encoder(tokenizer_path, space_leads).encode_many, int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids = memoryview(data + end)
                n = len(ids) // 4
                rows += [(doc_id, at, min(window, n - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
            if rows:
                yield [*zip(*rows)]

    return c.map_batches(c.pick(docs, "doc_id", "text"), cut, PIECE, encodes=True)


def pack(pieces: DataFrame, window: int = 4096, shard_tokens: int = 1 << 21) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``window`` tokens.

    ``shard_tokens`` bounds the tokens a task packs; sequence ids run on from shard to shard.
    """
    pieces = c.cut(pieces, "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    shards = -(-total // shard_tokens) or 1

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = best_fit_decreasing(rows.column("length").to_pylist(), window)
        return rows.append_column("local", pa.array([p[0] for p in placed], pa.int64())).append_column("offset", pa.array([p[1] for p in placed], pa.int64()))

    # Dealt at random under a fixed seed, not by a hash of the row: equal rows would all meet in one shard.
    spread = F.floor(F.rand(7) * shards).cast("long")
    placed = c.cut(
        pieces.withColumn("shard", spread).groupBy("shard").applyInArrow(place, PIECE + ", shard long, local long, offset long"), "placed"
    )
    sizes = placed.groupBy("shard").agg((F.max("local") + 1).alias("sequences"))
    base = sizes.select("shard", (F.sum("sequences").over(Window.orderBy("shard")) - F.col("sequences")).alias("base"))
    return placed.join(base, "shard").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, shard_tokens: int = 1 << 21) -> DataFrame:
    """Pieces of all documents with their place: one row per piece."""
    return pack(token_pieces(docs, tokenizer_path, window, end_id), window, shard_tokens)
