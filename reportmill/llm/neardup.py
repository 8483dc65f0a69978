"""Near duplicates by MinHash bands and odd sketches, confirmed on full shingle sets.

1. One pass over the texts: the set of k-word shingles as 64-bit hashes, a digest of the set, MinHash samples,
   their band keys, and an odd sketch: a bitmap in which each sample flips one bit. Two sketches' XOR has about
   ``bits/2 * (1 - (1 - 2/bits)^d)`` ones where d samples of either differ, which gives a precise estimate of high similarities.
2. Equal sets collapse to one representative each, so copies cost one row however many there are.
3. Representatives that share a band key form a bucket. Each is paired with the bucket's smallest member alone:
   links are made in proportion to members, never to pairs of them. A bucket or a smallest member with very many rows is dealt to several tasks (``salted_join``).
4. Pairs whose sketches allow the threshold are confirmed on their full sets, built again from the texts of those
   documents only. A second parity bitmap, of the whole set, bounds each pair before that: the ones of two bitmaps' XOR are never more than
   the shingles in which the sets differ, and these are a ninth of both sizes at most where the similarity is 0.8. So it loses no link.
5. A bucket whose members the links of step 4 have not all united goes on: its members outside its largest
   class meet all its members, block by block, by sketch; what the sketches allow is confirmed in the same way.
   So a link that the smallest member doesn't show is found too, and a bucket that is one class costs nothing more.
6. Classes are the connected components of all links.

A link is missed only if two documents share no band key (at the threshold of 0.8 and 32 bands of 4: about 1 in 20
million) or their sketches differ by over 5 standard deviations from their sets.

Rows: a document without words has no shingles and is linked with nothing; one with fewer words than a shingle has its
whole word sequence as the only one. A row with a null id takes part by its text; its class is the
smallest id reachable, null if there is none. Rows that share a ``doc_id`` count as one document for links. Ids must be under 2^62. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reportmill.llm import _common as c
from reportmill.llm.components import components

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
FINGERPRINT = "doc_id long, node long, n_shingles long, digest binary, bands array<long>, sketch binary, parity binary"


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct k-word shingles of a whole text as sorted 64-bit hashes."""
    words = c.words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(words))
    with np.errstate(over="ignore"):
        mixed = h[: len(h) - size + 1] * (_MIX[0] + np.uint64(2 * size))
        for i in range(1, size):
            mixed = _stir(mixed) + h[i : len(h) - size + 1 + i] * (_MIX[i % 8] | np.uint64(1))
        return np.unique(_stir(mixed))


class Sketcher:
    """MinHash samples, band keys and odd sketch of a shingle set."""

    def __init__(self, bands: int = 32, rows: int = 4, bits: int = 512, seed: int = 1):
        self.bands, self.rows, self.bits = bands, rows, bits
        draw = np.random.default_rng(seed)
        k = bands * rows
        self.a = draw.integers(0, 2**63, (k, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 2**63, (k, 1), dtype=np.uint64) * np.uint64(2)
        self.salt = draw.integers(0, 2**63, k, dtype=np.uint64)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            parts = [(shingles[i : i + 4096][None, :] * self.a + self.b).min(axis=1) for i in range(0, len(shingles), 4096)]
        return parts[0] if len(parts) == 1 else np.minimum.reduce(parts)

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            by_band = _stir(samples + self.salt).reshape(self.bands, self.rows)
            keys = np.arange(1, self.bands + 1, dtype=np.uint64) * _MIX[2]
            for i in range(self.rows):
                keys = _stir(keys + by_band[:, i])
        return keys.view(np.int64)

    def odd(self, samples: np.ndarray) -> bytes:
        with np.errstate(over="ignore"):
            places = _stir(samples ^ (self.salt * _MIX[1])) % np.uint64(self.bits)
        flips = np.bincount(places.astype(np.int64), minlength=self.bits) & 1
        return np.packbits(flips.astype(np.uint8)).tobytes()

    def parity(self, shingles: np.ndarray) -> bytes:
        """Odd sketch of the whole set, of a power of two of bits that grows with it; halves XORed are the sketch of half as many bits."""
        bits = 1 << min(max(int(2 * len(shingles) - 1).bit_length(), 8), 14)
        with np.errstate(over="ignore"):
            places = _stir(shingles * _MIX[4]) & np.uint64(bits - 1)
        flips = np.bincount(places.astype(np.int64), minlength=bits) & 1
        return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()

    def most_ones(self, threshold: float, sigmas: float = 5.0) -> int:
        """Ones that the XOR of two sketches has at most where the sets' similarity is ``threshold`` or more."""
        k = self.bands * self.rows
        differ = k * (1 - threshold) + sigmas * math.sqrt(k * threshold * (1 - threshold))
        ones = self.bits / 2 * (1 - (1 - 2 / self.bits) ** (2 * differ))
        return min(self.bits, math.ceil(ones + sigmas * math.sqrt(self.bits) / 4))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _node(doc_id: int | None, digest: bytes) -> int:
    """A document's id, or for a null id one beyond all ids, made of its set's digest."""
    return (1 << 62) + (int.from_bytes(digest[:8], "little") >> 3) if doc_id is None else doc_id


def fingerprints(docs: DataFrame, k: int, sketcher: Sketcher) -> DataFrame:
    """One row per document; ``node`` is its id, or for a null id one made of the set's digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, k)
                digest = _digest(s)
                node = _node(doc_id, digest)
                if len(s):
                    m = sketcher.samples(s)
                    rows.append((doc_id, node, len(s), digest, sketcher.band_keys(m), sketcher.odd(m), sketcher.parity(s)))
                else:
                    rows.append((doc_id, node, 0, None, None, None, None))
            if rows:
                yield [*zip(*rows)]

    return c.map_batches(c.pick(docs, "doc_id", "text"), work, FINGERPRINT)


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, digest, set) of the representatives in ``wanted`` (node, digest), from their texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            rows = []
            for node, digest, text in zip(*(x.to_pylist() for x in batch.columns)):
                s = shingle_set(text, k)
                if _digest(s) == digest:  # a shared doc_id may have other texts
                    rows.append((node, s.view(np.int64)))
            if rows:
                yield [*zip(*rows)]

    named = wanted.withColumn("doc_id", F.when(F.col("node") < 1 << 62, F.col("node")))
    texts = c.pick(docs, "doc_id", "text").join(named, docs["doc_id"].eqNullSafe(named["doc_id"]), "inner").select("node", "digest", "text")
    return c.map_batches(texts, work, "node long, shingles array<long>")


def _confirm(docs: DataFrame, pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (u, v) of representatives with 100 * intersection >= percent * union of their full sets.

    A pair takes the set of its v along to its u, which may be in very many pairs; that one's set is repeated once a salt."""
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = reps.select("node", "digest").join(ends, "node", "left_semi")
    # A shared doc_id may give a representative more than one row of the same set.
    sets = c.cut(_sets(docs, wanted, k), "sets").dropDuplicates(["node"])
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t")).cast("long")
    hubs = pairs.groupBy("u").agg(F.count("*").alias("n"))
    met = c.salted_join(pairs.join(right, "v"), left, "u", pairs.count(), counts=hubs).withColumn("both", both)
    return met.where(100 * F.col("both") >= percent * (F.size("s") + F.size("t") - F.col("both"))).select("u", "v")


def _sketches_allow(sketcher: Sketcher, percent: int):
    most = sketcher.most_ones(percent / 100)

    def allow(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(a ^ b).sum(axis=-1)
        return (ones <= most) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))

    return allow


def _differ(a: bytes, b: bytes) -> int:
    """Ones of two parity bitmaps' XOR; the longer one is folded to the shorter one's bits."""
    while len(a) > len(b):
        a = (int.from_bytes(a[: len(a) // 2], "little") ^ int.from_bytes(a[len(a) // 2 :], "little")).to_bytes(len(a) // 2, "little")
    while len(b) > len(a):
        b = (int.from_bytes(b[: len(b) // 2], "little") ^ int.from_bytes(b[len(b) // 2 :], "little")).to_bytes(len(b) // 2, "little")
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def _as_words(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, sketcher: Sketcher | None = None, block: int = 128) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and ``n_equal``, the rows with its very set.

    ``percent``: least similarity in hundredths. ``block``: members that meet at a time in step 5.
    """
    found = _classes(docs, k, percent, sketcher or Sketcher(), block).withColumn("component_id", F.when(F.col("root") < 1 << 62, F.col("root")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_equal")


def _classes(docs: DataFrame, k: int, percent: int, sketcher: Sketcher, block: int) -> DataFrame:
    """(doc_id, node, n_shingles, root, n_equal): ``root`` is the smallest node of a document's class."""
    prints = c.cut(fingerprints(docs, k, sketcher), "prints")
    allow = _sketches_allow(sketcher, percent)

    # 2. Equal sets: one representative, their smallest node.
    classes = c.cut(prints.where("digest is not null").groupBy("digest").agg(F.min("node").alias("rep"), F.count("*").alias("n_equal")), "classes")
    reps = c.cut(
        prints.join(classes.select("digest", F.col("rep").alias("node")), ["digest", "node"], "left_semi").select("node", "digest", "n_shingles", "bands", "sketch", "parity"), "reps"
    )
    banded = reps.select("node", F.explode("bands").alias("band"))
    shared = c.cut(banded.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("far"), F.count("*").alias("n")).where("pivot <> far").select("band", "pivot", "n"), "shared")
    n_members = shared.agg(F.sum("n")).first()[0] or 0
    members = c.cut(c.salted_join(banded, shared.select("band", "pivot"), "band", n_members, counts=shared), "members")

    # 3. and 4. Stars around each bucket's smallest member.
    stars = c.cut(members.where("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct(), "spokes")
    sketched = reps.select("node", "n_shingles", "sketch", "parity")
    with_v = stars.join(sketched.select(F.col("node").alias("v"), F.col("n_shingles").alias("nv"), F.col("sketch").alias("sv"), F.col("parity").alias("pv")), "v")
    hubs = stars.groupBy("u").agg(F.count("*").alias("n"))
    with_both = c.salted_join(with_v, sketched.select(F.col("node").alias("u"), F.col("n_shingles").alias("nu"), F.col("sketch").alias("su"), F.col("parity").alias("pu")), "u", stars.count(), counts=hubs)

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                fit = allow(_as_words(batch["su"]), _as_words(batch["sv"]), batch["nu"].to_numpy(), batch["nv"].to_numpy())
                left = batch.loc[fit]
                near = [_differ(p, q) * (100 + percent) <= (100 - percent) * (m + n) for p, q, m, n in zip(left["pu"], left["pv"], left["nu"], left["nv"])]
                yield left.loc[near, ["u", "v"]]

    allowed = c.cut(with_both.select("u", "v", "nu", "nv", "su", "sv", "pu", "pv").mapInPandas(passing, "u long, v long"), "allowed")
    links = c.cut(_confirm(docs, allowed, reps, k, percent), "linked")
    united = components(links)

    # 5. Buckets that are still several classes.
    labelled = c.cut(members.join(united, "node", "left").select("band", "node", F.coalesce("component", "node").alias("label")), "labelled")
    torn = labelled.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).where("a <> b and n > 2").select("band", "n")
    torn = c.cut(torn, "torn-bands")
    n_torn = torn.agg(F.sum("n")).first()[0] or 0
    if n_torn:
        torn_rows = c.cut(c.salted_join(labelled, torn.select("band"), "band", n_members, counts=torn), "torn")
        found = c.cut(_meet(torn_rows, torn, n_torn, sketched, links.union(allowed).distinct(), allow, percent, block), "met")
        more = _confirm(docs, found, reps, k, percent)
        united = components(links.union(more))

    out = prints.select("doc_id", "node", "n_shingles", "digest").join(classes, "digest", "left").join(united.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "node", "n_shingles", F.coalesce("component", "rep", "node").alias("root"), F.coalesce("n_equal", F.lit(1)).cast("long").alias("n_equal"))


def _meet(torn: DataFrame, sizes: DataFrame, total: int, sketched: DataFrame, done: DataFrame, allow, percent: int, block: int) -> DataFrame:
    """Pairs of different classes in a torn bucket that the sketches allow and that were not met before.

    ``sizes``: (band, n), ``total`` their sum. The members outside the largest class (the strays) meet every member. Both are dealt in blocks of
    ``block`` rows, so what one task holds is bounded whatever the bucket's size.
    """
    labels = torn.groupBy("band", "label").count()
    largest = labels.groupBy("band").agg(F.max(F.struct("count", "label")).alias("top")).select("band", F.col("top.label").alias("main"))
    rows = c.salted_join(torn, largest.join(sizes, "band"), "band", total, counts=sizes).join(sketched, "node")
    blocks = F.floor((F.col("n") + block - 1) / block).cast("int")
    number = F.pmod(F.xxhash64("node", "band"), blocks)
    held = rows.withColumn("part", number).groupBy("band", "part").agg(F.collect_list(F.struct("node", "label", "n_shingles", "sketch", "parity")).alias("held"))
    strays = rows.where("label <> main").withColumn("part", number).groupBy("band", "part").agg(F.collect_list(F.struct("node", "label", "n_shingles", "sketch", "parity")).alias("strays"))
    tasks = strays.select("band", F.col("part").alias("stray_part"), "strays").join(held, "band")
    tasks = tasks.repartition(c.part_count(torn.sparkSession), "band", "part", "stray_part")

    def frame(items) -> tuple[np.ndarray, ...]:
        return (
            np.array([x["node"] for x in items], np.int64), np.array([x["label"] for x in items], np.int64),
            np.array([x["n_shingles"] for x in items], np.int64), np.frombuffer(b"".join(x["sketch"] for x in items), np.uint64).reshape(len(items), -1), [x["parity"] for x in items],
        )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for strays, held in zip(batch["strays"], batch["held"]):
                a, b = frame(strays), frame(held)
                for i in range(len(a[0])):
                    fit = allow(a[3][i][None, :], b[3], a[2][i], b[2]) & (b[1] != a[1][i])
                    fit[fit] = [_differ(a[4][i], b[4][j]) * (100 + percent) <= (100 - percent) * (a[2][i] + b[2][j]) for j in np.flatnonzero(fit)]
                    if fit.any():
                        other = b[0][fit]
                        yield pd.DataFrame({"u": np.minimum(other, a[0][i]), "v": np.maximum(other, a[0][i])})

    pairs = tasks.select("strays", "held").mapInPandas(work, "u long, v long").distinct()
    return pairs.join(done, ["u", "v"], "left_anti")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with their columns, of which each class's smallest id stays. Rows that repeat a kept document are dropped too.

    Of a class without any id one row stays: a null id's document is told by its set, and met by that."""
    marked = c.cut(_classes(docs, k, percent, Sketcher(), 128).where("node = root").select("doc_id", "node"), "kept")
    nameless = marked.where("doc_id is null").select("node").distinct()
    if nameless.limit(1).count():
        named = drop_named(docs.where("doc_id is not null"), marked.where("doc_id is not null"))
        return named.unionByName(_first_of_sets(docs.where("doc_id is null"), nameless, k))
    return drop_named(docs, marked)


def _first_of_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Of the documents without an id, one for each node in ``nodes``, and all without words."""
    # Its columns may have any names, so the node comes last and is known by its place.
    names = docs.columns
    shape = StructType([*docs.schema.fields, StructField("__node", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            sets = [shingle_set(t, k) for t in batch.column(at).to_pylist()]
            made = [_node(None, _digest(x)) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=[*names, "__node"])

    told = docs.mapInArrow(work, shape)
    met = told.join(nodes.withColumnRenamed("node", "__kept"), F.col("__node") == F.col("__kept"), "left_semi").dropDuplicates(["__node"])
    return met.unionByName(told.where("__node is null")).select(*names)  # without words a document is like no other


def drop_named(docs: DataFrame, marked: DataFrame) -> DataFrame:
    kept = marked.groupBy("doc_id").agg(F.count("*").alias("times")).withColumnRenamed("doc_id", "kept_id")
    joined = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "inner").select(*[docs[x] for x in docs.columns], kept["times"].alias("__times"))
    if not kept.where("times > 1").limit(1).count():
        return joined.drop("__times")
    once, again = joined.where("__times = 1").drop("__times"), joined.where("__times > 1").drop("__times")
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))
