"""Approximate nearest neighbours by balanced posting lists, nearness by cosine.

Fit (on the driver, from a sample chosen by hash): the sample is split again and again by
2-means with equal halves until pieces are small, so lists come out balanced; each piece's mean direction is a centroid. The centroids are joined to a
graph of near neighbours with a few far links. There is a list for each ``list_rows`` vectors, so lists stay as long as the table grows, up to ``most_lists``,
which bounds what is sent to tasks; the sample has four vectors a list, and ``sample_rows`` at least.

Index: every vector goes to the list of its nearest centroid; a boundary vector, whose next centroids are within ``1 + reach`` of the
nearest distance and not nearer to a chosen centroid than to itself, is replicated to those as well.

Search: a best-first walk through the centroid graph finds the centroids near a query; those whose distance is within a ratio of the
nearest one's are searched. Ratio and most replicas are fitted with the index: those that reach ``recall`` of the true neighbours within the sample by
reading the fewest vectors. Lists are read in parts of at most ``part_rows`` vectors, and queries join parts by key; nothing is compared outside a searched list. Distances are exact, on the
original vectors in double precision.

Vectors are nearest among those of their own length. Each of the ``most_lengths`` commonest lengths has centroids of its own; vectors of any other are one list,
read in parts, which is exact.

Equal vectors are kept once, with their ``k + 1`` smallest ids: no others can be among the ``k`` nearest of anything, as ties go to
smaller ids. A map-side limit sees to it that a vector with very many copies is no hot spot.

Vectors without any structure (independent random directions) are a hard case for any such index: a query's neighbours lie in most lists, so
reaching ``recall`` means reading a large share of the vectors, and time grows with queries times vectors.

Rows: vectors that are null, zero or hold null or non-finite components take no part, nor do rows
with a null id; a repeated id takes part, and asks, with each of its vectors, and counts once, at its best; ``label`` and other columns are not read; without vectors there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportmill.llm import _common as c


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return (wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))).astype(np.float32)


def balanced_centroids(points: np.ndarray, pieces: int, seed: int = 1) -> np.ndarray:
    """Mean directions of ``pieces`` (rounded up to a power of two, where there are enough points) equal parts."""
    draw = np.random.default_rng(seed)
    groups = [np.arange(len(points))]
    while len(groups) < pieces:
        made = []
        for g in groups:
            if len(g) < 2:
                made.append(g)
                continue
            x = points[g]
            ends = x[draw.choice(len(g), 2, replace=False)]
            for _ in range(8):
                lean = x @ (ends[0] - ends[1])
                order = np.argsort(-lean, kind="stable")
                half = len(g) // 2
                ends = np.stack([x[order[:half]].mean(axis=0), x[order[half:]].mean(axis=0)])
            made += [g[order[:half]], g[order[half:]]]
        if len(made) == len(groups):
            break
        groups = made
    means = np.stack([points[g].mean(axis=0) for g in groups])
    norm = np.sqrt((means * means).sum(axis=1, keepdims=True))
    return np.where(norm > 0, means / np.maximum(norm, 1e-12), points[[g[0] for g in groups]]).astype(np.float32)


def centroid_graph(centroids: np.ndarray, near: int = 16, far: int = 4, seed: int = 1) -> np.ndarray:
    """Neighbours of each centroid: the nearest ones, those of the next in number (so all are reachable), and a few at random."""
    n = len(centroids)
    near = min(near, n - 1)
    found = []
    for i in range(0, n, 1024):
        like = centroids[i : i + 1024] @ centroids.T
        like[np.arange(len(like)), np.arange(i, i + len(like))] = -2
        found.append(np.argpartition(-like, near - 1, axis=1)[:, :near] if near else np.empty((len(like), 0), np.int64))
    draw = np.random.default_rng(seed)
    ring = (np.arange(n)[:, None] + 1) % n
    return np.concatenate([np.concatenate(found), ring, draw.integers(0, n, (n, far))], axis=1).astype(np.int32)


@dataclass
class Lists:
    """Centroids, their graph, and the ratios of the index."""

    centroids: np.ndarray
    graph: np.ndarray
    replicas: int = 4
    reach: float = 0.1
    ratio: float = 2.0
    beam: int = 32

    def near(self, queries: np.ndarray, beam: int, wide: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of about the ``beam`` nearest of each query, nearest first; -1 where there are fewer. All queries walk through
        the graph at once; each step follows the links of the ``wide`` nearest centroids that a query hasn't followed yet."""
        n, q = len(self.centroids), len(queries)
        beam = min(beam, n)
        rows = np.arange(q)[:, None]
        start = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))
        seen = np.zeros((q, n), bool)
        seen[:, start] = True
        at = np.broadcast_to(start, (q, len(start))).copy()
        d = 2 - 2 * queries @ self.centroids[start].T
        done = np.zeros(at.shape, bool)
        while not done.all():
            pick = np.argsort(np.where(done, np.inf, d), axis=1, kind="stable")[:, :wide]
            busy = ~np.take_along_axis(done, pick, axis=1)
            np.put_along_axis(done, pick, True, axis=1)
            new = np.where(busy[:, :, None], self.graph[np.take_along_axis(at, pick, axis=1)], -1).reshape(q, -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1  # linked from two sides
            new[seen[rows, new]] = -1
            some = (new >= 0).sum(axis=1).max(initial=0)
            new = -np.sort(-new, axis=1)[:, :some].astype(np.int64)
            fresh = new >= 0
            seen[np.nonzero(fresh)[0], new[fresh]] = True
            dn = 2 - 2 * np.einsum("qd,qkd->qk", queries, self.centroids[new])
            dn[~fresh] = np.inf
            at, d, done = np.concatenate([at, new], axis=1), np.concatenate([d, dn], axis=1), np.concatenate([done, ~fresh], axis=1)
            if d.shape[1] > beam:
                keep = np.argpartition(d, beam - 1, axis=1)[:, :beam]
                at, d, done = (np.take_along_axis(x, keep, axis=1) for x in (at, d, done))
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, axis=1)
        return np.where(np.isfinite(d), np.take_along_axis(at, order, axis=1), -1), np.sqrt(np.maximum(d, 0))

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list): each vector's nearest list, and those that its boundary reaches."""
        at, d = self.near(vectors, max(16, 2 * self.replicas))
        chosen = np.zeros(at.shape, bool)
        chosen[:, 0] = True
        for j in range(1, at.shape[1]):
            ok = np.isfinite(d[:, j]) & (at[:, j] >= 0) & (d[:, j] <= (1 + self.reach) * d[:, 0]) & (chosen.sum(axis=1) < self.replicas)
            if not ok.any():
                break
            mine = self.centroids[np.maximum(at[:, j], 0)]
            for i in range(j):
                gap = np.sqrt(((mine - self.centroids[np.maximum(at[:, i], 0)]) ** 2).sum(axis=1))
                ok &= ~chosen[:, i] | (gap >= 0.5 * d[:, j])  # not in nearly the same direction as a chosen one
            chosen[:, j] = ok
        return np.nonzero(chosen)[0], at[chosen]

    def searched(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of every list that a query's ratio selects."""
        at, d = self.near(queries, self.beam)
        fits = (d <= self.ratio * d[:, :1] + 1e-6) & (at >= 0) & np.isfinite(d)
        return np.nonzero(fits)[0], at[fits]


def fit(sample: np.ndarray, total: int, list_rows: int = 250, most_lists: int = 1 << 16, k: int = 5, recall: float = 0.98, seed: int = 1) -> Lists:
    """Fits centroids, graph, replicas and ratio on a sample of unit vectors of a table of ``total``."""
    wanted = max(1, min(most_lists, total // list_rows, len(sample) // 4 or 1))
    centroids = balanced_centroids(sample, wanted, seed)
    lists = Lists(centroids, centroid_graph(centroids))
    n = len(centroids)
    draw = np.random.default_rng(seed)
    some = draw.choice(len(sample), min(400, len(sample)), replace=False)
    like = sample[some] @ sample.T
    like[np.arange(len(some)), some] = -2
    few = min(k, len(sample) - 1)
    if n == 1 or not few:
        return lists
    true = np.argpartition(-like, few - 1, axis=1)[:, :few]
    d = np.sqrt(np.maximum(0, 2 - 2 * sample[some] @ centroids.T))  # to every centroid: how far the lists of the true ones are
    wanted_by, found = np.repeat(np.arange(len(some)), few), np.unique(true)
    spread = sample[draw.choice(len(sample), min(2000, len(sample)), replace=False)]  # stands for all vectors
    best = None
    for replicas in (2, 4, 8):
        lists.replicas = replicas
        owner, home = lists.homes(sample[found])
        reached = np.full((len(found), n), False)
        reached[owner, home] = True
        at = np.searchsorted(found, true.ravel())
        nearest_home = np.where(reached[at], d[wanted_by], np.inf).min(axis=1)
        ratio = float(np.quantile(nearest_home / np.maximum(d[wanted_by].min(axis=1), 1e-9), recall)) + 1e-6
        size = np.bincount(lists.homes(spread)[1], minlength=n)
        chosen = d <= ratio * d.min(axis=1, keepdims=True)
        cost = float((chosen @ size).mean())
        if best is None or cost < best[0]:
            best = cost, replicas, ratio, int(chosen.sum(axis=1).max())
    _, lists.replicas, lists.ratio, most = best
    lists.beam = int(min(n, max(32, 1.5 * most)))
    return lists


def _vectors(table: DataFrame) -> DataFrame:
    good = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.coalesce(good, F.lit(False)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows) of the vectors of each length, some at a time."""
    sizes = column.value_lengths().to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for i in range(0, len(at), rows):
            yield int(size), at[i : i + rows]


def nearest_in(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, offsets: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the ``k`` nearest ids of each query among ``vectors``, whose ids are ``ids[offsets[i]:offsets[i + 1]]``; never a query's ``own``."""
    q1, v1 = unit64(queries), unit64(vectors)
    left, most, found = np.arange(len(queries)), min(len(vectors), k + 1), []
    while len(left):
        like = q1[left] @ v1.T
        floor = np.partition(like, len(vectors) - most, axis=1)[:, len(vectors) - most]
        which, near = np.nonzero(like >= floor[:, None] - 1e-12)  # ties at the end come along
        score = _cosines(queries[left[which]], vectors[near])
        times = offsets[near + 1] - offsets[near]
        into = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(offsets[near], times)
        query, one, score = np.repeat(left[which], times), ids[into], np.repeat(score, times)
        other = one != own[query]
        query, one, score = query[other], one[other], score[other]
        order = np.lexsort((-score, one, query))  # an id counts at its best
        query, one, score = query[order], one[order], score[order]
        first = np.r_[True, (query[1:] != query[:-1]) | (one[1:] != one[:-1])] if len(query) else np.empty(0, bool)
        query, one, score = query[first], one[first], score[first]
        # Ids with several vectors may leave a query with fewer than k: it looks further.
        short = np.bincount(query, minlength=len(queries))[left] < k
        again = left[short] if most < len(vectors) else left[:0]
        keep = ~np.isin(query, again)
        query, one, score = query[keep], one[keep], score[keep]
        order = np.lexsort((one, -score, query))
        query, one, score = query[order], one[order], score[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        found.append((query[rank < k], one[rank < k], score[rank < k]))
        left, most = again, min(len(vectors), 4 * most)
    return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, np.float64)))


def nearest(
    table: DataFrame, queries: DataFrame, k: int = 5, sample_rows: int = 20_000, list_rows: int = 250, most_lists: int = 1 << 16, part_rows: int = 20_000, recall: float = 0.98, most_lengths: int = 8
) -> DataFrame:
    """The ``k`` nearest rows of ``table`` (vec_id, embedding) of each row of ``queries`` (likewise), without the query's own id:
    query_id, rank, vec_id, score. Queries of equal id and vector count once."""
    spark = table.sparkSession
    # The hash comes first in every comparison of vectors, so few are compared component by component.
    vectors = _vectors(table).withColumn("h", F.xxhash64("vector"))
    first = Window.partitionBy("h", "vector").orderBy("vec_id")
    few = vectors.distinct().withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1).drop("__n")
    classes = c.cut(few.groupBy("h", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    asked = c.cut(_vectors(queries).distinct().select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), "queries")
    lengths = classes.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").limit(most_lengths).collect()
    found_by: dict[int, Lists] = {}
    for length, total in lengths:
        # most_lists bounds the sample as well: four vectors a list.
        rows = max(sample_rows, 4 * min(most_lists, total // list_rows))
        drawn = classes.where(F.size("vector") == length).select("h", "vector").orderBy("h", "vector").limit(rows).select("vector").toArrow()
        found_by[length] = fit(unit(_matrix(drawn.column(0))), total, list_rows, most_lists, k, recall)

    def dealt(column: str, others: list[str], how: str):
        """Rows by the lists that ``how`` names for their vector; those of a rare length by list 0 of that length."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
            for batch in batches:
                vectors = batch.column(column)
                for length, at in _by_length(vectors):
                    part = vectors.take(pa.array(at))
                    owner, home = getattr(found_by[length], how)(unit(_matrix(part))) if length in found_by else (np.arange(len(at)), np.zeros(len(at), np.int64))
                    take = pa.array(at[owner])
                    yield [np.full(len(owner), length, np.int32), home.astype(np.int32), vectors.take(take), *[batch.column(x).take(take) for x in others]]

        return work

    postings = c.cut(c.map_batches(classes.select("vector", "ids"), dealt("vector", ["ids"], "homes"), "length int, list int, vector array<double>, ids array<long>"), "postings")
    # A row for each list; joined by whatever way its size allows.
    sizes = c.cut(postings.groupBy("length", "list").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")), "sizes")
    key = ["length", "list"]
    held = postings.join(sizes, key).select(*key, F.pmod(F.xxhash64("ids"), "parts").cast("int").alias("part"), "vector", "ids")
    searches = c.map_batches(asked.repartition(c.part_count(spark)), dealt("query", ["query_id"], "searched"), "length int, list int, query array<double>, query_id long")
    searches = searches.join(sizes, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "query")

    def score(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        parts = []
        if len(rows) and len(wanted):
            v, ids = _matrix(rows.column("vector")), rows.column("ids").combine_chunks()
            offsets, flat = np.r_[0, np.cumsum(ids.value_lengths().to_numpy())], ids.flatten().to_numpy()
            step = max(16, (1 << 22) // len(rows))  # so many likenesses at a time
            for i in range(0, len(wanted), step):
                some = wanted.slice(i, step)
                own = some.column("query_id").to_numpy()
                at, found, likeness = nearest_in(_matrix(some.column("query")), own, v, offsets, flat, k)
                parts.append((own[at], found, likeness))
        columns = [np.concatenate([p[j] for p in parts]) if parts else [] for j in range(3)]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    by = [*key, "part"]
    found = held.groupBy(*by).cogroup(searches.groupBy(*by)).applyInArrow(score, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def unit64(vectors: np.ndarray) -> np.ndarray:
    wide = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of each query and the vector in its row, in double precision; each by the same sums whatever the others are, scaled by the largest component."""
    q, v = (x / np.abs(x).max(axis=1, keepdims=True) for x in (queries, vectors))
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of one query and several vectors."""
    return _cosines(np.broadcast_to(query, vectors.shape), vectors)
