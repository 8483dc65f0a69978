from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.llm import mixing
from tests.llm.odd import ROWS, SCHEMA, documents


def targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; what is over a cap goes to the others, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / share > most * sizes[s]]
        if not over:
            return {**fixed, **{s: rest * w[s] / share for s in free}}
        fixed.update({s: most * sizes[s] for s in over})


def size(text):
    return len((text or "").encode().split())


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows(spark, clashes):
    got = mixing.mix(documents(spark, clashes=clashes)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in ROWS)
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += size(r[1])
    want = targets(dict(sizes))
    by_row = {(r[0], size(r[1])): r[3] for r in ROWS}
    for r in got:
        source = by_row[(r.doc_id, r.size)]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * len(r.placed)
    again = mixing.mix(documents(spark, clashes=clashes)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_real_documents_meet_targets(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in rows:
        b = by[r.source]
        b[0], b[1], b[2], b[3] = b[0] + r.size, b[1] + r.taken, r.target, max(b[3], r.size)
    want = targets({s: b[0] for s, b in by.items()})
    for s, (_, taken, target, longest) in by.items():
        assert target == pytest.approx(want[s])
        assert abs(taken - target) <= longest


@pytest.mark.parametrize("block_docs,run_blocks,levels", [(4, 2, 3), (64, 4096, None)])
def test_taken_as_brute_force(spark, sf, block_docs, run_blocks, levels):
    """The rule in plain Python: blocks whole by turns, then those at the front of the extra turn, then the documents that fit."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").unionByName(documents(spark, [r for r in ROWS if r[0] is not None]).select("doc_id", "text", "source").where("doc_id <> 3"))
    df = df.withColumn("doc_id", F.xxhash64("doc_id", "text"))
    seed = 9
    got = {r.doc_id: r for r in mixing.mix(df, block_docs=block_docs, run_blocks=run_blocks, levels=levels, seed=seed).collect()}
    rows = df.select("doc_id", "text", "source", F.xxhash64(F.lit(seed), "doc_id", "text").alias("mark")).withColumn("h", F.xxhash64("mark", F.lit(seed + 1))).collect()
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    shifts = {(r.s, r.t): r.h for r in spark.range(1, len(sources) + 1).withColumnRenamed("id", "s").crossJoin(spark.range(4).withColumnRenamed("id", "t")).select("s", "t", F.xxhash64(F.lit(seed), "s", "t").alias("h")).collect()}
    sizes = {s: sum(size(r.text) for r in rows if r.source == s) for s in sources}
    want = targets(sizes)
    for no, s in enumerate(sources, 1):
        mine = [r for r in rows if r.source == s]
        n, epochs = -(-len(mine) // block_docs), int(want[s] // sizes[s]) if sizes[s] else 0
        rest = want[s] - epochs * sizes[s]
        place = lambda r, n=n, no=no, epochs=epochs: (998_244_353 * (r.h % n) + shifts[no, epochs]) % n
        taken, left = Counter({r.doc_id: epochs * size(r.text) for r in mine}), rest
        for p in range(n):
            block = [r for r in mine if place(r) == p]
            words = sum(size(r.text) for r in block)
            if left <= 0:
                break
            if words <= left:
                taken.update({r.doc_id: size(r.text) for r in block})
                left -= words
                continue
            out = []
            for r in sorted(block, key=lambda r: r.mark):
                if size(r.text) <= left:
                    taken[r.doc_id] += size(r.text)
                    left -= size(r.text)
                else:
                    out.append(r)
            least = min(out, key=lambda r: (size(r.text), r.mark))
            if size(least.text) < 2 * left:
                taken[least.doc_id] += size(least.text)
            break
        assert {r.doc_id: got[r.doc_id].taken for r in mine} == {r.doc_id: taken[r.doc_id] for r in mine}


def test_rows_come_shard_by_shard(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    plan = {r.doc_id: r.placed for r in mixing.mix(df, levels=3).collect()}
    parts = mixing.mix_documents(df, levels=3).select(F.spark_partition_id().alias("p"), "doc_id").collect()
    by = defaultdict(list)
    for r in parts:
        by[r.p].append(r.doc_id)
    for ids in by.values():  # in each part of the output the shards follow each other, each in the order of its keys
        places = sorted((p.shard, p.shuffle_key, i) for i in set(ids) for p in plan[i])
        shards = {p.shard for i in ids for p in plan[i]}
        kept = [x for x in places if x[0] in shards]
        positions = iter(kept)
        assert all(any(i == x[2] for x in positions) for i in ids)
    assert Counter(r.doc_id for r in parts) == Counter({i: len(p) for i, p in plan.items() if p})


def test_sources_that_stop(spark):
    rows = [(i, "w " * (1 if i % 50 else 100), "", "abcde"[min(4, i % 9)], 1) for i in range(900)]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([(r[3], size(r[1])) for r in rows], "source string, size long"), (1, 20, 3), 3).collect()}
    want = targets(dict(sizes), (1, 20, 3))
    assert got == pytest.approx(want) and any(want[s] == 3 * sizes[s] for s in sizes)


def test_shards_are_disjoint_and_exact(spark):
    rows = [(i, "w " * (i % 7 + 1), "", "ab"[i % 5 == 0], 1) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), block_docs=20, levels=3).collect()
    taken = Counter()
    for r in got:
        assert [p.copy for p in r.placed] == list(range(len(r.placed)))
        assert all(p.shard is not None and 0 <= p.shard < 8 for p in r.placed)
        taken.update(p.shard for p in r.placed)
    assert len(taken) == 8 and max(taken.values()) < 2 * min(taken.values())


def test_tree_keeps_counts(spark):
    counts = spark.createDataFrame([(1, 1000), (2, 37), (3, 0), (4, 260)], "source_no long, copies long")
    leaves = mixing.split_tree(counts, 4, 5).collect()
    total = Counter()
    for x in leaves:
        total[x.source_no] += x.copies
        assert x.copies >= 0
    assert total == Counter({1: 1000, 2: 37, 4: 260, 3: 0})
    shard = Counter()
    for x in leaves:
        shard[x.shard] += x.copies
    assert len(shard) == 16 and max(shard.values()) - min(shard.values()) <= 1


def test_draws_follow_the_hypergeometric_distribution(spark):
    df = spark.range(20_000).select(mixing._draw(F.lit(60).cast("long"), F.lit(20).cast("long"), F.lit(15).cast("long"), mixing._uniform(F.col("id"))).alias("x"))
    got = np.array([r.x for r in df.collect()])
    draw = np.random.default_rng(1).hypergeometric(20, 40, 15, 200_000)
    for x in range(16):
        assert abs((got == x).mean() - (draw == x).mean()) < 0.015
    edge = spark.range(50).select(*[mixing._draw(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(d).cast("long"), mixing._uniform(F.col("id"))).alias(f"x{i}") for i, (n, k, d) in enumerate([(0, 0, 0), (9, 9, 4), (9, 0, 4), (9, 4, 9), (9, 4, 0)])])
    assert edge.distinct().collect() == [(0, 4, 0, 4, 0)]


def test_mixed_documents(spark):
    df = documents(spark, clashes=True)
    plan = {(r.doc_id, r.size): len(r.placed) for r in mixing.mix(df).collect()}
    left = mixing.mix_documents(df)
    assert left.columns == df.columns
    got = Counter((r.doc_id, size(r.text)) for r in left.collect())
    rows = Counter((r[0], size(r[1])) for r in ROWS)
    assert got == Counter({k: n * plan[k] for k, n in rows.items() if plan[k]})


def test_empty_table(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix_documents(documents(spark, [])).count() == 0
