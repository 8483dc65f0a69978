import hashlib
import itertools
import random

import numpy as np
import pytest

from reportmill.llm import _common as c
from reportmill.llm import neardup
from reportmill.llm.components import components
from tests.llm.odd import ROWS, documents


def sets(text, k):
    words = ("" if text is None else text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent=80):
    """Class ids by comparing all pairs."""
    shingles = [sets(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = shingles[i], shingles[j]
        same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
        if same_id or a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[find(j)] = find(i)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(shingles[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def found(df, **how):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, **how).collect()), key=str)


def family(seed, n, words, edits):
    """Copies of one text with ever more edits, so that links make chains and stars."""
    draw = random.Random(seed)
    base = [f"{seed}x{draw.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(draw.randrange(edits + 1)):
            w[draw.randrange(words)] = f"e{draw.randrange(10**6)}"
        rows.append((seed * 1000 + i, " ".join(w), "en", "s", 1))
        if i % 5 == 4:
            base = w
    return rows


@pytest.mark.parametrize("clashes", [False, True])
@pytest.mark.parametrize("k", [4, 5])
def test_odd_rows_as_brute_force(spark, k, clashes):
    assert found(documents(spark, clashes=clashes), k=k) == brute(ROWS, k)


def test_chains_and_hubs_as_brute_force(spark):
    rows = [r for seed, n, words, edits in ((1, 40, 120, 6), (2, 30, 60, 2), (3, 25, 200, 14), (4, 12, 30, 1)) for r in family(seed, n, words, edits)]
    random.Random(5).shuffle(rows)
    assert found(documents(spark, rows), k=4, block=8) == brute(rows, 4)


def test_real_documents_as_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert found(df, k=4) == brute(rows, 4)


def test_one_of_each_group_stays(spark):
    df = documents(spark, clashes=True)
    left = neardup.drop_near_duplicates(df, k=5)
    assert left.columns == df.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(x for x in ids if x) == [1, 4, 5, 6, 7, 9, 10, 2**53 + 1]


def test_one_of_each_group_without_ids_stays(spark):
    near = ROWS[0][1].replace("w7 ", "v7 ")
    rows = [(None, ROWS[0][1], "en", "a", 1), (None, near, "en", "a", 1), (None, ROWS[0][1], "fr", "a", 1), (None, "", "en", "a", 1), (None, None, "en", "a", 1), (None, "all alone here now", "en", "a", 1), (5, "all by itself there then", "en", "a", 1)]
    got = neardup.drop_near_duplicates(documents(spark, rows, True), k=5).collect()
    assert sorted(str(r.text)[:3] for r in got) == ["", "None"[:3], "all", "all", "w0 "]


def test_hot_keys_are_dealt_out(spark):
    """A join whose key holds most rows gives what a plain join gives."""
    rows = spark.range(5000).selectExpr("case when id % 3 = 0 then null when id % 5 < 4 then 7 else id % 11 end as k", "id as v")
    side = spark.range(11).selectExpr("id as k", "id * 10 as w")
    for how in ("inner", "left"):
        got, want = c.salted_join(rows, side, "k", 5000, how, least=100), rows.join(side, "k", how)
        assert sorted(map(str, got.select("k", "v", "w").collect())) == sorted(map(str, want.select("k", "v", "w").collect()))


def test_empty_table(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    assert neardup.drop_near_duplicates(documents(spark, [])).count() == 0


def test_odd_sketches_estimate_high_similarity():
    sketcher = neardup.Sketcher()
    most = sketcher.most_ones(0.8)
    draw = np.random.default_rng(1)
    kept = far = 0
    for i in range(200):
        x = np.unique(draw.integers(0, 2**63, 1000, dtype=np.uint64))
        near = np.unique(np.concatenate([x[:900], draw.integers(0, 2**63, 90, dtype=np.uint64)]))  # 0.83
        away = np.unique(np.concatenate([x[:400], draw.integers(0, 2**63, 600, dtype=np.uint64)]))  # 0.25
        one, two, three = (np.frombuffer(sketcher.odd(sketcher.samples(s)), np.uint8) for s in (x, near, away))
        kept += int(np.bitwise_count(one ^ two).sum()) <= most
        far += int(np.bitwise_count(one ^ three).sum()) <= most
    assert kept == 200 and far == 0


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(8, 60)] + [(7, 7), (8, 7)]
    other = [(1001, 1000), (1003, 1002), (1002, 1000)]
    got = dict(components(spark.createDataFrame(path + star + other, "u long, v long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 60)}, **{i: 1000 for i in range(1000, 1004)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_digest_tells_sets_apart():
    a, b = neardup.shingle_set("a b c d e", 4), neardup.shingle_set("e d c b a", 4)
    assert len(a) == 2 and hashlib.blake2b(a.tobytes()).digest() != hashlib.blake2b(b.tobytes()).digest()
    assert len(neardup.shingle_set("A b", 4)) == 1 and (neardup.shingle_set("A b", 4) == neardup.shingle_set("a\tB", 4)).all()
