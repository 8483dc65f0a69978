import hashlib

import pytest
from pyspark.sql import functions as F

from reportmill.llm import syncmers as S
from tests.llm.odd import ROWS, documents


def test_next_document_and_edited_text(spark):
    for clashes in (False, True):
        rows = [r for r in ROWS if r[0] is not None and r[0] != 3]
        got = {r.doc_id: r for r in S.fingerprint_edits(documents(spark, rows, clashes)).collect()}
        order = sorted(rows, key=lambda r: -r[0])
        for r, after in zip(order, order[1:] + order[:1]):
            text, other = r[1] or "", after[1] or ""
            cut = len(text) // 3
            edited = text[: len(text) - cut] + other[:cut]
            assert got[r[0]].n_chars == len(text)
            assert got[r[0]].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_order_holds_over_ranges_and_hot_ids(spark):
    """Ids in disorder, one with a third of all rows, ranges of a few rows."""
    n = 900
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(400)).otherwise((F.col("id") * 7919) % 5000).alias("doc_id"), F.xxhash64("id").alias("tie"), F.col("id").alias("no")).repartition(5)
    rows = [(r.doc_id, r.tie, r.no, r.next.no) for r in S.with_next(df, block_rows=10).collect()]
    order = [x[2] for x in sorted(rows, key=lambda r: (-r[0], r[1]))]
    after = dict(zip(order, order[1:] + order[:1]))
    assert len(rows) == n and all(after[no] == nxt for _, _, no, nxt in rows)


def test_real_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = S.fingerprint_edits(df, block_rows=30).collect()
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    prints = {}
    for r in got:
        text, other = texts[r.doc_id], texts[after[r.doc_id]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    near = sorted(r.near_edited for r in got)
    assert near[len(near) // 2] > 0.5


def brute_positions(hashes, k, s, of):
    smers = [of(hashes[i : i + s]) for i in range(len(hashes) - s + 1)]
    span = k - s + 1
    return [i for i in range(len(hashes) - k + 1) if min(smers[i : i + span]) in (smers[i], smers[i + span - 1])]


@pytest.mark.parametrize("k,s", [(8, 2), (5, 1), (6, 3)])
def test_choice_is_closed_syncmers(spark, k, s):
    text = " ".join(f"w{(i * i) % 53}" for i in range(120))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("h", S.token_hashes(F.col("text"))).withColumn("m", S.s_mers(F.col("h"), s))
    row = df.withColumn("at", S._chosen(F.col("m"), F.size("h"), k, s)).collect()[0]
    smers = list(row.m)
    table = {tuple(row.h[i : i + s]): smers[i] for i in range(len(smers))}
    assert [x - 1 for x in row["at"]] == brute_positions(list(row.h), k, s, lambda t: table[tuple(t)])
    gaps = [b - a for a, b in zip(row["at"], row["at"][1:])]
    assert max(gaps) <= k - s + 1


def test_anchors_are_free_of_context(spark):
    part = " ".join(f"p{i}" for i in range(60))
    a = spark.createDataFrame([(1, f"x y z {part} tail")], "doc_id long, text string")
    b = spark.createDataFrame([(2, f"quite another head of words {part}"), (3, "nothing of it")], "doc_id long, text string")
    got = S.anchor_matches(a, b).collect()
    assert len(got) > 8 and {r.a_at - r.b_at for r in got} == {3 - 5} and {r.b_id for r in got} == {2}


def test_equal_texts_nulls_and_repeats(spark):
    got = S.fingerprint_edits(documents(spark)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint == by[3][0].fingerprint == by[3][1].fingerprint and by[7][0].fingerprint == by[8][0].fingerprint
    assert by[4][0].fingerprint == by[5][0].fingerprint == "" and len(by[7][0].fingerprint) == 8
    assert S.fingerprint_edits(documents(spark, [])).count() == 0
    one = S.fingerprint_edits(documents(spark, ROWS[:1])).collect()[0]
    assert one.near_next == 1.0
