import random

import numpy as np
import pytest

from reportmill.llm import toxicity as T
from tests.llm.odd import ROWS, documents


def corpus(n=1500, seed=1):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(5, 300))]
        toxic, junk = draw.random() < 0.15, draw.random() < 0.2
        if toxic:
            for _ in range(draw.randrange(1, 4)):
                words.insert(draw.randrange(len(words)), draw.choice(["Vile", "foul!", "nasty,", "rude"]))
        if junk:
            words += ["$$$", "click", "buy"]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    df, lab = documents(spark, rows, True), spark.createDataFrame(labels, LABELS)
    chain = T.train(df, lab.where("doc_id < 1000"))
    scored = {r.doc_id: r for r in T.score_toxicity(df, chain).collect()}
    held = [(scored[i], q, t) for i, q, t in labels if i >= 1000]
    assert np.mean([(s.p_toxic >= 0.5) == (t == 1) for s, _, t in held]) > 0.98
    assert np.mean([(s.p_low_quality >= 0.5) == (q == 0) for s, q, _ in held]) > 0.98
    assert np.mean([(s.p_all_at_once >= 0.5) == (q == 0 and t == 1) for s, q, t in held]) > 0.97


def test_real_labels(spark):
    sf = "/root/testdata/sf0.01"
    df, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = {r.doc_id: r.p_toxic for r in T.score_toxicity(df, T.train(df, lab.where("doc_id % 5 <> 0"))).collect()}
    held = [(scored[r.doc_id] >= T.THRESHOLD, r.toxic) for r in lab.where("doc_id % 5 = 0").collect()]
    assert sum(p and not t for p, t in held) <= 1


def test_later_models_see_out_of_fold_probabilities(monkeypatch):
    seen = []
    fit = T.fit_linear
    monkeypatch.setattr(T, "fit_linear", lambda rows, before, y, **k: seen.append((len(rows), before.shape[1], before.copy())) or fit(rows, before, y, **k))
    draw = np.random.default_rng(1)
    rows = [np.unique(draw.integers(0, 50, 10)).astype(np.uint32) for _ in range(80)]
    y = np.column_stack([[int(3 in r) for r in rows], [int(5 in r) for r in rows]])
    T.fit_chain(rows, y, ["a", "b"], folds=4)
    assert [s[:2] for s in seen] == [(80, 0), (60, 0), (60, 0), (60, 0), (60, 0), (80, 1)]
    inside = fit(rows, np.zeros((80, 0)), y[:, 0].astype(float)).score(rows, np.zeros((80, 0)))
    assert not np.allclose(seen[-1][2][:, 0], inside)


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows(spark, clashes):
    df = documents(spark, clashes=clashes)
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (None, 1, 1), (4, 1, 0), (99, 0, 1)], LABELS)
    chain = T.train(df, lab)
    got = T.score_toxicity(df, chain).collect()
    assert len(got) == len(ROWS) and all(0 <= r.p_toxic <= 1 for r in got)
    left = T.drop_toxic(df, chain)  # too few labels to tell anything by
    assert left.columns == df.columns and not chain.tells("toxic") and left.count() == len(ROWS)
    bare = T.train(df, lab.where("false"))
    assert T.drop_toxic(df, bare).count() == len(ROWS)
    assert T.drop_toxic(documents(spark, []), T.train(documents(spark, []), lab)).count() == 0
