"""The stages against plain versions of themselves on a small table."""

import importlib
from collections import Counter

import pytest

from reportmill.llm import toxicity
from tests.llm.odd import documents
from tests.llm.test_neardup import brute as near_brute

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/t-{name}")
        docs = spark.read.parquet(path)
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = kept["toxicity"]
    chain = toxicity.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score_toxicity(before, chain).collect() if r.p_toxic >= toxicity.THRESHOLD}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = kept["near_duplicates"]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    assert {r.doc_id for r in after.collect()} == {c for _, _, c in near_brute(rows, 5)}
    before, after = kept["mixing"]
    assert set(Counter(r.doc_id for r in after.collect())) <= {r.doc_id for r in before.collect()}
    before, after = kept["packing"]
    assert Counter(r.doc_id for r in after.where("start = 0").collect()) == Counter(r.doc_id for r in before.collect())


def test_odd_rows_pass_every_stage(spark, tmp_path):
    docs = documents(spark, clashes=True)
    spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.where("false")):
        now = rows
        for name, stage in pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            assert name == "packing" or now.columns == docs.columns
        assert (now.count() > 0) == (rows is docs)


def test_it_is_registered():
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"].__wrapped__ is pipeline.run and "pipeline" not in entry.oracle_sql()
    assert len([n for n in entry.queries() if n.startswith("op")]) == 10
