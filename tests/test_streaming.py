"""Streams give what tables give."""

import datetime

from reportmill.operators import extract, lines, tables
from reportmill.streaming import transcripts as S

def _records(rows):
    numbered = lines.lines(rows)
    return extract.labels(numbered, tables.tables(numbered))


T0 = datetime.datetime(2026, 1, 1, 12, 0)


def test_streams(spark, tmp_path):
    rows = [("a", "## Page 1\nOne line here\n\nSecond line", T0), ("b", "| Report ID | R-1 |\n|---|---|\n| x | y |", T0 + datetime.timedelta(minutes=11))]
    spark.createDataFrame(rows, S.SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = S.read_transcripts(spark, f"{tmp_path}/in")
    S.prose_stream(stream).writeStream.format("memory").queryName("prose").trigger(availableNow=True).start().awaitTermination(60)
    assert [r.line for r in spark.table("prose").orderBy("document_id", "line_no").collect()] == ["One line here", "Second line"]
    S.token_stream(stream).writeStream.format("memory").outputMode("complete").queryName("tokens").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.n_documents for r in spark.table("tokens").collect()) == [1, 1]
    S.write_records(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", make=_records).awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.document_id, r.field, r.value) for r in got.collect()) == [("b", "report_id", "R-1")]
