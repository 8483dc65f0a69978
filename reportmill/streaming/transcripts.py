"""Structured Streaming over transcripts.

Within a document, work is stateless: ``prose_stream`` and ``token_stream`` are plain column expressions. Records need a document's lines together, which arrive in one
row; ``write_records`` runs the whole route on each micro-batch. Counts over time use event-time windows with a watermark, so state is bounded by the lateness allowed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reportmill.functions import text as T
from reportmill.plans import structure

SCHEMA = "document_id string, markdown string, arrived timestamp"


def read_transcripts(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def prose_stream(transcripts: DataFrame) -> DataFrame:
    """(document_id, arrived, line_no, line) of prose lines."""
    return transcripts.select("document_id", "arrived", F.posexplode(T.prose_lines(F.col("markdown"))).alias("line_no", "line"))


def token_stream(transcripts: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, n_documents, n_tokens) by time of arrival; rows later than ``late`` are left out, as their window is closed."""
    sized = transcripts.withWatermark("arrived", late).select("arrived", F.size(T.tokens(F.col("markdown"))).cast("long").alias("n"))
    return sized.groupBy(F.window("arrived", window).alias("window")).agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_tokens"))


def write_records(transcripts: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = structure.run_report, **trigger) -> StreamingQuery:
    """Writes what ``make`` gives for the documents that arrive, their run reports, as Parquet under ``path``; each micro-batch has a folder of its own, overwritten if it is run again, so a restart repeats nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        make(rows.select("document_id", "markdown")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return transcripts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
