"""Transcripts as lines: numbered, with their page, and what is page furniture.

A transcript is one Markdown text per document, each page between ``<!-- PAGE_START: n -->`` and ``<!-- PAGE_END: n -->``. Documents are dealt by
``document_id`` before their lines are made, so texts move once and every window over a document's lines runs where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import text as T

_MARK = r"^<!--\s*PAGE_(START|END):\s*(\d+)\s*-->$"


def by_line():
    """A document's lines in order. All windows over lines use it, so they share one sort."""
    return Window.partitionBy("document_id").orderBy("line_no")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows by document anew, after a union: Spark takes a union of parts that lie by document to lie so itself, yet such a union has the partitions of all its parts."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "document_id")


def shared(rows: DataFrame, more: int = 1) -> DataFrame:
    """Rows by document, made once for all that read them: as one value that is always whole (an array of one, into which the optimizer does not look), they are
    one exchange however few columns each reader needs.

    ``more`` partitions less than the rows lie in already (or more, of few), or Spark would leave the exchange out and make the rows anew for each reader. Less,
    because one task more than there are cores would be a round of its own.
    """
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.select("document_id", T.once(F.array(F.struct(*[c for c in rows.columns if c != "document_id"]))).alias("row"))
    moved = whole.repartition(count - more if count > 2 * more else count + more, "document_id")
    # Bound: a reader's filter would move behind the exchange, which then was no longer the one that others read.
    return moved.select("document_id", T.once(F.element_at("row", F.lit(1))).alias("row")).select("document_id", *[F.col("row")[c].alias(c) for c in rows.columns if c != "document_id"])


def lines(transcripts: DataFrame, **also: Column) -> DataFrame:
    """(document_id, line_no, raw, line, page): ``line`` without white space at its ends, ``page`` that of the last start mark up to it; and what ``also`` makes of the transcript."""
    dealt = transcripts.select("document_id", "markdown").repartition("document_id")
    # Bound: the optimizer would ask for its size in a filter first, and make each text twice for that.
    split = dealt.select("document_id", *[T.once(c).alias(k) for k, c in also.items()], T.once(T.split_lines(F.coalesce("markdown", F.lit("")))).alias("lines"))
    rows = split.select("document_id", *also, F.posexplode("lines").alias("line_no", "raw")).withColumn("line", T.strip_short(F.col("raw")))
    page = F.when(F.contains("raw", F.lit("<!-- PAGE_START: ")), F.regexp_extract("raw", r"<!-- PAGE_START: (\d+) -->", 1))
    page = F.when(page != "", F.try_to_number(page, F.lit("999999999"))).cast("int")
    return rows.withColumn("page", F.last(page, ignorenulls=True).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))


def prose(numbered: DataFrame) -> DataFrame:
    """The lines that are prose."""
    return numbered.where(~T.is_noise(F.col("line")))


def furniture(rows: DataFrame, document: str = "document_id", page: str = "page", key: str = "key", least: int = 3, share: float = 0.25) -> DataFrame:
    """(document, key) of lines that stand on many of a document's pages: at least ``least`` and ``share`` of them. Null is a page of its own.

    ``rows`` has a row per line; a page that holds nothing is a row with a null key.
    """
    seen = F.coalesce(F.col(page).cast("string"), F.lit("none"))
    # Distinct (page, key) first: a key that stands on every line of a page is one row then, by a map-side combine.
    once = rows.select(document, F.col(key).alias("key"), seen.alias("page"), F.col(page).isNotNull().alias("numbered")).distinct()
    pages = once.where("numbered").groupBy(document).agg(F.count_distinct("page").alias("pages"))
    on = once.where("key is not null and key <> ''").groupBy(document, "key").agg(F.count("*").alias("n"))
    need = F.greatest(F.lit(float(least)), share * F.coalesce("pages", F.lit(0)))
    return on.join(pages, document, "left").where(F.col("n") >= need).select(document, "key", "n")


def transcript_furniture(numbered: DataFrame) -> DataFrame:
    """(document_id, key) of running headers and footers, by the page that either mark names last."""
    mark = F.regexp_extract("line", _MARK, 2)
    at = F.last(F.when(mark != "", F.try_to_number(mark, F.lit("999999999"))).cast("int"), ignorenulls=True).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    rows = numbered.select("document_id", at.alias("page"), F.when((mark == "") & (F.col("line") != "") & ~F.startswith("line", F.lit("|")), T.token_key(T.clean_piece(F.col("line")))).alias("key"))
    return furniture(rows).select("document_id", "key")


def islands(rows: DataFrame, partition: list[str], order: list[str], breaks: str, name: str = "island") -> DataFrame:
    """Numbers runs of rows: ``breaks`` is a boolean that starts a new run."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn(name, F.sum(F.col(breaks).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order; with a limit of one per key and task before rows move, so hot keys cost no more than others."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


SECTION_LEAD = r"(?iU)^[ \t]*(?:#{1,6}\s*)?(?:\d+(?:\.\d+)*\.?\s*)?"


def opens(raw: Column, heading: str) -> Column:
    return raw.rlike(rf"{SECTION_LEAD}(?:{heading})[ \t]*:?[ \t]*$")


def ends(raw: Column, stop: str) -> Column:
    return raw.rlike(rf"{SECTION_LEAD}(?:{stop})\b")


def sections(numbered: DataFrame, heading: str, stop: str) -> DataFrame:
    """The lines under a document's last heading that matches, up to the next line that begins with ``stop``: with ``section_line``."""
    is_head = opens(F.col("raw"), heading)
    whole = Window.partitionBy("document_id")
    begin = F.max(F.when(is_head, F.col("line_no"))).over(whole)
    after = numbered.withColumn("begin", begin).where(F.col("line_no") > F.col("begin"))
    end = F.min(F.when(ends(F.col("raw"), stop), F.col("line_no"))).over(whole)
    return after.withColumn("end", end).where(F.col("end").isNull() | (F.col("line_no") < F.col("end"))).withColumn("section_line", F.col("line_no") - F.col("begin")).drop("begin", "end")
