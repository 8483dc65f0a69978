"""Transcripts made from rows: Markdown tables, pages, and whole reports from the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportmill.functions import text as T


def escape_cell(c: Column) -> Column:
    """Of a column or bound value: breaks are spaces, pipes entities, nothing is ''. Most cells are printable ASCII without either and stay as they are, which is far cheaper to see."""
    escaped = T.strip(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|\n", " "), F.lit("|"), F.lit("&#124;")))
    return F.when(c.rlike(r"\A[!-{}~](?:[ -{}~]*[!-{}~])?\z"), c).otherwise(escaped)


def row_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """Rows of cells as a Markdown table: empty rows go, short ones are filled up, the first is the header; '' without rows."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, escape_cell)), lambda r: F.exists(r, lambda x: x != ""))

    def lined(t: Column) -> Column:
        rule = row_line(F.array_repeat(F.lit("---"), t["width"]))
        full = F.transform(t["clean"], lambda r: row_line(F.concat(r, F.array_repeat(F.lit(""), t["width"] - F.size(r)))))
        return T.let(full, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(rule), F.slice(x, 2, 1_000_000)), "\n"))

    # Rows and width are bound: every row is filled up to the width, and would make all rows anew for it.
    sized = T.let(clean, lambda c: F.struct(c.alias("clean"), F.array_max(F.transform(c, F.size)).alias("width")))
    return T.let(sized, lambda t: F.when(F.size(t["clean"]) > 0, lined(t)).otherwise(""))


def page_block(page: Column, body: Column) -> Column:
    return F.format_string("<!-- PAGE_START: %d -->\n## Page %d\n\n%s\n\n<!-- PAGE_END: %d -->", page, page, T.strip(body), page)


def transcript(pages: DataFrame) -> DataFrame:
    """(document_id, markdown) of pages (document_id, page, body)."""
    blocks = pages.select("document_id", "page", page_block(F.col("page"), F.col("body")).alias("b"))
    got = blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "b"))).alias("b"))
    return got.select("document_id", F.array_join(F.transform("b", lambda x: x["b"]), "\n\n").alias("markdown"))


def date_in_style(d: Column, style: Column) -> Column:
    """A date as one of the four shapes that reports use."""
    month = F.date_format(d, "MMMM")
    return (
        F.when(style == 0, F.date_format(d, "yyyy-MM-dd")).when(style == 1, F.date_format(d, "dd.MM.yyyy"))
        .when(style == 2, F.concat(F.dayofmonth(d).cast("string"), F.lit("th "), month, F.lit(" "), F.year(d).cast("string")))
        .otherwise(F.concat(month, F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), F.year(d).cast("string")))
    )


def severity_text(quantity: Column, style: Column) -> Column:
    """A severity as reports spell it: five levels by quantity, in three spellings."""
    level = F.when(quantity <= 10, "low").when(quantity <= 20, "medium").when(quantity <= 30, "high").when(quantity <= 40, "critical").otherwise("info")
    return F.when(style == 0, F.initcap(level)).when(style == 1, F.upper(level)).otherwise(F.concat(level, F.lit(" (rated)")))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, page, serial, asset, title, cwe, severity, status, shipped): what reports are made of. A document per customer, a page per order, a finding
    per line, numbered in an order of all its columns."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    pages = o.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"))
    w = Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate")
    rows = joined.withColumn("serial", F.row_number().over(w)).join(pages, "o_orderkey")
    return rows.select(
        F.format_string("report-%d", "o_custkey").alias("document_id"), "page", "serial", F.format_string("host%d.example", "l_suppkey").alias("asset"),
        F.format_string("Weakness %d | part %d", "l_linenumber", "l_partkey").alias("title"), F.format_string("CWE-%d", F.col("l_partkey") % 1000).alias("cwe"),
        severity_text(F.col("l_quantity"), F.col("l_linenumber") % 3).alias("severity"), F.when(F.col("l_linestatus") == "F", "Closed").otherwise("open").alias("status"),
        date_in_style(F.col("l_shipdate"), F.col("l_linenumber") % 4).alias("shipped"),
    )


HEADER = ["S. No", "Affected Asset", "Vulnerability Title", "CWE", "Severity", "Status", "Date"]


def order_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, markdown): reports with one findings table on each page, under a running header."""
    rows = order_lines(spark, sf_dir)
    cells = F.array(F.col("serial").cast("string"), "asset", "title", "cwe", "severity", "status", "shipped")
    got = rows.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("serial", cells.alias("c")))).alias("r"))
    table = markdown_table(F.concat(F.array(F.array(*map(F.lit, HEADER))), F.transform("r", lambda x: x["c"])))
    body = F.concat(F.lit("Audit report of orders\n\n"), table, F.lit("\n\nPage footer text"))
    return transcript(got.select("document_id", "page", body.alias("body")))
