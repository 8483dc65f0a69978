"""Markdown tables in transcripts, their header rows, and the roles of their columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import text as T
from reportmill.operators.lines import by_line

# What tells the column of a findings table, in the order in which roles are tried.
FINDING_COLUMNS = {
    "sr": r"^\s*(?:s\.?\s*no|sr|sl|#)",
    "title": r"observation\s+title|vulnerability\s+(?:name|title)|finding\s+title|name\s+of\s+(?:the\s+)?vulnerab"
    r"|^\s*(?:observations?|vulnerabilit(?:y|ies)|findings?|title|issue)\s*$",
    "severity": r"severity|risk\s+rating|^\s*risk\s*$",
    "cwe": r"cwe|cve",
    "asset": r"affected|asset|\burl\b|\bip\b|host",
    "recommendation": r"recommend|remediation|mitigation",
    "status": r"status",
    "new_or_repeat": r"new\s*(?:or|/)\s*repeat",
    "impact": r"impact",
    "reference": r"reference",
    "complied": r"complied",
}
# Likewise for a table of assets.
ASSET_COLUMNS = {
    "description": r"asset\s+description|asset\s+name|application\s+name|host\s*name|^\s*asset\b",
    "criticality": r"critical",
    "internal_ip": r"internal\s+ip|private\s+ip",
    "public_ip": r"public\s+ip|external\s+ip",
    "url": r"\burl\b|end\s*point",
    "functions": r"function|in[\s-]scope",
}


def _row_lines(numbered: DataFrame) -> DataFrame:
    is_row = T.is_table_row(F.col("line"))
    flagged = numbered.withColumn("is_row", is_row).withColumn("starts", F.col("is_row") & ~F.coalesce(F.lag("is_row").over(by_line()), F.lit(False)))
    before = by_line().rowsBetween(Window.unboundedPreceding, 0)
    run = flagged.withColumn("table_no", F.sum(F.col("starts").cast("int")).over(before)).withColumn("page", F.last(F.when(F.col("starts"), F.struct("page")), ignorenulls=True).over(before)["page"])
    data = run.where("is_row").where(~F.col("line").rlike(r"(?U)^\|[\s\-:|]+\|$"))
    inner = F.expr("substring(line, 2, length(line) - 2)")
    cells = F.transform(F.split(inner, r"\|", -1), lambda x: F.replace(T.strip_short(x), F.lit("&#124;"), F.lit("|")))
    return data.select("document_id", "table_no", "page", "line_no", cells.alias("cells"))


def table_rows(numbered: DataFrame) -> DataFrame:
    """(document_id, table_no, row_no, page, line_no, cells): runs of lines between pipes, without rule lines. A run with rule lines alone has no rows.

    ``page`` is that of the run's first line. Pipes inside cells come as ``&#124;``.
    """
    order = Window.partitionBy("document_id", "table_no").orderBy("line_no")
    return _row_lines(numbered).select("document_id", "table_no", (F.row_number().over(order) - 1).alias("row_no"), "page", "line_no", "cells")


def tables(numbered: DataFrame) -> DataFrame:
    """One row per table: document_id, table_no, page, line_no, rows (cells of each row, in order)."""
    # By lines: rows needn't be numbered to be put in order.
    got = _row_lines(numbered).groupBy("document_id", "table_no").agg(F.min("line_no").alias("line_no"), F.first("page").alias("page"), F.array_sort(F.collect_list(F.struct("line_no", "cells"))).alias("r"))
    # Bound: what readers ask of a table's head or size would put all its rows in order anew.
    return got.select("document_id", "table_no", "page", "line_no", T.once(F.transform("r", lambda x: x["cells"])).alias("rows"))


def cells(table: DataFrame) -> DataFrame:
    """(document_id, table_no, row_no, col_no, page, cell)."""
    return table.select("document_id", "table_no", "page", F.posexplode("rows").alias("row_no", "c")).select("document_id", "table_no", "row_no", F.posexplode("c").alias("col_no", "cell"), "page")


def header_text(rows: Column, n: int = 4) -> Column:
    """The first rows of a table as one lower-case text."""
    return F.lower(F.array_join(F.transform(F.slice(rows, 1, n), lambda r: F.array_join(r, " ")), " "))


def header_size(rows: Column) -> Column:
    """How many leading rows are header: at most four and never the last; without a serial number, URL, address, long cell, or, after the first, a severity."""

    def content(r: Column, i: Column) -> Column:
        all_of = F.array_join(r, " ")
        return (
            T.serial(F.get(r, F.lit(0))).isNotNull() | all_of.rlike(T.URL) | all_of.rlike(T.IPV4)
            | ((i > 0) & all_of.rlike(r"(?iU)\b(critical|high|medium|low|informational)\b")) | F.exists(r, lambda x: F.length(x) > 60)
        )

    head = F.slice(rows, F.lit(1), F.least(F.lit(4), F.size(rows) - 1))
    first = F.get(F.filter(F.transform(head, lambda r, i: F.when(content(r, i), i)), lambda i: i.isNotNull()), F.lit(0))
    return F.coalesce(first, F.size(head))


def merged_header(rows: Column, n: Column) -> Column:
    """The header rows joined column by column."""
    head = F.slice(rows, F.lit(1), n)
    width = F.coalesce(F.array_max(F.transform(head, F.size)), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: T.strip(F.array_join(F.transform(F.filter(head, lambda r: F.size(r) > i), lambda r: F.get(r, i)), " ")))).otherwise(none)


def column_roles(header: Column, patterns: dict[str, str]) -> Column:
    """A map of role to column: each cell, from the left, takes the first role not yet taken whose pattern it shows."""
    start = F.create_map().cast("map<string,int>")

    def take(a: Column, x: Column) -> Column:
        # The fold's state counts cells as it goes, so a cell knows its place.
        role = reduce(lambda case, p: case.when(x.rlike(f"(?iU){p[1]}") & ~F.map_contains_key(a["m"], p[0]), F.lit(p[0])), list(patterns.items())[1:], F.when(x.rlike(f"(?iU){next(iter(patterns.values()))}") & ~F.map_contains_key(a["m"], next(iter(patterns))), F.lit(next(iter(patterns)))))
        return F.struct(F.when(role.isNull(), a["m"]).otherwise(F.map_concat(a["m"], F.create_map(F.coalesce(role, F.lit("")), a["i"]))).alias("m"), (a["i"] + 1).alias("i"))

    return F.aggregate(header, F.struct(start.alias("m"), F.lit(0).alias("i")), take, lambda a: a["m"])


def summary_roles(row: Column) -> Column:
    """Roles of a findings row without header: serial, CWE cell, a severity behind it, the title before it; else an empty map."""
    cwe = T.first_index(row, lambda x: x.rlike(r"(?iU)^\s*CWE-\s*\d"))

    def index(test) -> Column:
        return F.filter(F.transform(row, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())

    sev = F.get(index(lambda x, i: (i > cwe) & T.severity(x).isin(T.SEVERITIES)), F.lit(0))
    title = F.array_max(index(lambda x, i: (i < cwe) & (i > 0) & (T.strip(x) != "")))
    asset = F.get(index(lambda x, i: (i > 0) & (i < title) & (T.strip(x) != "")), F.lit(0))
    advice = F.get(index(lambda x, i: (i > sev) & (F.length(T.strip(x)) > 60)), F.lit(0))
    names = [("sr", F.lit(0)), ("title", title), ("cwe", cwe), ("severity", sev), ("asset", asset), ("recommendation", advice)]
    made = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("int").alias("value")) for k, v in names]), lambda e: e["value"].isNotNull()))
    return F.when(T.serial(F.get(row, F.lit(0))).isNotNull() & cwe.isNotNull() & sev.isNotNull() & title.isNotNull(), made).otherwise(F.create_map().cast("map<string,int>"))


def cell_at(row: Column, roles: Column, role: str) -> Column:
    """A row's cell of one role, as it is; null without the role."""
    return F.get(row, F.try_element_at(roles, F.lit(role)))


def with_header(table: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Adds n_header, header and roles."""
    sized = table.withColumn("n_header", header_size(F.col("rows")))
    return sized.withColumn("header", merged_header(F.col("rows"), F.col("n_header"))).withColumn("roles", column_roles(F.col("header"), patterns))
