"""Round trips: reports are rendered from order tables and parsed again; the SQL gives what was rendered, without any text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.catalogue._register import Register
from reportmill.functions import dates as D
from reportmill.functions import text as T
from reportmill.operators import extract, findings, lines, run, tables
from reportmill.sources import render

query = Register()
QUERIES, SQL = query.queries, query.sql

_DATE = "CASE l_linenumber % 4 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%d.%m.%Y') WHEN 2 THEN day(l_shipdate) || 'th ' || strftime(l_shipdate, '%B %Y') ELSE strftime(l_shipdate, '%B ') || day(l_shipdate) || ', ' || year(l_shipdate) END"
_LEVEL = "CASE WHEN l_quantity <= 10 THEN 'Low' WHEN l_quantity <= 20 THEN 'Medium' WHEN l_quantity <= 30 THEN 'High' WHEN l_quantity <= 40 THEN 'Critical' ELSE 'Informational' END"
_SPELT = "CASE WHEN l_quantity <= 10 THEN 'low' WHEN l_quantity <= 20 THEN 'medium' WHEN l_quantity <= 30 THEN 'high' WHEN l_quantity <= 40 THEN 'critical' ELSE 'info' END"
_BASE = f"""p AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders),
    r AS (SELECT 'report-' || o_custkey AS document_id, page, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linestatus, l_shipdate) AS serial,
          'host' || l_suppkey || '.example' AS asset, 'Weakness ' || l_linenumber || ' | part ' || l_partkey AS title, 'CWE-' || (l_partkey % 1000) AS cwe, {_LEVEL} AS severity,
          CASE l_linenumber % 3 WHEN 0 THEN upper(substr({_SPELT}, 1, 1)) || substr({_SPELT}, 2) WHEN 1 THEN upper({_SPELT}) ELSE {_SPELT} || ' (rated)' END AS severity_text,
          CASE WHEN l_linestatus = 'F' THEN 'Closed' ELSE 'Open' END AS status, CASE WHEN l_linestatus = 'F' THEN 'Closed' ELSE 'open' END AS status_text,
          {_DATE} AS shipped, strftime(l_shipdate, '%Y-%m-%d') AS iso FROM lineitem JOIN p ON l_orderkey = o_orderkey)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines(render.order_reports(spark, sf_dir))


@query(f"""WITH {_BASE} SELECT document_id, page::INT AS page, (count(*) + 8)::BIGINT AS n_lines, (count(*) + 2)::BIGINT AS n_rows FROM r GROUP BY ALL""")
def page_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each page that are not empty, between its marks and including them: mark, title, header, footer, rows and rule; and its table rows."""
    got = _lines(spark, sf_dir).where("line <> ''")
    return got.groupBy("document_id", "page").agg((F.count("*") + 1).alias("n_lines"), F.sum(T.is_table_row(F.col("line")).cast("long")).alias("n_rows"))


@query(f"""WITH {_BASE} SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page) AS table_no, page::INT AS page, (count(*) + 1)::INT AS n_rows, 7 AS n_cols FROM r GROUP BY document_id, page""")
def md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tables(_lines(spark, sf_dir)).select("document_id", "table_no", "page", F.size("rows").alias("n_rows"), F.array_max(F.transform("rows", F.size)).alias("n_cols"))


@query(f"""WITH {_BASE} SELECT document_id, page::INT AS page, serial::INT AS row_no, unnest([0, 1, 2, 3, 4, 5, 6])::INT AS col_no, unnest([serial::VARCHAR, asset, title, cwe, severity_text, status_text, shipped]) AS cell FROM r""")
def md_cells_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells(tables.tables(_lines(spark, sf_dir))).where("row_no > 0").select("document_id", "page", "row_no", "col_no", "cell")


@query(f"""WITH {_BASE}, n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, serial) AS ordinal FROM r)
    SELECT document_id, ordinal::INT AS ordinal, page::INT AS page, serial::VARCHAR AS finding_id, title, severity, status, cwe, asset AS affected_asset FROM n""")
def findings_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = findings.from_tables(tables.tables(_lines(spark, sf_dir)))
    return got.select("document_id", "ordinal", "page", "finding_id", "title", "severity", "status", F.array_join("cwe", ",").alias("cwe"), F.array_join("affected_asset", ",").alias("affected_asset"))


@query(f"""WITH {_BASE} SELECT document_id, count(*)::BIGINT AS total_findings, count(*) FILTER (severity = 'Critical')::BIGINT AS critical, count(*) FILTER (severity = 'High')::BIGINT AS high,
    count(*) FILTER (severity = 'Medium')::BIGINT AS medium, count(*) FILTER (severity = 'Low')::BIGINT AS low FROM r GROUP BY document_id""")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: reports rendered and parsed to findings, counted by severity; levels beyond the four count in the total alone."""
    got = findings.from_tables(tables.tables(_lines(spark, sf_dir)))
    level = lambda x: F.count_if(F.col("severity") == x)
    return got.groupBy("document_id").agg(F.count("*").alias("total_findings"), level("Critical").alias("critical"), level("High").alias("high"), level("Medium").alias("medium"), level("Low").alias("low"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS iso FROM lineitem""")
def parse_dates_4styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = render.date_in_style(F.col("l_shipdate"), F.col("l_linenumber") % 4)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", D.parse_date(F.concat(F.lit("on "), text)).alias("iso"))


@query("""SELECT o_orderkey, 'From ' || strftime(o_orderdate, '%Y-%m-%d') || ' until ' || strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') || ', v1.0 of 31.31.2020' AS text FROM orders""")
def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    later = F.date_add(F.to_date("o_orderdate"), 40)
    text = F.concat(F.lit("From "), render.date_in_style(F.to_date("o_orderdate"), F.lit(1)), F.lit(" until "), render.date_in_style(later, F.col("o_orderkey") % 4), F.lit(", v1.0 of 31.31.2020"))
    return o.select("o_orderkey", D.normalize_dates(text).alias("text"))


def _front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter of a report for each customer: label tables, a header row over values, and label lines."""
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    first = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("first"), F.max(F.to_date("o_orderdate")).alias("last"))
    rows = cust.join(first, F.col("c_custkey") == F.col("o_custkey"))
    cell = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    key = F.col("c_custkey").cast("string")
    signs = render.markdown_table(F.array(cell("Document", "", "", "Details"), cell("Prepared by", "", "", F.col("c_name")), cell("Report ID", "", "", F.concat(F.lit("R-"), key))))
    grid = render.markdown_table(F.array(cell("Document Title", "Document Version", "Classification"), cell(F.concat(F.lit("Audit of "), "c_name"), F.concat(F.lit("1."), key), F.col("c_mktsegment"))))
    period = F.concat(render.date_in_style(F.col("first"), F.col("c_custkey") % 4), F.lit(" to "), render.date_in_style(F.col("last"), (F.col("c_custkey") + 1) % 4))
    said = F.concat(F.lit("Period : "), period, F.lit("\nType of audit\n"), F.concat(F.lit("Web audit "), F.col("c_nationkey").cast("string")), F.lit("\nAssessment Start Date\nAssessment End Date\n"), render.date_in_style(F.col("first"), F.lit(2)), F.lit("\n"), render.date_in_style(F.col("last"), F.lit(3)))
    body = F.concat_ws("\n\n", signs, grid, said, F.lit("Report ID: not this one"))
    return render.transcript(rows.select(F.format_string("report-%d", "c_custkey").alias("document_id"), F.lit(1).alias("page"), body.alias("body")))


_FRONT = """f AS (SELECT o_custkey, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders GROUP BY ALL), c AS (SELECT 'report-' || c_custkey AS document_id, * FROM customer JOIN f ON c_custkey = o_custkey)"""


@query(f"""WITH {_FRONT} SELECT document_id, unnest(['prepared_by', 'report_id', 'document_title', 'document_version', 'classification', 'report_type']) AS field,
    unnest([c_name, 'R-' || c_custkey, 'Audit of ' || c_name, '1.' || c_custkey, c_mktsegment, 'Web audit ' || c_nationkey]) AS value FROM c""")
def label_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = lines.lines(_front(spark, sf_dir))
    return extract.labels(numbered, tables.tables(numbered)).where("field <> 'audit_period'")


@query(f"""WITH {_FRONT} SELECT document_id, strftime(first, '%Y-%m-%d') AS period_from, strftime(last, '%Y-%m-%d') AS period_to, strftime(first, '%Y-%m-%d') AS start, strftime(last, '%Y-%m-%d') AS "end" FROM c""")
def audit_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = _front(spark, sf_dir)
    numbered = lines.lines(front)
    period = extract.labels(numbered, tables.tables(numbered)).where("field = 'audit_period'").select("document_id", D.find_dates(F.col("value")).alias("d"))
    period = period.select("document_id", F.get("d", F.lit(0)).alias("period_from"), F.get("d", F.lit(1)).alias("period_to"))
    return period.join(extract.timeline(front), "document_id")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation as a report's people: team, recipients, tools, history and scope tables."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")
    n = F.row_number
    from pyspark.sql import Window

    s = s.withColumn("i", n().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    key = F.col("s_suppkey").cast("string")
    serial = F.concat(F.col("i").cast("string"), F.when(F.col("i") % 2 == 0, ".").otherwise(""))
    mail = F.concat(F.lit("u"), key, F.lit("@mail.example"))
    version = F.concat((F.col("i") % 9).cast("string"), F.lit("."), key)
    shaped = s.select(
        F.format_string("team-%d", "s_nationkey").alias("document_id"), "i",
        F.array(serial, "s_name", F.lit("Lead"), F.lit("Auditor"), mail, F.lit("Yes"), F.concat(F.lit("CERT "), key)).alias("team"),
        F.array("s_name", F.concat(F.lit("Org "), key), F.lit("Head of"), F.lit("IT"), mail).alias("recipient"),
        F.array(serial, F.concat(F.lit("Scanner "), (F.col("s_suppkey") % 3).cast("string")), F.concat(F.lit("v"), (F.col("s_suppkey") % 2).cast("string")), F.when(F.col("i") % 2 == 0, "licensed").otherwise("Open-Source")).alias("tool"),
        F.array(version, render.date_in_style(F.date_add(F.lit("2024-01-01").cast("date"), F.col("s_suppkey").cast("int")), F.col("s_suppkey") % 4), F.lit("Changed"), F.concat(F.lit("by "), key)).alias("change"),
        F.array(serial, F.concat(F.lit("Asset "), (F.col("s_suppkey") % 40).cast("string")), F.concat(F.lit("https://h"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".example/ a")), F.lit("Critical function"), F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 40).cast("string"))).alias("asset"),
    )
    got = shaped.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("i", "team", "recipient", "tool", "change", "asset"))).alias("r"))

    def table(name: str, *head: list[str]) -> Column:
        return render.markdown_table(F.concat(F.array(*[F.array(*map(F.lit, h)) for h in head]), F.transform("r", lambda x: x[name])))

    body = F.concat_ws(
        "\n\n", table("team", ["S. No", "Name", "", "Designation", "Email", "Listed", "Certifications"]), table("recipient", ["Name", "Organization", "Role", "", "Email"]), table("tool", ["No", "Tool name", "Version", "License"]),
        table("change", ["Version", "Date", "Remarks", ""]), table("asset", ["Sr", "Asset", "Endpoint", "Criticality", "Internal"], ["No", "Description", "URL", "", "IP"]),
    )
    return render.transcript(got.select("document_id", F.lit(1).alias("page"), body.alias("body")))


_PEOPLE = "s AS (SELECT 'team-' || s_nationkey AS document_id, *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)"


def _people_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tables(lines.lines(_people(spark, sf_dir)))


@query(f"""WITH {_PEOPLE} SELECT document_id, i::INT AS ordinal, i::INT AS sr_no, s_name AS name, 'Lead Auditor' AS designation, 'u' || s_suppkey || '@mail.example' AS email, 'CERT ' || s_suppkey AS certifications FROM s""")
def team_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.team(_people_tables(spark, sf_dir)).select("document_id", "ordinal", "sr_no", "name", "designation", "email", "certifications")


@query(f"""WITH {_PEOPLE}, t AS (SELECT *, row_number() OVER (PARTITION BY document_id, s_suppkey % 3, s_suppkey % 2 ORDER BY i) AS k FROM s)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i)::INT AS ordinal, i::INT AS sr_no, 'Scanner ' || (s_suppkey % 3) AS tool_name, 'v' || (s_suppkey % 2) AS version, CASE WHEN i % 2 = 0 THEN 'Licensed' ELSE 'Open Source' END AS license_type FROM t WHERE k = 1""")
def tools_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.tools(_people_tables(spark, sf_dir)).select("document_id", "ordinal", "sr_no", "tool_name", "version", "license_type")


@query(f"""WITH {_PEOPLE} SELECT document_id, i::INT AS ordinal, (i % 9) || '.' || s_suppkey AS version, strftime(DATE '2024-01-01' + s_suppkey::INT, '%Y-%m-%d') AS date, 'Changed by ' || s_suppkey AS remarks FROM s""")
def history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.history(_people_tables(spark, sf_dir)).select("document_id", "ordinal", "version", "date", "remarks")


@query(f"""WITH {_PEOPLE} SELECT document_id, i::INT AS ordinal, s_name AS name, 'Org ' || s_suppkey AS organization, 'Head of IT' AS designation, 'u' || s_suppkey || '@mail.example' AS email FROM s""")
def recipients_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.recipients(_people_tables(spark, sf_dir)).select("document_id", "ordinal", "name", "organization", "designation", "email")


@query(f"""WITH {_PEOPLE}, t AS (SELECT *, row_number() OVER (PARTITION BY document_id, s_suppkey % 40 ORDER BY i) AS k FROM s)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i)::INT AS ordinal, i::INT AS sr_no, 'Asset ' || (s_suppkey % 40) AS asset_description, 'https://h' || (s_suppkey % 40) || '.example/a' AS url, 'Critical function' AS criticality,
    '10.0.0.' || (s_suppkey % 40) AS internal_ip, NULL::VARCHAR AS public_ip FROM t WHERE k = 1""")
def assets_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.assets(_people_tables(spark, sf_dir)).select("document_id", "ordinal", "sr_no", "asset_description", "url", "criticality", "internal_ip", "public_ip")


@query("""SELECT 'team-' || n_nationkey AS document_id, 4 AS n_tables, 2 AS n_header, 'criticality=3,description=1,internal_ip=4,url=2' AS roles FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)""")
def header_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the scope table, whose header stands in two rows; and how many tables stand before it."""
    got = tables.with_header(_people_tables(spark, sf_dir), tables.ASSET_COLUMNS).where("table_no = 5")
    roles = F.array_join(F.array_sort(F.transform(F.map_entries("roles"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return got.select("document_id", (F.col("table_no") - 1).cast("int").alias("n_tables"), "n_header", roles.alias("roles"))


@query("""WITH m AS (SELECT s_nationkey, s_suppkey, lower(s_name) AS member FROM supplier), q AS (SELECT s_nationkey, s_suppkey AS role, substr(s_name, 1, 17) AS name FROM supplier)
    SELECT q.s_nationkey::VARCHAR AS document_id, role::VARCHAR AS role, name, min_by(s_suppkey, s_suppkey) AS auditing_team_sr_no FROM q JOIN m ON q.s_nationkey = m.s_nationkey AND (contains(member, lower(name)) OR contains(lower(name), member)) GROUP BY ALL""")
def signoff_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    doc = F.col("s_nationkey").cast("string").alias("document_id")
    names = s.select(doc, F.col("s_suppkey").cast("string").alias("role"), F.concat(F.lit(" "), F.substring("s_name", 1, 17), F.lit(" :")).alias("raw"))
    return extract.signoff(names, s.select(doc, F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").alias("sr_no"), F.col("s_name").alias("name")))


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of headed findings, one per order of a customer, with contents page, sections, labelled fields, image tags and an appendix."""
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("d"))
    o = o.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    k = F.col("o_orderkey").cast("string")
    level = F.when(F.col("o_orderkey") % 4 == 0, "Low").when(F.col("o_orderkey") % 4 == 1, "MEDIUM risk").when(F.col("o_orderkey") % 4 == 2, "high").otherwise("Informational")
    state = F.when(F.col("o_orderstatus") == "F", "fixed").when(F.col("o_orderstatus") == "O", "Open").otherwise("partially closed?")
    text = F.concat(
        F.col("n").cast("string"), F.lit(". Weakness of order "), k, F.lit("\nSeverity: "), level, F.lit("  Status: "), state, F.lit("\nAffected Assets:\n• https://a.example/"), k, F.lit("\n• host"), k,
        F.lit("\nCVE/CWE: CWE-"), (F.col("o_orderkey") % 900 + 1).cast("string"), F.lit(": Some name • CWE-20, cve-2024-"), (F.col("o_orderkey") % 9000 + 1000).cast("string"), F.lit(" and CVE-2021-44228\n"),
        F.lit("CVSS Score: "), (F.col("o_orderkey") % 10).cast("string"), F.lit(".5 of 10\nCVSS Vector: AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H\nObservation Date: "), render.date_in_style(F.col("d"), F.col("o_orderkey") % 4),
        F.lit("\nDetailed Observation:\nThe order was\nfound open.\nNew or Repeat: repeated\nProof of Concept:\nSeen here\n[IMAGE_PAGE_1_FIG_"), F.col("n").cast("string"), F.lit("]\n[IMAGE_PAGE_1_FIG_"), F.col("n").cast("string"),
        F.lit("]\nRetest Proof of Concept:\n[IMAGE_PAGE_2_FIG_"), F.col("n").cast("string"), F.lit("]\nGone now\nRecommendation: Close order "), k, F.lit(".\n"),
    )
    got = o.withColumn("text", text).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("r"))
    front = "# Audit Report\n\n## Table of Contents\nMethodology ..... 2\nTools ..... 3\n\n## Page 1\n\nOut of Scope:\n• Printers\n* Phones, all\n-\n\nMethodology:\nWe follow the OWASP Top 10, NIST SP 800-115 and PCI-DSS. Also OSSTMM.\n1. Possible (Medium): it is not expected.\n\nTools used\n\nExecutive Summary\nThis is the summary of customer {}.\nIt has two lines.\n1\nnot this\n\nDetailed Observations\n"
    head = F.concat(F.lit(front.split("{}")[0]), F.col("o_custkey").cast("string"), F.lit(front.split("{}")[1]))
    body = F.concat(head, F.array_join(F.transform("r", lambda x: x["text"]), "\n"), F.lit("\nAppendix A\nSeverity: High\nNothing of the findings\n"))
    return render.transcript(got.select(F.format_string("headed-%d", "o_custkey").alias("document_id"), F.lit(1).alias("page"), body.alias("body")))


_HEADED = """h AS (SELECT 'headed-' || o_custkey AS document_id, *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"""


def _headed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _headed(spark, sf_dir)
    return findings.from_headers(lines.lines(reports), reports)


@query(f"""WITH {_HEADED} SELECT document_id, n::BIGINT AS ordinal, n::VARCHAR AS finding_id, 'Weakness of order ' || o_orderkey AS title,
    CASE o_orderkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Informational' END AS severity, CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Open' ELSE 'Closed' END AS status,
    (o_orderkey % 10) + 0.5::DOUBLE AS cvss_score, 'AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' AS cvss_vector, strftime(o_orderdate, '%Y-%m-%d') AS observation_date, 'The order was found open.' AS observation_description, 'Repeat' AS new_or_repeat,
    'Close order ' || o_orderkey || '.' AS recommendation, 'https://a.example/' || o_orderkey || ',host' || o_orderkey AS affected_asset FROM h""")
def findings_from_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _headed_findings(spark, sf_dir)
    return got.select("document_id", "ordinal", "finding_id", "title", "severity", "status", "cvss_score", "cvss_vector", "observation_date", "observation_description", "new_or_repeat", "recommendation", F.array_join("affected_asset", ",").alias("affected_asset"))


@query(f"""WITH {_HEADED} SELECT document_id, n::BIGINT AS ordinal, 'CWE-' || (o_orderkey % 900 + 1) || ': Some name' AS cwe, 'CVE-2021-44228;CVE-2024-' || (o_orderkey % 9000 + 1000) AS cve FROM h""")
def cwe_cve_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headed_findings(spark, sf_dir).select("document_id", "ordinal", F.array_join("cwe", ";").alias("cwe"), F.array_join("cve_id", ";").alias("cve"))


@query(f"""WITH {_HEADED} SELECT document_id, n::BIGINT AS ordinal, unnest([1, 2, 3, 4])::INT AS sr_no, unnest(['text', 'image', 'image', 'text']) AS type, unnest([NULL, '[IMAGE_PAGE_1_FIG_' || n || ']', '[IMAGE_PAGE_2_FIG_' || n || ']', NULL]) AS reference,
    unnest([false, false, true, true]) AS is_retest, unnest(['Seen here', NULL, NULL, 'Gone now']) AS description FROM h""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _headed_findings(spark, sf_dir).select("document_id", "ordinal", F.inline("proof_of_concept"))
    return got.select("document_id", "ordinal", "sr_no", "type", "reference", "is_retest", "description")


@query("""SELECT DISTINCT 'headed-' || o_custkey AS document_id, 'Printers;Phones, all' AS exclusions, 'This is the summary of customer ' || o_custkey || '. It has two lines.' AS narrative, 'Audit Report' AS title FROM orders""")
def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = lines.lines(_headed(spark, sf_dir))
    got = extract.exclusions(numbered).select("document_id", F.array_join("exclusions", ";").alias("exclusions"))
    return got.join(extract.narrative(numbered), "document_id").join(extract.title(numbered), "document_id")


@query("""SELECT DISTINCT 'headed-' || o_custkey AS document_id, unnest(['OWASP Top 10', 'NIST SP 800-115', 'OSSTMM', 'PCI DSS']) AS standard FROM orders""")
def standards_referred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.standards(lines.lines(_headed(spark, sf_dir))).select("document_id", F.explode("standards").alias("standard"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders)
    SELECT i.o_custkey::VARCHAR AS document_id, i.o_orderkey AS n, p.page::INT AS page FROM p i JOIN p ON i.o_custkey = p.o_custkey AND p.page BETWEEN i.page AND i.page + i.o_orderkey % 3 + 1""")
def page_slice_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("document_id"), "o_orderkey")
    pages = o.withColumn("page", F.row_number().over(Window.partitionBy("document_id").orderBy("o_orderkey")))
    index = pages.select("document_id", F.col("o_orderkey").alias("n"), F.col("page").alias("start_page"), (F.col("page") + F.col("o_orderkey") % 3).alias("end_page"))
    return run.page_range(index, pages.select("document_id", "page")).select("document_id", "n", "page")
