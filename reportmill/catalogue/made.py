"""Queries over small made inputs, or JSON and bytes made from tables: coercion, enforcement, screening, tags, runs, and reviews of records."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.catalogue._register import Register
from reportmill.catalogue.rendered import _headed
from reportmill.functions import dates as D
from reportmill.functions import schema as S
from reportmill.functions import text as T
from reportmill.operators import coverage, gate, images, run
from reportmill.plans import review, structure
from reportmill.sources import files

query = Register()
QUERIES, SQL = query.queries, query.sql


def _values(rows: list[tuple[str | None, str | None]]) -> str:
    say = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({say(a)}, {say(b)})" for a, b in rows) + ") AS t(given, result)"


_DATES = [
    ("16.02.2026", "2026-02-16"), ("29/05/2025", "2025-05-29"), ("16th February 2026", "2026-02-16"), ("05th September 2025", "2025-09-05"), ("9-May-24", "2024-05-09"), ("May 5, 2024", "2024-05-05"),
    ("2025-03-21", "2025-03-21"), ("12/31/2025", "2025-12-31"), ("Maybe 5, 2024", "2024-05-05"), ("30.02.2024 then 1 Mar 2024", "2024-03-01"), ("v1.0", None), ("11.80.1", None), ("2026.1", None), ("NA", None), ("", None), (None, None), ("1.1.202", "0202-01-01"),
]
_CLEAN = [("  NA ", "NA"), (" - ", None), ("a\n  b", "a b"), ("N/A", "N/A"), ("n/a.", None), ("NIL", None), ("• x : ", "x"), ("a&#124;b", "a|b"), ("—", None), (None, None), ("", None)]


@query(_values(_DATES))
def date_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a, _ in _DATES], "given string").select("given", D.parse_date(F.col("given")).alias("result"))


@query(_values(_CLEAN))
def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a, _ in _CLEAN], "given string").select("given", T.clean_value(F.col("given")).alias("result"))


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN event_id::DOUBLE WHEN event_id % 5 = 2 THEN event_id + 0.25 END AS number, CASE WHEN event_id % 5 = 3 THEN 'x' || event_id WHEN event_id % 5 IN (0, 1) THEN event_id::VARCHAR WHEN event_id % 5 = 2 THEN event_id::VARCHAR || '.25' END AS string,
    CASE WHEN event_id % 5 = 4 THEN event_id % 2 = 0 END AS boolean, CASE WHEN event_id % 3 = 0 THEN 'Open' WHEN event_id % 3 = 1 THEN 'Partially Remediated' END AS choice FROM events""")
def coerce_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    k, way = F.col("event_id").cast("string"), F.col("event_id") % 5
    value = F.when(way == 0, k).when(way == 1, F.concat(F.lit('" '), k, F.lit(' "'))).when(way == 2, F.concat(k, F.lit(".25"))).when(way == 3, F.concat(F.lit('"x'), k, F.lit('"'))).otherwise(F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"))
    choice = F.when(F.col("event_id") % 3 == 0, " OPEN").when(F.col("event_id") % 3 == 1, "partially remediated").otherwise("Reopened")
    v = F.try_parse_json(value)
    return e.select(
        "event_id", S.coerce(v, "number").alias("number"), F.trim(S.coerce(v, "string")).alias("string"), S.coerce(v, "boolean").alias("boolean"), S.coerce(F.try_parse_json(F.to_json(F.struct(choice.alias("a")))).cast("map<string,variant>")["a"], "Open | Closed | Partially Remediated").alias("choice"),
    )


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order, with what a schema can't hold: unknown keys, wrong types, words that are no choice."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus", F.to_date("o_orderdate").alias("d"))
    k = F.col("o_orderkey").cast("string")
    date = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("d", "dd.MM.yyyy")).otherwise(F.concat(F.lit("after "), F.date_format("d", "dd.MM.yyyy")))
    tool = F.when(F.col("o_orderkey") % 3 == 0, '"Freeware"').otherwise('"open source"')
    text = F.concat(
        F.lit('{"extra": 1, "report_meta": {"report_id": '), k, F.lit(', "report_release_date": "'), date, F.lit('", "note": [1, 2]}, "tools_used": [{"sr_no": "'), k, F.lit('", "tool_name": "T", "license_type": '), tool,
        F.lit('}, 5], "engagement_scope": {"exclusions": ["a", null, true, 7]}, "auditing_team": {"name": "x"}, "executive_summary": {"total_findings": "12"}, "appendices": 3}'),
    )
    return o.select(k.alias("document_id"), F.col("o_orderkey"), text.alias("record"))


@query("""SELECT o_orderkey, o_orderkey::VARCHAR AS report_id, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS released, 2 AS n_tools, o_orderkey::DOUBLE AS tool_no, CASE WHEN o_orderkey % 3 <> 0 THEN 'Open Source' END AS license_type,
    'a,7' AS exclusions, 0 AS n_team, 12::DOUBLE AS total_findings FROM orders""")
def enforce_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = structure.enforce(_candidates(spark, sf_dir))
    r = F.col("record")
    return got.select(
        F.col("document_id").cast("long").alias("o_orderkey"), r["report_meta"]["report_id"].alias("report_id"), r["report_meta"]["report_release_date"].alias("released"), F.size(r["tools_used"]).alias("n_tools"), r["tools_used"][0]["sr_no"].alias("tool_no"),
        r["tools_used"][0]["license_type"].alias("license_type"), F.array_join(r["engagement_scope"]["exclusions"], ",").alias("exclusions"), F.size(r["auditing_team"]).alias("n_team"), r["executive_summary"]["total_findings"].alias("total_findings"),
    )


@query("""WITH d AS (SELECT o_orderkey, unnest([{'path': 'extra', 'value': '1', 'reason': 'not defined in the master schema', 'keep': true}, {'path': 'report_meta.note', 'value': '[1,2]', 'reason': 'not defined in the master schema', 'keep': true},
      {'path': 'report_meta.report_release_date', 'value': '"after ' || strftime(o_orderdate, '%d.%m.%Y') || '"', 'reason': 'not a valid ''YYYY-MM-DD''', 'keep': o_orderkey % 2 = 1}, {'path': 'engagement_scope.exclusions[2]', 'value': 'true', 'reason': 'not a valid ''string''', 'keep': true},
      {'path': 'auditing_team', 'value': '{"name":"x"}', 'reason': 'expected a list', 'keep': true}, {'path': 'tools_used[0].license_type', 'value': '"Freeware"', 'reason': 'not a valid ''Open Source | Licensed''', 'keep': o_orderkey % 3 = 0},
      {'path': 'tools_used[1]', 'value': '5', 'reason': 'expected an object', 'keep': true}, {'path': 'appendices', 'value': '3', 'reason': 'expected an object', 'keep': true}]) AS x FROM orders)
    SELECT o_orderkey, x.path AS path, x.value AS value, x.reason AS reason FROM d WHERE x.keep""")
def dropped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.enforce(_candidates(spark, sf_dir)).select(F.col("document_id").cast("long").alias("o_orderkey"), F.inline("dropped"))


@query("""WITH m AS (SELECT o_orderkey, unnest(['report_meta.report_title', 'report_meta.audit_period.from', 'tools_used[*].sr_no (1/2 missing)', 'tools_used[*].version (2/2 missing)', 'auditing_team (empty)', 'appendices.retest_closure (empty)',
      CASE WHEN o_orderkey % 2 = 1 THEN 'report_meta.report_release_date' END, 'tools_used[*].license_type (' || CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END || '/2 missing)']) AS path FROM orders) SELECT * FROM m WHERE path IS NOT NULL""")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of the paths without a value; all are in ``schema.missing_fields``."""
    got = structure.enforce(_candidates(spark, sf_dir)).select(F.col("document_id").cast("long").alias("o_orderkey"), F.explode(S.missing_fields(F.col("record"))).alias("path"))
    shown = ["report_meta.report_title", "report_meta.audit_period.from", "report_meta.report_release_date", "auditing_team (empty)", "appendices.retest_closure (empty)"]
    return got.where(F.col("path").isin(shown) | F.col("path").rlike(r"^tools_used\[\*\]\.(sr_no|version|license_type)"))


# What the headed reports say, line by line: the SQL knows it from the tables alone.
_SAID = """h AS (SELECT 'headed-' || o_custkey AS document_id, *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    d AS (SELECT document_id, any_value(o_custkey) AS c FROM h GROUP BY ALL),
    l AS (SELECT *, o_orderkey::VARCHAR AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'MEDIUM risk' WHEN 2 THEN 'high' ELSE 'Informational' END AS level, CASE o_orderstatus WHEN 'F' THEN 'fixed' WHEN 'O' THEN 'Open' ELSE 'partially closed?' END AS state,
      CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 2 THEN day(o_orderdate) || 'th ' || strftime(o_orderdate, '%B %Y') ELSE strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) END AS day,
      CASE WHEN n = 1 THEN 'Methodology:' ELSE 'Retest Proof of Concept' END AS above, o_orderstatus = 'O' AND o_orderkey % 4 <> 3 AS held FROM h),
    u AS (SELECT document_id, 0 AS n, unnest([1, 2, 3, 4, 5, 6, 7]) AS i, 'Methodology:' AS heading, unnest(['We follow the OWASP Top 10, NIST SP 800-115 and PCI-DSS. Also OSSTMM.', 'Possible (Medium): it is not expected.', 'Tools used', 'Executive Summary',
        'This is the summary of customer ' || c || '.', 'It has two lines.', 'Detailed Observations']) AS text, unnest([9, 3, 2, 2, 3, 2, 2]) AS weight, unnest([false, false, true, true, true, true, true]) AS covered FROM d
      UNION ALL SELECT document_id, n, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]), unnest([above, above, 'Affected Assets', 'Affected Assets', 'Affected Assets', 'Affected Assets', 'Affected Assets', 'Affected Assets', 'Detailed Observation', 'Detailed Observation', 'Detailed Observation',
        'Proof of Concept', 'Retest Proof of Concept', 'Retest Proof of Concept']), unnest(['Weakness of order ' || k, 'Severity: ' || level || '  Status: ' || state, 'https://a.example/' || k, 'host' || k, 'CVE/CWE: CWE-' || (o_orderkey % 900 + 1) || ': Some name • CWE-20, cve-2024-' || (o_orderkey % 9000 + 1000) || ' and CVE-2021-44228',
        'CVSS Score: ' || (o_orderkey % 10) || '.5 of 10', 'CVSS Vector: AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H', 'Observation Date: ' || day, 'The order was', 'found open.', 'New or Repeat: repeated', 'Seen here', 'Gone now', 'Recommendation: Close order ' || k || '.']),
        unnest([CASE WHEN length(k) > 2 OR regexp_matches(k, '[0-9]') THEN 3 ELSE 2 END, 4 + (o_orderkey % 4 = 1)::INT + (o_orderstatus = 'P')::INT, 2, 1, 7, 4, 3, 3, 1, 2, 3, 2, 2, 4]), unnest([true, held, true, true, false, true, true, true, true, true, false, true, true, true]) FROM l
      UNION ALL SELECT document_id, 1000000, unnest([1, 2, 3]), 'Retest Proof of Concept', unnest(['Appendix A', 'Severity: High', 'Nothing of the findings']), unnest([1, 2, 2]), unnest([false, true, false]) FROM d)"""
_LEFT = f"""{_SAID}, e AS (SELECT document_id, n, i, heading, text FROM u WHERE NOT covered AND n > 0
      UNION ALL SELECT document_id, 0, 1, 'Methodology:', string_agg(text, ' ' ORDER BY i) FROM u WHERE NOT covered AND n = 0 GROUP BY document_id),
    k AS (SELECT *, CASE WHEN len(regexp_split_to_array(text, ' +')) >= 6 THEN 'narrative' ELSE 'other' END AS kind FROM e),
    g AS (SELECT *, row_number() OVER (PARTITION BY document_id, lower(text), kind ORDER BY n, i) AS again FROM k),
    left_over AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY n, i)::INT AS entry_no, 1 AS page, heading, kind, text, NULL::VARCHAR AS context FROM g WHERE again = 1)"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headed reports, made once for all that read them."""
    return files.cut(_headed(spark, sf_dir), "reports")


@query(f"""WITH {_SAID} SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY n, i) - 1)::INT AS unit_no, 1 AS page, heading, text, 'text' AS source, NULL::VARCHAR AS "row", NULL::VARCHAR AS "column" FROM u""")
def transcript_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.units(_headed(spark, sf_dir))


@query(f"WITH {_LEFT} SELECT * FROM left_over")
def unmapped_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _reports(spark, sf_dir)
    said = files.cut(structure.corpus(structure.enforce(structure.structure(reports))), "corpus")  # a long plan, which ends here
    return coverage.unmapped(coverage.coverage(coverage.units(reports), said).where("not covered"))


@query("""SELECT DISTINCT 'headed-' || o_custkey AS document_id, 9 AS structural FROM orders""")
def structural_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines up to the findings that only order the content: title, contents, sections and label lines; findings add four labels each."""
    reports = _headed(spark, sf_dir)
    whole = coverage.structural_units(reports)
    labels = reports.select("document_id", (F.regexp_count("markdown", F.lit("Retest Proof of Concept:")) * 4).alias("labels"))
    return whole.join(labels, "document_id").select("document_id", (F.col("structural") - F.col("labels")).alias("structural"))


@query(f"""WITH {_LEFT}, w AS (SELECT document_id, sum(weight) FILTER (covered) / sum(weight) AS coverage FROM u GROUP BY ALL), m AS (SELECT document_id, count(*) AS n_unmapped FROM left_over GROUP BY ALL),
    f AS (SELECT document_id, count(*) AS n_findings, 2 * count(*) FILTER (o_orderkey % 4 = 3) AS n_dropped FROM h GROUP BY ALL)
    SELECT document_id, 'fallback' AS status, round(coverage, 6) AS coverage, n_findings::INT AS n_findings, n_dropped::INT AS n_dropped, n_unmapped::INT AS n_unmapped FROM f JOIN w USING (document_id) JOIN m USING (document_id)""")
def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole route over headed reports: record, status, coverage, what was dropped or not mapped."""
    got = structure.run_report(_reports(spark, sf_dir))
    found = F.get_json_object("record", "$.executive_summary.total_findings").cast("double").cast("int")
    return got.select("document_id", "status", F.round("coverage", 6).alias("coverage"), found.alias("n_findings"), F.size("dropped").alias("n_dropped"), F.size("unmapped_content").alias("n_unmapped"))


_OLE = bytes.fromhex("D0CF11E0A1B11AE1")
_TARGETS = [
    ("clean", "raw", b"%PDF-1.7 nothing here", "CLEAN", False),
    ("autorun", "pdfobj", b"<< /OpenAction 5 0 R >> << /S /JavaScript /JS (x) >>", "MALICIOUS", True),
    ("hidden", "pdfobj", b"<< /AA << /O 1 >> >> << /J#61vaScript (x) >>", "MALICIOUS", True),
    ("script", "pdfobj", b"<< /JS (x) >>", "SUSPICIOUS", True),
    ("launch", "pdfobj", b"<< /L#61unch /F (cmd) >>", "MALICIOUS", True),
    ("quoted", "raw", b"the text says powershell -enc and /JavaScript /OpenAction", "CLEAN", False),
    ("media", "pdfobj", b"/RichMedia", "SUSPICIOUS", True),
    ("exe", "embedded", b"MZ" + b"\0" * 100 + b"PE\0\0rest", "MALICIOUS", True),
    ("elf", "pdfstream", b"\x7fELF\x02", "MALICIOUS", True),
    ("vba", "ooxml-part", _OLE + b"Attribute VB_Name = x", "SUSPICIOUS", True),
    ("wide", "ooxml-part", _OLE + "_VBA_PROJECT".encode("utf-16-le"), "SUSPICIOUS", True),
    ("auto", "embedded", _OLE + b"attribute vb_name AutoOpen", "MALICIOUS", True),
    ("dde", "ooxml-part", b"<w:instrText xml:space='x'> DDEAUTO c:\\\\x", "MALICIOUS", True),
    ("drop", "embedded", b"run cmd.exe /c del", "SUSPICIOUS", True),
    ("eicar", "raw", b"X5O!P%@AP[4\\PZX54(P^)7CC)7}$EICAR-" + b"STANDARD-ANTIVIRUS-TEST-FILE!$H+H*", "TEST_SIGNATURE_DETECTED", False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{v}', {str(b).lower()})" for n, _, _, v, b in _TARGETS) + ") AS t(document_id, verdict, blocked)")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([(n, n, k, bytearray(d)) for n, k, d, _, _ in _TARGETS], "document_id string, label string, kind string, data binary")
    none = spark.createDataFrame([], "document_id string, verdict string")
    return gate.verdicts(targets, gate.rule_matches(targets), none)


_SNIFF = [
    (b"MZ\x90", "a.bin", "application/x-msdownload", "DANGEROUS"), (b"%PDF-1.4", "a.pdf", "application/pdf", "UNKNOWN"), (b"\x89PNG\r\n\x1a\nxx", "a.png", "image/png", "SAFE"), (b"  \n<?xml?>", "a.xml", "application/xml", "SAFE"),
    (b" [1]", "a", "application/json", "SAFE"), ("é text".encode(), "a.txt", "text/plain", "SAFE"), (b"\xff\xfe\x00x", "a", "application/octet-stream", "UNKNOWN"), (b"plain", "run.EXE", "text/plain", "DANGEROUS"),
    (b"#!/bin/sh", "x", "text/x-shellscript", "DANGEROUS"), (b"PK\x03\x04", "x.zip", "application/zip", "UNKNOWN"), (b"", "none", "text/plain", "SAFE"), (b"BM1", "x", "image/bmp", "SAFE"), (b"GIF89a", "x", "image/gif", "SAFE"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{m}', '{v}')" for i, (_, n, m, v) in enumerate(_SNIFF)) + ") AS t(no, name, mime, verdict)")
def sniff_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, bytearray(d), n) for i, (d, n, _, _) in enumerate(_SNIFF)], "no int, data binary, name string")
    return df.select("no", "name", gate.sniff(F.col("data")).alias("mime")).withColumn("verdict", gate.embedded_verdict(F.col("mime"), F.col("name")))


def _zip(**members: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w:document/>")
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


_REL = b"<Relationships><pr:Relationship Id='r1' Type='http://x/attachedTemplate' Target='http://evil/t.dotm' TargetMode='External'/><Relationship Type=\"http://x/hyperlink\" Target=\"http://ok\" TargetMode=\"External\"/></Relationships>"
_ARCHIVES = [
    ("plain", _zip(), "PASS", "CLEAN"), ("macro", _zip(**{"word/vbaProject.bin": _OLE}), "BLOCK", "SUSPICIOUS"), ("remote", _zip(**{"word/_rels/settings.xml.rels": _REL}), "BLOCK", "SUSPICIOUS"),
    ("exe", _zip(**{"word/embeddings/a.bin": b"MZ\x90"}), "BLOCK", "MALICIOUS"), ("ole", _zip(**{"word/embeddings/oleObject1.bin": _OLE}), "SANITIZE", "CLEAN"), ("broken", b"PK no zip", "BLOCK", "SUSPICIOUS"), ("bomb", _zip(**{"word/media/x": b"\0" * (11 << 20)}), "BLOCK", "SUSPICIOUS"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{r}', '{v}')" for n, _, r, v in _ARCHIVES) + ") AS t(document_id, recommendation, verdict)")
def ooxml_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(n, bytearray(b)) for n, b, _, _ in _ARCHIVES], "document_id string, content binary")
    return gate.inspect_archives(gate.archive_members(df)).select("document_id", "recommendation", "verdict")


def _placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements by order lines: a document per customer's order, a page per line number; spacers, layout boxes and figures."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct()
    q = F.col("l_quantity")
    return li.select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_linenumber").cast("int").alias("page"), F.col("l_partkey").alias("xref"), F.struct("l_suppkey", "l_quantity").alias("placement_no"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"),
        F.lit("png").alias("format"), (q + 3).cast("int").alias("width"), (q * 2).cast("int").alias("height"), F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), (q * 2 + 10).alias("x1"), (q + 40).alias("y1"),
    )


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem), k AS (SELECT *, l_quantity * 2 < 40 AS layout FROM l WHERE (l_quantity + 3)::INT >= 8 AND (l_quantity * 2)::INT >= 8)
    SELECT l_orderkey::VARCHAR AS document_id, l_linenumber::INT AS page, l_partkey AS xref, CASE WHEN layout THEN '' ELSE '[IMAGE_PAGE_' || l_linenumber || '_FIG_' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber, layout ORDER BY l_partkey, l_suppkey, l_quantity) || ']' END AS tag, layout AS is_layout FROM k""")
def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = images.tag_placements(_placements(spark, sf_dir).withColumn("uri", F.lit("x")))
    return got.select("document_id", "page", "xref", "tag", "is_layout")


@query("""WITH c AS (SELECT DISTINCT o_custkey FROM orders) SELECT o_custkey::VARCHAR AS document_id, 3 AS page, CASE o_custkey % 3 WHEN 0 THEN 'a [IMAGE_PAGE_3_FIG_1] b' || chr(10) || '[IMAGE_PAGE_3_FIG_2]' WHEN 1 THEN 'a [IMAGE_PAGE_3_FIG_1] b [IMAGE_PAGE_3_FIG_2]' ELSE 'a b' || chr(10) || chr(10) || '[IMAGE_PAGE_3_FIG_1]' || chr(10) || '[IMAGE_PAGE_3_FIG_2]' END AS markdown,
    CASE o_custkey % 3 WHEN 0 THEN 0 ELSE 1 END AS n_issues FROM c""")
def reconcile_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").distinct()
    way = F.col("o_custkey") % 3
    text = F.when(way == 0, "a [image page 3 fig 1] b\n[IMAGE_PAGE_3_FIG_2]").when(way == 1, "a [lMAGE_PAGE_3_FIG_1] b [IMAGE_PAGE_3_FIG_2]").otherwise("a b \n")
    pages = ids.select(F.col("o_custkey").cast("string").alias("document_id"), F.lit(3).alias("page"), text.alias("markdown"))
    tags = pages.select("document_id", "page", F.explode(F.array(F.lit(1), F.lit(2))).alias("figure")).withColumn("tag", T.image_tag(F.col("page"), F.col("figure")))
    return images.reconcile_tags(pages, tags).select("document_id", "page", "markdown", F.size("issues").alias("n_issues"))


_ATTEMPTS = "a AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS attempt, CASE WHEN event_id % 11 <> 0 THEN least(1, round(value / 100, 3)) END AS recall, event_id % 13 = 0 AS failed FROM events)"


@query(f"""WITH {_ATTEMPTS}, g AS (SELECT *, coalesce(max((NOT failed AND (recall IS NULL OR recall >= 0.97))::INT) OVER (PARTITION BY user_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM a WHERE attempt <= 3),
    k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS attempts, row_number() OVER (PARTITION BY user_id ORDER BY failed, coalesce(recall, 0) DESC, attempt) AS r FROM g WHERE ended = 0)
    SELECT user_id, attempt, recall, attempts, CASE WHEN failed THEN 'fallback' ELSE 'model' END AS source FROM k WHERE r = 1""")
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    attempts = e.select(
        "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("attempt"), F.when(F.col("event_id") % 11 != 0, F.least(F.lit(1.0), F.round(F.col("value") / 100, 3))).alias("recall"), F.when(F.col("event_id") % 13 == 0, "failed").alias("error")
    )
    return run.best_attempt(attempts, ["user_id"]).select("user_id", "attempt", "recall", "attempts", "source")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1) THEN 'fallback' WHEN o_orderkey % 6 = 5 THEN 'ok' ELSE 'needs_review' END AS status,
    CASE o_orderkey % 6 WHEN 0 THEN 'model unavailable: whole document produced by the rule-based fallback' WHEN 1 THEN 'pass 1 fell back to the text layer on page(s) [2]' WHEN 2 THEN 'page recall below 0.97 on page(s) [1]' WHEN 3 THEN 'image tags repaired on page(s) [1]' WHEN 4 THEN 'only 90.0% of transcript text placed in schema fields (rest kept in unmapped_content); 2 value(s) the master schema cannot hold were set to null (originals in dropped_values)' ELSE '' END AS reasons FROM orders""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    way = F.col("o_orderkey") % 6
    page = lambda n, source, recall, *issues: F.struct(F.lit(n).alias("page"), source.alias("source"), recall.cast("double").alias("recall"), F.array(*map(F.lit, issues)).cast("array<string>").alias("issues"))
    model = F.lit("model")
    first = F.when(way == 3, page(1, model, F.lit(None), "misread tag x corrected")).otherwise(page(1, model, F.when(way == 2, 0.5).otherwise(1.0)))
    rows = o.select(
        "o_orderkey", (way != 0).alias("model_ran"), F.array(first, page(2, F.when(way == 1, "text_layer").otherwise(model), F.lit(None))).alias("pages"), F.array(F.struct(F.lit("scope").alias("name"), model.alias("source"))).alias("sections"),
        F.when(way == 4, 0.9).otherwise(1.0).alias("coverage"), F.lit(0).alias("n_errors"), F.when(way == 4, 2).otherwise(0).alias("n_dropped"),
    )
    return run.status(rows).select("o_orderkey", "status", F.array_join("status_reasons", "; ").alias("reasons"))


@query("""WITH r AS (SELECT 'headed-' || o_custkey AS document_id, count(*) AS n, count(*) FILTER (o_orderkey % 4 = 3) AS informational FROM orders GROUP BY ALL)
    SELECT document_id, n::DOUBLE AS stated, n::DOUBLE AS counted, (n - informational)::DOUBLE AS by_severity, informational::BIGINT AS dropped FROM r""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The executive summary against the findings it counts; severities that the schema lacks are dropped twice, in the summary's table and in the finding."""
    got = structure.enforce(structure.structure(_reports(spark, sf_dir)))
    return review.reconcile_summary(got).select("document_id", "stated", "counted", "by_severity", F.floor(F.size(F.filter("dropped", lambda d: d["reason"].contains("Critical | High"))) / 2).alias("dropped"))


@query("""SELECT 'team-' || s_nationkey AS document_id, 1.0::DOUBLE AS tools_complete FROM supplier GROUP BY ALL""")
def review_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportmill.catalogue.rendered import _people

    got = structure.enforce(structure.structure(_people(spark, sf_dir)))
    return review.tool_disclosure(got).select("document_id", "tools_complete")
