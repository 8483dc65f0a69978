"""Extraction from whole transcripts: what must be found, and what must not be made up."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from reportmill.operators import extract, findings, lines, tables
from reportmill.plans import structure as P

GENERAL = """<!-- PAGE_START: 1 -->
## Page 1

Web Application Security Audit Report

| Report ID | | RA-17 |
| --- | --- | --- |
| Report Release Date | | 16.02.2026 |
| Prepared by | | Dev Rana |
| Approved by | | Nobody Known |

| Document Title | Document Version |
| --- | --- |
| Audit of Shop | 1.2 |

Period : 1st January 2026 to 31.01.2026
Classification
Restricted use

| S. No | Name | Designation | Email | Certifications |
| --- | --- | --- | --- | --- |
| 1 | Asha Dev Rana | Lead | asha@com | OSCP |
| 2. | B. Singh | Junior | b.singh@x.org | Yes | CEH |
| 3 | Again | Other | ASHA@com | |

| Name | Organization | Designation | Email |
| --- | --- | --- | --- |
| C. Client | Shop Ltd | CISO | c@shop.example |

| Version | Date | Remarks |
| --- | --- | --- |
| v1.0 | 01/02/2026 | First | draft |
| 1.1 | soon | no date |

| Sr | Asset | Internal | URL | Criticality |
| --- | --- | --- | --- | --- |
| No | Description | IP | | |
| 1 | Shop front | 10.1.2.3 | https://shop. example/ | High |
| | Back office | NA | http://bo.example | |

| S. No | Tool Name | Version | License |
| --- | --- | --- | --- |
| 1 | Burp Suite | 2024.1 | Licensed |
| 2 | Nmap | 7.94 | Open Source |
| 3 | nmap | 7.94 | Open Source |

<!-- PAGE_END: 1 -->

<!-- PAGE_START: 2 -->
## Page 2

Methodology
We use the OWASP Top 10 and NIST SP 800-115.
Tools
Executive Summary
All is nearly well.
1
Detailed Observations
1. Broken Access Control
Severity: High   Status: Closed
i. Affected Assets: https://shop.example/admin
ii. CVE/CWE: CWE-284: Improper Access Control
CVSS Score: 8.1 (High)
CVSS Vector: CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:N
Detailed Observation:
Any user can
open the page.
Proof of Concept:
[IMAGE_PAGE_2_FIG_1]
Retest Proof of Concept:
[IMAGE_PAGE_2_FIG_2]
Recommendation: Check roles.
2. Possible (Medium): an attack is likely, but not expected.
Severity: Low
2. Weak TLS
Severity: Info
Status: Reopened
References:
Case I
Appendix A
Status: Open
<!-- PAGE_END: 2 -->"""

CASES = """<!-- PAGE_START: 1 -->
Case I
i. Observation/Vulnerability title
SQL injection
ii. Severity
Critical
iii. Status: Partially fixed
iv. CVE/CWE
cve-2024-12345 CWE-89
v. Impact
Data loss
Case II
Observation/Vulnerability title: Open port
Severity: moderate
New or Repeat: recurring
<!-- PAGE_END: 1 -->"""

HEADERLESS = """| 1 | host1 | SQL injection | CWE-89 | High | Use bound parameters in every statement of the application, and review them all | x | y | z |
| --- | --- | --- | --- | --- | --- | --- | --- | --- |
| 2 | host2 | Weak password | CWE- 521 | low | short | x | y | z |"""

CARRIED = """| S. No | Vulnerability Title | Severity | Complied |
| --- | --- | --- | --- |
| 1 | One | High | |
| 2 | Two | Low | Complied |

text

| 7 | Three | Critical | |
| --- | --- | --- | --- |
| | Four | Weird | |

| only | two |
| --- | --- |
| a | b |

| 9 | Five | High | x |
| --- | --- | --- | --- |
| 10 | Six | High | x |"""

NUMBERED = """1. Scope of the work
We did this.
2. Possible (Medium): an attack is possible but not expected.
Nothing else here."""


def df(spark, **texts):
    return spark.createDataFrame([*texts.items()], "document_id string, markdown string")


@pytest.fixture(scope="module")
def record(spark):
    rows = P.structure(df(spark, general=GENERAL, cases=CASES, empty="", numbered=NUMBERED, headerless=HEADERLESS, carried=CARRIED)).select("document_id", F.to_json("record", {"ignoreNullFields": "false"}).alias("j")).collect()
    return {r.document_id: json.loads(r.j) for r in rows}


def test_front_matter(record):
    r = record["general"]
    assert r["report_meta"] == {
        "report_id": "RA-17", "report_title": "Web Application Security Audit Report", "report_type": None, "report_release_date": "2026-02-16", "report_version": "1.2", "audit_type": None,
        "audit_period": {"from": "2026-01-01", "to": "2026-01-31"}, "classification": "Restricted use",
    }
    d = r["document_control"]
    assert d["document_title"] == "Audit of Shop" and d["prepared_by"] == {"name": "Dev Rana", "auditing_team_sr_no": 1.0} and d["approved_by"] == {"name": "Nobody Known", "auditing_team_sr_no": None} and d["reviewed_by"] == {"name": None, "auditing_team_sr_no": None}
    assert d["change_history"] == [{"version": "v1.0", "date": "2026-02-01", "remarks": "First draft"}]
    assert d["distribution_list"] == [{"name": "C. Client", "organization": "Shop Ltd", "designation": "CISO", "email": "c@shop.example"}]


def test_team_tools_assets(record):
    r = record["general"]
    assert [(m["sr_no"], m["name"], m["designation"], m["email"], m["certifications"]) for m in r["auditing_team"]] == [(1, "Asha Dev Rana", "Lead", "asha@com", "OSCP"), (2, "B. Singh", "Junior", "b.singh@x.org", "CEH")]
    assert [(t["tool_name"], t["version"], t["license_type"]) for t in r["tools_used"]] == [("Burp Suite", "2024.1", "Licensed"), ("Nmap", "7.94", "Open Source")]
    assert [(a["sr_no"], a["asset_description"], a["url"], a["criticality"], a["internal_ip"], a["public_ip"]) for a in r["engagement_scope"]["assets"]] == [(1, "Shop front", "https://shop.example/", "High", "10.1.2.3", None), (2, "Back office", "http://bo.example", None, "NA", None)]


def test_sections(record):
    r = record["general"]
    assert r["methodology"]["standards_referred"] == ["OWASP Top 10", "NIST SP 800-115"]
    assert r["executive_summary"]["narrative"] == "All is nearly well."


def test_headed_findings(record):
    a, b = record["general"]["detailed_observations"]
    assert (a["finding_id"], a["title"], a["severity"], a["status"], a["cvss_score"], a["cvss_vector"]) == ("1", "Broken Access Control", "High", "Closed", 8.1, "CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:N")
    assert a["affected_asset"] == ["https://shop.example/admin"] and a["cwe"] == ["CWE-284: Improper Access Control"] and a["cve_id"] == []
    assert a["observation_description"] == "Any user can open the page." and a["recommendation"].startswith("Check roles.")
    assert [(p["sr_no"], p["reference"], p["is_retest"]) for p in a["proof_of_concept"]] == [(1, "[IMAGE_PAGE_2_FIG_1]", False), (2, "[IMAGE_PAGE_2_FIG_2]", True)]
    assert (b["finding_id"], b["title"], b["severity"], b["status"], b["reference"]) == ("2", "Weak TLS", "Informational", "Reopened", "Case I")
    s = record["general"]["executive_summary"]
    assert s["total_findings"] == 2 and s["severity_count"] == {"critical": 0.0, "high": 1.0, "medium": 0.0, "low": 0.0} and [x["title"] for x in s["summary_table"]] == ["Broken Access Control", "Weak TLS"]


def test_case_template(record):
    a, b = record["cases"]["detailed_observations"]
    assert (a["finding_id"], a["title"], a["severity"], a["status"], a["impact"]) == ("I", "SQL injection", "Critical", "Partially Remediated", "Data loss")
    assert a["cve_id"] == ["CVE-2024-12345"] and a["cwe"] == ["CWE-89"]
    assert (b["finding_id"], b["title"], b["severity"], b["new_or_repeat"]) == ("II", "Open port", "Medium", "Repeat")


def test_findings_tables(record):
    a, b = record["headerless"]["detailed_observations"]
    assert (a["finding_id"], a["title"], a["affected_asset"], a["cwe"], a["severity"]) == ("1", "SQL injection", ["host1"], ["CWE-89"], "High") and a["recommendation"].startswith("Use bound")
    assert (b["finding_id"], b["title"], b["cwe"], b["severity"], b["recommendation"]) == ("2", "Weak password", ["CWE-521"], "Low", None)
    got = [(f["finding_id"], f["title"], f["severity"]) for f in record["carried"]["detailed_observations"]]
    assert got == [("1", "One", "High"), ("7", "Three", "Critical"), ("3", "Four", "Weird")]


def test_nothing_is_made_up(record):
    for name in ("empty", "numbered"):
        r = record[name]
        assert r["detailed_observations"] == [] and r["auditing_team"] == [] and r["executive_summary"]["total_findings"] == 0
        assert r["report_meta"]["report_id"] is None and r["engagement_scope"]["assets"] == [] and r["methodology"]["standards_referred"] == []


def test_labels_next_to_each_other_take_no_value(spark):
    numbered = lines.lines(df(spark, a="Assessment Start Date\nAssessment End Date\n01.02.2024\n03.02.2024\nReport No: 7\nReport ID: 8"))
    got = {r.field: r.value for r in extract.labels(numbered, tables.tables(numbered)).collect()}
    assert got == {"report_id": "7"}
    when = extract.timeline(df(spark, a="Assessment Start Date\nAssessment End Date\n01.02.2024\n03.02.2024")).collect()[0]
    assert (when.start, when.end) == ("2024-02-01", "2024-02-03")


def test_tables_and_pages(spark):
    text = "| a | b |\n|---|---|\n| | |\n| 1 | x&#124;y |\n\n<!-- PAGE_START: 4 -->\n| c |\n|---|\ntext | no |\n| d | e |"
    got = tables.tables(lines.lines(df(spark, t=text))).orderBy("table_no").collect()
    assert [(r.table_no, r.page, r.rows) for r in got] == [(1, None, [["a", "b"], ["1", "x|y"]]), (2, 4, [["c"]]), (3, 4, [["d", "e"]])]


def test_fields_of_a_finding(spark):
    body = "intro\n- Severity: High Status: Open\n**Impact:** bad\nRecommendation\nfix it iii. Description: text"
    got = spark.createDataFrame([(body,)], "b string").select(F.inline(findings.fields(F.col("b")))).collect()
    assert [(r.key, r.value.strip()) for r in got] == [(None, "intro"), ("severity", "High"), ("status", "Open"), ("impact", "bad"), ("recommendation", "fix it"), ("observation_description", "text")]


def test_tables_are_rendered_from_rows_made_once(spark):
    from reportmill.sources import render

    assert str(render.markdown_table(F.col("r"))).count("&#124;") == 1  # a row's cells are made in one place, bound for all uses
    rows = [[["a", "b|c", "d"], ["", "", ""], ["1"], ["2", None, " x\ny "]], [], [["", None]], None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r array<array<string>>").select(render.markdown_table(F.col("r"))).collect()
    assert [r[0] for r in got] == ["| a | b&#124;c | d |\n| --- | --- | --- |\n| 1 |  |  |\n| 2 |  | x y |", "", "", ""]


def test_rows_do_not_carry_their_table(spark):
    table = spark.createDataFrame([("d", 1, [["Name", "Email"], ["a", "a@b.c"]])], "document_id string, table_no int, rows array<array<string>>")
    got = extract._rows(table)
    assert re.search(r"Generate posexplode\(rows#\d+\), \[\d+\]", got._jdf.queryExecution().optimizedPlan().toString())  # the table ends there
    assert [(r.head, r.row_no, r.mail) for r in got.orderBy("row_no").collect()] == [("name email a a@b.c", 0, None), ("name email a a@b.c", 1, 1)]


def test_a_header_finds_its_label_once(spark):
    label = str(findings._field_of(F.regexp_extract("previous", "here", 1)))
    assert label.count("here") == 1  # not once for each of the patterns
    rows = spark.createDataFrame([("Retest Proof of Concept",), ("",), ("reference",), ("none",), (None,)], "x string")
    assert [r[0] for r in rows.select(findings._field_of(F.col("x"))).collect()] == ["retest_poc", None, "reference", None, None]


def test_strip_takes_every_white_space(spark):
    from reportmill.functions import text as T

    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, f"{c}a{c}{c}") for c in every], "c string, x string")
    wrong = df.where(T.strip(F.col("x")) != F.regexp_replace("x", r"(?U)^\s+|\s+$", "")).collect()
    assert wrong == []
    assert "regexp" not in str(T.strip(F.col("x"))).lower()  # each line of a transcript passes here


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bodies_are_cut_from_texts_and_lines_read_once(spark):
    text = "1. First one\r\nSeverity: High\r\nImpact:\ra\x0bb\n2. Second\nStatus: Open\n## Appendix\nSeverity: Low\n3. No\nno"
    late = "1. Alone\nSeverity: Low\nsee Appendix A\n \tannexure: x\nmore"
    last = "1. One\n2. Two\nSeverity: Low\n3. Three  Status: x"
    rows = spark.createDataFrame([("a", text), ("b", late), ("c", last), ("d", None), ("e", "no finding")], "document_id string, markdown string")
    got = findings.bodies(lines.lines(rows), rows)
    assert {(r.document_id, r.ordinal, r.number, r.title, r.body) for r in got.collect()} == {
        ("a", 1, "1", "First one", "Severity: High\nImpact:\na\nb"), ("a", 2, "2", "Second", "Status: Open"), ("b", 1, "1", "Alone", "Severity: Low\nsee Appendix A"),
        ("c", 1, "1", "One", ""), ("c", 2, "2", "Two", "Severity: Low\n3. Three  Status: x"),
    }
    assert _plan(got).count("posexplode(") == 1
    assert _plan(lines.lines(rows)).count("split(") == 1


def test_every_label_begins_with_a_letter_that_is_tried():
    said = {"Re-validation Proof of Concept", "PoC", "Steps to Reproduce", "Screenshot", "Finding ID", "Observation Date", "Identified Date", "Discovery Date", "Date Observed", "Vulnerability title", "Detailed Observation", "Description", "Impact Level",
            "Likelihood", "Ease of Exploitation", "Business Impact", "CVE/CWE", "Affected Asset", "Vulnerable URL", "Recommendation", "Mitigation", "Solution", "Ref", "New or Repeat", "Current Status", "Severity", "Risk", "CVSS", "Vector String", "EPSS", "Pre-condition",
            "Likely Root Cause", "Regulatory Requirement", "Compliance Mapping"}
    every = "|".join(findings.FIELD_LABELS.values())
    assert all(re.fullmatch(every, x, re.I) and re.match(findings._LETTER, x) for x in said)


def test_evidence_is_made_once(spark):
    rows = spark.createDataFrame([("a", "1. One\nSeverity: High\nPoC:\nSeen\n[IMAGE_PAGE_1_FIG_1]\n")], "document_id string, markdown string")
    got = findings.from_headers(lines.lines(rows), rows).select(F.inline("proof_of_concept"))
    assert [(r.sr_no, r.type, r.reference, r.description) for r in got.collect()] == [(1, "text", None, "Seen"), (2, "image", "[IMAGE_PAGE_1_FIG_1]", None)]
    assert _plan(got).count("regexp_extract_all(") == 1


def _table(spark, *tables):
    return spark.createDataFrame([("d", i, rows) for i, rows in enumerate(tables, 1)], "document_id string, table_no int, rows array<array<string>>")


def test_tables_are_put_in_order_once(spark):
    text = "| a |\n|---|\n| 1 |\n\n| b |\n|---|\n| 2 |\n| 3 |"
    got = tables.tables(lines.lines(df(spark, t=text))).where(F.size("rows") > 2)
    assert [(r.table_no, r.rows) for r in got.collect()] == [(2, [["b"], ["2"], ["3"]])]
    plan = _plan(got)
    assert plan.count(".cells") == 1 and "row_number" not in plan  # not for the filter too, and without numbering rows first


def test_a_changes_date_is_read_once(spark):
    changes = [["Version", "Date", "Remarks"], ["1.0", "1 May 2024", "a"], ["x", "2 May 2024", "b"], ["v2", "soon", "c"], ["1.1", "02.05.2024", "c", "d"]]
    got = extract.history(_table(spark, changes, [["Name", "Email"], ["1.0", "1 May 2024", "no"]]))
    assert [tuple(r) for r in got.select("ordinal", "version", "date", "remarks").orderBy("ordinal").collect()] == [(1, "1.0", "2024-05-01", "a"), (2, "1.1", "2024-05-02", "c d")]
    assert _plan(got).count("array_sort(concat(") == 1 and _plan(got).count("transform(row#") == 1


def test_a_recipients_cells_are_made_once(spark):
    told = [["Name", "Organization", "Role", "Email"], ["1", "A", "Org", "Head", "of", "a@b.c"], ["B", "Org", "b@b.c"], ["1", "only@b.c"], ["C", "Org", "none"], ["2", "x@b.c"]]
    got = extract.recipients(_table(spark, told, [["Name", "Email"], ["D", "d@b.c"]]))
    assert [tuple(r) for r in got.select("ordinal", "name", "organization", "designation", "email").orderBy("ordinal").collect()] == [(1, "A", "Org", "Head of", "a@b.c"), (2, "B", "Org", None, "b@b.c")]
    assert _plan(got).count("transform(row#") == 1 and _plan(got).count("slice(c#") == 1


def test_plain_cells_are_rendered_as_they_are(spark):
    from reportmill.functions import text as T
    from reportmill.sources import render

    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    cells = [None, "", " ", "a\r\nb", " a", "a ", "a b", "||", "a" * 100_000 + "\n", *every, *[f"a{c}b" for c in every], *[f"{c}a{c}" for c in every]]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    whole = T.strip(F.replace(F.regexp_replace(F.coalesce("c", F.lit("")), r"\r\n|\n", " "), F.lit("|"), F.lit("&#124;")))
    assert rows.where(~render.escape_cell(F.col("c")).eqNullSafe(whole)).collect() == []
    assert str(render.escape_cell(F.col("c"))).startswith("Column<'CASE WHEN")  # the rule is for the others


def test_a_tools_license_is_found_once(spark):
    used = [["No", "Tool Name", "Version", "License"], ["1", "Burp", "2024", "licensed"], ["2", "nmap", "Open-Source"], ["3", "Nmap", "open source"], ["4", "Zap"], ["5"], ["x", "Nikto", "Free"]]
    got = extract.tools(_table(spark, used, [["S. No", "Name"], ["1", "Ann"], ["2", "Ben", "Commercial"]]))
    assert [tuple(r) for r in got.select("ordinal", "sr_no", "tool_name", "version", "license_type").orderBy("ordinal").collect()] == [
        (1, 1, "Burp", "2024", "Licensed"), (2, 2, "nmap", None, "Open Source"), (3, 4, "Zap", None, None), (4, 2, "Ben", None, "Commercial"),
    ]
    assert _plan(got).count("open[") == 1 and _plan(got).count("transform(row#") == 1


def test_a_members_address_is_looked_for_once(spark):
    people = [["S. No", "Name", "Designation", "Email", "Listed"], ["1", "Ann", "Lead", "Auditor", "a@b.c", "Yes", "OSCP"], ["2.", "Ben", "b@b.c"], ["3", "c@b.c"], ["x", "Dan", "d@b.c"], ["4", "Ann again", "A@b.c"]]
    got = extract.team(_table(spark, people, [["S. No", "Name", "Organization", "Email"], ["1", "Eve", "Org", "e@b.c"]]))
    assert [tuple(r) for r in got.select("ordinal", "sr_no", "name", "designation", "email", "certifications").orderBy("ordinal").collect()] == [(1, 1, "Ann", "Lead Auditor", "a@b.c", "OSCP"), (2, 2, "Ben", None, "b@b.c", None)]
    plan = _plan(got)
    assert plan.count("transform(row#") == 1 and len(re.findall(r"RLIKE\([^()]*, \[A-Za-z0-9\._%\+-\]", plan)) == 1


def test_sections_are_read_once_and_equal_each_alone(spark):
    texts = [
        None, "", "no section", "Acme Report\n\nMethodology\nOWASP Top 10\n\nMethodology:\nPTES\n| x |\nTools\nOSSTMM", "1. Methodology\n2.1 Standards Referred\nNIST CSF\nExecutive Summary\nAll well.\nOf two lines\n12\nno more\nAppendix",
        "Exclusions\n• a\n-\n* b, c\n\nTools", "## Out of Scope:\nphones\nDetails of Auditing\nno", "Executive Summary\n7\nno", "Executive Summary", "methodology\n" * 3 + "ISO 27001", "Exclusions\n" + "x\n" * 60,
        "x\n" * 14 + "Late Report", "x\n" * 15 + "Too late Report", "---\n" * 30 + "# Some Assessment ", "a\n<!-- PAGE_END: 1 -->\nNext Report", "Document title\nReport\n# Document transcript Report", "Toolsmith\nExclusion\nb\nExecutive Summary: x\n\tAudit  Methodology\nMASVS\n Tools\nx",
    ]
    rows = lines.lines(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, markdown string")).cache()
    every = ["standards", "exclusions", "narrative", "title"]
    got = extract.sections(rows)
    said = {r.document_id: {k: r[k] for k in every if r[k] is not None} for r in got.collect()}
    want = {}
    for k in every:
        for r in getattr(extract, k)(rows).collect():
            if r[k] is not None:
                want.setdefault(r.document_id, {})[k] = r[k]
    assert {k: v for k, v in said.items() if v} == want and len(want) > 8
    rows.unpersist()
    assert "Window" not in _plan(extract.sections(spark.createDataFrame([], rows.schema)))  # no line is put in order


def test_dates_are_marked_as_they_were_cut(spark):
    from reportmill.functions import dates as D

    old = (
        r"(?iU)\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b|\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b"
        r"|\b\d{1,2}(?:st|nd|rd|th)?[\s\-./,]*[A-Za-z]{3,9}\.?[\s\-./,]*(?:\d{4}|\d{2})\b|\b[A-Za-z]{3,9}\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}\b"
    )
    pieces = ["1", "2024", "12/", "5.", "-", "3rd", "May", "5TH ", "Sep.", " ", ", ", "24", "_", "x", "é", "٣", " ", "Januaryfebruary", "20", "\x01", "\x02", "ſep", "\n"]
    some = random.Random(3)
    texts = [None, "", "1.2.2024\x01 May 5, 2024\x02", "2024-02-30 and 5th of May 2024", "a" * 50_000 + " 1 May 2024"] + ["".join(some.choices(pieces, k=some.randint(1, 12))) for _ in range(4000)]
    c = F.col("c")
    hits = F.regexp_extract_all(c, F.lit(old), F.lit(0))
    parts = F.zip_with(F.split(c, old, -1), F.transform(hits, lambda h: F.coalesce(D.parse_date(h), h)), lambda g, h: F.concat(F.coalesce(g, F.lit("")), F.coalesce(h, F.lit(""))))
    want = F.when(c.rlike(r"(?U)\d") & (F.size(hits) > 0), F.array_join(parts, "")).otherwise(c)
    rows = spark.createDataFrame([(t,) for t in texts], "c string")
    got = rows.select("c", D.normalize_dates(c).alias("got"), want.alias("want")).collect()
    assert [r for r in got if r.got != r.want] == [] and sum(r.c != r.got for r in got) > 30
    assert str(D.normalize_dates(c)).count("regexp_extract_all") <= str(want).count("regexp_extract_all") - 1


def test_plain_lines_are_prose_as_they_are(spark):
    from reportmill.functions import text as T

    pieces = ["Open", " ", "  ", "\n", "\t", ":", "Page 1 of 2", "page ", "iv.", "x", "CONFIDENTIAL", "nil", "n/a.", "&#124;", "&", "•", "*", "-", "(", "é", "\r", "[IMAGE_PAGE_1_FIG_1]", "|", "#", "---", "\x0b", "1."]
    some = random.Random(4)
    texts = [None, "", "NIL ", " N/A.", "nil:", "a" * 50_000, *pieces, *[f"\n{p}\n" for p in pieces]] + ["".join(some.choices(pieces, k=some.randint(1, 6))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "c string")
    plain, T._PLAIN = T._PLAIN, "(?!)"
    try:
        want = T.prose(F.col("c"))
    finally:
        T._PLAIN = plain
    got = rows.select("c", T.prose(F.col("c")).alias("got"), want.alias("want"), F.col("c").rlike(plain).alias("plain")).collect()
    assert [r for r in got if r.got != r.want] == [] and sum(bool(r.plain) for r in got) > 100


def test_usual_labels_are_what_the_patterns_say(spark):
    usual = findings._USUAL
    rows = spark.createDataFrame([(x,) for x in [*usual, *[x.lower() for x in usual], "", "Unknown"]], "c string")
    c = F.col("c")
    want = F.when(c != "", F.coalesce(*[F.when(c.rlike(f"(?iU)^(?:{p})$"), F.lit(k)) for k, p in findings.FIELD_LABELS.items()]))
    assert [r for r in rows.select("c", findings._field_of(c).alias("got"), want.alias("want")).collect() if r.got != r.want] == []
