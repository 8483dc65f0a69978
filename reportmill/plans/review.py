"""Reviews of master records: sign-offs, scope, tools, standards, summaries, retests. All over (document_id, record)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.functions import text as T


def signoff_separation(records: DataFrame) -> DataFrame:
    """(document_id, reviewer_distinct, approver_distinct): whether they are other team members than who prepared; null if either is unknown."""
    d = F.col("record")["document_control"]
    other = lambda role: d[role]["auditing_team_sr_no"] != d["prepared_by"]["auditing_team_sr_no"]
    return records.select("document_id", other("reviewed_by").alias("reviewer_distinct"), other("approved_by").alias("approver_distinct"))


def unresolved_assets(records: DataFrame) -> DataFrame:
    """(document_id, finding_id, affected_asset) of findings whose asset the scope doesn't declare, by URL, address or description after normalisation."""
    key = lambda c: F.regexp_replace(F.lower(c), r"^https?://|/+$|\s+", "")
    found = records.select("document_id", F.explode(F.col("record")["detailed_observations"]).alias("f")).select("document_id", F.col("f.finding_id").alias("finding_id"), F.explode("f.affected_asset").alias("affected_asset"))
    scope = records.select("document_id", F.explode(F.col("record")["engagement_scope"]["assets"]).alias("a"))
    names = scope.select("document_id", F.explode(F.array_compact(F.array("a.url", "a.internal_ip", "a.public_ip", "a.asset_description"))).alias("name")).select("document_id", key(F.col("name")).alias("key")).distinct()
    return found.withColumn("key", key(F.col("affected_asset"))).join(names, ["document_id", "key"], "left_anti").drop("key")


def scope_staleness(records: DataFrame) -> DataFrame:
    """(document_id, days): from the scope list's last update to the assessment's end."""
    r = F.col("record")
    end, till = r["audit_timeline"]["assessment_end_date"].try_cast("date"), r["engagement_scope"]["scope_updated_till"].try_cast("date")
    return records.select("document_id", F.date_diff(end, till).alias("days"))


def tool_disclosure(records: DataFrame) -> DataFrame:
    """(document_id, tools_complete): share of tools with name, version and license; null without tools."""
    tools = F.col("record")["tools_used"]
    full = F.size(F.filter(tools, lambda t: t["tool_name"].isNotNull() & t["version"].isNotNull() & t["license_type"].isNotNull()))
    return records.select("document_id", F.when(F.size(tools) > 0, full / F.size(tools)).alias("tools_complete"))


def standards_share(records: DataFrame, accepted: Sequence[str]) -> DataFrame:
    """(document_id, share) of a record's standards that are on a list."""
    named = F.col("record")["methodology"]["standards_referred"]
    return records.select("document_id", F.when(F.size(named) > 0, F.size(F.filter(named, lambda s: s.isin(*accepted))) / F.size(named)).alias("share"))


def reconcile_summary(records: DataFrame) -> DataFrame:
    """Adds stated (total), counted (findings), by_severity (the sum of the summary's counts) and rows_differ: summary rows whose title or severity is not the finding's."""
    r = F.col("record")
    e, found = r["executive_summary"], r["detailed_observations"]
    sums = sum((F.coalesce(e["severity_count"][x], F.lit(0.0)) for x in ("high", "medium", "low")), F.coalesce(e["severity_count"]["critical"], F.lit(0.0)))
    same = lambda s, f: (s["finding_id"] == f["finding_id"]) & s["title"].eqNullSafe(f["title"]) & s["severity"].eqNullSafe(f["severity"])
    differ = F.size(F.filter(e["summary_table"], lambda s: ~F.exists(found, lambda f: same(s, f))))
    return records.withColumn("stated", e["total_findings"]).withColumn("counted", F.size(found).cast("double")).withColumn("by_severity", sums).withColumn("rows_differ", differ)


def retests(records: DataFrame) -> DataFrame:
    """(document_id, finding_id, retest_date, evidence_found, later): closures with whether their evidence exists in the finding, and whether the retest is later than its first evidence."""
    closed = records.select("document_id", F.explode(F.col("record")["appendices"]["retest_closure"]).alias("c")).select("document_id", "c.*")
    shown = records.select("document_id", F.explode(F.col("record")["detailed_observations"]).alias("f")).select("document_id", F.col("f.finding_id").alias("finding_id"), F.explode("f.proof_of_concept").alias("p"))
    shown = shown.groupBy("document_id", "finding_id").agg(F.min("p.capture_date").alias("first"), F.collect_set("p.sr_no").alias("numbers"))
    met = closed.join(shown, ["document_id", "finding_id"], "left")
    return met.select("document_id", "finding_id", "retest_date", F.coalesce(F.array_contains("numbers", F.col("closure_evidence_ref")), F.lit(False)).alias("evidence_found"), (F.col("retest_date") > F.col("first")).alias("later"))


def rate_by_matrix(records: DataFrame) -> DataFrame:
    """(document_id, finding_id, severity, expected): the severity that the record's own risk matrix gives for a finding's impact and likelihood."""
    matrix = records.select("document_id", F.explode(F.col("record")["appendices"]["risk_rating_criteria"]).alias("m")).select("document_id", "m.impact_level", "m.likelihood_level", T.severity(F.col("m.rating")).alias("expected"))
    found = records.select("document_id", F.explode(F.col("record")["detailed_observations"]).alias("f")).select("document_id", "f.finding_id", "f.severity", "f.impact_level", "f.likelihood_level")
    return found.join(matrix, ["document_id", "impact_level", "likelihood_level"], "left").select("document_id", "finding_id", "severity", "expected")
