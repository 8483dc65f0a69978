"""Queries that replay runs and reviews: a model's answers and attempts, page layout and masks, files by bytes, and reviews of typed records; inputs are made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from reportmill.catalogue._register import Register
from reportmill.catalogue.made import _placements, _values
from reportmill.functions import dates as D
from reportmill.functions import schema as S
from reportmill.functions import text as T
from reportmill.operators import coverage, extract, gate, images, run, tables
from reportmill.plans import review

query = Register()
QUERIES, SQL = query.queries, query.sql


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its key as text, ``k``."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").cast("string").alias("k"))


def _say(pattern: str):
    """``pattern`` with the order's key for each %s."""
    return F.format_string(pattern, *[F.col("k")] * pattern.count("%s"))


_FIELDS = [("16.02.2026", "2026-02-16"), ("on 5 May 2024", "2024-05-05"), ("NA", "NA"), (" soon ", "soon"), (" - ", None), (None, None), ("", None)]
_PIECES = [("## Title", "Title"), ("• item *", "item"), ("3) x [IMAGE_PAGE_1_FIG_2] y", "x   y"), ("`code`", "code"), ("https://a.example/ b", "https://a.example/b"), ("", "")]


@query(_values(_FIELDS))
def date_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a, _ in _FIELDS], "given string").select("given", D.date_field(F.col("given")).alias("result"))


@query(_values(_PIECES))
def clean_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a, _ in _PIECES], "given string").select("given", T.clean_piece(F.col("given")).alias("result"))


@query("SELECT o_orderkey, unnest([1, 2])::INT AS n, unnest(['first ' || o_orderkey, 'second ' || o_orderkey]) AS item FROM orders")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _orders(spark, sf_dir).select("o_orderkey", F.posexplode(T.items(_say("• first %s\n• NA\n• second %s"))).alias("n", "item"))
    return got.withColumn("n", F.col("n") + 1)


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '{"a": ' || o_orderkey || '}' WHEN 1 THEN 'Here: {"a": ' || o_orderkey || '} done' WHEN 2 THEN '[1, ' || o_orderkey || ']' WHEN 3 THEN 'no json' ELSE '{"a": ' || o_orderkey END AS bare,
    CASE WHEN o_orderkey % 5 IN (0, 1) THEN '{"a":' || o_orderkey || '}' END AS object FROM orders""")
def model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model, fenced, within prose, no object, or broken."""
    way = F.col("o_orderkey") % 5
    text = F.when(way == 0, _say('```json\n{"a": %s}\n```')).when(way == 1, _say('Here: {"a": %s} done')).when(way == 2, _say("[1, %s]")).when(way == 3, "no json").otherwise(_say('{"a": %s'))
    return _orders(spark, sf_dir).select("o_orderkey", T.strip_fences(text).alias("bare"), F.to_json(T.json_object(text)).alias("object"))


@query("""SELECT o_orderkey::VARCHAR AS document_id, 1 AS page, CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END AS attempt, CASE WHEN o_orderkey % 3 > 0 THEN 'alpha k' || o_orderkey END AS text, CASE WHEN o_orderkey % 3 > 0 THEN 1.0::DOUBLE END AS recall,
    CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS attempts, CASE WHEN o_orderkey % 3 = 0 THEN 'fallback' ELSE 'model' END AS source FROM orders""")
def attempted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails on some pages, misses a word at first on others, and is told which; the best attempt stays."""

    def transcribe(document_id: str, page: int, missing: str, attempt: int) -> str:
        way = int(document_id) % 3
        if way == 0:
            raise RuntimeError("down")
        return f"alpha k{document_id}" if way == 2 else f"alpha {missing}".strip()

    pages = _orders(spark, sf_dir).select(F.col("k").alias("document_id"), F.lit(1).alias("page"), _say("alpha k%s").alias("reference"))
    return run.best_attempt(run.attempt_pages(pages, transcribe), ["document_id", "page"]).select("document_id", "page", "attempt", "text", "recall", "attempts", "source")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("o_orderkey") % 4
    one = lambda n, text, truncated, errors, problem: F.struct(F.lit(n).alias("attempt"), text.alias("text"), F.lit(truncated).alias("truncated"), F.lit(errors).alias("n_errors"), problem.cast("string").alias("error"))
    none, good = F.lit(None), _say('{"a": %s}')
    some = F.array(one(1, F.lit("no json"), False, 0, none), one(2, good, False, 2, none), one(3, F.lit('{"a": 9}'), True, 0, none))
    valid = F.array(one(1, good, False, 0, none), one(2, F.lit('{"a": 8}'), False, 0, none))
    never = F.array(one(1, F.lit("x"), False, 0, none), one(2, F.lit("[]"), False, 0, none), one(3, F.lit("x"), False, 0, none))
    later = F.array(one(1, F.lit(None).cast("string"), False, 0, F.lit("down")), one(2, good, False, 0, none), one(3, F.lit('{"a": 7}'), False, 0, none))
    return _orders(spark, sf_dir).select("o_orderkey", F.inline(F.when(way == 0, some).when(way == 1, valid).when(way == 2, never).otherwise(later)))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 2 THEN '{"a":' || o_orderkey || '}' END AS object, CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END::BIGINT AS attempts, CASE WHEN o_orderkey % 4 = 2 THEN 'rule_based' ELSE 'model' END AS source FROM orders""")
def section_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid answer of a section, else its last usable one, else none."""
    return run.usable_sections(_answers(spark, sf_dir), ["o_orderkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN 'rules ' || o_orderkey ELSE '{"a":' || o_orderkey || '}' END AS object, CASE WHEN o_orderkey % 4 = 2 THEN 'rule_based' ELSE 'model' END AS source FROM orders""")
def section_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections without a usable answer are those of the rules."""
    model = run.usable_sections(_answers(spark, sf_dir), ["o_orderkey"]).where("object is not null").select("o_orderkey", "object")
    return run.with_fallback(model, _orders(spark, sf_dir).select("o_orderkey", _say("rules %s").alias("object")), ["o_orderkey"])


@query("""SELECT 'c' || o_custkey AS document_id, o_orderkey AS n, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS rule_ordinal, o_orderkey % 3 = 0 AS stub FROM orders""")
def finding_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's list of findings against the rules' findings, which hold each title twice."""
    o = _orders(spark, sf_dir).withColumn("document_id", F.format_string("c%d", "o_custkey"))
    index = o.select("document_id", F.col("o_orderkey").alias("n"), F.col("k").alias("finding_id"), F.when(F.col("o_orderkey") % 3 == 0, _say("Other %s")).otherwise(_say(" Weakness  of-ORDER %s!")).alias("title"))
    found = o.select("document_id", F.explode(F.array(F.col("o_orderkey"), F.col("o_orderkey") + 10**9)).alias("ordinal"), _say("Weakness of order %s").alias("title"))
    return run.match_index(index, found).select("document_id", "n", "rule_ordinal", "stub")


@query("""SELECT o_orderkey::VARCHAR AS document_id, 1 AS page, CASE WHEN o_orderkey % 2 = 0 THEN '| t' || o_orderkey || ' |' || chr(10) || chr(10) ELSE '' END || 'high' || chr(10) || '[IMAGE_PAGE_1_FIG_1]' || chr(10) || 'low ' || o_orderkey || chr(10) || '[IMAGE_PAGE_1_FIG_2]' AS markdown FROM orders""")
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables first, then text and image tags by height; a tag without a place comes last."""
    o = _orders(spark, sf_dir).select("k", "o_orderkey", F.col("k").alias("document_id"), F.lit(1).alias("page"))
    block = lambda n, y, is_text, text: F.struct(F.lit(n).alias("block_no"), F.lit(y).alias("y0"), F.lit(1.0).alias("x0"), F.lit(is_text).alias("is_text"), text.alias("text"))
    blocks = o.select("document_id", "page", F.inline(F.array(block(0, 5.0, True, _say("low %s ")), block(1, 1.0, True, F.lit("high")), block(2, 2.0, False, F.lit("image")), block(3, 3.0, True, F.lit("  ")))))
    tag = lambda n, y, x: F.struct(F.lit(f"[IMAGE_PAGE_1_FIG_{n}]").alias("tag"), F.lit(y).cast("double").alias("y0"), F.lit(x).cast("double").alias("x0"))
    tags = o.select("document_id", "page", F.inline(F.array(tag(1, 5.0, 0.0), tag(2, None, None))))
    return images.layout_pages(o.where("o_orderkey % 2 = 0").select("document_id", "page", F.lit(0).alias("table_no"), _say("| t%s |").alias("markdown")), blocks, tags)


@query("""WITH w AS (SELECT o_orderkey, unnest([1, 1, 1, 1, 2])::INT AS page, unnest([0, 1, 2, 3, 0])::INT AS word_no FROM orders)
    SELECT o_orderkey::VARCHAR AS document_id, page, word_no FROM w WHERE page = 2 OR NOT (least(10 * word_no + 10, o_orderkey % 40) - 10 * word_no > 5)""")
def masked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that an image covers by more than half are left out."""
    o = _orders(spark, sf_dir)
    at = lambda page, n: F.struct(F.lit(page).alias("page"), F.lit(n).alias("word_no"))
    words = o.select(F.col("k").alias("document_id"), F.inline(F.array(at(1, 0), at(1, 1), at(1, 2), at(1, 3), at(2, 0))))
    words = words.select("*", (F.col("word_no") * 10.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("word_no") * 10.0 + 10).alias("x1"), F.lit(10.0).alias("y1"))
    rects = o.select(F.col("k").alias("document_id"), F.lit(1).alias("page"), F.lit(0.0).alias("rx0"), F.lit(-5.0).alias("ry0"), (F.col("o_orderkey") % 40).cast("double").alias("rx1"), F.lit(50.0).alias("ry1"))
    return coverage.masked_words(words, rects).select("document_id", "page", "word_no")


@query("SELECT o_custkey::VARCHAR AS document_id, o_orderkey AS xref, sum(o_orderkey % 50) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) > 100 AS over FROM orders")
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = _orders(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("document_id"), F.col("o_orderkey").alias("xref"), F.repeat(F.lit("x"), (F.col("o_orderkey") % 50).cast("int")).cast("binary").alias("data"))
    return gate.within_budget(streams, budget=100).select("document_id", "xref", "over")


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem), k AS (SELECT *, l_quantity * 2 < 40 AS layout FROM l WHERE (l_quantity + 3)::INT >= 8 AND (l_quantity * 2)::INT >= 8)
    SELECT l_orderkey::VARCHAR AS document_id, '[IMAGE_PAGE_' || l_linenumber || '_FIG_' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) || ']' AS tag, sha256(l_partkey::VARCHAR) AS sha256, l_linenumber::INT AS page FROM k WHERE NOT layout""")
def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's map of tags to placements, read back by tag."""
    made = images.manifest(images.tag_placements(_placements(spark, sf_dir).withColumn("uri", F.lit("x"))))
    return made.select("document_id", F.explode("images").alias("tag", "p")).select("document_id", "tag", "p.sha256", "p.page")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("o_orderkey") % 3
    content = F.when(way == 0, _say("plain text %s")).when(way == 1, _say("%%PDF-1.7 %s")).otherwise(_say("MZ %s")).cast("binary")
    length = F.when(F.col("o_orderkey") % 7 == 0, 300 << 20).otherwise(F.octet_length(content))
    return _orders(spark, sf_dir).select("o_orderkey", F.col("k").alias("document_id"), _say("/in/my report %s.pdf").alias("path"), length.cast("long").alias("length"), content.alias("content"))


@query("""SELECT o_orderkey::VARCHAR AS document_id, CASE WHEN o_orderkey % 7 = 0 THEN 'size' ELSE 'file_type' END AS "check", 'SUSPICIOUS' AS verdict,
    CASE WHEN o_orderkey % 7 = 0 THEN '314572800 bytes exceeds the 268435456-byte scan limit' ELSE '.pdf file does not contain a PDF header' END AS detail FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 3 <> 1""")
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.file_checks(_files(spark, sf_dir))


@query("""WITH f AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'plain text ' WHEN 1 THEN '%PDF-1.7 ' ELSE 'MZ ' END || o_orderkey AS content FROM orders)
    SELECT 'my_report_' || o_orderkey || '-' || sha256(content)[1:12] AS document_id, sha1('blob ' || length(content) || chr(0) || content) AS git_sha1, CASE WHEN o_orderkey % 3 = 0 THEN 'PASS' ELSE 'BLOCK' END AS recommendation FROM f""")
def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document ids, the hash under which a version control system keeps the bytes, and whether they are plain text."""
    stem = T.safe_stem(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", ""))
    return _files(spark, sf_dir).select(T.document_id(stem, F.col("content")).alias("document_id"), T.git_blob_sha1(F.col("content")).alias("git_sha1"), gate.text_recommendation(F.col("content")).alias("recommendation"))


@query("""SELECT o_orderkey, array_to_string(list_transform(range(o_orderkey % 20, least(70, o_orderkey % 20 + 60)), lambda i: 't' || i), ' ') AS missing FROM orders""")
def first_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 70 words a page's text holds the first few; the first 60 of the others, in order."""
    words = lambda n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("t"), i.cast("string"))), " ")
    o = _orders(spark, sf_dir)
    few = (F.col("o_orderkey") % 20).cast("int")
    got = coverage.first_missing(o.select("o_orderkey", words(F.lit(70)).alias("text")), o.select("o_orderkey", F.when(few > 0, words(F.greatest(few, F.lit(1)))).otherwise("").alias("text")), ["o_orderkey"])
    return got.select("o_orderkey", F.array_join("missing", " ").alias("missing"))


@query("SELECT o_orderkey::VARCHAR AS document_id, strftime(o_orderdate, '%Y-%m-%d') AS start, strftime(o_orderdate::DATE + 10, '%Y-%m-%d') AS \"end\" FROM orders")
def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("# Report\nAssessment Start Date\n\nAssessment End Date\n"), F.date_format("d", "dd.MM.yyyy"), F.lit("\n"), F.date_format(F.date_add("d", 10), "d MMMM yyyy"), F.lit("\n01.01.2001\n"))
    return extract.timeline(_orders(spark, sf_dir).select(F.col("k").alias("document_id"), body.alias("markdown")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat_ws(' ', CASE WHEN o_orderkey % 5 > 0 THEN 'asset=1' END, 'cwe=3', 'recommendation=5', 'severity=4', 'sr=0', 'title=2') END AS roles FROM orders""")
def summary_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the cells of findings rows without a header; a row without a CWE cell has none."""
    advice = "Keep what is secret out of what is public, and review that every year."
    cwe = F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise(F.format_string("CWE-%d: Name", F.col("o_orderkey") % 900 + 1))
    row = F.array((F.col("o_orderkey") % 50 + 1).cast("string"), F.when(F.col("o_orderkey") % 5 > 0, _say("host%s")).otherwise(" "), _say("Weakness %s"), cwe, F.when(F.col("o_orderkey") % 2 == 0, "High").otherwise("medium"), F.lit(advice))
    said = F.transform(F.array_sort(F.map_entries(tables.summary_roles(row))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(said, " ").alias("roles"))


@query("""SELECT o_orderkey, 'report id ' || o_orderkey || ' total findings ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE o_orderkey || '.5' END || ' tools used tool name T' || o_orderkey || ' sr no tool name U sr no 2 report title' AS corpus FROM orders""")
def record_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a record says, with the names of fields that have no value."""
    kind = Y.StructType.fromDDL("report_id string, total_findings double, tools_used array<struct<tool_name:string,sr_no:double>>, report_title string, _meta string")
    number = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 0.0).otherwise(0.5)
    tool = lambda name, n: F.struct(name.alias("tool_name"), F.lit(n).cast("double").alias("sr_no"))
    made = F.struct(F.col("k").alias("report_id"), number.alias("total_findings"), F.array(tool(_say("T%s"), None), tool(F.lit("U"), 2.0)).alias("tools_used"), F.lit(None).cast("string").alias("report_title"), F.lit("hidden").alias("_meta"))
    return _orders(spark, sf_dir).select("o_orderkey", made.alias("r")).select("o_orderkey", S.corpus(F.col("r"), kind).alias("corpus"))


@query("""SELECT o_orderkey, '1' AS extra, o_orderkey::VARCHAR AS report_id, 'certifications,designation,email,name,sr_no' AS team_fields, '[]' AS tools, 'assessment_end_date,assessment_start_date' AS timeline FROM orders""")
def conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing keys are added, extra ones and all values stay."""
    text = S.conform(_say('{"extra": 1, "report_meta": {"report_id": %s}, "auditing_team": [{"name": "x"}], "tools_used": null}'))
    at = lambda path: F.get_json_object("r", path)
    keys = lambda path: F.array_join(F.array_sort(F.json_object_keys(at(path))), ",")
    return _orders(spark, sf_dir).select("o_orderkey", text.alias("r")).select("o_orderkey", at("$.extra").alias("extra"), at("$.report_meta.report_id").alias("report_id"), keys("$.auditing_team[0]").alias("team_fields"), at("$.tools_used").alias("tools"), keys("$.audit_timeline").alias("timeline"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records of reviews: people, scope, findings with evidence, a risk matrix and closures."""
    key, day = F.col("o_orderkey"), lambda n: F.date_format(F.date_add("d", n), "yyyy-MM-dd")
    text = F.format_string(
        '{"report_meta": {"report_release_date": "%s"}, "document_control": {"prepared_by": {"auditing_team_sr_no": 1}, "reviewed_by": {"auditing_team_sr_no": %d}, "approved_by": {"name": "A"}}, "engagement_scope": {"assets": [{"url": "https://a.example/%s/", "internal_ip": "10.0.0.%d"}], "scope_updated_till": "%s"},'
        ' "audit_timeline": {"assessment_end_date": "%s"}, "methodology": {"standards_referred": ["PTES", "OSSTMM", "S%d"]}, "tools_used": [{"tool_name": "T", "license_type": "%s"}],'
        ' "detailed_observations": [{"finding_id": "1", "severity": "%s", "impact_level": "Major", "likelihood_level": "Easy", "affected_asset": ["HTTP://A.example/%s", "10.0.0.7", "other%s"], "proof_of_concept": [{"sr_no": 1, "capture_date": "%s"}, {"sr_no": 2, "capture_date": "%s"}]}],'
        ' "appendices": {"risk_rating_criteria": [{"rating": "Critical risk", "impact_level": "Major", "likelihood_level": "Easy"}], "retest_closure": [{"finding_id": "1", "retest_date": "%s", "closure_evidence_ref": %d}, {"finding_id": "2", "retest_date": "%s", "closure_evidence_ref": 1}]}}',
        F.when(key % 2 == 0, day(0)).otherwise("16.02.2026"), key % 3, F.col("k"), key % 20, day(0), day(10), key % 2, F.when(key % 3 == 0, "Freeware").otherwise("Licensed"),
        F.when(key % 5 == 0, "Severe").otherwise("High"), F.col("k"), F.col("k"), day(5), day(4), F.when(key % 2 == 0, day(6)).otherwise(day(3)), key % 4, day(6),
    )
    return _orders(spark, sf_dir).select(F.col("k").alias("document_id"), F.from_json(text, S.spark_type(S.TEMPLATE)).alias("record"))


@query("""SELECT o_orderkey::VARCHAR AS document_id, unnest(list_filter([CASE WHEN o_orderkey % 2 = 1 THEN 'report_meta.report_release_date: {"value":"16.02.2026"} is not YYYY-MM-DD' END, CASE WHEN o_orderkey % 3 = 0 THEN 'tools_used[0].license_type: {"value":"Freeware"} is not Open Source | Licensed' END,
    CASE WHEN o_orderkey % 5 = 0 THEN 'detailed_observations[0].severity: {"value":"Severe"} is not Critical | High | Medium | Low' END], lambda x: x IS NOT NULL)) AS problem FROM orders""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("document_id", F.explode(S.violations(F.col("record"))).alias("problem"))


@query("SELECT o_orderkey::VARCHAR AS document_id, o_orderkey % 3 <> 1 AS reviewer_distinct, NULL::BOOLEAN AS approver_distinct FROM orders")
def review_signoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.signoff_separation(_records(spark, sf_dir))


@query("""SELECT o_orderkey::VARCHAR AS document_id, '1' AS finding_id, unnest(list_filter(['other' || o_orderkey, CASE WHEN o_orderkey % 20 <> 7 THEN '10.0.0.7' END], lambda x: x IS NOT NULL)) AS affected_asset FROM orders""")
def review_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.unresolved_assets(_records(spark, sf_dir))


@query("SELECT o_orderkey::VARCHAR AS document_id, 10 AS days FROM orders")
def review_scope_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.scope_staleness(_records(spark, sf_dir))


@query("SELECT o_orderkey::VARCHAR AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END / 3.0::DOUBLE AS share FROM orders")
def review_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.standards_share(_records(spark, sf_dir), ["PTES", "S0"])


@query("""SELECT o_orderkey::VARCHAR AS document_id, '1' AS finding_id, strftime(o_orderdate::DATE + CASE WHEN o_orderkey % 2 = 0 THEN 6 ELSE 3 END, '%Y-%m-%d') AS retest_date, o_orderkey % 4 IN (1, 2) AS evidence_found, o_orderkey % 2 = 0 AS later FROM orders
    UNION ALL SELECT o_orderkey::VARCHAR, '2', strftime(o_orderdate::DATE + 6, '%Y-%m-%d'), false, NULL FROM orders""")
def review_retests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.retests(_records(spark, sf_dir))


@query("SELECT o_orderkey::VARCHAR AS document_id, '1' AS finding_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Severe' ELSE 'High' END AS severity, 'Critical' AS expected FROM orders")
def review_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.rate_by_matrix(_records(spark, sf_dir))
