"""Queries over texts as they come: documents, pages, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.catalogue._register import Register
from reportmill.functions import text as T
from reportmill.operators import coverage, images, run
from reportmill.operators import lines as L

query = Register()
QUERIES, SQL = query.queries, query.sql
_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+(?:[.\-/:@][a-z0-9]+)*')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_CONTENT = f"token NOT IN ({_STOP}) AND (length(token) > 2 OR regexp_matches(token, '[0-9]'))"
_LINES = "SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM documents"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).withColumn("line", F.btrim("raw", F.lit(" \t\r"))).drop("raw")


@query(f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct
    FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"""SELECT token, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs
    FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) WHERE {_CONTENT} GROUP BY token""")
def content_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_doc = coverage.token_counts(_read(spark, sf_dir, "documents"), ["doc_id"], "text", content=True)
    return by_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts, and what a transcript kept of them: the first four fifths, and a passage that isn't there."""
    docs, bench = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark")
    extra = bench.select(F.col("item_id").alias("item"), F.col("text").alias("extra"))
    kept = F.substring("text", F.lit(1), (F.length("text") * 4 / 5).cast("int"))
    got = docs.join(extra, F.pmod("doc_id", F.lit(40)) == F.col("item"), "left").select("doc_id", F.concat_ws(" ", kept, "extra").alias("text"))
    return docs, got


_PAGES = f"""w AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents),
    h AS (SELECT doc_id, unnest({_TOKENS.format("(substr(d.text, 1, (length(d.text) * 4 / 5)::DOUBLE::INT - CASE WHEN (length(d.text) * 4 / 5)::DOUBLE::INT > length(d.text) * 4 / 5 THEN 1 ELSE 0 END) || ' ' || coalesce(b.text, ''))")}) AS token
          FROM documents d LEFT JOIN benchmark b ON d.doc_id % 40 = b.item_id),
    wn AS (SELECT doc_id, token, count(*) AS n FROM w GROUP BY ALL), hn AS (SELECT doc_id, token, count(*) AS n FROM h GROUP BY ALL)"""


@query(f"""WITH {_PAGES} SELECT d.doc_id, coalesce(sum(wn.n), 0)::BIGINT AS n_reference, coalesce(sum(least(wn.n, coalesce(hn.n, 0))), 0)::BIGINT AS n_hit,
    round(sum(least(wn.n, coalesce(hn.n, 0))) / sum(wn.n), 6)::DOUBLE AS recall
    FROM documents d LEFT JOIN wn USING (doc_id) LEFT JOIN hn ON wn.doc_id = hn.doc_id AND wn.token = hn.token GROUP BY d.doc_id""")
def page_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.page_recall(*_pages(spark, sf_dir), ["doc_id"]).withColumn("recall", F.round("recall", 6))


@query(f"""WITH {_PAGES} SELECT doc_id, token, count(*)::BIGINT AS n FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM h) GROUP BY ALL""")
def recall_missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.missing_tokens(*_pages(spark, sf_dir), ["doc_id"])


_FURNITURE = f"""k AS (SELECT source, doc_id, lower(line) AS key FROM ({_LINES})), n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM k GROUP BY source),
    c AS (SELECT source, key, count(DISTINCT doc_id) AS n FROM k WHERE key <> '' GROUP BY source, key), f AS (SELECT c.* FROM c JOIN n USING (source) WHERE c.n >= greatest(3, 0.05 * pages))"""


def _furniture(rows: DataFrame) -> DataFrame:
    return L.furniture(rows.withColumn("key", F.lower("line")), "source", "doc_id", share=0.05)


@query(f"""WITH {_FURNITURE} SELECT source, key, n::BIGINT AS n FROM f""")
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a document and each of its texts a page."""
    return _furniture(_doc_lines(spark, sf_dir))


@query(f"""WITH {_FURNITURE} SELECT doc_id, count(*)::BIGINT AS n_lines, sum(length(key))::BIGINT AS n_chars FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.source = k.source AND f.key = k.key) GROUP BY doc_id""")
def drop_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_lines(spark, sf_dir)
    left = rows.withColumn("key", F.lower("line")).join(_furniture(rows).select("source", "key"), ["source", "key"], "left_anti")
    return left.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


_ISLANDS = f"""a AS (SELECT doc_id, line_no, line, length(line) >= 80 AS long FROM ({_LINES})), b AS (SELECT *, coalesce(long <> lag(long) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS starts FROM a),
    c AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM b)"""


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_lines(spark, sf_dir).select("doc_id", "line_no", "line", (F.length("line") >= 80).alias("long"))
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line_no")
    return L.islands(rows.withColumn("starts", F.coalesce(F.col("long") != F.lag("long").over(w), F.lit(True))), ["doc_id"], ["line_no"], "starts")


@query(f"""WITH {_ISLANDS} SELECT doc_id, island::BIGINT AS island, min(line_no)::BIGINT AS first_line, count(*)::BIGINT AS n_lines, bool_and(long) AS long FROM c GROUP BY doc_id, island""")
def doc_line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(spark, sf_dir).groupBy("doc_id", "island").agg(F.min("line_no").cast("long").alias("first_line"), F.count("*").alias("n_lines"), F.min("long").alias("long"))


@query(f"""WITH {_ISLANDS} SELECT doc_id, island::BIGINT AS island, md5(string_agg(line, ' ' ORDER BY line_no)) AS text_md5 FROM c GROUP BY doc_id, island""")
def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _islands(spark, sf_dir).groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("r"))
    return got.select("doc_id", "island", F.md5(F.array_join(F.transform("r", lambda x: x["line"]), " ")).alias("text_md5"))


@query("""SELECT key, doc_id FROM (SELECT md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) AS key, doc_id, row_number() OVER (PARTITION BY md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))))
    return L.first_by(_read(spark, sf_dir, "documents").select(key.alias("key"), "doc_id"), ["key"], ["doc_id"])


@query(f"""WITH v AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS token FROM documents), c AS (SELECT conv_id, turn, unnest({_TOKENS.format('text')}) AS token FROM conversations)
    SELECT a.conv_id, a.turn, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_known, 0)::BIGINT AS n_known FROM conversations a
    LEFT JOIN (SELECT conv_id, turn, count(*) AS n_tokens, count(v.token) AS n_known FROM c LEFT JOIN v USING (token) WHERE {_CONTENT} GROUP BY ALL) b ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def vocab_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = _read(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return coverage.vocabulary_share(_read(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", vocabulary)


_EMAIL, _IP = T.EMAIL.replace("'", "''"), r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _read(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    return a.unionByName(_read(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text")))


_TEXTS = "(SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages)"


@query(f"""SELECT origin, id, email, count(*)::BIGINT AS n FROM (SELECT origin, id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS email FROM {_TEXTS}) GROUP BY ALL""")
def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _texts(spark, sf_dir).select("origin", "id", F.explode(F.regexp_extract_all("text", F.lit(T.EMAIL), F.lit(0))).alias("email"))
    return hits.groupBy("origin", "id", "email").agg(F.count("*").alias("n"))


@query(f"""WITH i AS (SELECT origin, id, unnest(regexp_extract_all(text, '{_IP}')) AS ip FROM {_TEXTS}), s AS (SELECT *, string_split(ip, '.')::INT[] AS p, regexp_matches(ip, '(^|\\.)0[0-9]') AS padded FROM i)
    SELECT origin, id, ip, (NOT padded AND list_max(p) <= 255 AND (p[1] IN (0, 10, 127) OR p[1] >= 240 OR (p[1] = 172 AND p[2] BETWEEN 16 AND 31) OR (p[1] = 192 AND p[2] = 168) OR (p[1] = 169 AND p[2] = 254)
    OR (p[1] = 192 AND p[2] = 0 AND p[3] = 2) OR (p[1] = 198 AND p[2] IN (18, 19)) OR (p[1] = 198 AND p[2] = 51 AND p[3] = 100) OR (p[1] = 203 AND p[2] = 0 AND p[3] = 113)
    OR (p[1] = 192 AND p[2] = 0 AND p[3] = 0 AND p[4] NOT IN (9, 10)))) AS private, count(*)::BIGINT AS n FROM s GROUP BY ALL""")
def private_public_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _texts(spark, sf_dir).select("origin", "id", F.explode(F.regexp_extract_all("text", F.lit(T.IPV4), F.lit(0))).alias("ip"))
    return hits.groupBy("origin", "id", "ip").agg(F.count("*").alias("n")).withColumn("private", T.is_private_ip(F.col("ip")))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), '^https?://') AND len(string_split(lower(url), 'http')) = 2 THEN regexp_replace(url, '\\s+', '', 'g') ELSE substr(url, 1, 12) || chr(10) || '  ' || substr(url, 13) END AS url FROM pages""")
def url_join_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.substring("url", 1, 12), F.lit("\n  "), F.expr("substring(url, 13)"))
    return _read(spark, sf_dir, "pages").select("page_id", T.unwrap_url(wrapped).alias("url"))


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^\w.\-]+', '_', 'g'), '._ '), ''), 'document') AS stem FROM pages""")
def safe_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", T.safe_stem(F.col("url")).alias("stem"))


@query("""WITH t AS (SELECT text AS content, 'md' AS ext FROM documents UNION ALL SELECT html, 'html' FROM pages) SELECT sha256(content) AS sha256, 'objects/' || substr(sha256(content), 1, 2) || '/' || substr(sha256(content), 3, 2) || '/' || sha256(content) || '.' || min(ext) AS uri,
    any_value(strlen(content))::BIGINT AS n_bytes FROM t GROUP BY sha256(content)""")
def content_hash_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _read(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("content"), F.lit("md").alias("extension"))
    blobs = texts.unionByName(_read(spark, sf_dir, "pages").select(F.col("html").cast("binary").alias("content"), F.lit(".HTML").alias("extension")))
    return images.store_objects(blobs).select("sha256", "uri", F.length("content").cast("long").alias("n_bytes"))


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'wrong size' WHEN doc_id % 3 = 0 THEN 'checksum mismatch' ELSE 'ok' END AS state FROM documents""")
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    git = T.git_blob_sha1(F.col("text").cast("binary"))
    listed = docs.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.octet_length("text").alias("size"), F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).alias("sha256"), F.when(F.col("doc_id") % 2 == 1, git).alias("git_sha1"))
    there = docs.where("doc_id % 7 <> 0").select(
        F.col("doc_id").cast("string").alias("path"), (F.octet_length("text") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size"),
        F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("sha256"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("0")).otherwise(git).alias("git_sha1"),
    )
    return run.verify_manifest(listed, there)


@query("""SELECT count(*)::BIGINT AS n_files, sum(strlen(text))::BIGINT AS total_bytes FROM documents""")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.manifest_totals(_read(spark, sf_dir, "documents").select(F.octet_length("text").cast("long").alias("size")))
