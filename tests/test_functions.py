"""Column functions by table: given values and what must come out."""

import datetime

import pytest
from pyspark.sql import functions as F

from reportmill.functions import dates as D
from reportmill.functions import text as T


def run(spark, given, f, kind="string"):
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], f"i int, c {kind}").select("i", f(F.col("c")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def check(spark, cases, f):
    assert run(spark, [a for a, _ in cases], f) == [b for _, b in cases]


def test_clean_value(spark):
    check(spark, [("  NA ", "NA"), (" - ", None), ("a\n  b", "a b"), ("N/A", "N/A"), ("n/a.", None), ("Nil", None), ("•: x :", "x"), ("a&#124;b", "a|b"), ("a  b", "a b"), (None, None)], T.clean_value)


def test_serial(spark):
    check(spark, [("3", 3), ("3.", 3), (" 12 . ", None), (" 12. ", 12), ("S. No", None), ("12345", None), ("", None), (None, None)], T.serial)


def test_label_key(spark):
    check(spark, [(" Report  ID: ", "report id"), ("• Prepared By -", "prepared by")], T.label_key)


def test_unwrap_url(spark):
    check(spark, [("https://host- name.test/pa th?x=1", "https://host-name.test/path?x=1"), ("see https://a b", "see https://a b"), ("http://a http://b c", "http://a http://b c"), (" x ", "x")], T.unwrap_url)


def test_a_url_is_cleaned_once(spark):
    assert str(T.clean_piece(F.col("x"))).count("IMAGE") == 1  # not once for each use of the cleaned text
    cases = {"- HTTPS://a.example/ b ": "HTTPS://a.example/b", "http://a http://b": "http://a http://b", "## x  y": "x  y", "ftp://a b": "ftp://a b", None: None, "": ""}
    got = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string").select("i", T.clean_piece(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [*cases.values()]


def test_compact(spark):
    got = spark.createDataFrame([(["a", "", "a", "b", " b ", "", "a"],), ([],)], "c array<string>").select(T.compact(F.col("c")).alias("r")).collect()
    assert [r.r for r in got] == [["a", "b", "a"], []]


def test_prose(spark):
    text = "<!-- PAGE_START: 1 -->\n## Page 1\nFirst line\nwraps here\n•\nbullet one\n• two\nCONFIDENTIAL\n| a | b |\n[IMAGE_PAGE_1_FIG_1]\niv.\nPage 2 of 3"
    check(spark, [(text, "First line wraps here\n• bullet one\n• two"), ("  one\n value :", "one value"), ("", None), ("-", None), (None, None), ("internal", "internal"), ("INTERNAL USE ONLY", None)], T.prose)


def test_tokens(spark):
    check(spark, [("Über CVE-2024-1 a.b@c.d  x", ["ber", "cve-2024-1", "a.b@c.d", "x"]), (None, []), ("--a--", ["a"])], T.tokens)
    check(spark, [("the cat is on a 7 mat ab", ["cat", "7", "mat"])], T.content_tokens)
    check(spark, [("ﬁne ①", "fine 1"), ("plain", "plain")], T.normalize_forms)


def test_picks(spark):
    check(spark, [("Low to High", "High"), ("info only", "Informational"), ("moderate", "Medium"), ("Severe", "Severe"), ("", None), (None, None), ("highest", "highest")], T.severity)
    check(spark, [("Reopened", "Reopened"), ("not fixed", "Closed"), ("partially remediated", "Partially Remediated"), ("OPEN", "Open"), ("partial fix", "Partially Remediated")], T.status)
    check(spark, [("recurring", "Repeat"), ("New one", "New"), ("repeated", "Repeat")], T.new_or_repeat)
    check(spark, [("licensed", "Licensed"), ("Open-Source", "Open Source"), ("Freeware", "Freeware"), (None, None)], T.license_type)


def test_identifiers(spark):
    check(spark, [("cve-2024-1234, CVE-2021-44228 CVE-2024-1234 CVE-1-2", ["CVE-2021-44228", "CVE-2024-1234"]), (None, [])], T.cves)
    check(spark, [("CWE-79: Cross\n site • cwe-79 • CWE-20 Affected x", ["CWE-79: Cross site", "cwe-79", "CWE-20"]), ("CWE-1 CWE-1", ["CWE-1"])], T.cwes)
    check(spark, [("a\n• b\n• NA\n", ["a", "b"]), (None, [])], T.items)


def test_private_ip(spark):
    import ipaddress

    given = ["10.0.0.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "8.8.8.8", "127.0.0.1", "169.254.1.1", "0.0.0.0", "240.0.0.1", "255.255.255.255", "192.0.2.9", "198.18.0.1", "198.20.0.1", "198.51.100.3", "203.0.113.7", "192.0.0.9", "192.0.0.8", "100.64.0.1", "300.1.1.1", "10.01.1.1"]

    def expected(ip):
        try:
            return ipaddress.ip_address(ip).is_private
        except ValueError:
            return False

    assert run(spark, given, T.is_private_ip) == [expected(x) for x in given]


def test_json_object(spark):
    shown = lambda c: F.to_json(T.json_object(c))
    check(spark, [('```json\n{"a": 1}\n```', '{"a":1}'), ('Sure: {"b": {"c": 2}} ok', '{"b":{"c":2}}'), ("[1]", None), ("no", None), (None, None)], shown)


def test_files(spark):
    check(spark, [("my report (1)", "my_report_1"), ("..", "document"), ("Ünï", "Ünï"), ("a.b-c_", "a.b-c")], T.safe_stem)


DATES = [
    ("16.02.2026", "2026-02-16"), ("29/05/2025", "2025-05-29"), ("16th February 2026", "2026-02-16"), ("05th September 2025", "2025-09-05"), ("9-May-24", "2024-05-09"), ("May 5, 2024", "2024-05-05"), ("2025-03-21", "2025-03-21"),
    ("12/31/2025", "2025-12-31"), ("v1.0", None), ("11.80.1", None), ("2026.1", None), ("NA", None), ("", None), (None, None), ("on 1 Jan 2024 and 02.02.2024", "2024-01-01"), ("30.02.2024", None), ("x 30.02.2024, 1.3.24", "2024-03-01"),
    ("Maybe 5, 2024", "2024-05-05"), ("Report of 2024.13.45 or 3 Foo 2024", None), ("13/13/2024", None), ("29.02.2023", None), ("29.02.2024", "2024-02-29"),
]


def test_parse_date(spark):
    check(spark, DATES, D.parse_date)


def test_every_day_in_every_style(spark):
    from reportmill.sources.render import date_in_style

    first = datetime.date(2023, 12, 1)
    df = spark.range(500).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("d")).crossJoin(spark.range(4).withColumnRenamed("id", "s"))
    text = date_in_style(F.col("d"), F.col("s"))
    got = df.select(F.date_format("d", "yyyy-MM-dd").alias("iso"), D.parse_date(F.concat(F.lit("from "), text)).alias("a"), D.whole_date(text).alias("b"), F.get(D.find_dates(F.concat(text, F.lit("; "), text)), F.lit(1)).alias("c"))
    assert got.where("iso <> a or iso <> b or iso <> c or a is null or b is null or c is null").count() == 0


def test_date_field_and_whole_date(spark):
    check(spark, [("Q3 of FY26", "Q3 of FY26"), ("-", None), (" 16.02.2026 ", "2026-02-16"), ("due 16.02.2026", "2026-02-16")], D.date_field)
    check(spark, [("16.02.2026", "2026-02-16"), ("after 3 Jan 2025", None), ("2025-02-30", None), (" 2025-02-28 ", "2025-02-28"), ("May 5, 2024", "2024-05-05"), ("12/31/2025", "2025-12-31"), ("5 May 24", "2024-05-05"), ("x", None)], D.whole_date)


def test_normalize_dates(spark):
    check(spark, [("from 01.02.2024 to 3rd May 2024!", "from 2024-02-01 to 2024-05-03!"), ("no date", "no date"), ("31.31.2020", "31.31.2020")], D.normalize_dates)


@pytest.mark.parametrize("n", [0, 3])
def test_git_blob(spark, n):
    import hashlib

    data = b"x" * n
    got = spark.createDataFrame([(bytearray(data),)], "c binary").select(T.git_blob_sha1(F.col("c")).alias("r")).collect()[0].r
    assert got == hashlib.sha1(b"blob %d\0" % n + data).hexdigest()
