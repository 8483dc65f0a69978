import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reportmill.llm import _common as c
from reportmill.llm import _files as files
from reportmill.llm import warc

BIG = "<p>" + "é text " * 40
ROWS = [
    (5, "http://www.Example.org:80/b?q=1", BIG), (3, "https://a.example.org/x", BIG), (9, None, BIG), (9, None, BIG),
    (1, "http://example.org/small", "tiny"), (2, "http://example.org/small", "tiny"), (4, "", None), (6, "no url at all\r\nX: y", ""),
    (None, "http://z.net/", BIG), (None, None, None), (7, "http://z.net:8080/p?" + "x" * 3000, "L" * 300_000), (8, "http://z.net", "L" * 300_000),
    (0, "ftp://user@host.example/", "x" * 99), (10, "ftp://user@host.example/", "x" * 99), (11, "http://u/", "x" * 100), (12, "http://u/", "x" * 100),
]


def pages(spark, rows=ROWS, clashes=False):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", *[F.lit(1).alias(x) for x in ("key", "digest", "n", "path", "offset", "refers_to", "sized")]) if clashes else df


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page_id is not None:
            first[body] = min(page_id, first.get(body, page_id))
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        ref = first.get(body)
        ref = None if ref == page_id else ref
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "response" if ref is None else "revisit", ref))
    return Counter(out)


@pytest.mark.parametrize("clashes", [False, True])
def test_round_trip(spark, clashes):
    folder = c.scratch(spark, "warc")
    index = warc.write_index(warc.write_archives(pages(spark, clashes=clashes), folder), folder, block_lines=3, index_files=3)
    got = warc.read_all(index).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(ROWS)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    looked_up = warc.lookup(index, pages(spark, clashes=clashes)).collect()
    assert Counter(map(str, looked_up)) == Counter(map(str, got))


def test_many_copies_of_one_payload(spark):
    """One payload of most pages, and many without any, in as many records."""
    rows = [(i, f"http://h{i % 7}.example/{i % 50}", BIG if i % 3 else "small") for i in range(4000)]
    folder = c.scratch(spark, "warc")
    index = warc.write_index(warc.write_archives(pages(spark, rows), folder), folder, block_lines=64)
    got = warc.lookup(index, pages(spark, rows)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)


def test_lookup_and_order(spark):
    folder = c.scratch(spark, "warc")
    index = warc.write_index(warc.write_archives(pages(spark), folder), folder, block_lines=2, index_files=3)
    got = warc.lookup(index, spark.createDataFrame([("http://example.org/small",), ("http://EXAMPLE.org/b?q=1",), ("http://absent.org/",)], "url string")).collect()
    assert sorted(r.page_id for r in got) == [1, 2, 5]
    keys = []
    for row in sorted(index.collect(), key=lambda r: r.first_key):
        reader = warc.IndexReader(row.path, files.RangeReader())
        assert reader.lines == row.lines
        keys += [x[0] for n in range(len(reader.blocks)) for x in reader.block(n)]
    assert [k.encode() for k in keys] == sorted(k.encode() for k in keys) and len(keys) == len(ROWS)


def test_keys(spark):
    urls = ["http://www.Example.org:80/b?Q=1", "https://a.b.co.uk", "http://h:8080?x", "odd thing", None, "http://u@h.net/#f"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i long, url string").select("i", warc.reversed_host_key(F.col("url")).alias("k"))
    assert [r.k for r in df.orderBy("i").collect()] == ["org,example)/b?Q=1", "uk,co,b,a)/", "h:8080)/?x", "odd%20thing", "", "net,h)/#f"]


def test_records_are_gzip_members_of_their_own():
    data = [warc.record_bytes(i, f"http://x/{i}", b"body %d" % i, hashlib.sha256(b"body %d" % i).hexdigest(), None, "1970-01-01T00:00:00Z") for i in range(3)]
    assert gzip.decompress(b"".join(data)).count(b"WARC/1.1\r\n") == 3
    assert warc.parse_record(data[1])[:4] == (1, "http://x/1", b"body 1", 6)
    bad = warc.record_bytes(1, "u", b"body", "00", None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse_record(bad)


def test_empty_table(spark):
    folder = c.scratch(spark, "warc")
    assert warc.read_all(warc.write_index(warc.write_archives(pages(spark, []), folder), folder)).count() == 0
    assert warc.lookup(warc.write_index(warc.write_archives(pages(spark, []), folder), folder), pages(spark)).count() == 0
