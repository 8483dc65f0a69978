"""WARC archives with a two-level capture index.

Writing: records of equal payload (by SHA-256, from ``least_dedup`` bytes on) are one response, that of the smallest ``page_id``, and revisits that
refer to it; the smallest ids come from a map-side combined minimum over digests alone, so a page with very many copies is
no hot spot. Each task streams one archive; a record is a gzip member of its own, so a byte range of the archive is a record.

Index: lines of (key, page_id, archive, offset, length), where the key is the URL with its host reversed, go to key ranges and are sorted;
each task writes one index file of compressed blocks of ``block_lines`` lines, behind them the sparse directory with each block's first key and place, and a footer.
A lookup sorts its keys; each task picks index files by binary search in the list of files, finds the block by binary search in the directory, reads that byte range, and then the record's.

Only lists of files (a row per file, written as a table) leave the tasks, and only tasks read them; files of lost attempts are never listed. The number of files follows
the size of the pages, so a file, and what a task holds of it, stays as it is when the data grow.

Rows: null html is empty; a null or odd URL has the key that is left of it, at least empty; rows that share the smallest ``page_id`` of a payload are all responses; a null ``page_id`` ranks behind all others;
repeated rows are records of their own; other columns are not read; an empty table makes no file.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.llm import _common as c
from reportmill.llm import _files as files

MAGIC = b"RMCAPIX1"
_FOOTER = struct.Struct("<QQQ8s")
LINE = "key string, page_id long, path string, offset long, length long"
DIRECTORY = "path string, lines long, first_key string, last_key string"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def reversed_host_key(url: Column) -> Column:
    """``http://www.a.example.org:80/x?y`` is ``org,example,a)/x?y``: host reversed, lower-cased, without www; sorted, a site's
    pages stand together. White space and control characters are escaped."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")
    host = F.lower(F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    port = F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*(:\d+)", 1)
    port = F.when(port.isin(":80", ":443"), "").otherwise(port)
    back = F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\d*\.", ""), r"\.")), ",")
    path = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host == "", clean).otherwise(F.concat(back, port, F.lit(")"), path))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    inner = name[len("<urn:page:") : -1]
    return None if inner == "null" else int(inner)


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, compressed by itself. A revisit keeps the response's HTTP headers and leaves its payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse_record(data: bytes) -> tuple:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to); payload is null for a revisit."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    said = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(said["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    digest, kind = said["WARC-Payload-Digest"].removeprefix("sha256:"), said["WARC-Type"]
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record of {said['WARC-Record-ID']} is damaged")
        return _page(said["WARC-Record-ID"]), said["WARC-Target-URI"], payload, size, digest, kind, None
    return _page(said["WARC-Record-ID"]), said["WARC-Target-URI"], None, size, digest, kind, _page(said["WARC-Refers-To"])


def write_archives(pages: DataFrame, path: str, least_dedup: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes archives under ``path``; returns the capture lines (``LINE``)."""
    html = F.coalesce("html", F.lit(""))
    digest = F.sha2(html, 256)
    sized = F.octet_length(html) >= least_dedup
    groups = pages.where(sized).groupBy(digest.alias("met")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = c.cut(groups, "payloads")
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%20").alias("url"), reversed_host_key(F.col("url")).alias("key"), html.alias("html"), digest.alias("digest"), F.when(sized, digest).alias("met"))
    # Payloads too small to share have no key, and one that very many pages share has many: both are dealt to many tasks.
    shared = groups.agg(F.sum("n")).first()[0] or 0
    met = c.salted_join(rows, groups.select("met", "first"), "met", shared, "left", counts=groups)
    met = met.select("page_id", "url", "key", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        stream, at = None, 0
        for batch in batches:
            lines = []
            for page_id, url, key, text, said, refers_to in zip(*(x.to_pylist() for x in batch.columns)):
                if stream is None:
                    store, folder = files.open_store(path)
                    store.create_dir(folder, recursive=True)
                    name = files.attempt_name("pages", ".warc.gz")
                    stream = store.open_output_stream(f"{folder}/{name}", compression=None)
                data = record_bytes(page_id, url, text.encode("utf-8", "surrogatepass"), said, refers_to, date)
                stream.write(data)
                lines.append((key, page_id, f"{path}/{name}", at, len(data)))
                at += len(data)
            if lines:
                yield [*zip(*lines)]
        if stream is not None:
            stream.close()

    return c.cut(c.map_batches(met, write, LINE), "captures")


class IndexReader:
    """One index file: its footer and sparse directory, then blocks on demand."""

    def __init__(self, path: str, reader: files.RangeReader):
        self.path, self.reader, self.unzip = path, reader, zstandard.ZstdDecompressor()
        size = reader.size(path)
        at, length, self.lines, magic = _FOOTER.unpack(reader.read(path, size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no capture index")
        self.blocks = json.loads(self.unzip.decompress(reader.read(path, at, length)))
        self.firsts = [b[0].encode("utf-8", "surrogatepass") for b in self.blocks]
        self.held: tuple[int, list] = (-1, [])

    def block(self, n: int) -> list[list]:
        """The lines of a block; the last one read is kept, as sorted keys ask for it again."""
        if self.held[0] != n:
            _, at, length = self.blocks[n]
            self.held = n, json.loads(self.unzip.decompress(self.reader.read(self.path, at, length)))
        return self.held[1]

    def find(self, key: str) -> list[list]:
        """Lines of one key, from the one or few blocks that can hold it."""
        want, found = key.encode("utf-8", "surrogatepass"), []
        n = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while n < len(self.blocks) and self.firsts[n] <= want:
            lines = self.block(n)
            i = bisect.bisect_left(lines, want, key=lambda x: x[0].encode("utf-8", "surrogatepass"))
            while i < len(lines) and lines[i][0] == key:
                found.append(lines[i])
                i += 1
            n += 1
        return found


def _footer(at: int, length: int, lines: int) -> bytes:
    return _FOOTER.pack(at, length, lines, MAGIC)


def write_index(captures: DataFrame, path: str, block_lines: int = 1024, index_files: int | None = None, file_bytes: int = 64 << 20) -> DataFrame:
    """Sorts capture lines into index files under ``path``; returns the list of files (``DIRECTORY``)."""
    n = index_files or c.file_count(captures, file_bytes)
    names = [x.split()[0] for x in LINE.split(", ")]
    order = ["key", F.col("page_id").asc_nulls_last(), "path", "offset"]
    ranged = captures.select(*names).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        stream, at, lines, directory, held, low, high = None, 0, 0, [], [], None, None
        pack = zstandard.ZstdCompressor(level=3)

        def flush() -> None:
            nonlocal at, lines, held
            data = pack.compress(json.dumps(held, separators=(",", ":")).encode("utf-8", "surrogatepass"))
            stream.write(data)
            directory.append((held[0][0], at, len(data)))
            at, lines, held = at + len(data), lines + len(held), []

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                if stream is None:
                    store, folder = files.open_store(path)
                    store.create_dir(folder, recursive=True)
                    name = files.attempt_name("index", ".cap")
                    stream = store.open_output_stream(f"{folder}/{name}", compression=None)
                    low = row[0]
                held.append(row)
                high = row[0]
                if len(held) >= block_lines:
                    flush()
        if stream is not None:
            if held:
                flush()
            data = pack.compress(json.dumps(directory, separators=(",", ":")).encode("utf-8", "surrogatepass"))
            stream.write(data + _footer(at, len(data), lines))
            stream.close()
            yield [[f"{path}/{name}"], [lines], [low], [high]]

    return c.cut(c.map_batches(ranged, write, DIRECTORY), "index-list")


def _read_records(lines: DataFrame) -> DataFrame:
    """The records of capture lines; each archive's in order of offset."""
    sorted_lines = lines.select("path", "offset", "length").repartition(c.part_count(lines.sparkSession), "path", F.floor(F.col("offset") / (64 << 20))).sortWithinPartitions("path", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        reader = files.RangeReader()
        for batch in batches:
            rows, held = [], 0
            for path, offset, length in zip(*(x.to_pylist() for x in batch.columns)):
                rows.append(parse_record(reader.read(path, offset, length)))
                held += rows[-1][3]
                if held > 16 << 20:
                    yield [*zip(*rows)]
                    rows, held = [], 0
            if rows:
                yield [*zip(*rows)]
        reader.close()

    return c.map_batches(sorted_lines, read, RECORD)


def read_all(index_list: DataFrame) -> DataFrame:
    """Every record that the index lists: block by block, then by the records' byte ranges."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        reader = files.RangeReader()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                index = IndexReader(path, reader)
                for n in range(len(index.blocks)):
                    yield [*zip(*index.block(n))]
        reader.close()

    listed = index_list.select("path").repartition(c.part_count(index_list.sparkSession), "path")
    return _read_records(c.map_batches(listed, read, LINE))


class Root:
    """The list of index files, as a task reads it."""

    def __init__(self, listed: list[str], reader: files.RangeReader):
        rows = sorted((x["first_key"].encode("utf-8", "surrogatepass"), x["last_key"].encode("utf-8", "surrogatepass"), x["path"]) for f in listed for x in files.read_table(f).to_pylist())
        self.lasts, self.rows, self.reader, self.open = [x[1] for x in rows], rows, reader, (None, None)

    def find(self, key: str) -> list[list]:
        """Lines of one key, from the one or few files that can hold it."""
        want, found = key.encode("utf-8", "surrogatepass"), []
        n = bisect.bisect_left(self.lasts, want)
        while n < len(self.rows) and self.rows[n][0] <= want:
            path = self.rows[n][2]
            if self.open[0] != path:
                self.open = path, IndexReader(path, self.reader)
            found += self.open[1].find(key)
            n += 1
        return found


def lookup(index_list: DataFrame, urls: DataFrame) -> DataFrame:
    """The records of the URLs in ``urls`` (a column url), by binary search in the list of files, the sparse directories and the blocks.

    ``index_list`` is what ``write_index`` returns. Keys are sorted first, so a task reads neighbouring blocks, each once."""
    wanted = urls.select(reversed_host_key(F.col("url")).alias("key")).distinct()
    wanted = wanted.repartitionByRange(c.file_count(wanted, 64 << 20), "key").sortWithinPartitions("key")
    listed = c.table_files(index_list)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        reader, root = files.RangeReader(), None
        for batch in batches:
            root = root or Root(listed, reader)
            found = [x for key in batch.column(0).to_pylist() for x in root.find(key)]
            if found:
                yield [*zip(*found)]
        reader.close()

    return _read_records(c.map_batches(wanted, find, LINE))
