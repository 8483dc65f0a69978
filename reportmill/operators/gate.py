"""Screening of input files: what their bytes are, malware rules over scan targets, and the verdict.

Scan targets are rows (document_id, label, kind, data); kind is raw, pdfobj, pdfstream, ooxml-part or embedded.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdicts from harmless to worst.
VERDICTS = ["CLEAN", "TEST_SIGNATURE_DETECTED", "SUSPICIOUS", "MALICIOUS"]
BLOCK_ON = ("MALICIOUS", "SUSPICIOUS")
MAX_SCAN_BYTES = 256 << 20
MAX_STREAM_BYTES = 512 << 20
MAX_MEMBERS, MAX_TOTAL, MAX_RATIO, RATIO_FROM = 5000, 512 << 20, 200, 10 << 20
# First bytes (hex) and the type that they show, in the order in which they are tried.
MAGIC = [
    ("4D5A", "application/x-msdownload"), ("7F454C46", "application/x-executable"), ("CAFEBABE", "application/x-mach-binary"), ("CFFAEDFE", "application/x-mach-binary"),
    ("2321", "text/x-shellscript"), ("255044462D", "application/pdf"), ("D0CF11E0A1B11AE1", "application/x-ole-storage"), ("504B0304", "application/zip"),
    ("526172211A07", "application/x-rar-compressed"), ("377ABCAF271C", "application/x-7z-compressed"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("424D", "image/bmp"), ("01000000", "image/emf"), ("D7CDC69A", "image/wmf"),
]
# Types and extensions by danger.
SAFE = ["image/png", "image/jpeg", "image/gif", "image/tiff", "image/bmp", "image/emf", "image/wmf", "text/plain", "application/xml", "application/json"]
DANGEROUS = ["application/x-msdownload", "application/x-executable", "application/x-mach-binary", "text/x-shellscript"]
DANGEROUS_EXTENSIONS = [".exe", ".dll", ".scr", ".bat", ".cmd", ".ps1", ".vbs", ".js", ".hta"]
# Relationship types that load remote content on open.
REMOTE_RELATIONS = ["attachedtemplate", "oleobject", "frame", "subdocument", "afchunk", "externallinkpath", "package"]

_OLE = r"(?s)^\xD0\xCF\x11\xE0\xA1\xB1\x1A\xE1"


def _hex_name(name: str) -> str:
    """A PDF name of which any letter may be written as #xx."""
    return "/" + "".join(f"(?:{ch}|#{ord(ch) >> 4:x}{_nibble(ord(ch) & 15)})" for ch in name)


def _nibble(n: int) -> str:
    return str(n) if n < 10 else f"[{chr(87 + n)}{chr(55 + n)}]"


def _wide(name: str) -> str:
    return "".join(f"{ch}\\x00" for ch in name)


_JS = rf"/(?:J|#4[aA])(?:{_hex_name('avaScript')[1:]}|(?:S|#53))\b"
#: (name, verdict, kinds or none for all, patterns that must all be found). Patterns run over bytes as Latin-1.
RULES: list[tuple[str, str, tuple[str, ...], list[str]]] = [
    ("PDF_Launch_Action", "MALICIOUS", ("pdfobj",), [_hex_name("Launch") + r"\b"]),
    ("PDF_AutoRun_JavaScript", "MALICIOUS", ("pdfobj",), [_JS, rf"{_hex_name('OpenAction')}|{_hex_name('AA')}\s*<<"]),
    ("PDF_JavaScript", "SUSPICIOUS", ("pdfobj",), [_JS]),
    ("PDF_Rich_Media_Or_XFA", "SUSPICIOUS", ("pdfobj",), ["/RichMedia|/XFA"]),
    ("Office_VBA_Project", "SUSPICIOUS", ("ooxml-part", "embedded"), [_OLE, rf"_VBA_PROJECT|{_wide('_VBA_PROJECT')}|(?i:Attribute VB_Name)|VBAProject"]),
    ("Office_AutoExec_Macro", "MALICIOUS", ("ooxml-part", "embedded"), [_OLE, "(?i)Attribute VB_", "(?i)AutoOpen|Document_Open|Workbook_Open|AutoExec"]),
    ("Office_DDE_Field", "MALICIOUS", ("ooxml-part",), [r'(?i)instrText[^>]*>\s*DDE(?:AUTO)?\b|fldSimple[^>]+instr="\s*DDE(?:AUTO)?\b']),
    ("Executable_Payload", "MALICIOUS", (), [r"(?s)^(?:MZ.{62,1022}PE\x00\x00|\x7FELF)"]),
    ("Script_Dropper_Strings", "SUSPICIOUS", ("embedded",), [r"(?i)powershell -e|powershell\.exe -enc|WScript\.Shell|cmd\.exe /c|mshta |certutil -decode"]),
    ("EICAR_Test_File", "TEST_SIGNATURE_DETECTED", (), [r"X5O!P%@AP\[4\\PZX54\(P\^\)7CC\)7\}\$", r"EICAR-STANDARD-ANTIVIRUS-TEST-FILE!\$H\+H\*"]),
]


def sniff(data: Column) -> Column:
    """A type by first bytes, then by the first character, else plain text if it is UTF-8."""
    case = reduce(lambda k, m: k.when(F.startswith(data, F.unhex(F.lit(m[0]))), F.lit(m[1])), MAGIC[1:], F.when(F.startswith(data, F.unhex(F.lit(MAGIC[0][0]))), F.lit(MAGIC[0][1])))
    head = F.regexp_replace(F.decode(F.substring(data, 1, 512), "ISO-8859-1"), r"^[ \t\n\r\x0B\x0C]+", "")
    # A cut inside a character at byte 4096 is no plain text, as with any other broken one.
    rest = F.when(F.startswith(head, F.lit("<")), "application/xml").when(head.rlike(r"^[{\[]"), "application/json").when(F.is_valid_utf8(F.substring(data, 1, 4096).cast("string")), "text/plain")
    return case.otherwise(rest.otherwise(F.lit("application/octet-stream")))


def embedded_verdict(mime: Column, name: Column) -> Column:
    extension = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/.](\.[^./]*)$", 1))
    return F.when(mime.isin(DANGEROUS) | extension.isin(DANGEROUS_EXTENSIONS), "DANGEROUS").when(mime.isin(SAFE), "SAFE").otherwise("UNKNOWN")


def text_recommendation(data: Column) -> Column:
    """PASS for a text file that really is one."""
    mime = sniff(data)
    return F.when((mime == "text/plain") & (embedded_verdict(mime, F.lit("")) != "DANGEROUS"), "PASS").otherwise("BLOCK")


def rule_matches(targets: DataFrame) -> DataFrame:
    """(document_id, rule, verdict, label) of every rule that a target shows; once for each rule and label.

    Each rule is a predicate over the bytes, tested in one pass over the targets.
    """
    text = F.decode("data", "ISO-8859-1")

    def test(rule) -> Column:
        name, verdict, kinds, patterns = rule
        hit = reduce(lambda a, b: a & b, [F.col("bytes").rlike(p) for p in patterns])
        if kinds:
            hit = F.col("kind").isin(*kinds) & hit
        return F.when(hit, F.struct(F.lit(name).alias("rule"), F.lit(verdict).alias("verdict")))

    got = targets.withColumn("bytes", text).select("document_id", "label", F.explode(F.array_compact(F.array(*map(test, RULES)))).alias("m"))
    return got.select("document_id", "m.rule", "m.verdict", "label").distinct()


def rank(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, VERDICTS)), verdict)


def worst(verdict: Column) -> Column:
    """Aggregate: the worst verdict, CLEAN of none."""
    return F.element_at(F.array(*map(F.lit, VERDICTS)), F.greatest(F.coalesce(F.max(rank(verdict)), F.lit(1)), F.lit(1)).cast("int"))


def verdicts(documents: DataFrame, matches: DataFrame, checks: DataFrame) -> DataFrame:
    """(document_id, verdict, blocked): the worst of a document's rule matches and checks (document_id, verdict)."""
    found = matches.select("document_id", "verdict").unionByName(checks.select("document_id", "verdict"))
    got = documents.select("document_id").join(found, "document_id", "left").groupBy("document_id").agg(worst(F.col("verdict")).alias("verdict"))
    return got.withColumn("blocked", F.col("verdict").isin(*BLOCK_ON))


def file_checks(files: DataFrame, path: str = "path", id_column: str = "document_id") -> DataFrame:
    """(document_id, check, verdict, detail) by size and header alone; sizes are tested before contents are read."""
    big = F.col("length") > MAX_SCAN_BYTES
    fake = F.lower(path).endswith(".pdf") & ~F.contains(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), F.lit("%PDF-"))
    check = F.when(big, F.struct(F.lit("size").alias("check"), F.lit("SUSPICIOUS").alias("verdict"), F.format_string(f"%d bytes exceeds the {MAX_SCAN_BYTES}-byte scan limit", "length").alias("detail"))).when(
        fake, F.struct(F.lit("file_type").alias("check"), F.lit("SUSPICIOUS").alias("verdict"), F.lit(".pdf file does not contain a PDF header").alias("detail"))
    )
    return files.select(id_column, check.alias("c")).where("c is not null").select(id_column, "c.*")


def attachment_checks(targets: DataFrame) -> DataFrame:
    """(document_id, check, verdict, detail) of embedded files, by their bytes and names."""
    name = F.regexp_replace("label", r"^(?:embedded|annotation|member):", "")
    mime = sniff(F.col("data"))
    rows = targets.where("kind = 'embedded'").select("document_id", name.alias("name"), mime.alias("mime"))
    danger = embedded_verdict(F.col("mime"), F.col("name"))
    verdict = F.when(danger == "DANGEROUS", "MALICIOUS").when(danger == "SAFE", "CLEAN").otherwise("SUSPICIOUS")
    return rows.select("document_id", F.lit("attachment").alias("check"), verdict.alias("verdict"), F.format_string("%s (%s)", "name", "mime").alias("detail"))


def within_budget(streams: DataFrame, order: str = "xref", budget: int = MAX_STREAM_BYTES) -> DataFrame:
    """Streams of a document in order, up to the byte budget; with ``over`` on those beyond it."""
    from pyspark.sql import Window

    running = F.sum(F.length("data")).over(Window.partitionBy("document_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return streams.withColumn("over", running > budget)


def archive_members(files: DataFrame) -> DataFrame:
    """(document_id, name, file_size, compress_size, data, error) of ZIP archives (document_id, content), a row per member; one row with ``error`` and no data for an archive that can't be read
    within the limits. Each archive is opened where its bytes are."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document_id, content in zip(batch["document_id"], batch["content"]):
                rows = []
                try:
                    if not zipfile.is_zipfile(io.BytesIO(content)):
                        raise zipfile.BadZipFile("Not a valid OOXML (zip) container")
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        listed = z.infolist()
                        total = sum(m.file_size for m in listed)
                        if len(listed) > MAX_MEMBERS:
                            raise zipfile.BadZipFile(f"{len(listed)} archive members (limit {MAX_MEMBERS})")
                        if total > MAX_TOTAL:
                            raise zipfile.BadZipFile(f"{total} bytes uncompressed (limit {MAX_TOTAL})")
                        for m in listed:
                            if m.file_size > RATIO_FROM and m.compress_size and m.file_size / m.compress_size > MAX_RATIO:
                                raise zipfile.BadZipFile(f"{m.filename} decompresses {m.file_size // m.compress_size}x")
                            rows.append((document_id, m.filename, m.file_size, m.compress_size, z.read(m), None))
                except Exception as problem:  # whatever is wrong with an archive, it is not safe
                    rows = [(document_id, None, None, None, None, str(problem))]
                yield pd.DataFrame(rows, columns=["document_id", "name", "file_size", "compress_size", "data", "error"]).astype({"file_size": "Int64", "compress_size": "Int64"})

    return files.select("document_id", "content").mapInPandas(work, "document_id string, name string, file_size long, compress_size long, data binary, error string")


def remote_targets(xml: Column) -> Column:
    """Targets of external relationships that load content on open."""
    elements = F.regexp_extract_all(xml, F.lit(r"(?i)<(?:[\w.-]+:)?Relationship\b[^>]*>"), F.lit(0))

    def attribute(e: Column, name: str) -> Column:
        return F.regexp_extract(e, rf"""(?is)\b(?:[\w.-]+:)?{name}\s*=\s*(["'])(.*?)\1""", 2)

    kind = lambda e: F.lower(F.regexp_extract(attribute(e, "Type"), r"([^/]*)/*$", 1))
    risky = F.filter(elements, lambda e: (F.lower(F.trim(attribute(e, "TargetMode"))) == "external") & kind(e).isin(REMOTE_RELATIONS))
    return F.transform(risky, lambda e: F.when(e.rlike(r"(?i)\bTarget\s*="), attribute(e, "Target")).otherwise("?"))


def inspect_archives(members: DataFrame) -> DataFrame:
    """(document_id, macro_verdict, external_ref, n_external, n_embedded, n_dangerous, recommendation, verdict) of archives by their members."""
    low = F.lower("name")
    inside = F.contains(low, F.lit("/embeddings/")) | F.startswith(low, F.lit("word/activex/"))
    rows = members.select(
        "document_id", F.col("error").isNotNull().alias("broken"), F.endswith(low, F.lit("vbaproject.bin")).alias("macro"),
        F.when(F.endswith(low, F.lit(".rels")), F.size(remote_targets(F.decode("data", "ISO-8859-1")))).alias("external"), inside.alias("inside"),
        (inside & (embedded_verdict(sniff(F.col("data")), F.col("name")) == "DANGEROUS")).alias("danger"),
    )
    n = lambda x: F.coalesce(F.sum(F.col(x).cast("int")), F.lit(0)).cast("long")
    got = rows.groupBy("document_id").agg(F.max("broken").alias("broken"), n("macro").alias("macros"), n("external").alias("n_external"), n("inside").alias("n_embedded"), n("danger").alias("n_dangerous"))
    block = F.col("broken") | (F.col("macros") > 0) | (F.col("n_external") > 0) | (F.col("n_dangerous") > 0)
    verdict = F.when(F.col("n_dangerous") > 0, "MALICIOUS").when(block, "SUSPICIOUS").otherwise("CLEAN")
    return got.select(
        "document_id", F.when(F.col("macros") > 0, "PRESENT").otherwise("NONE").alias("macro_verdict"), F.when(F.col("n_external") > 0, "FOUND").otherwise("NONE").alias("external_ref"),
        "n_external", "n_embedded", "n_dangerous", F.when(block, "BLOCK").when(F.col("n_embedded") > 0, "SANITIZE").otherwise("PASS").alias("recommendation"), verdict.alias("verdict"),
    )


def archive_targets(members: DataFrame) -> DataFrame:
    """Members as scan targets."""
    kind = F.when(F.contains(F.lower("name"), F.lit("/embeddings/")), "embedded").otherwise("ooxml-part")
    return members.where("error is null").select("document_id", F.concat(F.lit("member:"), "name").alias("label"), kind.alias("kind"), "data")
