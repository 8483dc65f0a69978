"""Column functions for cell, line and token text. All are built-in expressions, so they stay in the JVM.

Patterns carry ``(?U)`` where white space, digits and word characters beyond ASCII count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that stand for "nothing", in lower case.
PLACEHOLDERS = ["", "-", "--", "—", "–", "n/a.", "nil"]
# Words that carry no content.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it its of on or that the this to was were will with "
    "which not no any all can may be been being"
).split()
# Shapes of addresses and identifiers.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
URL = r"(?i)https?://\S+"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
CVE = r"(?i)\bCVE-\d{4}-\d{4,7}\b"
CVSS_VECTOR = r"\b(?:CVSS:\d\.\d/)?AV:[NALP]/AC:[LH]/(?:AT:[NP]/)?PR:[NLH]/UI:[NRPA]/\S+"
IMAGE_TAG = r"\[IMAGE_(?:PAGE_\d+_FIG_\d+|DOCX_FIG_\d+)\]"
TOKEN = r"[a-z0-9]+(?:[.\-/:@][a-z0-9]+)*"

_NOISE = (
    r"(?i)^\s*(?:<!-- PAGE_(?:START|END): \d+ -->|## Page \d+"
    r"|### (?:Page Text Content|Embedded Visual Elements|Table [\d.]+|Other Embedded Images)"
    r"|---|Page \d+ of \d+|[ivx]{1,4}\.?)\s*$"
)
# One line of printable ASCII that is prose for certain: without entities, marks at its beginning, two spaces in a row, or what may be a numeral or a class.
_PLAIN = r"\A[ \t\n]*(?!(?i:page )|(?i:[ivx]{1,4}\.?[ \t\n]*\z)|CONFIDENTIAL|RESTRICTED|INTERNAL)(?![ -~]*  )[A-Za-z0-9(][ -%'-~]*[ \t\n]*\z"
# All that is ``(?U)\\s``.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"


def let(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often ``use`` names it; for values that are dear to make."""
    # element_at knows its type; get would find it anew for each row, from all that ``use`` makes.
    return F.element_at(F.transform(F.array(c), use), F.lit(1))


def once(c: Column) -> Column:
    """``c``, declared as not repeatable: the optimizer neither repeats it in each use nor moves it into filters; for values that are dear to make."""
    return F.when(F.spark_partition_id() >= 0, c)


def nothing_is_null(c: Column) -> Column:
    """A regular expression that didn't match gives '' in Spark; here that is null."""
    return F.when(c != "", c)


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return nothing_is_null(F.regexp_extract(c, pattern, group))


def one_space(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("&#124;"), F.lit("|")), r"(?U)\s+", " ")


def strip(c: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.btrim(c, F.lit(_SPACES))


def strip_short(x: Column) -> Column:
    """``strip`` of a column or bound value: most begin and end with a printable ASCII character and stay as they are, which is far cheaper to see."""
    return F.when((x == "") | x.rlike(r"\A[!-~](?:.*[!-~])?\z"), x).otherwise(strip(x))


def clean_value(c: Column) -> Column:
    """Runs of white space are one space, colons, bullets and spaces go from the ends, placeholders are null; NA stays."""
    v = F.btrim(one_space(c), F.lit(" :•"))
    return F.when(~F.lower(v).isin(PLACEHOLDERS), v)


def serial(c: Column) -> Column:
    """The number of a cell that is one to four digits, perhaps with a full stop; else null."""
    return F.try_to_number(found(c, r"^\s*(\d{1,4})\.?\s*$", 1), F.lit("9999")).cast("int")


def label_key(c: Column) -> Column:
    return F.lower(F.btrim(one_space(c), F.lit(" :.-•")))


def unwrap_url(c: Column) -> Column:
    """A cell that is one URL, broken over lines, becomes whole again."""

    def whole(t: Column) -> Column:
        start = F.lower(F.substring(t, 1, 8))
        one = (F.startswith(start, F.lit("http://")) | F.startswith(start, F.lit("https://"))) & (F.regexp_count(F.lower(t), F.lit("http")) == 1)
        return F.when(one, F.regexp_replace(t, r"(?U)\s+", "")).otherwise(t)

    return let(strip(c), whole)


def compact(cells: Column) -> Column:
    """Cells without the empty ones and without those that repeat the one before."""
    return let(F.filter(F.transform(cells, strip_short), lambda x: x != ""), lambda full: F.filter(full, lambda x, i: (i == 0) | (x != F.get(full, i - 1))))


def first_index(cells: Column, test) -> Column:
    """Index (from 0) of the first cell that passes; null if none does."""
    return F.get(F.filter(F.transform(cells, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()), F.lit(0))


def split_lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK, -1)


def is_table_row(line: Column) -> Column:
    return F.startswith(line, F.lit("|")) & F.endswith(line, F.lit("|")) & (F.length(line) > 1)


def is_noise(line: Column) -> Column:
    """Lines that are no prose: empty, page marks and titles, rules, lone numerals, table rows, image tags."""
    row = F.startswith(line, F.lit("|")) & F.endswith(line, F.lit("|"))
    return (line == "") | line.rlike(_NOISE) | row | line.rlike("^" + IMAGE_TAG)


def prose_lines(c: Column) -> Column:
    return F.filter(F.transform(split_lines(F.coalesce(c, F.lit(""))), strip_short), lambda x: ~is_noise(x))


def prose(c: Column) -> Column:
    """Wrapped lines joined by spaces, bullets on lines of their own; a text of one line is cleaned as a value."""
    lines = F.filter(prose_lines(c), lambda x: ~x.rlike("^(?:CONFIDENTIAL|RESTRICTED|INTERNAL(?: USE ONLY)?)$"))
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("bullet"))

    def join(a: Column, x: Column) -> Column:
        alone = x.isin("•", "*", "▪")
        marked = a["bullet"] | F.startswith(x, F.lit("•"))
        piece = F.when(marked, F.concat(F.lit("\n• "), strip(F.ltrim(x, F.lit("• "))))).otherwise(F.concat(F.when(a["text"] == "", F.lit("")).otherwise(F.lit(" ")), x))
        return F.struct(F.when(alone, a["text"]).otherwise(F.concat(a["text"], piece)).alias("text"), alone.alias("bullet"))

    text = strip(F.regexp_replace(F.aggregate(lines, start, join)["text"], r"[ \t]+", " "))
    whole = let(text, lambda t: F.when(F.contains(t, F.lit("\n")), t).otherwise(clean_value(t)))
    # Most texts are one line of plain words, which is cleaned alone.
    bare = F.btrim(c, F.lit(" \t\n:"))
    return F.when(c.isNotNull(), F.when(c.rlike(_PLAIN), F.when(~F.lower(bare).isin(PLACEHOLDERS), bare)).otherwise(whole))


def tokens(c: Column) -> Column:
    """Lower-case tokens: ASCII letters and digits, joined inside by . - / : @. Compatibility forms are expected to be normalised before (``normalize_forms``)."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def is_content(t: Column) -> Column:
    return ~t.isin(STOP_WORDS) & ((F.length(t) > 2) | t.rlike("[0-9]"))


def content_tokens(c: Column) -> Column:
    return F.filter(tokens(c), is_content)


def token_key(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def normalize_forms(c: Column) -> Column:
    """NFKC, by an Arrow function; only texts beyond ASCII are sent to it."""
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.astype("string").str.normalize("NFKC")  # also where all are null

    # Declared as not repeatable, so that the optimizer neither repeats it nor moves it into filters, where it can't run.
    return F.coalesce(nfkc.asNondeterministic()(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def clean_piece(c: Column) -> Column:
    """A transcript line or cell without its leading mark, image tags and emphasis."""
    bare = F.regexp_replace(c, r"(?U)^\s*(?:#{1,6}\s*|[-*•▪]\s+|\d+[.)]\s+)?", "")
    return unwrap_url(F.btrim(F.regexp_replace(bare, r"(?i)\[\s*IMAGE[_ ]PAGE[_ ](\d+)[_ ]FIG[_ ](\d+)\s*\]", " "), F.lit(" *_`")))


def pick(c: Column, allowed: Sequence[str], synonyms: Sequence[tuple[str, str]] = ()) -> Column:
    """The first allowed word, in the order of ``allowed``, that the value holds as a whole word; else the first synonym that it holds
    anywhere; else the value as it is. Empty is null."""
    def choose(v: Column) -> Column:
        low = F.lower(v)
        tests = [(low.rlike(rf"(?U)\b{a.lower()}\b"), a) for a in allowed] + [(F.contains(low, F.lit(s)), a) for s, a in synonyms]
        chosen = reduce(lambda case, t: case.when(t[0], F.lit(t[1])), tests[1:], F.when(tests[0][0], F.lit(tests[0][1])))
        return F.when(v.isNotNull() & (v != ""), chosen.otherwise(v))

    return let(c, choose)


# Severities, statuses and their synonyms, in the order in which they are tried.
SEVERITIES = ["Critical", "High", "Medium", "Low", "Informational"]


def severity(c: Column) -> Column:
    return pick(c, SEVERITIES, [("info", "Informational"), ("moderate", "Medium")])


def status(c: Column) -> Column:
    return pick(c, ["Partially Remediated", "Open", "Closed"], [("partial", "Partially Remediated"), ("remediated", "Closed"), ("fixed", "Closed"), ("resolved", "Closed")])


def impact_level(c: Column) -> Column:
    return pick(c, ["Major", "Moderate", "Minor"])


def likelihood_level(c: Column) -> Column:
    return pick(c, ["Easy", "Moderate", "Hard"])


def new_or_repeat(c: Column, recurring: bool = True) -> Column:
    return pick(c, ["New", "Repeat"], [("repeated", "Repeat"), *([("recurring", "Repeat")] if recurring else [])])


def license_type(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low == "licensed", F.lit("Licensed")).when(F.contains(low, F.lit("open")), F.lit("Open Source")).otherwise(c)


def cves(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CVE), F.lit(0)), F.upper)))


def cwes(c: Column) -> Column:
    """CWE entries with their names, the first of each whatever its case."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")
    pattern = r"(?i)CWE-\d+(?:\s*[:\-–]\s*[^•\n]*?)?(?=\s*(?:•|CWE-\d|$|\s(?:Affected|Recommendation|Impact)\b))"
    all_of = F.transform(F.regexp_extract_all(flat, F.lit(pattern), F.lit(0)), lambda x: F.btrim(x, F.lit(" ,;")))
    return let(all_of, lambda every: F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: F.upper(y) == F.upper(x))))


def items(c: Column) -> Column:
    """Values of a field that lists several, by line or bullet."""
    parts = F.transform(F.split(F.coalesce(prose(c), F.lit("")), "\n|•", -1), clean_value)
    return F.filter(parts, lambda x: x.isNotNull() & (F.upper(x) != "NA"))


def is_private_ip(c: Column) -> Column:
    """Whether an IPv4 address is of a range that isn't routed globally; a malformed one is not."""
    part = [F.regexp_extract(c, r"^(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})$", i) for i in (1, 2, 3, 4)]
    a, b, d, e = (F.try_to_number(F.when(p != "", p), F.lit("999")).cast("int") for p in part)
    valid = (a <= 255) & (b <= 255) & (d <= 255) & (e <= 255)
    ranges = (
        a.isin(0, 10, 127) | (a >= 240) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        | ((a == 192) & (b == 0) & (d == 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (d == 100)) | ((a == 203) & (b == 0) & (d == 113))
        | ((a == 192) & (b == 0) & (d == 0) & ~e.isin(9, 10))
    )
    return F.coalesce(valid & ranges, F.lit(False))


def strip_fences(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?s)^```[A-Za-z]*[ \t]*\n?|\n?```$", "")


def json_object(c: Column) -> Column:
    """The object in a text as a variant: all of the text, or what its outermost braces hold; else null."""
    text = strip_fences(c)
    inner = found(text, r"(?s)(\{.*\})", 1)
    whole = F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), F.try_parse_json(text))

    def objects_only(v: Column) -> Column:
        return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)

    return F.coalesce(objects_only(whole), objects_only(F.try_parse_json(inner)))


def safe_stem(c: Column) -> Column:
    """A file name's stem with only word characters, dots and dashes."""
    t = F.btrim(F.regexp_replace(c, r"(?U)[^\w.\-]+", "_"), F.lit("._ "))
    return F.coalesce(nothing_is_null(t), F.lit("document"))


def document_id(stem: Column, content: Column) -> Column:
    return F.concat(stem, F.lit("-"), F.substring(F.sha2(content, 256), 1, 12))


def git_blob_sha1(content: Column) -> Column:
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.lit(b"\x00"), content))


def image_tag(page: Column, figure: Column) -> Column:
    return F.format_string("[IMAGE_PAGE_%d_FIG_%d]", page, figure)
