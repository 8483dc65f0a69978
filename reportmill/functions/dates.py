"""Dates in text, as ISO strings. Days come before months unless that can't be; two-digit years are in the 2000s."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportmill.functions.text import clean_value, let

# Months by their first three letters, in order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_YMD = r"(?U)\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b"
_DMY = r"(?U)\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})\b"
_DAY_MONTH = r"(?U)\b(\d{1,2})[\s\-./,]*([A-Za-z]{3,9})\.?[\s\-./,]*(\d{4}|\d{2})\b"
_MONTH_DAY = r"(?U)\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})\b"
#: Any of the four shapes, as they stand in running text. Nothing behind a month's letters takes letters, so none of them are given back.
_SHAPES = (
    r"\b(?:(?=\d)(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b"
    r"|\d{1,2}(?:(?i:st|nd|rd|th))?[\s\-./,]*[A-Za-z]{3,9}+\.?[\s\-./,]*(?:\d{4}|\d{2})\b)|[A-Za-z]{3,9}+\.?\s+\d{1,2}(?:(?i:st|nd|rd|th))?,?\s+\d{4}\b)"
)
ANY_DATE = "(?iU)" + _SHAPES


def _candidates(text: Column, pattern: str, shape: str) -> Column:
    """An array of (position, year, month, day), a row for each match. Positions come from cutting the text before each match."""
    # The gaps between matches give the place of each: gap lengths and match lengths up to it.
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.split(text, pattern, -1).alias("gaps"))

    def number(s: Column) -> Column:
        return F.try_to_number(s, F.lit("9999")).cast("int")

    def one(both: Column, m: Column, i: Column) -> Column:
        length = lambda a, g: a + F.length(g)
        at = F.aggregate(F.slice(both["gaps"], F.lit(1), i + 1), F.lit(0), length) + F.aggregate(F.slice(both["whole"], F.lit(1), i), F.lit(0), length)
        g = [F.regexp_extract(m, pattern, k) for k in (1, 2, 3)]
        if shape == "ymd":
            y, mo, d = (number(x) for x in g)
        elif shape == "dmy":
            first, second, y = (number(x) for x in g)
            swap = (second > 12) & (first <= 12)
            d, mo = F.when(swap, second).otherwise(first), F.when(swap, first).otherwise(second)
        else:
            day, name = (g[0], g[1]) if shape == "day_month" else (g[1], g[0])
            d, y = number(day), number(g[2])
            mo = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))).cast("int")
        y = F.when(y < 100, y + 2000).otherwise(y) if shape != "ymd" else y
        return F.struct(at.alias("at"), y.alias("y"), mo.alias("m"), d.alias("d"))

    return let(cut, lambda both: F.filter(F.transform(both["whole"], lambda m, i: one(both, m, i)), lambda x: x["m"] > 0))


def _plain(c: Column) -> Column:
    """Without the endings of ordinal numbers."""
    return F.regexp_replace(c, r"(?iU)(\d{1,2})\s*(?:st|nd|rd|th)\b", "$1")


def _iso(x: Column) -> Column:
    return F.when((x["y"] > 0) & (x["m"] > 0), F.format_string("%04d-%02d-%02d", x["y"], x["m"], x["d"]))


def _first_valid(every: Column) -> Column:
    return F.get(F.filter(F.transform(every, _iso), lambda s: s.isNotNull() & s.try_cast("date").isNotNull()), F.lit(0))


def parse_date(c: Column) -> Column:
    """The first date of a text that the calendar has, as YYYY-MM-DD; null if there is none."""

    def first(text: Column) -> Column:
        # A text without two numbers apart, or without a month's letters, has no date: most texts end here.
        likely = text.rlike(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}") | text.rlike(r"(?iU)\d.*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec).*\d")
        every = F.array_sort(F.concat(_candidates(text, _YMD, "ymd"), _candidates(text, _DMY, "dmy"), _candidates(text, _DAY_MONTH, "day_month"), _candidates(text, _MONTH_DAY, "month_day")))
        return F.when(likely, _first_valid(every))

    return let(_plain(c), first)


def find_dates(c: Column) -> Column:
    """Every date of a text in order, as ISO strings."""
    hits = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ANY_DATE), F.lit(0))
    return F.filter(F.transform(hits, parse_date), lambda x: x.isNotNull())


def normalize_dates(c: Column) -> Column:
    """The text with each date in it rewritten as ISO."""
    # Dates are marked and the text is cut at the marks, so that the pattern runs over it once, and the same without the Unicode classes over ASCII, which is far
    # cheaper. A text that holds such marks itself is cut by the pattern. Either way gaps and dates take turns.
    mark = lambda pattern: F.regexp_replace(c, pattern, "\x01$1\x02")
    marked = F.when(c.rlike(r"[^\x00-\x7F]"), mark(f"(?iU)({_SHAPES})")).otherwise(mark(f"({_SHAPES})"))
    hits = F.concat(F.regexp_extract_all(c, F.lit(ANY_DATE), F.lit(0)), F.array(F.lit("")))
    turns = F.when(c.rlike("[\x01\x02]"), F.flatten(F.zip_with(F.split(c, ANY_DATE, -1), hits, lambda g, h: F.array(g, h)))).otherwise(F.split(marked, "[\x01\x02]", -1))
    said = F.transform(turns, lambda x, i: F.when(i % 2 == 1, F.coalesce(parse_date(x), x)).otherwise(x))
    # Without a digit there is no date: most texts end here.
    return F.when(c.rlike(r"(?U)\d"), F.array_join(said, "")).otherwise(c)


def date_field(c: Column) -> Column:
    """ISO if the value has a date, else the cleaned value."""
    return let(clean_value(c), lambda v: F.coalesce(parse_date(v), v))


def whole_date(c: Column) -> Column:
    """ISO of a value that is one date and nothing else; null otherwise."""

    def read(t: Column) -> Column:
        def shape(s: Column, pattern: str, order: tuple[int, int, int], named: bool = False) -> Column:
            g = [F.regexp_extract(s, pattern, k) for k in (1, 2, 3)]
            number = lambda x: F.try_to_number(x, F.lit("9999")).cast("int")
            y, mo, d = g[order[0]], g[order[1]], g[order[2]]
            month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(mo, 1, 3))).cast("int") if named else number(mo)
            return F.struct(number(y).alias("y"), month.alias("m"), number(d).alias("d"))

        def full(x: Column) -> Column:
            return F.struct(F.when(x["y"] < 100, x["y"] + 2000).otherwise(x["y"]).alias("y"), x["m"].alias("m"), x["d"].alias("d"))

        def day_first(x: Column) -> Column:
            swap = (x["m"] > 12) & (x["d"] <= 12)
            return F.struct(x["y"].alias("y"), F.when(swap, x["d"]).otherwise(x["m"]).alias("m"), F.when(swap, x["m"]).otherwise(x["d"]).alias("d"))

        plain = let(_plain(t), lambda s: _first_valid(F.array(
            shape(s, _YMD, (0, 1, 2)), let(full(shape(s, _DMY, (2, 1, 0))), day_first), full(shape(s, _DAY_MONTH, (2, 1, 0), True)), shape(s, _MONTH_DAY, (2, 0, 1), True),
        )))
        exact = F.when(t.try_cast("date").isNotNull(), t)
        return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), exact).when(t.rlike(f"(?iU)^(?:{ANY_DATE.removeprefix('(?iU)')})$"), plain)

    return let(F.trim(c), read)
