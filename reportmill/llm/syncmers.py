"""Document fingerprints by closed syncmers, in DataFrame operations alone.

A text is a sequence of tokens: its words, A-Z lower-cased, words of more than ``piece`` characters cut into pieces of that length. Over token hashes, a
k-mer is ``k`` tokens in a row and an s-mer ``s`` of them. A k-mer is chosen when the smallest s-mer in it is its
first or its last: that depends on the k-mer alone, so a passage has the same anchors wherever it stands, and of any ``k - s + 1`` k-mers in a row one at least is chosen.
Anchors that begin alike are told apart by their whole k-mer's hash.

The fingerprint is the distinct anchors in order of first occurrence, each 8 hex digits. A text with fewer than ``k`` tokens has one anchor, the hash of all of
them; a text without tokens has none. The likeness of two fingerprints is twice the number of shared anchors by the numbers of
both together (1 for two empty ones).

Positional matching: ``anchor_matches`` gives the token positions at which two texts share an anchor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.llm import _common as c


def token_hashes(text: Column, piece: int = 24) -> Column:
    tokens = F.regexp_extract_all(c.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"{c.WORD_CLASS}{{1,{piece}}}"), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def s_mers(hashes: Column, s: int) -> Column:
    """Hash of each s tokens in a row."""
    if s == 1:
        return hashes
    return F.transform(F.sequence(F.lit(1), F.size(hashes) - (s - 1)), lambda i: F.xxhash64(*[F.element_at(hashes, i + j) for j in range(s)]))


def _chosen(smers: Column, n: Column, k: int, s: int) -> Column:
    span = k - s + 1

    def edge(i: Column) -> Column:
        least = F.array_min(F.slice(smers, i, span))
        return (F.element_at(smers, i) == least) | (F.element_at(smers, i + (span - 1)) == least)

    return F.filter(F.sequence(F.lit(1), n - (k - 1)), edge)


def fingerprint_column(df: DataFrame, text: str, out: str, k: int, s: int, piece: int) -> DataFrame:
    """Adds ``out``: the anchors' hashes as an array of longs (32 bits each), in order."""
    h, m, at = f"{out}__h", f"{out}__m", f"{out}__at"
    few = F.size(h) < k
    df = df.withColumn(h, token_hashes(F.col(text), piece))
    df = df.withColumn(m, F.when(few, F.array().cast("array<bigint>")).otherwise(s_mers(F.col(h), s)))
    df = df.withColumn(at, F.when(few, F.array().cast("array<int>")).otherwise(_chosen(F.col(m), F.size(h), k, s)))
    low = F.lit(0xFFFFFFFF)
    whole = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h).bitwiseAND(low)))
    # Every k-mer is told apart by the s-mers that cover it.
    cover = [*range(0, k - s, s), k - s]
    marks = F.transform(at, lambda i: F.xxhash64(*[F.element_at(F.col(m), i + j) for j in cover]).bitwiseAND(low))
    return df.withColumn(out, F.array_distinct(F.when(few, whole).otherwise(marks))).drop(h, m, at)


def likeness(a: Column, b: Column) -> Column:
    """Dice's measure of two sets of anchors."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def with_next(docs: DataFrame, block_rows: int = 2000, most_ranges: int = 10_000, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Adds ``next``, a struct of all columns: the next row in descending order of ``doc_id`` (null last, then by ``tie``), and after
    the last row the first. ``docs`` has doc_id and a long ``tie`` that spreads rows of one id. ``prepare`` adds columns to each row, once, before rows move.

    Rows go to ranges of the id, with bounds from the ids alone; a range that is one id with very many rows is cut
    by ``tie``. Each range also gets the first row of the one behind it, so the rows' payload is shuffled once and no task holds more than a range.
    """
    keyed = docs.withColumn("__k", F.coalesce("doc_id", F.lit(-(2**63))))
    thin = keyed.select("__k", "tie")
    total = thin.count()
    n = max(1, min(most_ranges, -(-total // block_rows)))
    cuts = [int(x) for x in thin.select(F.col("__k").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)] if n > 1 and total else []
    # An id that is several cuts in a row gets a range of its own. Ids beyond 2^53 round to nearby cuts, which only shifts a bound.
    hot = {x for x, y in zip(cuts, cuts[1:]) if x == y}
    cuts = sorted({*cuts, *(max(x - 1, -(2**63)) for x in hot)})
    if cuts:
        step = max(1, round(len(cuts) ** 0.5))
        groups = F.array(*[F.array(*map(F.lit, cuts[i : i + step])) for i in range(0, len(cuts), step)])
        firsts = F.array(*map(F.lit, cuts[::step]))
        coarse = F.size(F.filter(firsts, lambda b: b < F.col("__k")))
        fine = F.size(F.filter(F.element_at(groups, F.greatest(coarse, F.lit(1))), lambda b: b < F.col("__k")))
        place = F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine)
    else:
        place = F.lit(0)
    parts = {r["p"]: -(-r["n"] // block_rows) for r in thin.groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.min("__k").alias("a"), F.max("__k").alias("b")).where(f"a = b and n > {4 * block_rows}").collect()}
    slot = (F.lit(len(cuts)) - place).cast("long") * 1_000_000
    for p, m in parts.items():
        sub = F.floor((F.col("tie") / 2.0**64 + 0.5) * min(m, 999_999))
        slot = slot + F.when(place == p, sub).otherwise(0)
    slotted = keyed.withColumn("__slot", slot)
    # One head per range; a row for each range is a small table by the bound on ranges.
    heads = slotted.groupBy("__slot").agg(F.min(F.struct((-1 - F.col("__k")).alias("down"), "tie")).alias("head"))
    order = Window.orderBy("__slot")
    around = F.last("__slot").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.coalesce(F.lag("__slot").over(order), around).alias("__to"), (-1 - F.col("head.down")).alias("__hk"), F.col("head.tie").alias("__ht"))
    ahead = keyed.join(F.broadcast(heads), (F.col("__k") == F.col("__hk")) & (F.col("tie") == F.col("__ht")))
    ahead = ahead.select(*docs.columns, "__k", F.col("__to").alias("__slot")).dropDuplicates(["__slot"])
    rows = slotted.withColumn("__extra", F.lit(False)).unionByName(ahead.withColumn("__extra", F.lit(True)))
    line = Window.partitionBy("__slot").orderBy("__extra", F.col("__k").desc(), "tie")
    rows = prepare(rows)
    shown = [x for x in rows.columns if x not in ("__k", "__slot", "__extra")]
    led = rows.withColumn("next", F.lead(F.struct(*shown)).over(line))
    return led.where("not __extra").drop("__k", "__slot", "__extra")


def fingerprint_edits(docs: DataFrame, k: int = 8, s: int = 2, piece: int = 24, block_rows: int = 2000) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last ``floor(n_chars / 3)`` code points replaced by the first as many of the next document's. Null text is empty; a repeated row is the
    next document of its like; other columns are not read; an empty table gives no rows.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("tie", F.xxhash64("text"))
    # Neighbours exchange what the other needs: the text, of which a third of the other's length is used, and the anchors.
    led = with_next(own, block_rows, prepare=lambda rows: fingerprint_column(rows, "text", "anchors", k, s, piece))
    led = led.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    led = led.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("cut")), F.substring(F.col("next.text"), F.lit(1), F.col("cut"))))
    led = led.select("doc_id", "n_chars", "anchors", F.col("next.anchors").alias("next_anchors"), F.sha2("edited", 256).alias("edited_sha256"), "edited")
    led = fingerprint_column(led, "edited", "edited_anchors", k, s, piece)
    return led.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("anchors")).alias("fingerprint"), as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


def anchor_matches(a: DataFrame, b: DataFrame, k: int = 8, s: int = 2, piece: int = 24) -> DataFrame:
    """Positional matching of two tables (doc_id, text): (a_id, b_id, a_at, b_at, anchor), a row for each anchor that occurs
    once in a text of either table's document and is shared. ``a`` should be the smaller; pairs grow with shared anchors only."""

    def placed(docs: DataFrame, side: str) -> DataFrame:
        df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        df = df.withColumn("h", token_hashes(F.col("text"), piece)).where(F.size("h") >= k).withColumn("m", s_mers(F.col("h"), s))
        df = df.withColumn("at", _chosen(F.col("m"), F.size("h"), k, s))
        cover = [*range(0, k - s, s), k - s]
        marks = F.transform("at", lambda i: F.struct(F.xxhash64(*[F.element_at(F.col("m"), i + j) for j in cover]).alias("anchor"), (i - 1).alias("at")))
        rows = df.select("doc_id", F.explode(marks).alias("x")).select("doc_id", "x.*")
        once = rows.groupBy("doc_id", "anchor").agg(F.min("at").alias("at"), F.count("*").alias("n")).where("n = 1")
        return once.select(F.col("doc_id").alias(f"{side}_id"), F.col("at").alias(f"{side}_at"), "anchor")

    return placed(a, "a").join(placed(b, "b"), "anchor").select("a_id", "b_id", "a_at", "b_at", "anchor")
