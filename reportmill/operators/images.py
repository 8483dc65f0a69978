"""Image placements: tags, repair of misread tags, the manifest, and the content-addressed store."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import text as T
from reportmill.operators.lines import first_by

MIN_PIXELS, MIN_BOX = 8, 40.0
PLACEMENT = ["tag", "page", "figure", "sha256", "uri", "format", "width", "height", "bbox"]


def tag_placements(placed: DataFrame, min_box: float = MIN_BOX) -> DataFrame:
    """Placements (document_id, page, xref, placement_no, sha256, format, width, height, x0, y0, x1, y1) with figure, tag and is_layout.

    An image that a page lists twice counts by its first listing; spacers are left out; a box with a short side is layout and has no tag; figures are numbered on each page in order.
    """
    seen = Window.partitionBy("document_id", "page", "xref", "placement_no").orderBy("listing") if "listing" in placed.columns else None
    rows = placed if seen is None else placed.withColumn("n", F.row_number().over(seen)).where("n = 1").drop("n")
    rows = rows.where((F.least("width", "height") >= MIN_PIXELS) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    rows = rows.withColumn("is_layout", F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) < min_box)
    figure = F.row_number().over(Window.partitionBy("document_id", "page", "is_layout").orderBy("xref", "placement_no"))
    rows = rows.withColumn("figure", F.when(F.col("is_layout"), 0).otherwise(figure))
    tag = F.when(F.col("is_layout"), F.lit("")).otherwise(T.image_tag(F.col("page"), F.col("figure")))
    return rows.withColumn("tag", tag).withColumn("bbox", F.transform(F.array("x0", "y0", "x1", "y1"), lambda v: F.round(v, 2)))


def manifest(tagged: DataFrame) -> DataFrame:
    """(document_id, images, layout_images): a map of tag to placement, and the layout images."""
    one = F.struct(*[x for x in PLACEMENT if x in tagged.columns])
    images = F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("is_layout"), F.struct(F.col("tag").alias("key"), one.alias("value"))))))
    return tagged.groupBy("document_id").agg(images.alias("images"), F.array_sort(F.collect_list(F.when(F.col("is_layout"), one))).alias("layout_images"))


def object_path(sha256, extension):
    """objects/ab/cd/<sha256>.<extension>."""
    ext = F.coalesce(T.nothing_is_null(F.regexp_replace(F.lower(extension), r"^\.+", "")), F.lit("bin"))
    return F.concat(F.lit("objects/"), F.substring(sha256, 1, 2), F.lit("/"), F.substring(sha256, 3, 2), F.lit("/"), sha256, F.lit("."), ext)


def store_objects(blobs: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """New objects (sha256, uri, content) of blobs (content, extension): one of each content, without those that the store already has."""
    keyed = blobs.select(F.sha2("content", 256).alias("sha256"), "content", "extension")
    new = first_by(keyed, ["sha256"], [F.col("extension").asc_nulls_last()])
    if store is not None:
        new = new.join(store.select("sha256"), "sha256", "left_anti")
    return new.select("sha256", object_path(F.col("sha256"), F.col("extension")).alias("uri"), "content")


def reconcile_tags(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """(document_id, page, markdown, issues): page texts with their image tags repaired: exact ones in any spelling, misread ones by likeness (0.8 or more), unknown ones left, missing ones at the end.

    ``expected``: document_id, page, figure, tag. A page's tags travel with its text; the likeness is that of difflib.
    """
    strict = re.compile(r"\[\s*IMAGE[_ ]PAGE[_ ](\d+)[_ ]FIG[_ ](\d+)\s*\]", re.I)
    loose = re.compile(r"\[\s*[I1l]MAGE[\s_]*PAGE[\s_]*[\dOoIl]+[\s_]*F[I1l]G[\s_]*[\dOoIl]+\s*\]", re.I)

    def repair(text: str, wanted: list[str]) -> tuple[str, list[str]]:
        issues: list[str] = []

        def one(m: re.Match) -> str:
            raw, exact = m[0], strict.fullmatch(m[0])
            if exact and (tag := f"[IMAGE_PAGE_{int(exact[1])}_FIG_{int(exact[2])}]") in wanted:
                return tag
            near = difflib.get_close_matches(raw.upper().replace(" ", "_"), wanted, 1, 0.8)
            if not near:
                issues.append(f"unknown image tag {raw!r} left as text")
                return raw
            if near[0] != raw:
                issues.append(f"misread tag {raw!r} corrected to {near[0]}")
            return near[0]

        text = loose.sub(one, text)
        if lost := [t for t in wanted if t not in text]:
            issues.append(f"tags not transcribed, appended to page end: {lost}")
            text = text.rstrip() + "\n\n" + "\n".join(lost)
        return text, issues

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [repair(m or "", [] if w is None else [x["tag"] for x in w]) for m, w in zip(batch["markdown"], batch["wanted"])]
            yield batch[["document_id", "page"]].assign(markdown=[d[0] for d in done], issues=[d[1] for d in done])

    tags = expected.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("figure", "tag"))).alias("wanted"))
    met = pages.select("document_id", "page", "markdown").join(tags, ["document_id", "page"], "left")
    return met.mapInPandas(work, "document_id string, page int, markdown string, issues array<string>")


def layout_pages(tables: DataFrame, blocks: DataFrame, tags: DataFrame) -> DataFrame:
    """(document_id, page, markdown): each page's tables, then its text blocks with image tags between them by height.

    ``tables``: document_id, page, table_no, markdown; ``blocks``: document_id, page, block_no, y0, x0, is_text, text; ``tags``: document_id, page, tag, y0, x0 (null if not placed).
    """
    big = float("inf")
    text = blocks.where("is_text").withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    parts = (
        tables.where("markdown <> ''").select("document_id", "page", F.struct(F.lit(0).alias("part"), F.col("table_no").cast("double").alias("y"), F.lit(0).alias("kind"), F.lit(0.0).alias("x"), F.col("markdown").alias("s")).alias("p"))
        .unionByName(text.select("document_id", "page", F.struct(F.lit(1).alias("part"), F.col("y0").alias("y"), F.lit(1).alias("kind"), F.col("x0").alias("x"), F.col("text").alias("s")).alias("p")))
        .unionByName(tags.select("document_id", "page", F.struct(F.lit(1).alias("part"), F.coalesce("y0", F.lit(big)).alias("y"), F.lit(0).alias("kind"), F.coalesce("x0", F.lit(big)).alias("x"), F.col("tag").alias("s")).alias("p")))
    )
    got = parts.groupBy("document_id", "page").agg(F.array_sort(F.collect_list("p")).alias("p"))
    one = lambda n, sep: F.array_join(F.transform(F.filter("p", lambda x: x["part"] == n), lambda x: x["s"]), sep)
    both = F.filter(F.array(one(0, "\n\n"), one(1, "\n")), lambda x: x != "")
    return got.select("document_id", "page", F.array_join(both, "\n\n").alias("markdown"))
