"""Page text from items, and matches projected onto the boxes of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import WS
from ..functions.geometry import MARGIN, box, measure_text, run_box, sub_box_measured, sub_box_uniform, word_box
from .spans import let

SCANNED_BELOW = 20
GAP = 0.6
PREVIEW_SCALE, REDACTION_SCALE = 1.5, 2.5


def significant_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, WS + "+", ""))


def is_scanned(text: Column) -> Column:
    """Whether a page has too little text of its own and must be read from its image."""
    return significant_chars(F.coalesce(text, F.lit(""))) < SCANNED_BELOW


def with_offsets(items: DataFrame, length: Column) -> DataFrame:
    """Add start_pos and end_pos: running lengths in item order on each page."""
    w = Window.partitionBy("doc_id", "page").orderBy("item_seq").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("end_pos", F.sum(length).over(w).cast("int")).withColumn("start_pos", (F.col("end_pos") - length).cast("int"))


def native_items(runs: DataFrame) -> DataFrame:
    """Items of glyph runs (doc_id, page, item_seq, str, has_eol, transform, width, height, page_width, page_height).

    A run's text ends in a newline or a space; a run without a string is
    skipped; an empty one moves the offsets but is no item.
    """
    rows = runs.where("str is not null").withColumn("text", F.concat("str", F.when(F.coalesce("has_eol", F.lit(False)), "\n").otherwise(" ")))
    placed = with_offsets(rows, F.length("text")).where("str != ''")
    shape = run_box(F.col("transform"), F.col("width"), F.col("height"), F.col("page_width"), F.col("page_height"))
    return placed.select("doc_id", "page", "item_seq", "text", "start_pos", "end_pos", shape.alias("box"), F.lit("native").alias("source"))


def ocr_items(words: DataFrame) -> DataFrame:
    """Items of words read from an image (doc_id, page, item_seq, text, x0, y0, x1, y1, img_width, img_height).

    A blank word moves the offsets but is no item.
    """
    rows = words.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" ")))
    shape = word_box(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "img_width", "img_height")))
    return with_offsets(rows, F.length("text")).where(significant_chars(F.col("text")) > 0).select("doc_id", "page", "item_seq", "text", "start_pos", "end_pos", shape.alias("box"), F.lit("ocr").alias("source"))


def page_text(items: DataFrame) -> DataFrame:
    """Rows (doc_id, page, text): the items' texts in order, nothing between them. A page's items meet in one row."""
    return items.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_seq", "text"))), lambda s: s["text"]), "").alias("text"))


def switch_source(native: DataFrame, ocr: DataFrame, pages: DataFrame) -> DataFrame:
    """Each page's items: from its image where it is scanned, else its own.

    Two filtered branches and a union, so the costly branch only sees the
    pages that need it. ``pages``: doc_id, page, is_scanned.
    """
    scanned = pages.where("is_scanned").select("doc_id", "page")
    return native.join(scanned, ["doc_id", "page"], "left_anti").unionByName(ocr.join(scanned, ["doc_id", "page"], "left_semi"))


def overlaps(matches: DataFrame, items: DataFrame) -> DataFrame:
    """Each match with the items of its page that its span overlaps: equality on the page, the interval as a residual.

    Both sides grow with the pages, and the size that a plan expects of matches (a Parquet file's bytes, however many
    findings a row has) says nothing: they are merged over shuffles by page and never broadcast.
    """
    i = items.select("doc_id", "page", "item_seq", F.col("text").alias("item_text"), F.col("start_pos").alias("item_start"), F.col("end_pos").alias("item_end"), "box", F.col("source").alias("item_source"))
    m = matches.alias("m")
    on = (F.col("m.doc_id") == i["doc_id"]) & (F.col("m.page") == i["page"]) & (i["item_end"] > F.col("m.start_pos")) & (i["item_start"] < F.col("m.end_pos"))
    return m.hint("merge").join(i, on).select("m.*", "item_seq", "item_text", "item_start", "item_end", "box", "item_source")


def sub_boxes(overlapping: DataFrame, measured: bool = False) -> DataFrame:
    """Replace box by the part of it that the match covers, uniform or measured; text that measures nothing falls back to uniform."""
    b, s, e = F.col("box"), F.col("item_start"), F.col("item_end")
    uniform = sub_box_uniform(b, s, e, F.col("start_pos"), F.col("end_pos"))
    if not measured:
        return overlapping.withColumn("box", uniform)
    lo, hi = F.greatest("start_pos", "item_start") - s, F.least("end_pos", "item_end") - s
    # each width is measured once a row; the box uses them many times
    widths = F.struct(
        measure_text(F.col("item_text")).alias("full"), measure_text(F.substring("item_text", F.lit(1), lo)).alias("prefix"), measure_text(F.substring("item_text", lo + 1, hi - lo)).alias("part"))

    def placed(w: Column) -> Column:
        exact = sub_box_measured(b, F.nullif(w["full"], F.lit(0.0)), w["prefix"], w["part"], F.lit(MARGIN))
        return F.when((e > s) & (w["full"] > 0), exact).otherwise(uniform)

    return overlapping.withColumn("box", let(widths, placed))


def cluster_boxes(parts: DataFrame) -> DataFrame:
    """Add ``cluster``: 0-based; a part begins a new one where it lies more than 0.6 heights below its predecessor, by y."""
    w = Window.partitionBy("doc_id", "page", "ord").orderBy(F.col("box.y"), "item_seq")
    y, h = F.lag("box.y").over(w), F.lag("box.height").over(w)
    new = F.when(F.col("box.y") - (y + h) > h * F.lit(GAP).cast("double"), 1).otherwise(0)
    return parts.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def union_boxes(clustered: DataFrame) -> DataFrame:
    """One row for each cluster of a match, with the box around its parts."""
    first = ["type", "text", "start_pos", "end_pos", "confidence", "source"]
    x, y = F.min("box.x"), F.min("box.y")
    around = box(x, y, F.max(F.col("box.x") + F.col("box.width")) - x, F.max(F.col("box.y") + F.col("box.height")) - y)
    return clustered.groupBy("doc_id", "page", "ord", "cluster", *first).agg(around.alias("box"))


def detection_id(doc: str = "doc_id") -> Column:
    """An id that is the same whenever a detection is computed again."""
    return F.sha2(F.concat_ws("|", doc, "page", "type", "start_pos", "end_pos", "ord", "cluster"), 256)


def detections(matches: DataFrame, items: DataFrame, measured: bool = False) -> DataFrame:
    """One detection for each cluster of each match; matches without an item vanish; a page with any item read from an image has source ``ocr``."""
    page = Window.partitionBy("doc_id", "page")
    told = items.withColumn("source", F.when(F.bool_or(F.col("source") == "ocr").over(page), "ocr").otherwise(F.col("source")))
    parts = cluster_boxes(sub_boxes(overlaps(matches, told), measured))
    found = union_boxes(parts.withColumn("source", F.when(F.col("item_source") == "ocr", "ocr").otherwise(F.col("source"))))
    return found.select("doc_id", "page", "ord", "cluster", "type", "text", "start_pos", "end_pos", "confidence", "source", "box", detection_id().alias("id"))


def page_dims(width: Column, height: Column) -> Column:
    """Page size as shown: the preview raster's size in whole pixels, scaled back."""
    s = F.lit(PREVIEW_SCALE).cast("double")
    return F.struct((F.ceil(width * s) / s).alias("width"), (F.ceil(height * s) / s).alias("height"))
