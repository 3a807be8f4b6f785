"""Review of detections: inclusion, manual zones, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box
from .layout import REDACTION_SCALE
from .patterns import LABELS

INCLUDE_FROM = 0.5
LEAST_ZONE = 0.005


def default_included(detections: DataFrame) -> DataFrame:
    """Add ``included``: confidence from 0.5 on."""
    return detections.withColumn("included", F.col("confidence") >= F.lit(INCLUDE_FROM).cast("double"))


def apply_overrides(detections: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace ``included`` by a reviewer's choice (id, choice) where there is one."""
    return detections.join(overrides.hint("merge"), "id", "left").withColumn("included", F.coalesce("choice", "included")).drop("choice")


def included_lookup(detections: DataFrame, inclusion: DataFrame) -> DataFrame:
    """Look ``included`` up by id; a detection that is not listed is excluded."""
    return detections.join(inclusion.hint("merge"), "id", "left").withColumn("included", F.coalesce("included", F.lit(False)))


def manual_zones(drags: DataFrame) -> DataFrame:
    """Zones (doc_id, zone_id, page, box) of drags (…, x0, y0, x1, y1): clamped to the page, in any direction; slivers are dropped."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    x0, y0, x1, y1 = (clamp(c) for c in ("x0", "y0", "x1", "y1"))
    shape = box(F.least(x0, x1), F.least(y0, y1), F.abs(x1 - x0), F.abs(y1 - y0))
    least = F.lit(LEAST_ZONE).cast("double")
    return drags.select("doc_id", "zone_id", "page", shape.alias("box")).where((F.col("box.width") >= least) & (F.col("box.height") >= least))


def zones(detections: DataFrame, manual: DataFrame) -> DataFrame:
    """Zones (doc_id, page, box) of included detections and of the reviewer."""
    return detections.where("included").select("doc_id", "page", "box").unionByName(manual.select("doc_id", "page", "box"))


def parse_zones(raw: Column) -> Column:
    """Zones (page, box) of a JSON array; null where the text is no JSON array.

    Elements that are no objects are skipped and the others stay; a number
    that is missing or none is null in its zone.
    """
    items = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    objects = F.filter(items, lambda z: F.schema_of_variant(z).startswith("OBJECT"))
    side = lambda z, c: F.try_variant_get(z, f"$.box.{c}", "double").alias(c)
    return F.transform(objects, lambda z: F.struct(
        F.try_variant_get(z, "$.page", "int").alias("page"), F.struct(*(side(z, c) for c in ("x", "y", "width", "height"))).alias("box")))


def zones_by_page(zone_rows: DataFrame) -> DataFrame:
    """Rows (doc_id, page, zones): the zones of a page in one list, by position."""
    return zone_rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("box")).alias("zones"))


def zone_pixels(zone: Column, page_width: Column, page_height: Column) -> Column:
    """A zone in pixels of the redaction raster."""
    s = F.lit(REDACTION_SCALE).cast("double")
    w, h = F.ceil(page_width * s), F.ceil(page_height * s)
    return F.struct((zone["x"] * w).alias("x"), (zone["y"] * h).alias("y"), (zone["width"] * w).alias("width"), (zone["height"] * h).alias("height"))


def count_by_type(detections: DataFrame) -> DataFrame:
    """Rows (type, label, n) and the first place of each type."""
    return detections.groupBy("type").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "page", "ord", "cluster")).alias("first")).select("type", type_label(F.col("type")).alias("label"), "n", F.col("first.doc_id").alias("first_doc"), F.col("first.ord").alias("first_ord"))


def count_by_page(detections: DataFrame, manual: DataFrame) -> DataFrame:
    """Rows (doc_id, page, detections, manual)."""
    a = detections.groupBy("doc_id", "page").agg(F.count("*").alias("n_detections"))
    b = manual.groupBy("doc_id", "page").agg(F.count("*").alias("n_manual"))
    return a.join(b, ["doc_id", "page"], "full").na.fill(0, ["n_detections", "n_manual"])


def included_summary(detections: DataFrame, manual: DataFrame) -> DataFrame:
    """Rows (doc_id, included, total, zones) of the documents with detections."""
    a = detections.groupBy("doc_id").agg(F.count_if("included").alias("n_included"), F.count("*").alias("n_total"))
    b = manual.groupBy("doc_id").agg(F.count("*").alias("n_manual"))
    return a.join(b.hint("merge"), "doc_id", "left").select("doc_id", "n_included", "n_total", (F.col("n_included") + F.coalesce("n_manual", F.lit(0))).alias("n_zones"))


def type_label(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[kind], kind)


def page_label(page: Column, is_scanned: Column) -> Column:
    return F.concat(F.lit("Page "), (page + 1).cast("string"), F.when(is_scanned, " · OCR").otherwise(""))


def preview_percent(b: Column) -> Column:
    return F.struct(*((b[c] * 100).alias(c) for c in ("x", "y", "width", "height")))
