"""The findings of a file as one JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.redact import output_name

# Characters that a URI component keeps and the encoder here does not, and how the encoder writes them.
_KEPT = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def uri_component(text: Column) -> Column:
    """A text percent-encoded as a URI component: letters, digits and ``-_.!~*'()`` stay."""
    out = F.url_encode(text)
    for written, kept in _KEPT.items():
        out = F.replace(out, F.lit(written), F.lit(kept))
    return out


def attachment_header(name: Column) -> Column:
    """The header under which a redacted file is offered for download."""
    return F.concat(F.lit('attachment; filename="'), uri_component(output_name(name)), F.lit('"'))


def responses(files: DataFrame, pages: DataFrame, detections: DataFrame, mode: str = "regex") -> DataFrame:
    """Rows (doc_id, json), one for each file: its name, pages, detections and the mode.

    ``files``: doc_id, name. ``pages``: doc_id, page, width, height, is_scanned
    and, optionally, image (a data URL). ``detections`` as ``layout.detections``
    gives them. Pages are in order; detections by page, start, ordinal and
    cluster. A file without pages or findings has empty lists. A document's
    pages and findings meet in one row.
    """
    image = [F.col("image").alias("imageDataUrl")] if "image" in pages.columns else []
    page = F.struct(F.col("page").alias("index"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), *image, F.col("is_scanned").alias("isScanned"))
    finding = F.struct("page", "start_pos", "ord", "cluster", F.struct("id", "page", "type", "text", "box", "confidence", "source").alias("d"))
    by_file = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    found = detections.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(finding)), lambda x: x["d"]).alias("detections"))
    both = files.select("doc_id", "name").join(by_file.hint("merge"), "doc_id", "left").join(found.hint("merge"), "doc_id", "left")
    lists = [F.coalesce(c, F.array().cast(kind.dataType)).alias(c) for c, kind in (("pages", by_file.schema["pages"]), ("detections", found.schema["detections"]))]
    return both.select("doc_id", F.to_json(F.struct(F.col("name").alias("fileName"), *lists, F.lit("ai" if mode == "ai" else "regex").alias("mode"))).alias("json"))


def write_responses(rows: DataFrame, path: str) -> None:
    """One JSON text a line."""
    rows.select("json").write.mode("overwrite").text(path)
