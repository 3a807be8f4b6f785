"""The relations of a detection as temporary views, for use from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, patterns
from . import detect

VIEWS = ("pages", "matches", "findings", "redacted", "rules", "detections")


def register_views(spark: SparkSession, pages: DataFrame, items: DataFrame | None = None, prefix: str = "") -> list[str]:
    """Create views over ``pages`` (doc_id, page, text) and, with ``items``, their detections; returns the names.

    ``matches`` holds all rule matches, ``findings`` what detection keeps,
    ``redacted`` the masked pages, ``rules`` the catalogue. Views are plans:
    nothing is computed before it is read.
    """
    rules = [(k, p.key, p.type, p.label, p.regex, p.confidence, p.valid is not None) for k, p in enumerate(patterns.PATTERNS)]
    findings = detect.detect_regex_mode(pages)
    views = {
        "pages": pages,
        "matches": patterns.detect_patterns(pages),
        "findings": findings,
        "redacted": detect.redact_pages(pages),
        "rules": spark.createDataFrame(rules, "place int, key string, type string, label string, regex string, confidence double, checked boolean"),
    }
    if items is not None:
        views["detections"] = layout.detections(findings, items).withColumn("included", F.col("confidence") >= F.lit(0.5))
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
