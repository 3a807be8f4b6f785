"""Whole detection plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import dedupe_exact, dedupe_nested, unnested
from ..operators.model_matches import model_matches
from ..operators.names import detect_names, name_matches
from ..operators.patterns import detect_patterns, pattern_matches
from ..operators.redact import mask_spans
from ..operators.review import INCLUDE_FROM
from ..operators.spans import let


def page_findings(text: Column) -> Column:
    """Rules and names of one text without nested matches: array of MATCH, by start and ordinal. Row-local."""
    return unnested(F.concat(pattern_matches(text), F.coalesce(name_matches(text), pattern_matches(F.lit("")))))


def detect_regex_mode(pages: DataFrame, people: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """Rules and names of ``pages`` (doc_id, page, text), without nested matches.

    One narrow stage from the scan to the findings. A provider's ``people``
    and ``places`` are joined by page, and then the nested matches go over a
    shuffle of the matches.
    """
    if people is None and places is None:
        return pages.select("doc_id", "page", F.inline(page_findings(F.col("text"))))
    return dedupe_nested(detect_patterns(pages).unionByName(detect_names(pages, people, places)))


def detect_hybrid_mode(pages: DataFrame, replies: DataFrame) -> DataFrame:
    """Rules and a text model's findings; names come from the model alone. Equal findings of both are one."""
    return dedupe_nested(dedupe_exact(detect_patterns(pages).unionByName(model_matches(pages, replies))))


def detect(pages: DataFrame, mode: str = "regex", replies: DataFrame | None = None, people: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """``mode`` "ai" is the hybrid one; any other value is "regex", and so is "ai" without replies."""
    return detect_hybrid_mode(pages, replies) if mode == "ai" and replies is not None else detect_regex_mode(pages, people, places)


def redact_pages(pages: DataFrame, include_from: float = INCLUDE_FROM) -> DataFrame:
    """``pages`` with every finding of at least ``include_from`` masked, in the same narrow stage; other columns stay."""
    text = F.col("text")
    spans = let(page_findings(text), lambda ms: F.transform(F.filter(ms, lambda m: m["confidence"] >= F.lit(include_from).cast("double")), lambda m: F.struct(m["start_pos"].alias("start_pos"), m["end_pos"].alias("end_pos"))))
    return pages.withColumn("text", mask_spans(text, spans))
