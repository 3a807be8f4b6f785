"""Pages of text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_pages(table: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Rows (doc_id, page, text, kept columns): each row of a text table is a document of one page."""
    return table.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("page"), F.col(text_col).alias("text"), *keep)
