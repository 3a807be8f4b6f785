"""Reconciling matches of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import let, running


def dedupe_exact(matches: DataFrame) -> DataFrame:
    """One row for each (type, span) of a page: the highest confidence, the first of equal ones, in the first one's place."""
    key = Window.partitionBy("doc_id", "page", "type", "start_pos", "end_pos")
    ranked = matches.withColumn("__n", F.row_number().over(key.orderBy(F.desc("confidence"), "ord"))).withColumn("__ord", F.min("ord").over(key))
    return ranked.where("__n = 1").select(*(F.col("__ord").alias(c) if c == "ord" else F.col(c) for c in matches.columns))


def dedupe_nested(matches: DataFrame) -> DataFrame:
    """Drop a match that lies within an earlier, larger one of its page (by start, then ordinal).

    Equal spans all stay, and at one start a shorter match before a longer one.
    What is dropped is exactly what ends no later than some match of an
    earlier start, or before some earlier match of its own start; two running
    maxima tell it, over one shuffle by page.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("start_pos").rangeBetween(Window.unboundedPreceding, -1)
    start = Window.partitionBy("doc_id", "page", "start_pos").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    marked = matches.withColumn("__outer", F.max("end_pos").over(page)).withColumn("__same", F.max("end_pos").over(start))
    nested = F.coalesce(F.col("__outer") >= F.col("end_pos"), F.lit(False)) | F.coalesce(F.col("__same") > F.col("end_pos"), F.lit(False))
    return marked.where(~nested).drop("__outer", "__same")


def unnested(matches: Column) -> Column:
    """``dedupe_nested`` of one page's matches in an array of MATCH, by start and ordinal; row-local, in linear time.

    One pass over the sorted array carries the greatest end of earlier starts
    and that of the current start.
    """
    rows = F.array_sort(F.transform(matches, lambda m: F.struct(*(m[c].alias(c) for c in ("start_pos", "ord", "end_pos", "type", "text", "confidence", "source")))))
    before = F.struct(F.lit(-1).alias("outer"), F.lit(-1).alias("at"), F.lit(-1).alias("same"), F.lit(False).alias("nested"))

    def step(a: Column, m: Column) -> Column:
        new = m["start_pos"] != a["at"]
        outer = F.when(new, F.greatest(a["outer"], a["same"])).otherwise(a["outer"])
        same = F.when(new, F.lit(-1)).otherwise(a["same"])
        nested = (outer >= m["end_pos"]) | (same > m["end_pos"])
        return F.struct(outer.alias("outer"), m["start_pos"].alias("at"), F.greatest(same, m["end_pos"]).alias("same"), nested.alias("nested"))

    passed = let(rows, lambda r: let(running(r, before, "struct<outer:int,at:int,same:int,nested:boolean>", step), lambda s: F.filter(r, lambda _, i: ~F.get(s, i)["nested"])))
    return F.transform(passed, lambda m: F.struct(*(m[c].alias(c) for c in ("ord", "type", "text", "start_pos", "end_pos", "confidence", "source"))))
