"""Boxes as columns: normalised, origin at the top left, x, y, width, height from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,width:double,height:double>"


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def _or_else(*values: Column) -> Column:
    """The first value that is neither null, NaN nor zero; the last as it is."""
    return F.coalesce(*(F.nullif(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) for v in values[:-1]), values[-1])


def run_box(transform: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Box of a glyph run from its transform; missing or zero sizes fall back to the font height, or 10, and to 1."""
    t = [F.get(transform, F.lit(i)) for i in range(6)]
    font = _or_else(F.hypot(t[2], t[3]), F.abs(t[3]), F.lit(10.0))
    w, h = _or_else(width, F.lit(1.0)), _or_else(height, font)
    return box(
        F.greatest(F.lit(0.0), t[4] / page_width),
        F.greatest(F.lit(0.0), (page_height - t[5] - h * F.lit(0.8).cast("double")) / page_height),
        F.least(F.lit(1.0), w / page_width),
        F.least(F.lit(1.0), h / page_height),
    )


def word_box(x0: Column, y0: Column, x1: Column, y1: Column, img_width: Column, img_height: Column) -> Column:
    """Box of a word found in an image, from its pixels."""
    return box(x0 / img_width, y0 / img_height, (x1 - x0) / img_width, (y1 - y0) / img_height)


def sub_box_uniform(b: Column, item_start: Column, item_end: Column, start: Column, end: Column) -> Column:
    """The part of an item's box that [start, end) covers, all characters as wide, one more on either side."""
    length = item_end - item_start
    lo = F.greatest(F.lit(0.0), (F.greatest(start, item_start) - item_start - 1) / length)
    hi = F.least(F.lit(1.0), (F.least(end, item_end) - item_start + 1) / length)
    return F.when(length <= 0, b).otherwise(box(b["x"] + lo * b["width"], b["y"], (hi - lo) * b["width"], b["height"]))


def sub_box_measured(b: Column, full: Column, prefix: Column, match: Column, margin: Column) -> Column:
    """The same from measured widths of the item, of what stands before the match, and of the match."""
    lo = F.greatest(F.lit(0.0), prefix - margin) / full
    hi = F.least(full, prefix + match + margin) / full
    return box(b["x"] + lo * b["width"], b["y"], (hi - lo) * b["width"], b["height"])


#: Advance widths of a public sans-serif font's ASCII characters from space on, in thousandths of its size.
ADVANCES = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
#: Half the width of a wide letter: what a measured box is widened by on either side.
MARGIN = ADVANCES[ord("M") - 32] / 2


#: Accented letters, and the letters that they measure as.
_ACCENTED = ("àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def text_advance(text: str) -> int:
    """As ``measure_text``, of one string."""
    base = text.translate(str.maketrans(*_ACCENTED)).replace("\n", "")
    return sum(ADVANCES[ord(c) - 32] if 0 <= ord(c) - 32 < len(ADVANCES) else 556 for c in base)


def measure_text(text: Column) -> Column:
    """Width of a text in thousandths of the font size; accented letters measure as their base letter, others as 556."""
    base = F.translate(text, *_ACCENTED)
    widths = F.array(*map(F.lit, ADVANCES))
    return F.aggregate(F.split(base, ""), F.lit(0), lambda a, c: a + F.when(c.isin("", "\n"), 0).otherwise(F.coalesce(F.get(widths, F.ascii(c) - 32), F.lit(556)))).cast("double")
