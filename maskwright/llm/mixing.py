"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, with_running_totals

#: Words of a block.
BLOCK = 256
#: Blocks of a target from which its source is dealt whole blocks (half a block is then at most 0.025 % of it); smaller
#: sources are dealt single words.
WHOLE = 2048
#: Words and rows of one source in one shard, about; of larger tables more, so that no more shards than MOST_SHARDS are
#: due to the words, and to the rows, of sources that have several.
SHARD_WORDS, SHARD_ROWS, MOST_SHARDS = 2_000_000, 400_000, 200_000
PLAN = ("size", "source_size", "target", "taken", "passes", "start", "span")
WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(seats: int, votes: Sequence[float]) -> list[int]:
    """Seats by highest quotients votes / (2 * seats + 1); ties go to the earlier one.

    Seats that any order of awards gives (all but one or so for each party) are
    given at once, and the quotients decide the rest.
    """
    total = float(sum(votes))
    if seats <= 0 or total <= 0:
        return [0] * len(votes)
    got = [max(0, int(seats * v / total - 1)) for v in votes]
    while sum(got) > seats:  # not more than rounding could give
        got[got.index(max(got))] -= 1
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def count_words(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def highest_quotients(sources: DataFrame, votes: str, order: str, seats: int) -> DataFrame:
    """``sources`` with ``seats``, as ``sainte_lague`` gives them for the column ``votes``, ties by the column ``order``.

    A party has as many seats as votes / divisor rounded; the divisor that
    hands out all of them is found by sums over a grid that narrows. Where no
    divisor does, because quotients are equal, the next seats go by quotient
    and order. The parties stay distributed.
    """
    v = F.col(votes)
    rounded = lambda d: F.when(v > 0, F.floor(v / d + 0.5)).otherwise(0).cast("long")
    top = sources.agg(F.max(votes)).first()[0] or 0.0
    if seats <= 0 or top <= 0:
        return sources.withColumn("seats", F.lit(0).cast("long"))
    many, few = top / (4.0 * seats), 4.0 * top  # divisors: at the first at least the largest party takes more than all, at the second nobody has any
    while True:
        grid = [many * (few / many) ** (k / 64) for k in range(1, 64)] if few > 2 * many else [many + (few - many) * k / 64 for k in range(1, 64)]
        given = sources.agg(*(F.sum(rounded(F.lit(d))) for d in grid)).first()
        hit = next((d for d, g in zip(grid, given, strict=True) if g == seats), None)
        if hit is not None:
            return sources.withColumn("seats", rounded(F.lit(hit)))
        low = max([many, *(d for d, g in zip(grid, given, strict=True) if g > seats)])
        high = min([few, *(d for d, g in zip(grid, given, strict=True) if g < seats)])
        if (low, high) == (many, few) or high <= low * (1 + 1e-13):
            break
        many, few = low, high
    got = sources.withColumn("seats", rounded(F.lit(few)))
    left = seats - got.agg(F.sum("seats")).first()[0]
    next_ = got.where(v > 0).orderBy(F.desc(v / (2 * F.col("seats") + 1)), order).limit(left).select(F.col(order).alias("__next"))
    return got.join(next_, F.col(order) == F.col("__next"), "left").withColumn("seats", F.col("seats") + F.when(F.col("__next").isNotNull(), 1).otherwise(0)).drop("__next")


def targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """``sources`` (n: size, place: 0-based rank) with ``target``: all sizes shared by the weights in turn; a target stops at
    ``cap`` times its size, and the excess is reshared until none is above.

    What a unit of weight gets grows while sources reach their cap, so the
    capped ones are those that this unit takes beyond it: a sum for each step.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    both = sources.withColumn("weight", weight)
    most = F.col("n").cast("double") * float(cap)
    unit = None
    while True:
        full = F.lit(False) if unit is None else F.col("weight") * unit > most
        total, held, free = both.agg(F.sum(F.col("n").cast("double")), F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = float("inf") if not free else max(0.0, total - held) / free
        if new == unit or new == float("inf"):
            unit = new
            break
        unit = new
    return both.withColumn("target", most if unit == float("inf") else F.least(most, F.col("weight") * unit)).drop("weight")


def mix_plan(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """What a mix takes of each document.

    Rows (id_col, size, source_size, target double, taken, passes, start, span:
    long): ``taken`` = ``passes`` whole copies and ``span`` words of one more,
    from word ``start`` on (it may wrap round to the first word).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    all words; a target stops at ``cap`` times its source. Sainte-Lague gives
    each source its number of equal-token blocks, of single words to sources
    that whole blocks would not come near enough. Each source's documents are dealt
    to shards by a seeded hash and, in seeded order, form a stream of blocks.
    Sainte-Lague gives each shard an integer quota of its source's blocks;
    whole rounds of a shard's blocks give passes, and the rest is a run of
    blocks from a seeded place in the stream.

    A null or blank text has no words: it takes 0, and a source with no words
    has target 0. Ids may be null or repeat: repeated rows are rows of their
    own. An empty table gives no rows. One source may hold any share of the
    rows: its shards grow with its words and its rows. Sources stay
    distributed, however many there are.
    """
    rows = materialize(docs.select(F.col(id_col).alias("__id"), *_keys(F.col(id_col), F.col(text_col), F.col(source_col), seed)), "words")
    placed = _place(rows, rows, weights, cap, seed)
    return placed.select(F.col("__id").alias(id_col), *(F.col(f"__{c}").alias(c) for c in PLAN))


def _keys(id_: Column, text: Column, source: Column, seed: int) -> list[Column]:
    key = F.when(source.isNotNull(), F.concat(F.lit("a"), source.cast("string"))).otherwise("b")  # null is last
    return [id_.alias("__draw_id"), key.alias("__source"), count_words(text).alias("__size"), F.xxhash64(F.lit(seed), id_, text).alias("__draw")]


def source_plan(narrow: DataFrame, weights: Sequence[float], cap: int) -> DataFrame:
    """Rows (__source, __source_size, __target, __due, __unit, __shards), one for each source of ``narrow``.

    ``__due`` is what Sainte-Lague awards to the source: blocks of BLOCK words
    among the sources with targets of WHOLE blocks or more, single words among
    the others. ``__unit`` is the size of the blocks that are dealt to its
    shards: BLOCK, or less where the source is small.
    """
    by_source = materialize(narrow.groupBy("__source").agg(F.sum("__size").alias("n"), F.count("*").alias("rows")), "sources")
    ranked = with_running_totals(by_source, ["__source"], {}, "place")
    aimed = materialize(targets(ranked, weights, cap), "targets")
    large = F.col("target") >= WHOLE * BLOCK
    of_large, of_small, words, rows = (v or 0 for v in aimed.agg(F.sum(F.when(large, F.col("target"))), F.sum(F.when(~large, F.col("target"))), F.sum("n"), F.sum("rows")).first())
    seated = highest_quotients(aimed.where(large), "target", "place", round(of_large / BLOCK)).withColumn("words", F.lit(BLOCK))
    seated = seated.unionByName(highest_quotients(aimed.where(~large), "target", "place", round(of_small)).withColumn("words", F.lit(1)))
    due = F.least(F.col("seats") * F.col("words"), F.col("n") * cap)
    shards = F.greatest(F.lit(1), F.ceil(F.col("n") / max(SHARD_WORDS, words / MOST_SHARDS)), F.ceil(F.col("rows") / max(SHARD_ROWS, rows / MOST_SHARDS))).cast("long")
    plan = seated.withColumn("due", due).withColumn("shards", shards)
    unit = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("due") / (256 * F.col("shards"))))).cast("long")
    return materialize(plan.select("__source", F.col("n").alias("__source_size"), F.col("target").alias("__target"), F.col("due").alias("__due"), unit.alias("__unit"), F.col("shards").alias("__shards")), "plan")


def _place(rows: DataFrame, narrow: DataFrame, weights: Sequence[float], cap: int, seed: int) -> DataFrame:
    """``rows`` with the PLAN columns (names with two underscores before); ``narrow`` has their keys, read twice.

    ``rows`` is shuffled once, by source and shard: the quotas' join and the
    window take the same partitioning. A row's shard needs its source's number
    of shards; the sources with more than one shard, MOST_SHARDS * 2 at most,
    are broadcast.
    """
    plan = source_plan(narrow, weights, cap)
    many = F.broadcast(plan.where("__shards > 1").select(F.col("__source").alias("__s"), F.col("__shards").alias("__n")))
    deal = lambda df: df.join(many, F.col("__source") == F.col("__s"), "left").withColumn("__shard", F.coalesce(F.expr("pmod(__draw, __n)"), F.lit(0).cast("long"))).drop("__s", "__n")
    streams = deal(narrow).groupBy("__source", "__shard").agg(F.sum("__size").alias("__words")).join(plan, "__source")

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__shard")
        first = pdf.iloc[0]
        unit, due, words = int(first["__unit"]), int(first["__due"]), pdf["__words"].to_numpy()
        asked = np.array(sainte_lague(due // unit, [float(w) for w in words]), np.int64) * unit
        asked[int(words.argmax())] += due % unit  # the last block is short
        if due == cap * words.sum():
            asked = cap * words
        return pdf.assign(__asked=np.minimum(asked, cap * words)).drop(columns=["__due", "__shards"])

    # one row for each shard of a source, made from sums
    told = "__source string, __shard long, __words long, __source_size long, __target double, __unit long, __asked long"
    whole = streams.where("__shards = 1").withColumn("__asked", F.col("__due")).select(*(c.split()[0] for c in told.split(", ")))
    quotas = whole.unionByName(streams.where("__shards > 1").groupBy("__source").applyInPandas(share, told))
    both = deal(rows).join(quotas.hint("merge"), ["__source", "__shard"])
    order = Window.partitionBy("__source", "__shard").orderBy("__draw", "__draw_id").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__at", F.sum("__size").over(order) - F.col("__size"))
    size, words, at, asked = F.col("__size"), F.col("__words"), F.col("__at"), F.col("__asked")
    # The quota asks for whole rounds of the shard's stream and a run that starts at a seeded block and may wrap.
    begin = F.expr(f"pmod(xxhash64({seed}, __shard, __source), greatest(__words div __unit, 1)) * __unit")
    both = both.withColumn("__passes", F.when(words > 0, F.floor(asked / F.greatest(words, F.lit(1)))).otherwise(0).cast("long"))
    rest = F.when(words > 0, asked - F.col("__passes") * words).otherwise(0)
    overlap = lambda lo, hi: F.greatest(F.least(at + size, hi) - F.greatest(at, lo), F.lit(0))
    head, tail = overlap(begin, F.least(begin + rest, words)), overlap(F.lit(0), begin + rest - words)
    return (
        both.withColumn("__span", (head + tail).cast("long"))
        .withColumn("__start", F.when(head > 0, F.greatest(begin - at, F.lit(0))).otherwise(0).cast("long"))
        .withColumn("__taken", F.col("__passes") * size + F.col("__span"))
    )


def apply_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3, seed: int = 17) -> DataFrame:
    """``docs`` (doc_id, text, source and any more) as the mix takes them: the same columns, a row for each whole
    copy and one for a part.

    A part keeps the words from ``start`` on, with the white space between
    them. Documents that the mix takes no word of go, and so do null and blank
    texts. n_chars, where present, follows the new text. Ids and sources may be
    null (a null source is a source of its own); repeated rows are rows of
    their own; ties in the seeded order go by id, and equal rows are
    interchangeable; an empty table gives no rows.
    """
    keys = _keys(docs["doc_id"], docs["text"], docs["source"], seed)
    narrow = materialize(docs.select(*keys), "words")
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("__row")
    both = _place(docs.select(whole, *keys), narrow, weights, cap, seed).where("__passes > 0 or __span > 0")
    size, start, span, text = F.col("__size"), F.col("__start"), F.col("__span"), F.col("__row.text")
    both = both.withColumn("__part", F.explode(F.concat(F.array_repeat(F.lit(False), F.col("__passes").cast("int")), F.array_repeat(F.lit(True), F.when(span > 0, 1).otherwise(0)))))
    # words start .. start + span with the white space after each, wrapping to the first ones
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    ahead = F.least(span, size - start)
    part = F.concat(
        F.array_join(F.slice(words, (start + 1).cast("int"), ahead.cast("int")), ""),
        F.when(span > ahead, " ").otherwise(""),
        F.array_join(F.slice(words, F.lit(1), (span - ahead).cast("int")), ""),
    )
    both = both.withColumn("__text", F.when(F.col("__part"), part).otherwise(text))
    new = {"text": F.col("__text"), "n_chars": F.length("__text")}
    return both.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("__row")[c].alias(c) for c in docs.columns))
