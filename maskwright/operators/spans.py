"""All positions of a pattern or a literal in a text, as a column.

Offsets are half-open, 0-based and count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK, _RUN = 256, 1024
#: What find_all gives.
HITS = "array<struct<occ:int,x:string,start:int,end:int,before:string,after:string,prior:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(rows: Column, state: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array the state after it: ``step(state before, element)``, from ``state`` of SQL type ``kind``.

    States are gathered in blocks, and the blocks in turn: an append copies a
    block's list and not all states so far, so time is linear in the elements.
    """

    def block(first: Column, part: Column) -> Column:
        start = F.struct(first.alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, start, lambda a, x: let(step(a["s"], x).cast(kind), lambda s: F.struct(s.alias("s"), F.concat(a["out"], F.array(s)).alias("out"))))

    def blocks(rows: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _BLOCK).cast("int"))
        start = F.struct(state.cast(kind).alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        done = F.aggregate(numbers, start, lambda a, b: let(block(a["s"], F.slice(rows, b * _BLOCK + 1, F.lit(_BLOCK))), lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out"))))
        return F.flatten(done["out"])

    return let(rows, lambda r: F.when(F.size(r) > 0, blocks(r)).otherwise(F.array().cast(f"array<{kind}>")))


def with_parts(text: Column, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``body`` of a function (start, length) -> part of ``text``, for many parts of a long text: a part is taken from the
    runs of _RUN characters that hold it, and not from the text's first character on."""

    def taking(runs: Column) -> Callable[[Column, Column], Column]:
        def part(start: Column, n: Column) -> Column:
            first = F.floor(start / _RUN).cast("int")
            count = F.greatest(F.floor((start + n - 1) / _RUN).cast("int") - first + 1, F.lit(0))
            return F.substring(F.array_join(F.slice(runs, first + 1, count), ""), start - first * _RUN + 1, n)

        return part

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_RUN}}}"), F.lit(0)), lambda runs: body(taking(runs)))


def find_all(text: Column, pattern: str | Column, found: Column | None = None) -> Column:
    """The leftmost non-overlapping matches of ``pattern`` in ``text``: array of (occ, x, start, end, before, after, prior).

    ``before`` and ``after`` are the texts between this match and its
    neighbours, ``prior`` is the match before it (none: empty). The pattern cuts the text into gaps; ends are running sums
    over gaps and matches. ``found``: the matches, if they are known without
    the pattern.
    """

    def place(rows: Column) -> Column:
        ends = running(rows, F.lit(0), "int", lambda a, r: a + r["gap"] + r["n"])
        return let(ends, lambda e: F.transform(rows, lambda r, i: F.struct(
            i.alias("occ"), r["x"].alias("x"), (F.get(e, i) - r["n"]).alias("start"), F.get(e, i).alias("end"), r["before"].alias("before"), r["after"].alias("after"), r["prior"].alias("prior"))))

    rule = F.lit(pattern) if isinstance(pattern, str) else pattern
    cut = F.struct((F.regexp_extract_all(text, rule, F.lit(0)) if found is None else found).alias("m"), F.split(text, rule, -1).alias("g"))
    rows = let(cut, lambda c: F.transform(c["m"], lambda x, i: F.struct(
        F.length(F.get(c["g"], i)).alias("gap"), F.length(x).alias("n"), x.alias("x"), F.get(c["g"], i).alias("before"), F.get(c["g"], i + 1).alias("after"), F.coalesce(F.get(c["m"], i - 1), F.lit("")).alias("prior"))))
    return let(rows, lambda r: F.when(F.size(r) > 0, place(r)))


def find_literal(text: Column, literal: Column) -> Column:
    """As ``find_all`` for every non-overlapping occurrence of a literal column; an empty literal occurs nowhere."""
    inside = F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))  # the end mark of a quotation, quoted by itself
    rule = F.concat(F.lit("\\Q"), inside, F.lit("\\E"))
    times = lambda: F.size(F.split(text, rule, -1)) - 1
    return F.when((F.length(literal) > 0) & F.contains(text, literal), find_all(text, rule, F.array_repeat(literal, times())))


def merge_spans(spans: Column, touching: bool = True) -> Column:
    """Spans (start, end, more fields) sorted by start, merged where they overlap (or touch): array of (first, start, end),
    ``first`` being the first one's place in ``spans``."""
    joins = lambda a, m: (a["end"] >= 0) & ((m["start"] <= a["end"]) if touching else (m["start"] < a["end"]))
    before = F.struct(F.lit(-1).alias("place"), F.lit(-1).alias("first"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

    def step(a: Column, m: Column) -> Column:
        on = joins(a, m)
        return F.struct(
            (a["place"] + 1).alias("place"), F.when(on, a["first"]).otherwise(a["place"] + 1).alias("first"),
            F.when(on, a["start"]).otherwise(m["start"]).alias("start"), F.when(on, F.greatest(a["end"], m["end"])).otherwise(m["end"]).alias("end"))

    states = running(spans, before, "struct<place:int,first:int,start:int,end:int>", step)
    # a merged span is complete where the next state has another first one
    last = lambda s: F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["first"] != x["first"]))
    return F.transform(let(states, last), lambda x: F.struct(x["first"].alias("first"), x["start"].alias("start"), x["end"].alias("end")))
