"""Findings of a text model: model choice, reply parsing, and literal search with word boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import WS
from .patterns import BLOCK, PATTERNS
from .spans import HITS, find_literal

CONFIDENCE = 0.65
PROMPT_CHARS = 6000
#: Types a model may report, and the least trimmed length of a text of each.
LEAST_LENGTH = {"name": 3, "postal_address": 8, "custom": 4}


def pick_model(models: Column, wanted: str | None) -> Column:
    """The wanted model if it is installed (or none is), else the first with ``instruct`` in its name, else the first."""
    want = F.lit(wanted).cast("string")
    installed = F.when(F.array_contains(models, F.coalesce(want, F.lit(""))), want)
    instruct = F.get(F.filter(models, lambda m: m.rlike("(?i)instruct")), F.lit(0))
    return F.when(F.size(models) == 0, F.nullif(want, F.lit(""))).otherwise(F.coalesce(F.nullif(installed, F.lit("")), instruct, F.get(models, F.lit(0))))


def prompt(text: Column, instructions: str) -> Column:
    """Instructions with the start of the text in place of ``{{TEXT}}``."""
    head, _, tail = instructions.partition("{{TEXT}}")
    return F.concat(F.lit(head), F.substring(text, 1, PROMPT_CHARS), F.lit(tail))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def reply_items(replies: DataFrame) -> DataFrame:
    """Rows (doc_id, page, seq, type, candidate) of the usable items of ``replies`` (doc_id, page, raw).

    A reply that is no JSON object with an array ``items`` has none; elements
    that are no objects, have no string text, a type not allowed or a text too
    short are skipped, the others stay.
    """
    items = F.expr("try_variant_get(try_parse_json(raw), '$.items', 'array<variant>')")
    rows = replies.select("doc_id", "page", F.posexplode(items).alias("seq", "item"))
    is_text = F.expr("schema_of_variant(try_variant_get(item, '$.text', 'variant')) = 'STRING'")
    rows = rows.select("doc_id", "page", "seq", is_text.alias("ok"), F.expr("try_variant_get(item, '$.type', 'string')").alias("type"), F.expr("try_variant_get(item, '$.text', 'string')").alias("candidate"))
    least = F.create_map(*(F.lit(x) for kv in LEAST_LENGTH.items() for x in kv))
    return rows.where("ok").where(F.col("type").isin(*LEAST_LENGTH) & (F.length(js_trim(F.col("candidate"))) >= least[F.col("type")])).drop("ok")


def clean_edges(text: Column, start: Column, end: Column) -> Column:
    """Whether a span neither begins nor ends inside a word (of letters and digits of any script)."""
    at = lambda i: F.coalesce(F.substring(text, i, 1), F.lit("")).rlike(r"[\p{L}\p{N}]")
    return ~((start > 0) & at(start) & at(start + 1)) & ~(at(end) & at(end + 1))


def model_matches(pages: DataFrame, replies: DataFrame) -> DataFrame:
    """Matches of the model's items on their pages: every literal occurrence with clean edges; what does not occur drops out.

    A page's items are gathered first, so that its text is sent once, and
    searched in one row.
    """
    items = reply_items(replies).groupBy("doc_id", "page").agg(F.collect_list(F.struct("seq", "type", "candidate")).alias("items"))
    both = items.join(pages.select("doc_id", "page", F.col("text").alias("page_text")), ["doc_id", "page"])
    text = F.col("page_text")

    def hits(item: Column) -> Column:
        clean = F.filter(F.coalesce(find_literal(text, item["candidate"]), F.array().cast(HITS)), lambda m: clean_edges(text, m["start"], m["end"]))
        return F.transform(clean, lambda m: F.struct(
            (F.lit(len(PATTERNS) * BLOCK) + item["seq"].cast("long") * 1_000_000 + m["occ"]).cast("long").alias("ord"), item["type"].alias("type"), item["candidate"].alias("text"),
            m["start"].alias("start_pos"), m["end"].alias("end_pos")))

    found = both.select("doc_id", "page", F.inline(F.flatten(F.transform("items", hits))))
    return found.select("*", F.lit(CONFIDENCE).cast("double").alias("confidence"), F.lit("nlp").alias("source"))
