"""Person names: capitalised sequences, and a provider of known people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPACES
from .patterns import BLOCK, NAME_SEQUENCE, PATTERNS
from .spans import HITS, find_all, find_literal, let, merge_spans, with_parts

SEQUENCE_CONFIDENCE, PERSON_CONFIDENCE = 0.55, 0.65
# Fixed values, lower case: words that no name holds, and places that are no names.
STOP_WORDS = (
    "le", "la", "les", "un", "une", "des", "de", "du", "et", "ou", "mais", "donc", "or", "ni", "car", "ce", "cette", "ces",
    "cher", "chère", "bonjour", "cordialement", "merci", "fait", "paris", "france",
    "article", "chapitre", "annexe", "section", "objet", "note", "rapport",
)
PLACES = (
    "clermont-ferrand", "saint-étienne", "saint-etienne", "aix-en-provence", "boulogne-billancourt", "saint-denis", "villeneuve-d'ascq",
    "châlons-en-champagne", "chalons-en-champagne", "le havre", "le mans", "la rochelle", "saint-nazaire", "saint-malo",
    "issy-les-moulineaux", "neuilly-sur-seine", "levallois-perret", "charleville-mézières", "charleville-mezieres", "château-thierry", "chateau-thierry",
)
#: Given names of the built-in provider; a capitalised word after one belongs to the person.
GIVEN_NAMES = ("Camille", "Jean", "Marie", "Paul", "Julien", "Claire", "Sophie", "Pierre", "Louis", "Anne")


def is_place(candidate: Column, places: Column | None = None) -> Column:
    """Whether a candidate is or ends in a known place, whatever the case, or is or ends in a word of a page's own ``places``
    (an array, as a provider reports them; the case counts)."""
    low = F.lower(candidate)
    known = low.isin(*PLACES)
    for p in PLACES:
        known = known | low.endswith(p)
    if places is None:
        return known
    ends = lambda p: (p != "") & ((candidate == p) | candidate.endswith(F.concat(F.lit(" "), p)))
    return known | F.coalesce(F.exists(places, ends), F.lit(False))


def is_name(candidate: Column, places: Column | None = None) -> Column:
    """Whether a capitalised sequence may be a name: no stop word, three words at most, not all capitals, no place at its end."""
    words = F.split(F.lower(candidate), rf"[{SPACES}\-]+")
    return ~F.exists(words, lambda w: w.isin(*STOP_WORDS)) & (F.size(words) <= 3) & candidate.rlike("[a-zà-ÿ]") & ~is_place(candidate, places)


def name_candidates(text: Column, places: Column | None = None) -> Column:
    """Capitalised sequences that may be names: array of (occ, x, start, end, before, after). A rejected sequence is not searched again."""
    return F.when(text.rlike("[A-ZÀ-Ý]"), F.filter(find_all(text, NAME_SEQUENCE), lambda m: is_name(m["x"], places)))


def lexicon_people(text: Column, given: Sequence[str] = GIVEN_NAMES) -> Column:
    """The built-in provider: a given name and the capitalised word after it, each distinct text once (array of strings)."""
    rule = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(given)})(?: \p{{Lu}}[\p{{L}}'’\-]+)?(?![\p{{L}}\p{{N}}])"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rule), F.lit(0)))


def with_places(pages: DataFrame, places: DataFrame | None) -> DataFrame:
    """``pages`` with ``places``: the array of the texts (doc_id, page, place) that a provider reports as places of a page."""
    if places is None:
        return pages.withColumn("places", F.array().cast("array<string>"))
    listed = places.where("place is not null").groupBy("doc_id", "page").agg(F.collect_set("place").alias("places"))  # of one page's text
    return pages.join(listed, ["doc_id", "page"], "left").withColumn("places", F.coalesce("places", F.array().cast("array<string>")))


def person_spans(pages: DataFrame, people: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, page, ord, text, start_pos, end_pos, confidence): every occurrence of each person's text on its page.

    ``people``: doc_id, page, seq, person. Those of fewer than two characters,
    known places and the page's own ``places`` are left out. Case counts, word
    boundaries do not. A page's people are gathered first, so that its text is
    sent once.
    """
    listed = people.where(F.length(F.trim("person")) >= 2).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "person"))).alias("people"))
    both = with_places(listed, places).join(pages.select("doc_id", "page", F.col("text").alias("page_text")), ["doc_id", "page"])
    found = F.transform(F.filter("people", lambda p: ~is_place(p["person"], F.col("places"))), lambda p: F.transform(
        F.coalesce(find_literal(F.col("page_text"), p["person"]), F.array().cast(HITS)),
        lambda m: F.struct((p["seq"].cast("long") * 1_000_000 + m["occ"]).alias("ord"), p["person"].alias("text"), m["start"].alias("start_pos"), m["end"].alias("end_pos"))))
    return both.select("doc_id", "page", F.inline(F.flatten(found)), F.lit(PERSON_CONFIDENCE).cast("double").alias("confidence"))


def regex_names(pages: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The same columns for capitalised sequences."""
    listed = pages if places is None else with_places(pages, places)
    hits = listed.select("doc_id", "page", F.inline(name_candidates(F.col("text"), None if places is None else F.col("places"))))
    return hits.select("doc_id", "page", F.col("occ").cast("long").alias("ord"), F.col("x").alias("text"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.lit(SEQUENCE_CONFIDENCE).cast("double").alias("confidence"))


def merge_names(spans: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Merge spans of a page that overlap or touch; rows (doc_id, page, ord, start_pos, end_pos, confidence[, text]).

    A merged span has the highest confidence of its parts and, with
    ``pages``, the text it covers. One shuffle by page.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("start_pos", "ord")
    before = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("island", F.when(F.col("start_pos") <= before, 0).otherwise(1)).withColumn("island", F.sum("island").over(w))
    merged = marked.groupBy("doc_id", "page", "island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.max("confidence").alias("confidence"))
    merged = merged.select("doc_id", "page", (F.col("island") - 1).cast("long").alias("ord"), "start_pos", "end_pos", "confidence")
    if pages is None:
        return merged
    texts = pages.select("doc_id", "page", F.col("text").alias("page_text"))
    return merged.join(texts, ["doc_id", "page"]).select(*merged.columns, F.substring("page_text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")).alias("text"))


def name_matches(text: Column, places: Column | None = None) -> Column:
    """Merged capitalised sequences of a text, row-local: array of MATCH of type ``name``, after those of the rules."""

    def named(merged: Column, part) -> Column:
        return F.transform(merged, lambda m, i: F.struct(
            (i.cast("long") + len(PATTERNS) * BLOCK).alias("ord"), F.lit("name").alias("type"), part(m["start"], m["end"] - m["start"]).alias("text"),
            m["start"].alias("start_pos"), m["end"].alias("end_pos"), F.lit(SEQUENCE_CONFIDENCE).cast("double").alias("confidence"), F.lit("nlp").alias("source")))

    return let(name_candidates(text, places), lambda found: F.when(F.size(found) > 0, with_parts(text, lambda part: let(merge_spans(found), lambda merged: named(merged, part)))))


def detect_names(pages: DataFrame, people: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """Merged names of the pages, as matches of type ``name``; ``people`` adds a provider's persons after the sequences,
    ``places`` takes away what it reports as places.

    Without ``people`` all is row-local (``places`` are joined by page); with
    them, spans are merged over a shuffle by page.
    """
    if people is None:
        listed = pages if places is None else with_places(pages, places)
        return listed.select("doc_id", "page", F.inline(name_matches(F.col("text"), None if places is None else F.col("places"))))
    spans = regex_names(pages, places).unionByName(person_spans(pages, people, places).withColumn("ord", F.col("ord") + BLOCK))
    merged = merge_names(spans, pages)
    return merged.select("doc_id", "page", (F.col("ord") + len(PATTERNS) * BLOCK).alias("ord"), F.lit("name").alias("type"), "text", "start_pos", "end_pos", "confidence", F.lit("nlp").alias("source"))
