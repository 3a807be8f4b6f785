"""The rule catalogue, and its application to texts as one row-local table function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import BOUNDARY, LEAD, SPACES, TRAIL, WS
from ..functions.iban import iban_valid
from .spans import find_all

INVALID_FACTOR = 0.85
BIRTH_CONFIDENCE, BIRTH_WINDOW = 0.7, 12
#: Fixed value: what stands before a date of birth.
BIRTH_CONTEXT = rf"{LEAD}(?iu:n[ée]e?){WS}+(?iu:le{WS}+)?\z"


@dataclass(frozen=True)
class Pattern:
    """A rule: its matches are findings of ``type`` with ``confidence``.

    ``may`` is a cheap necessary condition on a text, ``valid`` an optional
    check of a match, as column functions. A failed check lowers the
    confidence; it does not drop the match.
    """

    key: str
    type: str
    label: str
    regex: str
    confidence: float
    may: Callable[[Column], Column]
    valid: Callable[[Column], Column] | None = None


def _digit(t: Column) -> Column:
    return t.rlike("[0-9]")


# Month names and street words of the rules.
_MONTHS = "janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre"
_STREETS = r"rue|avenue|av\.?|boulevard|bd\.?|impasse|allée|chemin|place|route|quai|square|cours|voie|lieu-dit"
_SEP = rf"[{SPACES}.\-]"
_DAY = "(?:0?[1-9]|[12][0-9]|3[01])"

# The rules' order, types, labels, formats and confidences.
PATTERNS: list[Pattern] = [
    Pattern("email", "email", "Adresse email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", 0.98, lambda t: t.contains("@")),
    Pattern("phone_fr", "phone", "Téléphone (FR)", rf"(?:(?:\+33|0033){_SEP}?[1-9]|0[1-9])(?:{_SEP}?[0-9]{{2}}){{4}}", 0.9, lambda t: t.rlike(r"(?:\+33|0)[^a-z]{0,2}[1-9]")),
    Pattern("phone_intl", "phone", "Téléphone (international)", rf"\+[0-9]{{1,3}}(?:{_SEP}?[0-9]{{2,4}}){{2,5}}", 0.75, lambda t: t.contains("+")),
    Pattern("iban", "iban", "IBAN", rf"{LEAD}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?{TRAIL}", 0.85, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), iban_valid),
    Pattern("nir", "nir", "Numéro de sécurité sociale",
            rf"{LEAD}[12]{WS}?[0-9]{{2}}{WS}?(?:0[1-9]|1[0-2]|20|30|4[0-9]){WS}?(?:[0-9]{{2}}|2[ABab]){WS}?[0-9]{{3}}{WS}?[0-9]{{3}}(?:{WS}?[0-9]{{2}})?{TRAIL}", 0.85, _digit),
    Pattern("date_num", "date_naissance", "Date (numérique)", rf"{LEAD}{_DAY}[/.\-](?:0?[1-9]|1[0-2])[/.\-](?:[0-9]{{4}}|[0-9]{{2}}){TRAIL}", 0.35, lambda t: t.rlike(r"[0-9][/.\-][0-9]")),
    Pattern("date_lit", "date_naissance", "Date (littérale)", rf"{LEAD}{_DAY}{WS}+(?iu:{_MONTHS}){WS}+[0-9]{{4}}{TRAIL}", 0.4, _digit),
    Pattern("address", "postal_address", "Adresse postale",
            rf"{LEAD}[0-9]{{1,4}}(?:{WS}?(?iu:bis|ter|quater))?{WS}+(?iu:{_STREETS}){WS}+[A-Za-zÀ-ÖØ-öø-ÿŸ0-9'’.\- ]{{2,60}}", 0.5, _digit),
    Pattern("postal_code", "postal_code", "Code postal", rf"{LEAD}[0-9]{{5}}{TRAIL}", 0.3, _digit),
    Pattern("generic_id", "custom", "Identifiant générique", rf"{LEAD}(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{{8,20}}{TRAIL}", 0.25, _digit),
]
#: Fixed value: a capitalised or all-capitals word, and two or three of them.
_NAME_WORD = "(?:[A-ZÀ-Ý][a-zà-ÿ'’]+|[A-ZÀ-Ý][A-ZÀ-Ý'’]+)"
NAME_SEQUENCE = rf"{BOUNDARY}{_NAME_WORD}(?:[{SPACES}\-]+{_NAME_WORD}){{1,2}}{BOUNDARY}"

#: Display names of the types.
LABELS = {
    "email": "Email", "phone": "Téléphone", "iban": "IBAN", "nir": "Sécurité sociale", "postal_address": "Adresse",
    "postal_code": "Code postal", "date_naissance": "Date", "date": "Date", "name": "Nom / Prénom", "custom": "Identifiant",
}


def register_pattern(pattern: Pattern) -> None:
    """Add a rule to the end of the catalogue; its matches come after those of the rules before it."""
    if any(p.key == pattern.key for p in PATTERNS):
        raise ValueError(f"pattern {pattern.key!r} exists")
    PATTERNS.append(pattern)


def birth_context(text: Column, start: Column) -> Column:
    """Whether a date's start follows the words that announce a date of birth, within the window."""
    return F.substring(text, F.greatest(F.lit(1), start - BIRTH_WINDOW + 1), F.least(F.lit(BIRTH_WINDOW), start)).rlike(BIRTH_CONTEXT)


def confidence(p: Pattern, m: Column) -> Column:
    """The confidence of a match of ``find_all``: lowered by a failed check, raised by a birth context (what announces a
    date stands between the match before it and the date)."""
    c = F.lit(p.confidence).cast("double")
    if p.valid is not None:
        c = F.when(p.valid(m["x"]), c).otherwise(c * F.lit(INVALID_FACTOR).cast("double"))
    if p.type == "date_naissance":
        c = F.when(F.right(F.concat(m["prior"], m["before"]), F.lit(BIRTH_WINDOW)).rlike(BIRTH_CONTEXT), F.greatest(c, F.lit(BIRTH_CONFIDENCE).cast("double"))).otherwise(c)
    return c


MATCH = "struct<ord:bigint,type:string,text:string,start_pos:int,end_pos:int,confidence:double,source:string>"
#: Ordinals: rule number times this, plus the occurrence.
BLOCK = 1_000_000_000


def pattern_matches(text: Column, patterns: list[Pattern] | None = None, strict: bool = False) -> Column:
    """All matches of the rules in a text, in rule order: array of MATCH. ``strict`` drops those that fail their check."""
    parts = []
    for k, p in enumerate(PATTERNS if patterns is None else patterns):
        def shape(m: Column, k: int, p: Pattern) -> Column:
            return F.struct(
                (m["occ"].cast("long") + k * BLOCK).alias("ord"), F.lit(p.type).alias("type"), m["x"].alias("text"), m["start"].alias("start_pos"), m["end"].alias("end_pos"),
                confidence(p, m).alias("confidence"), F.lit("regex").alias("source"))

        found = find_all(text, p.regex)
        if strict and p.valid is not None:
            found = F.filter(found, _valid(p))
        parts.append(F.when(p.may(text), F.transform(found, _bound(shape, k, p))))
    empty = F.from_json(F.lit("[]"), f"array<{MATCH}>")
    return F.concat(empty, *(F.coalesce(x, empty) for x in parts))


def _bound(shape, k: int, p: Pattern):
    return lambda m: shape(m, k, p)


def _valid(p: Pattern):
    return lambda m: p.valid(m["x"])


def detect_patterns(pages: DataFrame, patterns: list[Pattern] | None = None, strict: bool = False) -> DataFrame:
    """Rows (doc_id, page, MATCH...) of ``pages`` (doc_id, page, text), one for each match. No shuffle."""
    return pages.select("doc_id", "page", F.inline(pattern_matches(F.col("text"), patterns, strict)))


def pattern(key: str) -> Pattern:
    return next(p for p in PATTERNS if p.key == key)
