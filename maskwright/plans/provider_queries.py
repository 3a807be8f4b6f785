"""Registered queries of providers, added rules, sinks and controls, with their SQL. ``queries`` imports this module last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import LEAD, TRAIL
from ..functions.geometry import ADVANCES, MARGIN
from ..operators import layout, names, patterns, redact
from ..sinks import responses
from ..sources import files, models
from . import detect, relations, rules_sql
from .queries import _BARE, _MERGE, _PLACE, AFTER_RULES, CTE, _box, _detections, _files, _overlaps, _pages, _sqlbox, _u, lit, query, spans_sql, sql

MATCH = "doc_id, page, ord, type, text, start_pos, end_pos, confidence, source"

# --- people, places, added rules, prompts

# RE2 cannot look around: each run of letters and digits is put between two marks, which stand for the boundaries.
_MARKED = r"regexp_replace(text, '([\p{L}\p{N}]+)', chr(1) || '\1' || chr(2), 'g')"
# The given names of the built-in provider.
_GIVEN = "Camille|Jean|Marie|Paul|Julien|Claire|Sophie|Pierre|Louis|Anne"
_PERSON = rf"\x01(?:{_GIVEN})\x02(?: \x01\p{{Lu}}\p{{L}}+\x02(?:['’-]+\x01\p{{L}}+\x02)*['’-]*| \x01\p{{Lu}}\x02['’-]+(?:\x01\p{{L}}+\x02['’-]*)*)?"
CTE["people"] = (
    "select doc_id, page, text as page_text, i - 1 as seq, p[i] as person from (select *, unnest(generate_series(1, len(p))) as i from (select doc_id, page, text, list_filter(l, lambda v, i: list_position(l, v) = i) as p"
    f" from (select doc_id, page, text, list_transform(regexp_extract_all({_MARKED}, {lit(_PERSON)}), lambda v: replace(replace(v, chr(1), ''), chr(2), '')) as l from texts)))"
)
CTE["person_hits"] = (
    "select doc_id, page, cast(seq * 1000000 + k - 1 as bigint) as ord, person as text, start_pos, cast(start_pos + length(person) as int) as end_pos, 0.65::double as confidence from"
    " (select *, cast(list_sum(list_transform(g[1:k], lambda z: length(z))) + (k - 1) * length(person) as int) as start_pos from (select *, unnest(generate_series(1, len(g) - 1)) as k from"
    f" (select *, string_split(page_text, person) as g from people where not regexp_matches(lower(person), {_PLACE}))))"
)
CTE["with_people"] = f"select doc_id, page, ord, start_pos, end_pos, confidence from seqs union all select doc_id, page, ord + {rules_sql.BLOCK}, start_pos, end_pos, confidence from person_hits"
CTE["merged_people"] = _MERGE.format("with_people")


def _people(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.posexplode(names.lexicon_people(F.col("text"))).alias("seq", "person"))


@query(sql("select * from person_hits", "person_hits"))
def name_lexicon(spark, d):
    return names.person_spans(_pages(spark, d), _people(_pages(spark, d)))


@query(
    sql(
        f"select doc_id, page, cast({AFTER_RULES} + island - 1 as bigint) as ord, 'name' as type, substr(t.text, m.start_pos + 1, m.end_pos - m.start_pos) as text, m.start_pos, m.end_pos, m.confidence, 'nlp' as source"
        " from merged_people m join texts t using (doc_id, page)",
        "merged_people",
        "texts",
    )
)
def names_with_people(spark, d):
    return names.detect_names(_pages(spark, d), _people(_pages(spark, d)))


_PLACE_OF = "case c_custkey % 5 when 1 then 'Dupont' else 'Petit' end as place"
CTE["page_places"] = f"select c_custkey as doc_id, 0 as page, {_PLACE_OF} from customer"


@query(
    sql(
        "select doc_id, page, ord, text, start_pos, end_pos from seqs s where not exists (select 1 from page_places p where p.doc_id = s.doc_id and p.page = s.page and (s.text = p.place or s.text like '% ' || p.place))",
        "seqs",
        "page_places",
    )
)
def names_without_places(spark, d):
    places = relations.table(spark, d, "customer").selectExpr("c_custkey as doc_id", "0 as page", _PLACE_OF)
    return names.regex_names(_pages(spark, d), places).select("doc_id", "page", "ord", "text", "start_pos", "end_pos")


_ADDED = patterns.Pattern("file_number", "file_number", "Dossier", rf"{LEAD}AB[0-9]{{8}}{TRAIL}", 0.6, lambda t: t.contains("AB"), lambda x: x.endswith("7"))
_ADDED_RE2 = r"\bAB[0-9]{8}\b"


@query(
    sql(
        f"select doc_id, page, cast({AFTER_RULES} + row_number() over (partition by doc_id, page order by start_pos) - 1 as bigint) as ord, x as text, start_pos,"
        f" case when x like '%7' then 0.6::double else 0.6::double * 0.85::double end as confidence from ({spans_sql('texts', _ADDED_RE2)})",
        "texts",
    )
)
def added_rule(spark, d):
    rows = patterns.detect_patterns(_pages(spark, d), [*patterns.PATTERNS, _ADDED])
    return rows.where("type = 'file_number'").select("doc_id", "page", "ord", "text", "start_pos", "confidence")


@query(
    sql(
        "select doc_id, page, sha256('Find: ' || substr(text, 1, 6000) || chr(10) || 'End') as digest, cast(least(6000, length(text)) + 10 as int) as n from texts"
        f" where regexp_replace(text, {lit(rules_sql.WS)}, '', 'g') <> ''",
        "texts",
    )
)
def model_prompt(spark, d):
    rows = models.prompts(_pages(spark, d), "Find: {{TEXT}}\nEnd")
    return rows.select("doc_id", "page", F.sha2("prompt", 256).alias("digest"), F.length("prompt").alias("n"))


# --- measured boxes


def _advance(text: str) -> str:
    """Width of a text in SQL."""
    each = f"list_transform(string_split(translate({text}, '{_BARE[0]}', '{_BARE[1]}'), ''), lambda c: case when c in ('', chr(10)) then 0 else coalesce({list(ADVANCES)}[ascii(c) - 31], 556) end)"
    return f"cast(coalesce(list_sum({each}), 0) as double)"


CTE["cut_items"] = "select *, greatest(start_pos, item_start) - item_start as from_, least(end_pos, item_end) - item_start as to_ from overlap"
CTE["widths"] = (
    f"select *, {_advance('item_text')} as full_, {_advance('substr(item_text, 1, cast(from_ as bigint))')} as prefix_, {_advance('substr(item_text, cast(from_ + 1 as bigint), cast(to_ - from_ as bigint))')} as part_ from cut_items"
)
CTE["measured"] = f"select *, greatest(0::double, prefix_ - {MARGIN}::double) / full_ as lo, least(full_, prefix_ + part_ + {MARGIN}::double) / full_ as hi from widths"


@query(sql(f"select doc_id, page, ord, item_seq, {_sqlbox('x + lo * w_', 'y', '(hi - lo) * w_', 'h')} from measured", "measured"))
def sub_box_measured(spark, d):
    return layout.sub_boxes(_overlaps(spark, d), measured=True).select("doc_id", "page", "ord", "item_seq", *_box())


# --- files and sinks

_KEPT = "url_encode(regexp_replace(name, '(?i)\\.pdf$', '') || ' (1)!~*é+_anonymise.pdf')"
for _code, _char in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
    _KEPT = f"replace({_KEPT}, '{_code}', '{_char}')"


@query(sql(f"select id, 'attachment; filename=\"' || {_KEPT} || '\"' as header from files", "files"))
def attachment_header(spark, d):
    named = F.concat(F.regexp_replace("name", r"(?i)\.pdf\z", ""), F.lit(" (1)!~*é+.pdf"))
    return _files(spark, d).select("id", responses.attachment_header(named).alias("header"))


CTE["drops"] = "select id // 3 as drop_id, id % 3 as seq, name, mime from files"


@query(
    sql(
        "select drop_id, seq, name, mime from drops d where seq = (select min(seq) from drops e where e.drop_id = d.drop_id) and (mime = 'application/pdf' or lower(name) like '%.pdf')",
        "drops",
    )
)
def first_of_drops(spark, d):
    return files.first_of_drops(_files(spark, d).selectExpr("id div 3 as drop_id", "id % 3 as seq", "name", "mime"))


@query(
    sql(
        "select f.id as doc_id, f.name as file_name, 'regex' as mode, 1 as n_pages, count(s.doc_id) as n_detections, arg_min(s.text, (s.start_pos, s.ord, s.cluster)) as first_text,"
        " cast(round(arg_min(s.confidence, (s.start_pos, s.ord, s.cluster)) * 1e6) as bigint) as confidence_u, cast(round(arg_min(s.y, (s.start_pos, s.ord, s.cluster)) * 1e6) as bigint) as y_u"
        " from files f left join seen s on s.doc_id = f.id group by f.id, f.name",
        "files",
        "seen",
    )
)
def upload_response(spark, d):
    pages = relations.table(spark, d, "customer").selectExpr("c_custkey as doc_id", "0 as page", "612D as width", "792D as height", "c_custkey % 10 = 0 as is_scanned")
    rows = responses.responses(_files(spark, d).withColumnRenamed("id", "doc_id"), pages, _detections(spark, d)).withColumn("v", F.parse_json("json"))
    value = lambda path, kind="string": F.try_variant_get("v", path, kind)
    size = lambda path: F.size(value(path, "array<variant>"))
    return rows.select(
        "doc_id", value("$.fileName").alias("file_name"), value("$.mode").alias("mode"), size("$.pages").alias("n_pages"), size("$.detections").cast("long").alias("n_detections"),
        value("$.detections[0].text").alias("first_text"), _u(value("$.detections[0].confidence", "double")).alias("confidence_u"), _u(value("$.detections[0].box.y", "double")).alias("y_u"))


@query(
    sql(
        "select m.doc_id, m.page, m.ord from included_matches m join (select r.doc_id, r.page, case when r.doc_id % 7 = 0 then t.text else r.text end as text from redacted r join texts t using (doc_id, page)) r using (doc_id, page)"
        " where substr(r.text, m.start_pos + 1, m.end_pos - m.start_pos) = m.text",
        "included_matches",
        "redacted",
        "texts",
    )
)
def redaction_planted_leaks(spark, d):
    """The control of ``redaction_leak_check``: every seventh document's text goes out as it was."""
    pages = _pages(spark, d)
    found = detect.detect_regex_mode(pages).where(F.col("confidence") >= F.lit(0.5).cast("double"))
    done = redact.redact_text(pages, found).join(pages.select("doc_id", "page", F.col("text").alias("was")), ["doc_id", "page"])
    return redact.leaks(done.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.col("was")).otherwise(F.col("text"))), found).select("doc_id", "page", "ord")
