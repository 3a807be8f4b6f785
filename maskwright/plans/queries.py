"""The registered queries, each with the SQL that an independent engine runs on the same tables.

Fractions of a page are compared in millionths (``_u``), confidences as
doubles: both engines do the same arithmetic in the same order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import ADVANCES
from ..functions.iban import iban_valid
from ..operators import dedupe, layout, model_matches, names, patterns, redact, review, spans
from ..sources import files
from . import detect, relations, rules_sql
from .relations import CTE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(select: str, *needs: str) -> str:
    """``select`` with the common table expressions that it needs, and those that they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in CTE:
            if other != name and other not in order and _mentions(CTE[name], other):
                visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    return "with " + ", ".join(f"{n} as ({CTE[n]})" for n in order) + " " + select


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"(?<![\w.']){name}(?![\w'(])", text) is not None


RE_WS = rules_sql.WS


def spans_sql(relation: str, rule: str) -> str:
    """(doc_id, page, text_, occ, x, start_pos) of all matches of a rule in a relation's texts."""
    return (
        f"select doc_id, page, text as text_, k - 1 as occ, m[k] as x, cast(list_sum(list_transform(g[1:k], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda z: length(z))), 0) as int) as start_pos"
        f" from (select *, unnest(generate_series(1, len(m))) as k from (select doc_id, page, text, regexp_extract_all(text, {lit(rule)}) as m, string_split_regex(text, {lit(rule)}) as g from {relation}))"
    )


IBAN_CLEAN = f"upper(regexp_replace(x, {lit(RE_WS + '+')}, '', 'g'))"
IBAN_SQL = (
    f"(length({IBAN_CLEAN}) between 15 and 34 and list_reduce(list_prepend(0::bigint, list_transform(string_split(substr({IBAN_CLEAN}, 5) || left({IBAN_CLEAN}, 4), ''),"
    " lambda c: case when c between '0' and '9' then c::bigint else (ascii(c) - 55)::bigint end)), lambda a, c: case when c < 10 then (a * 10 + c) % 97 else (a * 100 + c) % 97 end) = 1)"
)
BIRTH_SQL = f"regexp_matches(substr(text_, greatest(1, start_pos - 11), least(12, start_pos)), {lit(rules_sql.BIRTH)})"


def rule_sql(key: str, relation: str = "texts") -> str:
    """(doc_id, page, ord, type, text, start_pos, end_pos, confidence, source) of one rule."""
    kind, confidence, rule = rules_sql.RULES[key]
    base = conf = f"{confidence}::double"
    if key == "iban":
        conf = f"case when {IBAN_SQL} then {base} else {base} * {rules_sql.INVALID}::double end"
    if kind == "date_naissance":
        conf = f"case when {BIRTH_SQL} then greatest({base}, {rules_sql.BIRTH_AT_LEAST}::double) else {base} end"
    k = list(rules_sql.RULES).index(key)
    return (
        f"select doc_id, page, cast({k * rules_sql.BLOCK} + row_number() over (partition by doc_id, page order by start_pos) - 1 as bigint) as ord, {lit(kind)} as type, x as text,"
        f" start_pos, cast(start_pos + length(x) as int) as end_pos, {conf} as confidence, 'regex' as source from ({spans_sql(relation, rule)}) where {rules_sql.KEEP.get(key, 'true')}"
    )


_STOP = ", ".join(map(lit, rules_sql.STOP))
_PLACE = lit("(" + "|".join(rules_sql.PLACES) + ")$")
_NAME_OK = f"not list_has_any(string_split_regex(lower(x), {lit(rules_sql.NAME_SPLIT)}), [{_STOP}]) and regexp_matches(x, '[a-zà-ÿ]') and not regexp_matches(lower(x), {_PLACE})"
AFTER_RULES = len(rules_sql.RULES) * rules_sql.BLOCK
CTE["raw"] = " union all ".join(f"({rule_sql(key)})" for key in rules_sql.RULES)
CTE["seqs"] = f"select doc_id, page, occ as ord, x as text, start_pos, cast(start_pos + length(x) as int) as end_pos, 0.55::double as confidence from ({spans_sql('texts', rules_sql.NAME)}) where {_NAME_OK}"
_MERGE = (
    "select doc_id, page, island, min(start_pos) as start_pos, max(end_pos) as end_pos, max(confidence) as confidence from (select *, sum(case when start_pos <= before then 0 else 1 end) over (partition by doc_id, page order by start_pos, ord rows unbounded preceding) as island"
    " from (select *, max(end_pos) over (partition by doc_id, page order by start_pos, ord rows between unbounded preceding and 1 preceding) as before from {0})) group by all"
)
CTE["merged"] = _MERGE.format("seqs")
CTE["names_"] = (
    f"select doc_id, page, cast({AFTER_RULES} + island - 1 as bigint) as ord, 'name' as type, substr(t.text, m.start_pos + 1, m.end_pos - m.start_pos) as text, m.start_pos, m.end_pos, m.confidence, 'nlp' as source"
    " from merged m join texts t using (doc_id, page)"
)
_NESTED = (
    "select doc_id, page, ord, type, text, start_pos, end_pos, confidence, source from (select *, max(end_pos) over (partition by doc_id, page order by start_pos range between unbounded preceding and 1 preceding) as outer_,"
    " max(end_pos) over (partition by doc_id, page, start_pos order by ord rows between unbounded preceding and 1 preceding) as same_ from {0}) where not (coalesce(outer_ >= end_pos, false) or coalesce(same_ > end_pos, false))"
)
CTE["both_modes"] = "select * from raw union all select * from names_"
CTE["found"] = _NESTED.format("both_modes")
CTE["found_letters"] = f"select * from found where doc_id < {relations.OFFSET}"
MATCH = "doc_id, page, ord, type, text, start_pos, end_pos, confidence, source"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return relations.texts(spark, d)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return patterns.detect_patterns(_pages(spark, d))


def _letter_matches(spark: SparkSession, d: str) -> DataFrame:
    return detect.detect_regex_mode(relations.letters(spark, d))


def _u(c: Column) -> Column:
    return F.round(c * 1e6).cast("long")


def _box(b: str = "box") -> list[Column]:
    return [_u(F.col(f"{b}.{c}")).alias(f"{c}_u") for c in ("x", "y", "width", "height")]


def _rule(p: patterns.Pattern) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return patterns.detect_patterns(_pages(spark, d), [p]).withColumn("ord", F.col("ord") + patterns.PATTERNS.index(p) * patterns.BLOCK)

    run.__name__ = {"address": "pat_address"}.get(p.key, f"pat_{p.key}")
    query(sql(rule_sql(p.key), "texts"))(run)


for _p in list(patterns.PATTERNS):
    _rule(_p)


@query(sql(f"select {MATCH} from raw", "raw"))
def all_patterns(spark, d):
    return _raw(spark, d)


@query(sql(f"select doc_id, page, x as text, start_pos, {IBAN_SQL} as valid from ({spans_sql('texts', rules_sql.RULES['iban'][2])})", "texts"))
def iban_check(spark, d):
    rows = patterns.detect_patterns(_pages(spark, d), [patterns.pattern("iban")])
    return rows.select("doc_id", "page", "text", "start_pos", iban_valid(F.col("text")).alias("valid"))


QUERIES["iban_valid"], SQL["iban_valid"] = QUERIES.pop("iban_check"), SQL.pop("iban_check")


@query(sql("select type, confidence, count(*) as n from raw group by all", "raw"))
def confidence_adjust(spark, d):
    return _raw(spark, d).groupBy("type", "confidence").agg(F.count("*").alias("n"))


@query(sql(f"select doc_id, page, start_pos, {BIRTH_SQL} as birth from ((select * from ({spans_sql('texts', rules_sql.RULES['date_num'][2])})) union all (select * from ({spans_sql('texts', rules_sql.RULES['date_lit'][2])})))", "texts"))
def birth_context(spark, d):
    text = F.col("text")
    dates = F.concat(*(F.coalesce(spans.find_all(text, patterns.pattern(k).regex), F.array().cast(spans.HITS)) for k in ("date_num", "date_lit")))
    found = F.transform(dates, lambda m: F.struct(m["start"].alias("start_pos"), patterns.birth_context(text, m["start"]).alias("birth")))
    return _pages(spark, d).select("doc_id", "page", F.inline(found))


@query(sql("select doc_id, page, ord, text, start_pos, end_pos, confidence from seqs", "seqs"))
def name_regex(spark, d):
    # the ordinal counts sequences before the filters, as the search does not go back
    return names.regex_names(_pages(spark, d))


@query(sql("select doc_id, page, cast(island - 1 as bigint) as ord, start_pos, end_pos, confidence from merged", "merged"))
def merge_names(spark, d):
    return names.merge_names(names.regex_names(_pages(spark, d)))


@query(sql(f"select {MATCH} from names_", "names_"))
def detect_names(spark, d):
    return names.detect_names(_pages(spark, d))


@query(sql(f"select {MATCH} from found", "found"))
def detect_regex_mode(spark, d):
    return detect.detect_regex_mode(_pages(spark, d))


@query(sql(_NESTED.format("raw"), "raw"))
def dedupe_nested(spark, d):
    return dedupe.dedupe_nested(_raw(spark, d))


CTE["twice"] = f"select doc_id, page, ord, type, text, start_pos, end_pos, confidence, source from raw union all select doc_id, page, ord + {20 * rules_sql.BLOCK}, type, text, start_pos, end_pos, case when doc_id % 2 = 0 then 0.65::double else 0.1::double end, 'nlp' from raw where doc_id % 3 = 0"
_EXACT = "select doc_id, page, ord_ as ord, type, text, start_pos, end_pos, confidence, source from (select *, min(ord) over (partition by doc_id, page, type, start_pos, end_pos) as ord_, row_number() over (partition by doc_id, page, type, start_pos, end_pos order by confidence desc, ord) as n_ from {0}) where n_ = 1"


@query(sql(_EXACT.format("twice"), "twice"))
def dedupe_exact(spark, d):
    raw = _raw(spark, d)
    again = raw.where("doc_id % 3 = 0").withColumn("ord", F.col("ord") + 20 * patterns.BLOCK).withColumn("confidence", F.expr("case when doc_id % 2 = 0 then 0.65D else 0.1D end")).withColumn("source", F.lit("nlp"))
    return dedupe.dedupe_exact(raw.unionByName(again))


# --- the text model

CTE["replies"] = (
    "select c_custkey as doc_id, 0 as page, case c_custkey % 5 when 0 then '{\"items\":[{\"type\":\"name\",\"text\":\"Jean Dupont\"},{\"type\":\"name\",\"text\":\"ne\"},{\"type\":\"email\",\"text\":\"exemple.fr\"},{\"type\":\"postal_address\",\"text\":\"rue de la Gare\"}]}'"
    " when 1 then '{\"items\":[null,\"x\",{\"type\":\"name\",\"text\":5},{\"type\":\"custom\",\"text\":\"dossier AB\"},{\"type\":\"name\",\"text\":\"Monsieur\"},{\"type\":\"name\",\"text\":\"Jean\"}]}'"
    " when 2 then 'not json' when 3 then '{\"items\":{\"type\":\"name\"}}' else '{\"items\":[{\"type\":\"custom\",\"text\":\"AB' || lpad(c_custkey::varchar, 8, '0') || '\"},{\"type\":\"name\",\"text\":\"exemple\"},{\"type\":\"custom\",\"text\":\"C:' || chr(92) || chr(92) || 'Etc\"}]}' end as raw from customer"
)
CTE["reply_items_"] = (
    "select doc_id, page, cast(i as int) as seq, item ->> '$.type' as type, item ->> '$.text' as candidate from (select doc_id, page, i, json_extract(raw, '$.items[' || i || ']') as item from (select *, unnest(generate_series(0, 9)) as i from replies where json_valid(raw) and json_type(raw, '$.items') = 'ARRAY'))"
    " where item is not null and json_type(item) = 'OBJECT' and json_type(item, '$.text') = 'VARCHAR' and (item ->> '$.type') in ('name', 'postal_address', 'custom') and length(trim(item ->> '$.text')) >= case item ->> '$.type' when 'name' then 3 when 'postal_address' then 8 else 4 end"
)
CTE["model_hits"] = (
    f"select doc_id, page, cast({AFTER_RULES} + seq::bigint * 1000000 + k - 1 as bigint) as ord, type, candidate as text, start_pos, cast(start_pos + length(candidate) as int) as end_pos, 0.65::double as confidence, 'nlp' as source from"
    " (select *, cast(list_sum(list_transform(g[1:k], lambda z: length(z))) + (k - 1) * length(candidate) as int) as start_pos from (select *, unnest(generate_series(1, len(g) - 1)) as k from (select r.*, l.text as page_text, string_split(l.text, candidate) as g from reply_items_ r join texts l using (doc_id, page))))"
    " where not (start_pos > 0 and regexp_matches(substr(page_text, start_pos, 1), '[\\p{L}\\p{N}]') and regexp_matches(substr(page_text, start_pos + 1, 1), '[\\p{L}\\p{N}]'))"
    " and not (regexp_matches(substr(page_text, start_pos + length(candidate), 1), '[\\p{L}\\p{N}]') and regexp_matches(substr(page_text, start_pos + length(candidate) + 1, 1), '[\\p{L}\\p{N}]'))"
)
CTE["hybrid_all"] = "select * from raw union all select * from model_hits"
CTE["hybrid_once"] = _EXACT.format("hybrid_all")


@query(sql("select * from reply_items_", "reply_items_"))
def llm_items_json(spark, d):
    return model_matches.reply_items(relations.replies(spark, d))


@query(sql(f"select {MATCH} from model_hits", "model_hits"))
def llm_matches(spark, d):
    return model_matches.model_matches(_pages(spark, d), relations.replies(spark, d))


@query(sql(_NESTED.format("hybrid_once"), "hybrid_once"))
def detect_hybrid_mode(spark, d):
    return detect.detect_hybrid_mode(_pages(spark, d), relations.replies(spark, d))


_MODELS = [["a:1b", "b-Instruct:7b", "c-instruct"], ["a:1b", "wanted:2b"], ["only"], []]


@query(
    "select cast(n_nationkey as int) as n_nationkey, case n_nationkey % 4 when 0 then case when n_nationkey % 3 = 0 then 'c-instruct' else 'b-Instruct:7b' end when 1 then case when n_nationkey % 3 = 1 then 'wanted:2b' else 'a:1b' end"
    " when 2 then 'only' else case n_nationkey % 3 when 0 then 'c-instruct' when 1 then 'wanted:2b' else null end end as model from nation"
)
def pick_model(spark, d):
    rows = relations.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"))
    models = F.element_at(F.array(*(F.array(*map(F.lit, m)).cast("array<string>") for m in _MODELS)), F.col("n_nationkey") % 4 + 1)
    wanted = ("c-instruct", "wanted:2b", None)
    picks = [model_matches.pick_model(models, w) for w in wanted]
    return rows.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, picks[0]).when(F.col("n_nationkey") % 3 == 1, picks[1]).otherwise(picks[2]).alias("model"))


# --- pages, items and boxes

CTE["overlap"] = (
    "select m.*, i.item_seq, i.text as item_text, i.start_pos as item_start, i.end_pos as item_end, i.x, i.y, i.w_, i.h, i.source as item_source from found_letters m join items i on m.doc_id = i.doc_id and m.page = i.page and i.end_pos > m.start_pos and i.start_pos < m.end_pos"
)
CTE["parts"] = (
    "select * exclude (x, w_), x + lo * w_ as x, (hi - lo) * w_ as w_ from (select *, greatest(0::double, (greatest(start_pos, item_start) - item_start - 1) / (item_end - item_start)) as lo, least(1::double, (least(end_pos, item_end) - item_start + 1) / (item_end - item_start)) as hi from overlap)"
)
CTE["clustered"] = (
    "select *, cast(sum(new_) over (partition by doc_id, page, ord order by y, item_seq rows unbounded preceding) as int) as cluster from (select *, case when y - (lag(y) over w + lag(h) over w) > lag(h) over w * 0.6::double then 1 else 0 end as new_ from parts window w as (partition by doc_id, page, ord order by y, item_seq))"
)
CTE["boxes"] = "select doc_id, page, ord, cluster, type, text, start_pos, end_pos, confidence, source, min(x) as x, min(y) as y, max(x + w_) - min(x) as w_, max(y + h) - min(y) as h from clustered group by all"
CTE["seen"] = "select b.* exclude (source), case when o.any_ocr then 'ocr' else b.source end as source from boxes b join (select doc_id, page, bool_or(source = 'ocr') as any_ocr from items group by all) o using (doc_id, page)"


def _sqlbox(x: str = "x", y: str = "y", w: str = "w_", h: str = "h") -> str:
    return ", ".join(f"cast(round(({e}) * 1e6) as bigint) as {n}_u" for e, n in ((x, "x"), (y, "y"), (w, "width"), (h, "height")))


def _overlaps(spark, d):
    return layout.overlaps(_letter_matches(spark, d), relations.items(spark, d))


def _detections(spark, d):
    return layout.detections(_letter_matches(spark, d), relations.items(spark, d))


@query(sql("select doc_id, page, item_seq, start_pos, end_pos from items", "items"))
def item_offsets(spark, d):
    return relations.items(spark, d).select("doc_id", "page", "item_seq", "start_pos", "end_pos")


@query(sql("select doc_id, page, text from letters", "letters"))
def page_text(spark, d):
    return layout.page_text(relations.items(spark, d))


@query(sql("select doc_id, page, ord, item_seq, item_start, item_end from overlap", "overlap"))
def match_item_overlap(spark, d):
    return _overlaps(spark, d).select("doc_id", "page", "ord", "item_seq", "item_start", "item_end")


@query(sql(f"select doc_id, page, ord, item_seq, {_sqlbox()} from parts", "parts"))
def sub_box_uniform(spark, d):
    return layout.sub_boxes(_overlaps(spark, d)).select("doc_id", "page", "ord", "item_seq", *_box())


_BARE = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


@query(
    sql(
        f"select doc_id, item_seq, cast(list_sum(list_transform(string_split(translate(text, '{_BARE[0]}', '{_BARE[1]}'), ''), lambda c: case when c in ('', chr(10)) then 0 else coalesce({list(ADVANCES)}[ascii(c) - 31], 556) end)) as double) as width from items",
        "items",
    )
)
def measure_text(spark, d):
    from ..functions.geometry import measure_text as width

    return relations.items(spark, d).select("doc_id", "item_seq", width(F.col("text")).alias("width"))


@query(sql("select doc_id, page, ord, item_seq, cluster from clustered", "clustered"))
def cluster_boxes(spark, d):
    return layout.cluster_boxes(layout.sub_boxes(_overlaps(spark, d))).select("doc_id", "page", "ord", "item_seq", "cluster")


@query(sql(f"select doc_id, page, ord, cluster, {_sqlbox()} from boxes", "boxes"))
def union_boxes(spark, d):
    return layout.union_boxes(layout.cluster_boxes(layout.sub_boxes(_overlaps(spark, d)))).select("doc_id", "page", "ord", "cluster", *_box())


@query(sql(f"select doc_id, page, ord, cluster, type, text, start_pos, end_pos, confidence, source, {_sqlbox()} from seen", "seen"))
def detections(spark, d):
    return _detections(spark, d).select("doc_id", "page", "ord", "cluster", "type", "text", "start_pos", "end_pos", "confidence", "source", *_box())


@query(sql("select source, type, count(*) as n from seen group by all", "seen"))
def detection_source(spark, d):
    return _detections(spark, d).groupBy("source", "type").agg(F.count("*").alias("n"))


@query(sql("select doc_id, page, ord, cluster, sha256(doc_id || '|' || page || '|' || type || '|' || start_pos || '|' || end_pos || '|' || ord || '|' || cluster) as id from seen", "seen"))
def detection_id(spark, d):
    return _detections(spark, d).select("doc_id", "page", "ord", "cluster", "id")


def _runs(spark, d):
    rows = relations.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", F.explode(F.array(*map(F.lit, range(5)))).alias("item_seq"))
    k, j = F.col("doc_id"), F.col("item_seq")
    dbl = lambda c: c.cast("double")
    return rows.select(
        "doc_id", F.lit(0).alias("page"), "item_seq", F.when(j == 2, "").when(j != 3, F.col("c_name")).alias("str"), (k % 2 == 0).alias("has_eol"),
        F.array(F.lit(1.0), F.lit(0.0), F.when(j == 0, 0.0).otherwise(3.0), F.when(k % 3 == 0, 0.0).otherwise(4.0), dbl(k % 700) - 50, dbl(k % 900)).alias("transform"),
        F.when(k % 4 != 0, dbl(k % 800)).alias("width"), F.when(k % 5 == 0, float("nan")).otherwise(dbl(k % 30)).alias("height"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))


CTE["runs"] = (
    "select c_custkey as doc_id, 0 as page, j as item_seq, case when j = 2 then '' when j = 3 then null else c_name end as str, c_custkey % 2 = 0 as has_eol, case when j = 0 then 0::double else 3::double end as t2, case when c_custkey % 3 = 0 then 0::double else 4::double end as t3,"
    " (c_custkey % 700)::double - 50 as t4, (c_custkey % 900)::double as t5, case when c_custkey % 4 <> 0 then (c_custkey % 800)::double end as width, case when c_custkey % 5 <> 0 then (c_custkey % 30)::double end as height from customer, (select unnest([0, 1, 2, 3, 4]) as j)"
)
CTE["run_items"] = (
    "select *, cast(sum(length(text)) over (partition by doc_id, page order by item_seq rows unbounded preceding) as int) as end_pos, coalesce(nullif(sqrt(t2 * t2 + t3 * t3), 0), nullif(abs(t3), 0), 10) as font from (select *, str || case when has_eol then chr(10) else ' ' end as text from runs where str is not null)"
)


@query(
    sql(
        f"select doc_id, page, item_seq, text, cast(end_pos - length(text) as int) as start_pos, end_pos, {_sqlbox('greatest(0::double, t4 / 612)', 'greatest(0::double, (792 - t5 - hh * 0.8::double) / 792)', 'least(1::double, ww / 612)', 'least(1::double, hh / 792)')}"
        " from (select *, coalesce(nullif(width, 0), 1) as ww, coalesce(nullif(height, 0), font) as hh from run_items) where str <> ''",
        "run_items",
    )
)
def native_items(spark, d):
    return layout.native_items(_runs(spark, d)).select("doc_id", "page", "item_seq", "text", "start_pos", "end_pos", *_box())


def _words(spark, d):
    rows = relations.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", F.explode(F.array(*map(F.lit, range(4)))).alias("item_seq"))
    k, j = F.col("doc_id"), F.col("item_seq")
    return rows.select("doc_id", F.lit(0).alias("page"), "item_seq", F.when(j == 1, "  ").otherwise(F.col("c_name")).alias("text"), *((e).cast("double").alias(n) for n, e in (("x0", k % 500), ("y0", k % 400), ("x1", k % 500 + 80), ("y1", k % 400 + 20))), F.lit(1240).alias("img_width"), F.lit(1754).alias("img_height"))


CTE["ocr_words"] = "select c_custkey as doc_id, 0 as page, j as item_seq, case when j = 1 then '  ' else c_name end || ' ' as text, (c_custkey % 500)::double as x0, (c_custkey % 400)::double as y0, (c_custkey % 500 + 80)::double as x1, (c_custkey % 400 + 20)::double as y1 from customer, (select unnest([0, 1, 2, 3]) as j)"


@query(
    sql(
        f"select * from (select doc_id, page, item_seq, text, cast(sum(length(text)) over w - length(text) as int) as start_pos, cast(sum(length(text)) over w as int) as end_pos, {_sqlbox('x0 / 1240', 'y0 / 1754', '(x1 - x0) / 1240', '(y1 - y0) / 1754')}"
        " from ocr_words window w as (partition by doc_id, page order by item_seq rows unbounded preceding)) where trim(text) <> ''",
        "ocr_words",
    )
)
def ocr_items(spark, d):
    return layout.ocr_items(_words(spark, d)).select("doc_id", "page", "item_seq", "text", "start_pos", "end_pos", *_box())


@query(f"select doc_id, length(regexp_replace(text, {lit(RE_WS + '+')}, '', 'g')) < 20 as is_scanned, cast(length(regexp_replace(text, {lit(RE_WS + '+')}, '', 'g')) as int) as chars from documents")
def scanned_pages(spark, d):
    return relations.table(spark, d, "documents").select("doc_id", layout.is_scanned(F.col("text")).alias("is_scanned"), layout.significant_chars(F.col("text")).alias("chars"))


@query(
    sql(
        "select doc_id, page, item_seq, text, source from (select doc_id, page, item_seq, text, 'native' as source from items where doc_id % 4 <> 0 union all select doc_id, page, item_seq, text, 'ocr' as source from"
        " (select * from ocr_words where trim(text) <> '') where doc_id % 4 = 0)",
        "items",
        "ocr_words",
    )
)
def page_source_switch(spark, d):
    pages = relations.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page"), (F.col("c_custkey") % 4 == 0).alias("is_scanned"))
    native = relations.items(spark, d).withColumn("source", F.lit("native"))
    return layout.switch_source(native, layout.ocr_items(_words(spark, d)), pages).select("doc_id", "page", "item_seq", "text", "source")


@query("select p_partkey, ceil((300 + p_size * 7.3::double) * 1.5::double) / 1.5::double as width, ceil((500 + p_size * 3.1::double) * 1.5::double) / 1.5::double as height from part")
def page_dims(spark, d):
    rows = relations.table(spark, d, "part")
    return rows.select("p_partkey", layout.page_dims(300 + F.col("p_size") * F.lit(7.3).cast("double"), 500 + F.col("p_size") * F.lit(3.1).cast("double")).alias("s")).select("p_partkey", "s.width", "s.height")


# --- sources and sinks

CTE["files"] = "select c_custkey as id, c_name || case c_custkey % 4 when 0 then '.pdf' when 1 then '.PDF' when 2 then '.txt' else '' end as name, case c_custkey % 3 when 0 then '' when 1 then 'application/pdf' else 'text/plain' end as mime from customer"


def _files(spark, d):
    return relations.table(spark, d, "customer").selectExpr(
        "c_custkey as id", "concat(c_name, case c_custkey % 4 when 0 then '.pdf' when 1 then '.PDF' when 2 then '.txt' else '' end) as name", "case c_custkey % 3 when 0 then '' when 1 then 'application/pdf' else 'text/plain' end as mime")


@query("select doc_id, length(text) as n, lang, source from documents")
def scan_documents(spark, d):
    from ..sources.tables import text_pages

    pages = text_pages(relations.table(spark, d, "documents"), keep=("lang", "source"))
    return pages.select("doc_id", F.length("text").cast("long").alias("n"), "lang", "source")


@query(sql("select * from files where not (mime <> '' and mime <> 'application/pdf' and not lower(name) like '%.pdf')", "files"))
def filter_pdf_server(spark, d):
    return _files(spark, d).where(files.accepted_by_server(F.col("name"), F.col("mime")))


@query(sql("select * from files where mime = 'application/pdf' or lower(name) like '%.pdf'", "files"))
def filter_pdf_client(spark, d):
    return _files(spark, d).where(files.accepted_by_client(F.col("name"), F.col("mime")))


@query(sql("select id, regexp_replace(name, '(?i)\\.pdf$', '') || '_anonymise.pdf' as out_name from files", "files"))
def output_name(spark, d):
    return _files(spark, d).select("id", redact.output_name(F.col("name")).alias("out_name"))


@query("select c_custkey as id, 'data:image/png;base64,' || to_base64(encode(c_name)) as url from customer")
def data_url(spark, d):
    return relations.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), redact.data_url(F.col("c_name").cast("binary")).alias("url"))


@query(sql("select doc_id, '{\"page\":' || page || ',\"type\":' || to_json(type) || ',\"text\":' || to_json(text) || ',\"start_pos\":' || start_pos || ',\"end_pos\":' || end_pos || ',\"source\":' || to_json(source) || '}' as json from found", "found"))
def detections_json(spark, d):
    return detect.detect_regex_mode(_pages(spark, d)).select("doc_id", F.to_json(F.struct("page", "type", "text", "start_pos", "end_pos", "source")).alias("json"))


@query(sql(f"select doc_id, ord, cluster, {_sqlbox('x * 100', 'y * 100', 'w_ * 100', 'h * 100')} from seen", "seen"))
def preview_pct(spark, d):
    return _detections(spark, d).select("doc_id", "ord", "cluster", review.preview_percent(F.col("box")).alias("box")).select("doc_id", "ord", "cluster", *_box())


# --- review and zones

CTE["inc"] = "select *, confidence >= 0.5::double as included from seen"
CTE["manual"] = (
    "select doc_id, zone_id, page, least(a0, a1) as x, least(b0, b1) as y, abs(a1 - a0) as w_, abs(b1 - b0) as h from (select *, greatest(0, least(1, x0)) as a0, greatest(0, least(1, y0)) as b0, greatest(0, least(1, x1)) as a1, greatest(0, least(1, y1)) as b1 from drags) where abs(a1 - a0) >= 0.005::double and abs(b1 - b0) >= 0.005::double"
)
CTE["zone_rows"] = "select doc_id, page, x, y, w_, h from inc where included union all select doc_id, page, x, y, w_, h from manual"
CTE["sheets"] = "select c_custkey as doc_id, unnest([0, 1, 2]) as page from customer"


def _included(spark, d):
    return review.default_included(_detections(spark, d))


def _manual(spark, d):
    return review.manual_zones(relations.drags(spark, d))


def _zones(spark, d):
    return review.zones(_included(spark, d), _manual(spark, d))


def _sheets(spark, d):
    return relations.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("page"))


@query(sql("select doc_id, page, ord, cluster, included from inc", "inc"))
def default_included(spark, d):
    return _included(spark, d).select("doc_id", "page", "ord", "cluster", "included")


_CHOICE = "case when start_pos % 5 = 0 then {0} when start_pos % 5 = 1 then true end"


@query(sql(f"select doc_id, page, ord, cluster, coalesce({_CHOICE.format('not included')}, included) as included from inc", "inc"))
def apply_overrides(spark, d):
    rows = _included(spark, d)
    choices = rows.select("id", F.expr(_CHOICE.format("not included")).alias("choice")).where("choice is not null")
    return review.apply_overrides(rows, choices).select("doc_id", "page", "ord", "cluster", "included")


@query(sql("select doc_id, page, ord, cluster, start_pos % 3 = 0 and included as included from inc", "inc"))
def included_lookup(spark, d):
    rows = _included(spark, d)
    return review.included_lookup(rows.drop("included"), rows.where("start_pos % 3 = 0").select("id", "included")).select("doc_id", "page", "ord", "cluster", "included")


@query(sql(f"select doc_id, zone_id, page, {_sqlbox()} from manual", "manual"))
def manual_zones(spark, d):
    return _manual(spark, d).select("doc_id", "zone_id", "page", *_box())


@query(sql(f"select doc_id, page, {_sqlbox()} from zone_rows", "zone_rows"))
def zones(spark, d):
    return _zones(spark, d).select("doc_id", "page", *_box())


@query(
    "select k as id, z ->> '$.page' as page, cast(round((z ->> '$.box.x')::double * 1e6) as bigint) as x_u, cast(round((z ->> '$.box.width')::double * 1e6) as bigint) as width_u from"
    " (select c_custkey as k, unnest(generate_series(0, 1)) as i from customer where c_custkey % 3 <> 0) t, lateral (select json_object('page', (k % 7 + i)::int, 'box', json_object('x', (k % 8) / 8::double, 'y', 0.25, 'width', 0.5 / (i + 1), 'height', 0.125)) as z)"
)
def parse_zones(spark, d):
    one = "'{{\"page\":' || cast(cast(k % 7 + {i} as int) as string) || ',\"box\":{{\"x\":' || cast((k % 8) / 8D as string) || ',\"y\":0.25,\"width\":' || cast(0.5D / ({i} + 1) as string) || ',\"height\":0.125}}}}'"
    raw = f"case when k % 3 = 0 then '{{\"page\":1}}' else chr(10) || '[' || {one.format(i=0)} || ',5,null,' || {one.format(i=1)} || ',\"x\"]' end"
    rows = relations.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).select("k", F.expr(raw).alias("raw"))
    got = rows.select(F.col("k").alias("id"), F.explode(review.parse_zones(F.col("raw"))).alias("z"))
    return got.select("id", F.col("z.page").cast("string").alias("page"), _u(F.col("z.box.x")).alias("x_u"), _u(F.col("z.box.width")).alias("width_u"))


@query(sql("select doc_id, page, count(*) as n, cast(round(sum(x) * 1e4) as bigint) as x_sum from zone_rows group by all", "zone_rows"))
def zones_by_page(spark, d):
    rows = review.zones_by_page(_zones(spark, d))
    return rows.select("doc_id", "page", F.size("zones").cast("long").alias("n"), F.round(F.aggregate("zones", F.lit(0.0), lambda a, z: a + z["x"]) * 1e4).cast("long").alias("x_sum"))


@query(sql("select s.doc_id, s.page, count(z.doc_id) as n from sheets s left join zone_rows z using (doc_id, page) group by all", "sheets", "zone_rows"))
def pages_left_zones(spark, d):
    rows = _sheets(spark, d).join(review.zones_by_page(_zones(spark, d)).hint("merge"), ["doc_id", "page"], "left")
    return rows.select("doc_id", "page", F.when(F.col("zones").isNull(), 0).otherwise(F.size("zones")).cast("long").alias("n"))


@query(sql("select s.doc_id, s.page from sheets s semi join zone_rows z using (doc_id, page)", "sheets", "zone_rows"))
def pages_rasterised(spark, d):
    return redact.split_pages(_sheets(spark, d), review.zones_by_page(_zones(spark, d)))[1].select("doc_id", "page")


@query(sql("select s.doc_id, s.page from sheets s anti join zone_rows z using (doc_id, page)", "sheets", "zone_rows"))
def pages_untouched(spark, d):
    return redact.split_pages(_sheets(spark, d), review.zones_by_page(_zones(spark, d)))[0]


@query(sql(f"select doc_id, page, {_sqlbox('x * ceil(612.3::double * 2.5)', 'y * ceil(792.1::double * 2.5)', 'w_ * ceil(612.3::double * 2.5)', 'h * ceil(792.1::double * 2.5)')} from zone_rows", "zone_rows"))
def zone_pixels(spark, d):
    rows = _zones(spark, d)
    return rows.select("doc_id", "page", review.zone_pixels(F.col("box"), F.lit(612.3).cast("double"), F.lit(792.1).cast("double")).alias("box")).select("doc_id", "page", *_box())


_LABEL_SQL = "case type " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in rules_sql.LABELS.items()) + " else type end"


@query(sql(f"select type, {_LABEL_SQL} as label, count(*) as n from raw group by all", "raw"))
def type_labels(spark, d):
    return _raw(spark, d).groupBy("type").agg(F.count("*").alias("n")).select("type", review.type_label(F.col("type")).alias("label"), "n")


@query(sql(f"select type, {_LABEL_SQL} as label, count(*) as n, arg_min(doc_id, (doc_id, page, ord, cluster)) as first_doc, arg_min(ord, (doc_id, page, ord, cluster)) as first_ord from seen group by all", "seen"))
def count_by_type(spark, d):
    return review.count_by_type(_detections(spark, d))


@query(sql("select doc_id, page, coalesce(n_detections, 0) as n_detections, coalesce(n_manual, 0) as n_manual from (select doc_id, page, count(*) as n_detections from seen group by all) full join (select doc_id, page, count(*) as n_manual from manual group by all) using (doc_id, page)", "seen", "manual"))
def count_by_page(spark, d):
    return review.count_by_page(_detections(spark, d), _manual(spark, d))


@query(sql("select doc_id, n_included, n_total, n_included + coalesce(n_manual, 0) as n_zones from (select doc_id, count_if(included)::bigint as n_included, count(*) as n_total from inc group by all) left join (select doc_id, count(*) as n_manual from manual group by all) using (doc_id)", "inc", "manual"))
def included_summary(spark, d):
    return review.included_summary(_included(spark, d), _manual(spark, d))


@query("select doc_id, 'Page ' || (doc_id % 5 + 1)::varchar || case when length(text) < 200 then ' · OCR' else '' end as label from documents")
def page_label(spark, d):
    return relations.table(spark, d, "documents").select("doc_id", review.page_label(F.col("doc_id") % 5, F.length("text") < 200).alias("label"))


# --- redaction

CTE["included_matches"] = "select * from found where confidence >= 0.5::double"
CTE["islands"] = _MERGE.format("included_matches")
CTE["redacted"] = (
    "select t.doc_id, t.page, case when s.l is null then t.text else list_reduce(list_prepend(struct_pack(o := '', e := 0), list_append(list_transform(s.l, lambda z: struct_pack(o := z.s::varchar, e := z.e)), struct_pack(o := length(t.text)::varchar, e := length(t.text)::int))),"
    " lambda a, z: struct_pack(o := a.o || substr(t.text, a.e + 1, z.o::int - a.e) || repeat('█', z.e - z.o::int), e := z.e)).o end as text from texts t left join"
    " (select doc_id, page, list(struct_pack(s := start_pos, e := end_pos) order by start_pos) as l from islands group by all) s using (doc_id, page)"
)


@query(sql("select doc_id, page, sha256(text) as digest, cast(length(text) as int) as n, cast(length(regexp_replace(text, '[^█]', '', 'g')) as int) as masked from redacted", "redacted"))
def redact_text(spark, d):
    done = detect.redact_pages(_pages(spark, d))
    return done.select("doc_id", "page", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"), F.length(F.regexp_replace("text", "[^█]", "")).alias("masked"))


@query(sql("select m.doc_id, m.page, m.ord from included_matches m join redacted r using (doc_id, page) where substr(r.text, m.start_pos + 1, m.end_pos - m.start_pos) = m.text", "included_matches", "redacted"))
def redaction_leak_check(spark, d):
    pages = _pages(spark, d)
    found = detect.detect_regex_mode(pages).where(F.col("confidence") >= F.lit(0.5).cast("double"))
    return redact.leaks(redact.redact_text(pages, found), found).select("doc_id", "page", "ord")


def entry(spark: SparkSession) -> DataFrame:
    """Personal data in the small documents and letters, rules and names."""
    return detect_regex_mode(spark, "/root/testdata/sf0.001")


from . import provider_queries  # noqa: E402, F401  (registers its queries, which build on those above)
