"""Relations that the registered queries work on, built the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFFSET = 1_000_000_000

#: A letter for each customer key k: a person, dates, an address, numbers of all kinds.
LETTER = """
'Monsieur ' || case k % 4 when 0 then 'Camille' when 1 then 'Jean' when 2 then 'Marie-Claire' else 'Paul' end
|| ' ' || case k % 5 when 0 then 'ROUSSEAU' when 1 then 'Dupont' when 2 then 'Delattre' when 3 then 'Petit' else 'Bastide' end || chr(10)
|| case when k % 2 = 0 then 'Né le ' else 'Audience du ' end || lpad(cast(k % 28 + 1 as {s}), 2, '0') || '/' || lpad(cast(k % 12 + 1 as {s}), 2, '0') || '/' || cast(1940 + k % 60 as {s}) || chr(10)
|| cast(k % 300 + 1 as {s}) || ' rue de la Gare ' || lpad(cast(k % 95000 + 1000 as {s}), 5, '0') || chr(10)
|| 'Tél : 06 ' || lpad(cast(k % 100 as {s}), 2, '0') || ' ' || cast(k % 90 + 10 as {s}) || ' 56 78' || chr(10)
|| 'IBAN FR' || lpad(cast(98 - ((k + case when k % 3 = 0 then 1 else 0 end) * 1000000 + 152700) % 97 as {s}), 2, '0') || lpad(cast(k as {s}), 23, '0') || chr(10)
|| 'NIR ' || cast(k % 2 + 1 as {s}) || ' ' || lpad(cast(k % 100 as {s}), 2, '0') || ' ' || lpad(cast(k % 12 + 1 as {s}), 2, '0') || ' 78 006 084 36' || chr(10)
|| 'Signé le ' || cast(k % 28 + 1 as {s}) || ' ' || case k % 3 when 0 then 'janvier' when 1 then 'février' else 'décembre' end || ' ' || cast(2000 + k % 25 as {s})
|| ', dossier AB' || lpad(cast(k as {s}), 8, '0') || ', mail c' || cast(k as {s}) || '@exemple.fr.' || chr(10)
|| 'Bureau +44 2079 46' || lpad(cast(k % 100 as {s}), 2, '0') || ' 58, 00' || cast(k % 7 as {s}) || 'é75001 Saint-Malo, C:' || chr(92) || 'Etc' || chr(10)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows to all cores where the scan has fewer tasks than cores (a file of one row group is one task)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, page, text): a letter for each customer."""
    rows = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))
    return rows.select(F.col("k").alias("doc_id"), F.lit(0).alias("page"), F.expr(LETTER.format(s="string")).alias("text"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, page, text): the letters, and the documents with OFFSET added to their ids."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + OFFSET).alias("doc_id"), F.lit(0).alias("page"), "text")
    return letters(spark, sf_dir).unionByName(spread(docs))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the letters: a line each, lower lines further apart; every tenth letter was read from an image."""
    lines = letters(spark, sf_dir).select("doc_id", "page", F.posexplode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("item_seq", "line"))
    from ..operators.layout import with_offsets

    rows = with_offsets(lines.withColumn("text", F.concat("line", F.lit("\n"))), F.length("line") + 1)
    y = F.expr("0.05D + 0.0625D * item_seq + case when item_seq >= 4 then 0.125D else 0D end")
    box = F.struct(F.lit(0.125).alias("x"), y.alias("y"), F.lit(0.75).alias("width"), F.lit(0.03125).alias("height"))
    return rows.select("doc_id", "page", "item_seq", "text", "start_pos", "end_pos", box.alias("box"), F.when(F.col("doc_id") % 10 == 0, "ocr").otherwise("native").alias("source"))


def drags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointer drags of a reviewer: one for each third customer, some of them slivers or beyond the page."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    return c.selectExpr(
        "c_custkey as doc_id", "concat('z', cast(c_custkey as string)) as zone_id", "cast(c_custkey % 2 as int) as page",
        "(c_custkey % 16) / 8D - 0.25D as x0", "(c_custkey % 8) / 16D as y0", "(c_custkey % 5) / 4D as x1", "(c_custkey % 7) / 8D as y1")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model about the letters: usable items, items to skip, and replies that are no JSON."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    raw = F.expr("""case k % 5 when 0 then '{"items":[{"type":"name","text":"Jean Dupont"},{"type":"name","text":"ne"},{"type":"email","text":"exemple.fr"},{"type":"postal_address","text":"rue de la Gare"}]}'
        when 1 then '{"items":[null,"x",{"type":"name","text":5},{"type":"custom","text":"dossier AB"},{"type":"name","text":"Monsieur"},{"type":"name","text":"Jean"}]}'
        when 2 then 'not json' when 3 then '{"items":{"type":"name"}}' else '{"items":[{"type":"custom","text":"AB' || lpad(cast(k as string), 8, '0') || '"},{"type":"name","text":"exemple"},{"type":"custom","text":"C:' || chr(92) || chr(92) || 'Etc"}]}' end""")
    return c.select(F.col("k").alias("doc_id"), F.lit(0).alias("page"), raw.alias("raw"))


# The same in SQL, as common table expressions.

CTE: dict[str, str] = {
    "letters": f"select k as doc_id, 0 as page, {LETTER.format(s='varchar')} as text from (select c_custkey as k from customer)",
    "texts": f"select doc_id, page, text from letters union all select doc_id + {OFFSET}, 0, text from documents",
    "lines": "select doc_id, page, cast(i - 1 as int) as item_seq, string_split(rtrim(text, chr(10)), chr(10))[i] || chr(10) as text from (select *, unnest(generate_series(1, len(string_split(rtrim(text, chr(10)), chr(10))))) as i from letters)",
    "items": "select doc_id, page, item_seq, text, cast(sum(length(text)) over w - length(text) as int) as start_pos, cast(sum(length(text)) over w as int) as end_pos, 0.125::double as x,"
    " 0.05::double + 0.0625::double * item_seq + case when item_seq >= 4 then 0.125::double else 0::double end as y, 0.75::double as w_, 0.03125::double as h,"
    " case when doc_id % 10 = 0 then 'ocr' else 'native' end as source from lines window w as (partition by doc_id, page order by item_seq rows unbounded preceding)",
    "drags": "select c_custkey as doc_id, 'z' || c_custkey::varchar as zone_id, (c_custkey % 2)::int as page, (c_custkey % 16) / 8::double - 0.25::double as x0, (c_custkey % 8) / 16::double as y0,"
    " (c_custkey % 5) / 4::double as x1, (c_custkey % 7) / 8::double as y1 from customer where c_custkey % 3 = 0",
}
