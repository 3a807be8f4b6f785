"""A training corpus from raw documents: language, near copies, personal data, mix, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import language_id, mixing, near_dedup, packing, pii, queries, scratch

#: Not expressible: learned models, graph components and a tokenizer.
ORACLE_SQL = None
#: Percent of shared shingles from which documents of the corpus are near copies; op1's 85 binds its query only.
NEAR_COPIES = 80


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what no language model accepts. The models learn from a bounded sample of the rows with a lang.

    Null texts and texts without letters go; where no row has a lang, no model
    is learned and all rows go. Repeated rows are each kept or each dropped;
    other columns may be null; an empty table gives no rows.
    """
    scratch.small_batches(spark)
    models = language_id.train(docs.select("doc_id", "text", "lang"), F.lit(True))
    return language_id.keep_identified(docs, models)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id; repeated rows once.

    Rows without an id and blank texts stay; where an id stands on different
    texts, each text is kept or dropped as its own.
    """
    return near_dedup.keep_representatives(docs, NEAR_COPIES)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind. Null texts stay null; all rows and other columns stay."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut and drop documents so that the sources meet their target weights.

    A null source is a source of its own; null and blank texts, of which a mix
    takes no word, go.
    """
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, neighbours on the Hilbert curve together: a row for each piece, of every row of ``docs``."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("language", keep_languages),
    ("near_dedup", keep_one_of_near_copies),
    ("pii", redact_personal_data),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each writes a table that the next reads."""
    scratch.small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
