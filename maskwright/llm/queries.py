"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches


def vocabulary() -> str:
    """Path of the byte-level vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_documents(spark, sf_dir)).withColumn("grown_shard", F.lit(None).cast("int"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_following

    return compare_with_following(_documents(spark, sf_dir))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("recall")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, identify, train

    docs = _documents(spark, sf_dir)
    models = train(docs.select("doc_id", "text", "lang"), ~held_out())
    return identify(docs, models).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    return mix_plan(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "passes", "start", "span")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(_documents(spark, sf_dir), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE_KINDS, find_personal_data, span_digest

    found = find_personal_data(_documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(span_digest("base"), 256).alias("base_sha256"), span_digest("spans").alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out
    from .quality import score, train

    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = held_out(parts=3, part=1)
    scored = score(docs, train(docs.select("doc_id", "text"), labels, ~out))
    return scored.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    counts = token_counts(_documents(spark, sf_dir), vocabulary())
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_sharding, op3_fingerprints, op4_embedding_near_dedup, op5_language_id, op6_mixing, op7_packing, op8_pii, op9_quality, op10_token_counts)
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_REACH = """
reach as (select node, node as r from nodes union select l.y, reach.r from reach join links l on l.x = reach.node),
parts as (select node, min(r) as component_id from reach group by 1)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(w) >= 5 then list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from w)),
n as (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
links as (select x, y from pairs join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
nodes as (select doc_id as node from documents),{_REACH}
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from documents left join n using (doc_id) join parts on node = doc_id
""",
    "op4_embedding_near_dedup": f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
nodes as (select vec_id as node from embeddings),{_REACH}
select vec_id, (select count(*) from links where x = vec_id) as n_links, component_id, vec_id = component_id as kept from embeddings join parts on node = vec_id
""",
}
