"""The pipeline stage by stage against plain Python on a small table."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import queries

from .test_pii import base
from .test_text_operators import components, library, reference_targets, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).withColumn("text", F.element_at(F.array(F.lit(""), F.lit("12 34 !!"), F.lit(None)), F.row_number().over(Window.orderBy("doc_id")))).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    nulls = docs.where("doc_id in (5, 6)").withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
    docs = docs.unionByName(odd).unionByName(nulls).unionByName(docs.limit(2)).withColumn("extra", F.lit("x")).withColumn("size", F.lit(1)).withColumn("rep", F.lit(2))
    docs = docs.cache()
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], SF).cache())
    return out


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_rejects_only_what_has_no_letters(stages):
    before, after = ({r["doc_id"] for r in s.collect() if r["doc_id"] is not None} for s in stages[:2])
    assert stages[1].where("doc_id is null").count() == 2
    assert {i for i in before - after if i < 1_000_000} == set() and all(i < 1_000_000 for i in after)


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].where("doc_id is not null").collect()]
    kept = [r["doc_id"] for r in stages[2].where("doc_id is not null").collect()]
    assert stages[2].where("doc_id is null").count() == 2
    want = components(rows)
    assert sorted(kept) == sorted(set(want.values()))


def test_no_personal_data_is_left(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    for r in stages[3].collect():
        assert not base(r["text"]) and r["n_chars"] in (len(r["text"]), None if r["doc_id"] is None else -1)
        if r["doc_id"] is not None and not base(before[r["doc_id"]]) and "[" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]


def test_mix_meets_targets(stages):
    sizes, taken = Counter(), Counter()
    for r in stages[3].collect():
        sizes[r["source"]] += len(words(r["text"]))
    for r in stages[4].collect():
        taken[r["source"]] += len(words(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, aim in zip(order, reference_targets([sizes[s] for s in order]), strict=True):
        assert abs(taken[s] - aim) <= 0.02 * aim + 2


def test_packing_holds_every_token(stages):
    rows = stages[4].collect()
    want = sum(len(x) + 1 for x in library([r["text"] for r in rows]))
    pieces = stages[5].collect()
    assert sum(p["length"] for p in pieces) == want == sum(len(p["ids"]) // 4 for p in pieces)
    by = defaultdict(int)
    for p in pieces:
        by[p["sequence_id"]] += p["length"]
    assert max(by.values()) == 1024 and np.mean([n == 1024 for n in by.values()]) > 0.8


def test_run_and_empty_input(spark, tmp_path):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert queries.vocabulary().endswith(".json")
