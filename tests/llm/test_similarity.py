"""Near copies at other similarities than op1's, against brute force."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import near_dedup, scratch
from maskwright.llm.components import connected_components

from .test_text_operators import shingles


def linked(rows, similarity):
    """The least id that each id can reach, over all pairs."""
    label = {i: i for i, _ in rows}
    sets = {i: shingles(t) for i, t in rows}
    for i, j in combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a and 100 * len(a & b) >= similarity * len(a | b) and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("similarity", [60, 80])
def test_pairs_at_the_threshold_are_found(spark, similarity):
    rows, keep = [], 200
    for k in range(150):  # pairs with exactly ``similarity`` of their shingles in common
        shared = [f"p{k}_{i}" for i in range(keep + 4)]
        more = 100 * keep // similarity - keep
        rows += [(2 * k, " ".join(shared)), (2 * k + 1, " ".join(shared + [f"q{k}_{i}" for i in range(more)]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in rows}


def test_matches_follow_the_similarity():
    assert [near_dedup.least_matches(s) for s in (85, 80)] == [38, 33]
    draws = np.random.default_rng(3).binomial(near_dedup.COORDINATES, 0.6, 1_000_000)
    assert (draws < near_dedup.least_matches(60)).sum() <= 3 and near_dedup.least_matches(1) == 1 and near_dedup.least_matches(100) == 64


def test_the_pipeline_drops_near_copies_from_80_percent(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = linked([(r["doc_id"], r["text"]) for r in docs.collect()], 80)
    assert {1, 6} == {want[177], want[145]}  # at 0.80 to 0.85
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_texts_of_clashing_ids_stand_for_themselves(spark):
    own = [" ".join(f"{w}{i}" for i in range(30)) for w in "abcd"]
    rows = [(1, own[0]), (2, own[1]), (2, own[0] + " more"), (3, own[2]), (3, own[3]), (3, own[3]), (4, None), (4, own[1]), (None, own[0])]
    got = near_dedup.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"), 80)
    want = [(1, own[0]), (2, own[1]), (3, own[2]), (3, own[3]), (4, None), (None, own[0])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_large_block_of_templated_pages(spark):
    """Pages from a pool of passages share every shingle with others and are linked with few: a block cut in many parts."""
    rng = np.random.default_rng(6)
    pool = [[f"p{i}w{j}" for j in range(24)] for i in range(30)]
    rows = []
    for k in range(150):
        page = [w for i in rng.choice(30, 8, replace=False) for w in pool[i]]
        rows.append((2 * k, " ".join(page)))
        if k % 3 == 0:  # a near copy, and one that is not near enough
            rows.append((2 * k + 1, " ".join([*page[:-3], f"x{k}", f"y{k}", f"z{k}"])))
        elif k % 3 == 1:
            rows.append((2 * k + 1, " ".join(w for j, w in enumerate(page) if j % 20)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, block_shingles=3000).collect()}
    assert got == linked(rows, 85)


def test_hot_classes_and_empty_sets(spark):
    same, near = " ".join(f"a{i}" for i in range(60)), " ".join(f"a{i}" for i in range(61))
    rows = [(i, same if i % 3 else None if i % 2 else "  ") for i in range(5000)] + [(6000, near), (6000, near), (None, same), (None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("component", F.lit("x"))).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert r["component_id"] == (None if i is None else 1 if i == 6000 or i % 3 else i) and r["kept"] == (i is None or r["component_id"] == i)


def test_components(spark):
    chain = [(i + 1, i) for i in range(100, 400)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = [*chain, *star, *star, (1, 1), (None, 5), (5, None), (1300, 1299), (2, 7), (7, 2), (-3, 7)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {(i, 100) for i in range(100, 401)} | {(i, 1000) for i in range(1000, 1300)} | {(1300, 1000), (2, -3), (7, -3), (-3, -3)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_tables_go_to_a_shared_folder(spark, monkeypatch, tmp_path):
    """Without a shared folder a cluster's master is refused; a round's table goes when it is no longer read."""

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    with pytest.raises(RuntimeError):
        scratch._shared(type("Session", (), {"conf": Conf, "sparkContext": Context})())
    app, edges = spark.sparkContext.applicationId, spark.range(500).selectExpr("id as src", "id + 1 as dst")
    scratch.scratch_root(spark)
    monkeypatch.setitem(scratch._roots, app, f"file://{tmp_path}")
    assert connected_components(edges).count() == 501
    assert len(list(tmp_path.glob("pairs-*"))) == 1
