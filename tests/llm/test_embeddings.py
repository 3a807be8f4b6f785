"""Embedding links against a scan of all pairs, and hostile vectors."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm.embedding_dedup import near_vectors
from maskwright.llm.hnsw import Graph

SF = "/root/testdata/sf0.01"


def brute_force(rows, threshold=0.93):
    sound = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound.setdefault((label, len(v)), []).append((i, np.array(v, float) / np.abs(v).max()))
    parent, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for group in sound.values():
        ids, v = [i for i, _ in group], np.array([x for _, x in group])
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(v @ v.T >= threshold, 1)), strict=True):
            links[ids[a]] += 1
            links[ids[b]] += 1
            x, y = sorted((root(ids[a]), root(ids[b])))
            parent[y] = x
    return {i: (links[i], root(i)) for i in parent}


@pytest.mark.parametrize("shard", [3000, 40])
def test_links_equal_a_scan(spark, shard):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = [tuple(r) for r in table.collect()]
    rng = np.random.default_rng(3)
    center = rng.standard_normal(64)
    extra = [(10_000 + k, (center + 0.3 * rng.standard_normal(64)).tolist(), 1) for k in range(150)]
    extra += [(20_000 + k, center.tolist(), 1) for k in range(30)]
    odd = [(30_000, None, 1), (30_001, [], 1), (30_002, [0.0] * 64, 1), (30_003, [float("nan")] + [1.0] * 63, 1), (30_004, [None] + [1.0] * 63, 1), (30_005, center.tolist(), None),
           (30_006, [1e300] * 64, 2), (30_007, [1e-300] * 64, 2), (30_008, [1.0] * 3, 2), (30_009, [float("inf")] * 64, 2)]
    rows += extra + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute_force(rows)
    got = {r["vec_id"]: r for r in near_vectors(df, shard_rows=shard).collect()}
    assert set(got) == set(want)
    total = sum(n for n, _ in want.values())
    missing = sum(want[i][0] - got[i]["n_links"] for i in want)
    assert all(got[i]["n_links"] <= want[i][0] for i in want) and missing <= 0.01 * total
    assert np.mean([got[i]["component_id"] == want[i][1] for i in want]) > 0.995
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert got[30_006]["n_links"] == 1


def test_links_between_shards_only(spark):
    """Each vector's one partner is in another shard: what the graphs' own vectors are linked with tells nothing."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((600, 48))
    shards = 5
    rows = []
    for k, v in enumerate(base):
        twin = v + 0.1 * rng.standard_normal(48)
        rows += [(2 * k, v.tolist(), 7), (2 * k + 1, twin.tolist(), 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").withColumn("shard", F.lit("x")).withColumn("recall", F.lit(0)).withColumn("rep", F.lit(1))
    raw = {i: np.asarray(v) + 0.0 for i, v, _ in rows}
    keys = spark.createDataFrame([(i, hashlib.sha256(v.tobytes()).hexdigest()) for i, v in raw.items()], "i long, key string")
    shard = {r["i"]: r["s"] for r in keys.select("i", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("s")).collect()}
    apart = [k for k in range(600) if shard[2 * k] != shard[2 * k + 1]]
    some = {i for k in apart for i in (2 * k, 2 * k + 1)}
    df = df.where(F.col("vec_id").isin(sorted(some)))
    want = brute_force([r for r in rows if r[0] in some])
    got = {r["vec_id"]: r for r in near_vectors(df, shard_rows=-(-len(some) // shards)).collect()}
    links = sum(n for n, _ in want.values())
    assert links > 700 and sum(r["n_links"] for r in got.values()) >= 0.99 * links
    assert all(r["n_links"] <= want[i][0] for i, r in got.items())
    assert {r["recall"] for r in got.values()} <= {r for r in [next(iter(got.values()))["recall"]] if r >= 0.99}


def test_a_shard_of_one_cluster(spark):
    """All vectors near each other: links are counted, not listed."""
    rng = np.random.default_rng(9)
    center = rng.standard_normal(16)
    rows = [(i, (center + 0.02 * rng.standard_normal(16)).tolist(), 1) for i in range(3000)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard_rows=2000).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(2999, 0)}


def test_no_rows_and_no_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, near_vectors(df).collect()), key=str) == [(None, 0, None, True, 1.0)] * 2
    assert near_vectors(df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.standard_normal((1500, 32)), rng.standard_normal((1, 32)) + 0.05 * rng.standard_normal((300, 32))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Graph(v)
    beam, links, held = graph.audited_beam(v, 0.93, 0.99, True)
    assert held >= 0.99 * links > 0
    again = Graph.loads(graph.dumps(), v)
    q, t = (np.concatenate(x) for x in zip(*again.within(v, 0.93, beam), strict=True))
    true = set(zip(*(x.tolist() for x in np.nonzero(v @ v.T >= 0.93)), strict=True))
    assert len(true & set(zip(q.tolist(), t.tolist(), strict=True))) >= 0.99 * len(true)
    for n in (1, 2, 5, 33):
        assert len(Graph(v[:n]).search(v[:n], 8)[0]) == n
