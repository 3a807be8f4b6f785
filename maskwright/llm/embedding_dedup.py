"""Near-duplicate embeddings by navigable small-world graphs, one for each shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hnsw import Graph
from .scratch import discard, materialize

THRESHOLD = 0.93
RECALL = 0.99
#: Vectors of a shard at most, and bytes of their doubles.
SHARD, SHARD_BYTES = 16_000, 48 << 20


def _unit(raw: list, dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow or underflow in the norm
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


class _Links:
    """The links between the rows of ``a`` and of ``b`` as bits, whichever side found them; memory is bounded by the shards."""

    def __init__(self, a: np.ndarray, b: np.ndarray, threshold: float):
        self.a, self.b, self.threshold = a, b, threshold
        self.bits = np.zeros((len(a), -(-len(b) // 8)), np.uint8)

    def add(self, q: np.ndarray, t: np.ndarray) -> None:
        """Keep the pairs (row of a, row of b) whose cosine in double precision is at least the threshold."""
        for k in range(0, len(q), 1 << 16):
            i, j = q[k : k + (1 << 16)], t[k : k + (1 << 16)]
            near = np.einsum("ij,ij->i", self.a[i], self.b[j]) >= self.threshold
            np.bitwise_or.at(self.bits, (i[near], j[near] >> 3), (128 >> (j[near] & 7)).astype(np.uint8))

    def rows(self, lo: int, hi: int) -> np.ndarray:
        return np.unpackbits(self.bits[lo:hi], axis=1, count=len(self.b)).astype(bool)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let both ends of each link have the lower label, until no label changes."""
    while len(a):
        low = np.minimum(label[a], label[b])
        open_ = (label[a] != low) | (label[b] != low)
        if not open_.any():
            return
        a, b, low = a[open_], b[open_], low[open_]
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label[:] = label[label]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float = RECALL, shard_rows: int = SHARD) -> DataFrame:
    """Rows (id_col long, n_links long, component_id long, kept boolean, recall double), one for each row of ``vectors``.

    Vectors of one label (not null) and one length are linked if their cosine
    in double precision is at least ``threshold``. component_id is the least
    id reachable. A vector that is null, empty or zero, or holds a null or
    a value that is not finite, is linked with nothing; so is a row without an
    id, whose component_id is null and which is kept. Repeated rows count as
    vectors of their own. An empty table gives no rows. Other columns are not
    read, whatever their names.

    Equal vectors are one class with a multiplicity. The classes of a label
    are dealt to shards of ``shard_rows`` at most (fewer for long vectors);
    each gets a graph. Every vector queries every shard of its label: each
    pair of shards is a task, in which either side queries the other's graph,
    with a beam that audits of that side's own queries against a scan have
    widened until ``recall`` is met. Links are verified in double precision
    and leave the task as a count for each vector and a spanning forest, not
    as pairs. ``recall`` of the result is the share of the audits' links that
    the beams found, over the label (1 where the audits held no link).
    """
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double") + 0.0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vec.alias("v"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "dim": [len(v) for v in pdf["v"]], "raw": [np.asarray(v, np.float64).tobytes() for v in pdf["v"]]})

    kind = vectors.schema[label_col].dataType.simpleString()
    packed = rows.where(F.coalesce(sound, F.lit(False))).mapInPandas(pack, f"id long, label {kind}, dim int, raw binary")
    packed = materialize(packed.select("id", "label", "dim", F.sha2("raw", 256).alias("key"), "raw"), "vectors")
    classes = materialize(packed.groupBy("label", "dim", "key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("raw").alias("raw")), "classes")
    # a key's shard number needs its label's count; the counts have a row a label and length
    most = F.least(F.lit(shard_rows), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    counts = classes.groupBy("label", "dim").agg(F.count("*").alias("c")).select(F.col("label").alias("l"), F.col("dim").alias("d"), F.ceil(F.col("c") / most).cast("int").alias("shards"))
    dealt = classes.join(counts, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d"))).select("label", "dim", "rep", "n", "raw", "shards", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int").alias("shard"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        unit = _unit(pdf.raw.tolist(), int(pdf.dim.iloc[0]))
        first = pdf.iloc[:1]
        return pd.DataFrame({"label": first.label, "dim": first.dim, "shard": first.shard, "shards": first.shards,
                             "reps": pdf.rep.to_numpy(np.int64).tobytes(), "n": pdf.n.to_numpy(np.int64).tobytes(), "unit": unit.tobytes(), "graph": Graph(unit).dumps()})

    shape = f"label {kind}, dim int, shard int, shards int, reps binary, n binary, unit binary, graph binary"
    shards = materialize(dealt.groupBy("label", "dim", "shard").applyInPandas(build, shape), "shards")
    sends = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.struct(F.least(o, F.col("shard")).alias("i"), F.greatest(o, F.col("shard")).alias("j")))
    tasks = shards.withColumn("task", F.explode(sends)).withColumn("i", F.col("task.i")).withColumn("j", F.col("task.j")).drop("task", "shards")

    def query(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        sides = []
        for r in (pdf.iloc[0], pdf.iloc[-1]):
            unit = np.frombuffer(r.unit, np.float64).reshape(-1, int(r.dim))
            sides.append((np.frombuffer(r.reps, np.int64), np.frombuffer(r.n, np.int64), unit, r.graph))
        (reps_a, n_a, a, graph_a), (reps_b, n_b, b, graph_b) = sides
        same = len(pdf) == 1
        links, audited, found = _Links(a, b, threshold), 0, 0
        for unit, stored, turned in ((b, graph_b, False),) if same else ((b, graph_b, False), (a, graph_a, True)):
            graph, queries = Graph.loads(stored, unit), a if not turned else b
            beam, true, got = graph.audited_beam(queries, threshold, recall, same)
            audited, found = audited + true, found + got
            for q, t in graph.within(queries, threshold, beam):
                if same:
                    q, t = q[q != t], t[q != t]
                    links.add(t, q)
                links.add(*((t, q) if turned else (q, t)))
        reps, shift = (reps_a, 0) if same else (np.concatenate([reps_a, reps_b]), len(reps_a))
        total, label = np.zeros(len(reps), np.int64), np.arange(len(reps))
        for lo in range(0, len(a), 256):
            near = links.rows(lo, lo + 256)
            total[lo : lo + len(near)] += near @ n_b
            if not same:
                total[shift:] += n_a[lo : lo + 256] @ near
            q, t = np.nonzero(near)
            _join(label, q + lo, t + shift)
        some = total > 0
        out = pd.DataFrame({"rep": reps[some], "links": total[some], "root": reps[label[some]]}).astype("Int64")
        audits = pd.DataFrame({"rep": [None], "links": [None], "root": [None]}).astype("Int64")
        first = pdf.iloc[0]
        return pd.concat([out, audits]).assign(label=first.label, dim=first.dim, audited=[0] * len(out) + [audited], found=[0] * len(out) + [found])

    found = materialize(tasks.groupBy("label", "dim", "i", "j").applyInPandas(query, f"rep long, links long, root long, label {kind}, dim int, audited long, found long"), "links")
    audits = found.where("rep is null").groupBy("label", "dim").agg(F.sum("found").alias("f"), F.sum("audited").alias("a")).select("label", "dim", F.when(F.col("a") > 0, F.col("f") / F.col("a")).otherwise(1.0).alias("recall"))
    links = found.where("rep is not null")
    # ids need not be distinct between labels: nodes are class keys only through their least id
    joined = materialize(connected_components(links.select(F.col("rep").alias("src"), F.col("root").alias("dst"))), "joined")
    totals = links.groupBy("rep").agg(F.sum("links").alias("links"))
    # what is known of a class is gathered by class, so that rows meet their class in one join
    named = classes.select("label", "dim", "key", "rep", "n").join(totals, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(audits, ["label", "dim"], "left")
    own = packed.select("id", "label", "dim", "key").join(named, ["label", "dim", "key"])
    linked = own.select("id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "recall")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(1.0).alias("recall"))
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    discard(shards)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", "kept", "recall")
