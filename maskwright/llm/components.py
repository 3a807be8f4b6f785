"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of ``edges`` (src, dst: long); the
    component is the smallest node that can be reached.

    Alternating large-star and small-star rounds: each node's neighbours are
    pointed at the smallest one, so the rounds grow with the logarithm of the
    longest chain. Minima are taken by a partial aggregation and joined back,
    so a node with many neighbours is never gathered in one place. Null ends
    and self-loops link nothing; repeated edges and either direction count
    once; no edges give no rows. A round's table goes when the next one is
    written.
    """
    pairs = (
        edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .where("src is not null and dst is not null and hi != lo")
        .distinct()
    )
    pairs = materialize(pairs, "pairs")
    seen = None
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi")
        last, pairs = pairs, materialize(
            small.select(F.col("hi"), F.col("m").alias("lo"))
            .union(small.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
            .distinct(),
            "pairs",
        )
        discard(last)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
