"""Balanced label propagation: documents move towards the shards of those they are linked with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize, with_running_totals

SHARDS = 16
_PARTS = 64


def _share(value: Column, salt: int) -> Column:
    """A uniform double in [0, 1) from a column."""
    return F.pmod(F.xxhash64(F.lit(salt), value), F.lit(1 << 40)) / float(1 << 40)


def _largest() -> Column:
    """What the cells of a hub are compared by: the size, then a hash, so that ties favour no shard."""
    return F.struct(F.col("n"), F.xxhash64("hub", "shard").alias("tie"), F.col("shard"))


def propagate(cells: DataFrame, shards: int, capacity: int) -> DataFrame:
    """Move cells (hub, shard, n: what a hub's linked documents measure in a shard) until each hub has one: rows (hub, shard, n).

    Each round, a hub's cells aim at the shard that holds most of it (ties: by
    a hash). A shard's room is what it lacks and what wants to leave it. It
    takes whole cells by votes, largest first, until its room is used up (the
    last may go beyond it); where it ends is found from sums over classes of
    votes and of a hash, and cell by cell only in the class in which it ends,
    so no shard's movers are gathered in one place. Rounds go on until nothing
    moves; each move joins a cell to a larger one, so they end. Hubs that are
    divided even then join their largest cell without regard to room.
    """
    cells = materialize(cells.withColumn("moved", F.lit(1).cast("long")), "cells")
    while True:
        aims = cells.join(cells.groupBy("hub").agg(F.max(_largest()).alias("best")), "hub").withColumn("aim", F.col("best.shard"))
        rank = F.floor(F.log2("best.n")).cast("int")
        part = (63 - rank) * _PARTS + F.pmod(F.xxhash64("hub", "shard"), F.lit(_PARTS)).cast("int")
        aims = moving = materialize(aims.select("hub", "shard", "n", "moved", "aim", F.when(F.col("aim") != F.col("shard"), part).alias("class")), "aims")
        state = aims.groupBy("shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved"), F.sum(F.when(F.col("class").isNotNull(), F.col("n"))).alias("leave")).collect()  # one row a shard
        if not any(r["moved"] for r in state) or not any(r["leave"] for r in state):
            break
        lacks = {r["shard"]: capacity - r["n"] + (r["leave"] or 0) for r in state}
        room = {s: max(0, lacks.get(s, capacity)) for s in range(shards)}
        sums = aims.where("class is not null").groupBy("aim", "class").agg(F.sum("n").alias("all"))
        run = Window.partitionBy("aim").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
        limit = F.create_map(*(x for s, r in room.items() for x in (F.lit(s), F.lit(r).cast("long"))))
        # at most shards * 64 * _PARTS rows
        sums = sums.withColumn("left", limit[F.col("aim")] - F.coalesce(F.sum("all").over(run), F.lit(0)))
        aims = aims.join(F.broadcast(sums), ["aim", "class"], "left")
        ends = F.coalesce((F.col("left") > 0) & (F.col("left") < F.col("all")), F.lit(False))
        upto = Window.partitionBy("aim", "class").orderBy(F.xxhash64(F.lit(3), "hub", "shard"), "hub", "shard").rowsBetween(Window.unboundedPreceding, -1)
        last = aims.where(ends).withColumn("go", F.coalesce(F.sum("n").over(upto), F.lit(0)) < F.col("left"))
        after = aims.where(~ends).withColumn("go", F.coalesce(F.col("left") >= F.col("all"), F.lit(False))).unionByName(last)
        after = after.select("hub", F.when(F.col("go"), F.col("aim")).otherwise(F.col("shard")).alias("shard"), "n", F.when(F.col("go"), F.col("n")).otherwise(F.lit(0)).alias("moved"))
        last, cells = cells, materialize(after.groupBy("hub", "shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved")), "cells")
        discard(last, moving)
    return cells.groupBy("hub").agg(F.max(_largest())["shard"].alias("shard"), F.sum("n").alias("n"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", link_col: str | None = None) -> DataFrame:
    """Rows (id_col, size, text_crc32, law, shard int, slot long), one for each row of ``docs``.

    Documents that share ``link_col`` (default: that have equal texts) are
    linked. They start in shards by a hash of their ids and move by
    ``propagate``, each group to one shard; documents without links then fill
    what room is left. Room and votes are counted in rows or bytes, as the law
    asks. The order (shard, links, id) is cut where the law asks,
    whatever the shards hold: ``rows``: shard counts at most one apart;
    ``bytes``: sizes at most one document apart. A link group is cut only at
    one of the shards - 1 cuts.

    Size is UTF-8 bytes plus 1. A null text has no bytes, crc32 0, and is
    linked with other null texts; ids may be null or repeat; an empty table
    gives no rows; other columns are not read.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    text = F.col(text_col)
    binary = F.coalesce(text.cast("binary"), F.lit(b"").cast("binary"))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(binary) + 1).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"),
            F.xxhash64(F.lit(71), text if link_col is None else F.col(link_col)).alias("hub"),
        ),
        "sizes",
    )
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    n, capacity = total["n"], total["n" if law == "rows" else "size"] // shards
    measure = F.count("*") if law == "rows" else F.sum("size")
    start = F.pmod(F.xxhash64(F.lit(5), F.col("id")), F.lit(shards)).cast("int")
    hubs = rows.groupBy("hub").agg(F.count("*").alias("c")).where("c > 1").select("hub")
    cells = rows.groupBy("hub", start.alias("shard")).agg(measure.alias("n")).join(hubs, "hub", "left_semi")
    cells = materialize(propagate(cells, shards, capacity), "cells")
    held = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    free = [max(0, capacity - held.get(s, 0)) for s in range(shards)]
    ends = [sum(free[: s + 1]) / max(1, sum(free)) for s in range(shards)]
    both = rows.join(cells.select("hub", F.col("shard").alias("home")), "hub", "left")
    u = _share(F.col("id"), 11)
    alone = F.coalesce(*(F.when(u < e, F.lit(s)) for s, e in enumerate(ends[:-1])), F.lit(shards - 1))
    # documents without links stand at both ends of a shard's run, so that a cut falls among them
    zone = F.when(F.col("home").isNotNull(), F.lit(1)).otherwise(F.when(_share(F.col("id"), 13) < 0.5, F.lit(0)).otherwise(F.lit(2)))
    placed = both.select("id", "size", "text_crc32", "hub", F.coalesce("home", alone).alias("label"), zone.alias("zone"))
    ranked = with_running_totals(placed, ["label", "zone", "hub", "id"], {"before": "size"} if law == "bytes" else {}, "rank")
    if law == "rows":
        q, r = divmod(n, shards)
        large = r * (q + 1)
        rank = F.col("rank")
        q_ = max(1, q)
        shard = F.when(rank < large, F.floor(rank / (q + 1))).otherwise(r + F.floor((rank - large) / q_)).cast("int")
        slot = F.when(rank < large, rank % (q + 1)).otherwise((rank - large) % q_)
        out = ranked.select("id", "size", "text_crc32", shard.alias("shard"), slot.cast("long").alias("slot"))
    else:
        shard = F.least(F.lit(shards - 1), F.expr(f"before * {shards} div {max(1, total['size'])}")).cast("int")
        cut = materialize(ranked.select("id", "size", "text_crc32", "rank", shard.alias("shard")), "cut")
        firsts = cut.groupBy("shard").agg(F.min("rank").alias("first"))  # one row a shard
        out = cut.join(F.broadcast(firsts), "shard").select("id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot")
