"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash space."""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shuffle_partitions
from .textcore import mix, shingle_sets

#: One in so many shingle hashes is retained, whatever the length of a text.
SCALE = 8


Sketch = tuple[int, str, np.ndarray]


def retained(column: pa.Array, scale: int = SCALE, width: int = 5) -> list[Sketch]:
    """For each text its number of distinct shingles, a digest of their set, and the sorted hashes below 2**64 / scale."""
    bound = np.uint64((1 << 64) // scale)
    return [(len(s), f"{int(mix(s).sum(dtype=np.uint64)):016x}", s[: np.searchsorted(s, bound)]) for s in shingle_sets(column, width)]


def encode(sketch: Sketch) -> str:
    """``<distinct shingles>:<digest of the set>:<retained hashes, 16 hex digits each, ascending>``."""
    return f"{sketch[0]}:{sketch[1]}:{sketch[2].astype('>u8').tobytes().hex()}"


def decode(fingerprint: str) -> Sketch:
    size, digest, hashes = fingerprint.split(":")
    return int(size), digest, np.frombuffer(bytes.fromhex(hashes), ">u8").astype(np.uint64)


def merge(a: str, b: str) -> str:
    """The fingerprint of two texts' shingles together; the size is estimated from what is retained, the digest is left out."""
    (n, _, x), (m, _, y) = decode(a), decode(b)
    both = np.union1d(x, y)
    shared = len(x) + len(y) - len(both)
    kept = len(x) + len(y)
    return encode((round((n + m) * (1 - shared / kept)) if kept else n + m, "", both))


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of the smaller text's shingles that the larger text holds, 0 to 1.

    Equal sets have 1 (two empty ones too). Else it is 0 where either sketch
    retains nothing: no words, or a short text none of whose hashes fell below
    the bound.
    """
    x, y = a[2], b[2]
    if a[0] == b[0] and a[1] == b[1] != "":
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return float((y[np.minimum(at, len(y) - 1)] == x).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Rows (id_col, fingerprint string), one for each row of ``docs``; null text is empty.

    Ids may be null or repeat; an empty table gives no rows; other columns are
    not read, whatever their names. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            prints = [encode(s) for s in retained(batch.column(1), scale)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows, and code points of their texts, that are compared at a time.
_BATCH, _CHARS = 256, 1 << 21


def compare_with_following(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprint each text, its edited text (see ``edited_text``) and compare both, and the next document.

    ``docs``: doc_id long, text string; further columns are ignored. The next
    document follows in ascending (doc_id, text) order, nulls first; after the
    last comes the first, which for a single row is itself. Null text is
    empty. One row for each row, repeated rows included; an empty table gives
    no rows.

    Texts are shuffled once. Split points of doc_id (as many as there are
    shuffle partitions, times 8) cut the table into runs; each run also gets
    the row that follows it, so no run needs another.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n = 8 * shuffle_partitions(spark)
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))

    def locate(batches):
        for batch in batches:
            ids = batch.column(0)
            run = np.searchsorted(np.array(cuts, np.int64), ids.fill_null(0).to_numpy(), "left")
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.where(ids.is_null(), 0, run).astype(np.int32))], names=["doc_id", "run"])

    # The first row of each run: as many rows as there are runs, whatever the table's size.
    firsts = ids.mapInArrow(locate, "doc_id long, run int").groupBy("run").agg(F.min("doc_id").alias("id"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()
    firsts = sorted((r["run"], None if r["nulls"] else r["id"]) for r in firsts)
    runs = [r for r, _ in firsts]
    if not runs:
        return spark.createDataFrame([], _OUT)
    also = {}  # the first doc_id of each run -> the run before it, and how that run knows it
    for k, (_, first) in enumerate(firsts):
        also[first] = runs[k - 1]
    last = runs[-1]

    def place(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at, to, guest = [], [], []
            for i, v in enumerate(ids):
                own = 0 if v is None else bisect.bisect_left(cuts, v)
                at.append(i), to.append(own), guest.append(0)
                if v in also:
                    at.append(i), to.append(also[v]), guest.append(2 if also[v] == last and own == runs[0] else 1)
            out = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(to, pa.int32()), pa.array(guest, pa.int32())], names=["doc_id", "text", "run", "guest"])

    def compare(batches):
        queue: list[tuple] = []  # rows and their successors
        size = 0

        def flush(pairs):
            texts = [p[1] for p in pairs]
            edited = [edited_text(p[1], p[2][1]) for p in pairs]
            own = retained(pa.array(texts, pa.large_string()), scale)
            new = retained(pa.array(edited, pa.large_string()), scale)
            follow = own[1:] + retained(pa.array([pairs[-1][2][1]], pa.large_string()), scale)
            # a pair's follower is the next pair's own text, but where a run ends
            for k in range(len(pairs) - 1):
                if pairs[k][2][1] is not texts[k + 1]:
                    follow[k] = retained(pa.array([pairs[k][2][1]], pa.large_string()), scale)[0]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pairs], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([encode(s) for s in own]),
                    pa.array([encode(s) for s in new]),
                    pa.array([containment(a, b) for a, b in zip(own, new, strict=True)], pa.float64()),
                    pa.array([containment(a, b) for a, b in zip(own, follow, strict=True)], pa.float64()),
                ],
                names=[c.split()[0] for c in _OUT.split(", ")],
            )

        run, held, done = None, None, False
        for batch in batches:
            for doc_id, text, r, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != run:
                    run, held, done = r, None, False
                if held is not None and not done:
                    queue.append((held[0], held[1], (doc_id, text)))
                    size += len(held[1]) + len(text)
                if guest:
                    done = True  # the run's rows end here; a guest's repeats have the same doc_id
                else:
                    held = (doc_id, text)
                if len(queue) >= _BATCH or size >= _CHARS:
                    yield flush(queue)
                    queue.clear()
                    size = 0
        if queue:
            yield flush(queue)

    placed = rows.mapInArrow(place, "doc_id long, text string, run int, guest int")
    ordered = placed.repartition(shuffle_partitions(spark), "run").sortWithinPartitions("run", "guest", "doc_id", "text")
    return ordered.mapInArrow(compare, _OUT)
