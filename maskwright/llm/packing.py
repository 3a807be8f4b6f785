"""Packing along a space-filling curve: neighbours on a Hilbert curve share sequences."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import materialize, with_running_totals
from .token_counts import SPLIT, byte_pairs

LENGTH = 1024
DIMENSIONS, BITS = 4, 12
_CLASSES = 4096
#: Tokens of a range of the curve, about; bits of a key below a bucket's.
RANGE, SHIFT = 2_000_000, DIMENSIONS * BITS - 17


@lru_cache(2)
def _encoder(vocabulary: str):
    """A function from a text to the library's ids for the vocabulary file (special strings as one id)."""
    pairs = byte_pairs(vocabulary)
    if not pairs.ordered:
        raise ValueError("the file's identifiers do not follow its merges, so its ids cannot be made from ranks")
    plain = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=pairs.ranks, special_tokens={}).encode_to_numpy

    def encode(text: str) -> np.ndarray:
        if pairs.special is None or not pairs.special.search(text):
            return plain(text, disallowed_special=())
        out, at = [], 0
        for m in pairs.special.finditer(text):
            out += [plain(text[at : m.start()], disallowed_special=()), np.array([pairs.added[m.group()]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, plain(text[at:], disallowed_special=())])

    return encode


@lru_cache(1)
def _directions(seed: int = 7) -> np.ndarray:
    """Random directions of the hashed vectors' classes in the few dimensions."""
    return np.random.default_rng(seed).standard_normal((_CLASSES, DIMENSIONS)).astype(np.float32)


def project(ids: np.ndarray) -> np.ndarray:
    """A document's hashed token counts (square roots, unit length), projected to few dimensions."""
    classes = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
    counts = np.sqrt(np.bincount(classes, minlength=_CLASSES)).astype(np.float32)
    norm = float(np.sqrt(counts @ counts))
    return counts @ _directions() / norm if norm else np.zeros(DIMENSIONS, np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys on the Hilbert curve of points (rows) with integer coordinates below 2**bits.

    Gray-code form: rotate and reflect the axes from the highest bit down, undo
    the excess, then interleave the bits.
    """
    x = [c.astype(np.uint64) for c in points.T]
    n, one = len(x), np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] if i == 0 else x[i] ^ swap
        q >>= one
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | ((x[i] ^ t) >> np.uint64(b) & one)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Keys of projected vectors; each coordinate is squeezed into its range by a fixed sigmoid."""
    grid = 1 / (1 + np.exp(-2.0 * vectors.astype(np.float64)))
    return hilbert(np.minimum((grid * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)).astype(np.int64)


def curve_ranges(coded: DataFrame, range_tokens: int = RANGE) -> tuple[DataFrame, int]:
    """Rows (bucket, range, ranges) and the number of ranges: where on the curve a range of about ``range_tokens`` begins.

    Token totals of 2**17 equal stretches of the curve (buckets, so many rows
    at most) are summed up along it. A bucket belongs to the range in which it
    begins; one with more tokens than a range is spread over as many ranges as
    it fills, by a hash of its documents. Tables of more than 50,000 ranges
    get longer ones.
    """
    tokens = F.octet_length("raw") / F.when(F.col("small"), 2).otherwise(4)
    sums = materialize(coded.groupBy(F.shiftright("curve", SHIFT).alias("bucket")).agg(F.sum(tokens.cast("long")).alias("n")), "buckets")
    total = sums.agg(F.sum("n")).first()[0] or 0
    size = max(range_tokens, -(-total // 50_000))
    before = with_running_totals(sums, ["bucket"], {"before": "n"}, "rank")
    ranges = before.select("bucket", F.expr(f"before div {size}").alias("range"), F.ceil(F.col("n") / size).cast("int").alias("ranges"))
    return ranges, max(1, -(-total // size))


_PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", range_tokens: int = RANGE) -> DataFrame:
    """Pack whole texts into sequences of at most ``length`` tokens.

    A document is its ids by ``vocabulary`` and then ``end_id``. Documents are
    range-sorted by the Hilbert key of their projected vectors (then id), and
    each range is cut into full sequences; only its last one may be short, so
    padding is below ``length`` tokens a range. Ranges follow from exact token
    totals along the curve (see ``curve_ranges``), so a rerun gives the same
    sequences.

    Rows, one for each piece: id_col, start, length, doc_tokens, sequence_id,
    offset long, ids binary (little-endian unsigned 32-bit). A null text is
    empty: its piece is ``end_id`` alone. Ids may be null or repeat: repeated
    rows are packed each. Ties on the curve go by id and ids' bytes. An empty
    table gives no rows; other columns are not read, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ids_kind = to_arrow_type(docs.schema[id_col].dataType)

    def encode(batches):
        ids_of = _encoder(vocabulary)
        small = max(byte_pairs(vocabulary).ranks.values()) < 65536 and all(v < 65536 for v in byte_pairs(vocabulary).added.values()) and end_id < 65536
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = [ids_of(t or "") for t in part.column(1).to_pylist()]
                keys = curve_keys(np.array([project(v) for v in ids]).reshape(len(ids), DIMENSIONS))
                raw = [np.append(v, np.uint32(end_id)).astype("<u2" if small else "<u4").tobytes() for v in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array(raw, pa.binary()), pa.array([small] * len(ids))], names=["id", "curve", "raw", "small"])

    coded = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, f"id {kind}, curve long, raw binary, small boolean"), "coded")
    ranges, count = curve_ranges(coded, range_tokens)
    placed = coded.withColumn("bucket", F.shiftright("curve", SHIFT)).join(F.broadcast(ranges), "bucket")
    part = F.col("range") + F.pmod(F.xxhash64("id", "raw"), F.col("ranges"))
    sorted_ = placed.select("id", "curve", "raw", "small", part.alias("range")).repartition(count, "range").sortWithinPartitions("range", "curve", "id", "raw")

    def lay(batches):
        now, at = None, 0  # the range, and its tokens so far
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            held = 0
            for doc, raw, small, range_ in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3)), strict=True):
                if range_ != now:
                    now, at = range_, 0
                ids = np.frombuffer(raw, "<u2" if small else "<u4").astype("<u4")
                n, start = len(ids), 0
                while start < n:
                    take = min(n - start, length - at % length)
                    for column, v in zip(out, (doc, start, take, n, (now << 33) + at // length, at % length, ids[start : start + take].tobytes()), strict=True):
                        column.append(v)
                    start += take
                    at += take
                held += n
                if held > 1 << 21:
                    yield _batch(out, ids_kind)
                    out, held = [[] for _ in range(7)], 0
            if out[0]:
                yield _batch(out, ids_kind)

    return sorted_.select("id", "raw", "small", "range").mapInArrow(lay, f"id {kind}, {_PIECE}").withColumnRenamed("id", id_col)


def _batch(columns: list[list], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
