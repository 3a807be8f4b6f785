"""Quality classifier by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import distinct, mix, text_buffers, words_by_text

#: Bounds of the training sample: trusted positives and unlabelled rows.
POSITIVES, UNLABELLED = 4000, 8000
_CLASSES = 12
_CLASS = np.full(256, 11, np.uint8)  # bytes of other letters
for _i, _bytes in enumerate([b" ", b"\n\r", b"\t\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".,;:", b"!?", b"|", b"#$%&*+=/\\<>@^_~`", b"\"'()[]{}-"]):
    _CLASS[list(_bytes)] = _i
_COUNTS = 10
WIDTH = 256 + _CLASSES * _CLASSES + _COUNTS


def features(column: pa.Array) -> np.ndarray:
    """For each text: roots of the shares of its bytes and of neighbouring classes of bytes, a few lengths, and how
    much of it repeats (words, neighbouring words, runs of three words, the commonest word)."""
    data, off = text_buffers(column)
    out = np.zeros((len(off) - 1, WIDTH), np.float32)
    for row, h, ends in words_by_text(column):
        for i, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if z - a > 1:
                out[row + i, -4:] = _repeats(h[a:z])
    for i, (a, z) in enumerate(zip(off[:-1], off[1:], strict=True)):
        n = z - a
        if not n:
            continue
        b = data[a:z]
        k = _CLASS[b].astype(np.intp)
        pairs = np.bincount(k[:-1] * _CLASSES + k[1:], minlength=_CLASSES * _CLASSES)
        classes = np.bincount(k, minlength=_CLASSES)
        spaces = classes[0] + classes[1] + classes[2]
        out[i, :256] = np.sqrt(np.bincount(b, minlength=256) / n)
        out[i, 256:-_COUNTS] = np.sqrt(pairs / max(1, n - 1))
        words = spaces + 1
        out[i, -_COUNTS:-4] = (np.log1p(n) / 10, n / words / 20, classes[1] / words, classes[9] / words, classes[7] / words, classes[8] / words)
    return out


def _repeats(w: np.ndarray) -> tuple[float, float, float, float]:
    n = len(w)
    words = np.sort(w)
    starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    top = np.diff(np.append(starts, n)).max()
    three = len(distinct(mix(w[:-2]) + mix(w[1:-1]) * np.uint64(3) + w[2:])) / (n - 2) if n > 2 else 1.0
    return len(starts) / n, float((w[1:] == w[:-1]).mean()), three, top / n


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64), -30, 30)))


def _descend(gradient, width: int, steps: int, rate: float) -> np.ndarray:
    """Adam from zero; deterministic."""
    w, m, v = (np.zeros(width) for _ in range(3))
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The largest share of the positives' scores that the unlabelled scores can hold: the least ratio of
    the two shares above any threshold that at least half of the positives reach."""
    cuts = np.quantile(p, np.linspace(0, 0.5, 51))
    ratio = [(u >= c).mean() / (p >= c).mean() for c in cuts]
    return float(np.clip(min(ratio), 0.02, 0.98))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with logistic loss, and the direction to descend against: its
    gradient, or, while the bracket is negative, the bracket's upwards."""
    zp, zu = p @ w, u @ w
    rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    up = p.T @ (_sigmoid(zp) - 1) / len(p)
    down = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
    return float(prior * np.logaddexp(0, -zp).mean() + max(0.0, rest)), prior * up + down if rest >= 0 else -down


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 400, decay: float = 1e-3) -> Scorer:
    """Minimise the non-negative ``risk`` of a linear scorer.

    Where the class prior is not given, it is estimated from a scorer that
    tells half of the positives from the unlabelled, on the other half.
    """
    x = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 0.02
    p, u = ((y - mean) / scale for y in (positive.astype(np.float64), unlabelled.astype(np.float64)))
    p, u = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    if prior is None:
        a, b = p[::2], p[1::2] if len(p) > 1 else p
        plain = _descend(lambda w: a.T @ (_sigmoid(a @ w) - 1) / len(a) + u.T @ _sigmoid(u @ w) / len(u) + decay * w, p.shape[1], steps, 0.02)
        prior = estimate_prior(b @ plain, u @ plain)
    w = _descend(lambda w: risk(w, p, u, prior)[1] + decay * w, p.shape[1], steps, 0.02)
    return Scorer(mean.astype(np.float32), scale.astype(np.float32), w[:-1].astype(np.float32), float(w[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, usable: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Scorer:
    """Fit on bounded samples, taken by hashes of doc_id and text, of the ``usable`` rows: trusted positives (rows whose id
    has labels.quality = 1) and unlabelled rows of ``docs``. Features are made on the executors.

    An id that repeats brings its rows in hash order until the bound is met; a
    row may be in both samples. Rows without an id take no part. Without any
    trusted positive the scorer gives 0.5 for every text.
    """
    some = docs.where(usable & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    draw = lambda salt: F.xxhash64(F.lit(salt), F.col("doc_id"))
    marked = labels.where(usable & (F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = {r[0] for r in marked.orderBy(draw(3), "doc_id").limit(positives).collect()}
    rest = {r[0] for r in some.select("doc_id").orderBy(draw(4), "doc_id").limit(unlabelled).collect()}

    def make(batches):
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "place", "x"])

    def sample(ids: set[int], salt: int, most: int) -> np.ndarray:
        rows = some.where(F.col("doc_id").isin(sorted(ids))).withColumn("place", F.xxhash64("text")).mapInArrow(make, "doc_id long, place long, x binary")
        rows = rows.orderBy(draw(salt), "doc_id", "place").limit(most).collect() if ids else []
        return np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, WIDTH)

    p, u = sample(good, 3, positives), sample(rest, 4, unlabelled)
    if not len(p) or not len(u):
        return Scorer(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), np.zeros(WIDTH, np.float32), 0.0, 0.5)
    return fit(p, u)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, score double in 0..1), one for each row of ``docs``, from the whole text alone.

    Null and empty texts have the features of an empty text. Ids may be null
    or repeat, and equal texts have equal scores; an empty table gives no rows;
    other columns are not read, whatever their names. No shuffle; the scorer
    has a fixed size.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(features(batch.column(1))))], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
