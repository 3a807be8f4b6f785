"""Language identification by interpolated Kneser-Ney character models kept in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize
from .textcore import mix

ORDER = 4
#: Bounds of the training sample: documents of a language, code points of one of them, documents of all languages.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, SAMPLE_TOTAL = 400, 20_000, 40_000
UNKNOWN = "und"
_FACTOR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SALT = np.array([0x1000003 * (k + 2) for k in range(ORDER)], np.uint64)
#: Code points worked on at a time, about.
_RUN = 1 << 14


@lru_cache(1)
def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(1)
def _alphabet() -> int:
    """How many folded letters there are, and the space."""
    return len(np.unique(_fold()))


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of the texts, runs of spaces as one, one after another; and offsets."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=off[1:])
    c = _fold()[np.concatenate(raw)] if off[-1] else np.empty(0, np.uint32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    keep[off[:-1][off[:-1] < len(c)]] = True
    total = np.zeros(len(c) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return c[keep], total[off]


def _keys(c: np.ndarray, off: np.ndarray, before: np.ndarray | None = None) -> list[np.ndarray]:
    """For each k from 1 to ORDER the hashes of the k characters that end at a position.

    What lies before a text counts as spaces, or, for the first text, as the
    ORDER - 1 characters ``before``.
    """
    place = np.arange(len(c)) - np.repeat(off[:-1], np.diff(off))
    grams, sum_ = [np.empty(0, np.uint64)], np.zeros(len(c), np.uint64)
    for j in range(ORDER):
        x = np.full(len(c), 32, np.uint64)
        x[j:] = np.where(place[j:] >= j, c[: len(c) - j], 32)
        if before is not None and j:
            head = min(j, int(off[1]))
            x[:head] = before[len(before) - j : len(before) - j + head]
        sum_ = sum_ + x * _FACTOR[j]
        grams.append(mix(sum_ ^ _SALT[j]))
    return grams


def _spaces(k: int) -> np.uint64:
    """The hash of k spaces: what stands before a text."""
    total = np.uint64(sum(32 * int(f) for f in _FACTOR[:k]) & ((1 << 64) - 1))
    return mix(np.array([total ^ _SALT[k - 1]], np.uint64))[0]


@dataclass
class Level:
    """The sequences of one length that some language has seen, and what each adds to the languages' log probabilities.

    ``keys`` are their hashes, sorted; entries ``first[i]`` to ``first[i + 1]``
    belong to key i: a language, ``gain`` (what the sequence adds to the log
    probability of its last character, over what shorter ones say) and
    ``weight`` (what it adds, as a context, to that of the next character).
    """

    keys: np.ndarray
    first: np.ndarray
    language: np.ndarray
    gain: np.ndarray
    weight: np.ndarray

    def __post_init__(self):
        bits = max(1, int(len(self.keys) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.bucket = np.searchsorted(self.keys, np.arange((1 << bits) + 1, dtype=np.uint64)[:-1] << self.shift).astype(np.int32)
        self.bucket = np.append(self.bucket, np.int32(len(self.keys)))
        self.both = self.gain + self.weight

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of hashes; -1 where they are not held. The hashes' first bits tell where to look."""
        at = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return at
        slot = (keys >> self.shift).astype(np.int64)
        here, end = self.bucket[slot], self.bucket[slot + 1]
        todo = np.flatnonzero(here < end)
        here, end, keys = here[todo], end[todo], keys[todo]
        while len(todo):
            hit = self.keys[here] == keys
            at[todo[hit]] = here[hit]
            go = ~hit & (here + 1 < end)
            todo, keys, end, here = todo[go], keys[go], end[go], here[go] + 1
        return at

    def add(self, total: np.ndarray, rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        """Add the values of the found places to total[row, language]."""
        rows, at = rows[at >= 0], at[at >= 0]
        n = self.first[at + 1] - self.first[at]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return
        entry = np.arange(ends[-1]) + np.repeat(self.first[at] - (ends - n), n)
        cell = np.repeat(rows * total.shape[1], n) + self.language[entry]
        total += np.bincount(cell, values[entry], total.size).reshape(total.shape)


@dataclass
class LanguageModels:
    """One interpolated Kneser-Ney model for each language, in shared sorted hash arrays with an entry for each sequence
    and each language that has seen it, so that their size follows what was seen and not languages times sequences.

    The log probability of a character is ``floor`` and, for each order, the
    weight of its context and the gain of its sequence, where they were seen.
    ``limit`` is each language's highest accepted cross-entropy, ``sharpness``
    turns cross-entropies into scores.
    """

    languages: list[str]
    levels: list[Level]
    start: np.ndarray
    limit: np.ndarray
    sharpness: float = 1.0

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character of each text (row) under each language (column), and the characters counted."""
        out, lengths, at = [np.empty((0, len(self.languages)))], [np.empty(0, np.int64)], 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= _RUN):
                held += len(texts[end])
                end += 1
            ce, n = self._long(texts[at]) if held > _RUN else self._sums(texts[at:end])
            out.append(ce / np.maximum(n, 1)[:, None])
            lengths.append(n)
            at = end
        return np.concatenate(out), np.concatenate(lengths)

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The sums of one text in runs, each of which goes on where the one before it ended."""
        total, n, before = np.zeros((1, len(self.languages))), np.zeros(1, np.int64), None
        for i in range(0, len(text), _RUN):
            c, off = _letters([text[i : i + _RUN]])
            if before is not None and len(c) and c[0] == 32 and before[-1] == 32:
                c, off = c[1:], np.array([0, len(c) - 1])  # the space was counted
            if not len(c):
                continue
            total += self._of(c, off, before)[0]
            n += len(c)
            before = np.concatenate([np.full(ORDER, 32, np.uint32) if before is None else before, c[-ORDER:]])[-ORDER:]
        return -total, n

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        c, off = _letters(texts)
        return -self._of(c, off, None), np.diff(off)

    def _of(self, c: np.ndarray, off: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        n = np.diff(off)
        total = np.zeros((len(n), len(self.languages)))
        if not len(c) or not self.languages:
            return total
        total += n[:, None] * self.start
        rows = np.repeat(np.arange(len(n)), n)
        some = np.flatnonzero(n)
        last, grams = off[1:][some] - 1, _keys(c, off, before)
        for k, level in enumerate(self.levels, 1):
            if k == ORDER:
                level.add(total, rows, level.find(grams[k]), level.gain)
                continue
            # a sequence is the context of the next character, so it adds both; at a text's end there is no next one,
            # and before its beginning stand spaces or what came before
            at = level.find(grams[k])
            level.add(total, rows, at, level.both)
            level.add(total, some, at[last], -level.weight)
            opening = np.full(len(some), _spaces(k))
            if before is not None and len(some) and some[0] == 0:
                opening[0] = _keys(before[-k:], np.array([0, k]))[k][-1]
            level.add(total, some, level.find(opening), level.weight)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language (``und`` without letters), score, cross-entropy and whether the text is accepted as that language."""
        letters = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        ce, n = self.cross_entropy([t or "" for t in texts])
        best = ce.argmin(1)
        low = ce[np.arange(len(ce)), best]
        weight = np.exp(-np.minimum(self.sharpness * np.sqrt(np.maximum(n, 1))[:, None] * (ce - low[:, None]), 700))
        score = np.where(letters, 1 / weight.sum(1), 0.0)
        accepted = letters & (low <= self.limit[best] + 6 / np.sqrt(np.maximum(n, 1)))
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], score, np.where(letters, low, 0.0), accepted


def count(texts: Iterable[str]) -> list[tuple] | None:
    """Kneser-Ney statistics of one language, for orders 1 to ORDER: the sequences seen, sorted, how often (below ORDER: after
    how many characters), their contexts and what they are without their first character. None without a letter."""
    seen, often, letter = np.empty((0, 2 * ORDER - 1), np.uint64), np.empty(0, np.int64), False
    for run in _runs(texts):
        c, off = _letters(run)
        letter = letter or bool((c != 32).any())
        if not len(c):
            continue
        grams = _keys(c, off)
        begins = np.zeros(len(c), bool)
        begins[off[:-1][np.diff(off) > 0]] = True
        context = [np.where(begins, _spaces(k), np.append(np.uint64(0), grams[k][:-1])) for k in range(1, ORDER)]
        first, n = np.unique(grams[ORDER], return_index=True, return_counts=True)[1:]
        own = np.stack([*(g[first] for g in reversed(grams[1:])), *(x[first] for x in context)], 1)
        seen = np.concatenate([seen, own])
        first, back = np.unique(seen[:, 0], return_index=True, return_inverse=True)[1:]
        seen, often = seen[first], np.bincount(back, np.concatenate([often, n]), len(first)).astype(np.int64)
    if not letter:
        return None
    out = []
    for k in range(ORDER, 0, -1):
        gram = ORDER - k
        if k < ORDER:
            first, often = np.unique(seen[:, gram], return_index=True, return_counts=True)[1:]
            seen = seen[first]
        none = np.zeros(len(seen), np.uint64)
        out.append((seen[:, gram], often, seen[:, ORDER + k - 2] if k > 1 else none, seen[:, gram + 1] if k > 1 else none))
    return out[::-1]


def _runs(texts: Iterable[str]) -> Iterator[list[str]]:
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > _RUN:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


def model_of(stats: list[tuple]) -> tuple[float, list[tuple]]:
    """One language's ``start`` and, for each order, its (keys, gain, weight), from its statistics.

    For each order the discount is n1 / (n1 + 2 n2); order 0 is uniform over all letters.
    """
    letters = float(np.log(_alphabet()))
    start, found, kept, shorter = 0.0, [], (np.empty(0, np.uint64), np.empty(0)), (np.empty(0, np.uint64), np.empty(0))
    for k, (keys, often, context, tail) in enumerate(stats, 1):
        n1, n2 = (often == 1).sum(), (often == 2).sum()
        discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        contexts, at = np.unique(context, return_inverse=True)
        total = np.bincount(at, often)
        weight = np.log(discount * np.bincount(at) / total)
        below = np.full(len(keys), -letters) if k == 1 else shorter[1][np.searchsorted(shorter[0], tail)]
        logp = np.log((often - discount) / total[at] + np.exp(weight[at] + below))
        if k == 1:
            start = float(weight[0] - letters)
        else:
            found.append(_level(kept, (contexts, weight)))
        kept, shorter = (keys, logp - weight[at] - below), (keys, logp)
    found.append(_level(kept, (np.empty(0, np.uint64), np.empty(0))))
    return start, found


def _level(gains: tuple, weights: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.union1d(gains[0], weights[0])
    out = [np.zeros(len(keys), np.float32) for _ in range(2)]
    for column, (k, v) in zip(out, (gains, weights), strict=True):
        column[np.searchsorted(keys, k)] = v
    return keys, *out


def assemble(models: dict[str, tuple[float, list[tuple]]]) -> LanguageModels:
    """The languages' models in shared arrays."""
    languages = sorted(models)
    levels = []
    for k in range(ORDER if languages else 0):
        parts = [models[name][1][k] for name in languages]
        keys = np.concatenate([p[0] for p in parts])
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
        order = np.lexsort((owner, keys))
        names, first = np.unique(keys[order], return_index=True)
        levels.append(Level(names, np.append(first, len(keys)), owner[order], *(np.concatenate([p[c] for p in parts])[order] for c in (1, 2))))
    return LanguageModels(languages, levels, np.array([models[name][0] for name in languages]), np.full(len(languages), np.inf))


def fit(samples: dict[str, list[str]]) -> LanguageModels:
    """Train on texts by language; every fifth text of a language, or all of fewer than five, calibrates rejection and
    scores. Languages without letters in their texts are left out."""
    held = {k: v[::5] if len(v) >= 5 else v for k, v in samples.items()}
    stats = {k: count([t for i, t in enumerate(v) if i % 5 or len(v) < 5]) for k, v in samples.items()}
    models = assemble({k: model_of(s) for k, s in stats.items() if s is not None})
    return _calibrated(models, {k: _evidence(models, k, held[k]) for k in models.languages})


_SHARPNESS = tuple(2.0**k for k in range(-6, 5))


def _evidence(models: LanguageModels, language: str, texts: list[str]) -> tuple[float, np.ndarray]:
    """The highest cross-entropy of a language's texts under its own model, and the log likelihood of their being in it by
    each sharpness."""
    ce, n = models.cross_entropy([t for t in texts if any(map(str.isalpha, t))])
    own = models.languages.index(language)
    like = []
    for s in _SHARPNESS:
        x = -s * np.sqrt(np.maximum(n, 1))[:, None] * ce
        like.append(float((x[:, own] - np.logaddexp.reduce(x, axis=1)).sum()))
    return float(ce[:, own].max(initial=-np.inf)), np.array(like)


def _calibrated(models: LanguageModels, evidence: dict[str, tuple[float, np.ndarray]]) -> LanguageModels:
    """Reject beyond 1.3 times what the worst held-out text of a language needs, and half a nat; sharpen scores to the likeliest."""
    for j, name in enumerate(models.languages):
        highest = evidence.get(name, (-np.inf,))[0]
        models.limit[j] = 1.3 * highest + 0.5 if np.isfinite(highest) else np.inf
    if evidence:
        models.sharpness = _SHARPNESS[int(np.argmax(np.sum([like for _, like in evidence.values()], axis=0) + 1e-9 * -np.arange(len(_SHARPNESS))))]
    return models


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part


def train(docs: DataFrame, usable: Column, documents: int = SAMPLE_DOCUMENTS, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL) -> LanguageModels:
    """Fit on a sample of the rows of ``docs`` (doc_id, text, lang) that are ``usable`` and have a lang and a text.

    The sample, taken by a hash of doc_id, is bounded: ``documents`` rows a
    language (fewer, but 20 at least, where all languages together would have
    more than ``total``), and of a longer text a run of ``chars`` code points
    from a seeded place. Each language is counted and fitted in a task of its
    own; the driver gets the fitted arrays, never the texts. Rows without an
    id take part; no usable row gives models of no language.
    """
    size = F.length("text")
    begin = F.when(size > chars, F.pmod(F.xxhash64(F.lit(29), F.col("doc_id")), size - chars + 1)).otherwise(0).cast("int")
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.substring("text", begin + 1, F.lit(chars)).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return fit({})
    documents = min(documents, max(20, total // len(counts)))
    # four times the sample passes a threshold of the hash; the window then ranks only that
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * documents / n))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    draw = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    few = rows.where((place < share[F.col("lang")]) | (share[F.col("lang")] == 1.0))
    few = few.withColumn("place", F.row_number().over(draw)).where(F.col("place") <= documents)
    held = (F.col("place") % 5 == 1) | F.col("lang").isin([k for k, n in counts.items() if n < 5])
    learned = (F.col("place") % 5 != 1) | F.col("lang").isin([k for k, n in counts.items() if n < 5])
    sample = materialize(few.select("lang", "text", held.alias("held"), learned.alias("learned")), "sample")
    kind = docs.schema["lang"].dataType.simpleString()
    arrays = ", ".join(f"{c}{k} binary" for k in range(1, ORDER + 1) for c in ("keys", "gain", "weight"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        stats = count(pdf.text.tolist())
        if stats is None:
            return pd.DataFrame()
        start, levels = model_of(stats)
        return pd.DataFrame([[pdf.lang.iloc[0], start, *(x.tobytes() for level in levels for x in level)]], columns=["lang", "start", *(a.split()[0] for a in arrays.split(", "))])

    fitted = {}
    for r in sample.where("learned").groupBy("lang").applyInPandas(learn, f"lang {kind}, start double, {arrays}").toLocalIterator():
        level = lambda k, r=r: tuple(np.frombuffer(r[f"{c}{k}"], t) for c, t in (("keys", np.uint64), ("gain", np.float32), ("weight", np.float32)))
        fitted[r["lang"]] = (r["start"], [level(k) for k in range(1, ORDER + 1)])
    models = assemble(fitted)
    if models.languages:
        shared = docs.sparkSession.sparkContext.broadcast(models)

        def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
            name = pdf.lang.iloc[0]
            if name not in shared.value.languages:
                return pd.DataFrame()
            highest, like = _evidence(shared.value, name, pdf.text.tolist())
            return pd.DataFrame({"lang": [name], "highest": [highest], "likely": [like.tolist()]})

        rows = sample.where("held").groupBy("lang").applyInPandas(weigh, f"lang {kind}, highest double, likely array<double>").collect()  # one row a language
        _calibrated(models, {r["lang"]: (r["highest"], np.array(r["likely"])) for r in rows})
    discard(sample)
    return models


def identify(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, lang_pred string, score double, cross_entropy double, accepted boolean), one for each row of ``docs``.

    The language has the lowest cross-entropy a character over the whole text.
    A null text and one without letters give ``und``, score 0, not accepted; a
    text is also not accepted where its cross-entropy is beyond the language's
    calibrated limit. Ids may be null or repeat, and each row stands for
    itself; an empty table gives no rows; other columns are not read, whatever
    their names. No shuffle; the models, bounded by the training sample, are
    broadcast.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        model = shared.value
        for batch in batches:
            langs, score, ce, ok = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(ce), pa.array(ok)], names=["id", "lang_pred", "score", "cross_entropy", "accepted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, cross_entropy double, accepted boolean").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """The rows of ``docs`` (text and any more columns) whose text is accepted as some language, as they are.

    A null text and one without letters are not accepted and go; ids and other
    columns may be null; repeated rows are each kept or each dropped; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.predict(batch.column(at).to_pylist())[3]))

    return docs.mapInArrow(run, docs.schema)
