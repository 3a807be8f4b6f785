"""Token counts by byte-pair merging over a heap and a linked list."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public split pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of a worker's table of counted pieces; beyond, it starts anew.
TABLE = 400_000
#: Longer pieces are counted each time they occur.
LONGEST_KEPT = 48
_ID = 20


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


def _check(spec: dict) -> None:
    """Refuse a file that says more than the counting below does: another model, a normaliser, another split, or options
    that change merges."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    sound = (
        model.get("type") == "BPE" and spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )
    if not sound:
        raise ValueError("the file is no plain byte-level vocabulary")


class BytePairs:
    """A byte-level vocabulary file: its merges, and the strings it treats as one token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.symbol = [vocab[letters[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << _ID | vocab[b], n << _ID | vocab[a + b])
        added = spec.get("added_tokens", [])
        if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take neighbouring text are not supported")
        texts = sorted((x["content"] for x in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, texts))) if texts else None
        self.added = {x["content"]: x["id"] for x in added}
        own = {v: k for k, v in letters.items()}
        self.ranks = {bytes(own[c] for c in t): i for t, i in vocab.items() if t not in self.added}
        #: Whether a later merge always makes a higher identifier: then identifiers rank merges as the file does.
        self.ordered = all(a < b for a, b in pairwise(r & ((1 << _ID) - 1) for _, r in sorted(self.rank.items(), key=lambda x: x[1] >> _ID)))
        self.split = regex.compile(SPLIT)
        self.table = _Counted(self)

    def merges(self, piece: str) -> int:
        """How many merges a piece takes: the adjacent pair of lowest rank, leftmost first, until none is left."""
        sym = [self.symbol[b] for b in piece.encode()]
        n = len(sym)
        if n < 2:
            return 0
        rank, done = self.rank, 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r >> _ID << 40 | i for i in range(n - 1) if (r := rank.get(sym[i] << _ID | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFFFF
            if (j := after[i]) >= n or sym[i] < 0:
                continue
            r = rank.get(sym[i] << _ID | sym[j])
            if r is None or r >> _ID != top >> 40:
                continue  # what stood here has been merged since
            sym[i], sym[j] = r & ((1 << _ID) - 1), -1
            k = after[i] = after[j]
            done += 1
            if k < n:
                before[k] = i
                if (r := rank.get(sym[i] << _ID | sym[k])) is not None:
                    heapq.heappush(heap, r >> _ID << 40 | i)
            if (h := before[i]) >= 0 and (r := rank.get(sym[h] << _ID | sym[i])) is not None:
                heapq.heappush(heap, r >> _ID << 40 | h)
        return done

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        if len(text) > 1 << 20:
            return sum(self.table[m.group()] for m in self.split.finditer(text))
        return sum(map(self.table.__getitem__, self.split.findall(text)))


class _Counted(dict):
    """Symbols minus merges by piece; holds TABLE entries at most."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, piece: str) -> int:
        n = len(piece.encode()) - self.pairs.merges(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= TABLE:
                self.clear()
            self[piece] = n
        return n


@lru_cache(4)
def byte_pairs(path: str) -> BytePairs:
    """The vocabulary at ``path``, read once in each process."""
    return BytePairs(path)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes long, n_tokens long), one for each row of ``docs``.

    The count is each piece's initial symbols minus the merges a heap of
    adjacent pairs gives; no identifiers are made. ``vocabulary`` is the path
    of a byte-level vocabulary file on every machine. A null text is empty and
    counts 0; ids may be null or repeat; texts are counted whole; strings of
    the vocabulary's special tokens count as one token; an empty table gives no
    rows; other columns are not read, whatever their names. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        pairs = byte_pairs(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.fromiter(map(pairs.count, texts), np.int64, len(texts)))],
                names=["id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
