"""Word and shingle hashes of whole texts, in numpy over Arrow buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D after A-Z are
lower-cased. Hashes are 64-bit and the same in every process. Texts are worked
on in pieces cut at white space, so memory follows the piece, not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: One odd factor for each place in a shingle.
_PLACE = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1) + 0xA0761D6478BD642E * i) & _M | 1 for i in range(64)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _piece_words(b: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased bytes, and each word's first byte. No word spans two texts."""
    n = len(b)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = ~_SPACE[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = starts_of_texts[(starts_of_texts > 0) & (starts_of_texts < n)]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[e] - total[s]) * down[s]
    return mix(h ^ ((e - s).astype(np.uint64) << np.uint64(48))), s


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def _cuts(b: np.ndarray) -> list[int]:
    """Where to cut one long text: at white space, in steps of PIECE."""
    cuts, at = [0], 0
    while len(b) - at > PIECE:
        gap = np.flatnonzero(_SPACE[b[at + PIECE :]][: PIECE])
        step = PIECE
        while not len(gap) and at + PIECE + step < len(b):
            gap = np.flatnonzero(_SPACE[b[at + PIECE + step :]][: PIECE]) + step
            step += PIECE
        if not len(gap):
            break
        at += PIECE + int(gap[0])
        cuts.append(at)
    return [*cuts, len(b)]


def words_by_text(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, word hashes, offsets of the rows' words) for runs of rows, in order."""
    data, off = text_buffers(column)
    row, rows = 0, len(off) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + PIECE, "right")) - 1)
        b = _LOWER[data[off[row] : off[end]]]
        if end == row + 1 and len(b) > PIECE:
            cuts = _cuts(b)
            parts = [_piece_words(b[i:j], np.empty(0, np.int64))[0] for i, j in zip(cuts, cuts[1:], strict=False)]
            h = np.concatenate(parts)
            yield row, h, np.array([0, len(h)])
        else:
            begin = off[row : end + 1] - off[row]
            h, s = _piece_words(b, begin[:-1])
            yield row, h, np.searchsorted(s, begin)
        row = end


def shingles_by_text(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, shingle hashes with repeats, offsets of the rows' shingles) for runs of rows.

    A text with fewer than ``width`` words, but at least one, has one shingle:
    its whole word sequence. A text without words has none.
    """
    for row, h, off in words_by_text(column):
        n = np.diff(off)
        count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
        out = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=out[1:])
        if not out[-1]:
            yield row, np.empty(0, np.uint64), out
            continue
        first = np.repeat(off[:-1] - out[:-1], count) + np.arange(out[-1])
        full = np.repeat(n >= width, count)
        acc = np.zeros(out[-1], np.uint64)
        for j in range(width):
            i = first + j
            there = full | (np.repeat(off[1:], count) > i)
            acc += np.where(there, h[np.minimum(i, len(h) - 1)] * _PLACE[j], np.uint64(0))
        acc += np.where(full, np.uint64(0), np.repeat(n, count).astype(np.uint64) * _PLACE[63])
        yield row, mix(acc), out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    v = np.sort(values)
    keep = np.empty(len(v), bool)
    keep[0] = True
    np.not_equal(v[1:], v[:-1], out=keep[1:])
    return v[keep]


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row, in order."""
    for _, h, off in shingles_by_text(column, width):
        for i, j in zip(off[:-1], off[1:], strict=True):
            yield distinct(h[i:j])
