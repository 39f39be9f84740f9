"""Words and shingles of whole Arrow text columns as 64-bit hashes, in numpy, without a Python loop per word.

A word is a run of ``[^\\x20\\x09-\\x0D]``, with A-Z lower-cased. All separators are ASCII, so the
UTF-8 bytes can be cut as they are. Word hashes are polynomial hashes modulo 2^64 taken from a running
sum, cut into pieces of a quarter of a megabyte, so memory stays bounded for texts of any length, and what a
worker keeps after its task stays small.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"

_PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, out=up), np.cumprod(down, out=down)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    word = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word, lower-cased."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _PIECE, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        if high - low > _PIECE:  # one very long word: piece by piece
            out[at] = _long_word(data[low:high])
            at += 1
            continue
        up, down = _powers(_PIECE)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUE[_LOWER[data[low:high]]] * up[: high - low], out=total[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def _long_word(data: np.ndarray) -> np.uint64:
    up, _ = _powers(_PIECE)
    total, scale, step = 0, 1, pow(int(_BASE), _PIECE, 1 << 64)
    for k in range(0, len(data), _PIECE):
        part = _VALUE[_LOWER[data[k : k + _PIECE]]]
        total = (total + scale * int((part * up[: len(part)]).sum())) % (1 << 64)
        scale = scale * step % (1 << 64)
    return mix(np.array([(total + len(data)) % (1 << 64)], np.uint64))[0]


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words; a row with fewer words gives its whole sequence once."""
    first = np.searchsorted(rows, np.arange(n_rows))
    count = np.searchsorted(rows, np.arange(n_rows), "right") - first
    n = max(len(words) - size + 1, 0)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = value * _BASE + words[k : k + n]
    same = rows[:n] == rows[size - 1 :] if n else np.zeros(0, bool)
    value, owner = mix(value[same] + np.uint64(size)), rows[:n][same]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        few = np.empty(len(short), np.uint64)
        for j, r in enumerate(short):
            x = 0
            for w in words[first[r] : first[r] + count[r]]:
                x = (x * int(_BASE) + int(w)) % (1 << 64)
            few[j] = (x + int(count[r])) % (1 << 64)
        value, owner = np.concatenate((value, mix(few))), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


def slices(data_offsets: np.ndarray, limit: int):
    """Ranges of rows of at most ``limit`` bytes together; a longer row stands alone."""
    at, n = 0, len(data_offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(data_offsets, data_offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)
