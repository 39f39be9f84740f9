"""Periodic runs of words by seeds and extension along diagonals.

A run of period q and length of at least max(6, 4q) makes the words q apart equal over at least max(6 - q, 3q) places.
Lags are taken in classes from 2^j to 2^(j+1) - 1, and a class is searched with grams of the least overlap its lags
guarantee: 5 words for lag 1, else 3 * 2^j. Such a gram is no shorter than the lag, so inside a run its next occurrence
lies exactly one smallest period on: pairs of neighbouring occurrences in one document are all seeds there are, and
they are no more than the words. A seed is extended to both sides along its lag until words differ. A table of the
furthest place covered at each lag keeps later seeds of the same stretch from being extended again.

Words are numbered exactly, by a dictionary of their bytes; hashes of grams only propose seeds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from modelkeel.llm.hashing import mix
from modelkeel.session import spread

LEAST_LENGTH, LEAST_TIMES = 6, 4
#: Words of one search; a document with more is searched alone.
WORDS_AT_ONCE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _gram_length(j: int) -> int:
    """Least number of places at which words a lag of class ``j`` apart are equal in a run."""
    return min(max(LEAST_LENGTH - q, (LEAST_TIMES - 1) * q) for q in range(1 << j, 2 << j))


def _seeds(words: np.ndarray, owner: np.ndarray, sizes: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of class ``j`` where a gram of a document occurs next in it; by lag and place."""
    k, low, high = _gram_length(j), 1 << j, 2 << j
    long_enough = sizes[owner] >= max(LEAST_LENGTH, LEAST_TIMES * low)
    places = np.flatnonzero(long_enough)
    places = places[places + k <= len(words)]
    places = places[owner[places] == owner[places + k - 1]]
    if not len(places):
        return places, places
    # hash of the k words from each place, by doubling: any k in log2(k) steps
    value, power, total, done = mix(words.astype(np.uint64) + np.uint64(1)), int(_BASE), np.zeros(len(places), np.uint64), 0
    step = 1
    while step <= k:
        if k & step:
            total = total * np.uint64(power) + value[places + done]
            done += step
        if 2 * step <= k:
            longer = np.zeros(len(value), np.uint64)
            longer[: len(value) - step] = value[: len(value) - step] * np.uint64(power) + value[step:]
            value, power = longer, power * power % (1 << 64)
        step *= 2
    total = mix(total)
    order = np.argsort(total, kind="stable")
    a, b = places[order[:-1]], places[order[1:]]
    lag = b - a
    hit = (total[order[:-1]] == total[order[1:]]) & (lag >= low) & (lag < high) & (owner[a] == owner[b])
    a, lag = a[hit], lag[hit]
    order = np.lexsort((a, lag))
    return a[order], lag[order]


def _differs(words: np.ndarray, a: int, lag: int, stop: int) -> int:
    """First place from ``a`` on, before ``stop``, whose word is not that ``lag`` further; ``stop`` if there is none."""
    size = 32
    while a < stop:
        end = min(stop, a + size)
        unlike = np.flatnonzero(words[a:end] != words[a + lag : end + lag])
        if len(unlike):
            return a + int(unlike[0])
        a, size = end, size * 2
    return stop


def _agrees_from(words: np.ndarray, a: int, lag: int, start: int) -> int:
    """Least place from which on, up to ``a``, every word is that ``lag`` further; not before ``start``."""
    size = 32
    while a > start:
        begin = max(start, a - size)
        unlike = np.flatnonzero(words[begin:a] != words[begin + lag : a + lag])
        if len(unlike):
            return begin + int(unlike[-1]) + 1
        a, size = begin, size * 2
    return start


def runs(words: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (document, start in ``words``, length, smallest period) of all runs, by document, start and period.

    ``words`` are the word numbers of documents one after another, ``owner`` the document of each, ``sizes`` their
    numbers of words.
    """
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    found = []
    longest = int(sizes.max()) if len(sizes) else 0
    j = 0
    while max(LEAST_LENGTH, LEAST_TIMES << j) <= longest:
        places, lags = _seeds(words, owner, sizes, j)
        at = 0
        while at < len(places):
            a, q = int(places[at]), int(lags[at])
            d = int(owner[a])
            begin = _agrees_from(words, a, q, int(firsts[d]))
            end = _differs(words, a, q, int(firsts[d + 1]) - q)
            length = end + q - begin
            if end > a and length >= max(LEAST_LENGTH, LEAST_TIMES * q):
                found.append((d, begin, length, q))
            # seeds of this lag that begin in the covered stretch lie in it as a whole
            stop = int(np.searchsorted(lags, q, "right"))
            at = max(at + 1, min(stop, int(np.searchsorted(places[at:stop], max(end, a + 1))) + at))
        j += 1
    return np.array(sorted((d, s, q, n) for d, s, n, q in found), np.int64).reshape(-1, 4)[:, [0, 1, 3, 2]]


def _looped(words: np.ndarray, doc_id: bytes) -> np.ndarray:
    """The order of the words after the contract's edit: some documents repeat their words from one place on."""
    n, h = len(words), zlib.crc32(doc_id)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((words[:a], words[a + np.arange(n - a) % p]))


def _group(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Ranges of documents with a bounded number of words together; a longer one stands alone."""
    at = 0
    while at < len(texts):
        to, n = at + 1, len(texts[at])
        while to < len(texts) and n + len(texts[to]) <= WORDS_AT_ONCE:
            n += len(texts[to])
            to += 1
        yield at, to
        at = to


def collapse(text: str | None, doc_id: str | None = None) -> tuple[list[tuple[int, int, int]], str]:
    """Runs (start, length, period) of one text, and its words without what repeats in runs, joined by blanks."""
    return next(iter(_search([text], [doc_id])))


def _search(texts: list[str | None], edit_by: list[str | None]) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """Runs and collapsed text of each text; those with an id of digits in ``edit_by`` are edited by it first."""
    cut = [(t or "").encode().split() for t in texts]  # bytes are cut at ASCII blanks alone
    for low, high in _group(cut):
        part = cut[low:high]
        flat = pa.array([w for words in part for w in words], pa.large_binary())
        numbered = pc.dictionary_encode(flat)
        numbers = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.array([len(w) for w in part], np.int64)
        firsts = np.concatenate(([0], np.cumsum(sizes)))
        orders = []
        for k in range(len(part)):
            own = np.arange(firsts[k], firsts[k + 1])
            orders.append(own if edit_by[low + k] is None else _looped(own, edit_by[low + k].encode()))
        order = np.concatenate(orders) if orders else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(part)), sizes)
        found = runs(numbers[order], owner, sizes)
        bounds = np.searchsorted(found[:, 0], np.arange(len(part) + 1))
        for k, words in enumerate(part):
            mine = found[bounds[k] : bounds[k + 1], 1:] - np.array([firsts[k], 0, 0])
            dropped = np.zeros(int(sizes[k]) + 1, np.int64)
            np.add.at(dropped, mine[:, 0] + mine[:, 2], 1)
            np.add.at(dropped, mine[:, 0] + mine[:, 1], -1)
            kept = order[firsts[k] : firsts[k + 1]][np.cumsum(dropped[:-1]) == 0] - firsts[k]
            yield [tuple(map(int, r)) for r in mine], b" ".join([words[i] for i in kept.tolist()]).decode()


_SCHEMA = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
_FULL = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _rows(docs: DataFrame, edited: bool, schema: str, summary) -> DataFrame:
    """``docs`` (doc_id, text) with what ``summary`` makes of the runs and the collapsed text of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in schema.replace("array<struct<start:bigint,length:bigint,period:bigint>>", "x").split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(0)
                as_text = [("" if x is None else str(x)) if edited else None for x in ids.to_pylist()]
                rows = [summary(*x) for x in _search(part.column(1).to_pylist(), as_text)]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(_ARROW[schema])]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *names])

    return spread(docs.select("doc_id", "text")).mapInArrow(search, f"doc_id {kind}, {schema}")


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_ARROW = {_SCHEMA: [pa.int64()] * 5 + [pa.string()] * 2, _FULL: [_RUN, pa.string()]}


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _summed(found: list[tuple[int, int, int]], collapsed: str) -> tuple:
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    exponent = 1000 * length // period if found else None
    return len(found), start, length, period, exponent, _digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), _digest(collapsed)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row: all runs by start and period, and the text without their repetitions.

    A null or empty text has no run and collapses to an empty one; the words that are left are joined by one blank.
    Rows are looked at one by one, so repeated rows and null ids give equal results; other columns are not read, and
    an empty table gives no row. A text of any length is one row: its search takes time near its length times its
    logarithm, and memory of some ten numbers a word.
    """
    return _rows(docs, False, _FULL, lambda found, text: ([dict(zip(("start", "length", "period"), r)) for r in found], text))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, number of runs, the longest one and digests, of all documents, some of them made to repeat by their id."""
    return _rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), True, _SCHEMA, _summed)
