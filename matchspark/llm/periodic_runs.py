"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words whose words ``q`` apart are identical, ``q`` being the
smallest such number, of at least ``max(LEAST, 2 * q)`` words, which no neighbouring word
extends. Documents are taken apart many at a time; no document is cut.

*Names.* Level k gives each place a number for the 2**k words from there, equal where those
words are equal, by pairing the numbers of the level below; words that stand once in their
document have none. How far two places agree to the right or left is read off the levels.

*Short periods.* Lags below ``2 * SMALLEST`` are scanned directly.

*Scales.* For periods from Q to 2Q (Q = 2m; m = 16, 32, ...) each place has the gram of m words
from there, and of every window of m + 1 grams the one of least hash is kept. The first Q words
of a run are one window, and it repeats at the period's distance: equal minimizers Q to 2Q apart
are seeds, which are extended both ways. A gram that is itself periodic (period up to m / 3)
is no minimizer; the others are more than m / 3 apart if equal, so a minimizer has few partners.

*Runs within runs.* If all grams of the window are periodic, so is the run's period word; the run
then lies across two touching runs of one shorter period d, which are known by then, and its
period is one of the numbers that bring both in phase: these are seeds too.

Repeats of a period end where the period ends, so of runs with the same ends the smallest stays.

Defined results: a null or empty text has no words and no run; ids, repeated rows and other
columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.text import slices, text_bytes, word_codes

LEAST = 12
#: Words of a gram at the smallest scale; a power of two.
SMALLEST = 16
#: Bytes of text whose words are held as numbers at once.
SLICE = 2 << 20


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Small numbers for equal keys, -1 for keys that occur once."""
    _, place, n = np.unique(keys, return_inverse=True, return_counts=True)
    often = n > 1
    return np.where(often, np.cumsum(often) - 1, -1)[place]


def names(words: np.ndarray) -> list[np.ndarray]:
    """Level k: a number for the 2**k words from each place, -1 where they stand nowhere else."""
    out = [_numbered(words)]
    while True:
        last, step = out[-1], 1 << (len(out) - 1)
        here = np.flatnonzero((last[: max(len(last) - step, 0)] >= 0) & (last[step:] >= 0))
        found = np.full(len(last), -1, np.int64)
        found[here] = _numbered(last[here] * (last.max(initial=0) + 1) + last[here + step])
        if not (found >= 0).any():
            return out
        out.append(found)


def _right(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on; i < j."""
    n, far = len(levels[0]), np.zeros(len(j), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        b = j + far
        own, other = levels[k][np.minimum(i + far, n - 1)], levels[k][np.minimum(b, n - 1)]
        far += np.where((b < n) & (own >= 0) & (own == other), 1 << k, 0)
    return far


def _left(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j; i < j."""
    far = np.zeros(len(j), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - far - (1 << k), j - far - (1 << k)
        own, other = levels[k][np.maximum(a, 0)], levels[k][np.maximum(b, 0)]
        far += np.where((a >= 0) & (own >= 0) & (own == other), 1 << k, 0)
    return far


def _short(words: np.ndarray, lag: int) -> np.ndarray:
    """Runs (start, end, lag) by comparing every word with the one ``lag`` further."""
    same = np.flatnonzero((words[:-lag] == words[lag:]) & (words[lag:] >= 0)) if lag < len(words) else np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(same) > 1)
    first = same[np.concatenate(([0], cuts + 1))] if len(same) else same
    last = same[np.concatenate((cuts, [len(same) - 1]))] if len(same) else same
    found = np.column_stack([first, last + lag + 1, np.full(len(first), lag)])
    return found[found[:, 1] - found[:, 0] >= max(LEAST, 2 * lag)]


def _extended(levels: list[np.ndarray], at: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Runs (start, end, lag) through the seeds: words at ``at`` that repeat ``lag`` further."""
    start = at - _left(levels, at, at + lag)
    end = at + lag + _right(levels, at, at + lag)
    found = np.column_stack([start, end, lag])
    return found[end - start >= np.maximum(LEAST, 2 * lag)]


def _distinct(runs: np.ndarray) -> np.ndarray:
    """Of runs with the same ends the one of the smallest period: the others are its multiples."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    other = (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)
    return runs[np.concatenate(([True], other))[: len(runs)]]


def _windows(x: np.ndarray, size: int, fold: np.ufunc) -> np.ndarray:
    """The least or largest of each ``size`` neighbours."""
    width = 1
    while 2 * width <= size:
        x, width = fold(x[:-width], x[width:]), 2 * width
    rest = size - width
    return fold(x[:-rest], x[rest:]) if rest else x


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _minimizer_seeds(grams: np.ndarray, runs: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of minimizers that return 2m to 4m further, and how much further."""
    none = np.iinfo(np.uint64).max
    own = runs[(3 * runs[:, 2] <= m) & (runs[:, 1] - runs[:, 0] >= m)]
    edge = np.zeros(len(grams) + 1, np.int64)
    np.add.at(edge, own[:, 0], 1)
    np.add.at(edge, own[:, 1] - m + 1, -1)
    periodic = np.cumsum(edge[:-1]) > 0
    # windows of grams that all return, one stretch after the other
    inside = np.concatenate(([0], (grams >= 0).astype(np.int8), [0]))
    first, past = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    long = past - first > m
    first, length = first[long], (past - first)[long]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
    hashes = np.where(periodic[place], none, _hash(grams[place]))
    least = _windows(hashes, m + 1, np.minimum)
    pad = np.zeros(m, np.uint64)
    chosen = (_windows(np.concatenate((pad, least, pad)), m + 1, np.maximum) == hashes) & (hashes < none)
    place = place[chosen]
    order = np.lexsort((place, grams[place]))
    place, name = place[order], grams[place][order]
    at, lags, t = [], [], 1
    while t < len(place):
        lag = place[t:] - place[:-t]
        near = (name[t:] == name[:-t]) & (lag < 4 * m)
        if not near.any():
            break
        fits = near & (lag >= 2 * m)
        at.append(place[:-t][fits])
        lags.append(lag[fits])
        t += 1
    return np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *lags])


def _phase_seeds(levels: list[np.ndarray], runs: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of periods 2m to 4m across two touching runs of one period, up to a third of m."""
    own = runs[3 * runs[:, 2] <= m]
    own = own[np.lexsort((own[:, 0], own[:, 2]))]
    a, b = own[:-1], own[1:]
    meet = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1])
    room = np.minimum(a[:, 1] - a[:, 0], b[:, 1] - b[:, 0])
    at, lags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for (l1, _, d), (l2, _, _), most in zip(a[meet & (room >= 2 * m)], b[meet & (room >= 2 * m)], room[meet & (room >= 2 * m)]):
        turned = np.flatnonzero(_right(levels, l1 + np.arange(d), np.full(d, l2)) >= d)
        if len(turned):
            phase = (l2 - l1 - turned[0]) % d
            lag = np.arange(2 * m + (phase - 2 * m) % d, min(most + 1, 4 * m), d)
            at.append(np.maximum(l1, l2 - lag))
            lags.append(lag)
    return np.concatenate(at), np.concatenate(lags)


def find(words: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) of words given as numbers, by start, then period."""
    if not len(words):
        return np.zeros((0, 3), np.int64)
    levels = names(words)
    runs = np.concatenate([_short(levels[0], lag) for lag in range(1, 2 * SMALLEST)])
    m = SMALLEST
    while m.bit_length() <= len(levels):  # no run of two periods of 2m words without a gram of m that returns
        seeds = zip(_minimizer_seeds(levels[m.bit_length() - 1], runs, m), _phase_seeds(levels, runs, m))
        found = _extended(levels, *(np.concatenate(x) for x in seeds))
        runs = _distinct(np.concatenate([runs, found]))
        m *= 2
    runs = _distinct(runs)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(docs: DataFrame, id: Column | str = "doc_id", text: str = "text") -> DataFrame:
    """(id, runs, collapsed): the runs of each text, and its words without those after a run's first period.

    ``runs`` holds (start, length, period) by start, then period; words are joined by one space.
    """
    key = F.col(id) if isinstance(id, str) else id
    rows = docs.select(key.alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            codes, starts, distinct = word_codes(batch.column(1))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            # words of two documents are never the same, so no run leaves its document
            found = find(owner * len(distinct) + codes)
            edge = np.zeros(len(codes) + 1, np.int64)
            np.add.at(edge, found[:, 0] + found[:, 2], 1)
            np.add.at(edge, found[:, 1], -1)
            kept = np.cumsum(edge[:-1]) == 0
            whole = np.logical_and.reduceat(np.append(kept, True), starts[:-1]) | (np.diff(starts) == 0)
            out = []
            for i, words in enumerate(map(bytes.split, text_bytes(batch.column(1)))):
                out.append(b" ".join(words if whole[i] else compress(words, kept[starts[i] : starts[i + 1]])))
            where = owner[found[:, 0]] if len(found) else np.zeros(0, np.int64)
            ends = np.searchsorted(where, np.arange(batch.num_rows + 1))
            parts = (found[:, 0] - starts[where], found[:, 1] - found[:, 0], found[:, 2])
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
            columns = [batch.column(0), runs, pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "runs", "collapsed"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
