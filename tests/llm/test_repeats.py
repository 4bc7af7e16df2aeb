"""Periodic runs and repeated passages against brute force and SQL."""

import hashlib
import zlib

import numpy as np
import pytest
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st

from matchspark.llm import periodic_runs, queries, substring_dedup

SCHEMA = "doc_id long, text string, ID long, tag string, runs int"


def brute_runs(words) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period, lag by lag."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        first = None
        for i in range(len(words) - q + 1):
            same = i + q < len(words) and words[i] == words[i + q]
            if same and first is None:
                first = i
            elif not same and first is not None:
                if i + q - first >= max(12, 2 * q):
                    found.setdefault((first, i + q), q)
                first = None
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(words) -> list[tuple[int, int, int]]:
    return [(int(a), int(b - a), int(q)) for a, b, q in periodic_runs.find(np.asarray(words, dtype=np.int64))]


SMALL = st.lists(st.integers(0, 2), max_size=9)


@settings(max_examples=150, deadline=None)
@given(SMALL, SMALL, SMALL, st.integers(1, 30), st.integers(1, 8), st.integers(0, 40))
def test_runs_within_runs(a, b, c, inner, outer, cut):
    words = ((a * inner + b) * outer + c) * 2
    assert runs_of(words[cut:700]) == brute_runs(words[cut:700])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 3), st.integers(1, 200), st.integers(2, 5))
def test_long_periods(seed, kinds, period, times):
    rng = np.random.default_rng(seed)
    unit = rng.integers(0, kinds, period)
    words = np.concatenate([rng.integers(0, kinds, 20), np.tile(unit, times), rng.integers(0, kinds, 20)]).tolist()
    assert runs_of(words) == brute_runs(words)


def test_touching_runs_of_one_period():
    words = ([0, 1] * 40 + [0]) * 2 + [1]
    assert runs_of(words) == brute_runs(words)
    assert {q for _, _, q in runs_of(words)} >= {2, 41, 51, 81}


def test_fibonacci_words_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 800:
        a, b = b, b + a
    assert runs_of(b) == brute_runs(b)
    assert runs_of([3] * 50_000) == [(0, 50_000, 1)]
    assert runs_of([]) == [] and runs_of([1] * 11) == [] and runs_of([1] * 12) == [(0, 12, 1)]


def changed(doc_id: int, words: list[bytes]) -> list[bytes]:
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_query_against_brute_force(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        words = changed(i, (text or "").encode().split())
        runs = brute_runs(words) if len(words) < 1500 else runs_of(np.unique(words, return_inverse=True)[1])
        dropped = {w for s, n, q in runs for w in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert rows[i].asDict() == {
            "doc_id": i, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": best[1] and 1000 * best[1] // best[2],
            "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            "collapsed_sha256": sha(b" ".join(w for k, w in enumerate(words) if k not in dropped)),
        }


def test_runs_odd_rows(spark):
    rows = [
        (1, None, 1, "x", 0), (2, "", None, None, None), (3, " \t\n", 1, "x", 0), (4, "a b " * 30_000, 1, "x", 0),
        (4, "a b " * 30_000, 1, "x", 0), (None, "Ä ä " * 12, 1, "x", 0), (5, "one two", 1, "x", 0),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = periodic_runs.collapse(docs)
    got = sorted(((r["id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()), key=str)
    pair = (4, [(0, 60_000, 2)], "a b")
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), pair, pair, (0, [(0, 12, 1)], "Ä ä"), (5, [], "one two")], key=str)
    assert periodic_runs.collapse(docs.limit(0)).count() == 0
    given_periods = queries.with_periods(docs).collect()
    assert len(given_periods) == len(rows)


def brute_dedup(docs: list[tuple]) -> list[tuple]:
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, words in split:
        for k in range(len(words) - 12):
            w = tuple(words[k : k + 13])
            if i is not None:
                least[w] = min(i, least.get(w, i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - 12):
            if i is not None and least[tuple(words[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def deduped(docs, **given):
    return sorted((tuple(r) for r in substring_dedup.dedup(docs, **given).collect()), key=str)


@pytest.mark.parametrize("given", [{}, {"bucket_bytes": 3000}])
def test_passages_against_brute_force(spark, given):
    rng = np.random.default_rng(5)
    passages = [" ".join(f"p{p}w{k}" for k in range(n)) for p, n in enumerate([12, 13, 14, 20, 60, 200])]
    docs = []
    for i in rng.permutation(120):
        parts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, rng.integers(0, 40)))]
        for _ in range(rng.integers(0, 4)):
            words = passages[rng.integers(0, 6)].split()
            a = rng.integers(0, len(words))
            parts += [" ".join(words[a:] if rng.random() < 0.3 else words), " ".join(f"w{x}" for x in rng.integers(0, 10**6, rng.integers(0, 9)))]
        docs.append((int(i), "\n".join(parts)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert deduped(frame, **given) == brute_dedup(docs)


def test_passages_odd_rows(spark):
    line = " ".join(f"l{k}" for k in range(13))
    long = " ".join(f"x{k % 997}" for k in range(60_000))
    docs = [
        (7, line), (3, f"a {line} b"), (3, f"{line}\tend"), (3, f"a {line} b"), (None, line), (None, None), (9, None), (10, ""),
        (11, " ".join(["same"] * 40)), (12, " ".join(["same"] * 14)), (13, "Ä " + line.upper()), (20, long), (21, long + " y"), (-5, "l0 l1"),
    ]
    frame = spark.createDataFrame([(i, t, 0, "t", 1) for i, t in docs], SCHEMA)
    assert deduped(frame) == brute_dedup(docs)
    assert deduped(frame.limit(0)) == []


def test_hot_window_in_many_parts(spark):
    """One passage in every document: each part of the texts asks for it once."""
    line = " ".join(f"l{k}" for k in range(15))
    docs = [(i, f"{line} own{i} {line}") for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(20)
    assert deduped(frame) == brute_dedup(docs)


def test_passages_are_as_sql(spark, sf_dir):
    q = "op13_substring_dedup"
    assert difference(queries.QUERIES[q], queries.ORACLE[q], spark, connect(sf_dir), sf_dir) is None
