"""Exact and near de-duplication against brute force."""

import numpy as np
import pytest
from compare import connect, difference

from matchspark.llm import exact_dedup, queries, simhash
from matchspark.llm.components import components

SCHEMA = "doc_id long, text string, DIGEST_ string, id string"
ODD = [
    (1, "Same Text", "x", "a"), (2, "same text", "y", "b"), (2, "same text", "z", "c"), (3, None, "x", None),
    (4, "", None, "d"), (None, "", "x", "e"), (None, None, "x", "f"), (5, "ÀB", "x", "g"), (6, "àb", "x", "h"),
    (7, "word " * 30000, "x", "i"),
]


def test_exact_is_as_sql(spark, sf_dir):
    q = "op5_exact_dedup"
    assert difference(queries.QUERIES[q], queries.ORACLE[q], spark, connect(sf_dir), sf_dir) is None


def test_exact_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = exact_dedup.mark(docs).collect()
    assert len(rows) == len(ODD)
    assert sum(r["kept"] for r in rows) == 5
    assert {(r["keep"], r["size"]) for r in rows} == {(2, 3), (4, 4), (5, 1), (6, 1), (7, 1)}
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6, 7]


@pytest.mark.parametrize("operator", [exact_dedup.mark, exact_dedup.keep, simhash.near_components, simhash.keep])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_components(fps: list[int], radius: int) -> list[int]:
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


def test_fingerprint_is_plain_simhash():
    import xxhash

    text = "One two\tTHREE four\x0bfive one two three"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint("É a".encode()) == xxhash.xxh64_intdigest("É a".encode(), 42)


@pytest.mark.parametrize("tile_rows", [4096, 5])
def test_links_connect_as_all_pairs_do(spark, tile_rows):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {0, 1, 7}
    for s in seeds:
        value = int(s)
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                value ^= 1 << int(b)
            fps.add(value)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, tile_rows)
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in pairs)
    found = {r["node"]: r["component"] for r in components(links).collect()}
    got = [found.get(f, f) for f in signed]
    want = brute_components(fps, 3)
    groups = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == v) for v in set(labels)}
    assert groups(got) == groups(want)


def test_components_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(100, 164)] + [(1, i) for i in range(2, 90)] + [(5, 5), (200, None)]
    rows = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r["component"] for r in rows if r["node"] >= 100} == {100}
    assert {r["component"] for r in rows if r["node"] < 90} == {1}
    assert len(rows) == 65 + 89


def test_near_query_against_brute_force(spark, sf_dir):
    rows = queries.QUERIES["op6_simhash"](spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, sf_dir).collect()}
    ids = sorted(texts)
    fps = [simhash.fingerprint((texts[i] or "").encode()) for i in ids]
    want = {i: ids[c] for i, c in zip(ids, brute_components(fps, 3))}
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{f:016x}" for i, f in zip(ids, fps)}


def test_near_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = simhash.near_components(docs).collect()
    assert len(rows) == len(ODD)
    assert {r["id"]: r["component"] for r in rows}[None] == 3
    assert {r["component"] for r in rows if r["id"] in (1, 2)} == {1}
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7]
