"""Packing: ids against the tokenizer itself, plan against plain best-fit decreasing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from matchspark.llm import packing, queries

SCHEMA = "doc_id long, text string, start string, ids string, part string"


def plain_best_fit(lengths, window):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(window - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 7, 16, 50, 100])
    lengths = [rng.randint(1, rng.choice([window, max(1, window // 3)])) for _ in range(rng.choice([0, 1, 30, 300]))]
    plan, windows = packing.best_fit_decreasing(dict(Counter(lengths)), window)
    spans = defaultdict(list)
    bounds = {}
    for n, first, each, base, offset in plan.tolist():
        bounds.setdefault(n, []).append((first, each, base, offset))
    for n, count in Counter(lengths).items():
        for nth in range(count):
            first, each, base, offset = [b for b in bounds[n] if b[0] <= nth][-1]
            spans[base + (nth - first) // each].append((offset + (nth - first) % each * n, n))
    assert sorted(spans) == list(range(windows))
    for parts in spans.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    assert sorted(window - sum(n for _, n in p) for p in spans.values()) == plain_best_fit(lengths, window)


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own, encode = Tokenizer.from_file(path), packing.encoder(path)
    for text in ["", "Hello  world\n\n", "a<|endoftext|>b", "É ça 漢字 ́x\x00", "x" * 3000, " " * 50, "I'll 12,345"]:
        assert encode(text) == own.encode(text, add_special_tokens=False).ids


def check(rows, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert sorted(by_seq) == list(range(len(by_seq)))
    return padding / sum(r["length"] for r in rows)


def test_query_places_every_id_once(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, sf_dir).collect()}
    assert check(queries.QUERIES["op10_packing"](spark, sf_dir).collect(), texts) < 0.02


def test_odd_rows_and_sequences(spark):
    texts = {1: None, 2: "", 3: "word " * 20000, 4: "a", 5: "a", 6: "<|endoftext|>"}
    docs = spark.createDataFrame([(i, t, "s", "i", "p") for i, t in texts.items()], SCHEMA).repartition(3)
    check(queries.packed(docs).collect(), texts)
    placed = packing.pack(docs)
    rows = packing.sequences(docs, placed).collect()
    assert all(len(r["ids"]) == 2048 or (r["used"] & (r["used"] - 1)) == 0 and len(r["ids"]) == r["used"] for r in rows)
    assert sum(r["used"] for r in rows) == sum(r["length"] for r in placed.collect())
    assert queries.packed(docs.limit(0)).count() == 0
    twice = docs.union(docs)
    assert packing.pack(twice).count() == 2 * placed.count()
