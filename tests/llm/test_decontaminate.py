"""Decontamination against every window of every size."""

import re
from collections import Counter

import pytest

from matchspark.llm import decontaminate, queries

SCHEMA = "doc_id long, text string, mark string, pos string"
BENCH = "item_id long, text string, words string"


def cut_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def brute(docs, items, threshold=0.8):
    found = {}
    for item, text in items:
        words = cut_words(text)
        if not words:
            continue
        n = min(5, len(words))
        want = Counter(shingles(words, n))
        size = want.total()
        for doc, body in docs:
            own = shingles(cut_words(body), n)
            if not set(own) & set(want):
                continue
            for at in range(len(own)):
                have = Counter(own[at : at + size])
                shared = (have & want).total()
                value = shared / (size + have.total() - shared)
                if value >= threshold and value > found.get((doc, item), 0):
                    found[doc, item] = value
    return found


def as_dict(rows, a="id", b="item"):
    return {(r[a], r[b]): pytest.approx(r["similarity"]) for r in rows}


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in queries.documents(spark, sf_dir).collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert want
    assert as_dict(queries.QUERIES["op9_decontaminate"](spark, sf_dir).collect(), "doc_id", "item_id") == want


def test_edits_short_items_and_odd_rows(spark):
    base = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(base), "x"), (2, "two words", "x"), (3, None, "x"), (4, " .", "x"), (5, "la la la la la la la", "x")]
    changed = [*base[:2], "new", *base[3:]]
    docs = [
        (1, "Before. " + ", ".join(base).upper() + " after", None, "p"),
        (2, "x y " + " ".join(changed), "m", "p"),
        (3, " ".join(w if i % 4 else "z" for i, w in enumerate(base)), "m", "p"),
        (4, None, "m", "p"), (5, "", "m", "p"), (None, "two words", "m", None),
        (6, " ".join(base[:36]), "m", "p"), (6, "other text", "m", "p"), (7, "a Two  WORDS b", "m", "p"),
        (7, "a Two  WORDS b", "m", "p"), (8, "la " * 8, "m", "p"), (9, "la " * 5, "m", "p"), (10, "word " * 20000, "m", "p"),
    ]
    left, right = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, BENCH)
    got = decontaminate.matches(left, right)
    assert as_dict(got.collect()) == brute([d[:2] for d in docs], [i[:2] for i in items])
    kept = decontaminate.keep(left, right)
    assert kept.columns == left.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 9, 10]
    assert decontaminate.matches(left.limit(0), right).count() == 0
    assert decontaminate.matches(left, right.limit(0)).count() == 0
    assert decontaminate.keep(left, right.limit(0)).count() == len(docs)


def test_many_items_of_one_size(spark, tmp_path):
    """Windows meet the items that hold their first shingle, not all items of their size."""
    import random

    rng = random.Random(1)
    items = [(i, " ".join(f"v{rng.randrange(4000)}" for _ in range(24))) for i in range(1000)]
    docs = []
    for i in range(400):
        words = items[rng.randrange(1000)][1].split()
        if i % 3 == 0:
            words[rng.randrange(24)] = "changed"
        docs.append((i, " ".join(["before", *words, "after"]) if i % 4 else " ".join(f"v{rng.randrange(4000)}" for _ in range(60))))
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert as_dict(decontaminate.matches(left, right).collect()) == brute(docs, items)


def test_repeats_within_an_item_count(spark):
    """Multiplicities: an item of one word many times, and one of thousands of equal shingles."""
    items = [(1, "again " * 40), (2, "again " * 3000 + "and more of it")]
    docs = [(1, "again " * 38), (2, "again " * 30), (3, "again " * 3000), (4, "again " * 2000)]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert as_dict(decontaminate.matches(left, right).collect()) == {
        (d, i): pytest.approx(s) for d, i, s in [(1, 1, 34 / 36), (3, 1, 1.0), (4, 1, 1.0), (3, 2, 2996 / 3000)]
    }
