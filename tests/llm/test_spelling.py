"""Spelling variants against brute force and SQL."""

import random

import pytest
from compare import connect, difference

from matchspark.llm import queries, spelling


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words: dict[str, int], ratio: int) -> set[tuple]:
    other = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(other[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, words[w], len(other[w]), form[w], form[w] and words[form[w]], root))
    return out


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


@pytest.mark.parametrize("letters, least, most", [("ab", 1, 9), ("abcdé", 5, 12), ("xyzß", 14, 40)])
def test_against_brute_force(spark, letters, least, most):
    rng = random.Random(least)
    words = {}
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
        for _ in range(8):
            words[word] = int(5 ** rng.uniform(0, 6))
            at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
            word = word[:at] + (rng.choice(letters) if kind else "") + word[at + (kind < 2) :] or "a"
    rows = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), ratio=5).select(*COLUMNS).collect()
    assert {tuple(r) for r in rows} == brute(words, 5)
    assert len(rows) == len(words)


def test_odd_rows(spark):
    rows = [("colour", 60, 1, None), ("color", 10, 1, "x"), (None, 5, 1, "x"), ("color", 2, 1, "x"), ("", None, 1, "x"), ("c", 3, 1, "x"), ("long" * 9000, 5, 1, "x"), ("long" * 9000 + "s", 25, 1, "x")]
    words = spark.createDataFrame(rows, "word string, n long, Root int, key string")
    want = {"colour": 60, "color": 12, "": 0, "c": 3, "long" * 9000: 5, "long" * 9000 + "s": 25}
    assert {tuple(r) for r in spelling.variants(words).select(*COLUMNS).collect()} == brute(want, 5)
    assert spelling.variants(words.limit(0)).count() == 0


def test_ties_and_long_chains(spark):
    words = {"a" * i: 5**i for i in range(1, 14)} | {"bcdefg": 1, "bcdefh": 50, "bcdefi": 50}
    rows = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).select(*COLUMNS).collect()
    assert {tuple(r) for r in rows} == brute(words, 5)


def test_no_table_of_pieces_is_broadcast(spark, tmp_path):
    """A words' file below the broadcast limit has many times its rows once they are cut into pieces."""
    words = spark.range(2000).selectExpr("concat(sha2(string(id), 256), 'x') as word", "id as n")
    words.write.parquet(str(tmp_path / "words"))
    pairs = spelling.near_pairs(spark.read.parquet(str(tmp_path / "words")))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert pairs.count() == 0


def test_counted_words_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (None, "Straße Straße straße STRAßE straße"), (3, "ÀÉ×÷ÿab " * 5), (4, "short a1b2c3"), (5, "letters" * 20_000)]
    found = {r["word"]: r["n"] for r in queries.counted_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {"straße": 5, "ÀÉ×÷ÿab": 5}


def test_query_is_as_sql(spark, sf_dir):
    q = "op11_spelling"
    assert difference(queries.QUERIES[q], queries.ORACLE[q], spark, connect(sf_dir), sf_dir) is None
