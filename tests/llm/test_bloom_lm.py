"""Language model: exact columns against plain counting, filter counts against true counts."""

import zlib
from collections import Counter

import numpy as np
import pytest

from matchspark.llm import bloom_lm, queries

SCHEMA = "doc_id long, text string, h string, row string, n string"


def plain(texts, learn):
    tokens = {k: [*(t or "").encode().lower().split(), b""] for k, t in texts.items()}
    c = Counter(w for k in learn for w in tokens[k])
    n, v = c.total(), len(c)
    base = {k: sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws) for k, ws in tokens.items()}
    return tokens, c, base


def test_query_exact_columns(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, sf_dir).collect()}
    learn = [k for k in texts if zlib.crc32(str(k).encode()) % 7 != 2]
    tokens, c, base = plain(texts, learn)
    rows = queries.QUERIES["op4_bloom_lm"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(c[w] > 0 for w in own))
        assert r["train_tokens"] == c.total() and r["held_out"] == (r["doc_id"] not in learn)
        assert r["base_score"] == pytest.approx(base[r["doc_id"]], rel=1e-9)
    # the model knows the learning texts better than single tokens tell
    known = [r for r in rows if not r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in known) > sum(r["base_score"] for r in known)


@pytest.mark.parametrize("frequent", [1 << 20, 3])
def test_rare_tokens_and_odd_rows(spark, frequent):
    texts = {1: "the cat the dog The end", 2: None, 3: "", 4: "cat\tcat\x0bcat unseen", 5: "one two three four " * 5000, 6: "É é"}
    docs = spark.createDataFrame([(k, t, "h", None, "n") for k, t in texts.items()] + [(None, "the cat", "", "", "")], SCHEMA)
    model = bloom_lm.fit(docs.filter("doc_id in (1, 2, 5, 6)"), frequent=frequent)
    assert model.complete == (frequent > 3)
    _, c, base = plain({**texts, None: "the cat"}, [1, 2, 5, 6])
    assert (model.tokens, model.types) == (c.total(), len(c))
    rows = {r["id"]: r for r in bloom_lm.score(docs, model).collect()}
    assert {k: pytest.approx(v) for k, v in base.items()} == {k: r["base_score"] for k, r in rows.items()}
    assert rows[4]["n_known"] == 4 and rows[2]["n_tokens"] == 1
    assert all(r["score"] <= 0 for r in rows.values())
    nothing = bloom_lm.fit(docs.limit(0))
    assert {r["n_known"] for r in bloom_lm.score(docs, nothing).collect()} == {0}
    assert bloom_lm.score(docs.limit(0), model).count() == 0


def test_filter_levels_are_never_too_low_and_seldom_too_high(spark):
    words = [f"w{i}" for i in range(400)]
    text = " ".join(w for i, w in enumerate(words) for _ in range(1 + i % 40))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = bloom_lm.fit(docs)
    true = np.array([1 + i % 40 for i in range(400)])
    keys = bloom_lm._mixed(np.array([bloom_lm.token_hashes(w.encode())[0] for w in words], np.uint64))
    got, want = model.single.level(keys), bloom_lm.levels(true)
    assert (got >= want).all() and (got > want).mean() < 0.1
    absent = bloom_lm._mixed(np.arange(5000, dtype=np.uint64))
    assert (model.single.level(absent) > 0).mean() < 0.05
    none = bloom_lm.fit(docs, max_bytes=0)
    assert none.away and not none.single.by_level
    assert bloom_lm.score(docs, none).first()["score"] < 0


def test_probabilities_are_nearly_normalised(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    text = " ".join(rng.choice(words, 20000, p=rng.dirichlet(np.ones(60))))
    model = bloom_lm.fit(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    after = [np.array([bloom_lm.token_hashes(b"w7")[0], bloom_lm.token_hashes(w.encode())[0]]) for w in words]
    total = sum(probabilities_of(model, tokens)[1] for tokens in after)
    assert 0.6 < total < 1.5


@pytest.mark.parametrize("away", [False, True])
def test_scores_do_not_depend_on_what_fits(spark, documents, monkeypatch, away):
    """Whether the single tokens' filters fit or not, scores are those of one model that holds all filters."""
    monkeypatch.setattr(bloom_lm, "BUCKET_TOKENS", 1 << 12)
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (-1, ""), (7, "twice"), (7, "twice")], "doc_id long, text string"))
    model = bloom_lm.fit(documents, max_bytes=0 if away else 1 << 30)
    assert model.away == away and model.single.buckets > 1
    got = sorted((str(r["id"]), r["n_tokens"], round(r["score"], 6)) for r in bloom_lm.score(docs.repartition(5), model).collect())
    want = []
    for r in docs.collect():
        tokens = bloom_lm.token_hashes((r["text"] or "").encode())
        want.append((str(r["doc_id"]), len(tokens), round(float(np.log10(probabilities_of(model, tokens)).sum()), 6)))
    assert got == sorted(want)


_HELD: dict = {}


def probabilities_of(model, tokens):
    """P(token | token before) of a text's tokens, with all filters at hand."""
    if _HELD.get("of") is not model:
        _HELD.update(of=model, filters=[bloom_lm._gathered(model.filters, g, model.single.buckets) for g in (1, 2)])
    single, pair = _HELD["filters"]
    before, keys, pairs = bloom_lm._keys([tokens])
    own = single.level(keys)
    end = single.level(bloom_lm._mixed(np.array([bloom_lm.token_hashes(b"")[0]], np.uint64)))
    previous = np.concatenate((end, own[:-1]))
    return bloom_lm.chances(model, pair.level(pairs), own, previous)


def test_base_is_as_sql(spark, sf_dir):
    from compare import connect, difference

    q = "lm_base"
    assert difference(queries.QUERIES[q], queries.ORACLE[q], spark, connect(sf_dir), sf_dir) is None
