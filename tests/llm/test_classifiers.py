"""Language and toxicity: held-out accuracy, and defined results of odd rows."""

import numpy as np

from matchspark.llm import language, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, score string, rejected string"


def test_language_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["lang"] for r in queries.documents(spark, sf_dir).select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op1_language"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 150
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["rejected"] for r in rows]) < 0.01


def test_counts_are_those_of_plain_ngrams():
    text = "Ab, cé!"
    grams = ["a", "b", "c", "é", " a", "ab", "b ", " c", "cé", "é ", " ab", "ab ", " cé", "cé "]
    places, letters = language.counts(text)
    assert letters == 4 and places.sum() == len(grams)
    assert language.counts("ab cé")[0].tolist() == places.tolist()
    assert language.counts(" 12 !")[1] == 0 and language.counts("")[0].sum() == 0


def test_language_odd_rows(spark):
    text = "the cat and the dog went over the hill to see what they could see in the valley of the river"
    other = "der hund und die katze gingen über den berg und sahen was sie dort im tal am fluss sehen konnten"
    docs = spark.createDataFrame(
        [(i, t, x, "s", None) for i, (t, x) in enumerate([(text, "en")] * 9 + [(other, "de")] * 9)]
        + [(90, None, "en", None, None), (91, "", None, None, None), (92, "12 34 !", "de", None, None),
           (None, "the dog and the cat", None, None, None), (93, "漢字仮名交じり文" * 50, None, None, None), (94, text * 2000, None, None, None)],
        SCHEMA,
    )
    model = language.fit(docs)
    rows = {r["id"]: r for r in language.identify(docs, model).collect()}
    assert (rows[90]["lang"], rows[91]["lang"], rows[92]["lang"]) == ("und",) * 3
    assert rows[90]["score"] == 0 and rows[90]["rejected"]
    assert rows[None]["lang"] == "en" and rows[94]["lang"] == "en" and rows[10]["lang"] == "de"
    assert rows[93]["rejected"] and not rows[94]["rejected"]
    kept = language.keep(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["id"] for r in rows.values() if not r["rejected"]}
    nothing = language.fit(docs.limit(0))
    assert {r["lang"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_language_sample_is_full_whatever_copies_and_short_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 50)
    seen = {}
    clustered = language._clustered
    monkeypatch.setattr(language, "_clustered", lambda rows, k, rounds: seen.setdefault(len(seen), len(rows)) and clustered(rows, k, rounds))
    letter = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    rows = [("der hund und die katze gingen über den berg und sahen das tal", "de")] * 30000
    rows += [(f"der hund {letter(i)} und die katze gingen über den berg und sahen das tal", "de") for i in range(300)]
    rows += [("kurz", "de")] * 5000 + [(f"the cat {letter(i)}", "en") for i in range(300)] + [("12 34", "xx")]
    docs = spark.createDataFrame([(i, t, x, None, None) for i, (t, x) in enumerate(rows)], SCHEMA)
    model = language.fit(docs)
    assert list(seen.values()) == [50, 50]
    found = language.identify(spark.createDataFrame([(1, "the cat abc"), (2, "der hund und die katze")], "doc_id long, text string"), model)
    assert {r["id"]: r["lang"] for r in found.collect()} == {1: "en", 2: "de"}


def test_toxicity_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.QUERIES["op8_toxicity"](spark, sf_dir).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    found = sum(p and y for p, y in held)
    assert found / sum(y for _, y in held) >= 0.79
    assert found / sum(p for p, _ in held) > 0.95


def test_pairs_are_learned():
    """Two terms that are harmless alone and toxic together: no weights can say that."""
    rng = np.random.default_rng(5)
    toxic = [float(a + b == 2) for a, b in rng.integers(0, 2, (1500, 2))]
    pairs = [np.array([0, 1] if y else [int(rng.integers(0, 2))]) for y in toxic]
    model = toxicity.learn(pairs, np.array(toxic))
    rows, at = np.array([0, 0, 1, 2]), np.array([0, 1, 0, 1])
    both, one, other = toxicity._sums(model, rows, at, 3)[0]
    assert both > 1 and one < -1 and other < -1


def test_neutral_words_that_are_toxic_together(spark):
    """Two words equally frequent in toxic and clean texts, through the choice of terms as well."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1200):
        words = [f"w{x}" for x in rng.integers(0, 3000, 40)]
        kind = i % 6
        rows.append((i, " ".join([*words, *{0: ["zorb", "glim"], 1: ["zorb"], 2: ["glim"]}.get(kind, [])]), int(kind == 0 or kind == 3)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    # a third of all texts is toxic, and so is one half of those with either word: alone they tell little
    model = toxicity.fit(docs.filter("doc_id < 900"), labels)
    texts = ["a zorb b glim", "a zorb b", "glim a", "nothing of it"]
    test = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = {r["id"]: r["score"] for r in toxicity.score(test, model).collect()}
    assert score[0] > 0.7 and max(score[1], score[2], score[3]) < 0.5


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, "s", None), (2, "", "en", "s", None), (None, "you idiot", "en", None, None), (3, "word " * 30000, "x", "s", None)],
        SCHEMA,
    )
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 1), (None, 1), (9, 1), (3, None), (1, 7)], "doc_id long, toxic int")
    twice = docs.union(docs)
    for rows, marks in ((docs, labels), (twice, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        model = toxicity.fit(rows, marks)
        scores = toxicity.score(docs, model).collect()
        assert len(scores) == 4 and all(0 <= r["score"] <= 1 for r in scores)
    assert {r["score"] for r in scores} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0
