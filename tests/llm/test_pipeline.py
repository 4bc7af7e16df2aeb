"""The pipeline against plain Python, and its stages on odd rows."""

import corpus_pipeline
from test_decontaminate import brute
from test_dedup import brute_components
from test_packing import check

from matchspark.llm import queries, simhash


def ascii_lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


def test_run_is_the_plain_pipeline(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    rejected = {r["doc_id"] for r in queries.QUERIES["op1_language"](spark, sf_dir).collect() if r["rejected"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in rejected}
    last = {}
    for k in sorted(texts):
        last[ascii_lower(texts[k])] = k
    ids = sorted(last.values())
    labels = brute_components([simhash.fingerprint(texts[i].encode()) for i in ids], 3)
    ids = [i for at, i in enumerate(ids) if labels[at] == at]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {doc for doc, _ in brute([(i, texts[i]) for i in ids], items)}
    assert leaks
    check(corpus_pipeline.run(spark, sf_dir).collect(), {i: texts[i] for i in ids if i not in leaks})


def test_stages_on_odd_rows(spark, sf_dir):
    odd = spark.createDataFrame(
        [(1, "the cat sat on the mat and the dog too", "en", "s", 1), (1, "the cat sat on the mat and the dog too", "en", "s", 1),
         (2, None, None, None, None), (None, "", "en", "s", 0), (3, "!!", "en", "s", 2), (4, "word " * 30000, "en", None, 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for table in (odd, odd.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, table, sf_dir)
            if name != "packing":
                assert found.columns == table.columns
                assert found.count() <= table.count()
                docs = stage(spark, docs, sf_dir)
        assert {r["doc_id"] for r in docs.collect()} <= {1, 4}
    assert docs.count() == 0
