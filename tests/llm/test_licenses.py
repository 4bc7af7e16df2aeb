"""Licence scan: base phrases against a plain reading, rules and suppression on small cases."""

import re

import pytest

from matchspark.llm import license_rules, licenses, queries


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in license_rules.BASE.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_query_base_columns(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, sf_dir).collect()}
    rows = queries.QUERIES["op3_licenses"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("Released under the MIT License.", {"mit"}),
        ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0-or-later"}),
        ("see https://www.apache.org/licenses/LICENSE-2.0", {"apache-2.0"}),
        ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
        ("Todo: all rights\nreserved. © 2020", {"proprietary"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
        ("nothing here, transmit licenses", set()),
    ],
)
def test_rules(text, labels):
    rules = license_rules.rules()
    found = {rules[s[3]].label for s in licenses.scan_text(text.encode())[5]}
    assert found - {"licensed"} == labels


def test_every_gate_is_needed_by_its_pattern():
    rules = license_rules.rules()
    assert len(rules) > 250
    for rule in rules:
        # a pattern that matches without its gate would be missed
        bare = rule.pattern.pattern.replace(rule.gate, b"\x00")
        assert bare != rule.pattern.pattern, rule


def test_suppression():
    spans = [(0, 5, 2, 1), (1, 3, 2, 2), (1, 3, 4, 3), (0, 5, 2, 4), (4, 8, 1, 5), (6, 7, 2, 6), (0, 5, 2, 1)]
    assert licenses.suppressed(spans) == [(0, 5, 2, 1), (1, 3, 4, 3), (4, 8, 1, 5), (6, 7, 2, 6)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x", "y"), (2, "", "x", None), (None, "mit license mit license", "x", "y"), (3, "Apache License " * 9000, "x", "y")],
        "doc_id long, text string, id string, n_words string",
    )
    rows = {r["id"]: r for r in licenses.scan(docs).collect()}
    assert rows[1]["n_words"] == rows[2]["n_words"] == 0 and rows[1]["detections"] == [] and rows[1]["score"] == 0
    assert (rows[None]["n_base"], rows[None]["first_word"], rows[None]["last_word"]) == (2, 0, 2)
    assert (rows[3]["n_base"], rows[3]["last_word"]) == (9000, 17998)
    assert len(rows[3]["detections"]) == 9000
    assert licenses.scan(docs.limit(0)).count() == 0


def test_phrases_are_as_sql(spark, sf_dir):
    from compare import connect, difference

    q = "license_phrases"
    assert difference(queries.QUERIES[q], queries.ORACLE[q], spark, connect(sf_dir), sf_dir) is None
