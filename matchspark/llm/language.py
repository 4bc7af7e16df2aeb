"""Language identification by nearest centroid.

A text becomes its vector of letter n-grams (one to three letters of the
lower-cased text; whatever is no letter separates words, and a word's ends are
part of its n-grams), hashed to ``DIMENSIONS`` places, weighted with
(1 + log of the count) times inverse document frequency, and scaled to length
one. Each language has several centroids, found by spherical k-means; a text
takes the language of the centroid of the largest cosine. A text farther from
it than any plausible text of the language is rejected.

Document frequencies count all learning rows, in one distributed pass. The
centroids are fitted on a bounded sample: the ``SAMPLE`` distinct texts of each
language, at most ``SAMPLE_ALL`` in all, that come first by a hash of the text;
texts of fewer than ``SHORT`` letters fill it up where there are not enough others.

Defined results: a text that is null or has no letter is ``und`` with score 0
and rejected; without any learning row all texts are. Equal cosines go to the
language that comes first by name. Rows repeat as they are given; empty tables
give empty results; columns other than the named ones play no part.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.text import slices

DIMENSIONS, CENTROIDS, ROUNDS = 4096, 4, 12
SAMPLE, SAMPLE_ALL, SHORT = 400, 4000, 40
#: A text is rejected below this share of the cosine that all but one in a hundred sampled texts of the centroid exceed …
SLACK = 0.3
#: … and short texts, whose cosines are lower, below this share of that again for each halving under FULL letters.
FULL, HALVING = 400, 0.75
UNKNOWN = "und"
BATCH_CELLS = 1 << 20


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters with one 0 around and between words; empty if there are none."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes = np.concatenate(([0], np.where(_letters()[codes], codes, 0), [0]))
    inside = codes > 0
    if not inside.any():
        return codes[:0]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the separator after each word
    found = codes[keep]
    return np.concatenate(([0], found))


def counts(text: str, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, int]:
    """Counts of hashed n-grams, and the number of letters."""
    codes = letters(text)
    if not len(codes):
        return np.zeros(dimensions, np.int64), 0
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    grams = [mixed[codes > 0]]
    pairs = mixed[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (mixed[1:] ^ (mixed[1:] >> np.uint64(29)))
    grams.append(pairs)
    triples = pairs[:-1] * np.uint64(0x165667B19E3779F9) + (mixed[2:] ^ (mixed[2:] >> np.uint64(31)))
    grams.append(triples[codes[1:-1] > 0])
    places = np.concatenate(grams)
    places ^= places >> np.uint64(32)
    places *= np.uint64(0xD6E8FEB86659FD93)
    places >>= np.uint64(64 - (dimensions.bit_length() - 1))
    return np.bincount(places.astype(np.int64), minlength=dimensions), int(np.count_nonzero(codes))


def _vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and the numbers of letters."""
    rows, letters_of = np.zeros((len(texts), len(idf)), dtype=np.float32), np.zeros(len(texts), np.int64)
    for at, text in enumerate(texts):
        found, letters_of[at] = counts(text, len(idf))
        there = np.flatnonzero(found)
        rows[at, there] = (1 + np.log(found[there])) * idf[there]
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return rows, letters_of


def _inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """From all rows: one count for each place and partition is shuffled, one for each place gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                total[:-1] += counts(text)[0] > 0
                total[-1] += 1
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total[places])], ["place", "n"])

    summed = rows.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    total = np.zeros(DIMENSIONS + 1)
    for r in summed.collect():
        total[r["place"]] = r["n"]
    return (np.log((1 + total[-1]) / (1 + total[:-1])) + 0.1).astype(np.float32)


def _clustered(rows: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out rows: centroids and each row's centroid."""
    chosen = [0]
    near = rows @ rows[0]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centers = rows[chosen]
    for _ in range(rounds):
        own = np.argmax(rows @ centers.T, axis=1)
        sums = np.array([rows[own == c].sum(axis=0) if np.any(own == c) else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers, np.argmax(rows @ centers.T, axis=1)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", centroids: int = CENTROIDS) -> Model:
    """Learn from the rows whose text and language are not null."""
    known = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    idf = _inverse_frequencies(known)
    is_long = F.length(F.regexp_replace("text", r"\P{L}+", "")) >= SHORT
    hashed = known.filter(F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text").alias("place"), is_long.alias("long"))
    n = F.approx_count_distinct("place", 0.05).alias("n")
    # distinct texts of each language, long and short ones; copies count once
    distinct = {(r["lang"], r["long"]): r["n"] for r in hashed.groupBy("lang", "long").agg(n).collect()}
    sizes = {r["lang"] for r in known.select("lang").distinct().collect()}
    each = max(1, min(SAMPLE, SAMPLE_ALL // max(len(sizes), 1)))
    # twice as many as needed, so that enough come whatever the estimate is off; the rest is cut on arrival
    share = F.lit(0.0)
    for name, long in distinct:
        enough = not long and distinct.get((name, True), 0) >= 2 * each
        part = 0.0 if enough else min(1.0, 2 * each / max(distinct[name, long], 1))
        share = F.when((F.col("lang") == name) & (F.col("long") == long), part).otherwise(share)
    at = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000
    sampled = known.withColumn("long", is_long).filter(at < share).select("lang", "long", F.xxhash64("text").alias("place"), "text")
    sampled = sampled.filter(F.col("text").rlike(r"\p{L}")).distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("long"), "place", "text"))
    sampled = sampled.withColumn("nth", nth).filter(F.col("nth") <= each).select("lang", "place", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            vectors, _ = _vectors(batch.column(2).to_pylist(), idf)
            cells = pa.array([v.astype("<f2").tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells], ["lang", "place", "vector"])

    vectors_of: dict[str, list] = {name: [] for name in sorted(sizes)}
    for r in sampled.mapInArrow(run, "lang string, place long, vector binary").collect():
        vectors_of[r["lang"]].append((r["place"], r["vector"]))
    languages, centers, owner, floor = sorted(sizes), [], [], []
    for at, name in enumerate(languages):
        got = sorted(vectors_of[name])
        if not got:
            continue
        vectors = np.array([np.frombuffer(v, "<f2") for _, v in got], dtype=np.float32)
        middle, cluster = _clustered(vectors, centroids, ROUNDS)
        for c in range(len(middle)):
            if np.any(cluster == c):
                centers.append(middle[c])
                owner.append(at)
                floor.append(SLACK * float(np.quantile(vectors[cluster == c] @ middle[c], 0.01)))
    return Model(
        languages, idf, np.array(centers, np.float32).reshape(-1, DIMENSIONS), np.array(owner, np.int64), np.array(floor)
    )


def _judged(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    vectors, n = _vectors([t or "" for t in texts], model.idf)
    if not len(model.owner):
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    cosine = vectors @ model.centroids.T
    best = np.argmax(cosine, axis=1)
    score = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0, 1)
    halvings = np.maximum(0, np.log2(FULL / np.maximum(n, 1)))
    far = score < model.floor[best] * HALVING**halvings
    names = [model.languages[model.owner[b]] if k else UNKNOWN for b, k in zip(best, n)]
    return names, np.where(n > 0, score, 0.0), far | (n == 0)


def identify(docs: DataFrame, model: Model, id: Column | str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang, score, rejected): nearest language of each row, its cosine, and whether that is too far."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x CENTROIDS x DIMENSIONS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_CELLS // DIMENSIONS)
        for whole in slices(batches):
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                names, score, far = _judged(batch.column(1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(far)],
                    ["id", "lang", "score", "rejected"],
                )

    key = F.col(id) if isinstance(id, str) else id
    rows = docs.select(key.alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang string, score double, rejected boolean")


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not rejected, with all columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_CELLS // DIMENSIONS)
        for whole in slices(batches):
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                _, _, far = _judged(batch.column(at).to_pylist(), shared.value)
                yield batch.filter(pa.array(~far))

    return docs.mapInArrow(run, docs.schema)
