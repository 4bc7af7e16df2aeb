"""Toxicity by a factorization machine over hashed terms.

A text's terms are the distinct words it holds (runs of letters and digits, A-Z
lower-cased) and the beginnings of these words, hashed to 2 ** ``BITS`` places. The score is
sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j): the factors v learn
which terms are toxic together, such as an insult with a group, and which are
harmless together, what weights alone cannot say. Features are not scaled by the
text's length, so a few insults count the same in a long text.

It is fitted by mini-batch AdaGrad on a bounded sample: the texts of at most
``SAMPLE`` labels of each kind, those that come first by a hash of their id.
A term gets parameters in one of two ways. Alone: at least ``MIN_TEXTS`` sampled texts hold it and their
labels differ from the others' by ``MIN_DEVIATIONS`` standard deviations. In a pair: texts that hold it and another
word are toxic more often, or less, than either word tells, by ``PAIR_DEVIATIONS``; so two words that are neutral
alone and toxic together are learned. Pairs of words are counted in ``PAIR_SAMPLE`` texts of each label. Terms and
pairs are counted by Spark; the driver gets the chosen terms and, of each sampled text, those it holds.

Defined results: null is the empty text; texts without a known term have the score
of the bias; without learning rows every score is 0.5; if all learning rows have one
label, scores are near it. Rows are scored as given; conflicting labels are all used;
rows without id, text or label are not learned from, of texts with one id one is. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.text import slices, text_bytes
from matchspark.session import cut

BITS, FACTORS = 20, 6
STEMS = (4, 5, 6, 7)
SAMPLE, MIN_TEXTS, MIN_DEVIATIONS = 4000, 5, 4.0
#: Texts of each label in which pairs of words are counted; least texts with a pair and deviations that tell; words in
#: more than this share of the texts make no pairs, they are everywhere; most words that make pairs, those in most
#: toxic texts, and most pairs that are chosen, the clearest first; words whose pairs are counted together.
PAIR_SAMPLE, PAIR_TEXTS, PAIR_DEVIATIONS, PAIR_SHARE, PAIR_WORDS, PAIRS, PAIR_BLOCK = 1000, 12, 5.0, 0.1, 12_000, 2000, 512
#: Words whose places a worker remembers.
REMEMBERED = 200_000
EPOCHS, BATCH, RATE = 12, 64, 0.05
L2_WEIGHT, L2_FACTOR = 2e-4, 1e-3
SEED = 11

#: Bytes of words stay, A-Z become small, all else separates. Bytes from 128 up belong to letters outside ASCII.
_TABLE = bytes(
    b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)


class Model(NamedTuple):
    places: np.ndarray  # sorted places that have parameters
    bias: float
    weights: np.ndarray
    factors: np.ndarray


_known: dict[bytes, tuple[int, ...]] = {}


def _of_word(word: bytes) -> tuple[int, ...]:
    digest, shift = xxhash.xxh64_intdigest, 64 - BITS
    return tuple(digest(t) >> shift for t in (word + b" ", *(word[:n] for n in STEMS if len(word) >= n)))


def places(text: bytes) -> np.ndarray:
    """Sorted distinct places of a text's terms: words with an end mark, and their first bytes."""
    found: set[int] = set()
    for word in set(text.translate(_TABLE).split()):
        own = _known.get(word)
        if own is None:
            if len(_known) >= REMEMBERED:
                _known.clear()
            own = _known[word] = _of_word(word)
        found.update(own)
    return np.sort(np.fromiter(found, np.int64, len(found)))


def word_places(text: bytes) -> np.ndarray:
    """Sorted distinct places of whole words."""
    digest, shift = xxhash.xxh64_intdigest, 64 - BITS
    return np.array(sorted({digest(w + b" ") >> shift for w in set(text.translate(_TABLE).split())}), np.int64)


def _sums(model: Model, rows: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and the sums of factors, of n texts given as (row, parameter) pairs."""
    linear = np.bincount(rows, model.weights[at], minlength=n)
    own = model.factors[at]
    total = np.stack([np.bincount(rows, own[:, f], minlength=n) for f in range(own.shape[1])], axis=1)
    square = np.bincount(rows, (own**2).sum(axis=1), minlength=n)
    return model.bias + linear + 0.5 * ((total**2).sum(axis=1) - square), total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learn(texts: list[np.ndarray], labels: np.ndarray) -> Model:
    """AdaGrad on the logistic loss of the sampled texts, given as places."""
    rng = np.random.default_rng(SEED)
    if not len(texts):
        return Model(np.empty(0, np.int64), 0.0, np.empty(0), np.empty((0, FACTORS)))
    used = np.unique(np.concatenate(texts))
    found = [np.searchsorted(used, t) for t in texts]
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    model = Model(used, np.log(share / (1 - share)), np.zeros(len(used)), rng.normal(0, 0.01, (len(used), FACTORS)))
    bias, bias_seen = model.bias, 1e-6
    seen_w, seen_v = np.full(len(used), 1e-6), np.full((len(used), FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            at = np.concatenate([found[i] for i in chosen])
            rows = np.repeat(np.arange(len(chosen)), [len(found[i]) for i in chosen])
            score, total = _sums(model._replace(bias=bias), rows, at, len(chosen))
            error = (_sigmoid(score) - labels[chosen]) / len(chosen)
            touched, place = np.unique(at, return_inverse=True)
            pull = error[rows]
            slope_w = np.zeros(len(touched))
            np.add.at(slope_w, place, pull)
            slope_w += L2_WEIGHT * model.weights[touched]
            own = model.factors[at]
            part = pull[:, None] * (total[rows] - own)
            slope_v = np.zeros((len(touched), FACTORS))
            np.add.at(slope_v, place, part)
            slope_v += L2_FACTOR * model.factors[touched]
            seen_w[touched] += slope_w**2
            seen_v[touched] += slope_v**2
            model.weights[touched] -= RATE * slope_w / np.sqrt(seen_w[touched])
            model.factors[touched] -= RATE * slope_v / np.sqrt(seen_v[touched])
            slope = float(error.sum())
            bias_seen += slope**2
            bias -= RATE * slope / np.sqrt(bias_seen)
    return model._replace(bias=bias)


def _counted(sampled: DataFrame) -> DataFrame:
    """(place, n, toxic): texts of the sample with each term, and toxic ones among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cells = [np.frombuffer(x, "<i4") for x in batch.column(1).to_pylist()]
            toxic = np.repeat(np.asarray(batch.column(0)), [len(c) for c in cells])
            place, at = np.unique(np.concatenate(cells), return_inverse=True)
            n = np.bincount(at, minlength=len(place))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place, n, np.bincount(at, toxic, len(place)).astype(np.int64))], ["place", "n", "toxic"])

    return sampled.select("label", "places").mapInArrow(run, "place int, n long, toxic long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _pairs(sampled: DataFrame) -> np.ndarray:
    """Places of words that tell something together that neither tells alone."""
    some = [sampled.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(PAIR_SAMPLE) for y in (0, 1)]
    texts = cut(some[0].unionAll(some[1]).select("label", F.col("words").alias("places")), "pair-texts")
    total, toxic = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    often = _counted(texts).filter((F.col("n") >= PAIR_TEXTS) & (F.col("n") <= max(PAIR_SHARE * total, 2 * PAIR_TEXTS)))
    band = often.orderBy(F.desc("toxic"), "place").limit(PAIR_WORDS).toArrow()
    order = np.argsort(np.asarray(band.column(0)))
    known, n, hits = (np.asarray(band.column(i))[order].astype(np.int64) for i in range(3))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [np.searchsorted(known, np.intersect1d(np.frombuffer(x, "<i4"), known, assume_unique=True)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype("<i4").tobytes() for x in own], pa.binary())], ["label", "words"])

    held = texts.mapInArrow(found, "label int, words binary").collect()  # at most 2 * PAIR_SAMPLE * PAIR_WORDS numbers
    sides = [[np.frombuffer(bytes(r["words"]), "<i4") for r in held if r["label"] == y] for y in (0, 1)]
    spark = sampled.sparkSession
    shared = spark.sparkContext.broadcast((sides, hits / np.maximum(n, 1), toxic / max(total, 1)))
    count = len(known)

    def incidence(texts: list[np.ndarray], start: int, stop: int) -> np.ndarray:
        """A row for each text, a column for each word of a range."""
        out = np.zeros((len(texts), stop - start), np.float32)
        for row, words in zip(out, texts):
            row[words[(words >= start) & (words < stop)] - start] = 1
        return out

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, rate, base = shared.value
        for start in (int(x) for batch in batches for x in np.asarray(batch.column(0))):
            stop = min(start + PAIR_BLOCK, count)
            own = [incidence(t, start, stop) for t in sides]
            for left in range(start, count, 4 * PAIR_BLOCK):
                right = min(left + 4 * PAIR_BLOCK, count)
                clean, hits = (a.T @ incidence(t, left, right) for a, t in zip(own, sides))
                a, b = np.nonzero((clean + hits >= PAIR_TEXTS) & (np.arange(start, stop)[:, None] < np.arange(left, right)))
                hits, n = hits[a, b], (clean + hits)[a, b]
                a, b = a + start, b + left
                high, low = (np.clip(f(f(rate[a], rate[b]), base), 0.01, 0.99) for f in (np.maximum, np.minimum))
                apart = np.maximum((hits - n * high) / np.sqrt(n * high * (1 - high)), (n * low - hits) / np.sqrt(n * low * (1 - low)))
                keep = apart >= PAIR_DEVIATIONS
                pair = a[keep].astype(np.int64) << BITS | b[keep]
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(apart[keep].astype(float))], ["pair", "apart"])

    blocks = spark.range(0, count, PAIR_BLOCK, max(1, -(-count // PAIR_BLOCK)))
    best = blocks.mapInArrow(tell, "pair long, apart double").orderBy(F.desc("apart"), "pair").limit(PAIRS)
    pairs = np.array([r["pair"] for r in best.collect()], np.int64)
    return known[np.unique(np.concatenate([pairs >> BITS, pairs & ((1 << BITS) - 1)]))] if len(pairs) else known[:0]


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE
) -> Model:
    """Learn from the texts of ``docs`` that ``labels`` marks 0 or 1.

    The sample is drawn from the labels, by a hash of their id, before any text is read: at most
    2 * ``sample`` ids, which go to every task, so no text is shuffled.
    """
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).dropna()
    drawn = [known.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(drawn[0].union(drawn[1]).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cells = [[f(t).astype("<i4").tobytes() for t in text_bytes(batch.column(2))] for f in (places, word_places)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.binary()) for c in cells)], ["id", "label", "places", "words"])

    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    rows = texts.join(chosen, "id").select("id", "label", "text")
    kind = rows.schema["id"].dataType.simpleString()
    # repeated rows of an id are one text
    once = rows.mapInArrow(run, f"id {kind}, label int, places binary, words binary").groupBy("id", "label").agg(F.min(F.struct("places", "words")).alias("text"))
    sampled = cut(once.select("id", "label", "text.*"), "sampled")
    total, toxic = sampled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    yes, no = max(toxic, 1), max(total - toxic, 1)
    rate = F.greatest(F.least(F.col("n") / max(total, 1), F.lit(1 - 1e-9)), F.lit(1e-9))
    apart = F.abs(F.col("toxic") / yes - (F.col("n") - F.col("toxic")) / no) / F.sqrt(rate * (1 - rate) * (1 / yes + 1 / no))
    alone = _counted(sampled).filter((F.col("n") >= MIN_TEXTS) & (apart >= MIN_DEVIATIONS)).select("place").toArrow()  # at most 2 ** BITS
    used = np.unique(np.concatenate([np.asarray(alone.column(0)).astype(np.int64), _pairs(sampled)]))
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cells = [np.frombuffer(x, "<i4") for x in batch.column(2).to_pylist()]
            kept = [c[np.isin(c, shared.value, assume_unique=True)].tobytes() for c in cells]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(kept, pa.binary()), batch.column(0).cast(pa.string())], ["label", "places", "id"])

    got = sampled.select("id", "label", "places").mapInArrow(held, "label int, places binary, id string").collect()
    got = sorted((r["label"], bytes(r["places"]), r["id"]) for r in got)
    return learn([np.frombuffer(p, "<i4").astype(np.int64) for _, p, _ in got], np.array([y for y, _, _ in got], float))


def score(docs: DataFrame, model: Model, id: Column | str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): how likely each text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        has = np.zeros(1 << BITS, dtype=np.int32)
        has[model.places] = np.arange(1, len(model.places) + 1)
        for batch in slices(batches):
            found = [has[places(t)] for t in text_bytes(batch.column(1))]
            found = [x[x > 0] - 1 for x in found]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            at = np.concatenate(found).astype(np.int64)
            values = _sigmoid(_sums(model, rows, at, len(found))[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["id", "score"])

    key = F.col(id) if isinstance(id, str) else id
    rows = docs.select(key.alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
