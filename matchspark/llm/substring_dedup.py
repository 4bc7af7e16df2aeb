"""Repeated passages by difference-cover anchors.

A window is ``WINDOW`` consecutive words of a document. A word goes if some window over it also
starts in a document with a smaller id; windows are judged on the input.

1. *Anchors.* A gram of ``GRAM`` words is hashed only at places that modulo ``PERIOD`` lie in
   ``COVER``. Every number modulo ``PERIOD`` is a difference of two members of it, so for any two
   places there is a shift below ``PERIOD`` that takes both to members: two equal windows share
   an aligned anchor, as ``PERIOD - 1 + GRAM = WINDOW``. Hashes are dealt to buckets, which say which
   places hold an anchor that stands somewhere else too. Five bytes of a hash are kept there:
   a false hit only costs work.
2. *Extension.* Windows that hold such an anchor are hashed whole, with 96 bits beside the bucket's, and dealt to
   buckets, which say which of them also stand in a document with a smaller id.
3. The words of those windows go, whole texts in hand.

What a slice of texts holds more than once is settled there, and sent to a bucket once: a passage that a
third of all documents share is one key for each slice. Buckets are asked with hashes and places; texts
move to the answers for their document, once after each step. There are as many buckets, and as many parts of
the documents that answers go to, as the texts need for each to be small.

Defined results: a null or empty text has no words; a null id is neither smaller nor larger than
another, so its row stays as it is and takes nothing away; rows of the same id take nothing from
each other, and equal rows of one id are treated alike; other columns play no part; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.text import slices, text_bytes, word_codes
from matchspark.session import cut

WINDOW = 13
GRAM, PERIOD, COVER = 7, 7, (0, 1, 3)
#: Bytes of text whose hashes meet in one bucket, and whose words are held as numbers at once.
BUCKET_BYTES, SLICE = 16 << 20, 2 << 20
FACTORS = np.random.default_rng(13).integers(0, 2**63, (2, WINDOW), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a batch of texts: their hashes, and where each text begins."""

    def __init__(self, texts: pa.Array):
        codes, self.starts, distinct = word_codes(texts)
        digests = b"".join(map(xxhash.xxh3_128_digest, distinct.cast(pa.binary()).to_pylist()))
        self.hashes = np.frombuffer(digests, np.uint64).reshape(-1, 2)[codes]
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.starts))
        self.place = np.arange(len(codes)) - self.starts[self.owner]
        self.left = self.starts[self.owner + 1] - np.arange(len(codes))  # words from here to the end

    def grams(self, at: np.ndarray, size: int, half: int = 0) -> np.ndarray:
        """Hashes of the ``size`` words from each place on."""
        own = self.hashes[:, half]
        return _mixed(sum((own[at + i] * FACTORS[half, i] for i in range(size)), np.zeros(len(at), np.uint64)))


def _planes(x: np.ndarray) -> bytes:
    """Differences of neighbours, bytes of equal weight together: what a shuffle's compression makes small."""
    x = np.diff(x, prepend=x[:1] * 0)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplaned(parts: list[bytes], kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    each = [np.cumsum(np.frombuffer(p, np.uint8).reshape(width, -1).T.copy().view(kind).ravel(), dtype=kind) for p in parts]
    return np.concatenate([np.zeros(0, kind), *each])


def _joined(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)


#: Keys to look up with the rows and places that ask, keys known to answer all others, and settled rows and places.
ASKED = "bucket int, keys binary, ids binary, tags binary, places binary, known binary, done_ids binary, done_tags binary, done_places binary"


def _cut_by(bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> list[list[np.ndarray]]:
    """The columns' values of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(1, buckets))
    return list(zip(*(np.split(c[order], bounds) for c in columns)))


def _batch(buckets: int, asked: list, known: list, done: list) -> pa.RecordBatch:
    """One row for each bucket: asked (keys, ids, tags, places), known (keys), done (ids, tags, places)."""
    rows = []
    for b in range(buckets):
        keys, *where = asked[b]
        if len(keys) or len(known[b][0]) or len(done[b][0]):
            rows.append((b, keys.tobytes(), *map(_planes, where), known[b][0].tobytes(), *map(_planes, done[b])))
    kinds = [pa.int32()] + [pa.binary()] * 8
    names = [x.split()[0] for x in ASKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names)


def _gathered(table: pa.Table) -> pa.Table:
    """A row for each id and tag with all its places."""
    ids, tags, places = (_unplaned(table.column(c).to_pylist(), k) for c, k in (("ids", np.int64), ("tags", np.int64), ("places", np.int32)))
    order = np.lexsort((places, tags, ids))
    ids, tags, places = ids[order], tags[order], places[order]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])))[: len(ids)]
    ends = np.append(np.flatnonzero(new), len(ids))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places))
    return pa.table([pa.array(ids[new]), pa.array(tags[new]), lists], ["id", "tag", "places"])


def _settled(asked: DataFrame, wins: Callable, width: int, buckets: int) -> DataFrame:
    """(id, tag, places): what the buckets answer yes to. ``wins(keys, ids, known)`` tells which of the keys are."""

    def run(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_pylist() for c in table.column_names if c != "bucket"}
        asking, done = ([_unplaned(column[f"{d}{c}"], k) for c, k in (("ids", np.int64), ("tags", np.int64), ("places", np.int32))] for d in ("", "done_"))
        yes = wins(_joined(column["keys"], width), asking[0], _joined(column["known"], width))
        where = [np.concatenate([a[yes], b]) for a, b in zip(asking, done)]
        order = np.lexsort(where[::-1])
        part = (_mixed(where[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        parts = _cut_by(part[order], buckets, *(w[order] for w in where))
        rows = [(i, *map(_planes, p)) for i, p in enumerate(parts) if len(p[0])]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["part", "ids", "tags", "places"])

    found = asked.groupBy("bucket").applyInArrow(run, "part int, ids binary, tags binary, places binary")
    return found.groupBy("part").applyInArrow(_gathered, "id long, tag long, places array<int>")


def _anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """(id, tag, places): places of anchors that stand at another place too; ``tag`` is 0."""
    cover = np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            words, ids = Words(batch.column(1)), np.asarray(batch.column(0))
            long = (np.diff(words.starts) >= WINDOW)[words.owner]
            at = np.flatnonzero(cover[words.place % PERIOD] & (words.left >= GRAM) & long)
            key = words.grams(at, GRAM)
            order = np.argsort(key, kind="stable")
            same = np.concatenate(([False], key[order][1:] == key[order][:-1], [False]))[: len(key) + 1]
            several = np.empty(len(key), bool)
            several[order] = same[1:] | same[:-1]
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            short = np.ascontiguousarray((key // np.uint64(buckets))[:, None].view(np.uint8).reshape(-1, 8)[:, :5])
            where = ids[words.owner[at]], np.zeros(len(at), np.int64), words.place[at].astype(np.int32)
            asked = _cut_by(bucket[~several], buckets, short[~several], *(w[~several] for w in where))
            first = np.zeros(len(key), bool)
            first[order[~same[:-1]]] = True
            known = _cut_by(bucket[several & first], buckets, short[several & first])
            done = _cut_by(words.owner[at][several] % buckets, buckets, *(w[several] for w in where))
            yield _batch(buckets, asked, known, done)

    def wins(keys: np.ndarray, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(keys) + len(known), 8), np.uint8)
        wide[:, :5] = np.concatenate([keys, known])
        own = wide.view(np.uint64).ravel()
        again = np.concatenate([own, own[len(keys) :]])  # a known key answers alone
        order = np.argsort(again)
        same = np.concatenate(([False], again[order][1:] == again[order][:-1], [False]))
        yes = np.empty(len(again), bool)
        yes[order] = (same[1:] | same[:-1])[: len(again)]
        return yes[: len(keys)]

    return _settled(rows.select("id", "text").mapInArrow(run, ASKED), wins, 5, buckets)


#: Bytes of a window's two hashes that its bucket sees.
_KEPT = np.array([0, 1, 2, 3, 8, 9, 10, 11, 12, 13, 14, 15])


def _windows(rows: DataFrame, buckets: int) -> DataFrame:
    """(id, tag, places): a first place of each window that also starts in a document with a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            words, ids, tags = Words(batch.column(2)), np.asarray(batch.column(0)), np.asarray(batch.column(1))
            lists = batch.column(3)
            owner = np.repeat(np.arange(len(ids)), np.diff(np.asarray(lists.offsets)))
            places = np.asarray(lists.flatten()).astype(np.int64)
            inside = places < np.diff(words.starts)[owner]  # of another row with the same id
            at = words.starts[owner[inside]] + places[inside]
            edge = np.zeros(len(words.owner) + 1, np.int64)
            np.add.at(edge, np.maximum(at - (WINDOW - GRAM), words.starts[owner[inside]]), 1)
            np.add.at(edge, at + 1, -1)
            start = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (words.left >= WINDOW))
            high, low, doc = words.grams(start, WINDOW, 0), words.grams(start, WINDOW, 1), words.owner[start]
            # one place for each document and window, the smallest id first
            order = np.lexsort((start, tags[doc], ids[doc], low, high))
            high, low, doc, start = high[order], low[order], doc[order], start[order]
            other = np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))[: len(high)]
            new = other | np.concatenate(([True], (ids[doc][1:] != ids[doc][:-1]) | (tags[doc][1:] != tags[doc][:-1])))[: len(high)]
            group = np.cumsum(other)[new] - 1
            high, low, doc, start = high[new], low[new], doc[new], start[new]
            least = ids[doc][np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]]
            more = ids[doc] > least[group] if len(group) else np.zeros(0, bool)
            key = np.column_stack([high // np.uint64(buckets), low]).view(np.uint8).reshape(-1, 16)[:, _KEPT]
            # in the order of the texts, so that neighbours' ids and places are alike
            order = np.lexsort((start,))
            high, key, doc, start, more = high[order], key[order], doc[order], start[order], more[order]
            where = ids[doc], tags[doc], words.place[start].astype(np.int32)
            bucket = (high % np.uint64(buckets)).astype(np.int64)
            asked = _cut_by(bucket[~more], buckets, key[~more], *(w[~more] for w in where))
            done = _cut_by(doc[more] % buckets, buckets, *(w[more] for w in where))
            yield _batch(buckets, asked, [(key[:0],)] * buckets, done)

    def wins(keys: np.ndarray, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(keys), 16), np.uint8)
        wide[:, _KEPT] = keys
        high, low = wide.view(np.uint64).T
        order = np.lexsort((ids, low, high))
        new = np.concatenate(([True], (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)))[: len(ids)]
        least = ids[order][new][np.cumsum(new) - 1] if len(ids) else ids
        yes = np.empty(len(ids), bool)
        yes[order] = ids[order] > least
        return yes

    return _settled(rows.select("id", "tag", "text", "places").mapInArrow(run, ASKED), wins, 12, buckets)


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept): every row with its words counted, and those that stay joined by one space."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = rows.withColumn("tag", F.xxhash64("text"))
    named = own.filter("id is not null")
    buckets = max(1, -(-(named.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes))
    anchors = cut(_anchors(named, buckets).drop("tag"), "anchors")
    repeats = cut(_windows(named.join(anchors, "id"), buckets), "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            words, lists = Words(batch.column(1)), batch.column(2).fill_null([])
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            at = words.starts[owner] + np.asarray(lists.flatten()).astype(np.int64)
            # an answer names one place of its window in the document: find the others
            touched = np.zeros(batch.num_rows, bool)
            touched[owner] = True
            start = np.flatnonzero(touched[words.owner] & (words.left >= WINDOW))
            hashes = np.concatenate([words.grams(start, WINDOW), words.grams(at, WINDOW)])
            distinct, number = np.unique(hashes, return_inverse=True)
            number += np.concatenate([words.owner[start], owner]) * len(distinct)
            start = start[np.isin(number[: len(start)], number[len(start) :])]
            edge = np.zeros(len(words.owner) + 1, np.int64)
            edge[start] += 1
            edge[start + WINDOW] -= 1
            stays = np.cumsum(edge[:-1]) == 0
            gone = np.concatenate(([0], np.cumsum(~stays)))[words.starts]
            n_removed = np.diff(gone)
            kept = []
            for i, parts in enumerate(map(bytes.split, text_bytes(batch.column(1)))):
                kept.append(b" ".join(compress(parts, stays[words.starts[i] : words.starts[i + 1]]) if n_removed[i] else parts))
            columns = [batch.column(0), pa.array(np.diff(words.starts)), pa.array(n_removed), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept"])

    answered = own.join(repeats, ["id", "tag"], "left").select("id", "text", "places")
    return answered.mapInArrow(run, "id long, n_words long, n_removed long, kept string")
