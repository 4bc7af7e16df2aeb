"""Language-model scores from a log-frequency Bloom filter.

Tokens are words between ASCII white space after lower-casing A-Z, then an end.

*Counting.* Every token and every pair of neighbours of the learning texts is
counted, folded in each task before it is shuffled, by 64-bit hash.

*Filter.* A count c is held as the level 1 + floor(log2 c): an n-gram is entered
in the filters of all levels up to its own. n-grams are dealt to buckets by hash,
and each bucket builds its own filters of ``BITS`` bits for each entry, so no task
sees them all. Filters of single tokens go to every worker if all their levels fit in ``MAX_BYTES``;
else, and for pairs always, they stay where they lie and are asked. Either way every
n-gram is probed in all levels, so scores do not depend on what fits.

*Scoring.* The level of an n-gram is found by probing level after level until one
fails. P(w | u) = (1 - g) * count(u w) / count(u) + g * (count(w) + 1) / (N + V + 1);
g is the share of the learning text whose pairs are not in the filter or occur
once: the Good-Turing estimate of what is new. A text's score is a sum over its pairs, so of a slice of texts
each distinct pair of a row goes to the pair's bucket with the levels of its two tokens, and returns
with its own level in place of its key. Texts stay where they are, unless the single tokens' filters do not fit:
then a slice travels with the answers about its tokens. Of pairs 48 bits of a hash are kept.

*Base score.* It needs exact counts of all tokens. The ``FREQUENT`` most frequent
ones or fewer go to every worker; the other tokens of a text are joined with their
counts by hash.

Defined results: a null or empty text is the end token alone; without learning
texts N and V are 0 and every token is unknown; repeated rows and ids count and
are scored row by row; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from matchspark.llm.text import slices, text_bytes
from matchspark.session import cut

SEED, START = 42, np.uint64(0x9E3779B97F4A7C15)
BITS, PROBES = 8, 4
MAX_BYTES = 64 << 20
FREQUENT = 1 << 20
#: Tokens of learning text for each bucket, and the most buckets.
BUCKET_TOKENS, MAX_BUCKETS = 1 << 21, 1 << 20
LEVELS = 48
#: Bytes of text, or of packed keys, that a worker takes apart at once; and of texts whose keys are sent together.
SLICE, PART = 2 << 20, 4 << 20
#: Most rows of such a part: a row's number has 16 bits beside its key's 48.
PART_ROWS = 1 << 16
LOW = np.uint64(16)


def token_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    words.append(b"")  # the end: no word is empty
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of the texts: hash of the one before, key of the token, key of the pair."""
    hashes = np.concatenate(texts)
    before = np.concatenate([np.concatenate(([START], t[:-1])) for t in texts])
    return before, _mixed(hashes), _mixed(before * np.uint64(0xD1B54A32D192ED03) + hashes) >> LOW << LOW


_ZSTD = pa.Codec("zstd", 1)


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of one length, bytes of equal weight together, compressed."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return np.array([len(columns[0]), len(raw)], np.int64).tobytes() + _ZSTD.compress(raw, asbytes=True)


def _opened(data: bytes, *kinds: type) -> list[np.ndarray]:
    n, size = np.frombuffer(data, np.int64, 2)
    raw, at, out = np.frombuffer(_ZSTD.decompress(data[16:], int(size)), np.uint8), 0, []
    for kind in map(np.dtype, kinds):
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def _steps_of(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys: small numbers."""
    return np.diff(keys, prepend=keys[:1] * np.uint64(0))


def _by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the sorted keys of each bucket begin, and their number."""
    bounds = np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - (buckets.bit_length() - 1)) if buckets > 1 else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(counts, 1).astype(float))[1]


def _middle(level: np.ndarray) -> np.ndarray:
    """Mean of the counts of a level; 0 for level 0."""
    top = np.exp2(level.astype(float))
    return np.where(level > 0, (1.5 * top - 1) / 2, 0.0)


def _steps(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of each key's places in a filter; probe i is at (start + i * step) modulo the filter's bits."""
    return _mixed(keys + np.uint64(0x632BE59BD9B4E019)), _mixed(keys ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def filter_bits(keys: np.ndarray) -> bytes:
    size = -(-max(64, len(keys) * BITS) // 8) * 8
    bits = np.zeros(size, dtype=bool)
    a, b = _steps(keys)
    for i in range(PROBES):
        bits[(a + np.uint64(i) * b) % np.uint64(size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class LogFilter(NamedTuple):
    """Filters of one order, by level from ``lowest`` up: (bit offset of each bucket, bits of each bucket, bytes)."""

    buckets: int
    lowest: int
    by_level: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def level(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), dtype=np.int64)
        alive = np.arange(len(keys))
        shift = np.uint64(64 - (self.buckets.bit_length() - 1))
        level = self.lowest
        while len(alive) and level in self.by_level:
            offsets, sizes, data = self.by_level[level]
            own = keys[alive]
            bucket = (own >> shift).astype(np.int64) if self.buckets > 1 else np.zeros(len(own), np.int64)
            size = sizes[bucket]
            there = size > 0
            alive, own, bucket, size = alive[there], own[there], bucket[there], size[there]
            a, b = _steps(own)
            for i in range(PROBES):
                p = (a + np.uint64(i) * b) % size + offsets[bucket]
                hit = (data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
                alive, a, b, size, bucket = alive[hit], a[hit], b[hit], size[hit], bucket[hit]
            found[alive] = level
            level += 1
        return found

    def count(self, keys: np.ndarray) -> np.ndarray:
        return _middle(self.level(keys))


class Found(NamedTuple):
    """Levels of the keys of a part of the texts, as their buckets found them."""

    keys: np.ndarray  # sorted; what is not here has level 0
    levels: np.ndarray

    def level(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.levels[at], 0)

    def count(self, keys: np.ndarray) -> np.ndarray:
        return _middle(self.level(keys))


class Model(NamedTuple):
    tokens: int
    types: int
    novel: float
    single: LogFilter  # empty if it does not go to every worker
    frequent: np.ndarray  # sorted hashes
    frequent_counts: np.ndarray
    complete: bool  # the frequent tokens are all there are
    counts: DataFrame | None  # (h, n) of all tokens
    filters: DataFrame | None = None  # of all orders, bucket by bucket
    away: bool = False  # those of single tokens do not go to every worker


def _token_counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            found, n = np.unique(np.concatenate([token_hashes(t) for t in text_bytes(batch.column(0))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["h", "n"])

    return rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


PACKED = "grams int, bucket int, data binary"


def _packed(grams: int, keys: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted keys with counts, cut by bucket: a row for those of count 1, which need no count, and one for the others."""
    rows = []
    for several in (False, True):
        chosen = (n > 1) == several
        own, counts = keys[chosen], n[chosen].astype(np.uint64)
        cuts = _by_bucket(own, buckets)
        for i in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[i], cuts[i + 1])
            steps = _steps_of(own[part])
            rows.append((grams, int(i), bytes([several]) + (_squeezed(steps, counts[part]) if several else _squeezed(steps))))
    columns = zip(*rows) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], ["grams", "bucket", "data"])


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, *counts = _opened(data[1:], np.uint64, np.uint64) if data[0] else _opened(data[1:], np.uint64)
    keys = np.cumsum(steps, dtype=np.uint64)
    return keys, counts[0].astype(np.int64) if counts else np.ones(len(keys), np.int64)


def _filters(rows: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """(grams, bucket, level, n, total, bits): filters of each bucket and level; n entries that occur total times."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PART):
            _, _, keys = _keys([token_hashes(t) for t in text_bytes(batch.column(0))])
            yield _packed(2, *np.unique(keys, return_counts=True), buckets)

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = _mixed(np.asarray(batch.column(0)).view(np.uint64)), np.asarray(batch.column(1))
            order = np.argsort(keys)
            yield _packed(1, keys[order], n[order], buckets)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if here is None:
                return
            keys, n = (np.concatenate(x) for x in zip(*map(_unpacked, parts)))
            keys, place = np.unique(keys, return_inverse=True)
            n = np.bincount(place, n, minlength=len(keys))
            own = levels(n)
            out = []
            for level in range(1, int(own.max(initial=0)) + 1):
                held = own >= level
                out.append((*here, level, int(held.sum()), int(n[held].sum()), filter_bits(keys[held])))
            names = ["grams", "bucket", "level", "n", "total", "bits"]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in slices(batches, SLICE):
            for r in batch.to_pylist():
                if here != (r["grams"], r["bucket"]):
                    yield from done()
                    here, parts = (r["grams"], r["bucket"]), []
                parts.append(r["data"])
        yield from done()

    packed = rows.mapInArrow(pairs, PACKED).unionAll(counts.mapInArrow(singles, PACKED))
    dealt = packed.repartition("grams", "bucket").sortWithinPartitions("grams", "bucket")
    return dealt.mapInArrow(build, "grams int, bucket int, level int, n long, total long, bits binary")


def _gathered(filters: DataFrame, grams: int, buckets: int) -> LogFilter:
    by_level: dict[int, list] = {}
    kept = filters.filter(F.col("grams") == grams)
    for r in kept.select("level", "bucket", "bits").collect():
        by_level.setdefault(r["level"], []).append((r["bucket"], bytes(r["bits"])))
    found = {}
    for level, parts in by_level.items():
        parts.sort()
        offsets, sizes = np.zeros(buckets, np.uint64), np.zeros(buckets, np.uint64)
        own = np.array([b for b, _ in parts])
        lengths = np.array([len(x) for _, x in parts], dtype=np.uint64) * np.uint64(8)
        sizes[own] = lengths
        offsets[own] = np.cumsum(lengths) - lengths
        found[level] = (offsets, sizes, np.frombuffer(b"".join(x for _, x in parts), np.uint8))
    return LogFilter(buckets, 1, found)


def fit(docs: DataFrame, text: str = "text", max_bytes: int = MAX_BYTES, frequent: int = FREQUENT) -> Model:
    """Learn from all texts of ``docs``."""
    rows = docs.select(F.col(text).cast("string").alias("text"))
    counts = cut(_token_counts(rows), "tokens")
    n, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = 1
    while buckets < MAX_BUCKETS and buckets * BUCKET_TOKENS < n:
        buckets *= 2
    filters = cut(_filters(rows, counts, buckets), "filters")
    sized = filters.groupBy("grams", "level").agg(F.sum(F.octet_length("bits")).alias("bytes"), F.sum("total").alias("total"))
    stats = {(r["grams"], r["level"]): (r["bytes"], r["total"]) for r in sized.collect()}
    away = sum(size for (g, _), (size, _) in stats.items() if g == 1) > max_bytes
    seen = stats.get((2, 2), (0, 0))[1]
    novel = min(max(1 - seen / max(n, 1), 0.05), 0.95)
    spread = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().collect()
    room, least = frequent, LEVELS
    for r in sorted(spread, key=lambda r: -r["level"]):
        if r["count"] > room:
            break
        room, least = room - r["count"], r["level"]
    top = counts.filter(F.col("n") >= 2**least).toArrow()
    hashes, held = np.asarray(top.column(0)).view(np.uint64), np.asarray(top.column(1))
    order = np.argsort(hashes)
    single = LogFilter(buckets, 1, {}) if away else _gathered(filters, 1, buckets)
    return Model(n, types, novel, single, hashes[order], held[order], len(order) == types, counts, filters, away)


def chances(model: Model, pair: np.ndarray, own: np.ndarray, before: np.ndarray) -> np.ndarray:
    """P(token | token before) from the levels of the pair, the token and the token before."""
    share = np.minimum(1.0, _middle(pair) / np.maximum(_middle(before), 1))
    flat = (_middle(own) + 1) / (model.tokens + model.types + 1)
    return np.minimum(1.0, (1 - model.novel) * share + model.novel * flat)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of the texts, each with a number of its own."""
    number = TaskContext.get().partitionId() << 32
    for batch in slices(batches, PART):
        for start in range(0, batch.num_rows, PART_ROWS):
            yield number, batch.slice(start, PART_ROWS)
            number += 1


def _asks(part: int, ids: pa.Array, texts: list[bytes], model: Model, single: LogFilter | Found, asked: pa.Schema) -> pa.RecordBatch:
    """What a part of the texts asks the buckets of its pairs; the first row carries what is known of its texts."""
    tokens = [token_hashes(t) for t in texts]
    lengths = np.array([len(t) for t in tokens])
    starts = np.cumsum(lengths) - lengths
    hashes = np.concatenate(tokens)
    before, keys, pairs = _keys(tokens)
    # exact base score of the frequent tokens; the others are joined with their counts later
    at = np.searchsorted(model.frequent, hashes)
    at[at == len(model.frequent)] = 0
    known = model.frequent[at] == hashes if len(model.frequent) else np.zeros(len(hashes), bool)
    c = np.where(known, model.frequent_counts[at], 0) if len(model.frequent) else np.zeros(len(hashes))
    base = np.add.reduceat(np.log10(c + 1) - np.log10(model.tokens + model.types + 1), starts)
    n_known = np.add.reduceat(known.astype(np.int64), starts)
    rest = [None if model.complete else h[~k].view(np.int64) for h, k in zip(tokens, np.split(known, starts[1:]))]
    distinct, place = np.unique(keys, return_inverse=True)
    own = single.level(distinct)[place].astype(np.uint8)
    previous = np.empty(len(own), np.uint8)
    previous[1:] = own[:-1]
    end = _mixed(np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64))
    previous[before == START] = single.level(end)[0]
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    found, first, times = np.unique(pairs | row, return_index=True, return_counts=True)
    cuts = _by_bucket(found, model.single.buckets)
    rows = []
    for i in np.flatnonzero(np.diff(cuts)):
        x, f, t = (v[cuts[i] : cuts[i + 1]] for v in (found, first, times))
        data = _squeezed(_steps_of(x >> LOW), x.astype(np.uint16), own[f], previous[f], t.astype(np.uint32))
        rows.append((int(i), part, 0, data, None))
    heads = [dict(zip(("id", "n_tokens", "n_known", "base", "rest"), h)) for h in zip(ids.to_pylist(), lengths.tolist(), n_known.tolist(), base.tolist(), rest)]
    rows[0] = (*rows[0][:4], heads)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), asked)], schema=asked)


def _probing(batches: Iterator[pa.RecordBatch], answer) -> Iterator[pa.RecordBatch]:
    """Rows by bucket and part, filters first: ``answer(filters, data)`` takes the place of what is asked."""
    here, own = None, LogFilter(1, 1, {})
    for batch in slices(batches, SLICE):
        out = []
        for r in batch.to_pylist():
            if here != r["bucket"]:
                here, own = r["bucket"], LogFilter(1, 1, {})
            if r["part"] < 0:
                bits = np.frombuffer(r["data"], np.uint8)
                own.by_level[r["level"]] = np.zeros(1, np.uint64), np.array([8 * len(bits)], np.uint64), bits
            else:
                out.append(r | {"data": answer(own, r["data"])})
        if out:
            yield pa.RecordBatch.from_pylist(out, batch.schema)


def _answered(asked: DataFrame, filters: DataFrame, grams: int, answer) -> DataFrame:
    """What was asked of the filters, each part's rows together with the answers."""
    held = filters.filter(F.col("grams") == grams).select("bucket", F.lit(-1).cast("long").alias("part"), "level", F.col("bits").alias("data"))
    rest = {c: F.lit(None).cast(asked.schema[c].dataType) for c in asked.columns[4:]}
    both = asked.unionByName(held.withColumns(rest))
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", "part", "level")
    return dealt.mapInArrow(lambda batches: _probing(batches, answer), asked.schema)


def _pair_levels(filters: LogFilter, data: bytes) -> bytes:
    """In place of its key, the level of each pair."""
    steps, row, own, before, times = _opened(data, np.uint64, np.uint16, np.uint8, np.uint8, np.uint32)
    level = filters.level(np.cumsum(steps, dtype=np.uint64) << LOW).astype(np.uint8)
    order = np.argsort(row, kind="stable")
    return _squeezed(np.diff(row[order], prepend=row[:1] * 0), level[order], own[order], before[order], times[order])


def _single_levels(filters: LogFilter, data: bytes | None) -> bytes | None:
    """The keys with their levels."""
    if data is None:
        return None
    steps = _opened(data, np.uint64)[0]
    return _squeezed(steps, filters.level(np.cumsum(steps, dtype=np.uint64)).astype(np.uint8))


def _asked(rows: DataFrame, model: Model) -> DataFrame:
    """(bucket, part, level, data, heads): what all parts of the rows (id, text) ask of the pairs' filters."""
    shared = rows.sparkSession.sparkContext.broadcast(model._replace(counts=None, filters=None))  # bounded by MAX_BYTES and FREQUENT
    id = rows.schema["id"].dataType.simpleString()
    asked = f"bucket int, part long, level int, data binary, heads array<struct<id: {id}, n_tokens: long, n_known: long, base: double, rest: array<long>>>"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], asked).schema)
    if not model.away:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for part, batch in _parts(batches):
                yield _asks(part, batch.column(0), text_bytes(batch.column(1)), model, model.single, schema)

        return rows.mapInArrow(run, asked)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = shared.value.single.buckets
        for part, batch in _parts(batches):
            keys = np.unique(_keys([token_hashes(t) for t in text_bytes(batch.column(1))])[1])
            cuts = _by_bucket(keys, buckets)
            out = [(int(i), part, 0, _squeezed(_steps_of(keys[cuts[i] : cuts[i + 1]])), None, None) for i in np.flatnonzero(np.diff(cuts))]
            out.append((int(part % buckets), part, 0, None, batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(batch.schema.field(0).type), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["bucket", "part", "level", "data", "ids", "texts"])

    def then(table: pa.Table) -> pa.Table:
        told = [_opened(d, np.uint64, np.uint8) for d in table.column("data").to_pylist() if d is not None]
        keys, level = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in told]), np.concatenate([v for _, v in told])
        order = np.argsort(keys)
        own = table.filter(pc.is_valid(table.column("texts"))).combine_chunks()
        ids, texts = (own.column(c).chunk(0).flatten() for c in ("ids", "texts"))
        single = Found(keys[order], level[order].astype(np.int64))
        return pa.Table.from_batches([_asks(table.column("part")[0].as_py(), ids, text_bytes(texts), shared.value, single, schema)])

    first = rows.mapInArrow(tokens, f"bucket int, part long, level int, data binary, ids array<{id}>, texts array<string>")
    return _answered(first, model.filters, 1, _single_levels).groupBy("part").applyInArrow(then, asked)


def score(docs: DataFrame, model: Model, id: Column | str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each row; scores are log10."""
    key = F.col(id) if isinstance(id, str) else id
    rows = docs.select(key.alias("id"), F.col(text).cast("string").alias("text"))
    numbers = model._replace(counts=None, filters=None, single=None, frequent=None, frequent_counts=None)

    def summed(table: pa.Table) -> pa.Table:
        heads = next(h for h in table.column("heads").to_pylist() if h is not None)
        total = np.zeros(len(heads))
        for data in table.column("data").to_pylist():
            steps, level, own, before, times = _opened(data, np.uint16, np.uint8, np.uint8, np.uint8, np.uint32)
            chance = np.log10(chances(numbers, level, own, before))
            total += np.bincount(np.cumsum(steps, dtype=np.uint16), times * chance, len(heads))
        part = table.column("part")[0].as_py()
        rows = [h | {"row": (part << 16) + i, "score": float(x)} for i, (h, x) in enumerate(zip(heads, total))]
        return pa.Table.from_pylist(rows, schema)

    asked = _asked(rows, model)
    kind = f"id {rows.schema['id'].dataType.simpleString()}, row long, n_tokens long, n_known long, base double, score double, rest array<long>"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], kind).schema)
    scored = _answered(asked, model.filters, 2, _pair_levels).groupBy("part").applyInArrow(summed, kind)
    if not model.complete:
        scored = cut(scored, "scores")
        rest = scored.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count(F.lit(1)).alias("times"))
        rare = rest.join(model.counts, "h").groupBy("row").agg(
            F.sum("times").alias("found"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more")
        )
        scored = scored.join(rare, "row", "left").withColumns({
            "n_known": F.col("n_known") + F.coalesce("found", F.lit(0)),
            "base": F.col("base") + F.coalesce("more", F.lit(0.0)),
        })
    return scored.select("id", "n_tokens", "n_known", F.col("base").alias("base_score"), "score")
