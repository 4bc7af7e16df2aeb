"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: words are split at ASCII white space after lower-casing A-Z; each
run of three words is hashed with XXH64 (seed 42); a bit is set if it is set in
over half of the hashes.

Comparison: equal fingerprints are folded first. A *tile* holds the fingerprints
with the same four population counts, one per 16-bit quarter. One differing bit
moves one of the counts by one, so two fingerprints within the radius lie in
tiles whose counts differ by at most the radius in sum: all other pairs of tiles
are skipped and nothing is lost. A tile larger than ``TILE_ROWS`` is cut into
chunks by a hash, so one pair of chunks is the unit of work: it keeps the rows
of its own chunk in memory and streams the rows of the others past it, with
numpy's exclusive-or and bit counts. Instead of all pairs a unit returns the
links of a spanning forest, at most one for each row it has read; components are
then found by star contraction.

Defined results: null and empty texts, and texts without words, have fingerprint
zero and link like any other; fewer than three words are one shingle. Repeated
rows have the same component. Ids may repeat or be null: a component's id is the
smallest that is not null, or null if there is none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.components import components
from matchspark.llm.text import fresh, slices, text_bytes
from matchspark.session import cut

WORDS, SEED, RADIUS = 3, 42, 3
BANDS = 4
TILE_ROWS = 4096
#: Pairs that numpy compares at once: the working set stays in a core's cache.
BLOCK_PAIRS = 1 << 17
#: Shingles whose bits are unpacked at once.
BLOCK_SHINGLES = 1 << 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in cuts), np.uint64, len(found) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK_SHINGLES):
        block = hashes[at : at + BLOCK_SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp): a signed 64-bit fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, words) for t in text_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _counts(fp) -> list:
    width = 64 // BANDS
    return [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND((1 << width) - 1)) for i in range(BANDS)]


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Steps from a tile to those within the radius, of each two opposite steps the later one, and no step."""
    reach = itertools.product(range(-radius, radius + 1), repeat=BANDS)
    return [s for s in reach if sum(map(abs, s)) <= radius and s >= (0,) * BANDS]


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Compare each unit's own rows with each other and with its guests. Rows come by unit, own rows first."""

    def links(a: list, b: list) -> pa.RecordBatch:
        ends = [np.array(x, dtype=np.uint64).view(np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    unit, own, waiting, label = None, np.empty(0, np.uint64), [], np.empty(0, np.int64)

    def joined(guests: np.ndarray, inside: bool) -> pa.RecordBatch:
        """Links of guests to own rows, or among these, that connect what was not connected yet."""
        a, b = [], []
        step = max(1, BLOCK_PAIRS // max(len(own), 1))
        for at in range(0, len(guests), step):
            near = np.bitwise_count(np.bitwise_xor.outer(guests[at : at + step], own)) <= radius
            i, j = np.nonzero(near)
            # of the own rows that a guest is close to, one for each component so far
            _, one = np.unique(i * len(own) + label[j], return_index=True)
            first: dict[int, int] = {}
            for x, y in zip(i[one].tolist(), j[one].tolist()):
                old = label[at + x] if inside else label[first.setdefault(x, y)]
                new = label[y]
                if old != new:
                    label[label == max(old, new)] = min(old, new)
                elif inside or first[x] != y:
                    continue
                a.append(guests[at + x])
                b.append(own[y])
        return links(a, b)

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal own, waiting, label
        if waiting:
            own, waiting = np.concatenate(waiting), []
            label = np.arange(len(own))
            yield joined(own, True)

    for batch in batches:
        units = np.column_stack([np.asarray(batch.column(k)) for k in (0, 1)])
        fps, home = np.asarray(batch.column(3)).view(np.uint64), np.asarray(batch.column(2))
        edges = np.flatnonzero(np.any(np.diff(units, axis=0), axis=1)) + 1 if len(units) else []
        for start, end in itertools.pairwise([0, *edges, len(units)]):
            if start == end:
                continue
            here = tuple(units[start])
            if here != unit:
                yield from settle()
                unit, own, waiting = here, np.empty(0, np.uint64), []
            mine = home[start:end] == 0
            if mine.any():
                waiting.append(fps[start:end][mine])
            if not mine.all():
                yield from settle()
                if len(own):
                    yield joined(fps[start:end][~mine], False)
    yield from settle()


def near_links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``fp`` as all pairs within the radius do."""
    counts = _counts(F.col("fp"))
    key = sum((c.cast("long") * 100**i for i, c in enumerate(counts)), F.lit(0).cast("long"))
    rows = distinct.select("fp", *[c.alias(f"c{i}") for i, c in enumerate(counts)], key.alias("tile"))
    # at most 17 ** 4 = 83,521 tiles exist: small enough for every task
    tiles = rows.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("chunks"))
    tiles = F.broadcast(tiles)
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    rows = rows.join(tiles, "tile").withColumn("chunk", chunk).drop("chunks")
    steps = F.array(*[F.lit(sum(x * 100**i for i, x in enumerate(s))).cast("long") for s in _neighbours(radius)])
    sent = rows.select("fp", "tile", "chunk", F.explode(steps).alias("step"))
    sent = sent.withColumn("to", F.col("tile") + F.col("step"))
    sent = sent.join(tiles.withColumnRenamed("tile", "to"), "to")
    last = F.when(F.col("step") == 0, F.col("chunk")).otherwise(F.col("chunks") - 1)
    sent = sent.select("to", F.explode(F.sequence(F.lit(0), last)).alias("part"), "fp", "step", "chunk")
    guest = F.when((F.col("step") == 0) & (F.col("chunk") == F.col("part")), 0).otherwise(1).alias("guest")
    units = sent.select("to", "part", guest, "fp").repartition("to", "part").sortWithinPartitions("to", "part", "guest")
    return units.mapInArrow(lambda batches: _forest(batches, radius), "a long, b long")


def near_components(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): every row, with the smallest id that links reach."""
    rows = cut(fingerprints(docs, id, text, words), "fingerprints")
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    named = components(near_links(distinct, radius)).withColumnRenamed("node", "fp")
    named = distinct.join(named, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    groups = named.groupBy("group").agg(F.min("least").alias("component"))
    found = named.join(groups, "group").select("fp", "component")
    return rows.join(found, "fp").select("id", "fp", "component")


def keep(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component, that of the smallest id, with all columns of ``docs``."""
    stays = near_components(docs, id, text, words, radius).filter("id <=> component").select("id").distinct()
    i = fresh(docs, "near_id")
    stays = stays.withColumnRenamed("id", i)
    kept = docs.join(stays, F.col(id).eqNullSafe(F.col(i)), "left_semi")
    return kept
