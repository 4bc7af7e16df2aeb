"""Packing token sequences by best-fit decreasing over the whole corpus.

Every document is cut into full windows and one shorter rest. What best-fit
decreasing does depends only on how many pieces of each length there are, at
most ``window`` numbers, so only these are gathered: the plan is made once for
all pieces, longest first, with windows in the same state held together as one
class and a segment tree over remaining capacity to find the tightest open one.
The plan has a few entries for each length, whatever the size of the corpus.
Pieces are then numbered within their length, in parallel, and each looks up its
place in the plan by length and number.

Defined results: a null or empty text is the end token alone; a document of
exactly k windows has no rest; an empty table gives no rows; repeated rows and
ids are packed row by row; other columns play no part. The order of pieces of
equal length is that of the partitions.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.text import slices
from matchspark.session import cut

WINDOW, END = 2048, 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """Text to ids, as the tokenizer in ``path`` gives them without special tokens around the text.

    A byte-level BPE file is run by tiktoken with the ranks that the file's vocabulary holds:
    the same ids at five times the speed. Texts that spell an added token, and those tiktoken
    refuses, go through the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec.get("added_tokens", [])]
    # printable stand-ins of the 256 bytes in byte-level vocabularies: printable ones stand for themselves
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    del spec, ranks

    @functools.lru_cache(maxsize=1)
    def slow() -> Tokenizer:
        return Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if not any(a in text for a in added):
            try:
                return fast.encode_ordinary(text)
            except (ValueError, RuntimeError):
                pass
        return slow().encode(text, add_special_tokens=False).ids

    return encode


def pieces(docs: DataFrame, id: str, text: str, window: int, tokenizer: str) -> DataFrame:
    """(id, start, length, crc, total, part, nth): pieces, numbered within partition and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, dtype=np.int64)
        for batch in slices(batches):
            row, start, length, crc, total, nth = [], [], [], [], [], []
            for r, value in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(value or ""), END], dtype="<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    row.append(r)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    nth.append(seen[len(piece)])
                    seen[len(piece)] += 1
            same = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            numbered = [pa.array([part] * len(row), pa.int64()), pa.array(nth, pa.int64())]
            own = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *same, *numbered], ["id", "start", "length", "crc", "total", "part", "nth"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, start long, length long, crc long, total long, part long, nth long")


class CapacityTree:
    """Numbers of open windows by remaining capacity; finds the least capacity that is enough."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, count: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += count
            node //= 2

    def tightest(self, need: int) -> int | None:
        """Least capacity of at least ``need`` with an open window."""
        node = need + self.leaves
        if self.tree[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> tuple[np.ndarray, int]:
    """Plan for ``counts[length]`` pieces of each length.

    Returns rows (length, first number, pieces per window, first window, offset in it), ordered by
    length and number, and how many windows there are. A row's pieces fill equal windows one after the other.
    """
    tree = CapacityTree(window)
    classes: dict[int, list[tuple[tuple, int]]] = {}  # remaining capacity: (runs of (length, pieces), windows)

    def put(runs: tuple, windows: int) -> None:
        left = window - sum(n * k for n, k in runs)
        classes.setdefault(left, []).append((runs, windows))
        if left:
            tree.add(left, windows)

    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        rest = counts[n]
        while rest:
            left = tree.tightest(n)
            if left is None:
                runs, open_ = (), -(-rest // (window // n))
                left = window
            else:
                runs, open_ = classes[left].pop(0)
                tree.add(left, -open_)
            each = left // n
            full = min(open_, rest // each)
            if full:
                put((*runs, (n, each)), full)
                rest -= full * each
                open_ -= full
            if open_ and rest and rest < each:
                put((*runs, (n, rest)), 1)
                rest, open_ = 0, open_ - 1
            if open_ and runs:
                classes.setdefault(left, []).insert(0, (runs, open_))
                tree.add(left, open_)
    number, base, rows = dict.fromkeys(counts, 0), 0, []
    for left in sorted(classes):
        for runs, windows in classes[left]:
            offset = 0
            for n, each in runs:
                rows.append((n, number[n], each, base, offset))
                number[n] += each * windows
                offset += n * each
            base += windows
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), base


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """(id, start, length, crc, total, sequence, offset): where each piece of each document lies.

    ``total`` counts the document's ids with the end token; ``crc`` is CRC-32 of the piece's ids as
    little-endian 32-bit numbers; sequences are numbered from 0. The tokenizer file must be at the same
    path on every worker.
    """
    cuts = cut(pieces(docs, id, text, window, tokenizer or default_tokenizer()), "pieces")
    counted = cuts.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit_decreasing(counts, window)
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # a few rows for each of at most `window` lengths
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = cuts.join(before, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        scale = int(rows[:, 1].max(initial=0)) + 1
        keys = rows[:, 0] * scale + rows[:, 1]
        for batch in batches:
            n, nth = np.asarray(batch.column(2)), np.asarray(batch.column(5))
            at = np.searchsorted(keys, n * scale + np.minimum(nth, scale - 1), "right") - 1
            past = nth - rows[at, 1]
            sequence = rows[at, 3] + past // rows[at, 2]
            offset = rows[at, 4] + past % rows[at, 2] * n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["id", "start", "length", "crc", "total", "sequence", "offset"],
            )

    kind = cuts.schema["id"].dataType.simpleString()
    out = f"id {kind}, start long, length long, crc long, total long, sequence long, offset long"
    return numbered.select("id", "start", "length", "crc", "total", "nth").mapInArrow(place, out)


def sequences(
    docs: DataFrame, placed: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW,
    pad: int = 0, tokenizer: str | None = None,
) -> DataFrame:
    """(sequence, ids, used): the packed sequences of documents with unique ids that are not null.

    ``ids`` are padded to the window, except where the used length is a power of two.
    """
    path = tokenizer or default_tokenizer()

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches):
            ids = [np.array([*encode(t or ""), END]) for t in batch.column(1).to_pylist()]
            cuts = [(r, at, x[at : at + window]) for r, x in enumerate(ids) for at in range(0, len(x), window)]
            own = batch.column(0).take(pa.array([c[0] for c in cuts], pa.int64()))
            tokens = pa.array([c[2] for c in cuts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([own, pa.array([c[1] for c in cuts], pa.int64()), tokens], ["id", "start", "ids"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    tokens = rows.mapInArrow(ids_of, f"id {kind}, start long, ids array<int>")
    whole = tokens.join(placed, ["id", "start"]).groupBy("sequence").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("used")
    )
    ids = F.flatten(F.col("parts.ids"))
    bare = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    padded = F.when(bare, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad), (window - F.col("used")).cast("int"))))
    return whole.select("sequence", padded.alias("ids"), "used")
