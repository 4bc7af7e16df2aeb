"""Licence scan by ordered signature rules.

A text is brought to normal form (see :mod:`license_rules`) in one pass over its
bytes. Its words open gates; only rules behind an open gate are run, so a text
without such words costs no regular expression. Detections are word intervals.
One is suppressed if another covers it that has a higher priority, or the same
priority and a longer interval, or an equal interval and an earlier rule.

The base phrases are always found, whatever the rules say.

Defined results: a null or empty text has no words and no detections, empty
labels and score 0; rows are scanned one by one, so repeats repeat; ids may be null;
other columns play no part.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm import license_rules
from matchspark.llm.text import slices, text_bytes

_TABLE = bytes(
    b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)
SPAN = pa.struct([
    ("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
])
SPAN_SQL = "array<struct<label: string, rule: int, priority: int, start: bigint, end: bigint>>"
BASE_CONFIDENCE = 0.8


@functools.lru_cache(maxsize=1)
def _gated() -> tuple[list, dict[bytes, list[int]]]:
    rules, gates = license_rules.rules(), defaultdict(list)
    for at, rule in enumerate(rules):
        gates[rule.gate].append(at)
    return rules, dict(gates)


@functools.lru_cache(maxsize=1)
def _base() -> list[tuple[bytes, frozenset, str]]:
    return [(f" {p} ".encode(), frozenset(p.encode().split()), label) for p, label in license_rules.BASE.items()]


def suppressed(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (start, end, priority, rule) that no other span of precedence covers, in order of start."""
    kept, reach = [], defaultdict(int)
    # whatever covers a span comes before it; of equal intervals the one of precedence
    for span in sorted(set(spans), key=lambda s: (s[0], -s[1], -s[2], s[3])):
        _, end, priority, _ = span
        if any(reach[p] >= end for p in reach if p >= priority):
            continue
        kept.append(span)
        reach[priority] = max(reach[priority], end)
    return kept


def scan_text(text: bytes) -> tuple:
    """(words, base places, first, last, base labels, spans, score)."""
    words = text.translate(_TABLE).split()
    rules, gates = _gated()
    opened = gates.keys() & words if len(words) < len(gates) else gates.keys() & set(words)
    if not opened:
        return len(words), 0, None, None, [], [], 0.0
    normal = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    spans = []
    for at in sorted(i for g in opened for i in gates[g]):
        rule = rules[at]
        for m in rule.pattern.finditer(normal):
            start, end = np.searchsorted(spaces, [m.start(), m.end()])
            spans.append((int(start), int(end) + 1, rule.priority, at))
    places, labels, framed, known = [], set(), b" " + normal + b" ", set(words)
    for phrase, needed, label in _base():
        if needed <= known:
            at = framed.find(phrase)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = framed.find(phrase, at + len(phrase) - 1)
    # in the framed text a place is the space before the word
    starts = np.searchsorted(spaces, np.array(sorted(places), np.int64))
    spans = suppressed(spans)
    score = max([BASE_CONFIDENCE if places else 0.0, *(rules[s[3]].confidence for s in spans)])
    first, last = (int(starts[0]), int(starts[-1])) if places else (None, None)
    return len(words), len(places), first, last, sorted(labels), spans, score


def scan(docs: DataFrame, id: Column | str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, detections, score) of each row.

    ``detections`` are the spans that stand: label, rule, priority, first word, word after the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, _ = _gated()
        for batch in slices(batches):
            found = [scan_text(t) for t in text_bytes(batch.column(1))]
            columns = list(zip(*found))
            spans = [[(rules[r].label, r, p, a, b) for a, b, p, r in row] for row in columns[5]]
            spans = [[dict(zip(("label", "rule", "priority", "start", "end"), s)) for s in row] for row in spans]
            numbers = [pa.array(columns[i], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *numbers, pa.array(columns[4], pa.list_(pa.string())), pa.array(spans, pa.list_(SPAN)), pa.array(columns[6], pa.float64())],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "score"],
            )

    key = F.col(id) if isinstance(id, str) else id
    rows = docs.select(key.alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
        f"detections {SPAN_SQL}, score double",
    )
