"""Ordered per-entity series that stay balanced when one entity owns a third of the rows.

A plain ``Window.partitionBy(entity)`` puts all rows of an entity in one task.
Two forms replace it, both exact:

* :func:`running` (unbounded frames) cuts an entity's rows into *blocks* by a
  monotone expression of the order (a day, an hour, a range of line numbers).
  It folds inside each block, folds block totals per entity, and joins the
  carried-in value back. Per entity only one row per block meets in one task.
* :func:`form` cuts by row number into chunks of fixed length. For bounded frames
  the last rows of a chunk are shown to the next chunk as well, so a frame of ``w``
  rows always finds its predecessors: no group exceeds chunk + reach rows.
  Exponentially weighted means carry the folded state of a chunk to the next.

Entity and order columns must not be null, and the order must be unique within
an entity, so results do not depend on input order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from matchspark.session import cut

BLOCK, CHUNK, POS = "__block", "__chunk", "__pos"
CHUNK_ROWS = 2048


class Running(NamedTuple):
    """How one running measure folds rows, folds block totals and joins both."""

    rows: Callable[[WindowSpec], Column]
    total: Callable[[Column], Column]
    blocks: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]


def _plus(before: Column, here: Column) -> Column:
    return F.coalesce(before + here, before, here)


def _count(value: Column) -> Running:
    return Running(
        lambda w: F.count(value).over(w),
        lambda order: F.count(value),
        lambda total, w: F.sum(total).over(w),
        lambda before, here: F.coalesce(before, F.lit(0)) + here,
    )


def rows_before() -> Running:
    return _count(F.lit(1))


def count_of(value: Column) -> Running:
    return _count(value)


def sum_of(value: Column) -> Running:
    return Running(
        lambda w: F.sum(value).over(w),
        lambda order: F.sum(value),
        lambda total, w: F.sum(total).over(w),
        _plus,
    )


def max_of(value: Column) -> Running:
    return Running(
        lambda w: F.max(value).over(w),
        lambda order: F.max(value),
        lambda total, w: F.max(total).over(w),
        lambda before, here: F.greatest(before, here),
    )


def last_of(value: Column) -> Running:
    """Latest non-null value: carry-forward."""
    return Running(
        lambda w: F.last(value, ignorenulls=True).over(w),
        lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        lambda total, w: F.last(total, ignorenulls=True).over(w),
        lambda before, here: F.coalesce(here, before),
    )


def running(
    df: DataFrame,
    entity: Sequence[str],
    order: Sequence[str],
    block: Column,
    measures: dict[str, Running],
    inclusive: bool = False,
) -> DataFrame:
    """Add running measures over all earlier rows of the entity (and the row itself if ``inclusive``)."""
    marked = df.withColumn(BLOCK, block)
    keys = [*entity, BLOCK]
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    earlier = Window.partitionBy(*entity).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)
    totals = marked.groupBy(*keys).agg(*[m.total(position).alias(f"__t_{n}") for n, m in measures.items()])
    carried = totals.select(
        *keys, *[m.blocks(F.col(f"__t_{n}"), earlier).alias(f"__c_{n}") for n, m in measures.items()]
    )
    here = marked.select("*", *[m.rows(inside).alias(f"__l_{n}") for n, m in measures.items()])
    return here.join(carried, keys, "left").select(
        *[F.col(f"`{c}`") for c in df.columns if c not in measures],
        *[m.merge(F.col(f"__c_{n}"), F.col(f"__l_{n}")).alias(n) for n, m in measures.items()],
    )


def number(df: DataFrame, entity: Sequence[str], order: Sequence[str], block: Column, name: str = "seq") -> DataFrame:
    """0-based row number per entity."""
    return running(df, entity, order, block, {name: rows_before()})


class Trailing(NamedTuple):
    """A bounded frame: how many rows back it reaches and its window expression."""

    reach: int
    build: Callable[[WindowSpec], Column]


def trailing_mean(column: str, width: int, inclusive: bool = False) -> Trailing:
    return _trailing(F.avg, column, width, inclusive)


def trailing_sum(column: str, width: int, inclusive: bool = False) -> Trailing:
    return _trailing(F.sum, column, width, inclusive)


def _trailing(fold, column: str, width: int, inclusive: bool) -> Trailing:
    first, last = (1 - width, 0) if inclusive else (-width, -1)
    return Trailing(-first, lambda w: fold(F.col(column)).over(w.rowsBetween(first, last)))


def tail_weighted_mean(column: str, width: int) -> Trailing:
    """Exponentially weighted mean of the last ``width`` rows only, current row included."""
    q = 1.0 - 2.0 / (width + 1)

    def build(w: WindowSpec) -> Column:
        past = [F.lag(column, k).over(w) if k else F.col(column) for k in range(width)]
        weighted = sum((F.coalesce(x * F.lit(q**k), F.lit(0.0)) for k, x in enumerate(past)), F.lit(0.0))
        weight = sum((F.when(x.isNotNull(), q**k).otherwise(0.0) for k, x in enumerate(past)), F.lit(0.0))
        return weighted / F.nullif(weight, F.lit(0.0))

    return Trailing(width - 1, build)


def form(
    df: DataFrame,
    entity: Sequence[str],
    seq: str,
    trailing: dict[str, Trailing] | None = None,
    weighted: dict[str, tuple[str, int]] | None = None,
    chunk: int | None = None,
) -> DataFrame:
    """Features over the row numbering ``seq`` (0-based, without gaps).

    ``trailing`` maps an output name to a bounded frame: one shuffle, one sort.
    ``weighted`` maps an output name to ``(column, span)``: the exponentially
    weighted mean of all earlier rows, where a null keeps its place and only ages
    the others; see :func:`_weighted`. Both are folded in the same chunks, after the same shuffle and sort.
    """
    trailing, weighted = trailing or {}, weighted or {}
    if weighted and chunk is None:
        chunk = _weighted_chunk(weighted)
        # frames that reach far would be shown to many chunks this small
        frames_chunk = chunk if all(4 * t.reach <= chunk for t in trailing.values()) else None
    else:
        frames_chunk = chunk
    out = _frames(df, entity, seq, trailing, frames_chunk) if trailing else df
    if weighted and frames_chunk == chunk:
        return _weighted(out, entity, seq, weighted, chunk)
    out = out.select(*[F.col(f"`{c}`") for c in df.columns], *trailing)
    return _weighted(out, entity, seq, weighted, chunk) if weighted else out


def _frames(df: DataFrame, entity: Sequence[str], seq: str, trailing: dict[str, Trailing], chunk: int | None) -> DataFrame:
    """Bounded frames; rows keep their ``CHUNK``."""
    reach = max(t.reach for t in trailing.values())
    chunk = chunk or max(CHUNK_ROWS, reach)
    keys = [*entity, CHUNK]
    own = F.floor(F.col(seq) / chunk)
    # a row is shown to its own chunk and to the later ones it can reach
    last = F.floor((F.col(seq) + reach) / chunk)
    shown = df.select("*", F.explode(F.sequence(own, last)).alias(CHUNK)).withColumn(
        POS, F.col(seq) - F.col(CHUNK) * chunk
    )
    ordered = Window.partitionBy(*keys).orderBy(seq)
    folds = [t.build(ordered).alias(n) for n, t in trailing.items()]
    return shown.select("*", *folds).filter(F.col(POS) >= 0).select(*[F.col(f"`{c}`") for c in df.columns], *trailing, CHUNK)


def _weighted(
    df: DataFrame, entity: Sequence[str], seq: str, weighted: dict[str, tuple[str, int]], chunk: int
) -> DataFrame:
    """Exponentially weighted means, as ratios of two geometric running sums.

    Inside a chunk each row is lifted by ``q ** -position``. What earlier chunks leave is
    the sum of the last one that has values and of the chunks before it that are within a
    weight of 1e-16 of it: counted from the newest value, not from the row, so a run of nulls
    of any length carries the mean forward.
    """
    keys = [*entity, CHUNK]
    placed = df if CHUNK in df.columns else df.withColumn(CHUNK, F.floor(F.col(seq) / chunk))
    position = F.col(seq) - F.col(CHUNK) * chunk
    before = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    by_chunk = Window.partitionBy(*entity).orderBy(CHUNK)
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    sums, folds, states, carried, merged = [], [], [], [], {}
    for i, (name, (column, span)) in enumerate(weighted.items()):
        q = _decay(span)
        lift = F.pow(F.lit(q), -position)
        parts = {"t": F.col(column) * lift, "b": F.when(F.col(column).isNotNull(), lift)}
        sums += [F.sum(v).alias(f"__{k}{i}") for k, v in parts.items()]
        folds += [F.sum(v).over(before).alias(f"__{k}l{i}") for k, v in parts.items()]
        fade = math.exp(chunk * math.log(q))
        depth = math.ceil(_memory(span) / chunk)

        def faded(part: str, i: int = i, fade: float = fade, depth: int = depth) -> Column:
            past = [F.lag(f"__{part}{i}", d).over(by_chunk) * F.lit(fade**d) for d in range(1, depth + 1)]
            return sum((F.coalesce(x, F.lit(0.0)) for x in past), F.col(f"__{part}{i}"))

        state = F.struct(faded("t").alias("t"), faded("b").alias("b"), F.col(CHUNK).alias("at"))
        states.append(F.when(F.col(f"__b{i}").isNotNull(), state).alias(f"__s{i}"))
        carried.append(F.last(f"__s{i}", ignorenulls=True).over(earlier).alias(f"__c{i}"))
        # past e ** -650, about the least a double holds, what was left keeps a weight that any new value drowns
        age = (F.col(CHUNK) - F.col(f"__c{i}.at")) * (chunk * -math.log(q))
        weight = F.when(age < 650, F.col(f"__c{i}.b") * F.exp(-age)).otherwise(F.lit(1e-200))
        weight = F.when(F.col(f"__c{i}.b").isNotNull(), weight)
        old = F.col(f"__c{i}.t") / F.col(f"__c{i}.b") * weight
        top, bottom = (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)) for x, y in ((old, f"__tl{i}"), (weight, f"__bl{i}")))
        merged[name] = (top / F.nullif(bottom, F.lit(0.0))).alias(name)
    totals = placed.groupBy(*keys).agg(*sums)
    left = totals.select(*keys, *states).select(*keys, *carried)
    here = placed.select("*", *folds)
    return here.join(left, keys, "left").select(*[F.col(f"`{c}`") for c in df.columns if c != CHUNK], *merged.values())


def _weighted_chunk(weighted: dict[str, tuple[str, int]]) -> int:
    """Rows over which doubles hold the lift of the fastest decay."""
    if any(span < 2 for _, span in weighted.values()):
        raise ValueError("span must be at least 2")
    return min([CHUNK_ROWS, *[int(600 / -math.log(_decay(s))) for _, s in weighted.values()]])


def _decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1)


def _memory(span: int) -> int:
    """Rows after which a weight has fallen below 1e-16."""
    return math.ceil(37.0 / -math.log(_decay(span)))


def latest(df: DataFrame, entity: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Newest row per entity; the maximum is folded before the shuffle."""
    newest = F.max_by(F.struct(*keep), F.struct(*order)).alias("__row")
    return df.groupBy(*entity).agg(newest).select(*entity, "__row.*")


def dedupe(df: DataFrame, key: Sequence[str], order: Sequence[Column], keep: str = "first") -> DataFrame:
    """One row per key, first or last by ``order``.

    Spark limits each group before the shuffle (row_number = 1), so a hot key
    sends one row per map task.
    """
    ranked = [c.desc_nulls_last() for c in order] if keep == "last" else [c.asc_nulls_last() for c in order]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*ranked))
    return df.withColumn("__rn", first).filter(F.col("__rn") == 1).drop("__rn")


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Place of each row in the order of the whole table, from 1, without one task that sees all rows.

    Rows are dealt out by ranges of the order and sorted there; a row's number in its part is added to the rows of the
    parts before. The order must be unique for places to be fixed. The result is written once, in order part by part.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(parts.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33).alias("__part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("__rows"))  # one row for each part
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("__part", part).join(offsets, "__part")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (inside + F.col("__before") + 1).alias(name))


def last_rows(df: DataFrame, entity: Sequence[str], order: Sequence[Column], n: int, name: str = "recency") -> DataFrame:
    """The last ``n`` rows of each entity, limited before the shuffle."""
    # a hash first: rows are then sorted by one number that tells nearly all entities apart
    recency = F.row_number().over(Window.partitionBy(F.xxhash64(*entity), *entity).orderBy(*[c.desc() for c in order]))
    return df.withColumn(name, recency).filter(F.col(name) <= n)
