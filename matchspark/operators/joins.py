"""As-of, interval, priority and lookup joins without range joins or cross products."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators import sequences
from matchspark.session import cut


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    block: Callable[[Column], Column] | None,
    strict: bool = False,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Latest right row at or before (``strict``: before) each left row's time.

    Both sides are put in one ordered series and the right row is carried
    forward. ``block`` maps a time to its block (see :func:`sequences.running`);
    ``tie`` orders right rows of one time, the last one wins. Times that are their
    own blocks, as days are, need none: see :func:`_asof_days`.
    """
    if block is None:
        return _asof_days(left, right, by, left_time, right_time, values, strict, tie)
    before, after = (1, 0) if strict else (0, 1)
    asked = left.withColumns({"__t": F.col(left_time), "__kind": F.lit(after)})
    known = right.dropna(subset=list(by)).select(
        *by,
        F.col(right_time).alias("__t"),
        F.lit(before).alias("__kind"),
        F.struct(F.lit(1).alias("__one"), *tie).alias("__tie"),
        F.struct(*[F.col(v).alias(v) for v in values]).alias("__row"),
    )
    both = asked.unionByName(known, allowMissingColumns=True)
    carry = {"__match": sequences.last_of(F.col("__row"))}
    order = ["__t", "__kind", "__tie"]
    ran = sequences.running(both, by, order, block(F.col("__t")), carry, inclusive=True)
    found = ran.filter(F.col("__kind") == after)
    return found.select(*left.columns, *[F.col(f"__match.{v}").alias(v) for v in values])


def _asof_days(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], strict: bool, tie: Sequence[str]
) -> DataFrame:
    """As-of join over days: only one row for each day of either side is put in order, then left rows look up their day.

    Right rows are folded to the last of each day before they are shuffled; the left ones' days are, too. A null day is the first.
    """
    known = right.dropna(subset=list(by)).select(
        *by, F.col(right_time).alias("__t"), F.struct(*[F.col(v).alias(v) for v in values]).alias("__row"), F.struct(F.lit(1).alias("__one"), *tie).alias("__tie")
    )
    if tie:
        known = known.groupBy(*by, "__t").agg(F.max_by("__row", "__tie").alias("__row"))
    before, after = (1, 0) if strict else (0, 1)
    days = left.select(*by, F.col(left_time).alias("__t")).distinct().withColumn("__kind", F.lit(after))
    series = days.unionByName(known.select(*by, "__t", "__row", F.lit(before).alias("__kind")), allowMissingColumns=True)
    down = Window.partitionBy(*by).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    ran = series.select(*by, "__t", "__kind", F.last("__row", ignorenulls=True).over(down).alias("__match"))
    carried = ran.filter(F.col("__kind") == after).select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], "__t", "__match")
    same = [F.col(c) == F.col(f"__by{i}") for i, c in enumerate(by)] + [F.col(left_time).eqNullSafe(F.col("__t"))]
    found = left.join(carried, reduce(Column.__and__, same), "left")
    return found.select(*left.columns, *[F.col(f"__match.{v}").alias(v) for v in values])


def interval_sums(
    left: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    left_time: str,
    event_time: str,
    start: Column,
    measures: dict[str, Column],
    block: Callable[[Column], Column] | None,
) -> DataFrame:
    """Sums over the events of ``by`` with ``start <= event_time <= left_time``, per left ``key``; 0 without any.

    Each left row asks twice for the running sum, at both ends of its interval,
    and takes the difference: work grows with rows, not with matching pairs.
    Times that are their own blocks, as days are, need no ``block``: see :func:`_interval_days`.
    """
    if block is None:
        return _interval_days(left, events, by, key, left_time, event_time, start, measures)
    ends = F.array(
        F.struct(start.alias("__t"), F.lit(0).alias("__kind")),
        F.struct(F.col(left_time).alias("__t"), F.lit(2).alias("__kind")),
    )
    asked = left.select(*by, *[k for k in key if k not in by], F.inline(ends))
    happened = events.select(
        *by,
        F.col(event_time).alias("__t"),
        F.lit(1).alias("__kind"),
        *[v.alias(f"__v_{n}") for n, v in measures.items()],
    )
    both = asked.unionByName(happened, allowMissingColumns=True)
    sums = {n: sequences.sum_of(F.col(f"__v_{n}")) for n in measures}
    ran = sequences.running(both, by, ["__t", "__kind"], block(F.col("__t")), sums, inclusive=True)
    signed = {n: F.coalesce(F.col(n), F.lit(0)) * F.when(F.col("__kind") == 2, 1).otherwise(-1) for n in measures}
    return (
        ran.filter(F.col("__kind") != 1).groupBy(*key).agg(*[F.sum(v).alias(n) for n, v in signed.items()])
    )


def _interval_days(
    left: DataFrame, events: DataFrame, by: Sequence[str], key: Sequence[str], left_time: str, event_time: str, start: Column, measures: dict[str, Column]
) -> DataFrame:
    """Interval sums over days: events are folded by day and asked days listed once before a shuffle, and only days are put in order.

    Left rows then look up the running sums of both ends. A null day is the first.
    """
    happened = events.select(*by, F.col(event_time).alias("__t"), *[v.alias(f"__v_{n}") for n, v in measures.items()])
    known = happened.groupBy(*by, "__t").agg(*[F.sum(f"__v_{n}").alias(f"__v_{n}") for n in measures]).withColumn("__kind", F.lit(1))
    asked = left.select(*by, *[k for k in key if k not in by], start.alias("__t0"), F.col(left_time).alias("__t2"))
    ends = F.array(*[F.struct(F.col(f"__t{k}").alias("__t"), F.lit(k).alias("__kind")) for k in (0, 2)])
    series = asked.select(*by, F.inline(ends)).distinct().unionByName(known, allowMissingColumns=True)
    down = Window.partitionBy(*by).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(f"__v_{n}").over(down).alias(f"__s_{n}") for n in measures]
    ran = cut(series.select(*by, "__t", "__kind", *sums).filter(F.col("__kind") != 1), "day-sums")  # looked up twice
    for k in (0, 2):
        there = ran.filter(F.col("__kind") == k).select(
            *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], "__t", *[F.col(f"__s_{n}").alias(f"__{k}_{n}") for n in measures]
        )
        same = [F.col(c) == F.col(f"__by{i}") for i, c in enumerate(by)] + [F.col(f"__t{k}").eqNullSafe(F.col("__t"))]
        asked = asked.join(there, reduce(Column.__and__, same), "left").drop("__t", *[f"__by{i}" for i in range(len(by))])
    between = {n: F.coalesce(f"__2_{n}", F.lit(0)) - F.coalesce(f"__0_{n}", F.lit(0)) for n in measures}
    return asked.groupBy(*key).agg(*[F.sum(v).alias(n) for n, v in between.items()])


def trailing_priority(
    rows: DataFrame,
    team: str,
    group: str,
    priority: Sequence[str],
    order: Sequence[Column],
    features: Sequence[str],
    n: int = 5,
    minimum: int = 3,
) -> DataFrame:
    """Mean of a team's last ``n`` rows in the first listed group holding at least ``minimum`` of them."""
    if minimum > n:
        raise ValueError("minimum must not exceed n")
    ranks = F.create_map(*[F.lit(x) for pair in zip(priority, range(len(priority))) for x in pair])
    recent = sequences.last_rows(rows.filter(F.col(group).isin(*priority)), [group, team], order, n)
    means = recent.groupBy(group, team).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.coalesce(F.avg(f), F.lit(0.0)).alias(f) for f in features],
    )
    best = F.min_by(F.struct(group, *features), ranks[F.col(group)]).alias("__best")
    return means.filter(F.col("__n") >= minimum).groupBy(team).agg(best).select(team, "__best.*")


def unique_dimension(dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The dimension itself, failing at run time if a key occurs twice."""
    values = [c for c in dimension.columns if c not in keys]
    one = dimension.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in values])
    message = F.lit(f"duplicate key in dimension: {', '.join(keys)}")
    return one.filter(F.assert_true(F.col("__n") == 1, message).isNull()).drop("__n")


def lookup(
    df: DataFrame,
    dimension: DataFrame,
    key: str,
    sides: Sequence[str] = ("home", "away"),
    prefix: str = "",
    team: str = "{side}_team",
    how: str = "left",
) -> DataFrame:
    """Dimension columns for each side as ``{side}_{prefix}{column}``, null where unknown.

    No broadcast hint: adaptive execution broadcasts the dimension when its
    measured size allows, and otherwise splits skewed team keys in a sort-merge join.
    """
    for side in sides:
        on = team.format(side=side)
        renamed = dimension.select(
            F.col(key).alias(on),
            *[F.col(c).alias(f"{side}_{prefix}{c}") for c in dimension.columns if c != key],
        )
        df = df.join(renamed, on, how)
    return df


def latest_for_fixtures(fixtures: DataFrame, states: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Newest state of both teams beside each fixture; a fixture missing any of it is dropped."""
    joined = fixtures
    for side in ("home", "away"):
        renamed = states.select(
            *[F.col(k).alias(f"{side}_team" if k == "team" else k) for k in keys],
            *[F.col(f).alias(f"{side}_{f}") for f in features],
        )
        joined = joined.join(renamed, [f"{side}_team" if k == "team" else k for k in keys])
    return joined.dropna(subset=[f"{side}_{f}" for side in ("home", "away") for f in features])


def merge_tables(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge on ``keys``; where a column occurs twice the left one is kept."""

    def fold(a: DataFrame, b: DataFrame) -> DataFrame:
        fresh = [c for c in b.columns if c not in a.columns]
        return a.join(b.select(*keys, *fresh), list(keys), "full_outer")

    return reduce(fold, tables)


def composite_key(date: Column, home: Column, away: Column) -> Column:
    return F.concat_ws("_", F.date_format(date, "yyyy-MM-dd"), home, away)


def merge_on_key(
    left: DataFrame,
    right: DataFrame,
    key: str,
    values: Sequence[str],
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Left join on a built key. With ``order`` the last right row per key is kept, else rows may fan out."""
    rows = sequences.dedupe(right, [key], order, keep="last") if order else right
    return left.join(rows.select(key, *values), key, "left")


#: Days, for each day of tolerance, that are put in order together.
PART_DAYS = 32


def merge_nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], date: str, values: Sequence[str], left_id: str, right_id: str, days: int = 1
) -> DataFrame:
    """Left join on ``keys`` and a date up to ``days`` apart; a row of either side is used once.

    Nearest pairs come first (ties: the smaller ids): a pair stands if each is the other's nearest, and what is left meets again until no pair is.
    A left row without one keeps nulls. Null keys or dates meet nothing.

    Pairs are not made: on a day the n-th id of one side meets the n-th of the other, then what is over of one side only meets the days
    around it (:func:`_met_across`), and no more of it than there is to meet. An id on several days or keys ties together what is
    else apart, and a null id holds its nearest row for itself: where there are such ids, their keys make pairs (:func:`_met_pairs`).
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    own = [F.col(k).alias(n) for k, n in zip(keys, ks)] + [F.unix_date(F.col(date).cast("date")).alias("__day")]
    row = F.struct(F.col(right_id).alias("id"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]).alias("__row")
    dated = left if dict(left.dtypes)[date] == "date" else left.filter(F.col(date) == F.col(date).cast("date"))
    lefts = dated.select(*own, F.col(left_id).alias("__left")).dropna(subset=[*ks, "__day"])
    rights = right.select(*own, row).dropna(subset=[*ks, "__day"])
    near = cut(_in_reach(lefts, rights, ks, days), "near-days")
    met = near.filter("__l and __r").select(*ks, "__left", "__row", F.lit(0).alias("days_apart")).unionAll(_met_across(near, ks, days))
    if _ids_again(near):
        tied = cut(_tied_keys(lefts, rights, ks), "tied")
        pairs = _met_pairs(lefts.join(tied, ks, "left_semi"), rights.join(tied, ks, "left_semi"), ks, days)
        met = met.join(tied, ks, "left_anti").unionByName(pairs, allowMissingColumns=True)
    found = met.select(F.col("__left").alias(left_id), "days_apart", *[F.col(f"__row.v{i}").alias(v) for i, v in enumerate(values)])
    return left.join(found, left_id, "left")


def _in_reach(lefts: DataFrame, rights: DataFrame, ks: list[str], days: int) -> DataFrame:
    """(keys, __day, __nth, __left, __row, __l, __r): the n-th ids of a day side by side, without those that can't meet any.

    A row is shown to the parts of ``PART_DAYS`` days that it may matter to, so one shuffle and one sort tell its place among the
    ids of its day and what is over around it. Of the rows over, the n-th meets something only if so many are over on the other side.
    """
    width, is_left = PART_DAYS * max(days, 1), F.col("__is_left")
    part = lambda day: F.floor(day / width).cast("int")
    both = lefts.withColumn("__is_left", F.lit(True)).unionByName(rights.withColumn("__is_left", F.lit(False)), allowMissingColumns=True)
    shown = both.withColumn("__part", F.explode(F.sequence(part(F.col("__day") - days), part(F.col("__day") + days)))).repartition(*ks, "__part")
    day = [*ks, "__part", "__day"]
    of_day, around = Window.partitionBy(*day), Window.partitionBy(*ks, "__part").orderBy("__day").rangeBetween(-days, days)
    nth = F.dense_rank().over(Window.partitionBy(*day, "__is_left").orderBy("__left", "__row.id"))
    ids = lambda side: F.coalesce(F.max(F.when(side, F.col("__nth"))).over(of_day), F.lit(0))
    placed = shown.withColumn("__nth", nth).withColumn("__both", F.least(ids(is_left), ids(~is_left)))
    over = F.col("__nth") > F.col("__both")
    others = lambda side: F.count(F.when(over & side, 1)).over(around)
    there = F.when(is_left, others(~is_left)).otherwise(others(is_left))
    kept = placed.withColumn("__there", there).filter((part(F.col("__day")) == F.col("__part")) & (F.col("__nth") - F.col("__both") <= F.col("__there")))
    side = {"__left": F.min("__left"), "__row": F.min("__row"), "__l": F.max(is_left), "__r": F.max(~is_left)}
    return kept.groupBy(*day, "__nth").agg(*[v.alias(n) for n, v in side.items()]).drop("__part")


def _met_across(near: DataFrame, ks: list[str], days: int) -> DataFrame:
    """(keys, __left, __row, days_apart): pairs of different days among the rows that their own day left over.

    Days that could meet make a chain; a chain goes through one task, day by day.
    """
    known = F.col("__left").isNotNull() | F.col("__row.id").isNotNull()
    rest = near.filter(~(F.col("__l") & F.col("__r")) & known)
    order = Window.partitionBy(*ks).orderBy("__day", "__nth")
    gap = F.col("__day") - F.lag("__day").over(order)
    alone = gap > days
    if days == 1:
        alone |= (gap == 1) & (F.lag("__l").over(order) == F.col("__l"))
    first = rest.withColumn("__first", F.coalesce(alone, F.lit(True)))
    chains = first.withColumn("__chain", F.count(F.when(F.col("__first"), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = chains.repartition(*ks, "__chain").sortWithinPartitions(*ks, "__chain", "__day", "__nth")

    def met(table: pa.Table) -> pa.Table:
        day, own, left, first = (table.column(c).to_pylist() for c in ("__day", "__l", "__left", "__first"))
        right = pc.struct_field(table.column("__row"), "id").to_pylist()
        ids = [x if o else y for o, x, y in zip(own, left, right)]
        ends = [*(i for i, f in enumerate(first) if f), len(first)]
        pairs = [p for a, b in zip(ends, ends[1:]) for p in _chain_pairs(range(a, b), day, own, ids, days)]
        lefts, rights, apart = (pa.array([p[i] for p in pairs], pa.int64()) for i in range(3))
        found = table.select([*ks, "__left"]).take(lefts)
        return found.append_column("__row", table.column("__row").take(rights)).append_column("days_apart", apart.cast(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("__first").to_numpy(zero_copy_only=False))
            if len(starts) and (held or starts[-1]):
                yield from met(pa.Table.from_batches([*held, batch.slice(0, starts[-1])])).combine_chunks().to_batches()
                held, batch = [], batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from met(pa.Table.from_batches(held)).combine_chunks().to_batches()

    columns = [*ks, "__left", "__row"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
    return rows.select(*columns, "__day", "__l", "__first").mapInArrow(run, f"{kinds}, days_apart int")


def _chain_pairs(rows: Iterable[int], day: list[int], own: list[bool], ids: list, days: int) -> list[tuple[int, int, int]]:
    """(left, right, apart): pairs of the rows of a chain, each day of which has rows of one side, in order of their ids."""
    left_over: dict[int, list[int]] = {}
    for i in rows:
        left_over.setdefault(day[i], []).append(i)
    for some in left_over.values():
        some.reverse()
    found = []
    for apart in range(1, days + 1):

        def nearest(d: int) -> int | None:
            """The day with the smallest id that the first row of ``d`` may meet."""
            best, side = None, own[left_over[d][-1]]
            for e in (d - apart, d + apart):
                some = left_over.get(e)
                if some and own[some[-1]] != side and (best is None or ids[some[-1]] < ids[left_over[best][-1]]):
                    best = e
            return best

        for start in left_over:
            path = [start]  # ids get smaller along it, so it ends in two days that are each other's nearest
            while path:
                d = path[-1]
                e = nearest(d) if left_over[d] else None
                if e is None:
                    path.pop()
                elif (f := nearest(e)) != d:
                    path.append(f)
                else:
                    i, j = left_over[d].pop(), left_over[e].pop()
                    found.append((i, j, apart) if own[i] else (j, i, apart))
    return found


def _ids_again(near: DataFrame) -> bool:
    """Whether an id stands in several rows, or is null."""
    sides = [near.filter(flag).select(F.lit(flag).alias("side"), F.xxhash64(c).alias("id"), c.isNull().alias("none")) for flag, c in (("__l", F.col("__left")), ("__r", F.col("__row.id")))]
    times = sides[0].unionAll(sides[1]).groupBy("side", "id").agg(F.count(F.lit(1)).alias("n"), F.max("none").alias("none"))
    return not times.filter("n > 1 or none").isEmpty()


def _tied_keys(lefts: DataFrame, rights: DataFrame, ks: list[str]) -> DataFrame:
    """Keys with an id that is null or stands on another day or key, too."""
    found = []
    for side, name in ((lefts, F.col("__left")), (rights, F.col("__row.id"))):
        places = side.select(name.alias("__id"), *ks, "__day").distinct()
        many = places.groupBy(F.col("__id").alias("__many")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1 or __many is null")
        found.append(places.join(many, F.col("__id").eqNullSafe(F.col("__many"))).select(*ks))
    return found[0].unionAll(found[1]).distinct()


def _met_pairs(lefts: DataFrame, rights: DataFrame, ks: list[str], days: int) -> DataFrame:
    """(__left, __row, days_apart): the pairs that stand, found among all pairs that could meet, each right row shown to each day it may."""
    shown = rights.select(*ks, F.explode(F.sequence(F.col("__day") - days, F.col("__day") + days)).alias("__to"), F.col("__day").alias("__own"), "__row")
    apart = F.abs(F.col("__to") - F.col("__own")).alias("__apart")
    meeting = lefts.withColumnRenamed("__day", "__to").join(shown, [*ks, "__to"])
    pairs = cut(meeting.select("__left", F.col("__row.id").alias("__right"), apart, "__row"), "near-pairs")
    rounds = []
    while True:
        # folded before they are shuffled: one row for each row of either side
        best = pairs.groupBy("__left").agg(F.min(F.struct("__apart", "__row")).alias("__best"))
        taken = pairs.groupBy("__right").agg(F.min(F.struct("__apart", "__left")).alias("__by"))
        mutual = best.join(taken, F.col("__best.__row.id") == F.col("__right")).filter(F.col("__by.__left") == F.col("__left"))
        rounds.append(cut(mutual.select("__left", "__right", "__best.__row", F.col("__best.__apart").alias("days_apart")), "met"))
        if rounds[-1].isEmpty():
            break
        rest = pairs.join(rounds[-1].select("__left"), "__left", "left_anti").join(rounds[-1].select("__right"), "__right", "left_anti")
        pairs = cut(rest, "near-pairs", pairs)
    return reduce(DataFrame.unionAll, rounds).drop("__right")


def replace_rows(table: DataFrame, replaced: Column, fresh: DataFrame) -> DataFrame:
    """Drop the slice ``replaced`` and append its new rows."""
    return table.filter(~F.coalesce(replaced, F.lit(False))).unionByName(fresh, allowMissingColumns=True)
