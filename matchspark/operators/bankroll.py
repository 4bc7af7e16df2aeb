"""Bankroll recursion over ordered trades, its summary, and portfolio allocation.

What a chunk of trades does to the bankroll it is entered with is an increasing piecewise linear
function: its slope changes where a trade's stake begins to meet the cap. Chunks are taken apart in
parallel; what goes in order through a portfolio's task is at most ``POINTS`` points of each chunk's function.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators import sequences
from matchspark.session import cut

CHUNK = 4096


def bankroll_path(
    trades: DataFrame,
    portfolio: str,
    order: Sequence[str],
    block: Column,
    start: float = 10_000.0,
    cap: float = 0.10,
    chunk: int = CHUNK,
) -> DataFrame:
    """Stake, profit and bankroll after each trade when a stake is min(wanted, cap * bankroll).

    ``trades`` holds ``stake`` (wanted) and ``gain`` (profit per unit staked, -1 or more; ``cap`` is at most 1).
    Trades are cut into chunks of a portfolio, measured in parallel: what a chunk adds
    if no stake meets the cap, its highest point, and the least bankroll with which none
    does. These three numbers a chunk go in order through the portfolio's task. From
    the first chunk on that is entered with less, the chunks' functions are composed, see
    :func:`_entered`. Paths inside the chunks are computed in parallel afterwards.
    """
    numbered = sequences.number(trades, [portfolio], order, block, "__seq")
    row = F.struct("__seq", *[c for c in trades.columns if c != portfolio])
    measure = F.pandas_udf(_measuring(cap), "total double, top double, need double")
    chunks = cut(
        numbered.groupBy(portfolio, F.floor(F.col("__seq") / chunk).alias("__chunk"))
        .agg(F.array_sort(F.collect_list(row)).alias("__trades"))
        .withColumn("stakes", F.transform("__trades", lambda t: t["stake"].cast("double")))
        .withColumn("gains", F.transform("__trades", lambda t: t["gain"].cast("double")))
        .withColumn("measured", measure("stakes", "gains")),
        "chunks",
    )
    earlier = Window.partitionBy(portfolio).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    state = chunks.select(portfolio, "__chunk", "measured.*")
    state = state.withColumn("__bankroll", start + F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))
    highest = F.max(F.col("__bankroll") + F.col("top")).over(earlier)
    state = state.withColumn("__peak", F.coalesce(highest, F.lit(float("-inf"))))
    first = F.min(F.struct("__chunk", "__bankroll", "__peak")).alias("__first")
    capped = state.filter("__bankroll < need").groupBy(portfolio).agg(first)
    capped = cut(capped.select(F.col(portfolio).alias("__of"), "__first"), "capped")
    same = F.col(portfolio).eqNullSafe(F.col("__of"))
    free = state.join(capped, same, "left").filter(F.coalesce(F.col("__chunk") < F.col("__first.__chunk"), F.lit(True)))
    bound = chunks.join(capped, same).filter(F.col("__chunk") >= F.col("__first.__chunk"))
    fold = F.pandas_udf(_folding(cap), "stake array<double>, bankroll array<double>, peak array<double>")
    if not capped.isEmpty():
        entered = _entered(bound.select(portfolio, "__chunk", "stakes", "gains", "measured", "__first"), portfolio, cap)
        inside = fold("stakes", "gains", "__bankroll", F.lit(float("-inf")))
        tops = cut(
            entered.withColumn("__path", inside).select(
                portfolio, "__chunk", "__bankroll", F.col("__first.__peak").alias("__peak"), F.element_at("__path.peak", -1).alias("__top")
            ),
            "tops",
        )
        peak = F.greatest("__peak", F.coalesce(F.max("__top").over(earlier), F.lit(float("-inf"))))
        free = free.select(portfolio, "__chunk", "__bankroll", "__peak").unionByName(tops.withColumn("__peak", peak).drop("__top"))
    entered = free.select(portfolio, "__chunk", "__bankroll", "__peak")
    kept = [c for c in trades.columns if c not in (portfolio, "stake")]
    point = F.arrays_zip("__trades", "__path.stake", "__path.bankroll", "__path.peak")
    return (
        chunks.join(entered, [portfolio, "__chunk"])
        .withColumn("__path", fold("stakes", "gains", "__bankroll", "__peak"))
        .select(portfolio, F.inline(point).alias("__trade", "stake", "bankroll_after", "peak"))
        .select(
            portfolio,
            F.col("__trade.__seq").alias("trade"),
            *[F.col(f"__trade.{c}") for c in kept],
            "stake",
            (F.col("stake") * F.col("__trade.gain")).alias("profit"),
            "bankroll_after",
            ((F.col("bankroll_after") - F.col("peak")) / F.nullif("peak", F.lit(0.0))).alias("drawdown"),
        )
    )


def _fold_chunk(stakes, gains, bankroll: float, cap: float):
    """Stakes taken and bankroll after each trade of one chunk."""
    flat = np.cumsum(stakes * gains)
    before = np.concatenate(([0.0], flat[:-1]))
    if bankroll >= np.max(stakes / cap - before):
        return stakes, bankroll + flat
    taken, after = np.empty(len(stakes)), np.empty(len(stakes))
    for i, (stake, gain) in enumerate(zip(stakes, gains)):
        taken[i] = min(stake, cap * bankroll)
        bankroll += taken[i] * gain
        after[i] = bankroll
    return taken, after


def _measuring(cap: float):
    """Of each chunk: its sum, its highest point and the least bankroll with which no stake meets the cap."""

    def run(stakes: pd.Series, gains: pd.Series) -> pd.DataFrame:
        rows = []
        for s, g in zip(stakes, gains):
            flat = np.cumsum(s * g)
            rows.append((flat[-1], flat.max(), np.max(s / cap - np.concatenate(([0.0], flat[:-1])))))
        return pd.DataFrame(rows, columns=["total", "top", "need"], dtype=float)

    return run


def _entered(bound: DataFrame, portfolio: str, cap: float) -> DataFrame:
    """Adds ``__bankroll``, the bankroll each chunk is entered with; the first of a portfolio is known.

    Each round, every chunk tells in parallel how it maps the range it may be entered with: all pieces if
    they are few, else the values at ``POINTS`` even places. One row a chunk then goes in order through the
    portfolio's task, which narrows the ranges. They end as points, since a range is cut ``POINTS``-fold
    each round and a narrow one has few pieces.
    """
    known = F.col("__chunk") == F.col("__first.__chunk")
    low, high = F.when(known, F.col("__first.__bankroll")), F.when(known, F.col("__first.__bankroll"))
    ranges = bound.select(
        portfolio, "__chunk", F.coalesce(low, F.lit(0.0)).alias("low"), F.coalesce(high, F.lit(float("inf"))).alias("high")
    )
    ranges = cut(ranges, "ranges")
    mapped = F.pandas_udf(_mapping(cap), "x array<double>, y array<double>, exact boolean")
    kind = dict(bound.dtypes)[portfolio]
    keyed = bound.withColumnsRenamed({portfolio: "__own", "__chunk": "__at"})
    same = F.col(portfolio).eqNullSafe(F.col("__own")) & (F.col("__chunk") == F.col("__at"))
    while True:
        told = ranges.join(keyed, same).select(
            portfolio, "__chunk", "low", "high", "measured.need", "measured.total",
            mapped("stakes", "gains", "low", F.least("high", F.greatest("low", "measured.need"))).alias("map"),
        )
        narrowed = (
            told.repartition(portfolio)
            .sortWithinPartitions(portfolio, "__chunk")
            .mapInPandas(_narrowing(portfolio), f"`{portfolio}` {kind}, __chunk bigint, low double, high double")
        )
        ranges = cut(narrowed, "ranges", ranges)
        if ranges.filter("low < high").isEmpty():
            break
    return ranges.join(keyed, same).withColumn("__bankroll", F.col("low")).drop("__own", "__at", "low", "high")


#: Most points of a chunk's function that are told in a round.
POINTS = 64


def _pieces(stakes, gains, low: float, high: float, cap: float):
    """Ends of the pieces of a chunk's function between two bankrolls, or None if there are more than ``POINTS``."""
    x = y = np.unique([low, high]).astype(float)
    for stake, gain in zip(stakes, gains):
        bend = stake / cap
        if y[0] < bend < y[-1]:
            i = int(np.searchsorted(y, bend))
            if y[i] != bend:
                if len(y) >= POINTS:
                    return None
                at = x[i - 1] + (bend - y[i - 1]) * (x[i] - x[i - 1]) / (y[i] - y[i - 1])
                x, y = np.insert(x, i, at), np.insert(y, i, bend)
        y = y + np.minimum(stake, cap * y) * gain
    return x, y


def _mapping(cap: float):
    def run(stakes: pd.Series, gains: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
        rows = []
        for s, g, low, high in zip(stakes, gains, lows, highs):
            found = _pieces(s, g, low, high, cap)
            if found is None:
                x = y = np.linspace(low, high, POINTS)
                for stake, gain in zip(s, g):
                    y = y + np.minimum(stake, cap * y) * gain
                rows.append((x, y, False))
            else:
                rows.append((*found, True))
        return pd.DataFrame(rows, columns=["x", "y", "exact"])

    return run


def _narrowing(portfolio: str):
    """Ranges of the bankroll on entering each chunk, streaming over chunks sorted by portfolio and number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, low, high = object(), 0.0, 0.0
        for batch in batches:
            out = []
            for key, first, last, need, total, told in zip(*(batch[c] for c in (portfolio, "low", "high", "need", "total", "map"))):
                if key != current:
                    current, low, high = key, first, last
                low, high = max(low, first), min(high, last)
                low, high = min(low, high), max(low, high)
                out.append((low, high))
                x, y, exact = np.asarray(told["x"]), np.asarray(told["y"]), told["exact"]

                def after(b: float, side: str) -> float:
                    if b >= need:
                        return b + total
                    if exact:
                        return float(np.interp(b, x, y))
                    i = np.searchsorted(x, b, side="right") - 1 if side == "low" else np.searchsorted(x, b, side="left")
                    return float(y[min(max(i, 0), len(y) - 1)])

                low, high = after(low, "low"), after(high, "high")
            yield pd.concat([batch[[portfolio, "__chunk"]].reset_index(drop=True), pd.DataFrame(out, columns=["low", "high"], dtype=float)], axis=1)

    return run


def _folding(cap: float):
    def run(stakes: pd.Series, gains: pd.Series, bankrolls: pd.Series, peaks: pd.Series) -> pd.DataFrame:
        rows = []
        for s, g, bankroll, peak in zip(stakes, gains, bankrolls, peaks):
            taken, after = _fold_chunk(s, g, bankroll, cap)
            rows.append((taken, after, np.maximum(np.maximum.accumulate(after), peak)))
        return pd.DataFrame(rows, columns=["stake", "bankroll", "peak"])

    return run


def summary(path: DataFrame, portfolio: str, start: float = 10_000.0) -> DataFrame:
    return path.groupBy(portfolio).agg(
        F.count(F.lit(1)).alias("bets"),
        (F.sum("profit") / start).alias("roi"),
        F.avg(F.col("won").cast("double")).alias("hit_rate"),
        F.min("drawdown").alias("max_drawdown"),
        F.max_by("bankroll_after", "trade").alias("ending_bankroll"),
    )


def allocate(bets: DataFrame, portfolio: str, bankroll: float) -> DataFrame:
    """Share of the bankroll per bet by Kelly weight, equally, and by positive value.

    Totals are folded before the shuffle and joined back, so one large
    portfolio never has to meet in one task.
    """
    value = F.greatest(F.lit(0.0), F.col("probability") * F.col("odds") - 1.0)
    totals = bets.groupBy(portfolio).agg(
        F.sum("kelly").alias("__kelly"), F.sum(value).alias("__value"), F.count(F.lit(1)).alias("__bets")
    )
    shares = {
        "kelly_share": F.when(F.col("__kelly") > 0, F.col("kelly") / F.col("__kelly")).otherwise(0.0),
        "equal_share": 1.0 / F.col("__bets"),
        "value_share": F.when(F.col("__value") > 0, value / F.col("__value")).otherwise(0.0),
    }
    joined = bets.join(totals, portfolio).withColumns(shares)
    stakes = {n.replace("share", "stake"): F.col(n) * bankroll for n in shares}
    return joined.withColumns(stakes).drop("__kelly", "__value", "__bets")


def allocation_totals(allocated: DataFrame, portfolio: str, method: str) -> DataFrame:
    stake = F.col(f"{method}_stake")
    back = F.sum(stake * F.col("odds") * F.col("probability"))
    return allocated.groupBy(portfolio).agg(
        F.count(F.lit(1)).alias("bets"),
        F.sum(stake).alias("total_stake"),
        back.alias("expected_return"),
        (back - F.sum(stake)).alias("expected_profit"),
    )
