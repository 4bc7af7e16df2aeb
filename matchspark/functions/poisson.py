"""Goal-count probabilities as column expressions.

A line given as a number unrolls to plain arithmetic inside whole-stage code
generation; a line given as a column folds over a short ``sequence``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = (1.5, 2.5, 3.5, 4.5)


def clip(value: Column, low: float, high: float) -> Column:
    """Bounded value; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def pmf(k: int | Column, rate: Column) -> Column:
    if isinstance(k, int):
        return F.exp(-rate) * F.pow(rate, F.lit(k)) / F.lit(float(math.factorial(k)))
    # a running product: factorials end at 20
    counts = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).when(k.isNotNull(), F.array().cast("array<int>"))
    product = F.aggregate(counts, F.lit(1.0), lambda acc, i: acc * rate / i)
    return F.when(k < 0, 0.0).otherwise(F.exp(-rate) * product)


def cdf(k: int | Column, rate: Column) -> Column:
    """P(count <= k); zero below zero. A plain ``k`` is evaluated in Horner form."""
    if isinstance(k, int):
        if k < 0:
            return F.lit(0.0)
        total = F.lit(1.0)
        for i in range(k, 0, -1):
            total = 1.0 + total * rate / float(i)
        return F.exp(-rate) * total
    # Horner form, from the last count to the first
    counts = F.when(k >= 1, F.sequence(k.cast("int"), F.lit(1))).when(k.isNotNull(), F.array().cast("array<int>"))
    total = F.aggregate(counts, F.lit(1.0), lambda acc, i: 1.0 + acc * rate / i)
    return F.when(k < 0, 0.0).otherwise(F.exp(-rate) * total)


def single_rate_under(line: float | Column, rate: Column, low: float = 0.1, high: float = 6.0) -> Column:
    """One total-goals rate: P(total <= floor(line - 0.5))."""
    bounded = clip(rate, low, high)
    k = math.floor(line - 0.5) if isinstance(line, (int, float)) else F.floor(line - 0.5)
    return cdf(k, bounded)


def single_rate_over(line: float | Column, rate: Column, low: float = 0.1, high: float = 6.0) -> Column:
    return 1.0 - single_rate_under(line, rate, low, high)


def two_rate_under(line: float | Column, home: Column, away: Column, max_goals: int = 10) -> Column:
    """Independent home and away counts, each cut at ``max_goals``: P(h + a <= floor(line)).

    Up to the cut the sum of the counts is itself a count with the summed rate.
    """
    if isinstance(line, (int, float)):
        t = math.floor(line)
        if t <= max_goals:
            return cdf(t, home + away)
        return _sum([pmf(h, home) * cdf(min(t - h, max_goals), away) for h in range(max_goals + 1)])
    t = F.floor(line).cast("int")
    steps = F.sequence(F.lit(0), F.lit(max_goals))
    cut = F.aggregate(
        steps, F.lit(0.0), lambda acc, h: acc + pmf(h, home) * cdf(F.least(t - h, F.lit(max_goals)), away)
    )
    return F.when(t <= max_goals, cdf(t, home + away)).otherwise(cut)


def two_rate_over(line: float | Column, home: Column, away: Column, max_goals: int = 10) -> Column:
    """P(h + a > floor(line)) on the cut grid, which holds slightly less than all mass."""
    return cdf(max_goals, home) * cdf(max_goals, away) - two_rate_under(line, home, away, max_goals)


def two_rate_over_whole(line: float | Column, home: Column, away: Column) -> Column:
    """As above with no cut: the complement of the under probability."""
    reach = math.floor(line) if isinstance(line, (int, float)) else 170
    return 1.0 - two_rate_under(line, home, away, reach)


def with_outcomes(
    df: DataFrame,
    home: str,
    away: str,
    size: int = 10,
    lines: Sequence[float] = LINES,
    rho: Column | float | None = None,
    normalise: bool = False,
    complement: bool = False,
    prefix: str = "",
) -> DataFrame:
    """Result, totals and both-score probabilities from a scoreline grid of ``size`` goals a side.

    The grid is never built as rows: each side keeps its point and cumulative
    masses as columns. ``rho`` applies the low-score correlation, which changes
    four cells only; a null rate gives nulls. ``normalise`` divides by the grid's mass; ``complement``
    takes under as one minus over instead of the grid sum.
    """
    rates = {s: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.01))) for s, c in (("h", home), ("a", away))}
    points, sums = {}, {}
    for side in rates:
        for k in range(size):
            points[f"__{side}{k}"] = pmf(k, rates[side])
            sums[f"__{side}c{k}"] = _sum([F.col(f"__{side}{i}") for i in range(k + 1)])
    grid = df.withColumns(points).withColumns(sums)
    h, a = [F.col(f"__h{k}") for k in range(size)], [F.col(f"__a{k}") for k in range(size)]
    hc, ac = [F.col(f"__hc{k}") for k in range(size)], [F.col(f"__ac{k}") for k in range(size)]
    s = {}
    if rho is not None:
        r = F.lit(rho) if isinstance(rho, (int, float)) else rho
        cells = {
            f"__s{i}{j}": F.greatest(F.lit(0.0), f * h[i] * a[j]) - h[i] * a[j]
            for (i, j), f in low_score_factors(F.col(home), F.col(away), r).items()
        }
        grid = grid.withColumns(cells)
        s = {(int(n[3]), int(n[4])): F.col(n) for n in cells}

    def corrected(terms: list[Column], touched: Callable[[int, int], bool]) -> Column:
        return _sum(terms + [v for (i, j), v in s.items() if touched(i, j)])

    raw = {
        "__mass": corrected([hc[-1] * ac[-1]], lambda i, j: True),
        "__home_win": corrected([h[i] * ac[i - 1] for i in range(1, size)], lambda i, j: i > j),
        "__draw": corrected([h[i] * a[i] for i in range(size)], lambda i, j: i == j),
        "__away_win": corrected([a[i] * hc[i - 1] for i in range(1, size)], lambda i, j: i < j),
        "__btts": corrected([(hc[-1] - h[0]) * (ac[-1] - a[0])], lambda i, j: i and j),
    }
    for line in lines:
        t = math.floor(line)
        if t < size:
            terms = [cdf(t, rates["h"] + rates["a"])]
        else:
            terms = [h[i] * ac[min(t - i, size - 1)] for i in range(size)]
        raw[f"__under_{_tag(line)}"] = corrected(terms, lambda i, j, t=t: i + j <= t)
    grid = grid.withColumns(raw)
    mass = F.col("__mass")
    unit = mass if normalise else F.lit(1.0)
    out = {k: F.col(f"__{k}") / unit for k in ("home_win", "draw", "away_win")}
    out["both_score"] = F.col("__btts") / unit
    for line in lines:
        under = F.col(f"__under_{_tag(line)}")
        over = (mass - under) / unit
        out[f"over_{_tag(line)}"] = over
        out[f"under_{_tag(line)}"] = 1.0 - over if complement else under / unit
    return grid.select(*df.columns, *[v.alias(f"{prefix}{k}") for k, v in out.items()])


def low_score_factors(home: Column, away: Column, rho: Column) -> dict[tuple[int, int], Column]:
    """Correlation factor of the four lowest scorelines; one elsewhere."""
    return {
        (0, 0): 1.0 - home * away * rho,
        (0, 1): 1.0 + home * rho,
        (1, 0): 1.0 + away * rho,
        (1, 1): 1.0 - rho,
    }


def low_score_factor(home_goals: Column, away_goals: Column, home: Column, away: Column, rho: Column) -> Column:
    """The factor for a scoreline given as columns."""
    factor = F.lit(1.0)
    for (i, j), value in low_score_factors(home, away, rho).items():
        factor = F.when((home_goals == i) & (away_goals == j), value).otherwise(factor)
    return factor


def expected_goals(
    attack_home: Column, defense_home: Column, attack_away: Column, defense_away: Column, advantage: Column | float
) -> tuple[Column, Column]:
    """Expected goals from strengths, kept within 0.1 and 5."""
    home = clip(F.exp(attack_home + defense_away + advantage), 0.1, 5.0)
    away = clip(F.exp(attack_away + defense_home), 0.1, 5.0)
    return home, away


def result_call(home: Column, draw: Column, away: Column) -> Column:
    """H or A if it is the likeliest result alone, else D. Equal up to 1e-9 is a tie, whatever the order of sums."""
    home, draw, away = (F.round(p, 9) for p in (home, draw, away))
    call = F.when((home > away) & (home > draw), "H").when((away > home) & (away > draw), "A").otherwise("D")
    return F.when(home.isNotNull(), call)


def ensemble(poisson: Column, boosted: Column, strengths: Column, strengths_weight: float = 0.4) -> Column:
    """Blend of up to three model probabilities; a missing model is null. The weights are fixed values."""
    return (
        F.when(boosted.isNotNull() & strengths.isNotNull(), 0.35 * poisson + 0.35 * boosted + 0.30 * strengths)
        .when(strengths.isNotNull(), (1.0 - strengths_weight) * poisson + strengths_weight * strengths)
        .when(boosted.isNotNull(), 0.5 * poisson + 0.5 * boosted)
        .otherwise(poisson)
    )


def ensemble_label(boosted: Column, strengths: Column) -> Column:
    return (
        F.when(boosted.isNotNull() & strengths.isNotNull(), "full_ensemble")
        .when(strengths.isNotNull(), "poisson_dc_ensemble")
        .when(boosted.isNotNull(), "poisson_gb_ensemble")
        .otherwise("poisson_only")
    )


def blend(first: Column, second: Column) -> Column:
    """Even mix of two expected-goal models, the first alone where the second is missing."""
    return F.coalesce((first + second) / 2.0, first)


def availability(goals: Column, players_out: Column, step: float = 0.02, floor: float = 0.7) -> Column:
    """Expected goals less ``step`` per missing player, at most 30 % off."""
    return goals * F.greatest(F.lit(floor), 1.0 - step * F.coalesce(players_out, F.lit(0)))


def _sum(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def _tag(line: float) -> str:
    return str(float(line)).replace(".", "_")
