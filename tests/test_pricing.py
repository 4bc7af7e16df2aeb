"""Pricing and staking against known outputs and plain Python."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchspark.functions import poisson, staking
from matchspark.operators import bankroll


def value(spark, column):
    return spark.range(1).select(column.cast("double").alias("v")).first().v


def lit(*numbers):
    return [F.lit(float(x)) for x in numbers]


@pytest.mark.parametrize(
    "line, home, away, under",
    [
        (3.5, 1.015823265809885, 0.9172758691820826, 0.8689891530685966),
        (3.5, 1.1310816604719824, 0.985212076509804, 0.8355524601921097),
        (2.5, 1.2651965731219084, 0.7434839083116034, 0.6743268800775478),
    ],
)
def test_two_rate_grid(spark, line, home, away, under):
    h, a = lit(home, away)
    assert value(spark, poisson.two_rate_under(line, h, a)) == pytest.approx(under, abs=1e-12)
    assert value(spark, poisson.two_rate_under(F.lit(line), h, a)) == pytest.approx(under, abs=1e-12)


def test_cut_grid_beyond_its_edge(spark):
    h, a = lit(3.0, 2.0)
    p = lambda k, r: math.exp(-r) * r**k / math.factorial(k)
    under = sum(p(i, 3.0) * p(j, 2.0) for i in range(5) for j in range(5) if i + j <= 6)
    over = sum(p(i, 3.0) * p(j, 2.0) for i in range(5) for j in range(5) if i + j > 6)
    assert value(spark, poisson.two_rate_under(6.5, h, a, 4)) == pytest.approx(under, abs=1e-12)
    assert value(spark, poisson.two_rate_under(F.lit(6.5), h, a, 4)) == pytest.approx(under, abs=1e-12)
    assert value(spark, poisson.two_rate_over(6.5, h, a, 4)) == pytest.approx(over, abs=1e-12)


@pytest.mark.parametrize(
    "home, away, over, odds, ev",
    [
        (2.2704003968337614, 1.0148731378598952, 0.6376074590619019, 1.37, -0.12647778108519436),
        (1.5653401773524829, 1.1139596106027105, 0.5012911691908846, 1.4, -0.29819236313276165),
    ],
)
def test_whole_grid_and_value(spark, home, away, over, odds, ev):
    p = poisson.two_rate_over_whole(2.5, *lit(home, away))
    assert value(spark, p) == pytest.approx(over, abs=1e-12)
    assert value(spark, staking.expected_value(p, F.lit(odds))) == pytest.approx(ev, abs=1e-12)


def test_blend(spark):
    assert value(spark, poisson.blend(*lit(2.7557763971011724, 1.7850243965663506))) == pytest.approx(2.2704003968337614)
    assert value(spark, poisson.blend(F.lit(2.5), F.lit(None).cast("double"))) == 2.5


def test_single_rate(spark):
    assert value(spark, poisson.single_rate_over(1.5, F.lit(2.7479813989245896))) == pytest.approx(0.7599154191445202)
    assert value(spark, poisson.single_rate_over(F.lit(3.5), F.lit(2.391025035691168))) == pytest.approx(0.21940331035519683)


def test_stakes(spark):
    p, odds = lit(0.34426229508196726, 3.05)
    full = staking.kelly(p, odds)
    assert value(spark, staking.kelly_stake(full)) == pytest.approx(0.0036585365853658573)
    assert value(spark, staking.kelly(F.lit(0.9), F.lit(1.0))) == 0.0
    edge = staking.probability_edge(*lit(0.5117089121850291, 2.55))
    assert value(spark, edge) == pytest.approx(0.11955204943993103)
    assert value(spark, staking.edge_stake(edge, F.lit(2.55))) == pytest.approx(0.019282588619343715)


def test_corrected_grid_sums_to_one(spark):
    df = spark.createDataFrame([(1.4, 0.9), (0.3, 2.8)], "h double, a double")
    out = poisson.with_outcomes(df, "h", "a", size=9, rho=-0.12, normalise=True).toPandas()
    np.testing.assert_allclose(out.home_win + out.draw + out.away_win, 1.0, atol=1e-12)
    np.testing.assert_allclose(out.over_1_5 + out.under_1_5, 1.0, atol=1e-12)
    for _, row in out.iterrows():
        p = lambda k, r: math.exp(-r) * r**k / math.factorial(k)
        tau = {(0, 0): 1 + row.h * row.a * 0.12, (0, 1): 1 - row.h * 0.12, (1, 0): 1 - row.a * 0.12, (1, 1): 1.12}
        grid = np.array([[max(0, tau.get((i, j), 1) * p(i, row.h) * p(j, row.a)) for j in range(9)] for i in range(9)])
        grid /= grid.sum()
        total = np.add.outer(np.arange(9), np.arange(9))
        assert row.over_1_5 == pytest.approx(grid[total > 1].sum())
        assert row.both_score == pytest.approx(grid[1:, 1:].sum())
        assert row.draw == pytest.approx(np.trace(grid))


@pytest.mark.parametrize("chunk", [3, 7, 4096])
@pytest.mark.parametrize("start", [10_000.0, 900.0])
def test_bankroll_path(spark, chunk, start):
    rng = np.random.default_rng(5)
    n = 120
    frame = pd.DataFrame(
        {
            "book": rng.choice(["a", "a", "a", "b"], n), "day": rng.integers(0, 9, n), "id": np.arange(n),
            "stake": rng.uniform(50, 500, n), "gain": np.where(rng.random(n) < 0.45, rng.uniform(0.3, 2, n), -1.0),
        }
    )
    frame["won"] = frame.gain > 0
    path = bankroll.bankroll_path(
        spark.createDataFrame(frame.sample(frac=1, random_state=2)), "book", ["day", "id"], F.col("day"), start=start, chunk=chunk
    )
    got = path.toPandas().sort_values(["book", "trade"])
    capped = 0
    for book, trades in frame.sort_values(["book", "day", "id"]).groupby("book"):
        money, expected = start, []
        for stake, gain in zip(trades.stake, trades.gain):
            taken = min(stake, 0.1 * money)
            capped += taken < stake
            money += taken * gain
            expected.append(money)
        mine = got[got.book == book]
        np.testing.assert_allclose(mine.bankroll_after, expected)
        np.testing.assert_allclose(mine.peak if "peak" in mine else np.maximum.accumulate(expected), np.maximum.accumulate(expected))
        fall = (np.array(expected) - np.maximum.accumulate(expected)) / np.maximum.accumulate(expected)
        np.testing.assert_allclose(mine.drawdown, fall, atol=1e-12)
    assert capped > 0 or start > 1000


def test_capped_book_over_many_chunks(spark):
    """Stakes on both sides of the cap all along: ranges are narrowed over rounds, chunk by chunk."""
    rng = np.random.default_rng(8)
    n = 6000
    frame = pd.DataFrame({"book": np.where(np.arange(n) % 3, "a", "b"), "day": np.arange(n) // 50, "id": np.arange(n)})
    frame["stake"] = rng.uniform(20, 220, n)
    frame["gain"] = np.where(rng.random(n) < 0.5, rng.uniform(0.8, 1.2, n), -1.0)
    frame["won"] = frame.gain > 0
    path = bankroll.bankroll_path(spark.createDataFrame(frame), "book", ["day", "id"], F.col("day"), start=1200.0, chunk=500)
    got = path.toPandas().sort_values(["book", "trade"])
    for book, trades in frame.groupby("book"):
        money, expected, capped = 1200.0, [], 0
        for stake, gain in zip(trades.stake, trades.gain):
            capped += stake > 0.1 * money
            money += min(stake, 0.1 * money) * gain
            expected.append(money)
        assert 0 < capped < len(trades)
        mine = got[got.book == book]
        np.testing.assert_allclose(mine.bankroll_after, expected, rtol=1e-9)
        peak = np.maximum.accumulate(expected)
        np.testing.assert_allclose(mine.drawdown, (np.array(expected) - peak) / peak, atol=1e-9)


def test_pieces_of_a_chunk_are_its_function():
    rng = np.random.default_rng(3)
    stakes, gains = rng.uniform(1, 100, 40), np.where(rng.random(40) < 0.5, 0.9, -1.0)
    x, y = bankroll._pieces(stakes, gains, 0.0, 3000.0, 0.1)
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 2 < len(x) <= 42
    for b in rng.uniform(0, 3000, 300):
        assert np.interp(b, x, y) == pytest.approx(bankroll._fold_chunk(stakes, gains, b, 0.1)[1][-1])
    assert bankroll._pieces(rng.uniform(1, 100, 500), np.full(500, 0.01), 0.0, 3000.0, 0.1) is None


def test_allocation(spark):
    bets = spark.createDataFrame(
        [("p", 0.02, 0.5, 2.2), ("p", 0.03, 0.4, 3.0), ("q", 0.0, 0.2, 2.0)],
        "book string, kelly double, probability double, odds double",
    )
    rows = {(r.book, r.odds): r for r in bankroll.allocate(bets, "book", 100.0).collect()}
    assert rows["p", 2.2].kelly_stake == pytest.approx(40.0)
    assert rows["p", 3.0].value_share == pytest.approx(0.2 / 0.3)
    assert rows["q", 2.0].kelly_share == 0.0 and rows["q", 2.0].equal_share == 1.0
