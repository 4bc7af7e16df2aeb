"""Inputs past limits that once cut data: long null runs, large scores, null rates, long blocks."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchspark.functions import poisson
from matchspark.operators import reshape, sequences, strengths
from matchspark.sources import text


@pytest.mark.parametrize("chunk", [5, 64, None])
@pytest.mark.parametrize("span", [2, 3, 10, 40])
def test_weighted_means_through_null_runs(spark, span, chunk):
    rng = np.random.default_rng(span)
    value = rng.normal(5, 2, 3000)
    value[rng.random(3000) < 0.3] = np.nan
    value[40:1500] = np.nan
    value[1600:1605] = 3.0
    value[1700:2900] = np.nan
    value[:20] = np.where(np.arange(20) < 4, np.nan, 2.0)
    frame = pd.DataFrame({"team": 1, "seq": np.arange(3000), "x": value})
    rows = spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = sequences.form(rows, ["team"], "seq", weighted={"e": ("x", span)}, chunk=chunk).toPandas().sort_values("seq")
    want = frame.x.ewm(span=span, min_periods=1).mean().shift(1)
    np.testing.assert_allclose(got.e.astype(float).to_numpy(), want.to_numpy(), rtol=1e-9)


def test_counts_above_twenty(spark):
    rows = spark.createDataFrame([(k, r) for k in (-1, 0, 1, 20, 21, 45) for r in (0.5, 15.0)], "k int, r double")
    got = rows.select("k", "r", poisson.pmf(F.col("k"), F.col("r")).alias("p"), poisson.cdf(F.col("k"), F.col("r")).alias("c")).collect()
    for k, r, p, c in got:
        point = [math.exp(-r + i * math.log(r) - math.lgamma(i + 1)) for i in range(k + 1)]
        assert p == pytest.approx(point[-1] if point else 0.0, rel=1e-9)
        assert c == pytest.approx(sum(point), rel=1e-9)
    null = rows.select(poisson.pmf(F.lit(None).cast("int"), F.col("r")), poisson.cdf(F.lit(None).cast("int"), F.col("r"))).first()
    assert tuple(null) == (None, None)


def test_null_rates_give_nulls(spark):
    rows = spark.createDataFrame([(None, 1.0), (1.0, None), (None, None)], "h double, a double")
    for rho in (None, -0.1):
        for r in poisson.with_outcomes(rows, "h", "a", rho=rho).drop("h", "a").collect():
            assert set(r) == {None}


def test_long_odds_blocks(spark):
    filler = [f"filler {i}" for i in range(60)]
    page = "\n".join(["Tir. 05/03 18:45", "Home", "Away", "England - Premier League", *filler, "Over 2.5", "1.95", "Tir. 06/03 19:00", "C", "D", "Over 2.5", "1,40"])
    pages = spark.createDataFrame([(1, page)], "id int, page string")
    today = F.lit(datetime.date(2024, 1, 1))
    found = text.odds_pages(pages, ["id"], "page", today).orderBy("block").collect()
    assert [(r["home_team"], r["over_2_5"]) for r in found] == [("Home", 1.95), ("C", 1.4)]
    inline = page.replace("Over 2.5\n1.95", "Over 2.5 1.95").replace("Over 2.5\n1,40", "Over 2.5 1,40")
    found = text.inline_odds(spark.createDataFrame([(1, inline)], "id int, page string"), ["id"], "page", today)
    assert [r["over_2_5"] for r in found.orderBy("block").collect()] == [1.95, 1.4]


def test_strengths_say_whether_they_converged(spark):
    rng = np.random.default_rng(2)
    home, away = rng.integers(0, 12, 900), rng.integers(0, 11, 900)
    rows = [
        (f"t{h}", f"t{(h + a + 1) % 12}", int(rng.poisson(1.6)), int(rng.poisson(1.2)), datetime.date(2024, 1, 1) + datetime.timedelta(int(i) % 200))
        for i, (h, a) in enumerate(zip(home, away))
    ]
    rows.append(("t0", "t1", 25, 0, datetime.date(2024, 6, 1)))
    table = spark.createDataFrame(rows, "home_team string, away_team string, home_goals int, away_goals int, match_date date")
    assert strengths.fit(table, sweeps=10, tolerance=1e-5).converged
    assert not strengths.fit(table, sweeps=1, tolerance=1e-5).converged


def test_sides_are_folded_after_the_shuffle_only(spark):
    """A fold before it holds all rows of a task at the width of both sides, and folds nothing."""
    rows = [(1, True, 10, 2.0), (1, False, 11, None), (2, True, 11, 3.0), (None, True, 12, 4.0), (2, True, 11, 5.0)]
    table = spark.createDataFrame(rows, "match_id long, is_home boolean, team long, form double").repartition(3)
    wide = reshape.back_to_matches(table, ["match_id"], ["team", "form"], {"form": "goals"})
    plan = wide._jdf.queryExecution().sparkPlan().toString()
    # read from the top down: no aggregate stands below the shuffle by match
    shuffle = plan.find("Exchange hashpartitioning(match_id")
    assert shuffle > 0 and "Aggregate" not in plan[shuffle:]
    found = sorted(map(tuple, wide.collect()), key=repr)
    assert found == [(1, 2.0, 10, 2.0, 11, None), (2, 5.0, 11, 5.0, None, None), (None, 4.0, 12, 4.0, None, None)]
