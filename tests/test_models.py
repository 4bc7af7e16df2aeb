"""Fits against dense numpy solvers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchspark.operators import models, strengths
from matchspark.sources import sinks


def poisson_newton(x, y, alpha, scale):
    x = np.asarray(x, float)
    if scale:
        x = (x - x.mean(0)) / x.std(0)
    design = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([0.0] + [alpha] * x.shape[1])
    beta = np.zeros(design.shape[1])
    beta[0] = np.log(y.mean())
    for _ in range(60):
        mu = np.exp(design @ beta)
        gradient = design.T @ (mu - y) / len(y) + ridge @ beta
        beta -= np.linalg.solve(design.T @ (design * mu[:, None]) / len(y) + ridge, gradient)
    return np.exp(design @ beta)


@pytest.fixture(scope="module")
def goals():
    rng = np.random.default_rng(11)
    x = rng.normal([1.0, 5.0], [0.5, 3.0], (400, 2))
    return pd.DataFrame({"id": np.arange(400), "a": x[:, 0], "b": x[:, 1], "goals": rng.poisson(np.exp(0.3 * x[:, 0] - 0.1 * x[:, 1] + 0.5))})


@pytest.mark.parametrize("alpha, scale", [(0.01, True), (1.0, False)])
def test_goal_regression(spark, goals, alpha, scale):
    model = models.goal_regression(spark.createDataFrame(goals), ["a", "b"], "goals", alpha, scale)
    got = model.transform(spark.createDataFrame(goals)).orderBy("id").toPandas().goals_predicted
    expected = poisson_newton(goals[["a", "b"]], goals.goals.to_numpy(), alpha, scale)
    np.testing.assert_allclose(got, expected, rtol=1e-6)


def pool_adjacent(y, w):
    stack = []
    for value, weight in zip(y, w):
        stack.append([value, weight, 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            b, a = stack.pop(), stack.pop()
            total = a[1] + b[1]
            stack.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([[v] * n for v, _, n in stack])


def test_calibrator(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.uniform(0.2, 0.8, 500), 2)
    frame = pd.DataFrame({"p": p, "hit": (rng.random(500) < p**1.5).astype(int)})
    df = spark.createDataFrame(frame)
    model = models.calibrator(df, "p", "hit")
    got = models.calibrated(df.select("p").distinct(), model, "p", "c").orderBy("p").toPandas()
    pooled = frame.groupby("p").hit.agg(["mean", "count"])
    np.testing.assert_allclose(got.c, pool_adjacent(pooled["mean"], pooled["count"]), atol=1e-9)
    ends = models.calibrated(spark.createDataFrame([(0.0,), (1.0,)], "p double"), model, "p", "c").toPandas().c
    assert ends.min() == pytest.approx(got.c.min()) and ends.max() == pytest.approx(got.c.max())
    assert models.calibrator(df.filter("hit = 1"), "p", "hit") is None
    assert models.calibrator(df, "p", "hit", minimum=501) is None


def dense_gradient(frame, teams, attack, defense, advantage, rho):
    """Numerical gradient of the penalised loss."""
    index = {t: i for i, t in enumerate(teams)}
    h, a = frame.home_team.map(index).to_numpy(), frame.away_team.map(index).to_numpy()
    hg, ag, w = frame.home_goals.to_numpy(), frame.away_goals.to_numpy(), frame.weight.to_numpy()
    fact = np.array([1, 1, 2, 6, 24, 120, 720, 5040], float)

    def loss(v):
        att, dfn, adv, r = v[: len(teams)], v[len(teams) : -2], v[-2], v[-1]
        lam, mu = np.exp(att[h] + dfn[a] + adv), np.exp(att[a] + dfn[h])
        tau = np.ones(len(w))
        tau = np.where((hg == 0) & (ag == 0), 1 - lam * mu * r, tau)
        tau = np.where((hg == 0) & (ag == 1), 1 + lam * r, tau)
        tau = np.where((hg == 1) & (ag == 0), 1 + mu * r, tau)
        tau = np.where((hg == 1) & (ag == 1), 1 - r, tau)
        p = tau * np.exp(-lam - mu) * lam**hg * mu**ag / fact[hg] / fact[ag]
        return -(w * np.log(p)).sum() + 0.001 * ((att**2).sum() + (dfn**2).sum())

    v = np.concatenate([attack, defense, [advantage, rho]])
    return np.array([(loss(v + e) - loss(v - e)) / 2e-5 for e in np.eye(len(v)) * 1e-5])


def test_strengths(spark):
    rng = np.random.default_rng(8)
    n, teams = 500, list("abcdef")
    home = rng.integers(0, 6, n)
    away = (home + rng.integers(1, 6, n)) % 6
    skill = np.linspace(-0.4, 0.4, 6)
    frame = pd.DataFrame(
        {
            "home_team": [teams[i] for i in home], "away_team": [teams[i] for i in away],
            "home_goals": np.minimum(rng.poisson(np.exp(0.2 + skill[home] - skill[away] / 2)), 7),
            "away_goals": np.minimum(rng.poisson(np.exp(skill[away] - skill[home] / 2)), 7),
            "match_date": (pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 300, n), unit="D")).date,
        }
    )
    fitted = strengths.fit(spark.createDataFrame(frame), sweeps=20, tolerance=1e-6)
    table = fitted.teams.toPandas().set_index("team").loc[teams]
    assert abs(table.attack.sum()) < 1e-9 and abs(table.defense.sum()) < 1e-9
    latest = max(frame.match_date)
    frame["weight"] = [np.exp(-0.0018 * (latest - d).days) for d in frame.match_date]
    # undo the centring along the one direction left open (attack up, defense down changes nothing but the ridge)
    def level(shift):
        strength = (table.attack.to_numpy() + shift / 2, table.defense.to_numpy() + shift / 2)
        return *strength, dense_gradient(frame, teams, *strength, fitted.home_advantage, fitted.rho)

    low, high = -1.5, 1.5
    for _ in range(30):
        shift = (low + high) / 2
        low, high = (shift, high) if level(shift)[2][:-2].sum() < 0 else (low, shift)
    attack, defense, gradient = level(shift)
    assert fitted.converged and np.abs(gradient).max() < 0.05


def test_bundle_round_trip(spark, goals, tmp_path):
    df = spark.createDataFrame(goals)
    model = models.goal_regression(df, ["a", "b"], "goals")
    metrics = df.agg(F.avg("goals").alias("mean"))
    hits = df.select((F.col("goals") / 10).alias("p"), (F.col("goals") > 1).cast("int").alias("hit"))
    curve = models.calibrator(hits, "p", "hit")
    teams = spark.createDataFrame([("x", 0.1)], "team string, attack double")
    sinks.save_bundle(str(tmp_path / "bundle"), {"home": model}, ["a", "b"], metrics, curve, teams)
    again = sinks.load_calibrator(spark, str(tmp_path / "bundle"))
    assert again.boundaries == curve.boundaries and again.predictions == curve.predictions
    assert sinks.load_strengths(spark, str(tmp_path / "bundle")).collect() == teams.collect()
    sinks.save_bundle(str(tmp_path / "bare"), {"home": model}, ["a"])
    assert sinks.load_calibrator(spark, str(tmp_path / "bare")) is None and sinks.load_strengths(spark, str(tmp_path / "bare")) is None
    loaded, features = sinks.load_bundle(spark, str(tmp_path / "bundle"), ["home"])
    assert features == ["a", "b"]
    a = models.predict_goals(df, model, model).toPandas()
    b = models.predict_goals(df, loaded["home"], loaded["home"]).toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_boosted_goals(spark, goals):
    df = spark.createDataFrame(goals).withColumn("held_out", F.col("id") % 4 == 0)
    model = models.boosted_goals(df, ["a", "b"], "goals", "held_out", rounds=15, depth=3, rate=0.2)
    scored = model.transform(df).toPandas()
    assert ((scored.goals_predicted - scored.goals) ** 2).mean() < scored.goals.var()
    top = models.importances(model, ["a", "b"]).collect()
    assert sum(r.importance for r in top) == pytest.approx(1.0)


def test_boosting_goes_on_past_rounds_that_bring_nothing(spark, goals):
    errors = [5, 4, 4.5, 4.4, 3, 3.5, 3.4, 3.3, 1]
    assert models.best_round(errors, 3) == 5 and models.best_round(errors, 2) == 2 and models.best_round(errors, 50) == 9
    df = spark.range(300).selectExpr("double(id % 7) AS a", "double((id % 7) * (id % 7)) AS y", "id % 5 = 0 AS held")
    model = models.boosted_goals(df, ["a"], "y", "held", rounds=20, depth=2, rate=0.02, patience=3)
    assert model.stages[-1].getNumTrees == 20  # gains under a hundredth of the error do not end it
