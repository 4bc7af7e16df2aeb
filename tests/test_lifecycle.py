"""CSV folder to dataset to models to backtest, and the datasets against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchspark.operators import reshape
from matchspark.plans import datasets, lifecycle
from matchspark.sources import files


@pytest.fixture(scope="module")
def season_files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(21)
    frames = []
    for league in ("E0", "D1"):
        for year in (21, 22, 23):
            n = 110
            home = rng.integers(0, 8, n)
            away = (home + rng.integers(1, 8, n)) % 8
            frame = pd.DataFrame(
                {
                    "Date": pd.Timestamp(f"20{year}-08-01") + pd.to_timedelta(np.sort(rng.integers(0, 280, n)), unit="D"),
                    "HomeTeam": [f"{league}{i}" for i in home], "AwayTeam": [f"{league}{i}" for i in away],
                    "FTHG": rng.poisson(1.5, n), "FTAG": rng.poisson(1.1, n),
                }
            )
            for c in ("HS", "AS", "HST", "AST", "HC", "AC", "HF", "AF"):
                frame[c] = rng.integers(0, 15, n)
            frame["B365>2.5"] = np.round(rng.uniform(1.6, 2.6, n), 2)
            frame["P>2.5"] = np.round(rng.uniform(1.6, 2.6, n), 2)
            frame["B365<2.5"] = np.round(rng.uniform(1.5, 2.4, n), 2)
            frame = frame.drop_duplicates(["Date", "HomeTeam", "AwayTeam"])
            out = frame.assign(Date=frame.Date.dt.strftime("%d/%m/%Y"))
            out.to_csv(folder / f"{league}_{year}{year + 1}.csv", index=False)
            frames.append(frame.assign(league_code=league, season_code=f"{year}{year + 1}"))
    return str(folder), pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def dataset(spark, season_files):
    typed = files.typed_matches(files.match_folder(spark, season_files[0]))
    return datasets.domestic_dataset(typed, required=["home_avg_for_3", "away_avg_for_3"])


def test_domestic_dataset(dataset, season_files):
    raw = season_files[1].copy()
    raw["match_id"] = raw.league_code + "_" + raw.season_code + "_" + raw.Date.dt.strftime("%Y-%m-%d") + "_" + raw.HomeTeam + "_" + raw.AwayTeam
    raw = raw.sort_values(["Date", "match_id"])
    home = raw.rename(columns={"HomeTeam": "team", "FTHG": "gf", "FTAG": "ga", "HS": "sf", "HST": "st"}).assign(side="home")
    away = raw.rename(columns={"AwayTeam": "team", "FTAG": "gf", "FTHG": "ga", "AS": "sf", "AST": "st"}).assign(side="away")
    rows = pd.concat([d[["match_id", "Date", "team", "side", "gf", "ga", "sf", "st"]] for d in (home, away)]).sort_values(["team", "Date", "match_id"])
    rows["acc"] = rows.st / rows.sf.replace(0, np.nan)
    g = rows.groupby("team")
    rows["matches_played"] = g.cumcount()
    rows["avg_for_5"] = g.gf.transform(lambda s: s.shift(1).rolling(5, min_periods=1).mean())
    rows["ema_against_10"] = g.ga.transform(lambda s: s.shift(1).ewm(span=10, min_periods=1).mean())
    rows["avg_accuracy_10"] = g.acc.transform(lambda s: s.shift(1).rolling(10, min_periods=1).mean())
    rows["recent_shots_for"] = g.sf.transform(lambda s: s.shift(1).rolling(5, min_periods=1).sum())
    names = ["matches_played", "avg_for_5", "ema_against_10", "avg_accuracy_10", "recent_shots_for"]
    wide = {s: rows[rows.side == s].set_index("match_id")[names].add_prefix(f"{s}_") for s in ("home", "away")}
    expected = wide["home"].join(wide["away"])
    expected = expected[(expected.home_matches_played >= 5) & (expected.away_matches_played >= 5)].sort_index()
    raw["league"] = raw.groupby("league_code").FTHG.transform(lambda s: s.shift(1).expanding(min_periods=10).mean()).fillna(raw.FTHG.mean())
    got = dataset.toPandas().set_index("match_id").sort_index()
    assert list(got.index) == list(expected.index)
    np.testing.assert_allclose(got[expected.columns].astype(float), expected.astype(float), rtol=1e-9, atol=1e-12)
    by_id = raw.set_index("match_id").loc[got.index]
    np.testing.assert_allclose(got.league_avg_home_goals, by_id.league, rtol=1e-12)
    np.testing.assert_allclose(got.best_over_odds, by_id[["B365>2.5", "P>2.5"]].max(axis=1))


def test_train_predict_backtest(dataset):
    stored, features = lifecycle.split(dataset, "2223", "2324")
    assert "home_avg_conversion_5" in features and "home_team" not in features
    fitted = lifecycle.train(stored, features)
    assert fitted.calibrator is not None
    predicted = lifecycle.predict(stored, fitted)
    picked = lifecycle.signals(predicted)
    rows = picked.toPandas()
    assert len(rows) and (rows.edge >= 0.10).all() and rows.probability.between(0.35, 0.75).all() and (rows.stake_fraction <= 0.05).all()
    path = lifecycle.backtest(picked).toPandas().sort_values("trade")
    np.testing.assert_allclose(path.bankroll_after, 10_000 + path.profit.cumsum())
    assert list(path.trade) == list(range(len(path)))


def test_european_dataset(spark):
    df = spark.createDataFrame(
        [(1, "2024-09-10", "CL", "2024", "Group A", "Bayern Munich", "Porto", 2, 1), (2, "2024-09-20", "CL", "2024", "Group A", "Porto", "Bayern Munich", 0, 3),
         (3, "2024-10-20", "CL", "2024", "Semi-finals", "Bayern Munich", "Porto", 1, 1)],
        "match_id long, match_date string, competition_code string, season_code string, round string, home_team string, away_team string, home_goals long, away_goals long",
    ).withColumn("match_date", F.to_date("match_date"))
    league = spark.createDataFrame(
        [(f"d{i}", f"2024-09-{i:02d}", "Bayern", "Other FC", i % 4, 1) for i in range(1, 13)],
        "match_id string, match_date string, home_team string, away_team string, home_goals long, away_goals long",
    ).withColumn("match_date", F.to_date("match_date"))
    dom = reshape.participants(league, ["match_id", "match_date"], reshape.goal_sides()).drop("opponent")
    row = datasets.european_dataset(df, dom).first()
    assert row.match_id == 3 and row.is_knockout == 1 and row.stage_importance == 4
    assert row.home_european_matches == 2 and row.home_euro_avg_for_3 == 2.5 and row.home_euro_total_goals_for == 5.0
    assert row.home_dom_avg_for == np.mean([0, 1, 2, 3, 0]) and row.home_dom_total_games == 12
    assert row.away_dom_avg_for == pytest.approx(np.mean([2, 0, 1]))  # no domestic team: competition mean
    assert row.away_dom_home_pct == 0
