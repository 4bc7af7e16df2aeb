"""Fixtures scored by stored models: the same as by the models themselves, and cups with their fallbacks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchspark.plans import lifecycle, scoring
from matchspark.plans.lookups import latest_states
from matchspark.plans.series import match_features
from matchspark.plans.views import participants


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    stored, features = lifecycle.split(match_features(spark, sf_dir), scoring.VALIDATION, scoring.TEST, scoring.FORM)
    return lifecycle.train(stored, features)


def test_stored_models_score_alike(spark, sf_dir, fitted, tmp_path):
    lifecycle.save(fitted, str(tmp_path / "bundle"))
    loaded = lifecycle.load(spark, str(tmp_path / "bundle"))
    states, upcoming = latest_states(participants(spark, sf_dir)), scoring.upcoming_fixtures(spark, sf_dir)
    keys = ["league_code", "team"]
    frames = [scoring.score_fixtures_with(upcoming, states, keys, m).toPandas().set_index("fixture_id").sort_index() for m in (fitted, loaded)]
    pd.testing.assert_frame_equal(*frames)
    own = frames[0]
    assert own.pred_home.between(0.1, 5).all() and own.prob_over.between(0, 1).all()
    target = own[own.line == 2.5]
    np.testing.assert_allclose(target.prob_over, target.cal_over_prob.clip(1e-4, 1 - 1e-4))
    other = own[own.line == 3.5]
    lam = other.pred_total_goals.clip(0.1, 6)
    under = sum(np.exp(-lam) * lam**k / f for k, f in enumerate([1, 1, 2, 6]))
    np.testing.assert_allclose(other.prob_over, 1 - under, atol=1e-9)
    bets = scoring.fixture_signals(scoring.score_fixtures_with(upcoming, states, keys, fitted)).toPandas()
    assert (bets.edge >= 0.1).all() and (bets.stake <= 500).all() and bets.fixture_id.isin(own.index).all()


def test_queries_cover_all_fixtures(spark, sf_dir):
    from matchspark.plans import registered

    queries = registered()[0]
    cups = queries["score_european"](spark, sf_dir).toPandas()
    assert len(cups) == scoring.cup_fixtures(spark, sf_dir).count()
    assert (abs(cups.over_2_5_prob + cups.under_2_5_prob - 1) < 0.0011).all()
    assert (cups[["home_euro_experience", "away_euro_experience"]] >= 0).all().all()
    scored = queries["score_stored"](spark, sf_dir)
    assert scored.filter("stake is null and edge is not null").count() == 0 and scored.filter("stake > 0").count() > 0


def test_unknown_teams_and_cups_fall_back(spark):
    history = spark.createDataFrame(
        [(1, "2024-01-01", "CL", "x", "y", 3, 0, "Final"), (2, "2024-02-01", "CL", "x", "z", 1, 2, "Group A")],
        "match_id long, match_date string, competition_code string, home_team string, away_team string, home_goals long, away_goals long, round string",
    ).withColumn("match_date", F.to_date("match_date"))
    domestic = spark.createDataFrame([], "match_id long, match_date date, is_home boolean, team string, goals_for long, goals_against long")
    upcoming = spark.createDataFrame([(7, "CL", "Semi-finals", "x", "new"), (8, "EL", None, "new", "y")], "fixture_id long, competition_code string, round string, home_team string, away_team string")
    rows = {r["fixture_id"]: r for r in scoring.european_features(upcoming, history, domestic).collect()}
    first, second = rows[7], rows[8]
    assert (first["home_european_matches"], first["away_european_matches"], first["is_knockout"], first["is_final"]) == (2, 0, 1, 0)
    assert (first["home_euro_avg_for_3"], first["home_euro_total_goals_for"], first["comp_avg_away_goals"]) == (2.0, 4, 1.0)
    assert (first["away_euro_avg_for_5"], first["away_euro_ema_against_3"], first["away_dom_home_pct"]) == (1.0, 2.0, 0.5)
    assert (second["comp_avg_home_goals"], second["home_dom_avg_for"], second["home_dom_avg_against"]) == (1.5, 1.5, 1.2)
    assert (second["away_dom_avg_for"], second["away_euro_avg_against_3"], second["away_european_matches"]) == (1.2, 3.0, 1)
