"""Queries that fit models.

Fits themselves have no SQL; the ``…_balance`` queries return what a right fit must reproduce
from the data, which SQL computes: totals that the score equations tie to the goals scored.
The tests also hold the fits against dense solvers.
"""

from __future__ import annotations

import functools
import math
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.functions import conform
from matchspark.functions.poisson import clip
from matchspark.operators import bankroll, boosting, evaluation, models, strengths
from matchspark.plans import lifecycle
from matchspark.plans.catalog import query
from matchspark.plans.series import ROLLING_SQL, SERIES_WINDOW, match_features
from matchspark.plans.views import MATCHES_CTE, PARTICIPANTS_CTE, matches
from matchspark.session import shared_dir

VALIDATION, TEST = "1999", "2000"


def split_errors(df: DataFrame) -> DataFrame:
    aggregates = []
    for side in ("home", "away"):
        for name, value in evaluation.errors(F.col(f"pred_{side}"), F.col(f"{side}_goals")).items():
            aggregates.append(value.alias(f"{side}_{name}"))
    return df.groupBy("dataset_split").agg(F.count(F.lit(1)).alias("n"), *aggregates)


@query("glm_poisson")
def glm_poisson(spark, sf_dir):
    stored, features = lifecycle.split(match_features(spark, sf_dir), VALIDATION, TEST)
    train = stored.filter(F.col("dataset_split") == "train")
    fitted = {s: models.goal_regression(train, features, f"{s}_goals") for s in ("home", "away")}
    return split_errors(models.predict_goals(stored, fitted["home"], fitted["away"]))


@query("isotonic_cal")
def isotonic_cal(spark, sf_dir):
    """Raw and calibrated over 2.5 probability of every match."""
    stored, features = lifecycle.split(match_features(spark, sf_dir), VALIDATION, TEST)
    result = lifecycle.predict(stored, lifecycle.train(stored, features))
    return result.select("match_id", "dataset_split", "pred_home", "pred_away", "over_prob", "cal_over_prob")


@query("model_backtest")
def model_backtest(spark, sf_dir):
    """Train, predict, pick, settle: summary of each league's bankroll on the test seasons."""
    stored, features = lifecycle.split(match_features(spark, sf_dir), VALIDATION, TEST)
    predicted = lifecycle.predict(stored, lifecycle.train(stored, features))
    prices = matches(spark, sf_dir).select(
        "match_id", F.col("over_odds").alias("best_over_odds"), F.col("under_odds").alias("best_under_odds"), F.lit(2.5).alias("market_total_line")
    )
    total = F.col("home_goals") + F.col("away_goals")
    picked = lifecycle.signals(predicted.join(prices, "match_id").withColumn("total_goals", total))
    return bankroll.summary(lifecycle.backtest(picked, F.col("league_code")), "portfolio")


@query("strengths_fit")
def strengths_fit(spark, sf_dir):
    recent = conform.within_days_of_latest(matches(spark, sf_dir), "match_date", 3 * 365)
    fitted = strengths.fit(recent, tolerance=1e-3)
    whole = {"home_advantage": fitted.home_advantage, "rho": fitted.rho, "converged": fitted.converged}
    return fitted.teams.select("*", *[F.lit(v).alias(k) for k, v in whole.items()])


@query("gbt_goals")
def gbt_goals(spark, sf_dir):
    """Boosted Poisson trees, stopped by the validation season: errors of each split."""
    stored, features = lifecycle.split(match_features(spark, sf_dir), VALIDATION, TEST)
    seen = stored.filter(F.col("dataset_split") != "test").withColumn("held_out", F.col("dataset_split") == "validation")
    home, away = boosting.fit(seen, features, ["home_goals", "away_goals"], "held_out")
    expected = {f"pred_{side}": clip(boosting.expected(m), 0.1, 5.0) for side, m in (("home", home), ("away", away))}
    return split_errors(stored.withColumns(expected))


STUMP_FEATURES = ["over_odds", "under_odds", "month", "day"]
STUMP_LEAF = 20


def stump_rounds(rounds: int) -> str:
    """CTEs of boosting rounds of one split, by trying every value of every feature as a cut."""
    parts = [f"""{MATCHES_CTE}, side AS (SELECT match_id, match_date, over_odds, under_odds, 'home_goals' AS label, home_goals AS y FROM matches
      UNION ALL SELECT match_id, match_date, over_odds, under_odds, 'away_goals', away_goals FROM matches),
    score0 AS (SELECT label, match_id, y, ln(avg(y) OVER (PARTITION BY label)) AS s FROM side),
    cell AS (SELECT label, match_id, unnest(['over_odds', 'under_odds', 'month', 'day']) AS feature, unnest([0, 1, 2, 3]) AS nth,
      unnest([over_odds, under_odds, month(match_date)::DOUBLE, day(match_date)::DOUBLE]) AS x FROM side)"""]
    soft = "(sign({0}) * greatest(abs({0}) - 0.1e0, 0)) ** 2 / ({1} + 1)"
    value = "0.05e0 * greatest(least(-sign({0}) * greatest(abs({0}) - 0.1e0, 0) / ({1} + 1), 0.7e0), -0.7e0)"
    for r in range(rounds):
        parts.append(f"""slope{r} AS (SELECT label, match_id, exp(s) - y AS g, exp(s) AS h FROM score{r}),
    total{r} AS (SELECT label, sum(g) AS gt, sum(h) AS ht, count(*) AS nt FROM slope{r} GROUP BY 1),
    bin{r} AS (SELECT label, feature, nth, x, sum(g) AS g, sum(h) AS h, count(*) AS n FROM cell JOIN slope{r} USING (label, match_id) GROUP BY ALL),
    left{r} AS (SELECT label, feature, nth, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl FROM bin{r}
      WINDOW w AS (PARTITION BY label, feature ORDER BY x NULLS FIRST)),
    best{r} AS (SELECT * FROM (SELECT *, 0.5e0 * ({soft.format('gl', 'hl')} + {soft.format('(gt - gl)', '(ht - hl)')} - {soft.format('gt', 'ht')}) AS gain
      FROM left{r} JOIN total{r} USING (label) WHERE nl >= {STUMP_LEAF} AND nt - nl >= {STUMP_LEAF})
      WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY gain DESC, nth, x NULLS FIRST) = 1),
    leaf{r} AS (SELECT label, 0 AS node, feature, x AS threshold, {value.format('gt', 'ht')} AS value, gain, nt AS n FROM best{r}
      UNION ALL SELECT label, 1, NULL, NULL, {value.format('gl', 'hl')}, 0, nl FROM best{r}
      UNION ALL SELECT label, 2, NULL, NULL, {value.format('(gt - gl)', '(ht - hl)')}, 0, nt - nl FROM best{r}),
    score{r + 1} AS (SELECT label, match_id, y, s + leaf{r}.value AS s FROM score{r} JOIN best{r} USING (label) JOIN cell USING (label, match_id, feature)
      JOIN leaf{r} ON leaf{r}.label = score{r}.label AND leaf{r}.node = CASE WHEN cell.x IS NULL OR cell.x <= best{r}.x THEN 1 ELSE 2 END)""")
    return ", ".join(parts)


def stumps(spark, sf_dir) -> list[boosting.Boosted]:
    """Three rounds of one split on all matches, for both sides' goals."""
    days = {"month": F.month("match_date"), "day": F.dayofmonth("match_date")}
    settings = boosting.Settings(rounds=3, depth=1, leaf=STUMP_LEAF, subsample=1.0, columns=1.0, bins=128)
    return boosting.fit(matches(spark, sf_dir).withColumns(days), STUMP_FEATURES, ["home_goals", "away_goals"], settings=settings)


@query(
    "gbt_stumps",
    f"WITH {stump_rounds(3)} " + " UNION ALL ".join(
        f"SELECT label, {r} AS tree, node, feature, threshold, round(value, 7) AS value, round(gain, 5) AS gain, n::BIGINT AS n FROM leaf{r}" for r in range(3)
    ),
)
def gbt_stumps(spark, sf_dir):
    """Every split, gain and leaf value."""
    return boosting.nodes(spark, stumps(spark, sf_dir)).withColumns({"value": F.round("value", 7), "gain": F.round("gain", 5)})


@query(
    "gbt_importances",
    f"WITH {stump_rounds(3)}, s AS (" + " UNION ALL ".join(f"SELECT label, feature, gain FROM leaf{r} WHERE feature IS NOT NULL" for r in range(3)) + """)
    SELECT label, feature, round(sum(gain), 4) AS gain, count(*) AS splits FROM s GROUP BY ALL""",
)
def gbt_importances(spark, sf_dir):
    """The features that split, by their gains, of models that were written and read back."""
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    boosting.save(spark, stumps(spark, sf_dir), path)
    return boosting.importances(spark, list(boosting.load(spark, path).values())).withColumn("gain", F.round("gain", 4))


PLAYED_CTE = f"""{PARTICIPANTS_CTE}, played AS (
      SELECT match_id, is_home, season_code, goals_for, row_number() OVER (PARTITION BY team ORDER BY match_date, match_id) - 1 AS before FROM participants),
    fitted AS (SELECT h.match_id, h.goals_for AS home_goals, a.goals_for AS away_goals, h.season_code FROM played h JOIN played a ON h.match_id = a.match_id AND h.is_home AND NOT a.is_home
      WHERE h.before >= 5 AND a.before >= 5)"""


@query(
    "glm_balance",
    f"""WITH {PLAYED_CTE} SELECT side, count(*) AS n, round(avg(goals), 5) AS mean_goals
    FROM (SELECT 'home' AS side, home_goals AS goals, season_code FROM fitted UNION ALL SELECT 'away', away_goals, season_code FROM fitted)
    WHERE season_code < '{VALIDATION}' GROUP BY 1""",
)
def glm_balance(spark, sf_dir):
    """Mean prediction on the training rows: the intercept is not penalised, so it equals the mean of the goals."""
    stored, features = lifecycle.split(match_features(spark, sf_dir), VALIDATION, TEST)
    rows = stored.filter(F.col("dataset_split") == "train")
    means = []
    for side in ("home", "away"):
        scored = models.goal_regression(rows, features, f"{side}_goals").transform(rows)
        mean = F.round(F.avg(f"{side}_goals_predicted"), 5).alias("mean_goals")
        means.append(scored.agg(F.count(F.lit(1)).alias("n"), mean).select(F.lit(side).alias("side"), "n", "mean_goals"))
    return means[0].union(means[1])


SCORED = [f"{s}_{n}" for s in ("home", "away") for n in ("avg_for_5", "avg_against_5", "avg_diff_10")]


@query(
    "glm_scores",
    f"""WITH {PARTICIPANTS_CTE}, f AS (
      SELECT match_id, team, is_home, row_number() OVER w - 1 AS matches_played, {ROLLING_SQL} FROM participants {SERIES_WINDOW}),
    wide AS (SELECT m.home_goals, m.away_goals, {", ".join(f"{n[0]}.{n[5:]} AS {n}" for n in SCORED)}
      FROM matches m JOIN f h ON h.match_id = m.match_id AND h.is_home JOIN f a ON a.match_id = m.match_id AND NOT a.is_home
      WHERE h.matches_played >= 5 AND a.matches_played >= 5 AND m.season_code < '{VALIDATION}'),
    z AS (SELECT home_goals, away_goals, {", ".join(f"({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER () AS {n}" for n in SCORED)} FROM wide)
    """ + " UNION ALL ".join(
        f"SELECT '{s}' AS side, '{n}' AS feature, round(sum({s}_goals * {n}), 3) AS score FROM z" for s in ("home", "away") for n in SCORED
    ),
)
def glm_scores(spark, sf_dir):
    """For each feature in units of its deviation, its sum over the goals as the fit has it: expected goals plus the penalty's pull."""
    stored, _ = lifecycle.split(match_features(spark, sf_dir), VALIDATION, TEST)
    rows = stored.filter(F.col("dataset_split") == "train")
    n, found = rows.count(), []
    for side in ("home", "away"):
        model = models.goal_regression(rows, SCORED, f"{side}_goals")
        unit = math.sqrt(n / (n - 1))  # the scaler divides by the sample deviation
        scored = model.transform(rows).select(vector_to_array("scaled_features").alias("z"), F.col(f"{side}_goals_predicted").alias("p"))
        sums = scored.agg(*[F.sum(F.get("z", F.lit(i)) * F.col("p") * unit).alias(c) for i, c in enumerate(SCORED)])
        for c, beta in zip(SCORED, model.stages[-1].coefficients):
            pull = float(0.01 * n * beta / unit)
            found.append(sums.select(F.lit(side).alias("side"), F.lit(c).alias("feature"), F.round(F.col(c) + pull, 3).alias("score")))
    return functools.reduce(DataFrame.unionAll, found)


@query(
    "isotonic_curve",
    f"""WITH {MATCHES_CTE}, pooled AS (
      SELECT round(1 / over_odds, 6) AS p, avg(CAST(home_goals + away_goals > 2.5 AS INT)) AS y, count(*) AS w FROM matches WHERE over_odds IS NOT NULL GROUP BY 1),
    summed AS (SELECT row_number() OVER (ORDER BY p) AS i, p, sum(w) OVER (ORDER BY p) AS ws, sum(w * y) OVER (ORDER BY p) AS s, w, w * y AS t FROM pooled),
    span AS (SELECT a.i AS first, b.i AS last, (b.s - a.s + a.t) / (b.ws - a.ws + a.w) AS mean FROM summed a JOIN summed b ON a.i <= b.i),
    least AS (SELECT first, i, min(mean) AS low FROM span JOIN summed ON i BETWEEN first AND last GROUP BY 1, 2)
    SELECT p, max(w)::BIGINT AS n, round(max(low), 6) AS calibrated FROM least JOIN summed USING (i) GROUP BY p""",
)
def isotonic_curve(spark, sf_dir):
    """The calibrated probability of over 2.5 for each price: means of the blocks that pooling leaves."""
    total = F.col("home_goals") + F.col("away_goals")
    priced = matches(spark, sf_dir).filter("over_odds is not null").select(F.round(1 / F.col("over_odds"), 6).alias("p"), (total > 2.5).cast("int").alias("over"))
    counted = priced.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    curve = models.calibrated(counted, models.calibrator(priced, "p", "over"), "p", "calibrated")
    return curve.withColumn("calibrated", F.round("calibrated", 6))


@query(
    "isotonic_balance",
    f"""WITH {PLAYED_CTE} SELECT count(*) AS n, round(avg(CAST(home_goals + away_goals > 2.5 AS INT)), 5) AS mean_over FROM fitted WHERE season_code = '{VALIDATION}'""",
)
def isotonic_balance(spark, sf_dir):
    """Mean calibrated probability on the calibration rows: pooling keeps the share of outcomes."""
    stored, features = lifecycle.split(match_features(spark, sf_dir), VALIDATION, TEST)
    scored = lifecycle.predict(stored.filter(F.col("dataset_split") == "validation"), lifecycle.train(stored, features))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cal_over_prob"), 5).alias("mean_over"))


@query(
    "strengths_balance",
    f"""WITH {MATCHES_CTE}, recent AS (SELECT * FROM matches WHERE match_date >= (SELECT max(match_date) FROM matches) - 1095),
    w AS (SELECT *, exp(-0.0018e0 * date_diff('day', match_date, max(match_date) OVER ())) AS weight FROM recent)
    SELECT team, round(sum(weight * goals), 3) AS expected
    FROM (SELECT home_team AS team, weight, home_goals AS goals FROM w UNION ALL SELECT away_team, weight, away_goals FROM w) GROUP BY 1""",
)
def strengths_balance(spark, sf_dir):
    """Weighted goals the fitted strengths give each team: those it scored."""
    recent = conform.within_days_of_latest(matches(spark, sf_dir), "match_date", 3 * 365)
    expected = strengths.expected_for(strengths.fit(recent, tolerance=1e-9))
    return expected.select("team", F.round("expected", 3).alias("expected"))


@query(
    "score_upcoming",
    f"""WITH {PLAYED_CTE} SELECT dataset_split, count(*) AS n, count(*) AS priced, CASE WHEN dataset_split = 'train' THEN round(avg(home_goals), 4) END AS mean_home, CASE WHEN dataset_split = 'train' THEN round(avg(away_goals), 4) END AS mean_away
    FROM (SELECT *, CASE WHEN season_code >= '{TEST}' THEN 'test' WHEN season_code = '{VALIDATION}' THEN 'validation' ELSE 'train' END AS dataset_split FROM fitted) GROUP BY 1""",
)
def score_upcoming(spark, sf_dir):
    """Models, features and calibrator written, read back and applied to every match, with all outcome columns.

    Rows whose outcomes add up to one are counted; on the training rows unclipped predictions average to the goals.
    """
    path = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    stored, features = lifecycle.split(match_features(spark, sf_dir), VALIDATION, TEST)
    lifecycle.save(lifecycle.train(stored, features), path)
    fitted = lifecycle.load(spark, path)
    scored = lifecycle.predict_outcomes(stored, fitted)
    for side in ("home", "away"):
        model = getattr(fitted, side)
        scored = model.transform(scored).drop("raw_features", "scaled_features")
    whole = F.abs(F.col("home_win") + F.col("draw") + F.col("away_win") - 1) < 0.05
    priced = whole & F.col("cal_over_prob").between(0, 1) & (F.abs(F.col("over_2_5") + F.col("under_2_5") - 1) < 0.05)
    means = {s: F.when(F.col("dataset_split") == "train", F.round(F.avg(f"{s}_goals_predicted"), 4)).alias(f"mean_{s}") for s in ("home", "away")}
    return scored.groupBy("dataset_split").agg(F.count(F.lit(1)).alias("n"), F.count_if(priced).alias("priced"), *means.values())
