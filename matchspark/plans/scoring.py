"""Fixtures scored with stored models: domestic leagues, and European cups with their fallbacks."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions import conform, poisson, staking
from matchspark.operators import joins, models, names, reshape, sequences
from matchspark.plans import lifecycle
from matchspark.plans.catalog import query, table
from matchspark.plans.conforming import ROUNDS
from matchspark.plans.datasets import EURO_FORM, EURO_TOTALS, european_dataset
from matchspark.plans.fits import PLAYED_CTE, TEST, VALIDATION
from matchspark.plans.lookups import (
    DOMESTIC_FORM,
    DOMESTIC_STATE,
    FIXTURES_CTE,
    domestic,
    fixtures,
    latest_states,
    with_domestic_form,
)
from matchspark.plans.prices import sql_cdf
from matchspark.plans.series import _ewma_sql, match_features
from matchspark.plans.views import PARTICIPANTS_CTE, SERIES_ORDER, matches, participants
from matchspark.session import cut, shared_dir

FORM = [f"{side}_avg_{kind}_5" for side in ("home", "away") for kind in ("for", "against")]


def score_fixtures_with(
    upcoming: DataFrame, states: DataFrame, keys: Sequence[str], fitted: lifecycle.GoalModels, rules: staking.Rules = staking.Rules()
) -> DataFrame:
    """Every fixture whose teams both have a state, with expected goals and the probabilities of its line.

    ``upcoming`` has ``home_team, away_team, line`` and ``over_odds, under_odds``; ``states`` each team's newest row
    with the features of ``fitted`` without their side. On the target line probabilities are calibrated.
    """
    features = sorted({f.split("_", 1)[1] for f in fitted.features})
    joined = joins.latest_for_fixtures(upcoming, states.select(*keys, *features), keys, features)
    scored = lifecycle.predict(joined, fitted)
    under = poisson.single_rate_under(F.col("line"), F.col("pred_total_goals"))
    on_target = F.abs(F.col("line") - rules.target_line) < 1e-6
    over = F.coalesce(F.when(on_target, poisson.clip(F.col("cal_over_prob"), 1e-4, 1 - 1e-4)), 1.0 - under)
    whole = scored.withColumn("prob_over", over).withColumn("prob_under", 1.0 - F.col("prob_over"))
    return whole.select(
        *upcoming.columns, "pred_home", "pred_away", "pred_total_goals", "cal_over_prob", "cal_under_prob", "prob_over", "prob_under"
    )


def fixture_signals(scored: DataFrame, rules: staking.Rules = staking.Rules()) -> DataFrame:
    """The bets among scored fixtures, with their stakes."""
    return staking.pick_signals(scored.drop("prob_over", "prob_under"), rules)


def upcoming_fixtures(spark, sf_dir) -> DataFrame:
    """Fixtures with prices, a third of them on the line 3.5."""
    key = F.col("fixture_id")
    return fixtures(spark, sf_dir).withColumns(
        {
            "line": F.when(key % 3 == 0, 3.5).otherwise(2.5),
            "over_odds": F.lit(1.4) + (key % 13) / 10.0,
            "under_odds": F.when(key % 5 > 0, F.lit(1.5) + (key % 11) / 10.0),
        }
    )


def _scored(spark, sf_dir, dataset: DataFrame, features: list[str], states: DataFrame) -> DataFrame:
    """All fixtures by models and a calibrator that were fitted, written and read back."""
    path = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    stored, _ = lifecycle.split(dataset, VALIDATION, TEST, features)
    lifecycle.save(lifecycle.train(stored, features), path)
    fitted = lifecycle.load(spark, path)
    return cut(score_fixtures_with(upcoming_fixtures(spark, sf_dir), states, ["league_code", "team"], fitted), "scored")


@query("score_stored")
def score_stored(spark, sf_dir):
    """Predictions of all fixtures by a stored model, with the bet where there is one."""
    scored = _scored(spark, sf_dir, match_features(spark, sf_dir), FORM, latest_states(participants(spark, sf_dir)))
    bets = fixture_signals(scored).select("fixture_id", "selection", "edge", "stake")
    shown = scored.select("fixture_id", "pred_home", "pred_away", "line", "prob_over", "prob_under")
    return shown.join(bets, "fixture_id", "left")


PRICED_SQL = "CASE WHEN {p} BETWEEN 0.35e0 AND 0.75e0 AND {p} * {o} - 1 >= 0.1e0 THEN {p} * {o} - 1 END"


@query(
    "score_stored_means",
    f"""WITH {PLAYED_CTE}, {FIXTURES_CTE}, x AS (SELECT *, CASE WHEN fixture_id % 3 = 0 THEN 3.5e0 ELSE 2.5e0 END AS line, 1.4e0 + (fixture_id % 13) / 10e0 AS over_odds,
        CASE WHEN fixture_id % 5 > 0 THEN 1.5e0 + (fixture_id % 11) / 10e0 END AS under_odds FROM fixtures),
    t AS (SELECT DISTINCT league_code, team FROM participants),
    m AS (SELECT avg(home_goals) AS h, avg(away_goals) AS a FROM fitted WHERE season_code < '{VALIDATION}'),
    c AS (SELECT avg(CAST(home_goals + away_goals > 2.5 AS INT)) AS over FROM fitted WHERE season_code = '{VALIDATION}'),
    p AS (SELECT x.*, m.h, m.a, CASE WHEN line = 2.5 THEN c.over ELSE 1 - ({sql_cdf(3, 'least(m.h + m.a, 6e0)')}) END AS prob_over
      FROM x, m, c WHERE (league_code, home_team) IN (SELECT * FROM t) AND (league_code, away_team) IN (SELECT * FROM t)),
    e AS (SELECT *, {PRICED_SQL.format(p='prob_over', o='over_odds')} AS eo, {PRICED_SQL.format(p='(1 - prob_over)', o='under_odds')} AS eu FROM p),
    s AS (SELECT *, CASE WHEN coalesce(eo >= eu, eu IS NULL) THEN 'Over' ELSE 'Under' END AS selection, greatest(eo, eu) AS edge FROM e)
    SELECT fixture_id, line, round(h, 4) AS pred_home, round(a, 4) AS pred_away, round(prob_over, 4) AS prob_over,
      CASE WHEN edge IS NOT NULL THEN selection END AS selection, round(edge, 4) AS edge,
      CASE WHEN edge IS NOT NULL THEN round(10000 * least(0.15e0 * edge / (CASE WHEN selection = 'Over' THEN over_odds ELSE under_odds END - 1), 0.05e0), 1) END AS stake FROM s""",
)
def score_stored_means(spark, sf_dir):
    """The same with a feature that never varies, so models are means of the goals and all have one calibrated probability."""
    constant = {f"{side}_constant": F.lit(1.0) for side in ("home", "away")}
    states = latest_states(participants(spark, sf_dir)).withColumn("constant", F.lit(1.0))
    scored = _scored(spark, sf_dir, match_features(spark, sf_dir).withColumns(constant), list(constant), states)
    bets = fixture_signals(scored).select("fixture_id", "selection", F.round("edge", 4).alias("edge"), F.round("stake", 1).alias("stake"))
    rounded = {c: F.round(c, 4) for c in ("pred_home", "pred_away", "prob_over")}
    return scored.select("fixture_id", "line", "pred_home", "pred_away", "prob_over").withColumns(rounded).join(bets, "fixture_id", "left")


# --- European cups

# Goals of a competition without history, home, away and in all.
NO_HISTORY = {"comp_avg_home_goals": 1.5, "comp_avg_away_goals": 1.2, "comp_avg_total_goals": 2.7}
EURO_FEATURES = ["european_matches", *EURO_FORM, *EURO_TOTALS, "dom_total_games", *DOMESTIC_FORM]
LAST_DAY = "9999-12-31"


def european_features(upcoming: DataFrame, history: DataFrame, domestic_rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Feature row of each fixture ``fixture_id, competition_code, round, home_team, away_team``.

    ``history`` has the European matches played. Form is that after a team's last match. Without European or enough
    domestic matches a side has the competition's means, its own goals for and the other's against; shares of home
    matches are then a half and counts nought. A competition without history has fixed means.
    """
    goals = {"home": F.col("home_goals"), "away": F.col("away_goals")}
    goals["total"] = goals["home"] + goals["away"]
    means = history.groupBy("competition_code").agg(*[F.avg(v).alias(f"comp_avg_{k}_goals") for k, v in goals.items()])
    rated = upcoming.join(means, "competition_code", "left").fillna(NO_HISTORY)
    flags = conform.stage(F.col("round"))
    rated = rated.withColumns({k: (v if k != "stage_importance" else F.lit(1)).cast("int") for k, v in flags.items()})
    shared = ["fixture_id", "competition_code", *NO_HISTORY, *flags]
    sides = cut(reshape.participants(rated, shared, {"team": ("home_team", "away_team")}), "sides")
    # a row after the last match of each team: what the series holds before it is the state after that match
    rows = reshape.participants(history, ["match_id", "match_date"], reshape.goal_sides()).select("team", "match_date", "match_id", "goals_for", "goals_against")
    last = sides.select("team", F.lit(LAST_DAY).cast("date").alias("match_date")).distinct()
    rows = rows.unionByName(last, allowMissingColumns=True).withColumn("match_id", F.coalesce("match_id", F.lit(-1)))
    totals = {f"euro_total_{c}": sequences.sum_of(F.col(c)) for c in ("goals_for", "goals_against")}
    summed = sequences.running(rows, ["team"], SERIES_ORDER, F.col("match_date"), {"european_matches": sequences.rows_before(), **totals})
    trailing = {f"euro_avg_{m}_{w}": sequences.trailing_mean(f"goals_{m}", w) for w in (3, 5) for m in ("for", "against")}
    weighted = {f"euro_ema_{m}_{w}": (f"goals_{m}", w) for w in (3, 5) for m in ("for", "against")}
    formed = sequences.form(summed, ["team"], "european_matches", trailing, weighted)
    euro = formed.filter(F.col("match_date") == F.lit(LAST_DAY).cast("date")).select("team", "european_matches", *EURO_FORM, *EURO_TOTALS)
    asked = cut(sides.join(euro, "team", "left").withColumn("match_date", F.lit(LAST_DAY).cast("date")), "asked")
    own = F.col("team")
    if aliases is not None:
        known = names.resolve(asked.select(own.alias("name")), domestic_rows.select(F.col("team").alias("target")), aliases)
        asked = asked.join(known.select(F.col("name").alias("team"), F.col("target").alias("domestic_team")), "team", "left")
        asked = asked.withColumnsRenamed({"team": "european_team", "domestic_team": "team"})
    found = with_domestic_form(asked, domestic_rows)
    at_home = F.col("is_home")
    scored = F.when(at_home, F.col("comp_avg_home_goals")).otherwise(F.col("comp_avg_away_goals"))
    conceded = F.when(at_home, F.col("comp_avg_away_goals")).otherwise(F.col("comp_avg_home_goals"))

    def fallback(name: str) -> Column:
        if name in EURO_TOTALS or name in ("european_matches", "dom_total_games"):
            return F.lit(0)
        if name == "dom_home_pct":
            return F.lit(0.5)
        return scored if "for" in name else conceded

    filled = found.withColumns({c: F.coalesce(F.col(c), fallback(c)) for c in EURO_FEATURES})
    return reshape.back_to_matches(filled, shared, EURO_FEATURES)


def train_european(dataset: DataFrame, validation: str, test: str, alpha: float = 1.0) -> lifecycle.GoalModels:
    """Unscaled models on the European features that vary, and their calibrator."""
    features = conform.feature_columns(dataset.columns, conform.EUROPEAN_PREFIXES, conform.EUROPEAN_NAMES)
    stored, varying = lifecycle.split(dataset, validation, test, features)
    return lifecycle.train(stored, varying, alpha, scale=False)


def score_european_with(features: DataFrame, fitted: lifecycle.GoalModels) -> DataFrame:
    """Rounded predictions of the fixtures, with each side's number of European matches."""
    scored = lifecycle.predict(features, fitted)
    over = F.coalesce("cal_over_prob", "over_prob")
    return scored.select(
        "fixture_id", "competition_code", F.round("pred_home", 2).alias("pred_home_goals"), F.round("pred_away", 2).alias("pred_away_goals"),
        F.round("pred_total_goals", 2).alias("pred_total_goals"), F.round(over, 3).alias("over_2_5_prob"), F.round(1 - over, 3).alias("under_2_5_prob"),
        F.col("home_european_matches").alias("home_euro_experience"), F.col("away_european_matches").alias("away_euro_experience"),
    )


CUPS = ("L0", "L1", "L2")


def club(number: Column) -> Column:
    """A team's name in domestic tables."""
    return F.concat(F.lit("club "), F.lpad(number.cast("string"), 3, "0"))


def abroad(number: Column) -> Column:
    """Its name in European ones: the same, a longer one, or an alias."""
    return F.when(number % 3 == 0, club(number)).when(number % 3 == 1, F.concat(club(number), F.lit(" united"))).otherwise(F.concat(F.lit("k-"), number.cast("string")))


def club_aliases(spark) -> DataFrame:
    number = F.col("id")
    return spark.range(150).select(abroad(number).alias("raw"), club(number).alias("canonical"), F.lit(0).alias("rank"))


def cup_history(spark, sf_dir) -> DataFrame:
    df = matches(spark, sf_dir).drop("over_odds", "under_odds").filter(F.col("league_code").isin(*CUPS))
    rounds = F.array(*[F.lit(r) for r in ROUNDS])
    named = df.withColumn("round", F.get(rounds, (F.col("match_id") % 7).cast("int"))).withColumnRenamed("league_code", "competition_code")
    return named.withColumns({f"{s}_team": abroad(F.col(f"{s}_team")) for s in ("home", "away")})


def cup_domestic(spark, sf_dir) -> DataFrame:
    rows = reshape.participants(domestic(spark, sf_dir), ["match_id", "match_date"], reshape.goal_sides()).drop("opponent")
    return rows.withColumn("team", club(F.col("team")))


def cup_fixtures(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    rounds = F.array(*[F.lit(r) for r in ROUNDS])
    rows = table(spark, sf_dir, "customer").select(
        key.alias("fixture_id"), F.concat(F.lit("L"), (key % 5).cast("string")).alias("competition_code"),
        F.coalesce(F.get(rounds, (key % 7).cast("int")), F.lit("")).alias("round"),
        (key % 150).alias("home"), ((key * 11 + 5) % 150).alias("away"),
    )
    named = {f"{s}_team": abroad(F.col(s)) for s in ("home", "away")}
    return rows.filter(F.col("home") != F.col("away")).withColumns(named).drop("home", "away")


def cup_features(spark, sf_dir) -> DataFrame:
    return european_features(cup_fixtures(spark, sf_dir), cup_history(spark, sf_dir), cup_domestic(spark, sf_dir), club_aliases(spark))


def _fallback_sql(name: str, alias: str, home: bool) -> str:
    value = f"{alias}.{name}"
    if name in EURO_TOTALS or name in ("european_matches", "dom_total_games"):
        return f"coalesce({value}, 0)"
    if name == "dom_home_pct":
        return f"coalesce({value}, 0.5e0)"
    own, other = ("ch", "ca") if home else ("ca", "ch")
    return f"coalesce({value}, {own if 'for' in name else other})"


_EURO_STATE = ", ".join(
    [f"list_avg(past_{m}[1:{w}]) AS euro_avg_{m}_{w}" for w in (3, 5) for m in ("for", "against")]
    + [_ewma_sql(f"euro_ema_{m}_{w}", f"past_{m}[1:200]", w, 200) for w in (3, 5) for m in ("for", "against")]
    + [f"list_sum(past_{m}) AS euro_total_goals_{m}" for m in ("for", "against")]
)
CUP_CTE = f"""{PARTICIPANTS_CTE}, {DOMESTIC_STATE},
    d AS (SELECT team, {", ".join(f"CASE WHEN dom_total_games >= 3 THEN {c} END AS {c}" for c in ["dom_total_games", *DOMESTIC_FORM])} FROM dom_last
      QUALIFY row_number() OVER (PARTITION BY team ORDER BY match_date DESC) = 1),
    l AS (SELECT team, count(*) AS european_matches, list(CAST(goals_for AS DOUBLE) ORDER BY match_date DESC, match_id DESC) AS past_for,
      list(CAST(goals_against AS DOUBLE) ORDER BY match_date DESC, match_id DESC) AS past_against FROM participants WHERE league_code IN {CUPS} GROUP BY team),
    e AS (SELECT team, european_matches, {_EURO_STATE} FROM l),
    c AS (SELECT league_code, avg(home_goals) AS h, avg(away_goals) AS a, avg(home_goals + away_goals) AS t FROM matches WHERE league_code IN {CUPS} GROUP BY 1),
    x AS (SELECT c_custkey AS fixture_id, CONCAT('L', CAST(c_custkey % 5 AS VARCHAR)) AS competition_code, c_custkey % 150 AS home, (c_custkey * 11 + 5) % 150 AS away,
      CASE c_custkey % 7 {" ".join(f"WHEN {i} THEN lower('{r}')" for i, r in enumerate(ROUNDS))} ELSE '' END AS r FROM customer),
    y AS (SELECT x.*, coalesce(h, 1.5e0) AS ch, coalesce(a, 1.2e0) AS ca, coalesce(t, 2.7e0) AS ct FROM x LEFT JOIN c ON c.league_code = competition_code WHERE home <> away),
    cups AS (SELECT fixture_id, competition_code, ch AS comp_avg_home_goals, ca AS comp_avg_away_goals, ct AS comp_avg_total_goals,
      CAST(contains(r, 'group') AS INT) AS is_group_stage, CAST(contains(r, '16') OR contains(r, 'quarter') OR contains(r, 'semi') OR contains(r, 'final') AS INT) AS is_knockout,
      CAST(contains(r, 'final') AND NOT contains(r, 'semi') AS INT) AS is_final, 1 AS stage_importance,
      {", ".join(f"{_fallback_sql(n, ('e' if n in EURO_FEATURES[:1] + EURO_FORM + EURO_TOTALS else 'd') + s[0], s == 'home')} AS {s}_{n}" for s in ("home", "away") for n in EURO_FEATURES)}
      FROM y LEFT JOIN e eh ON eh.team = home LEFT JOIN e ea ON ea.team = away LEFT JOIN d dh ON dh.team = home LEFT JOIN d da ON da.team = away)"""
CUP_COLUMNS = [*NO_HISTORY, *[f"{s}_{n}" for s in ("home", "away") for n in EURO_FEATURES]]


@query(
    "european_fixtures",
    f"""WITH {CUP_CTE} SELECT fixture_id, competition_code, is_group_stage, is_knockout, is_final, stage_importance, {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in CUP_COLUMNS)} FROM cups""",
)
def european_fixtures(spark, sf_dir):
    """Feature rows of cup fixtures, teams matched by name, with every fallback."""
    found = cup_features(spark, sf_dir)
    return found.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in CUP_COLUMNS})


def cup_dataset(spark, sf_dir) -> DataFrame:
    return european_dataset(cup_history(spark, sf_dir), cup_domestic(spark, sf_dir), club_aliases(spark))


@query("score_european")
def score_european(spark, sf_dir):
    """Cup fixtures scored by models fitted on the cups' history, stored and read back."""
    path = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    lifecycle.save(train_european(cup_dataset(spark, sf_dir), VALIDATION, TEST), path)
    return score_european_with(cup_features(spark, sf_dir), lifecycle.load(spark, path))


CUP_FIT = [f"{s}_{n}" for s in ("home", "away") for n in ("euro_avg_for_3", "euro_avg_against_5", "dom_avg_for", "dom_home_pct")]
EURO_ALPHA = 1.0


@query(
    "european_scores",
    f"""WITH {PARTICIPANTS_CTE}, {DOMESTIC_STATE},
    c AS (SELECT match_id, {", ".join(
        f"coalesce(CASE WHEN count({k}_goals) OVER w >= 5 THEN avg({k}_goals) OVER w END, (SELECT avg({k}_goals) FROM matches WHERE league_code IN {CUPS})) AS comp_{k}" for k in ("home", "away"))}
      FROM matches WHERE league_code IN {CUPS} WINDOW w AS (PARTITION BY league_code ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    o AS (SELECT match_id, is_home, row_number() OVER w - 1 AS played, avg(goals_for) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS euro_avg_for_3,
      avg(goals_against) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS euro_avg_against_5
      FROM participants WHERE league_code IN {CUPS} WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id)),
    f AS (SELECT match_id, is_home, played, coalesce(euro_avg_for_3, comp_home) AS euro_avg_for_3, coalesce(euro_avg_against_5, comp_away) AS euro_avg_against_5,
      coalesce(dom_avg_for, comp_home) AS dom_avg_for, coalesce(dom_home_pct, 0) AS dom_home_pct FROM o JOIN c USING (match_id) JOIN dom_asof USING (match_id, is_home)),
    wide AS (SELECT m.home_goals, m.away_goals, {", ".join(f"{n[0]}.{n[5:]} AS {n}" for n in CUP_FIT)}
      FROM matches m JOIN f h ON h.match_id = m.match_id AND h.is_home JOIN f a ON a.match_id = m.match_id AND NOT a.is_home
      WHERE (h.played >= 2 OR a.played >= 2) AND m.season_code < '{VALIDATION}')
    """ + " UNION ALL ".join(
        f"SELECT '{s}' AS side, '{n}' AS feature, count(*) AS n, round(sum({s}_goals * {n}), 2) AS score FROM wide" for s in ("home", "away") for n in CUP_FIT
    ),
)
def european_scores(spark, sf_dir):
    """For each feature its sum over the goals as the unscaled European fit has it: expected goals plus the penalty's pull."""
    stored, _ = lifecycle.split(cup_dataset(spark, sf_dir), VALIDATION, TEST, CUP_FIT)
    rows = stored.filter(F.col("dataset_split") == "train")
    n, found = rows.count(), []
    for side in ("home", "away"):
        model = models.goal_regression(rows, CUP_FIT, f"{side}_goals", EURO_ALPHA, scale=False)
        scored = model.transform(rows).select(vector_to_array("raw_features").alias("x"), F.col(f"{side}_goals_predicted").alias("p"))
        sums = scored.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(i)) * F.col("p")).alias(c) for i, c in enumerate(CUP_FIT)])
        for c, beta in zip(CUP_FIT, model.stages[-1].coefficients):
            pull = float(EURO_ALPHA * n * beta)
            found.append(sums.select(F.lit(side).alias("side"), F.lit(c).alias("feature"), "n", F.round(F.col(c) + pull, 2).alias("score")))
    return functools.reduce(DataFrame.unionAll, found)
