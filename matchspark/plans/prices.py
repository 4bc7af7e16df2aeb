"""Queries that price matches, find value, size stakes and run the bankroll."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.functions import poisson, staking
from matchspark.operators import bankroll, reshape, sequences
from matchspark.plans.catalog import query
from matchspark.plans.views import MATCHES_CTE, matches, round6
from matchspark.plans.series import sql_rounded
from matchspark.session import cut

RHO = -0.1
PRICE_LINES = (1.5, 2.5, 3.5)


def priced(spark, sf_dir) -> DataFrame:
    """Matches with three models' expected goals (two of them missing here and there)."""
    key = F.col("match_id")
    return matches(spark, sf_dir).select(
        "*",
        (F.lit(0.4) + (key % 23) / F.lit(10.0)).alias("pred_home"),
        (F.lit(0.3) + (key % 19) / F.lit(10.0)).alias("pred_away"),
        F.when(key % 7 != 0, F.lit(0.5) + (key % 21) / F.lit(10.0)).alias("gb_home"),
        F.when(key % 7 != 0, F.lit(0.4) + (key % 18) / F.lit(10.0)).alias("gb_away"),
        F.when(key % 5 != 0, F.lit(0.6) + (key % 16) / F.lit(10.0)).alias("dc_home"),
        F.when(key % 5 != 0, F.lit(0.2) + (key % 20) / F.lit(10.0)).alias("dc_away"),
        (F.col("over_odds") - 0.1).alias("over_1_5"),
        (F.col("under_odds") + 0.6).alias("under_1_5"),
        F.col("over_odds").alias("over_2_5"),
        F.col("under_odds").alias("under_2_5"),
        (F.col("over_odds") + 0.5).alias("over_3_5"),
        (F.col("under_odds") - 0.1).alias("under_3_5"),
        F.when(F.col("season_code") >= "1998", F.lit(0.3) + (key % 41) / F.lit(100.0)).alias("cal_over_prob"),
        F.when(F.col("season_code") >= "1998", F.lit(0.7) - (key % 41) / F.lit(100.0)).alias("cal_under_prob"),
        F.when(key % 3 == 0, key % 9).alias("home_out"),
        F.when(key % 4 == 0, key % 21).alias("away_out"),
    )


PRICED_CTE = (
    MATCHES_CTE
    + """, priced AS (SELECT *, 0.4e0 + (match_id % 23) / 10e0 AS pred_home, 0.3e0 + (match_id % 19) / 10e0 AS pred_away,
    CASE WHEN match_id % 7 <> 0 THEN 0.5e0 + (match_id % 21) / 10e0 END AS gb_home,
    CASE WHEN match_id % 7 <> 0 THEN 0.4e0 + (match_id % 18) / 10e0 END AS gb_away,
    CASE WHEN match_id % 5 <> 0 THEN 0.6e0 + (match_id % 16) / 10e0 END AS dc_home,
    CASE WHEN match_id % 5 <> 0 THEN 0.2e0 + (match_id % 20) / 10e0 END AS dc_away,
    over_odds - 0.1e0 AS over_1_5, under_odds + 0.6e0 AS under_1_5, over_odds AS over_2_5, under_odds AS under_2_5,
    over_odds + 0.5e0 AS over_3_5, under_odds - 0.1e0 AS under_3_5,
    CASE WHEN season_code >= '1998' THEN 0.3e0 + (match_id % 41) / 100e0 END AS cal_over_prob,
    CASE WHEN season_code >= '1998' THEN 0.7e0 - (match_id % 41) / 100e0 END AS cal_under_prob,
    CASE WHEN match_id % 3 = 0 THEN match_id % 9 END AS home_out,
    CASE WHEN match_id % 4 = 0 THEN match_id % 21 END AS away_out
    FROM matches)"""
)


def sql_cdf(k: int, rate: str) -> str:
    return f"list_sum(list_transform(range(0, {k} + 1), lambda i: exp(-({rate})) * pow({rate}, i) / gamma(i + 1)))"


def sql_pmf(k: str, rate: str) -> str:
    return f"exp(-({rate})) * pow({rate}, {k}) / gamma({k} + 1)"


@query(
    "poisson_totals",
    f"""WITH {PRICED_CTE}, t AS (SELECT match_id, least(greatest(pred_home + pred_away, 0.1e0), 6e0) AS lam FROM priced),
    p AS (SELECT match_id, lam, {", ".join(f"{sql_cdf(k, 'lam')} AS under_{k}_5" for k in (1, 2, 3))} FROM t)
    SELECT match_id, {", ".join(
        f"round(under_{k}_5, 6) AS under_{k}_5, round(1 - under_{k}_5, 6) AS over_{k}_5" for k in (1, 2, 3))},
        round({sql_pmf('2', 'lam')}, 6) AS exactly_2 FROM p""",
)
def poisson_totals(spark, sf_dir):
    rate = F.col("pred_home") + F.col("pred_away")
    columns = [F.round(poisson.pmf(2, poisson.clip(rate, 0.1, 6.0)), 6).alias("exactly_2")]
    for line in PRICE_LINES:
        tag = str(line).replace(".", "_")
        columns.append(F.round(poisson.single_rate_under(line, rate), 6).alias(f"under_{tag}"))
        columns.append(F.round(poisson.single_rate_over(line, rate), 6).alias(f"over_{tag}"))
    return priced(spark, sf_dir).select("match_id", *columns)


def sql_grid(size: int, source: str, home: str, away: str, weight: str = "", rho: bool = False) -> str:
    """Scoreline grid as rows (the SQL check only; the Spark job never builds it)."""
    p = f"{sql_pmf('h.i', home)} * {sql_pmf('a.i', away)}"
    if rho:
        p = f"""greatest(0, {p} * CASE WHEN h.i = 0 AND a.i = 0 THEN 1 - {home} * {away} * ({RHO}e0)
            WHEN h.i = 0 AND a.i = 1 THEN 1 + {home} * ({RHO}e0) WHEN h.i = 1 AND a.i = 0 THEN 1 + {away} * ({RHO}e0)
            WHEN h.i = 1 AND a.i = 1 THEN 1 - ({RHO}e0) ELSE 1 END)"""
    return f"""SELECT match_id, {weight} h.i AS hg, a.i AS ag, {p} AS p
      FROM {source}, (SELECT unnest(range(0, {size})) AS i) h, (SELECT unnest(range(0, {size})) AS i) a"""


@query(
    "grid_totals",
    f"""WITH {PRICED_CTE}, g AS ({sql_grid(11, 'priced', 'pred_home', 'pred_away')}),
    w AS ({sql_grid(41, '(SELECT DISTINCT pred_home, pred_away, 0 AS match_id FROM priced)', 'pred_home', 'pred_away', 'pred_home, pred_away,')}),
    whole AS (SELECT pred_home, pred_away, 1 - sum(p) FILTER (WHERE hg + ag <= 2) AS over_whole FROM w GROUP BY ALL),
    cut AS (SELECT match_id, {", ".join(
        f"sum(p) FILTER (WHERE hg + ag {op} {k}) AS {side}_{k}_5" for k in (1, 2, 3) for side, op in (("over", ">"), ("under", "<="))
    )} FROM g GROUP BY match_id)
    SELECT match_id, {", ".join(f"round(cut.{s}_{k}_5, 6) AS {s}_{k}_5" for k in (1, 2, 3) for s in ("over", "under"))},
           round(over_whole, 6) AS over_whole
    FROM cut JOIN priced USING (match_id) JOIN whole USING (pred_home, pred_away)""",
)
def grid_totals(spark, sf_dir):
    home, away = F.col("pred_home"), F.col("pred_away")
    columns = [F.round(poisson.two_rate_over_whole(2.5, home, away), 6).alias("over_whole")]
    for line in PRICE_LINES:
        tag = str(line).replace(".", "_")
        columns.append(F.round(poisson.two_rate_over(line, home, away), 6).alias(f"over_{tag}"))
        columns.append(F.round(poisson.two_rate_under(line, home, away), 6).alias(f"under_{tag}"))
    return priced(spark, sf_dir).select("match_id", *columns)


OUTCOMES = ["home_win", "draw", "away_win", "both_score"] + [
    f"{side}_{k}_5" for k in (1, 2, 3, 4) for side in ("over", "under")
]
SQL_OUTCOMES = (
    "sum(p) AS mass, sum(p) FILTER (WHERE hg > ag) AS home_win, sum(p) FILTER (WHERE hg = ag) AS draw, "
    "sum(p) FILTER (WHERE hg < ag) AS away_win, sum(p) FILTER (WHERE hg > 0 AND ag > 0) AS both_score, "
    + ", ".join(
        f"sum(p) FILTER (WHERE hg + ag > {k}) AS over_{k}_5, sum(p) FILTER (WHERE hg + ag <= {k}) AS under_{k}_5"
        for k in (1, 2, 3, 4)
    )
)


@query(
    "grid_outcomes",
    f"""WITH {PRICED_CTE}, g AS ({sql_grid(10, 'priced', 'pred_home', 'pred_away')}),
    o AS (SELECT match_id, {SQL_OUTCOMES} FROM g GROUP BY match_id)
    SELECT match_id, {sql_rounded(OUTCOMES)} FROM o""",
)
def grid_outcomes(spark, sf_dir):
    df = priced(spark, sf_dir).select("match_id", "pred_home", "pred_away")
    return round6(poisson.with_outcomes(df, "pred_home", "pred_away"), *OUTCOMES).drop("pred_home", "pred_away")


@query(
    "grid_outcomes_short",
    f"""WITH {PRICED_CTE}, g AS ({sql_grid(8, 'priced', 'pred_home', 'pred_away')}),
    o AS (SELECT match_id, {SQL_OUTCOMES} FROM g GROUP BY match_id)
    SELECT match_id, round(home_win, 6) AS home_win, round(draw, 6) AS draw, round(away_win, 6) AS away_win,
           round(over_2_5, 6) AS over_2_5, round(1 - over_2_5, 6) AS under_2_5 FROM o""",
)
def grid_outcomes_short(spark, sf_dir):
    df = priced(spark, sf_dir).select("match_id", "pred_home", "pred_away")
    out = poisson.with_outcomes(df, "pred_home", "pred_away", size=8, lines=(2.5,), complement=True)
    kept = ["home_win", "draw", "away_win", "over_2_5", "under_2_5"]
    return round6(out.select("match_id", *kept), *kept)


STRENGTHS_CTE = """strengths AS (
    SELECT team, avg(g) - (SELECT avg(home_goals + away_goals) / 2 FROM matches) AS attack,
           avg(c) - (SELECT avg(home_goals + away_goals) / 2 FROM matches) AS defense
    FROM (SELECT home_team AS team, home_goals AS g, away_goals AS c FROM matches
          UNION ALL SELECT away_team, away_goals, home_goals FROM matches) GROUP BY team)"""


def simple_strengths(df: DataFrame) -> DataFrame:
    """Attack and defense as distances from the mean: a fixed stand-in for a fitted model."""
    mean = df.agg((F.avg(F.col("home_goals") + F.col("away_goals")) / 2).alias("mean"))
    rows = reshape.participants(df, [], reshape.goal_sides())
    return rows.groupBy("team").agg(
        (F.avg("goals_for") - mean.scalar()).alias("attack"),
        (F.avg("goals_against") - mean.scalar()).alias("defense"),
    )


def with_strengths(df: DataFrame, strengths: DataFrame, how: str = "left") -> DataFrame:
    """Both teams' strengths; a team without any counts as average (``how="left"``)."""
    for side in ("home", "away"):
        named = strengths.select(
            F.col("team").alias(f"{side}_team"),
            F.col("attack").alias(f"{side}_attack"),
            F.col("defense").alias(f"{side}_defense"),
        )
        df = df.join(named, f"{side}_team", how)
    names = [f"{s}_{k}" for s in ("home", "away") for k in ("attack", "defense")]
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})


@query(
    "dc_outcomes",
    f"""WITH {MATCHES_CTE}, {STRENGTHS_CTE}, x AS (
      SELECT m.match_id, least(greatest(exp(h.attack + a.defense + 0.25e0), 0.1e0), 5e0) AS home_exp,
             least(greatest(exp(a.attack + h.defense), 0.1e0), 5e0) AS away_exp
      FROM matches m JOIN strengths h ON h.team = m.home_team JOIN strengths a ON a.team = m.away_team),
    g AS ({sql_grid(9, 'x', 'home_exp', 'away_exp', rho=True)}),
    o AS (SELECT match_id, {SQL_OUTCOMES} FROM g GROUP BY match_id)
    SELECT match_id, round(home_exp, 6) AS home_exp, round(away_exp, 6) AS away_exp,
           {", ".join(f"round({n} / mass, 6) AS {n}" for n in OUTCOMES)} FROM o JOIN x USING (match_id)""",
)
def dc_outcomes(spark, sf_dir):
    df = matches(spark, sf_dir)
    joined = with_strengths(df.select("match_id", "home_team", "away_team"), simple_strengths(df))
    home, away = poisson.expected_goals(
        F.col("home_attack"), F.col("home_defense"), F.col("away_attack"), F.col("away_defense"), 0.25
    )
    expected = joined.select("match_id", home.alias("home_exp"), away.alias("away_exp"))
    out = poisson.with_outcomes(expected, "home_exp", "away_exp", size=9, rho=RHO, normalise=True)
    return round6(out, "home_exp", "away_exp", *OUTCOMES)


def _model_probabilities(df: DataFrame, line: float, tag: str = "") -> DataFrame:
    """Each model's over and under probability on a line and their blend."""
    prefixes = {"poisson": "pred", "gb": "gb", "dc": "dc"}
    rates = {label: (F.col(f"{p}_home"), F.col(f"{p}_away")) for label, p in prefixes.items()}
    under = {f"{label}_under{tag}": poisson.two_rate_under(line, *r) for label, r in rates.items()}
    mass = {f"{label}_mass": poisson.cdf(10, r[0]) * poisson.cdf(10, r[1]) for label, r in rates.items()}
    over = {f"{label}_over{tag}": F.col(f"{label}_mass") - F.col(f"{label}_under{tag}") for label in prefixes}
    if "poisson_mass" not in df.columns:
        df = df.withColumns(mass)
    blends = {
        f"{side}{tag}": poisson.ensemble(*[F.col(f"{label}_{side}{tag}") for label in prefixes])
        for side in ("over", "under")
    }
    label = poisson.ensemble_label(F.col("gb_home"), F.col("dc_home"))
    return df.withColumns(under).withColumns(over).withColumns({**blends, "model_used": label})


def _sql_cut(k: str, home: str, away: str) -> str:
    """Under probability on the cut grid as a nested list sum."""
    inner = f"list_sum(list_transform(range(0, {k} - i + 1), lambda j: pow({away}, j) / gamma(j + 1)))"
    return (
        f"list_sum(list_transform(range(0, {k} + 1), lambda i: pow({home}, i) / gamma(i + 1) * {inner}))"
        f" * exp(-({home}) - ({away}))"
    )


def _sql_models(source: str, k: str) -> str:
    parts = []
    for label, prefix in (("poisson", "pred"), ("gb", "gb"), ("dc", "dc")):
        home, away = f"{prefix}_home", f"{prefix}_away"
        parts.append(f"{_sql_cut(k, home, away)} AS {label}_under")
        parts.append(
            f"{sql_cdf(10, home)} * {sql_cdf(10, away)} - {_sql_cut(k, home, away)} AS {label}_over"
        )
    blend = ", ".join(
        f"""CASE WHEN gb_{s} IS NOT NULL AND dc_{s} IS NOT NULL
                 THEN 0.35e0 * poisson_{s} + 0.35e0 * gb_{s} + 0.30e0 * dc_{s}
               WHEN dc_{s} IS NOT NULL THEN 0.6e0 * poisson_{s} + 0.4e0 * dc_{s}
               WHEN gb_{s} IS NOT NULL THEN 0.5e0 * poisson_{s} + 0.5e0 * gb_{s} ELSE poisson_{s} END AS "{s}" """
        for s in ("over", "under")
    )
    return f"""models AS (SELECT *, {", ".join(parts)} FROM {source}),
    blended AS (SELECT *, {blend}, CASE WHEN gb_over IS NOT NULL AND dc_over IS NOT NULL THEN 'full_ensemble'
      WHEN dc_over IS NOT NULL THEN 'poisson_dc_ensemble' WHEN gb_over IS NOT NULL THEN 'poisson_gb_ensemble'
      ELSE 'poisson_only' END AS model_used FROM models)"""


@query(
    "ensemble",
    f"""WITH {PRICED_CTE}, {_sql_models('priced', '2')}
    SELECT match_id, model_used, round(poisson_over, 6) AS poisson_over, round(gb_over, 6) AS gb_over,
           round(dc_over, 6) AS dc_over, round("over", 6) AS over_prob, round("under", 6) AS under_prob,
           round(coalesce((pred_home + dc_home) / 2, pred_home), 6) AS blend_home,
           round(coalesce((pred_away + dc_away) / 2, pred_away), 6) AS blend_away,
           round(pred_home * greatest(0.7e0, 1 - 0.02e0 * coalesce(home_out, 0)), 6) AS adjusted_home,
           round(pred_away * greatest(0.7e0, 1 - 0.02e0 * coalesce(away_out, 0)), 6) AS adjusted_away
    FROM blended""",
)
def ensemble(spark, sf_dir):
    df = _model_probabilities(priced(spark, sf_dir), 2.5)
    columns = {
        "poisson_over": F.col("poisson_over"),
        "gb_over": F.col("gb_over"),
        "dc_over": F.col("dc_over"),
        "over_prob": F.col("over"),
        "under_prob": F.col("under"),
        "blend_home": poisson.blend(F.col("pred_home"), F.col("dc_home")),
        "blend_away": poisson.blend(F.col("pred_away"), F.col("dc_away")),
        "adjusted_home": poisson.availability(F.col("pred_home"), F.col("home_out")),
        "adjusted_away": poisson.availability(F.col("pred_away"), F.col("away_out")),
    }
    return df.select("match_id", "model_used", *[F.round(v, 6).alias(k) for k, v in columns.items()])


def all_bets(spark, sf_dir) -> DataFrame:
    """Every match, line and side with a price: blended probability, edges and stake."""
    df = priced(spark, sf_dir)
    options = []
    for line in PRICE_LINES:
        tag = "_" + str(line).replace(".", "_")
        df = _model_probabilities(df, line, f"_at{tag}")
        both = F.col(f"over{tag}").isNotNull() & F.col(f"under{tag}").isNotNull()
        for side in ("over", "under"):
            option = F.struct(
                F.lit(line).alias("line"),
                F.lit(side.capitalize()).alias("selection"),
                F.col(f"{side}_at{tag}").alias("probability"),
                F.col(f"{side}{tag}").alias("odds"),
                F.col(f"poisson_{side}_at{tag}").alias("poisson_prob"),
                F.col(f"dc_{side}_at{tag}").alias("dc_prob"),
            )
            options.append(F.when(both, option))
    bets = df.select(
        "match_id", "match_date", "league_code", "home_team", "away_team", "model_used",
        (F.col("pred_home") + F.col("pred_away")).alias("model_total"),
        F.inline(F.array_compact(F.array(*options))),
    )
    edge = staking.probability_edge(F.col("probability"), F.col("odds"))
    return (
        bets.withColumn("bet", F.concat_ws(" ", "selection", F.col("line").cast("string")))
        .withColumn("edge_prob", edge)
        .withColumn("ev", staking.expected_value(F.col("probability"), F.col("odds")))
        .withColumn("kelly", staking.edge_stake(F.col("edge_prob"), F.col("odds")))
    )


def value_bets(spark, sf_dir, min_edge: float = 0.05) -> DataFrame:
    """Bets above the minimum edge, the best one per (home, away, bet)."""
    rich = all_bets(spark, sf_dir).filter(F.col("edge_prob") > min_edge)
    order = [-F.round("edge_prob", 9), F.col("match_date"), F.col("match_id")]
    return sequences.dedupe(rich, ["home_team", "away_team", "bet"], order)


BETS_CTE = f"""{PRICED_CTE},
    lined AS (SELECT match_id, match_date, league_code, home_team, away_team, pred_home, pred_away, gb_home, gb_away,
                     dc_home, dc_away, l.line,
                     CASE l.line WHEN 1.5e0 THEN over_1_5 WHEN 2.5e0 THEN over_2_5 ELSE over_3_5 END AS over_odds,
                     CASE l.line WHEN 1.5e0 THEN under_1_5 WHEN 2.5e0 THEN under_2_5 ELSE under_3_5 END AS under_odds
              FROM priced, (SELECT unnest([1.5e0, 2.5e0, 3.5e0]) AS line) l),
    offered AS (SELECT * FROM lined WHERE over_odds IS NOT NULL AND under_odds IS NOT NULL),
    {_sql_models('offered', 'CAST(floor(line) AS BIGINT)')},
    sides AS (
      SELECT *, 'Over' AS selection, "over" AS probability, over_odds AS odds, poisson_over AS poisson_prob,
             dc_over AS dc_prob FROM blended
      UNION ALL SELECT *, 'Under', "under", under_odds, poisson_under, dc_under FROM blended),
    bets AS (SELECT *, pred_home + pred_away AS model_total, selection || ' ' || CAST(line AS VARCHAR) AS bet,
                    probability - 1 / odds AS edge_prob, probability * odds - 1 AS ev,
                    least(CASE WHEN odds > 1 THEN (probability - 1 / odds) / (odds - 1) ELSE 0 END * 0.25e0, 0.05e0) AS kelly
             FROM sides),
    valued AS (SELECT * FROM bets WHERE edge_prob > 0.05e0 QUALIFY row_number() OVER (
        PARTITION BY home_team, away_team, bet ORDER BY round(edge_prob, 9) DESC, match_date, match_id) = 1)"""
BET_NAMES = ["model_total", "probability", "odds", "poisson_prob", "dc_prob", "edge_prob", "ev", "kelly"]


@query(
    "value_table",
    f"""WITH {BETS_CTE} SELECT match_id, match_date, home_team, away_team, line, selection, bet, model_used,
        {sql_rounded(BET_NAMES)} FROM valued""",
)
def value_table(spark, sf_dir):
    kept = ["match_id", "match_date", "home_team", "away_team", "line", "selection", "bet", "model_used"]
    table = round6(value_bets(spark, sf_dir).select(*kept, *BET_NAMES), *BET_NAMES)
    return table.orderBy(F.desc("edge_prob"), "match_id", "bet")


def signal_table(spark, sf_dir) -> DataFrame:
    df = priced(spark, sf_dir).select(
        "match_id", "match_date", "league_code", "season_code", "home_team", "away_team",
        (F.col("home_goals") + F.col("away_goals")).alias("total_goals"),
        (F.col("pred_home") + F.col("pred_away")).alias("pred_total_goals"),
        F.when(F.col("match_id") % 6 == 0, 3.5).otherwise(2.5).alias("line"),
        "over_odds", "under_odds", "cal_over_prob", "cal_under_prob",
    )
    return staking.pick_signals(df.dropna(how="all", subset=["over_odds", "under_odds"]))


SIGNALS_CTE = f"""{PRICED_CTE},
    base AS (SELECT match_id, match_date, league_code, season_code, home_team, away_team,
                    home_goals + away_goals AS total_goals, pred_home + pred_away AS pred_total_goals,
                    CASE WHEN match_id % 6 = 0 THEN 3.5e0 ELSE 2.5e0 END AS line, over_odds, under_odds,
                    cal_over_prob, cal_under_prob FROM priced WHERE over_odds IS NOT NULL OR under_odds IS NOT NULL),
    raw AS (SELECT *, {sql_cdf("CAST(floor(line - 0.5e0) AS BIGINT)", "least(greatest(pred_total_goals, 0.1e0), 6e0)")} AS model_under FROM base),
    probs AS (SELECT *, CASE WHEN over_odds IS NOT NULL THEN least(greatest(coalesce(CASE WHEN line = 2.5e0 THEN cal_over_prob END, 1 - model_under), 1e-4), 1 - 1e-4) END AS over_prob,
                        CASE WHEN under_odds IS NOT NULL THEN least(greatest(coalesce(CASE WHEN line = 2.5e0 THEN cal_under_prob END, model_under), 1e-4), 1 - 1e-4) END AS under_prob FROM raw),
    evs AS (SELECT *, CASE WHEN over_prob BETWEEN 0.35e0 AND 0.75e0 THEN over_prob * over_odds - 1 END AS ev_over,
                      CASE WHEN under_prob BETWEEN 0.35e0 AND 0.75e0 THEN under_prob * under_odds - 1 END AS ev_under FROM probs),
    picked AS (SELECT *, ev_over IS NOT NULL AND (ev_under IS NULL OR ev_over >= ev_under) AS take_over FROM evs
               WHERE greatest(ev_over, ev_under) >= 0.1e0),
    named AS (SELECT *, CASE WHEN take_over THEN 'Over' ELSE 'Under' END AS selection,
                     CASE WHEN take_over THEN over_prob ELSE under_prob END AS probability,
                     CASE WHEN take_over THEN over_odds ELSE under_odds END AS odds,
                     CASE WHEN take_over THEN ev_over ELSE ev_under END AS edge FROM picked),
    signals AS (SELECT *, least((CASE WHEN odds <= 1 THEN 0 ELSE greatest(0, (probability * (odds - 1) - (1 - probability)) / (odds - 1)) END) * 0.15e0, 0.05e0) AS stake_fraction FROM named)"""
SIGNAL_NAMES = ["probability", "odds", "edge", "stake_fraction", "over_prob", "under_prob"]


@query(
    "signals",
    f"""WITH {SIGNALS_CTE} SELECT match_id, match_date, league_code, home_team, away_team, line, selection,
        {sql_rounded(SIGNAL_NAMES)}, round(stake_fraction * 10000, 4) AS stake FROM signals""",
)
def signals(spark, sf_dir):
    kept = ["match_id", "match_date", "league_code", "home_team", "away_team", "line", "selection"]
    return round6(signal_table(spark, sf_dir).select(*kept, *SIGNAL_NAMES, F.round("stake", 4).alias("stake")), *SIGNAL_NAMES)


@query(
    "settle",
    f"""WITH {SIGNALS_CTE}, s AS (SELECT *, CASE WHEN selection = 'Over' THEN total_goals > line ELSE total_goals < line END AS won FROM signals)
    SELECT match_id, selection, line, total_goals, won,
           round(CASE WHEN won THEN stake_fraction * 10000 * (odds - 1) ELSE -stake_fraction * 10000 END, 4) AS profit FROM s""",
)
def settle(spark, sf_dir):
    won = staking.settle(F.col("total_goals"), F.col("line"), F.col("selection"))
    df = signal_table(spark, sf_dir).withColumn("won", won)
    profit = F.round(staking.profit(F.col("won"), F.col("stake"), F.col("odds")), 4)
    return df.select("match_id", "selection", "line", "total_goals", "won", profit.alias("profit"))


def trades(spark, sf_dir) -> DataFrame:
    won = staking.settle(F.col("total_goals"), F.col("line"), F.col("selection"))
    return (
        signal_table(spark, sf_dir)
        .filter((F.col("stake") > 0) & F.col("total_goals").isNotNull())
        .select(
            "league_code", "match_id", "match_date", "selection", "line", "odds", "probability", "edge", "stake",
            won.alias("won"),
            F.when(won, F.col("odds") - 1.0).otherwise(-1.0).alias("gain"),
        )
    )


def trade_path(spark, sf_dir) -> DataFrame:
    return bankroll.bankroll_path(
        trades(spark, sf_dir), "league_code", ["match_date", "match_id"], F.col("match_date")
    )


PATH_CTE = f"""RECURSIVE {SIGNALS_CTE},
    trades AS (SELECT league_code, match_id, stake_fraction * 10000 AS wanted, odds,
                      row_number() OVER (PARTITION BY league_code ORDER BY match_date, match_id) AS n,
                      CASE WHEN selection = 'Over' THEN total_goals > line ELSE total_goals < line END AS won
               FROM signals WHERE stake_fraction > 0),
    walk AS (SELECT 0::BIGINT AS n, l.league_code, NULL::BIGINT AS match_id, NULL::BOOLEAN AS won, 0e0 AS stake, 0e0 AS profit, 10000e0 AS bankroll
             FROM (SELECT DISTINCT league_code FROM trades) l
             UNION ALL
             SELECT t.n, t.league_code, t.match_id, t.won, least(t.wanted, 0.1e0 * w.bankroll),
                    least(t.wanted, 0.1e0 * w.bankroll) * CASE WHEN t.won THEN t.odds - 1 ELSE -1 END,
                    w.bankroll + least(t.wanted, 0.1e0 * w.bankroll) * CASE WHEN t.won THEN t.odds - 1 ELSE -1 END
             FROM walk w JOIN trades t ON t.league_code = w.league_code AND t.n = w.n + 1),
    path AS (SELECT * FROM walk WHERE n > 0)"""


@query(
    "backtest_path",
    f"""WITH {PATH_CTE} SELECT league_code, n - 1 AS trade, match_id, won, round(stake, 3) AS stake,
        round(profit, 3) AS profit, round(bankroll, 3) AS bankroll_after FROM path""",
)
def backtest_path(spark, sf_dir):
    money = [F.round(c, 3).alias(c) for c in ("stake", "profit", "bankroll_after")]
    return trade_path(spark, sf_dir).select("league_code", "trade", "match_id", "won", *money)


@query(
    "backtest_summary",
    f"""WITH {PATH_CTE}, peaks AS (SELECT *, max(bankroll) OVER (PARTITION BY league_code ORDER BY n) AS peak FROM path)
    SELECT league_code, count(*) AS bets, round(sum(profit) / 10000, 6) AS roi, round(avg(CAST(won AS INT)), 6) AS hit_rate,
           round(min((bankroll - peak) / peak), 6) AS max_drawdown, round(arg_max(bankroll, n), 3) AS ending_bankroll
    FROM peaks GROUP BY league_code""",
)
def backtest_summary(spark, sf_dir):
    total = bankroll.summary(trade_path(spark, sf_dir), "league_code")
    return round6(total, "roi", "hit_rate", "max_drawdown").withColumn("ending_bankroll", F.round("ending_bankroll", 3))


@query(
    "portfolio_allocation",
    f"""WITH {BETS_CTE}, t AS (SELECT *, sum(kelly) OVER w AS sk, sum(greatest(0, ev)) OVER w AS se, count(*) OVER w AS n
        FROM valued WINDOW w AS (PARTITION BY league_code))
    SELECT match_id, bet, league_code, round(100 * kelly / sk, 6) AS kelly_share, round(100e0 / n, 6) AS equal_share,
           round(100 * greatest(0, ev) / se, 6) AS value_share FROM t""",
)
def portfolio_allocation(spark, sf_dir):
    shares = bankroll.allocate(cut(value_bets(spark, sf_dir), "bets"), "league_code", 1000.0)
    kept = [F.round(100 * F.col(n), 6).alias(n) for n in ("kelly_share", "equal_share", "value_share")]
    return shares.select("match_id", "bet", "league_code", *kept)


@query(
    "portfolio_totals",
    f"""WITH {BETS_CTE}, t AS (SELECT *, 1000 * kelly / sum(kelly) OVER (PARTITION BY league_code) AS stake FROM valued)
    SELECT league_code, count(*) AS bets, round(sum(stake), 4) AS total_stake,
           round(sum(stake * odds * probability), 4) AS expected_return,
           round(sum(stake * odds * probability) - sum(stake), 4) AS expected_profit FROM t GROUP BY league_code""",
)
def portfolio_totals(spark, sf_dir):
    allocated = bankroll.allocate(cut(value_bets(spark, sf_dir), "bets"), "league_code", 1000.0)
    totals = bankroll.allocation_totals(allocated, "league_code", "kelly")
    return totals.withColumns({n: F.round(n, 4) for n in ("total_stake", "expected_return", "expected_profit")})
