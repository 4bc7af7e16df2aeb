"""Queries that evaluate predictions and summarise tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.functions import conform, poisson, staking
from matchspark.operators import evaluation, joins, reshape, sequences, upserts
from matchspark.plans.catalog import query, table
from matchspark.plans.lookups import FIXTURES_CTE, STATE_NAMES, fixtures, latest_states
from matchspark.plans.prices import BETS_CTE, PRICED_CTE, STRENGTHS_CTE, priced, simple_strengths, sql_cdf, sql_grid, value_bets
from matchspark.plans.series import sql_rounded
from matchspark.plans.views import MATCHES_CTE, PARTICIPANTS_CTE, matches, participants, round6


def judged(spark, sf_dir) -> DataFrame:
    """Over 2.5 probability, outcome and price per match."""
    df = priced(spark, sf_dir)
    p = poisson.single_rate_over(2.5, F.col("pred_home") + F.col("pred_away"))
    hit = (F.col("home_goals") + F.col("away_goals") > 2.5).cast("int")
    return df.select("match_id", "league_code", F.when(F.col("match_id") % 17 != 0, p).alias("prob"), hit.alias("hit"), F.col("over_odds").alias("odds"))


JUDGED_CTE = f"""{PRICED_CTE}, judged AS (SELECT match_id, league_code, CASE WHEN match_id % 17 <> 0
  THEN 1 - {sql_cdf(2, 'least(greatest(pred_home + pred_away, 0.1e0), 6e0)')} END AS prob, CAST(home_goals + away_goals > 2.5e0 AS INT) AS hit, over_odds AS odds FROM priced),
  binned AS (SELECT *, least(floor(prob * 10) - CASE WHEN prob < floor(prob * 10) * 0.1e0 THEN 1 ELSE 0 END + CASE WHEN prob >= (floor(prob * 10) + 1) * 0.1e0 THEN 1 ELSE 0 END, 9) AS b FROM judged WHERE prob IS NOT NULL)"""


@query(
    "calibration_bins",
    f"""WITH {JUDGED_CTE}, c AS (SELECT league_code, CAST(b AS BIGINT) AS bin, avg(prob) AS mp, avg(hit) AS hr, count(*) AS n FROM binned GROUP BY 1, 2)
    SELECT league_code, bin, round(mp, 6) AS mean_predicted, round(hr, 6) AS hit_rate, n, round(abs(mp - hr), 6) AS error,
      CASE WHEN abs(mp - hr) < 0.03e0 THEN 'EXCELLENT' WHEN abs(mp - hr) < 0.05e0 THEN 'GOOD' WHEN abs(mp - hr) < 0.1e0 THEN 'OK' ELSE 'POOR' END AS grade FROM c""",
)
def calibration_bins(spark, sf_dir):
    bins = evaluation.calibration_bins(judged(spark, sf_dir), ["league_code"], "prob", "hit")
    return round6(bins, "mean_predicted", "hit_rate", "error")


@query(
    "calibration_summary",
    f"""WITH {JUDGED_CTE}, e AS (SELECT league_code, sum(abs(p - y)) AS ae, sum(n) AS n FROM (SELECT league_code, b, sum(prob) AS p, sum(hit) AS y, count(*) AS n FROM binned GROUP BY 1, 2) GROUP BY 1)
    SELECT league_code, count(*) AS n, round(avg(prob), 6) AS mean_predicted, round(avg(hit), 6) AS hit_rate, round(avg(pow(prob - hit, 2)), 6) AS brier,
      round(-avg(hit * ln(greatest(prob, 1e-10)) + (1 - hit) * ln(greatest(1 - prob, 1e-10))), 6) AS log_loss, round(any_value(e.ae / e.n), 6) AS ece
    FROM binned JOIN e USING (league_code) GROUP BY league_code""",
)
def calibration_summary(spark, sf_dir):
    total = evaluation.calibration_summary(judged(spark, sf_dir), ["league_code"], "prob", "hit")
    return round6(total, "mean_predicted", "hit_rate", "brier", "log_loss", "ece")


@query(
    "edge_buckets",
    f"""WITH {JUDGED_CTE}, v AS (SELECT *, prob - 1 / odds AS edge FROM judged WHERE prob IS NOT NULL AND odds IS NOT NULL),
    k AS (SELECT *, CASE WHEN edge >= 0 AND edge < 0.02e0 THEN 0 WHEN edge >= 0.02e0 AND edge < 0.05e0 THEN 1 WHEN edge >= 0.05e0 AND edge < 0.1e0 THEN 2
      WHEN edge >= 0.1e0 AND edge < 0.15e0 THEN 3 WHEN edge >= 0.15e0 AND edge < 0.2e0 THEN 4 WHEN edge >= 0.2e0 AND edge < 1 THEN 5 END AS bucket FROM v)
    SELECT league_code, bucket, ['0%-2%', '2%-5%', '5%-10%', '10%-15%', '15%-20%', '20%-100%'][bucket + 1] AS edge_range, count(*) AS n, round(avg(hit), 6) AS hit_rate, round(avg(odds), 6) AS avg_odds,
      round(avg(prob), 6) AS avg_probability, round(avg(1 / odds), 6) AS avg_implied, round(avg(CASE WHEN hit = 1 THEN odds - 1 ELSE -1 END), 6) AS roi,
      round(sum(CASE WHEN hit = 1 THEN odds - 1 ELSE -1 END), 4) AS total_profit, avg(CASE WHEN hit = 1 THEN odds - 1 ELSE -1 END) > 0 AS profitable
    FROM k WHERE bucket IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def edge_buckets(spark, sf_dir):
    buckets = evaluation.edge_buckets(judged(spark, sf_dir), ["league_code"], "prob", "hit", "odds")
    rounded = round6(buckets, "hit_rate", "avg_odds", "avg_probability", "avg_implied", "roi")
    return rounded.withColumn("total_profit", F.round("total_profit", 4))


MODELS = {"poisson": ("pred_home", "pred_away"), "boosted": ("gb_home", "gb_away"), "strengths": ("dc_home", "dc_away")}
ERROR_FIELDS = [f"{side}_{f}" for side in ("home", "away") for f in ("mae", "rmse", "bias", "mean_predicted", "mean_actual")]


def _sql_errors(model: str, home: str, away: str) -> str:
    parts = []
    for side, p in (("home", home), ("away", away)):
        a = f"{side}_goals"
        parts.append(
            f"avg(abs({p} - {a})) AS {side}_mae, sqrt(avg(pow({p} - {a}, 2))) AS {side}_rmse, avg({p} - {a}) AS {side}_bias, "
            f"avg({p}) AS {side}_mean_predicted, avg({a}) FILTER (WHERE {p} IS NOT NULL) AS {side}_mean_actual"
        )
    return f"SELECT '{model}' AS model, {', '.join(parts)} FROM priced"


@query(
    "model_errors",
    f"""WITH {PRICED_CTE}, e AS ({" UNION ALL ".join(_sql_errors(m, *p) for m, p in MODELS.items())}),
    r AS (SELECT *, (home_rmse + away_rmse) / 2 AS mean_rmse FROM e)
    SELECT model, {sql_rounded(ERROR_FIELDS + ['mean_rmse'])}, round((max(mean_rmse) OVER () - mean_rmse) / max(mean_rmse) OVER () * 100, 6) AS gain_pct FROM r""",
)
def model_errors(spark, sf_dir):
    compared = evaluation.compare_models(priced(spark, sf_dir), MODELS, ("home_goals", "away_goals"))
    return round6(compared, *ERROR_FIELDS, "mean_rmse", "gain_pct")


def evaluation_rows(spark, sf_dir) -> DataFrame:
    """Actual outcome and both models' outcome probabilities per match."""
    df = priced(spark, sf_dir).select(
        "match_id", "league_code", "home_goals", "away_goals", "pred_home", "pred_away", "dc_home", "dc_away",
        F.coalesce("over_3_5", "over_2_5").alias("odds"),
    )
    lines = (1.5, 2.5, 3.5)
    df = poisson.with_outcomes(df, "pred_home", "pred_away", lines=lines, prefix="poisson_")
    df = poisson.with_outcomes(df, "dc_home", "dc_away", lines=lines, rho=-0.1, prefix="dc_")
    # GREATEST ignores null, so a model without expected goals has to be blanked
    blank = [c for c in df.columns if c.startswith("dc_") and c not in ("dc_home", "dc_away")]
    df = df.withColumns({c: F.when(F.col("dc_home").isNotNull(), F.col(c)) for c in blank})
    total = F.col("home_goals") + F.col("away_goals")
    df = df.withColumn("result", conform.result_label(F.col("home_goals"), F.col("away_goals"))).withColumn("total_goals", total)
    calls = {
        f"{m}_call": poisson.result_call(*[F.col(f"{m}_{k}") for k in ("home_win", "draw", "away_win")])
        for m in ("poisson", "dc")
    }
    return df.withColumns(calls)


EVALUATED = [f"{m}_{k}" for m in ("poisson", "dc") for k in ("home_win", "draw", "away_win", "over_1_5", "over_2_5", "over_3_5", "under_2_5")]
EVALUATED_CTE = f"""{PRICED_CTE},
    gp AS ({sql_grid(10, 'priced', 'pred_home', 'pred_away')}),
    gd AS ({sql_grid(10, '(SELECT * FROM priced WHERE dc_home IS NOT NULL)', 'dc_home', 'dc_away', rho=True)}),
    {", ".join(f'''o{x} AS (SELECT match_id, sum(p) FILTER (WHERE hg > ag) AS {m}_home_win, sum(p) FILTER (WHERE hg = ag) AS {m}_draw, sum(p) FILTER (WHERE hg < ag) AS {m}_away_win,
      sum(p) FILTER (WHERE hg + ag > 1) AS {m}_over_1_5, sum(p) FILTER (WHERE hg + ag > 2) AS {m}_over_2_5, sum(p) FILTER (WHERE hg + ag > 3) AS {m}_over_3_5, sum(p) FILTER (WHERE hg + ag <= 2) AS {m}_under_2_5 FROM g{x} GROUP BY 1)''' for x, m in (("p", "poisson"), ("d", "dc")))},
    ev AS (SELECT *, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS result, home_goals + away_goals AS total_goals,
      {", ".join(f"CASE WHEN {m}_home_win IS NULL THEN NULL WHEN round({m}_home_win, 9) > round({m}_away_win, 9) AND round({m}_home_win, 9) > round({m}_draw, 9) THEN 'H' WHEN round({m}_away_win, 9) > round({m}_home_win, 9) AND round({m}_away_win, 9) > round({m}_draw, 9) THEN 'A' ELSE 'D' END AS {m}_call" for m in ("poisson", "dc"))}
      FROM priced JOIN op USING (match_id) LEFT JOIN od USING (match_id))"""


@query(
    "evaluation_frame",
    f"""WITH {EVALUATED_CTE} SELECT match_id, result, total_goals, {sql_rounded(EVALUATED)}, round(coalesce(over_3_5, over_2_5), 6) AS odds FROM ev""",
)
def evaluation_frame(spark, sf_dir):
    df = evaluation_rows(spark, sf_dir)
    return round6(df.select("match_id", "result", "total_goals", *EVALUATED, "odds"), *EVALUATED, "odds")


@query(
    "model_accuracy",
    f"""WITH {EVALUATED_CTE} SELECT league_code, {", ".join(f"round(avg(CAST({m}_call = result AS INT)), 6) AS {m}_result_accuracy, count({m}_call) AS {m}_count, round(avg(CAST(({m}_over_{k}_5 > 0.5e0) = (total_goals > {k}) AS INT)), 6) AS {m}_over_{k}_5_accuracy" for m in ("poisson", "dc") for k in (2,))} FROM ev GROUP BY 1""",
)
def model_accuracy(spark, sf_dir):
    aggregates = []
    for m in ("poisson", "dc"):
        over = evaluation.accuracy(F.col(f"{m}_over_2_5") > 0.5, F.col("total_goals") > 2.5)
        aggregates += [
            F.round(evaluation.accuracy(F.col(f"{m}_call"), F.col("result")), 6).alias(f"{m}_result_accuracy"),
            F.count(f"{m}_call").alias(f"{m}_count"),
            F.round(over, 6).alias(f"{m}_over_2_5_accuracy"),
        ]
    return evaluation_rows(spark, sf_dir).groupBy("league_code").agg(*aggregates)


# --- report tables

REPORT_COLUMNS = ["match_id", "home_team", "away_team", "bet_type", "line", "odds", "probability", "ev", "stake", "pred_total"]


def report_schema(df: DataFrame) -> DataFrame:
    """Two input shapes to one: edge rows as they are, side-by-side values as their better side if positive."""
    if "edge" in df.columns:
        bet = F.when(F.lower("bet").contains("over"), "Over").otherwise("Under")
        stake = F.col("kelly") if "kelly" in df.columns else F.col("stake_fraction")
        return df.select(
            "match_id", "home_team", "away_team", bet.alias("bet_type"), "line", "odds", "probability",
            F.col("edge").alias("ev"), stake.alias("stake"), F.col("model_total").alias("pred_total"),
        )
    if "over_ev" in df.columns:
        over = F.col("over_ev") > F.col("under_ev")
        over = F.coalesce(over, F.lit(False))
        best = df.withColumns(
            {
                "bet_type": F.when(over, "Over").otherwise("Under"),
                "odds": F.when(over, F.col("over_odds")).otherwise(F.col("under_odds")),
                "probability": F.when(over, F.col("over_prob")).otherwise(F.col("under_prob")),
                "ev": F.greatest("over_ev", "under_ev"),
                "line": F.lit(2.5),
            }
        ).filter(F.col("ev") > 0)
        return best.withColumn("stake", staking.report_stake(F.col("probability"), F.col("odds"))).select(*REPORT_COLUMNS)
    raise ValueError("neither an edge nor an over_ev column")


def two_sided(spark, sf_dir) -> DataFrame:
    """Blended expected goals, whole-grid probabilities and values of both sides."""
    df = priced(spark, sf_dir)
    home, away = (poisson.blend(F.col(f"pred_{s}"), F.col(f"dc_{s}")) for s in ("home", "away"))
    df = df.select(
        "match_id", "home_team", "away_team", home.alias("h"), away.alias("a"),
        F.col("over_2_5").alias("over_odds"), F.col("under_2_5").alias("under_odds"),
    )
    df = df.withColumn("over_prob", poisson.two_rate_over_whole(2.5, F.col("h"), F.col("a")))
    df = df.withColumn("under_prob", 1.0 - F.col("over_prob")).withColumn("pred_total", F.col("h") + F.col("a"))
    values = {f"{s}_ev": staking.expected_value(F.col(f"{s}_prob"), F.col(f"{s}_odds")) for s in ("over", "under")}
    return df.withColumns(values).dropna(subset=["over_odds", "under_odds"])


TWO_SIDED_CTE = f"""{PRICED_CTE}, bl AS (SELECT match_id, home_team, away_team, coalesce((pred_home + dc_home) / 2, pred_home) AS h, coalesce((pred_away + dc_away) / 2, pred_away) AS a,
      over_2_5 AS over_odds, under_2_5 AS under_odds FROM priced WHERE over_2_5 IS NOT NULL AND under_2_5 IS NOT NULL),
    ts AS (SELECT *, h + a AS pred_total, exp(-(h + a)) * (1 + (h + a) + pow(h + a, 2) / 2) AS under_prob FROM bl),
    two AS (SELECT *, 1 - under_prob AS over_prob, (1 - under_prob) * over_odds - 1 AS over_ev, under_prob * under_odds - 1 AS under_ev FROM ts)"""


@query(
    "report_frame",
    f"""WITH {TWO_SIDED_CTE}, r AS (SELECT match_id, home_team, away_team, CASE WHEN over_ev > under_ev THEN 'Over' ELSE 'Under' END AS bet_type, 2.5e0 AS line,
      CASE WHEN over_ev > under_ev THEN over_odds ELSE under_odds END AS odds, CASE WHEN over_ev > under_ev THEN over_prob ELSE under_prob END AS probability, greatest(over_ev, under_ev) AS ev, pred_total FROM two)
    SELECT match_id, home_team, away_team, bet_type, line, round(odds, 6) AS odds, round(probability, 6) AS probability, round(ev, 6) AS ev,
      round(CASE WHEN odds > 1 THEN greatest(0, least(0.05e0, 0.25e0 * (probability - (1 - probability) / (odds - 1)))) ELSE 0 END, 6) AS stake, round(pred_total, 6) AS pred_total
    FROM r WHERE ev > 0 AND probability BETWEEN 0.35e0 AND 0.75e0""",
)
def report_frame(spark, sf_dir):
    frame = report_schema(two_sided(spark, sf_dir)).filter(F.col("probability").between(0.35, 0.75))
    return round6(frame, "odds", "probability", "ev", "stake", "pred_total").orderBy(F.desc("ev"), "match_id")


@query(
    "report_summary",
    f"""WITH {BETS_CTE} SELECT line, count(*) FILTER (WHERE selection = 'Over') AS over_count, count(*) FILTER (WHERE selection = 'Under') AS under_count, round(avg(edge_prob), 6) AS mean_edge,
      round(sum(kelly) * 100, 4) AS total_stake, round(max(edge_prob) * 100, 4) AS best_ev, round(avg(odds), 6) AS avg_odds, round(avg(probability) * 100, 4) AS avg_prob,
      count(*) FILTER (WHERE probability BETWEEN 0.35e0 AND 0.75e0) AS optimal_count, count(*) FILTER (WHERE probability >= 0.65e0 AND odds >= 1.1e0) AS confident_count FROM valued GROUP BY line""",
)
def report_summary(spark, sf_dir):
    rows = report_schema(value_bets(spark, sf_dir).withColumn("edge", F.col("edge_prob")))
    p = F.col("probability")
    return rows.groupBy("line").agg(
        F.count_if(F.col("bet_type") == "Over").alias("over_count"),
        F.count_if(F.col("bet_type") == "Under").alias("under_count"),
        F.round(F.avg("ev"), 6).alias("mean_edge"),
        F.round(F.sum("stake") * 100, 4).alias("total_stake"),
        F.round(F.max("ev") * 100, 4).alias("best_ev"),
        F.round(F.avg("odds"), 6).alias("avg_odds"),
        F.round(F.avg(p) * 100, 4).alias("avg_prob"),
        F.count_if(p.between(0.35, 0.75)).alias("optimal_count"),
        F.count_if((p >= 0.65) & (F.col("odds") >= 1.1)).alias("confident_count"),
    )


@query(
    "value_sides",
    f"""WITH {TWO_SIDED_CTE}, s AS (SELECT match_id, 'Over' AS selection, over_prob AS prob, over_odds AS odds, over_ev AS ev FROM two UNION ALL SELECT match_id, 'Under', under_prob, under_odds, under_ev FROM two)
    SELECT match_id, selection, {sql_rounded(['prob', 'odds', 'ev'])} FROM s WHERE ev > 0""",
)
def value_sides(spark, sf_dir):
    sides = {
        name: {k: F.col(f"{name.lower()}_{k}") for k in ("prob", "odds", "ev")} for name in ("Over", "Under")
    }
    rows = reshape.side_rows(["match_id"], sides, two_sided(spark, sf_dir)).filter(F.col("ev") > 0)
    return round6(rows, "prob", "odds", "ev").orderBy(F.desc("ev"), "match_id", "selection")


@query(
    "value_ranks",
    f"""WITH {TWO_SIDED_CTE}, s AS (SELECT match_id, 'Over' AS selection, over_ev AS ev FROM two UNION ALL SELECT match_id, 'Under', under_ev FROM two)
    SELECT match_id, selection, round(ev, 6) AS ev, row_number() OVER (ORDER BY round(ev, 6) DESC, match_id, selection) AS rank FROM s WHERE ev > 0""",
)
def value_ranks(spark, sf_dir):
    """The whole value list in order, each side with its place: pages of any offset are a filter on it."""
    listed = value_sides(spark, sf_dir).select("match_id", "selection", "ev")
    return sequences.ranked(listed, [F.desc("ev"), F.asc("match_id"), F.asc("selection")])


@query(
    "price_rows",
    f"""WITH {PRICED_CTE}, l AS (SELECT match_id, 1.5e0 AS line, over_1_5 AS over_odds, under_1_5 AS under_odds FROM priced UNION ALL SELECT match_id, 2.5e0, over_2_5, under_2_5 FROM priced UNION ALL SELECT match_id, 3.5e0, over_3_5, under_3_5 FROM priced)
    SELECT match_id, line, round(over_odds, 6) AS over_odds, round(under_odds, 6) AS under_odds FROM l WHERE over_odds IS NOT NULL AND under_odds IS NOT NULL""",
)
def price_rows(spark, sf_dir):
    lines = {line: (f"over_{t}", f"under_{t}") for line, t in ((1.5, "1_5"), (2.5, "2_5"), (3.5, "3_5"))}
    return round6(reshape.price_rows(priced(spark, sf_dir), lines, ["match_id"]), "over_odds", "under_odds")


@query(
    "topk",
    f"""WITH {BETS_CTE} SELECT match_id, bet, round(edge_prob, 6) AS edge_prob, round(kelly, 6) AS kelly FROM valued ORDER BY round(edge_prob, 6) DESC, match_id, bet LIMIT 30""",
)
def topk(spark, sf_dir):
    rows = round6(value_bets(spark, sf_dir).select("match_id", "bet", "edge_prob", "kelly"), "edge_prob", "kelly")
    return rows.orderBy(F.desc("edge_prob"), "match_id", "bet").limit(30)


@query(
    "top_strengths",
    f"""WITH {MATCHES_CTE}, {STRENGTHS_CTE} SELECT team, round(attack, 6) AS attack, round(defense, 6) AS defense FROM strengths ORDER BY round(attack, 6) DESC, team LIMIT 5""",
)
def top_strengths(spark, sf_dir):
    rated = round6(simple_strengths(matches(spark, sf_dir)), "attack", "defense")
    return rated.orderBy(F.desc("attack"), "team").limit(5)


@query(
    "set_ops",
    f"""WITH {MATCHES_CTE}, a AS (SELECT match_id, home_team, over_odds FROM matches WHERE league_code <= 'L2'), b AS (SELECT match_id, away_team, under_odds FROM matches WHERE league_code > 'L2'),
    u AS (SELECT * FROM a UNION ALL BY NAME SELECT * FROM b)
    SELECT match_id, home_team, away_team, round(over_odds, 6) AS over_odds, round(under_odds, 6) AS under_odds FROM u WHERE match_id NOT IN (SELECT match_id FROM matches WHERE season_code = '1996')""",
)
def set_ops(spark, sf_dir):
    df = matches(spark, sf_dir)
    a = df.filter(F.col("league_code") <= "L2").select("match_id", "home_team", "over_odds")
    b = df.filter(F.col("league_code") > "L2").select("match_id", "away_team", "under_odds")
    union = a.unionByName(b, allowMissingColumns=True)
    closed = df.filter(F.col("season_code") == "1996").select("match_id")
    kept = union.join(closed, "match_id", "left_anti")
    return round6(kept.select("match_id", "home_team", "away_team", "over_odds", "under_odds"), "over_odds", "under_odds")


@query(
    "team_sets",
    f"""WITH {MATCHES_CTE} SELECT team FROM (SELECT home_team AS team FROM matches WHERE league_code <= 'L2' UNION SELECT away_team FROM matches WHERE league_code > 'L2')
    EXCEPT SELECT c_custkey * 3 FROM customer""",
)
def team_sets(spark, sf_dir):
    df = matches(spark, sf_dir)
    home = df.filter(F.col("league_code") <= "L2").select(F.col("home_team").alias("team"))
    away = df.filter(F.col("league_code") > "L2").select("away_team")
    known = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("team"))
    return home.union(away).distinct().join(known, "team", "left_anti")


@query(
    "replace_slice",
    f"""WITH {MATCHES_CTE} SELECT match_id, league_code, season_code, home_goals FROM matches WHERE NOT (season_code = '1997' AND league_code IN ('L0', 'L1'))
    UNION ALL SELECT match_id, league_code, season_code, home_goals + 100 FROM matches WHERE season_code = '1997' AND league_code = 'L0'""",
)
def replace_slice(spark, sf_dir):
    df = matches(spark, sf_dir).select("match_id", "league_code", "season_code", "home_goals")
    stale = (F.col("season_code") == "1997") & F.col("league_code").isin("L0", "L1")
    fresh = df.filter((F.col("season_code") == "1997") & (F.col("league_code") == "L0")).withColumn("home_goals", F.col("home_goals") + 100)
    return joins.replace_rows(df, stale, fresh)


@query(
    "upsert_season",
    f"""WITH {MATCHES_CTE}, c AS (SELECT match_id, season_code, match_date, home_team, away_team, home_goals AS v FROM matches WHERE season_code < '1999'),
    f AS (SELECT match_id, season_code, match_date, home_team, away_team, home_goals + 10 AS v FROM matches WHERE season_code >= '1998'),
    b AS (SELECT *, 0 AS fresh FROM c WHERE season_code NOT IN (SELECT season_code FROM f) UNION ALL SELECT *, 1 FROM f)
    SELECT match_id, season_code, match_date, home_team, away_team, v FROM b QUALIFY row_number() OVER (PARTITION BY match_date, home_team, away_team ORDER BY fresh DESC, match_id DESC) = 1""",
)
def upsert_season(spark, sf_dir):
    rows = matches(spark, sf_dir).select("match_id", "season_code", "match_date", "home_team", "away_team", F.col("home_goals").alias("v"))
    cached = rows.filter(F.col("season_code") < "1999")
    fresh = rows.filter(F.col("season_code") >= "1998").withColumn("v", F.col("v") + 10)
    return upserts.upsert(cached, fresh, "season_code", ["match_date", "home_team", "away_team"], [F.col("match_id")])


@query(
    "season_refresh",
    f"""WITH {MATCHES_CTE} SELECT DISTINCT season_code FROM matches WHERE season_code = '2001' OR season_code NOT IN (SELECT season_code FROM matches WHERE league_code = 'L1' AND season_code <> '1997')""",
)
def season_refresh(spark, sf_dir):
    df = matches(spark, sf_dir)
    cached = df.filter((F.col("league_code") == "L1") & (F.col("season_code") != "1997"))
    return upserts.seasons_to_refresh(df, cached, "season_code", F.lit("2001"))


@query(
    "profile_counts",
    f"""WITH {MATCHES_CTE} SELECT league_code, count(*) AS matches, count(DISTINCT season_code) AS seasons, min(season_code) AS first_season, max(season_code) AS last_season, min(match_date) AS first_date, max(match_date) AS last_date,
      round(avg(home_goals), 6) AS home_mean, round(avg(away_goals), 6) AS away_mean, round(avg(home_goals + away_goals), 6) AS total_mean,
      {", ".join(f"round(avg(CAST(home_goals + away_goals > {k} AS INT)), 6) AS over_{k}_5" for k in (1, 2, 3))},
      round(avg(CAST(home_goals > away_goals AS INT)), 6) AS home_share, round(avg(CAST(home_goals = away_goals AS INT)), 6) AS draw_share, round(avg(CAST(home_goals < away_goals AS INT)), 6) AS away_share,
      round(avg(CAST(over_odds IS NOT NULL AS INT)), 6) AS odds_rate FROM matches GROUP BY 1""",
)
def profile_counts(spark, sf_dir):
    home, away = F.col("home_goals"), F.col("away_goals")

    def share(condition):
        return F.round(F.avg(condition.cast("double")), 6)

    return matches(spark, sf_dir).groupBy("league_code").agg(
        F.count(F.lit(1)).alias("matches"), F.count_distinct("season_code").alias("seasons"),
        F.min("season_code").alias("first_season"), F.max("season_code").alias("last_season"),
        F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"),
        F.round(F.avg(home), 6).alias("home_mean"), F.round(F.avg(away), 6).alias("away_mean"),
        F.round(F.avg(home + away), 6).alias("total_mean"),
        *[share(home + away > k + 0.5).alias(f"over_{k}_5") for k in (1, 2, 3)],
        share(home > away).alias("home_share"), share(home == away).alias("draw_share"), share(home < away).alias("away_share"),
        share(F.col("over_odds").isNotNull()).alias("odds_rate"),
    )


@query(
    "league_teams",
    f"""WITH {PARTICIPANTS_CTE}, t AS (SELECT DISTINCT league_code, team FROM participants) SELECT league_code, team, count(*) OVER (PARTITION BY league_code) AS teams FROM t""",
)
def league_teams(spark, sf_dir):
    """Teams of each league as rows, with their number."""
    teams = participants(spark, sf_dir).select("league_code", "team").distinct()
    return teams.join(teams.groupBy("league_code").agg(F.count(F.lit(1)).alias("teams")), "league_code")


# --- scoring of upcoming fixtures with fixed coefficients in place of a fitted model


def scored_fixtures(spark, sf_dir) -> DataFrame:
    states = latest_states(participants(spark, sf_dir))
    df = joins.latest_for_fixtures(fixtures(spark, sf_dir), states, ["league_code", "team"], STATE_NAMES)
    home = F.exp(-0.2 + 0.15 * F.col("home_avg_for_5") + 0.1 * F.col("away_avg_against_5"))
    away = F.exp(-0.3 + 0.15 * F.col("away_avg_for_5") + 0.1 * F.col("home_avg_against_5"))
    key = F.col("fixture_id")
    return df.select(
        "fixture_id", "league_code", "home_team", "away_team",
        poisson.clip(home, 0.1, 5.0).alias("pred_home"), poisson.clip(away, 0.1, 5.0).alias("pred_away"),
        (F.lit(1.4) + (key % 13) / 10.0).alias("over_odds"), F.when(key % 5 > 0, F.lit(1.5) + (key % 11) / 10.0).alias("under_odds"),
    )


SCORED_CTE = f"""{PARTICIPANTS_CTE}, {FIXTURES_CTE}, s AS (
      SELECT league_code, team, avg(goals_for) OVER t AS f, avg(goals_against) OVER t AS g
      FROM participants WINDOW t AS (PARTITION BY league_code, team ORDER BY match_date, match_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
      QUALIFY row_number() OVER (PARTITION BY league_code, team ORDER BY match_date DESC, match_id DESC) = 1),
    scored AS (SELECT x.*, least(greatest(exp(-0.2e0 + 0.15e0 * h.f + 0.1e0 * a.g), 0.1e0), 5e0) AS pred_home, least(greatest(exp(-0.3e0 + 0.15e0 * a.f + 0.1e0 * h.g), 0.1e0), 5e0) AS pred_away,
      1.4e0 + (fixture_id % 13) / 10e0 AS over_odds, CASE WHEN fixture_id % 5 > 0 THEN 1.5e0 + (fixture_id % 11) / 10e0 END AS under_odds
      FROM fixtures x JOIN s h ON h.league_code = x.league_code AND h.team = x.home_team JOIN s a ON a.league_code = x.league_code AND a.team = x.away_team),
    priced_fixtures AS (SELECT *, pred_home + pred_away AS total, {sql_cdf(2, 'least(greatest(pred_home + pred_away, 0.1e0), 6e0)')} AS under FROM scored)"""


@query(
    "score_fixtures",
    f"""WITH {SCORED_CTE}, e AS (SELECT *, CASE WHEN 1 - under BETWEEN 0.35e0 AND 0.75e0 THEN (1 - under) * over_odds - 1 END AS eo, CASE WHEN under_odds IS NOT NULL AND under BETWEEN 0.35e0 AND 0.75e0 THEN under * under_odds - 1 END AS eu FROM priced_fixtures)
    SELECT fixture_id, round(pred_home, 6) AS pred_home, round(pred_away, 6) AS pred_away, CASE WHEN eu IS NULL OR eo >= eu THEN 'Over' ELSE 'Under' END AS selection, round(greatest(eo, eu), 6) AS edge FROM e WHERE greatest(eo, eu) >= 0.1e0""",
)
def score_fixtures(spark, sf_dir):
    df = scored_fixtures(spark, sf_dir).withColumns(
        {
            "pred_total_goals": F.col("pred_home") + F.col("pred_away"),
            "line": F.lit(2.5),
            "cal_over_prob": F.lit(None).cast("double"),
            "cal_under_prob": F.lit(None).cast("double"),
        }
    )
    picked = staking.pick_signals(df).select("fixture_id", "pred_home", "pred_away", "selection", "edge")
    return round6(picked, "pred_home", "pred_away", "edge")


@query(
    "score_with_fallback",
    f"""WITH {SCORED_CTE}, m AS (SELECT league_code, avg(home_goals) AS h, avg(away_goals) AS a FROM matches WHERE league_code <> 'L4' GROUP BY 1)
    SELECT x.fixture_id, round(coalesce(p.pred_home, m.h, 1.5e0), 2) AS pred_home_goals, round(coalesce(p.pred_away, m.a, 1.2e0), 2) AS pred_away_goals
    FROM fixtures x LEFT JOIN (SELECT * FROM scored WHERE league_code <> 'L3' AND league_code <> 'L4') p USING (fixture_id) LEFT JOIN m ON m.league_code = x.league_code""",
)
def score_with_fallback(spark, sf_dir):
    """Model where both teams have form, else the competition's means, else fixed defaults; rounded for display."""
    known = scored_fixtures(spark, sf_dir).filter(~F.col("league_code").isin("L3", "L4")).select("fixture_id", "pred_home", "pred_away")
    means = (
        matches(spark, sf_dir).filter(F.col("league_code") != "L4").groupBy("league_code")
        .agg(F.avg("home_goals").alias("h"), F.avg("away_goals").alias("a"))
    )
    joined = fixtures(spark, sf_dir).join(known, "fixture_id", "left").join(means, "league_code", "left")
    return joined.select(
        "fixture_id",
        F.round(F.coalesce("pred_home", "h", F.lit(1.5)), 2).alias("pred_home_goals"),
        F.round(F.coalesce("pred_away", "a", F.lit(1.2)), 2).alias("pred_away_goals"),
    )
