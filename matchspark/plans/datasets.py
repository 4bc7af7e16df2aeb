"""The two prepared tables models are trained on: domestic and European."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.functions import conform
from matchspark.operators import names, reshape, sequences
from matchspark.plans.catalog import query
from matchspark.plans.lookups import (
    DOMESTIC_FORM,
    DOMESTIC_STATE,
    domestic,
    impute_by_name,
    with_domestic_form,
)
from matchspark.plans.conforming import ROUNDS
from matchspark.plans.series import SERIES_WINDOW, league_means
from matchspark.plans.views import PARTICIPANTS_CTE, SERIES_ORDER, matches, round6
from matchspark.session import cut

# Raw columns and their names here; paired statistics per match.
RAW = {"Date": "match_date", "HomeTeam": "home_team", "AwayTeam": "away_team", "FTHG": "home_goals", "FTAG": "away_goals"}
PAIRED = {"shots": ("HS", "AS"), "sot": ("HST", "AST"), "corners": ("HC", "AC"), "fouls": ("HF", "AF")}
AVERAGED = (
    "for", "against", "diff", "shots_for", "shots_against", "sot_for", "sot_against", "corners_for", "corners_against",
    "conversion", "accuracy", "opp_conversion",
)


def domestic_dataset(
    typed: DataFrame,
    windows: Sequence[int] = (3, 5, 10),
    minimum: int = 5,
    line: float = 2.5,
    required: Sequence[str] | None = None,
    entity: Sequence[str] = ("team",),
) -> DataFrame:
    """Match features from typed raw matches, one row per match with enough history on both sides.

    Match columns ride through the team series as grouping keys, so putting the
    two teams side by side again needs no join. ``required`` limits the columns
    that must be filled (all averages by default).
    """
    df = typed.withColumnsRenamed(RAW)
    absent = {c: F.lit(None).cast("double") for pair in PAIRED.values() for c in pair if c not in df.columns}
    odds = {
        "best_over_odds": conform.best_price(df, conform.with_suffix(df, ">2.5")),
        "best_under_odds": conform.best_price(df, conform.with_suffix(df, "<2.5")),
        "market_total_line": F.lit(line),
    }
    match = ["match_id", "match_date", "league_code", "season_code", "home_team", "away_team"]
    numeric = ["home_goals", "away_goals", "total_goals", *odds]
    statistics = [c for pair in PAIRED.values() for c in pair]
    rated = league_means(df.withColumns({**absent, **odds}).select(*match, *numeric, *statistics))
    numeric += [f"league_avg_{k}_goals" for k in ("home", "away", "total")]
    sides = reshape.goal_sides(PAIRED)
    rows = reshape.participants(rated, [*match, *numeric], sides).withColumnsRenamed(
        {"goals_for": "for", "goals_against": "against"}
    )
    rows = rows.withColumns(
        {
            "diff": F.col("for") - F.col("against"),
            "conversion": conform.ratio(F.col("for"), F.col("shots_for")),
            "accuracy": conform.ratio(F.col("sot_for"), F.col("shots_for")),
            "opp_conversion": conform.ratio(F.col("against"), F.col("shots_against")),
        }
    )
    numbered = sequences.number(rows, list(entity), SERIES_ORDER, F.col("match_date"), "matches_played")
    trailing = {f"avg_{m}_{w}": sequences.trailing_mean(m, w) for w in windows for m in AVERAGED}
    for m, name in (("for", "goals_for"), ("against", "goals_against"), ("shots_for",) * 2, ("shots_against",) * 2):
        trailing[f"recent_{name}"] = sequences.trailing_sum(m, 5)
    weighted = {f"ema_{m}_{w}": (m, w) for w in windows for m in ("for", "against")}
    formed = sequences.form(numbered, list(entity), "matches_played", trailing, weighted)
    features = ["matches_played", *trailing, *weighted]
    wide = reshape.back_to_matches(formed, match, features, carried={c: c for c in numeric})
    if required is None:
        required = [c for c in wide.columns if c.startswith(("home_avg", "away_avg"))]
    enough = (F.col("home_matches_played") >= minimum) & (F.col("away_matches_played") >= minimum)
    return wide.dropna(subset=list(required)).filter(enough)


EURO_FORM = [f"euro_{k}_{m}_{w}" for w in (3, 5) for k in ("avg", "ema") for m in ("for", "against")]
EURO_TOTALS = ["euro_total_goals_for", "euro_total_goals_against"]


def european_dataset(
    df: DataFrame, domestic_rows: DataFrame, aliases: DataFrame | None = None, resolve: bool = True, minimum: int = 2
) -> DataFrame:
    """European match features: stage, competition means, European and domestic form of both teams.

    ``df`` has match columns with ``competition_code`` and ``round``;
    ``domestic_rows`` the domestic participant rows. ``resolve`` maps team names
    to domestic ones first. A match stays if either team played ``minimum`` before.
    """
    staged = df.withColumns({k: v.cast("int") for k, v in conform.stage(F.col("round")).items()}).drop("round")
    # written once: the series below reads it twice, and it reads its own source twice
    rated = cut(league_means(staged, minimum=5, group="competition_code", prefix="comp_avg"), "rated")
    match = ["match_id", "match_date", "competition_code", "season_code", "home_team", "away_team"]
    numeric = [c for c in rated.columns if c not in match]
    rows = reshape.participants(rated, [*match, *numeric], reshape.goal_sides())
    totals = {f"euro_total_{c}": sequences.sum_of(F.col(c)) for c in ("goals_for", "goals_against")}
    measures = {"european_matches": sequences.rows_before(), **totals}
    summed = sequences.running(rows, ["team"], SERIES_ORDER, F.col("match_date"), measures)
    trailing = {f"euro_avg_{m}_{w}": sequences.trailing_mean(f"goals_{m}", w) for w in (3, 5) for m in ("for", "against")}
    weighted = {f"euro_ema_{m}_{w}": (f"goals_{m}", w) for w in (3, 5) for m in ("for", "against")}
    formed = cut(sequences.form(summed, ["team"], "european_matches", trailing, weighted), "european")
    if resolve:
        own = formed.select(F.col("team").alias("name"))
        known = names.resolve(own, domestic_rows.select(F.col("team").alias("target")), aliases)
        named = formed.join(known.select(F.col("name").alias("team"), F.col("target").alias("domestic_team")), "team", "left")
        asked = named.withColumnsRenamed({"team": "european_team", "domestic_team": "team"})
        found = with_domestic_form(asked, domestic_rows).drop("team").withColumnRenamed("european_team", "team")
    else:
        found = with_domestic_form(formed, domestic_rows)
    features = ["european_matches", *EURO_FORM, *EURO_TOTALS, "dom_total_games", *DOMESTIC_FORM]
    wide = reshape.back_to_matches(found, match, features, carried={c: c for c in numeric})
    filled = [f"{s}_{c}" for s in ("home", "away") for c in features[1:]]
    wide = impute_by_name(wide, filled, "comp_avg_home_goals", "comp_avg_away_goals")
    played = [F.coalesce(f"{s}_european_matches", F.lit(0)) >= minimum for s in ("home", "away")]
    return wide.filter(played[0] | played[1])


SHOWN = ["euro_avg_for_3", "euro_avg_against_5", "dom_avg_for", "dom_avg_against", "dom_home_pct"]


def _filled(alias: str, name: str) -> str:
    fill = "c.comp_home" if "for" in name else "c.comp_away" if "against" in name else "0"
    return f"coalesce({alias}.{name}, {fill})"


@query(
    "european_dataset",
    f"""WITH {PARTICIPANTS_CTE}, {DOMESTIC_STATE},
    r AS (SELECT *, CASE match_id % 7 {" ".join(f"WHEN {i} THEN lower('{n}')" for i, n in enumerate(ROUNDS))} ELSE '' END AS t FROM matches),
    c AS (SELECT match_id, {", ".join(
        f"coalesce(CASE WHEN count({k}_goals) OVER w >= 5 THEN avg({k}_goals) OVER w END, (SELECT avg({k}_goals) FROM matches)) AS comp_{k}" for k in ("home", "away"))}
        FROM matches WINDOW w AS (PARTITION BY league_code ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e AS (SELECT match_id, is_home, row_number() OVER w - 1 AS european_matches, avg(goals_for) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS euro_avg_for_3,
          avg(goals_against) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS euro_avg_against_5,
          sum(goals_for) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS euro_total_goals_for FROM participants {SERIES_WINDOW}),
    f AS (SELECT * FROM e JOIN (SELECT match_id, is_home, dom_avg_for, dom_avg_against, dom_home_pct FROM dom_asof) USING (match_id, is_home))
    SELECT r.match_id, CAST(contains(t, '16') OR contains(t, 'quarter') OR contains(t, 'semi') OR contains(t, 'final') AS INT) AS is_knockout, round(c.comp_home, 6) AS comp_avg_home_goals,
      h.european_matches AS home_european_matches, a.european_matches AS away_european_matches, CAST({_filled('h', 'euro_total_goals_for')} AS DOUBLE) AS home_euro_total_goals_for,
      {", ".join(f"round({_filled(s[0], n)}, 6) AS {s}_{n}" for s in ("home", "away") for n in SHOWN)}
    FROM r JOIN c USING (match_id) JOIN f h ON h.match_id = r.match_id AND h.is_home JOIN f a ON a.match_id = r.match_id AND NOT a.is_home
    WHERE h.european_matches >= 2 OR a.european_matches >= 2""",
)
def european_query(spark, sf_dir):
    stage_names = F.array(*[F.lit(r) for r in ROUNDS])
    df = (
        matches(spark, sf_dir)
        .drop("over_odds", "under_odds")
        .withColumn("round", F.get(stage_names, (F.col("match_id") % 7).cast("int")))
        .withColumnRenamed("league_code", "competition_code")
    )
    dom = reshape.participants(domestic(spark, sf_dir), ["match_id", "match_date"], reshape.goal_sides()).drop("opponent")
    wide = european_dataset(df, dom, resolve=False)
    shown = [f"{s}_{n}" for s in ("home", "away") for n in SHOWN]
    kept = wide.select(
        "match_id", "is_knockout", "comp_avg_home_goals", "home_european_matches", "away_european_matches",
        F.col("home_euro_total_goals_for").cast("double").alias("home_euro_total_goals_for"), *shown,
    )
    return round6(kept, "comp_avg_home_goals", *shown)
