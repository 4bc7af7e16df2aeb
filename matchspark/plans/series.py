"""Queries over ordered team series: unpivot, form windows, expanding means, the match dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.operators import reshape, sequences
from matchspark.plans.catalog import query
from matchspark.plans.views import MATCHES_CTE, PARTICIPANTS_CTE, SERIES_ORDER, matches, participants, round6

WINDOWS = (3, 5, 10)


@query(
    "participants",
    f"""WITH {PARTICIPANTS_CTE}
    SELECT match_id, match_date, league_code, season_code, is_home, team, opponent,
           goals_for, goals_against, goals_for - goals_against AS goal_diff FROM participants""",
)
def participant_rows(spark, sf_dir):
    return participants(spark, sf_dir).withColumn("goal_diff", F.col("goals_for") - F.col("goals_against"))


def numbered(df: DataFrame) -> DataFrame:
    """Participant rows with the number of matches the team played before (``matches_played``)."""
    return sequences.number(df, ["team"], SERIES_ORDER, F.col("match_date"), "matches_played")


def team_form(df: DataFrame, windows=WINDOWS, weighted=True) -> DataFrame:
    """All goal form features of a participant table in one chunked pass."""
    rows = numbered(df).withColumn("goal_diff", F.col("goals_for") - F.col("goals_against"))
    trailing, ewm = {}, {}
    for w in windows:
        trailing[f"avg_for_{w}"] = sequences.trailing_mean("goals_for", w)
        trailing[f"avg_against_{w}"] = sequences.trailing_mean("goals_against", w)
        trailing[f"avg_diff_{w}"] = sequences.trailing_mean("goal_diff", w)
        if weighted:
            ewm[f"ema_for_{w}"] = ("goals_for", w)
            ewm[f"ema_against_{w}"] = ("goals_against", w)
    trailing["recent_goals_for"] = sequences.trailing_sum("goals_for", 5)
    trailing["recent_goals_against"] = sequences.trailing_sum("goals_against", 5)
    return sequences.form(rows, ["team"], "matches_played", trailing, ewm)


def _over(fold: str, column: str, width: int) -> str:
    return f"{fold}({column}) OVER (w ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING)"


SERIES_WINDOW = "WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id)"
ROLLING_SQL = ", ".join(
    f"{_over('avg', 'goals_for', w)} AS avg_for_{w}, {_over('avg', 'goals_against', w)} AS avg_against_{w}, "
    f"{_over('avg', 'goals_for - goals_against', w)} AS avg_diff_{w}"
    for w in WINDOWS
)
ROLLING_NAMES = [f"avg_{kind}_{w}" for w in WINDOWS for kind in ("for", "against", "diff")]


def sql_rounded(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(
    "rolling_form",
    f"""WITH {PARTICIPANTS_CTE}, f AS (
      SELECT match_id, team, is_home, row_number() OVER w - 1 AS matches_played, {ROLLING_SQL},
             CAST({_over('sum', 'goals_for', 5)} AS BIGINT) AS recent_goals_for,
             CAST({_over('sum', 'goals_against', 5)} AS BIGINT) AS recent_goals_against
      FROM participants {SERIES_WINDOW})
    SELECT match_id, team, is_home, matches_played, {sql_rounded(ROLLING_NAMES)},
           recent_goals_for, recent_goals_against FROM f""",
)
def rolling_form(spark, sf_dir):
    form = team_form(participants(spark, sf_dir), weighted=False)
    kept = ["match_id", "team", "is_home", "matches_played", *ROLLING_NAMES]
    return round6(form.select(*kept, "recent_goals_for", "recent_goals_against"), *ROLLING_NAMES)


def _ewma_sql(out: str, column: str, span: int, rows: int) -> str:
    """Direct weighted sums over the last ``rows`` rows, as list expressions."""
    q = repr(1.0 - 2.0 / (span + 1))
    weights = f"list_transform(range(len({column})), lambda i: pow({q}, i))"
    return f"list_dot_product({column}, {weights}) / list_sum({weights}) AS {out}"


EWMA_ROWS = 200
EWMA_NAMES = [f"ema_{kind}_{w}" for w in WINDOWS for kind in ("for", "against")]


@query(
    "ewma_form",
    f"""WITH {PARTICIPANTS_CTE}, l AS (
      SELECT match_id, team, is_home,
             list_reverse(list(CAST(goals_for AS DOUBLE)) OVER p) AS past_for,
             list_reverse(list(CAST(goals_against AS DOUBLE)) OVER p) AS past_against
      FROM participants WINDOW p AS (PARTITION BY team ORDER BY match_date, match_id
                                     ROWS BETWEEN {EWMA_ROWS} PRECEDING AND 1 PRECEDING)),
    e AS (SELECT match_id, team, is_home, {", ".join(
        _ewma_sql(f"ema_{kind}_{w}", f"past_{kind}", w, EWMA_ROWS) for w in WINDOWS for kind in ("for", "against")
    )} FROM l)
    SELECT match_id, team, is_home, {sql_rounded(EWMA_NAMES)} FROM e""",
)
def ewma_form(spark, sf_dir):
    rows = numbered(participants(spark, sf_dir))
    ewm = {f"ema_{kind}_{w}": (f"goals_{kind}", w) for w in WINDOWS for kind in ("for", "against")}
    form = sequences.form(rows, ["team"], "matches_played", weighted=ewm)
    return round6(form.select("match_id", "team", "is_home", *EWMA_NAMES), *EWMA_NAMES)


def league_means(df: DataFrame, minimum: int = 10, group: str = "league_code", prefix: str = "league_avg") -> DataFrame:
    """Expanding group means of earlier matches; below ``minimum`` matches, the overall mean."""
    goals = {"home": F.col("home_goals"), "away": F.col("away_goals")}
    goals["total"] = goals["home"] + goals["away"]
    measures = {f"__s_{k}": sequences.sum_of(v) for k, v in goals.items()}
    measures |= {f"__k_{k}": sequences.count_of(v) for k, v in goals.items()}
    ran = sequences.running(df, [group], SERIES_ORDER, F.col("match_date"), measures)
    overall = df.agg(F.struct(*[F.avg(v).alias(k) for k, v in goals.items()])).scalar()  # one row, read once
    means = {
        k: F.when(F.col(f"__k_{k}") >= minimum, F.col(f"__s_{k}") / F.col(f"__k_{k}")) for k in goals
    }
    return ran.select(
        *df.columns, *[F.coalesce(v, overall[k]).alias(f"{prefix}_{k}_goals") for k, v in means.items()]
    )


LEAGUE_NAMES = [f"league_avg_{k}_goals" for k in ("home", "away", "total")]


@query(
    "league_expanding",
    f"""WITH {MATCHES_CTE}, g AS (SELECT *, home_goals + away_goals AS total_goals FROM matches),
    e AS (SELECT match_id, league_code, {", ".join(
        f"coalesce(CASE WHEN count({k}_goals) OVER w >= 10 THEN avg({k}_goals) OVER w END, "
        f"(SELECT avg({k}_goals) FROM g)) AS league_avg_{k}_goals" for k in ("home", "away", "total")
    )} FROM g WINDOW w AS (PARTITION BY league_code ORDER BY match_date, match_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT match_id, league_code, {sql_rounded(LEAGUE_NAMES)} FROM e""",
)
def league_expanding(spark, sf_dir):
    means = league_means(matches(spark, sf_dir)).select("match_id", "league_code", *LEAGUE_NAMES)
    return round6(means, *LEAGUE_NAMES)


@query(
    "expanding_totals",
    f"""WITH {PARTICIPANTS_CTE}
    SELECT match_id, team, is_home, row_number() OVER w - 1 AS european_matches,
           CAST(sum(goals_for) OVER e AS BIGINT) AS total_goals_for,
           CAST(sum(goals_against) OVER e AS BIGINT) AS total_goals_against,
           max(goals_for - goals_against) OVER e AS best_goal_diff
    FROM participants {SERIES_WINDOW},
         e AS (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def expanding_totals(spark, sf_dir):
    measures = {
        "european_matches": sequences.rows_before(),
        "total_goals_for": sequences.sum_of(F.col("goals_for")),
        "total_goals_against": sequences.sum_of(F.col("goals_against")),
        "best_goal_diff": sequences.max_of(F.col("goals_for") - F.col("goals_against")),
    }
    ran = sequences.running(participants(spark, sf_dir), ["team"], SERIES_ORDER, F.col("match_date"), measures)
    return ran.select("match_id", "team", "is_home", *measures)


FEATURES = ["matches_played", *ROLLING_NAMES, *EWMA_NAMES, "recent_goals_for", "recent_goals_against"]


def match_features(spark, sf_dir, minimum: int = 5) -> DataFrame:
    """Both teams' form beside each match; matches whose teams both played ``minimum`` before."""
    form = team_form(participants(spark, sf_dir))
    return feature_table(form, minimum)


def feature_table(form: DataFrame, minimum: int = 5) -> DataFrame:
    wide = reshape.back_to_matches(
        form,
        ["match_id", "match_date", "league_code", "season_code"],
        ["team", *FEATURES],
        carried={"goals_for": "home_goals", "goals_against": "away_goals"},
    )
    averages = [c for c in wide.columns if c.startswith(("home_avg", "away_avg"))]
    return wide.dropna(subset=averages).filter(
        (F.col("home_matches_played") >= minimum) & (F.col("away_matches_played") >= minimum)
    )


DATASET_NAMES = ["avg_for_5", "avg_against_5", "avg_diff_10"]


@query(
    "match_dataset",
    f"""WITH {PARTICIPANTS_CTE}, f AS (
      SELECT match_id, team, is_home, row_number() OVER w - 1 AS matches_played, {ROLLING_SQL}
      FROM participants {SERIES_WINDOW})
    SELECT m.match_id, m.match_date, m.league_code, m.season_code, m.home_team, m.away_team,
           m.home_goals, m.away_goals, h.matches_played AS home_matches_played,
           a.matches_played AS away_matches_played,
           {", ".join(f"round({s[0]}.{n}, 6) AS {s}_{n}" for s in ("home", "away") for n in ROLLING_NAMES)}
    FROM matches m JOIN f h ON h.match_id = m.match_id AND h.is_home
                   JOIN f a ON a.match_id = m.match_id AND NOT a.is_home
    WHERE h.matches_played >= 5 AND a.matches_played >= 5""",
)
def match_dataset(spark, sf_dir):
    wide = match_features(spark, sf_dir)
    shown = ["match_id", "match_date", "league_code", "season_code", "home_team", "away_team",
             "home_goals", "away_goals", "home_matches_played", "away_matches_played"]
    averages = [f"{s}_{n}" for s in ("home", "away") for n in ROLLING_NAMES]
    return round6(wide.select(*shown, *averages), *averages)
