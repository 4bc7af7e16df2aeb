"""Side tables joined to the match dataset: absences, managers, team statistics, weather, expected goals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.operators import joins, reshape
from matchspark.plans import lookups
from matchspark.plans.catalog import ORACLE, query, table
from matchspark.plans.series import match_dataset
from matchspark.plans.views import MATCHES_CTE, matches, participants

# Weights of an injury's severity; unknown ones count as moderate.
SEVERITY = {"minor": 1, "moderate": 2, "major": 4, "long-term": 5}
UNKNOWN = 2
ABSENCES = ("injury_count", "injury_severity", "suspended_count")


def beside_matches(df: DataFrame, rows: DataFrame, columns: Sequence[str], prefix: str = "") -> DataFrame:
    """Columns of rows per match and side as ``home_{prefix}{column}`` and ``away_…``, null where there is no row."""
    sides = {"home": F.col("is_home"), "away": ~F.col("is_home")}
    wide = rows.groupBy("match_id").agg(
        *[F.max(F.when(own, F.col(c))).alias(f"{side}_{prefix}{c}") for side, own in sides.items() for c in columns]
    )
    return df.join(wide, "match_id", "left")


def injury_form(rows: DataFrame, absences: DataFrame, lookback: int = 7) -> DataFrame:
    """Absences of each match and side within ``lookback`` days up to the match, as rows ``match_id, is_home, …``.

    ``absences`` has ``team, date, injury_type, severity``; a suspension in any case is no injury.
    """
    suspended = F.coalesce(F.lower(F.trim("injury_type")) == "suspension", F.lit(False))
    weight = F.lit(UNKNOWN)
    for name, value in SEVERITY.items():
        weight = F.when(F.lower("severity") == name, value).otherwise(weight)
    measures = {
        "injury_count": (~suspended).cast("long"),
        "injury_severity": F.when(~suspended, weight).otherwise(0).cast("long"),
        "suspended_count": suspended.cast("long"),
    }
    start = F.date_sub("match_date", lookback)
    return joins.interval_sums(
        rows, absences, ["team"], ["match_id", "is_home"], "match_date", "date", start, measures, None
    )


def absences(spark, sf_dir) -> DataFrame:
    """Line items as absences of 120 teams."""
    kind = F.when(F.col("l_returnflag") == "R", "Suspension").when(F.col("l_returnflag") == "A", "Knee")
    severity = F.element_at(F.array(*[F.lit(s) for s in (*SEVERITY, "unknown")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 120).alias("team"), F.to_date("l_shipdate").alias("date"), kind.alias("injury_type"),
        F.when(F.col("l_linenumber") != 7, severity).alias("severity"),
    )


INJURY_SQL = f"""WITH {MATCHES_CTE}, a AS (SELECT l_suppkey % 120 AS team, CAST(l_shipdate AS DATE) AS date, coalesce(l_returnflag = 'R', FALSE) AS suspended,
      CASE WHEN l_linenumber = 7 THEN 2 ELSE [1, 2, 4, 5, 2][CAST(l_linenumber % 5 + 1 AS INT)] END AS weight FROM lineitem),
    d AS (SELECT team, date, count(*) FILTER (WHERE NOT suspended) AS injured, coalesce(sum(weight) FILTER (WHERE NOT suspended), 0) AS severity, count(*) FILTER (WHERE suspended) AS suspended FROM a GROUP BY 1, 2),
    s AS (SELECT m.match_id, {", ".join(
        f"CAST(coalesce(sum({c}) FILTER (WHERE d.team = m.{side}_team), 0) AS BIGINT) AS {side}_{name}"
        for side in ("home", "away") for c, name in zip(("injured", "severity", "d.suspended"), ABSENCES))}
      FROM matches m LEFT JOIN d ON d.team IN (m.home_team, m.away_team) AND d.date BETWEEN m.match_date - 7 AND m.match_date GROUP BY 1)
    SELECT *, home_injury_count - away_injury_count AS injury_count_diff, home_injury_severity - away_injury_severity AS injury_severity_diff FROM s"""


def with_injuries(df: DataFrame, rows: DataFrame, absent: DataFrame) -> DataFrame:
    wide = beside_matches(df, injury_form(rows, absent), ABSENCES)
    return reshape.with_differences(wide, ["injury_count", "injury_severity"])


@query("injury_form", INJURY_SQL)
def injuries(spark, sf_dir):
    """Injuries, their severity and suspensions of both sides in the week up to each match."""
    df = matches(spark, sf_dir).select("match_id")
    rows = participants(spark, sf_dir).select("match_id", "is_home", "team", "match_date")
    return with_injuries(df, rows, absences(spark, sf_dir))


TENURE = ("tenure_days", "new_manager", "experienced_manager")
SIDES = ("home", "away")


def _side_sql(alias: str, columns: Sequence[str], prefix: str = "") -> str:
    return ", ".join(
        f"max({c}) FILTER (WHERE {'' if side == 'home' else 'NOT '}is_home) AS {side}_{prefix}{c}" for side in SIDES for c in columns
    )


@query(
    "xg_match_form",
    f"""WITH {MATCHES_CTE}, x AS (SELECT match_id, {_side_sql("x", lookups.XG_FORM)} FROM ({ORACLE["xg_form"]}) GROUP BY 1)
    SELECT m.match_id, x.* EXCLUDE (match_id) FROM matches m LEFT JOIN x USING (match_id)""",
)
def xg_match_form(spark, sf_dir):
    """Expected-goal form of both sides beside each match; null without any."""
    df = matches(spark, sf_dir).select("match_id")
    return beside_matches(df, lookups.xg_form(spark, sf_dir), lookups.XG_FORM)


@query(
    "enriched_dataset",
    f"""WITH b AS ({ORACLE["match_dataset"]}), i AS ({INJURY_SQL}),
    k AS (SELECT match_id, {_side_sql("k", TENURE)} FROM ({ORACLE["manager_tenure"]}) GROUP BY 1),
    x AS (SELECT match_id, {_side_sql("x", lookups.XG_FORM)} FROM ({ORACLE["xg_form"]}) GROUP BY 1),
    d AS (SELECT CAST(c_nationkey AS BIGINT) AS team, count(*) AS squad, round(avg(c_acctbal), 4) AS budget FROM customer GROUP BY 1),
    w AS (SELECT CAST(n_nationkey AS BIGINT) AS team, n_nationkey * 3e0 - 20 AS temperature, n_nationkey % 4 * 0.8e0 AS rain FROM nation)
    SELECT b.*, i.* EXCLUDE (match_id), k.* EXCLUDE (match_id), x.* EXCLUDE (match_id), h.squad AS home_adv_squad, h.budget AS home_adv_budget, a.squad AS away_adv_squad,
      a.budget AS away_adv_budget, h.squad - a.squad AS adv_squad_diff, round(h.budget - a.budget, 6) AS adv_budget_diff, w.temperature AS weather_temp,
      w.temperature < 5 AS weather_is_cold, w.temperature > 30 AS weather_is_hot, w.rain > 1 AS weather_is_rainy
    FROM b LEFT JOIN i USING (match_id) LEFT JOIN k USING (match_id) LEFT JOIN x USING (match_id)
      LEFT JOIN d h ON h.team = b.home_team LEFT JOIN d a ON a.team = b.away_team LEFT JOIN w ON w.team = b.home_team""",
)
def enriched_dataset(spark, sf_dir):
    """The match dataset with all side tables: what the prefixed feature names of a training set refer to."""
    df = match_dataset(spark, sf_dir)
    rows = participants(spark, sf_dir).select("match_id", "is_home", "team", "match_date")
    df = with_injuries(df, rows, absences(spark, sf_dir))
    df = beside_matches(df, lookups.manager_tenure(spark, sf_dir), TENURE)
    df = beside_matches(df, lookups.xg_form(spark, sf_dir), lookups.XG_FORM)
    df = joins.lookup(df, joins.unique_dimension(lookups.nation_stats(spark, sf_dir), ["team"]), "team", prefix="adv_")
    df = reshape.with_differences(df, ["adv_squad", "adv_budget"]).withColumn("adv_budget_diff", F.round("adv_budget_diff", 6))
    key = F.col("n_nationkey")
    weather = table(spark, sf_dir, "nation").select(
        key.cast("long").alias("team"), (key * F.lit(3.0) - 20).alias("temperature"), (key % 4 * F.lit(0.8)).alias("rain")
    )
    df = joins.lookup(df, weather, "team", sides=("home",), prefix="weather_")
    flags = lookups.weather_flags(F.col("home_weather_temperature"), F.col("home_weather_rain"))
    named = df.withColumns({"weather_temp": F.col("home_weather_temperature"), **{f"weather_is_{k}": v for k, v in flags.items()}})
    return named.drop("home_weather_temperature", "home_weather_rain")
