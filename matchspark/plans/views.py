"""The provided tables seen as paired events, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.operators import reshape
from matchspark.plans.catalog import table

TEAMS = 120
SERIES_ORDER = ("match_date", "match_id")


def whole(value: Column) -> Column:
    return F.floor(value).cast("long")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches between two of 120 teams in five leagues."""
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    home, away = cust % TEAMS, (key * 7 + 3) % TEAMS
    over = F.when(key % 11 != 0, F.lit(1.2) + (key % 17) / F.lit(10.0))
    under = F.when(key % 13 != 0, F.lit(1.2) + (key % 19) / F.lit(10.0))
    return (
        table(spark, sf_dir, "orders")
        .filter(home != away)
        .select(
            key.alias("match_id"),
            F.to_date("o_orderdate").alias("match_date"),
            F.concat(F.lit("L"), (key % 5).cast("string")).alias("league_code"),
            F.year("o_orderdate").cast("string").alias("season_code"),
            home.alias("home_team"),
            away.alias("away_team"),
            (whole(price) % 5).alias("home_goals"),
            (whole(price / 7) % 4).alias("away_goals"),
            over.alias("over_odds"),
            under.alias("under_odds"),
        )
    )


MATCHES_CTE = """matches AS (
  SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date,
         CONCAT('L', CAST(o_orderkey % 5 AS VARCHAR)) AS league_code,
         CAST(year(o_orderdate) AS VARCHAR) AS season_code,
         o_custkey % 120 AS home_team, (o_orderkey * 7 + 3) % 120 AS away_team,
         CAST(floor(o_totalprice) AS BIGINT) % 5 AS home_goals,
         CAST(floor(o_totalprice / 7) AS BIGINT) % 4 AS away_goals,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 1.2e0 + (o_orderkey % 17) / 10e0 END AS over_odds,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 1.2e0 + (o_orderkey % 19) / 10e0 END AS under_odds
  FROM orders WHERE o_custkey % 120 <> (o_orderkey * 7 + 3) % 120)"""


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = ["match_id", "match_date", "league_code", "season_code"]
    return reshape.participants(matches(spark, sf_dir), shared, reshape.goal_sides())


PARTICIPANTS_CTE = (
    MATCHES_CTE
    + """, participants AS (
  SELECT match_id, match_date, league_code, season_code, TRUE AS is_home, home_team AS team,
         away_team AS opponent, home_goals AS goals_for, away_goals AS goals_against FROM matches
  UNION ALL
  SELECT match_id, match_date, league_code, season_code, FALSE, away_team, home_team,
         away_goals, home_goals FROM matches)"""
)


def round6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})
