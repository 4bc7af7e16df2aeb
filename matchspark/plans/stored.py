"""Queries that write a view with a sink, read it back through a reader and return what was read.

Each run writes under a folder of its own in the shared folder of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchspark.plans.catalog import query
from matchspark.plans.views import MATCHES_CTE, matches
from matchspark.session import shared_dir
from matchspark.sources import files, sinks, text

KEPT = ["match_id", "match_date", "league_code", "season_code", "home_team", "away_team", "home_goals"]
KEPT_SQL = ", ".join(KEPT)


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("stage_table", f"WITH {MATCHES_CTE} SELECT {KEPT_SQL} FROM matches")
def stage_table(spark, sf_dir):
    """A stage's table, written over an older one and read as an optional table."""
    path = _folder(spark, "stage")
    rows = matches(spark, sf_dir).select(*KEPT)
    sinks.write_stage(rows.filter("season_code = '1995'"), path)
    sinks.write_stage(rows, path)
    return files.optional_table(spark, path)


@query(
    "season_partitions",
    f"""WITH {MATCHES_CTE} SELECT match_id, match_date, league_code, season_code, home_team, away_team,
      home_goals + CASE WHEN season_code = '1997' THEN 10 ELSE 0 END AS home_goals FROM matches""",
)
def season_partitions(spark, sf_dir):
    """Partitions by league and season, of which those of one season are then replaced."""
    path = _folder(spark, "partitions")
    rows = matches(spark, sf_dir).select(*KEPT)
    sinks.write_partitions(rows, path, ["league_code", "season_code"])
    changed = rows.filter("season_code = '1997'").withColumn("home_goals", F.col("home_goals") + 10)
    sinks.write_partitions(changed, path, ["league_code", "season_code"])
    return spark.read.parquet(path).select(*KEPT).withColumn("season_code", F.col("season_code").cast("string"))


@query(
    "closed_seasons",
    f"""WITH {MATCHES_CTE} SELECT match_id, league_code, season_code, home_goals + CASE WHEN season_code = '1998' OR league_code = 'L4' THEN 10 ELSE 0 END AS home_goals FROM matches""",
)
def closed_seasons(spark, sf_dir):
    """Seasons already stored stay as they are, but for the current one and leagues not stored yet."""
    path = _folder(spark, "seasons")
    rows = matches(spark, sf_dir).select("match_id", "league_code", F.col("season_code").alias("s"), "home_goals")
    rows = rows.withColumn("Season", F.concat("s", F.lit("/"), (F.col("s").cast("int") + 1).cast("string"))).drop("s")
    sinks.write_seasons(rows.filter("league_code <> 'L4'"), path, "9899")
    sinks.write_seasons(rows.withColumn("home_goals", F.col("home_goals") + 10), path, "9899")
    start = F.lpad(F.col("season_code").cast("string"), 4, "0").substr(1, 2).cast("int")
    year = (start + F.when(start > 50, 1900).otherwise(2000)).cast("string")
    return spark.read.parquet(path).select("match_id", "league_code", year.alias("season_code"), "home_goals")


@query(
    "upsert_stored",
    f"""WITH {MATCHES_CTE} SELECT match_id, match_date, season_code, home_team, away_team, home_goals + CASE WHEN season_code >= '1998' THEN 10 ELSE 0 END AS home_goals
      FROM matches QUALIFY row_number() OVER (PARTITION BY match_date, home_team, away_team ORDER BY match_id DESC) = 1""",
)
def upsert_stored(spark, sf_dir):
    """A first load of the old seasons, then fresh rows that replace one season and add the later ones."""
    path = _folder(spark, "upsert")
    rows = matches(spark, sf_dir).select("match_id", "match_date", "season_code", "home_team", "away_team", "home_goals")
    fresh = rows.filter("season_code >= '1998'").withColumn("home_goals", F.col("home_goals") + 10)
    key, order = ["match_date", "home_team", "away_team"], [F.col("match_id")]
    sinks.upsert_seasons(spark, rows.filter("season_code <= '1998'"), path, "season_code", key, order)
    sinks.upsert_seasons(spark, fresh, path, "season_code", key, order)
    stored = spark.read.parquet(path).select(*rows.columns)
    return stored.withColumn("season_code", F.col("season_code").cast("string"))


@query("first_table", f"WITH {MATCHES_CTE} SELECT {KEPT_SQL} FROM matches")
def first_table(spark, sf_dir):
    """The first of several places that has a table with the wanted columns."""
    root, rows = _folder(spark, "places"), matches(spark, sf_dir).select(*KEPT)
    rows.select("match_id").write.parquet(f"{root}/narrow")
    rows.write.parquet(f"{root}/whole")
    return files.first_available(spark, [f"{root}/missing", f"{root}/narrow", f"{root}/whole"], KEPT)


@query(
    "stored_fixtures",
    f"""WITH {MATCHES_CTE} SELECT match_id, match_date AS "Date", round(over_odds, 2) AS best_over_odds, CASE WHEN match_id % 13 <> 0 THEN round(under_odds, 2) END AS best_under_odds FROM matches""",
)
def stored_fixtures(spark, sf_dir):
    """Upcoming fixtures as text, with prices that are no numbers."""
    path = _folder(spark, "fixtures")
    rows = matches(spark, sf_dir).select(
        "match_id", F.date_format("match_date", "dd/MM/yyyy").alias("Date"),
        F.coalesce(F.round("over_odds", 2).cast("string"), F.lit("-")).alias("best_over_odds"),
        F.coalesce(F.round("under_odds", 2).cast("string"), F.lit("n/a")).alias("best_under_odds"),
    )
    sinks.write_stage(rows, path, "csv", header=True)
    return files.fixtures_csv(spark, path).withColumn("match_id", F.col("match_id").cast("long"))


@query("json_fixtures", f"WITH {MATCHES_CTE} SELECT match_id, league_code, home_team FROM matches")
def json_fixtures(spark, sf_dir):
    """Fixtures of which only the JSON form is there."""
    stem = _folder(spark, "fixtures")
    rows = matches(spark, sf_dir).select("match_id", "league_code", "home_team")
    sinks.write_stage(rows, f"{stem}.json", "json")
    return files.fixtures_any(spark, stem, multiline=False).select("match_id", "league_code", "home_team")


@query(
    "test_prices",
    f"""WITH {MATCHES_CTE} SELECT match_id, over_odds AS best_over_odds, under_odds AS best_under_odds FROM matches
      WHERE season_code >= '1997' AND (over_odds IS NOT NULL OR under_odds IS NOT NULL)""",
)
def test_prices(spark, sf_dir):
    """Priced rows of the test split of a stored prediction table."""
    path = _folder(spark, "predictions")
    split = F.when(F.col("season_code") >= "1997", "test").otherwise("train").alias("dataset_split")
    prices = [F.col(f"{s}_odds").alias(f"best_{s}_odds") for s in ("over", "under")]
    sinks.write_stage(matches(spark, sf_dir).select("match_id", split, *prices), path)
    return files.test_predictions(files.optional_table(spark, path)).drop("dataset_split")


@query(
    "side_table_rows",
    f"""WITH {MATCHES_CTE} SELECT 'managers' AS side, home_team AS team, count(*) AS n FROM matches GROUP BY 2
      UNION ALL SELECT 'weather', away_team, count(*) FROM matches GROUP BY 2""",
)
def side_table_rows(spark, sf_dir):
    """Those side tables that exist, counted by team."""
    root, rows = _folder(spark, "side"), matches(spark, sf_dir)
    sinks.write_stage(rows.select(F.col("home_team").alias("team")), f"{root}/managers")
    sinks.write_stage(rows.select(F.col("away_team").alias("team")), f"{root}/weather")
    found = files.side_tables(spark, root, ["injuries", "managers", "weather"])
    tables = [t.select(F.lit(n).alias("side"), "team") for n, t in found.items()]
    return tables[0].union(tables[1]).groupBy("side", "team").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stored_pages",
    f"""WITH {MATCHES_CTE} SELECT match_id, league_code AS league, home_goals FROM matches""",
)
def stored_pages(spark, sf_dir):
    """Text files of many lines each, read whole as pages and taken apart again."""
    path = _folder(spark, "pages")
    row = F.concat_ws(";", F.col("match_id").cast("string"), "league_code", F.col("home_goals").cast("string"))
    matches(spark, sf_dir).select(row.alias("value")).write.text(path)

    def parse(pages):
        parts = F.split("line", ";")
        fields = {"match_id": (0, "long"), "league": (1, "string"), "home_goals": (2, "long")}
        return text.lines(pages, ["page"], "text").select(*[parts[i].cast(t).alias(n) for n, (i, t) in fields.items()])

    return files.parse_pages(spark, path, parse)


@query(
    "narrow_rows",
    f"""WITH {MATCHES_CTE} SELECT match_date AS "Date", 'T' || CAST(home_team AS VARCHAR) AS "HomeTeam", 'T' || CAST(away_team AS VARCHAR) AS "AwayTeam",
      CAST(home_goals AS INT) AS "FTHG", CAST(away_goals AS INT) AS "FTAG" FROM matches WHERE match_id % 5 <> 0""",
)
def narrow_rows(spark, sf_dir):
    """The required columns of stored text rows, complete rows only."""
    path, rows = _folder(spark, "narrow"), matches(spark, sf_dir)
    goals = F.when(F.col("match_id") % 5 == 0, "abandoned").otherwise(F.col("home_goals").cast("string"))
    raw = rows.select(
        F.date_format("match_date", "dd/MM/yyyy").alias("Date"), F.concat(F.lit("T"), F.col("home_team").cast("string")).alias("HomeTeam"),
        F.concat(F.lit("T"), F.col("away_team").cast("string")).alias("AwayTeam"), goals.alias("FTHG"), F.col("away_goals").cast("string").alias("FTAG"),
        F.lit("x").alias("Referee"),
    )
    sinks.write_stage(raw, path, "csv", header=True)
    return files.narrow_matches(files.optional_table(spark, path, "csv", header=True))


@query(
    "typed_rows",
    f"""WITH {MATCHES_CTE} SELECT match_date AS "Date", CAST(home_goals AS INT) AS "FTHG", CAST(away_goals AS INT) AS "FTAG", CASE WHEN match_id % 5 <> 0 THEN CAST(home_goals + 7 AS DOUBLE) END AS "HS",
      concat_ws('_', league_code, season_code, strftime(match_date, '%Y-%m-%d'), CAST(home_team AS VARCHAR), CAST(away_team AS VARCHAR)) AS match_id, CAST(home_goals + away_goals AS INT) AS total_goals FROM matches""",
)
def typed_rows(spark, sf_dir):
    """Stored text rows with dates, goals, statistics and keys made from them."""
    path, rows = _folder(spark, "typed"), matches(spark, sf_dir)
    shots = F.when(F.col("match_id") % 5 == 0, "").otherwise((F.col("home_goals") + 7).cast("string"))
    raw = rows.select(
        "league_code", "season_code", F.date_format("match_date", "dd/MM/yy").alias("Date"), F.col("home_team").cast("string").alias("HomeTeam"),
        F.col("away_team").cast("string").alias("AwayTeam"), F.col("home_goals").alias("FTHG"), F.col("away_goals").alias("FTAG"), shots.alias("HS"),
    )
    sinks.write_stage(raw, path, "csv", header=True)
    typed = files.typed_matches(files.optional_table(spark, path, "csv", header=True))
    return typed.select("Date", "FTHG", "FTAG", "HS", "match_id", "total_goals")


@query(
    "folder_rows",
    f"""WITH {MATCHES_CTE} SELECT league_code, season_code, match_date AS "Date", 'Club "' || CAST(home_team AS VARCHAR) || '", north' || chr(10) || 'side' AS "HomeTeam",
      CAST(home_goals AS INT) AS "FTHG", CAST(away_goals AS INT) AS "FTAG", CASE WHEN season_code >= '1998' THEN CAST(home_goals + 7 AS DOUBLE) END AS "HS" FROM matches WHERE league_code <> 'L4'""",
)
def folder_rows(spark, sf_dir):
    """A folder of one file for each league and season, headers of two kinds, fields quoted over lines; files without goals are skipped."""
    path, rows = _folder(spark, "folder"), matches(spark, sf_dir)
    name = F.concat(F.lit('Club "'), F.col("home_team").cast("string"), F.lit('", north\nside'))
    raw = rows.select(
        F.col("league_code").alias("league"), F.col("season_code").alias("season"), F.date_format("match_date", "dd/MM/yyyy").alias("Date"),
        name.alias("HomeTeam"), F.col("away_team").cast("string").alias("AwayTeam"), F.col("home_goals").alias("FTHG"), F.col("away_goals").alias("FTAG"),
    )
    late = F.col("season") >= "1998"
    kinds = {
        "early": raw.filter(~late & (F.col("league") != "L4")),
        "late": raw.filter(late & (F.col("league") != "L4")).withColumn("HS", F.col("FTHG") + 7),
        "odd": raw.filter(F.col("league") == "L4").drop("FTHG"),
    }
    for kind, part in kinds.items():
        part.repartition("league", "season").write.partitionBy("league", "season").csv(f"{path}/{kind}", header=True, escape='"')
    typed = files.typed_matches(files.match_folder(spark, path, naming=r"league=([^/]+)/season=([^/]+)/[^/]+$"))
    return typed.select("league_code", "season_code", "Date", "HomeTeam", "FTHG", "FTAG", "HS")
