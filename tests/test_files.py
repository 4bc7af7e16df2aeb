"""Readers and sinks on temporary folders."""

import pytest
from pyspark.sql import functions as F

from matchspark.sources import files, sinks, text


def write(folder, name, content, encoding="utf-8"):
    (folder / name).write_bytes(content.encode(encoding))


def test_match_folder(spark, tmp_path):
    write(tmp_path, "E0_2425.csv", "﻿Date,HomeTeam,AwayTeam,FTHG,FTAG,B365>2.5\n15/08/2024,A,B,2,1,1.9\n16/08/24,C,D,0,0\n17/08/2024,E,F,1,1,2.0,extra\nbad,G,H,1,1,2\n")
    write(tmp_path, "D1_2324.csv", "Date,HomeTeam,AwayTeam,FTHG,FTAG,HS\n2024-02-01,Köln,\"B, II\",3,1,12\n", "latin-1")
    write(tmp_path, "I1_2324.csv", "Date,HomeTeam,AwayTeam,FTHG,FTAG,HS\n2024-02-02,Roma,Como,1,0,8\n")
    write(tmp_path, "E1_2425.csv", "Date,HomeTeam,AwayTeam\n15/08/2024,X,Y\n")
    write(tmp_path, "E2_2425.csv", "Date,HomeTeam,AwayTeam,FTHG,FTAG\n")
    raw = files.match_folder(spark, str(tmp_path))
    rows = {r.HomeTeam: r for r in files.typed_matches(raw).collect()}
    assert set(rows) == {"A", "C", "Köln", "Roma"}
    assert rows["A"].league_code == "E0" and rows["A"].season_code == "2425" and rows["A"]["B365>2.5"] == "1.9"
    assert rows["C"]["B365>2.5"] is None and str(rows["C"].Date) == "2024-08-16"
    assert rows["Köln"].AwayTeam == "B, II" and rows["Köln"].HS == 12.0 and rows["Köln"].total_goals == 4
    assert rows["A"].match_id == "E0_2425_2024-08-15_A_B"
    assert files.narrow_matches(raw).count() == 4


def test_quoted_headers_and_records_over_lines(spark, tmp_path):
    write(tmp_path, "E0_2425.csv", '"Date","Home,Team",HomeTeam,AwayTeam,FTHG,FTAG\r\n15/08/2024,x,"A ""the"" B","C\nD",2,1\r\n16/08/2024,,"E, F",G,1,0\r\n')
    (tmp_path / "deep").mkdir()
    write(tmp_path / "deep", "E0_2324.csv", "FTAG,FTHG,AwayTeam,HomeTeam,Date\n1,2,Y,X,2023-08-15\n")
    write(tmp_path, "E9_2425.csv", "")
    raw = files.match_folder(spark, str(tmp_path))
    assert raw.columns == ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "Home,Team", "league_code", "season_code"]
    rows = {r.HomeTeam: r for r in raw.collect()}
    assert set(rows) == {'A "the" B', "E, F", "X"}
    assert rows['A "the" B'].AwayTeam == "C\nD" and rows['A "the" B']["Home,Team"] == "x" and rows["E, F"]["Home,Team"] is None
    assert (rows["X"].season_code, rows["X"].FTHG) == ("2324", "2")


def test_no_usable_file(spark, tmp_path):
    write(tmp_path, "E1_2425.csv", "Date,HomeTeam\n1,2\n")
    assert files.match_folder(spark, str(tmp_path)) is None


def test_header_names():
    assert files.header_names("﻿a,b,,b\r") == ["a", "b", "_c2", "b.1"]


def test_fallbacks(spark, tmp_path):
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "base"))
    spark.range(2).write.parquet(str(tmp_path / "rich"))
    paths = [str(tmp_path / n) for n in ("absent", "rich", "base")]
    assert files.first_available(spark, paths).count() == 2
    assert files.first_available(spark, paths, required=["x"]).count() == 3
    with pytest.raises(FileNotFoundError):
        files.first_available(spark, paths, required=["y"])
    assert set(files.side_tables(spark, str(tmp_path), ["base", "absent"])) == {"base"}


def test_fixture_files(spark, tmp_path):
    write(tmp_path, "f.csv", "Div,Date,best_over_odds,market_total_line\nE0,22/11/2025,n/a,2.5\n")
    row = files.fixtures_csv(spark, str(tmp_path / "f.csv")).first()
    assert row.best_over_odds is None and row.market_total_line == 2.5 and str(row.Date) == "2025-11-22"
    write(tmp_path, "g.json", '[{"HomeTeam": "A",\n "AwayTeam": "B"}]')
    assert files.fixtures_any(spark, str(tmp_path / "g")).first().HomeTeam == "A"
    assert files.fixtures_any(spark, str(tmp_path / "none")) is None
    write(tmp_path, "e.csv", "Div,Date\n")
    with pytest.raises(ValueError):
        files.fixtures_csv(spark, str(tmp_path / "e.csv"))


def test_predictions(spark):
    df = spark.createDataFrame(
        [("test", "1.9", None), ("test", None, "x"), ("train", "2", "2")], "dataset_split string, best_over_odds string, best_under_odds string"
    )
    assert [r.best_over_odds for r in files.test_predictions(df).collect()] == [1.9]


def test_seed(spark):
    row = files.seed_matches(spark, [("A", "B", 2, 1)], "HomeTeam string, AwayTeam string, FTHG int, FTAG int").first()
    assert row.FTR == "H" and row.total_goals == 3


def test_season_partitions(spark, tmp_path):
    path = str(tmp_path / "seasons")
    schema = "league_code string, Season string, Date string, HG int"
    sinks.write_seasons(spark.createDataFrame([("AUT", "2012/2013", "1/8/2012", 1), ("AUT", "2024/2025", "1/8/2024", 2), ("AUT", "bad", "1/8/2024", 9)], schema), path, "2425")
    sinks.write_seasons(spark.createDataFrame([("AUT", "2012/2013", "1/8/2012", 7), ("AUT", "2024/2025", "1/8/2024", 8)], schema), path, "2425")
    got = {str(r.season_code): r.FTHG for r in spark.read.parquet(path).collect()}
    assert got == {"1213": 1, "2425": 8}


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "xg")
    schema = "season int, day string, v int"
    for rows in ([(2023, "a", 1), (2024, "b", 1)], [(2024, "b", 2), (2024, "b", 3), (2024, "c", 4)]):
        sinks.upsert_seasons(spark, spark.createDataFrame(rows, schema), path, "season", ["season", "day"], [F.col("v")])
    got = sorted((r.season, r.day, r.v) for r in spark.read.parquet(path).collect())
    assert got == [(2023, "a", 1), (2024, "b", 3), (2024, "c", 4)]


PAGE = """Fotball
Søn. 7/12 15:00
Brighton and Hove Albion
West Ham United
England - Premier League
Vsport Premier League
TOTALT ANTALL MÅL - OVER/UNDER 1.5
Over 1.5
1.15
Under 1.5
5.00
Over 2.5
1.52
Under 2.5
2,45
+139
Søn. 7/12 17:30
Fulham
Crystal Palace
England - Premier League
H
1.9
"""


def test_pages_folder(spark, tmp_path):
    write(tmp_path, "one_snapshot.txt", PAGE)
    write(tmp_path, "two_snapshot.txt", "Error page\nnothing here\n")
    today = F.lit("2025-11-30").cast("date")
    found = files.parse_pages(spark, str(tmp_path), lambda p: text.odds_pages(p, ["page"], "text", today))
    rows = found.orderBy("block").collect()
    assert [(r.home_team, r.away_team, r.time, str(r.date)) for r in rows] == [
        ("Brighton and Hove Albion", "West Ham United", "15:00", "2025-12-07"), ("Fulham", "Crystal Palace", "17:30", "2025-12-07"),
    ]
    first = rows[0]
    assert (first.league, first.over_1_5, first.under_1_5, first.over_2_5, first.under_2_5, first.over_3_5) == ("England - Premier League", 1.15, 5.0, 1.52, 2.45, None)
    assert rows[1].home_odds == 1.9


RESULTS = """= Cup
» League, Matchday 1
Tue Sep/17 2024
  18.45  Juventus (ITA)  v PSV (NED)  3-1 (2-0)
  21.00  Real Madrid (ESP)  v Stuttgart (GER)
  21.00  Young Boys (SUI) v Aston Villa (ENG)  0-3
» Final
Sat Jan/18
  Brest (FRA)  v AZ (NED)  1-1 pen. 4-3
"""


def test_results_text(spark):
    pages = spark.createDataFrame([("p", RESULTS, "CL", "2024-25")], "page string, text string, competition string, season string")
    aliases = spark.createDataFrame([("AZ (NED)", "AZ Alkmaar"), ("PSV Eindhoven (NED)", "PSV E"), ("Stade Brest (FRA)", "Brest 29")], "raw string, canonical string")
    rows = text.results_text(pages, ["page"], "text", "competition", "season", aliases).orderBy("pos").collect()
    assert [(r.home_team, r.away_team, r.home_goals, r.away_goals, str(r.match_date), r.round) for r in rows] == [
        ("Juventus", "PSV E", 3, 1, "2024-09-17", "League, Matchday 1"),
        ("Young Boys", "Aston Villa", 0, 3, "2024-09-17", "League, Matchday 1"),
        ("Brest 29", "AZ Alkmaar", 1, 1, "2025-01-18", "Final"),
    ]
