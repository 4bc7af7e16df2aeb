"""Queries that take records out of text, JSON and HTML.

Where the provided tables hold no such page, Spark renders one small page per
match, so the work grows with the table and SQL knows the expected records.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import joins
from matchspark.plans.catalog import query, table
from matchspark.plans.series import sql_rounded
from matchspark.plans.views import MATCHES_CTE, matches, round6
from matchspark.sources import markup, text

def today():
    return F.lit("1998-06-15").cast("date")


def _text(value):
    return F.coalesce(value.cast("string"), F.lit(""))


@query(
    "text_blocks",
    """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
    x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos, l FROM s),
    a AS (SELECT *, regexp_matches(line, '^[A-D]') AS anchor FROM x),
    b AS (SELECT *, sum(CAST(anchor AS INT)) OVER w AS block, max(CASE WHEN anchor THEN pos END) OVER w AS start FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS lines, max(length(CASE WHEN pos = start THEN line END)) AS head_length,
           max(length(CASE WHEN pos = start + 1 THEN line END)) AS next_length, CAST(max(pos - start) AS BIGINT) AS last_offset FROM b WHERE block > 0 GROUP BY 1, 2""",
)
def text_blocks(spark, sf_dir):
    found = text.blocks(table(spark, sf_dir, "documents"), ["doc_id"], "text", "^[A-D]")
    return found.select(
        "doc_id", "block",
        F.size("lines").cast("long").alias("lines"),
        F.length(F.get("lines", F.lit(0))).alias("head_length"),
        F.length(F.get("lines", F.lit(1))).alias("next_length"),
        (F.size("lines") - 1).cast("long").alias("last_offset"),
    )


@query(
    "carried_headers",
    """WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations),
    x AS (SELECT conv_id, turn, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM s)
    SELECT conv_id, turn, pos, last_value(CASE WHEN length(line) < 60 THEN line END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS header FROM x""",
)
def carried_headers(spark, sf_dir):
    rows = text.lines(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")
    header = {"header": F.when(F.length("line") < 60, F.col("line"))}
    return text.carried(rows, ["conv_id", "turn"], header).select("conv_id", "turn", "pos", "header")


@query(
    "results_text",
    f"""WITH {MATCHES_CTE} SELECT match_id, match_date, 'Team ' || CAST(home_team AS VARCHAR) AS home_team, 'Team ' || CAST(away_team AS VARCHAR) AS away_team,
      CAST(home_goals AS INT) AS home_goals, CAST(away_goals AS INT) AS away_goals, 'League, Matchday ' || CAST(match_id % 8 AS VARCHAR) AS round FROM matches WHERE match_id % 6 > 0""",
)
def results_text(spark, sf_dir):
    df = matches(spark, sf_dir)
    date = F.col("match_date")
    year = F.when(F.col("match_id") % 2 == 0, F.date_format(date, " yyyy")).otherwise("")
    start = F.year(date) - F.when(F.month(date) <= 5, 1).otherwise(0)
    score = F.concat(_text(F.col("home_goals")), F.lit("-"), _text(F.col("away_goals")), F.lit(" (0-0)"))
    page = F.concat(
        F.lit("= Some cup\n\n» League, Matchday "), _text(F.col("match_id") % 8), F.lit("\n  "),
        F.date_format(date, "E MMM/d"), year, F.lit("\n    18.45  Team "), _text(F.col("home_team")), F.lit(" (ENG)  v Team "),
        _text(F.col("away_team")), F.lit(" (GER)   "), F.when(F.col("match_id") % 6 > 0, score).otherwise(""), F.lit("\n# end"),
    )
    pages = df.select("match_id", page.alias("page"), F.lit("CL").alias("competition"), F.concat_ws("-", start, (start + 1) % 100).alias("season"))
    found = text.results_text(pages, ["match_id"], "page", "competition", "season")
    return found.select("match_id", "match_date", "home_team", "away_team", "home_goals", "away_goals", "round")


ODDS = [f"{s}_{k}_5" for k in (1, 2, 3) for s in ("over", "under")]


@query(
    "odds_pages",
    f"""WITH {MATCHES_CTE} SELECT match_id, CASE WHEN strftime(match_date, '%m-%d') <> '02-29' THEN CASE WHEN month(match_date) < 6 THEN 1999 ELSE 1998 END * 10000 + month(match_date) * 100 + day(match_date) END AS day_number, '18:45' AS time,
      'Home ' || CAST(home_team AS VARCHAR) AS home_team, 'Away ' || CAST(away_team AS VARCHAR) AS away_team, 'England - Premier League' AS league,
      round(over_odds, 2) AS home_odds, 3.4e0 AS draw_odds, round(under_odds, 2) AS away_odds, round(over_odds, 2) AS over_1_5, round(under_odds, 2) AS under_1_5, 1.95e0 AS over_2_5, 1.85e0 AS under_2_5,
      CAST(NULL AS DOUBLE) AS over_3_5, round(under_odds, 2) AS under_3_5 FROM matches""",
)
def odds_pages(spark, sf_dir):
    df = matches(spark, sf_dir)
    over, under = (F.coalesce(F.translate(F.format_number(c, 2), ".", ","), F.lit("-")) for c in ("over_odds", "under_odds"))
    page = F.concat_ws(
        "\n", F.lit("Fotball"), F.concat(F.lit("Tir. "), F.date_format("match_date", "dd/MM"), F.lit(" 18:45")),
        F.concat(F.lit("Home "), _text(F.col("home_team"))), F.concat(F.lit("Away "), _text(F.col("away_team"))),
        F.lit("England - Premier League"), F.lit("  H "), over, F.lit("U"), F.lit("3,40"), F.lit("B"), under,
        F.lit("Over 1.5"), over, F.lit("Under 1,5"), under, F.lit("Over 2.5"), F.lit("9,99"), F.lit("Over 2.5"), F.lit("1.95"), F.lit("Under 2.5"), F.lit("1.85"),
        F.lit("Over 3.5"), F.lit("n/a"), F.lit("under 3.5"), under,
    )
    found = text.odds_pages(df.select("match_id", page.alias("page")), ["match_id"], "page", today())
    day = F.year("date") * 10000 + F.month("date") * 100 + F.dayofmonth("date")
    return found.select("match_id", day.alias("day_number"), "time", "home_team", "away_team", "league", "home_odds", "draw_odds", "away_odds", *ODDS)


@query(
    "odds_listing",
    f"""WITH {MATCHES_CTE} SELECT league_code, strftime(match_date, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY league_code, match_date ORDER BY match_id) AS block,
      'Home ' || CAST(home_team AS VARCHAR) AS home_team, 'Away ' || CAST(away_team AS VARCHAR) AS away_team, CASE WHEN match_id % 3 > 0 THEN 'Serie ' || CAST(match_id % 3 AS VARCHAR) END AS league,
      round(over_odds, 2) AS home_odds, round(under_odds, 2) AS under_2_5 FROM matches""",
)
def odds_listing(spark, sf_dir):
    """Pages of all matches of a league and day: blocks end where the next opens, and nothing runs over."""
    price = lambda c: F.coalesce(F.format_number(c, 2), F.lit("-"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("Tir. "), F.date_format("match_date", "dd/MM"), F.lit(" 18:45")),
        F.concat(F.lit("Home "), _text(F.col("home_team"))), F.concat(F.lit("Away "), _text(F.col("away_team"))),
        F.when(F.col("match_id") % 3 > 0, F.concat(F.lit("Serie "), _text(F.col("match_id") % 3))), F.lit("H"), price(F.col("over_odds")),
        F.lit("Under 2,5"), price(F.col("under_odds")), F.lit(" "),
    )
    day = F.date_format("match_date", "yyyy-MM-dd").alias("day")
    each = matches(spark, sf_dir).select("league_code", day, F.struct("match_id", block.alias("text")).alias("block"))
    pages = each.groupBy("league_code", "day").agg(F.array_join(F.array_sort(F.collect_list("block")).getField("text"), "\n").alias("page"))
    found = text.odds_pages(pages, ["league_code", "day"], "page", today())
    return found.select("league_code", "day", "block", "home_team", "away_team", "league", "home_odds", "under_2_5")


@query(
    "listed_odds",
    f"""WITH {MATCHES_CTE} SELECT match_id, '13:30' AS time, 'Home ' || CAST(home_team AS VARCHAR) AS home_team, 'Away ' || CAST(away_team AS VARCHAR) AS away_team, 'England - Premier League' AS league,
      CASE WHEN match_id % 2 = 0 THEN 'TV ' || CAST(match_id % 7 AS VARCHAR) END AS tv_channel, {", ".join(f"round({s}_odds + {k}, 2) AS {s}_{k}_5" for k in (1, 2, 3) for s in ("over", "under"))} FROM matches""",
)
def listed_odds(spark, sf_dir):
    df = matches(spark, sf_dir)
    parts = [
        F.concat(F.lit("Lør. "), F.date_format("match_date", "dd/MM"), F.lit(" 13:30")),
        F.concat(F.lit('uid=2_1 heading "Home '), _text(F.col("home_team")), F.lit('" level="2"')),
        F.concat(F.lit('uid=2_2 heading "Away '), _text(F.col("away_team")), F.lit('" level="2"')),
        F.lit('uid=2_3 StaticText "England - Premier League"'),
        F.when(F.col("match_id") % 2 == 0, F.concat(F.lit("TV "), _text(F.col("match_id") % 7))).otherwise("uid=2_4 button"),
    ]
    for k in (1, 2, 3):
        parts.append(F.lit(f"TOTALT ANTALL MÅL - OVER/UNDER {k}.5"))
        for side in ("over", "under"):
            parts.append(F.lit(f"{side.capitalize()} {k}.5"))
            price = F.coalesce(F.format_number(F.col(f"{side}_odds") + k, 2), F.lit("none"))
            parts.append(F.concat(F.lit(f"{side.capitalize()} {k}.5, odds "), price))
    pages = df.select("match_id", F.concat_ws("\n", *parts).alias("page"))
    found = text.listed_odds(pages, ["match_id"], "page", today())
    return found.select("match_id", "time", "home_team", "away_team", "league", "tv_channel", *ODDS)


@query(
    "inline_odds",
    f"""WITH {MATCHES_CTE} SELECT match_id, 'Home ' || CAST(home_team AS VARCHAR) AS home_team, CASE WHEN match_id % 2 = 0 THEN 'Serie A' END AS league, {", ".join(f"{'coalesce(round(over_odds + 1, 2), 7.77e0)' if (s, k) == ('over', 1) else f'round({s}_odds + {k}, 2)'} AS {s}_{k}_5" for k in (1, 2, 3) for s in ("over", "under"))} FROM matches""",
)
def inline_odds(spark, sf_dir):
    parts = [
        F.concat(F.lit("Lør. "), F.date_format("match_date", "dd/MM"), F.lit(" 13:30")), F.concat(F.lit("Home "), _text(F.col("home_team"))), F.lit("Away"),
        F.when(F.col("match_id") % 2 == 0, "Serie A").otherwise("TV"), F.lit("OVER 1.5 7.77"),
    ]
    for k in (1, 2, 3):
        for side in ("over", "UNDER"):
            price = F.coalesce(F.translate(F.format_number(F.col(f"{side.lower()}_odds") + k, 2), ".", ","), F.lit("-"))
            parts.append(F.concat(F.lit(f"{side} {k},5 "), price))
    pages = matches(spark, sf_dir).select("match_id", F.concat_ws("\n", *parts).alias("page"))
    found = text.inline_odds(pages, ["match_id"], "page", today())
    return found.select("match_id", "home_team", "league", *ODDS)


@query(
    "results_prose",
    f"""WITH {MATCHES_CTE} SELECT match_id, CASE WHEN match_id % 3 = 0 THEN 'Sturm' ELSE 'Malmo' END AS home_team, 'Saint-Gilloise' AS away_team, CAST(home_goals AS INT) AS home_goals, CAST(away_goals AS INT) AS away_goals,
      'Matchday ' || CAST(match_id % 8 + 1 AS VARCHAR) AS round, CAST(make_date(2025, 9, 15) + to_months(CAST((match_id % 8) // 2 AS INT)) + to_days(CAST((match_id % 8 + 1) % 2 * 7 AS INT)) AS DATE) AS date FROM matches""",
)
def results_prose(spark, sf_dir):
    df = matches(spark, sf_dir)
    page = F.concat(
        F.lit("Results\nMatchday "), _text(F.col("match_id") % 8 + 1), F.lit("\n\n"),
        F.when(F.col("match_id") % 3 == 0, "Sturm Austria").otherwise("Malmö Sweden"), F.lit(" | "), _text(F.col("home_goals")), F.lit("–"), _text(F.col("away_goals")),
        F.lit(" | Belgium Saint-Gilloise\n"),
    )
    found = text.results_prose(df.select("match_id", page.alias("page")), ["match_id"], "page")
    return found.select("match_id", "home_team", "away_team", "home_goals", "away_goals", "round", "date")


@query(
    "json_flatten",
    """SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS INT) % 2 = 0 AS is_even FROM events WHERE CAST(json_extract(props, '$.k') AS INT) IS NOT NULL""",
)
def json_flatten(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", "user_id", F.from_json("props", "k int").alias("j"))
    return parsed.select("event_id", "user_id", "j.k", (F.col("j.k") % 2 == 0).alias("is_even")).dropna(subset=["k"])


@query(
    "fixture_json",
    f"""WITH {MATCHES_CTE} SELECT match_id, strftime(match_date, '%Y-%m-%d') AS match_date, league_code AS competition_code, season_code AS season, CASE WHEN match_id % 5 = 0 THEN 'Final' ELSE 'Group A' END AS round,
      home_team AS home_team_id, 'T' || CAST(away_team AS VARCHAR) AS away_team, CAST(home_goals AS INT) AS home_goals, CAST(away_goals AS INT) AS away_goals, CAST(0 AS INT) AS half_home, 'Ground' AS venue, match_id % 5 = 0 AS is_neutral FROM matches WHERE match_id % 9 > 0""",
)
def fixture_json(spark, sf_dir):
    goals = F.when(F.col("match_id") % 9 > 0, F.struct(F.col("home_goals").alias("home"), F.col("away_goals").alias("away")))
    team = lambda c: F.struct(F.col(c).alias("id"), F.concat(F.lit("T"), _text(F.col(c))).alias("name"))
    record = F.struct(
        F.struct(F.col("match_id").alias("id"), F.date_format("match_date", "yyyy-MM-dd'T20:00:00'").alias("date"), F.struct(F.lit("Ground").alias("name")).alias("venue")).alias("fixture"),
        F.struct(F.lit(7).alias("id"), F.col("league_code").alias("name"), F.col("season_code").alias("season"), F.when(F.col("match_id") % 5 == 0, "Final").otherwise("Group A").alias("round")).alias("league"),
        F.struct(team("home_team").alias("home"), team("away_team").alias("away")).alias("teams"),
        goals.alias("goals"),
        F.struct(F.struct(F.lit(0).alias("home"), F.lit(0).alias("away")).alias("halftime")).alias("score"),
    )
    pages = matches(spark, sf_dir).select(F.to_json(record).alias("page"))
    return markup.fixtures(pages, "page").select(
        "match_id", "match_date", "competition_code", "season", "round", "home_team_id", "away_team", "home_goals", "away_goals", "half_home", "venue", "is_neutral"
    )


@query(
    "html_links",
    """SELECT page_id, count(*) AS links, count(*) FILTER (WHERE href LIKE '/%') AS local_links, CAST(sum(length(href)) AS BIGINT) AS href_length, min(href) AS first_href FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>', 1, 'i')) AS href FROM pages) GROUP BY 1""".replace("\\\\", "\\"),
)
def html_links(spark, sf_dir):
    found = markup.links(table(spark, sf_dir, "pages"), "html", ["page_id"])
    return found.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"), F.count_if(F.col("href").startswith("/")).alias("local_links"),
        F.sum(F.length("href")).alias("href_length"), F.min("href").alias("first_href"),
    )


@query(
    "html_records",
    """WITH p AS (SELECT page_id, unnest(l) AS inner_html, generate_subscripts(l, 1) - 1 AS position FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1) AS l FROM pages))
    SELECT page_id, position, trim(replace(replace(replace(replace(replace(replace(regexp_replace(inner_html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS label FROM p""".replace("\\\\", "\\"),
)
def html_records(spark, sf_dir):
    found = markup.elements(table(spark, sf_dir, "pages"), "html", "li", ["page_id"])
    return found.select("page_id", "position", F.col("text").alias("label"))


@query(
    "script_json",
    f"""WITH {MATCHES_CTE} SELECT match_id, match_date, 'Köln & "FC" ' || CAST(home_team AS VARCHAR) AS home_team, CAST(home_goals AS INT) AS home_goals, round(over_odds, 6) AS home_xg, round(over_odds + 0.5e0, 6) AS total_xg FROM matches WHERE over_odds IS NOT NULL""",
)
def script_json(spark, sf_dir):
    record = F.struct(
        F.date_format("match_date", "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        F.struct(F.concat(F.lit('Köln & "FC" '), _text(F.col("home_team"))).alias("title")).alias("h"), F.struct(F.lit("B").alias("title")).alias("a"),
        F.struct(_text(F.col("home_goals")).alias("h"), F.lit("1").alias("a")).alias("goals"),
        F.struct(F.coalesce(F.round("over_odds", 6).cast("string"), F.lit("bad")).alias("h"), F.lit("0.5").alias("a")).alias("xG"),
    )
    escaped = F.to_json(F.array(record))
    for plain, code in (("\\", "\\x5C"), ('"', "\\x22"), ("ö", "\\xF6"), ("&", "\\x26"), ("{", "\\x7B")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    page = F.concat(F.lit("<html><script>var  datesData = JSON.parse('"), escaped, F.lit("');</script></html>"))
    pages = matches(spark, sf_dir).select("match_id", page.alias("page"))
    found = markup.script_matches(pages, "page", ["match_id"])
    return found.select("match_id", "match_date", "home_team", "home_goals", F.round("home_xg", 6).alias("home_xg"), F.round("total_xg", 6).alias("total_xg"))


@query(
    "table_rows",
    f"""WITH {MATCHES_CTE} SELECT match_id, strftime(match_date, '%Y-%m-%d') AS match_date, 'H & ' || CAST(home_team AS VARCHAR) AS home_team, CAST(away_goals AS INT) AS away_goals, round(over_odds, 6) AS home_xg, 0.7e0 AS away_xg FROM matches WHERE over_odds IS NOT NULL AND match_id % 4 > 0""",
)
def table_rows(spark, sf_dir):
    cell = lambda stat, value: F.concat(F.lit(f'<td class="right" data-stat="{stat}">'), value, F.lit("</td>"))
    score = F.when(F.col("match_id") % 4 > 0, F.concat(_text(F.col("home_goals")), F.lit("–"), _text(F.col("away_goals")))).otherwise("")
    page = F.concat(
        F.lit('<table><tr class="thead"><th>Date</th></tr>\n<tr><th data-stat="week">1</th>'), cell("date", F.concat(F.lit("<a href='#'>"), F.date_format("match_date", "yyyy-MM-dd"), F.lit("</a>"))),
        cell("home_team", F.concat(F.lit("H &amp; "), _text(F.col("home_team")))), cell("home_xg", _text(F.round("over_odds", 6))), cell("score", score), cell("away_xg", F.lit("0.7")),
        cell("squad_b", F.lit("B")), cell("venue", F.lit("x")), F.lit("</tr></table>"),
    )
    found = markup.stat_matches(matches(spark, sf_dir).select("match_id", page.alias("page")), "page", ["match_id"])
    return found.select("match_id", "match_date", "home_team", "away_goals", "home_xg", "away_xg")


@query(
    "table_grid_rows",
    f"""WITH {MATCHES_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY league_code, match_date ORDER BY match_id) AS nth FROM matches)
    SELECT league_code, strftime(match_date, '%Y-%m-%d') AS day, 2 * nth - 2 + i AS position,
      CASE WHEN i = 0 THEN [league_code || ' & co', 'T' || CAST(home_team AS VARCHAR), CAST(home_goals AS VARCHAR), CAST(home_goals AS VARCHAR), 'é<b']
        ELSE ['in', CAST(match_id AS VARCHAR)] END AS cells
    FROM r, (VALUES (0), (1)) v(i) WHERE nth = 1 OR i = 0
    UNION ALL SELECT league_code, strftime(match_date, '%Y-%m-%d'), 2 * nth - 1, ['in', CAST(match_id AS VARCHAR)] FROM r WHERE nth > 1""",
)
def table_grid_rows(spark, sf_dir):
    """A table for each league and day: a cell that spans all rows, one of two columns, a table inside a cell, references of all kinds."""
    day = F.date_format("match_date", "yyyy-MM-dd").alias("day")
    each = matches(spark, sf_dir).select("league_code", day, F.struct("match_id", "home_team", "home_goals").alias("m"))
    listed = each.groupBy("league_code", "day").agg(F.array_sort(F.collect_list("m")).alias("ms"))

    def row(m, i):
        first = F.when(i == 0, F.concat(F.lit('<td rowspan="'), _text(F.size("ms")), F.lit('">'), F.col("league_code"), F.lit(" &#x26; co</td>"))).otherwise("")
        nested = F.concat(F.lit("<TABLE><tr><td>in<th>"), _text(m["match_id"]), F.lit("</TABLE>"))
        return F.concat(
            F.lit("<tr>"), first, F.lit("<td>T"), _text(m["home_team"]), nested, F.lit("</td><td class='x' colspan=2>"), _text(m["home_goals"]), F.lit("<td>&eacute;&lt;b</tr>"),
        )

    pages = listed.select("league_code", "day", F.concat(F.lit("<table>"), F.array_join(F.transform("ms", row), ""), F.lit("</table>")).alias("page"))
    found = markup.rows_with_cells(pages, "page", ["league_code", "day"])
    return found.select("league_code", "day", "position", F.transform("cells", lambda c: c["text"]).alias("cells"))


@query(
    "team_stat_rows",
    f"""WITH {MATCHES_CTE} SELECT match_id, 'T' || CAST(home_team AS VARCHAR) AS team, round(CAST(home_goals AS DOUBLE) + 0.5e0, 6) AS possession_pct, CAST(1000 + match_id % 1000 AS INT) AS touches, 0 AS touches_def_3rd, CAST(home_goals AS INT) AS progressive_carries,
      round(CASE WHEN away_goals > 0 THEN home_goals / away_goals * 100 ELSE 0 END, 6) AS won_pct FROM matches""",
)
def team_stat_rows(spark, sf_dir):
    values = {2: F.concat(_text(F.col("home_goals")), F.lit(".5%")), 3: F.format_number(1000 + F.col("match_id") % 1000, 0), 5: F.lit("n/a"), 13: _text(F.col("home_goals")), 15: _text(F.col("away_goals"))}
    cells = [F.concat(F.lit("<td>"), values.get(i, F.lit("")), F.lit("</td>")) for i in range(1, 16)]
    page = F.concat(F.lit("<tr><th>T"), _text(F.col("home_team")), F.lit("</th>"), *cells, F.lit("</tr><tr><td>short</td></tr>"))
    found = markup.team_statistics(matches(spark, sf_dir).select("match_id", page.alias("page")), "page", markup.POSSESSION, ["match_id"])
    won = markup.won_share(F.col("progressive_carries"), F.col("progressive_passes_received"))
    return found.select("match_id", "team", "possession_pct", "touches", "touches_def_3rd", "progressive_carries", F.round(won, 6).alias("won_pct"))


@query(
    "absence_rows",
    f"""WITH {MATCHES_CTE} SELECT match_id, 'Player ' || CAST(home_team AS VARCHAR) AS player_name, CASE WHEN match_id % 3 = 0 THEN 'Suspension' ELSE 'Injury' END AS injury_type, CASE WHEN match_id % 3 = 0 THEN 'red card' ELSE 'knee problem' END AS description FROM matches""",
)
def absence_rows(spark, sf_dir):
    page = F.concat(
        F.lit('<tr class="odd"><td class="hauptlink"><a href="/p">Player '), _text(F.col("home_team")), F.lit('</a></td><td class="links">'),
        F.when(F.col("match_id") % 3 == 0, "Red card").otherwise("Knee problem"), F.lit('</td><td>1/1</td></tr><tr class="even"><td>nobody</td></tr><tr class="other"><td class="hauptlink"><a>x</a></td></tr>'),
    )
    found = markup.absences(matches(spark, sf_dir).select("match_id", page.alias("page")), "page", ["match_id"])
    return found.select("match_id", "player_name", "injury_type", "description")


@query(
    "manager_rows",
    f"""WITH {MATCHES_CTE} SELECT match_id, 'Coach ' || CAST(home_team AS VARCHAR) AS manager FROM matches""",
)
def manager_rows(spark, sf_dir):
    page = F.concat(
        F.lit('<table class="infobox vcard"><tr><th>Ground</th><td>Park</td></tr><tr><th>Head coach</th><td>Coach '), _text(F.col("home_team")),
        F.lit('[3]</td></tr><tr><th>Team manager</th><td>Second</td></tr></table><table><tr><th>Manager</th><td>No</td></tr></table>'),
    )
    return markup.managers(matches(spark, sf_dir).select("match_id", page.alias("page")), "page", ["match_id"])


# --- statistics tables of several teams a page

PAGE_ROWS, CELLS = 16, 20


def _cell(i: int):
    return (F.col("match_id") * 31 + i * 7) % 1500


def statistics_pages(spark, sf_dir, table: str):
    """Pages of up to 16 table rows, one for each match; some rows are too short to count.

    Matches move to their page as numbers, and their rows are written there.
    """
    layout, _ = markup.LAYOUTS[table]
    kinds = {i: kind for i, kind in layout.values()}
    cells = [F.concat(F.lit("<td>"), _cell(i).cast("string"), F.lit(".5%</td>" if kinds.get(i) == "double" else "</td>")) for i in range(1, CELLS)]
    # thousands are set apart in the whole row at once: a formatting for each cell makes a method too long to be compiled
    grouped = lambda some: F.regexp_replace(F.concat(*some), r"(\d)(\d{3})(?=\D)", "$1,$2")
    short = F.col("match_id") % 9 == 0
    row = F.concat(F.lit("<tr><th>T"), _text(F.col("match_id")), F.lit("</th>"), grouped(cells[:5]), F.when(short, "").otherwise(grouped(cells[5:])), F.lit("</tr>"))
    moved = matches(spark, sf_dir).select(F.floor(F.col("match_id") / PAGE_ROWS).alias("page"), "match_id")
    moved = moved.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page")
    rows = moved.select("page", F.struct("match_id", row.alias("row")).alias("row"))
    listed = rows.groupBy("page").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # 16 at most
    body = F.array_join(F.col("rows.row"), "\n")
    return listed.select("page", F.concat(F.lit("<table><tbody><tr><th>Squad</th></tr>"), body, F.lit("</tbody></table>")).alias("html"))


def _statistics_sql(table: str) -> str:
    layout, _ = markup.LAYOUTS[table]
    value = {n: f"(match_id * 31 + {i * 7}) % 1500" for n, (i, _) in layout.items()}
    columns = [
        f"CAST({value[n]} AS INT) AS {n}" if kind == "int" else f"CAST({value[n]} AS DOUBLE) + 0.5e0 AS {n}" for n, (_, kind) in layout.items()
    ]
    if table == "defensive":
        won, all_ = value["tackles_won"], value["tackles"]
        columns.append(f"CASE WHEN {all_} > 0 THEN round(({won}) / CAST({all_} AS DOUBLE) * 100, 6) ELSE 0 END AS tackles_won_pct")
    return f"""WITH {MATCHES_CTE} SELECT match_id // {PAGE_ROWS} AS page, 'T' || CAST(match_id AS VARCHAR) AS team, {", ".join(columns)}
      FROM matches WHERE match_id % 9 <> 0"""


def _statistics_query(table: str):
    @query(f"{table}_rows", _statistics_sql(table))
    def rows(spark, sf_dir):
        found = markup.table_statistics(statistics_pages(spark, sf_dir, table), "html", table, ["page"])
        return round6(found, "tackles_won_pct") if table == "defensive" else found

    return rows


STATISTICS = {table: _statistics_query(table) for table in markup.LAYOUTS}


@query(
    "team_statistics",
    f"""SELECT page, team, {", ".join(n for layout, _ in markup.LAYOUTS.values() for n in layout)}, tackles_won_pct
    FROM ({_statistics_sql("possession")}) {" ".join(f"FULL JOIN ({_statistics_sql(t)}) USING (page, team)" for t in ("passing", "defensive", "shooting"))}""",
)
def team_statistics(spark, sf_dir):
    """All statistics tables of a team side by side."""
    return joins.merge_tables([rows(spark, sf_dir) for rows in STATISTICS.values()], ["page", "team"])
