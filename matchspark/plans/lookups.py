"""Queries over joins: as-of, interval, latest-row, priority, fallback and name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators import joins, names, reshape, sequences
from matchspark.plans.catalog import query, table
from matchspark.plans.series import LEAGUE_NAMES, league_means, sql_rounded, team_form
from matchspark.plans.views import MATCHES_CTE, PARTICIPANTS_CTE, SERIES_ORDER, matches, participants, round6
from matchspark.session import cut


def by_hour(time):
    return F.date_trunc("hour", time)


@query(
    "asof_snapshot",
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'),
    v AS (SELECT user_id, ts AS view_ts, event_id AS view_id, value AS view_value FROM events WHERE event_type = 'view'
          QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
    SELECT p.event_id, p.user_id, v.view_id, round(v.view_value, 6) AS view_value,
           date_diff('day', CAST(v.view_ts AS DATE), CAST(p.ts AS DATE)) AS tenure_days,
           CASE WHEN v.view_id IS NOT NULL THEN date_diff('day', CAST(v.view_ts AS DATE), CAST(p.ts AS DATE)) < 2 END AS is_new
    FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.view_ts""",
)
def asof_snapshot(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bought = events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    seen = events.filter(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value")
    )
    found = joins.asof(bought, seen, ["user_id"], "ts", "view_ts", ["view_ts", "view_id", "view_value"], by_hour, tie=["view_id"])
    tenure = F.datediff(F.to_date("ts"), F.to_date("view_ts")).cast("long")
    return found.select(
        "event_id", "user_id", "view_id", F.round("view_value", 6).alias("view_value"),
        tenure.alias("tenure_days"), (tenure < 2).alias("is_new"),
    )


def with_tenure(snapshots: DataFrame, team: str, manager: str, date: str) -> DataFrame:
    """Each snapshot with the date the same manager was first seen at the team."""
    first = snapshots.groupBy(team, manager).agg(F.min(date).alias("since"))
    return snapshots.select(team, manager, date).distinct().join(first, [team, manager])


def manager_features(matches_: DataFrame, snapshots: DataFrame, block=None, new: int = 30, long: int = 365) -> DataFrame:
    """Tenure in days of the latest known manager at the match, and the new and experienced flags."""
    known = with_tenure(snapshots, "team", "manager", "seen")
    found = joins.asof(matches_, known, ["team"], "match_date", "seen", ["manager", "since"], block, tie=["manager"])
    days = F.datediff("match_date", "since")
    return found.withColumns(
        {"tenure_days": days, "new_manager": (days < new).cast("int"), "experienced_manager": (days > long).cast("int")}
    ).drop("since")


@query(
    "manager_tenure",
    f"""WITH {PARTICIPANTS_CTE}, s AS (SELECT DISTINCT l_suppkey % 120 AS team, 'M' || CAST(l_linenumber % 3 AS VARCHAR) AS manager, CAST(l_shipdate AS DATE) AS seen FROM lineitem),
    k AS (SELECT *, min(seen) OVER (PARTITION BY team, manager) AS since FROM s QUALIFY row_number() OVER (PARTITION BY team, seen ORDER BY manager DESC) = 1)
    SELECT p.match_id, p.is_home, p.team, k.manager, CAST(p.match_date - k.since AS INT) AS tenure_days, CAST(p.match_date - k.since < 30 AS INT) AS new_manager, CAST(p.match_date - k.since > 365 AS INT) AS experienced_manager
    FROM participants p ASOF LEFT JOIN k ON p.team = k.team AND p.match_date >= k.seen""",
)
def manager_tenure(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    snapshots = items.select(
        (F.col("l_suppkey") % 120).alias("team"), F.concat(F.lit("M"), (F.col("l_linenumber") % 3).cast("string")).alias("manager"), F.to_date("l_shipdate").alias("seen")
    )
    rows = participants(spark, sf_dir).select("match_id", "is_home", "team", "match_date")
    return manager_features(rows, snapshots).drop("match_date")


@query(
    "range_event_counts",
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'),
    e AS (SELECT * FROM events WHERE event_type IN ('error', 'click'))
    SELECT p.event_id, p.user_id, count(e.event_id) FILTER (WHERE e.event_type = 'error') AS errors,
           count(e.event_id) FILTER (WHERE e.event_type = 'click') AS clicks,
           CAST(coalesce(sum(CASE WHEN e.event_type = 'error' THEN CASE WHEN e.value > 50 THEN 4 WHEN e.value > 20 THEN 2 ELSE 1 END END), 0) AS BIGINT) AS severity
    FROM p LEFT JOIN e ON e.user_id = p.user_id AND e.ts <= p.ts AND e.ts >= p.ts - INTERVAL 7 DAY
    GROUP BY ALL""",
)
def range_event_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bought = events.filter(F.col("event_type") == "purchase")
    watched = events.filter(F.col("event_type").isin("error", "click"))
    is_error = F.col("event_type") == "error"
    weight = F.when(F.col("value") > 50, 4).when(F.col("value") > 20, 2).otherwise(1)
    measures = {
        "errors": is_error.cast("long"),
        "clicks": (~is_error).cast("long"),
        "severity": F.when(is_error, weight).cast("long"),
    }
    start = F.col("ts") - F.expr("INTERVAL 7 DAYS")
    return joins.interval_sums(
        bought, watched, ["user_id"], ["event_id", "user_id"], "ts", "ts", start, measures, by_hour
    )


# --- second series: line items as domestic matches of the same teams


def domestic(spark, sf_dir) -> DataFrame:
    home, away = F.col("l_partkey") % 120, (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 120
    return (
        table(spark, sf_dir, "lineitem")
        .filter(home != away)
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"),
                        F.round(F.col("l_extendedprice") * 100).cast("long")).alias("match_id"),
            F.to_date("l_shipdate").alias("match_date"),
            home.alias("home_team"),
            away.alias("away_team"),
            (F.col("l_quantity").cast("long") % 5).alias("home_goals"),
            (F.floor("l_extendedprice").cast("long") % 4).alias("away_goals"),
            (F.col("l_quantity") / 10.0).alias("home_xg"),
            (F.sqrt("l_extendedprice") / 150.0).alias("away_xg"),
        )
    )


DOMESTIC_CTE = """domestic AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS match_id,
         CAST(l_shipdate AS DATE) AS match_date, l_partkey % 120 AS home_team,
         (l_suppkey * 7 + l_linenumber) % 120 AS away_team, CAST(l_quantity AS BIGINT) % 5 AS home_goals,
         CAST(floor(l_extendedprice) AS BIGINT) % 4 AS away_goals, l_quantity / 10e0 AS home_xg,
         sqrt(l_extendedprice) / 150e0 AS away_xg
  FROM lineitem WHERE l_partkey % 120 <> (l_suppkey * 7 + l_linenumber) % 120),
domestic_rows AS (
  SELECT match_id, match_date, TRUE AS is_home, home_team AS team, home_goals AS goals_for, away_goals AS goals_against FROM domestic
  UNION ALL SELECT match_id, match_date, FALSE, away_team, away_goals, home_goals FROM domestic)"""

DOMESTIC_FORM = ["dom_avg_for", "dom_avg_against", "dom_home_pct", "dom_ema_for", "dom_ema_against"]
DOMESTIC_ORDER = ["match_date", "match_id", "is_home"]


#: Matches that the domestic form looks back on.
FORM_ROWS = 5


def domestic_form(rows: DataFrame, n: int = FORM_ROWS) -> DataFrame:
    """State of each team after each of its domestic matches: means over the last ``n``, and the match count."""
    numbered = sequences.number(rows, ["team"], DOMESTIC_ORDER, F.col("match_date"), "seq")
    flagged = numbered.withColumn("home_flag", F.col("is_home").cast("double"))
    trailing = {
        "dom_avg_for": sequences.trailing_mean("goals_for", n, inclusive=True),
        "dom_avg_against": sequences.trailing_mean("goals_against", n, inclusive=True),
        "dom_home_pct": sequences.trailing_mean("home_flag", n, inclusive=True),
        "dom_ema_for": sequences.tail_weighted_mean("goals_for", n),
        "dom_ema_against": sequences.tail_weighted_mean("goals_against", n),
    }
    formed = sequences.form(flagged, ["team"], "seq", trailing)
    return formed.withColumn("dom_total_games", F.col("seq") + 1)


def with_domestic_form(rows: DataFrame, domestic_rows: DataFrame, minimum: int = 3) -> DataFrame:
    """Domestic form strictly before each match; null below ``minimum`` domestic matches.

    Only the state after a day's last match can be the newest one of a later day, and it reaches ``FORM_ROWS`` matches back:
    the last ones of each team and day and the number of all, both folded before a shuffle, hold what it needs.
    """
    shown = ["dom_total_games", *DOMESTIC_FORM]
    day = ["team", "match_date"]
    latest = [F.col(c) for c in DOMESTIC_ORDER if c not in day]
    played = domestic_rows.select(*DOMESTIC_ORDER, "team", "goals_for", "goals_against")
    ends = cut(sequences.last_rows(played, day, latest, FORM_ROWS).drop("recency"), "day-ends")  # the series reads them twice
    through = Window.partitionBy("team").orderBy("match_date").rowsBetween(Window.unboundedPreceding, 0)
    games = domestic_rows.groupBy(*day).agg(F.count(F.lit(1)).alias("__n"))
    games = games.select(F.col("team").alias("__team"), F.col("match_date").alias("__day"), F.sum("__n").over(through).alias("dom_total_games"))
    same = F.col("team").eqNullSafe(F.col("__team")) & F.col("match_date").eqNullSafe(F.col("__day"))
    formed = domestic_form(ends).drop("dom_total_games").join(games, same)
    states = formed.groupBy("team", F.col("match_date").alias("dom_date")).agg(*[F.max_by(c, "seq").alias(c) for c in shown])
    found = joins.asof(rows, states, ["team"], "match_date", "dom_date", shown, None, strict=True)
    enough = F.col("dom_total_games") >= minimum
    return found.withColumns({c: F.when(enough, F.col(c)) for c in ["dom_total_games", *DOMESTIC_FORM]})


def _tail_ewm(column: str) -> str:
    q = repr(1.0 - 2.0 / 6)
    terms = [f"lag({column}, {k}) OVER o" for k in range(5)]
    top = " + ".join(f"coalesce({t} * pow({q}, {k}), 0)" for k, t in enumerate(terms))
    bottom = " + ".join(f"CASE WHEN {t} IS NOT NULL THEN pow({q}, {k}) ELSE 0 END" for k, t in enumerate(terms))
    return f"({top}) / ({bottom})"


DOMESTIC_STATE = f"""{DOMESTIC_CTE}, dom_state AS (
      SELECT team, match_date, match_id, is_home, row_number() OVER o AS dom_total_games, avg(goals_for) OVER t AS dom_avg_for,
             avg(goals_against) OVER t AS dom_avg_against, avg(CAST(is_home AS INT)) OVER t AS dom_home_pct,
             {_tail_ewm('goals_for')} AS dom_ema_for, {_tail_ewm('goals_against')} AS dom_ema_against
      FROM domestic_rows WINDOW o AS (PARTITION BY team ORDER BY match_date, match_id, is_home),
           t AS (PARTITION BY team ORDER BY match_date, match_id, is_home ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    dom_last AS (SELECT * FROM dom_state QUALIFY row_number() OVER (PARTITION BY team, match_date ORDER BY match_id DESC, is_home DESC) = 1),
    dom_asof AS (SELECT p.*, {", ".join(f"CASE WHEN d.dom_total_games >= 3 THEN d.{c} END AS {c}" for c in ["dom_total_games", *DOMESTIC_FORM])}
      FROM participants p ASOF LEFT JOIN dom_last d ON p.team = d.team AND p.match_date > d.match_date)"""


@query(
    "asof_trailing_form",
    f"""WITH {PARTICIPANTS_CTE}, {DOMESTIC_STATE}
    SELECT match_id, is_home, team, dom_total_games, {sql_rounded(DOMESTIC_FORM)} FROM dom_asof""",
)
def asof_trailing_form(spark, sf_dir):
    rows = participants(spark, sf_dir).select("match_id", "is_home", "team", "match_date")
    dom = reshape.participants(domestic(spark, sf_dir), ["match_id", "match_date"], reshape.goal_sides())
    found = with_domestic_form(rows, dom.drop("opponent"))
    return round6(found.drop("match_date"), *DOMESTIC_FORM)


@query(
    "fallback_features",
    f"""WITH {PARTICIPANTS_CTE}, {DOMESTIC_STATE},
    own AS (SELECT match_id, is_home, team, row_number() OVER w - 1 AS played,
                   avg(goals_for) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS euro_avg_for
            FROM participants WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id))
    SELECT o.match_id, o.is_home, o.team, round(CASE WHEN o.played >= 20 THEN o.euro_avg_for ELSE d.dom_avg_for END, 6) AS avg_for,
           CASE WHEN o.played >= 20 THEN 'Euro' ELSE 'Dom' END AS data_source
    FROM own o JOIN dom_asof d USING (match_id, is_home)
    WHERE (CASE WHEN o.played >= 20 THEN o.euro_avg_for ELSE d.dom_avg_for END) IS NOT NULL""",
)
def fallback_features(spark, sf_dir):
    """Own form where the team has 20 matches, else domestic form, else the row is dropped."""
    form = team_form(participants(spark, sf_dir), windows=(5,), weighted=False)
    rows = cut(form.select("match_id", "is_home", "team", "match_date", "matches_played", "avg_for_5"), "form")
    dom = reshape.participants(domestic(spark, sf_dir), ["match_id", "match_date"], reshape.goal_sides())
    found = with_domestic_form(rows, dom.drop("opponent"))
    own = F.when(F.col("matches_played") >= 20, F.col("avg_for_5"))
    return found.select(
        "match_id", "is_home", "team",
        F.round(F.coalesce(own, "dom_avg_for"), 6).alias("avg_for"),
        F.when(own.isNotNull(), "Euro").otherwise("Dom").alias("data_source"),
    ).dropna(subset=["avg_for"])


# --- fixtures: customers as upcoming matches


def fixtures(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    home, away = key % 120, (key * 11 + 5) % 120
    return (
        table(spark, sf_dir, "customer")
        .filter(home != away)
        .select(
            key.alias("fixture_id"), F.concat(F.lit("L"), (key % 5).cast("string")).alias("league_code"),
            home.alias("home_team"), away.alias("away_team"),
        )
    )


FIXTURES_CTE = """fixtures AS (
  SELECT c_custkey AS fixture_id, CONCAT('L', CAST(c_custkey % 5 AS VARCHAR)) AS league_code,
         c_custkey % 120 AS home_team, (c_custkey * 11 + 5) % 120 AS away_team
  FROM customer WHERE c_custkey % 120 <> (c_custkey * 11 + 5) % 120)"""

STATE_NAMES = ["avg_for_5", "avg_against_5"]


def latest_states(rows: DataFrame, legacy: bool = False) -> DataFrame:
    """Form per (league, team) after its last match; ``legacy`` gives the state before that match."""
    entity = ["league_code", "team"]
    numbered = sequences.number(rows, entity, SERIES_ORDER, F.col("match_date"), "seq")
    trailing = {
        "avg_for_5": sequences.trailing_mean("goals_for", 5, inclusive=not legacy),
        "avg_against_5": sequences.trailing_mean("goals_against", 5, inclusive=not legacy),
    }
    formed = sequences.form(numbered, entity, "seq", trailing)
    return sequences.latest(formed, entity, ["seq"], ["match_date", *trailing])


@query(
    "latest_feature_join",
    f"""WITH {PARTICIPANTS_CTE}, {FIXTURES_CTE}, s AS (
      SELECT league_code, team, avg(goals_for) OVER t AS avg_for_5, avg(goals_against) OVER t AS avg_against_5
      FROM participants WINDOW t AS (PARTITION BY league_code, team ORDER BY match_date, match_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
      QUALIFY row_number() OVER (PARTITION BY league_code, team ORDER BY match_date DESC, match_id DESC) = 1)
    SELECT f.fixture_id, f.league_code, f.home_team, f.away_team,
           {", ".join(f"round({s}.{n}, 6) AS {side}_{n}" for s, side in (("h", "home"), ("a", "away")) for n in STATE_NAMES)}
    FROM fixtures f JOIN s h ON h.league_code = f.league_code AND h.team = f.home_team
                    JOIN s a ON a.league_code = f.league_code AND a.team = f.away_team""",
)
def latest_feature_join(spark, sf_dir):
    states = latest_states(participants(spark, sf_dir))
    joined = joins.latest_for_fixtures(fixtures(spark, sf_dir), states, ["league_code", "team"], STATE_NAMES)
    return round6(joined, *[f"{s}_{n}" for s in ("home", "away") for n in STATE_NAMES])


PRIORITY = ("L3", "L1", "L0", "L2", "L4")


@query(
    "trailing_avg_priority",
    f"""WITH {MATCHES_CTE}, {FIXTURES_CTE}, r AS (
      SELECT league_code, home_team, home_goals, away_goals, row_number() OVER (
        PARTITION BY league_code, home_team ORDER BY match_date DESC, match_id DESC) AS rn FROM matches),
    m AS (SELECT league_code, home_team, avg(home_goals) AS hg, avg(away_goals) AS ag, count(*) AS n FROM r WHERE rn <= 5 GROUP BY ALL),
    b AS (SELECT *, CASE league_code WHEN 'L3' THEN 0 WHEN 'L1' THEN 1 WHEN 'L0' THEN 2 WHEN 'L2' THEN 3 ELSE 4 END AS pr
          FROM m WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY home_team ORDER BY pr) = 1)
    SELECT f.fixture_id, f.home_team, b.league_code AS form_league, round(b.hg, 6) AS home_goals, round(b.ag, 6) AS away_goals
    FROM fixtures f LEFT JOIN b ON b.home_team = f.home_team""",
)
def trailing_avg_priority(spark, sf_dir):
    means = joins.trailing_priority(
        matches(spark, sf_dir), "home_team", "league_code", PRIORITY,
        [F.col("match_date"), F.col("match_id")], ["home_goals", "away_goals"],
    ).withColumnRenamed("league_code", "form_league")
    joined = fixtures(spark, sf_dir).select("fixture_id", "home_team").join(means, "home_team", "left")
    return round6(joined, "home_goals", "away_goals")


@query(
    "fuzzy_names",
    """WITH names AS (SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT s_name FROM supplier
                      UNION ALL SELECT 'fc ' || lower(n_name) || ' city' FROM nation)),
    targets AS (SELECT DISTINCT target FROM (SELECT lower(p_type) AS target FROM part UNION ALL SELECT n_name FROM nation
                UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE reverse(s_name) END FROM supplier UNION ALL SELECT CASE WHEN p_size < 20 THEN p_name || ' united' ELSE reverse(p_name) END FROM part)),
    aliases AS (SELECT p_name AS raw, 'NATION_' || CAST(p_size % 25 AS VARCHAR) AS canonical, min(p_partkey) AS rank FROM part WHERE p_name LIKE '%bolt' GROUP BY 1, 2),
    hits AS (SELECT name, target, 0 AS tier, 0 AS rank FROM names JOIN targets ON name = target
      UNION ALL SELECT name, target, 1, rank FROM names JOIN aliases ON raw = name JOIN targets ON canonical = target
      UNION ALL SELECT name, target, 2, abs(length(name) - length(target)) FROM names JOIN targets
        ON contains(lower(name), lower(target)) OR contains(lower(target), lower(name)))
    SELECT n.name, h.target, h.tier FROM names n LEFT JOIN (SELECT * FROM hits
      QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier, rank, target) = 1) h ON h.name = n.name""",
)
def fuzzy_names(spark, sf_dir):
    part, supplier, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    raw = part.select(F.col("p_name").alias("name")).union(supplier.select("s_name")).union(
        nation.select(F.concat(F.lit("fc "), F.lower("n_name"), F.lit(" city")))
    ).distinct()
    targets = (
        part.select(F.lower("p_type").alias("target"))
        .union(nation.select("n_name"))
        .union(supplier.select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.reverse("s_name"))))
        .union(part.select(F.when(F.col("p_size") < 20, F.concat("p_name", F.lit(" united"))).otherwise(F.reverse("p_name"))))
    )
    aliases = (
        part.filter(F.col("p_name").endswith("bolt"))
        .groupBy(F.col("p_name").alias("raw"), F.concat(F.lit("NATION_"), (F.col("p_size") % 25).cast("string")).alias("canonical"))
        .agg(F.min("p_partkey").alias("rank"))
    )
    return raw.join(names.resolve(raw, targets, aliases), "name", "left").select("name", "target", "tier")


@query(
    "unmapped_names",
    """WITH names AS (SELECT DISTINCT p_name AS name FROM part), m AS (SELECT DISTINCT p_name AS raw FROM part WHERE p_type = 'PROMO')
    SELECT name FROM names WHERE name NOT IN (SELECT raw FROM m)""",
)
def unmapped_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    aliases = part.filter(F.col("p_type") == "PROMO").select(F.col("p_name").alias("raw"), F.col("p_type").alias("canonical")).distinct()
    return names.unmapped(part.select(F.col("p_name").alias("name")), aliases, "name")


@query(
    "full_outer_stats",
    """WITH c AS (SELECT c_nationkey AS nationkey, count(*) AS accounts, round(sum(c_acctbal), 4) AS balance FROM customer GROUP BY 1),
    s AS (SELECT s_nationkey AS nationkey, round(sum(s_acctbal), 4) AS balance, count(*) AS suppliers FROM supplier GROUP BY 1),
    n AS (SELECT n_nationkey + 5 AS nationkey, n_name FROM nation)
    SELECT nationkey, c.accounts, c.balance, s.suppliers, n.n_name FROM c FULL JOIN s USING (nationkey) FULL JOIN n USING (nationkey)""",
)
def full_outer_stats(spark, sf_dir):
    customers = (
        table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey"))
        .agg(F.count(F.lit(1)).alias("accounts"), F.round(F.sum("c_acctbal"), 4).alias("balance"))
    )
    suppliers = (
        table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey"))
        .agg(F.round(F.sum("s_acctbal"), 4).alias("balance"), F.count(F.lit(1)).alias("suppliers"))
    )
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 5).alias("nationkey"), "n_name")
    return joins.merge_tables([customers, suppliers, nations], ["nationkey"])


def nation_stats(spark, sf_dir) -> DataFrame:
    """A team-level dimension: customers per nation number."""
    return (
        table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("team"))
        .agg(F.count(F.lit(1)).alias("squad"), F.round(F.avg("c_acctbal"), 4).alias("budget"))
    )


@query(
    "dim_lookup",
    f"""WITH {MATCHES_CTE}, d AS (SELECT CAST(c_nationkey AS BIGINT) AS team, count(*) AS squad, round(avg(c_acctbal), 4) AS budget FROM customer GROUP BY 1),
    w AS (SELECT CAST(n_nationkey AS BIGINT) AS team, n_nationkey * 3e0 - 20 AS temperature, n_nationkey % 4 * 0.8e0 AS rain FROM nation),
    o AS (SELECT s_nationkey AS team, count(*) FILTER (WHERE s_acctbal < 0) AS injured, count(*) FILTER (WHERE s_acctbal > 8000) AS suspended FROM supplier GROUP BY 1),
    f AS (SELECT n_nationkey + 3 AS team, 12.5e0 AS forecast FROM nation WHERE n_nationkey % 2 = 0)
    SELECT m.match_id, h.squad AS home_adv_squad, a.squad AS away_adv_squad, h.squad - a.squad AS adv_squad_diff,
           round(coalesce(h.budget, 1.5e0), 6) AS home_budget, coalesce(f.forecast, w.temperature) AS weather_temp,
           w.temperature < 5 AS weather_is_cold, w.temperature > 30 AS weather_is_hot, w.rain > 1 AS weather_is_rainy,
           coalesce(oh.injured, 0) + coalesce(oh.suspended, 0) AS home_out, coalesce(oa.injured, 0) + coalesce(oa.suspended, 0) AS away_out,
           coalesce(oa.injured, 0) + coalesce(oa.suspended, 0) - coalesce(oh.injured, 0) - coalesce(oh.suspended, 0) AS injury_advantage
    FROM matches m LEFT JOIN d h ON h.team = m.home_team LEFT JOIN d a ON a.team = m.away_team LEFT JOIN w ON w.team = m.home_team
      LEFT JOIN o oh ON oh.team = m.home_team LEFT JOIN o oa ON oa.team = m.away_team LEFT JOIN f ON f.team = m.home_team""",
)
def dim_lookup(spark, sf_dir):
    df = matches(spark, sf_dir).select("match_id", "home_team", "away_team")
    stats = joins.unique_dimension(nation_stats(spark, sf_dir), ["team"])
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    weather = nation.select(
        key.cast("long").alias("team"), (key * F.lit(3.0) - 20).alias("temperature"), (key % 4 * F.lit(0.8)).alias("rain")
    )
    forecast = nation.filter(key % 2 == 0).select((key + 3).cast("long").alias("team"), F.lit(12.5).alias("forecast"))
    balance = F.col("s_acctbal")
    out = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("team")).agg(
        (F.count_if(balance < 0) + F.count_if(balance > 8000)).alias("out")
    )
    df = joins.lookup(df, stats, "team", prefix="adv_")
    df = joins.lookup(df, out, "team")
    df = joins.lookup(df, weather, "team", sides=("home",), prefix="weather_")
    df = joins.lookup(df, forecast, "team", sides=("home",))
    df = df.withColumns({f"{s}_out": F.coalesce(F.col(f"{s}_out"), F.lit(0)) for s in ("home", "away")})
    df = reshape.with_differences(df, ["adv_squad"])
    flags = weather_flags(F.col("home_weather_temperature"), F.col("home_weather_rain"))
    return df.select(
        "match_id", "home_adv_squad", "away_adv_squad", "adv_squad_diff",
        F.round(F.coalesce("home_adv_budget", F.lit(1.5)), 6).alias("home_budget"),
        F.coalesce("home_forecast", "home_weather_temperature").alias("weather_temp"),
        *[v.alias(f"weather_is_{k}") for k, v in flags.items()],
        "home_out", "away_out", (F.col("away_out") - F.col("home_out")).alias("injury_advantage"),
    )


def weather_flags(temperature, rain, cold: float = 5, hot: float = 30, wet: float = 1):
    return {"cold": temperature < cold, "hot": temperature > hot, "rainy": rain > wet}


XG_NAMES = ["home_xg", "away_xg"]


@query(
    "composite_key_join",
    f"""WITH {MATCHES_CTE}, {DOMESTIC_CTE},
    r AS (SELECT strftime(date_trunc('month', match_date), '%Y-%m-%d') || '_' || CAST(home_team % 12 AS VARCHAR) || '_' || CAST(away_team % 12 AS VARCHAR) AS k,
                 home_xg, away_xg FROM domestic
          QUALIFY row_number() OVER (PARTITION BY k ORDER BY match_date DESC, match_id DESC) = 1)
    SELECT m.match_id, round(r.home_xg, 6) AS home_xg, round(r.away_xg, 6) AS away_xg, round(r.home_xg + r.away_xg, 6) AS total_xg
    FROM matches m LEFT JOIN r ON r.k = strftime(date_trunc('month', match_date), '%Y-%m-%d') || '_' || CAST(home_team % 12 AS VARCHAR) || '_' || CAST(away_team % 12 AS VARCHAR)""",
)
def composite_key_join(spark, sf_dir):
    joined = xg_joined(spark, sf_dir)
    return round6(joined.withColumn("total_xg", F.col("home_xg") + F.col("away_xg")), *XG_NAMES, "total_xg").select(
        "match_id", *XG_NAMES, "total_xg"
    )


def _month_key():
    month = F.trunc("match_date", "month")
    return joins.composite_key(month, (F.col("home_team") % 12).cast("string"), (F.col("away_team") % 12).cast("string"))


def xg_joined(spark, sf_dir) -> DataFrame:
    left = matches(spark, sf_dir).withColumn("__key", _month_key())
    right = domestic(spark, sf_dir).withColumn("__key", _month_key())
    order = [F.col("match_date"), F.col("match_id")]
    return joins.merge_on_key(left, right, "__key", XG_NAMES, order).drop("__key")


@query(
    "composite_key_fan_out",
    f"""WITH {MATCHES_CTE}, {DOMESTIC_CTE},
    k AS (SELECT *, strftime(match_date, '%Y-%m-%d') || '_' || CAST(home_team AS VARCHAR) || '_' || CAST(away_team AS VARCHAR) AS k FROM domestic)
    SELECT m.match_id, count(r.k) AS pairs, round(avg(r.home_xg), 6) AS home_xg
    FROM matches m LEFT JOIN k r ON r.k = strftime(m.match_date, '%Y-%m-%d') || '_' || CAST(m.home_team AS VARCHAR) || '_' || CAST(m.away_team AS VARCHAR)
    GROUP BY m.match_id""",
)
def composite_key_fan_out(spark, sf_dir):
    """Every match with all expected-goal rows of its date and teams: a key as selective as the matches are many."""
    left, right = (
        df.withColumn("__key", joins.composite_key(F.col("match_date"), F.col("home_team").cast("string"), F.col("away_team").cast("string")))
        for df in (matches(spark, sf_dir), domestic(spark, sf_dir))
    )
    joined = joins.merge_on_key(left, right, "__key", XG_NAMES, None).drop("__key")
    return joined.groupBy("match_id").agg(F.count("home_xg").alias("pairs"), F.round(F.avg("home_xg"), 6).alias("home_xg"))


@query(
    "xg_tolerant_join",
    f"""WITH {MATCHES_CTE}, {DOMESTIC_CTE},
    c0 AS (SELECT m.match_id, d.match_id AS other, abs(date_diff('day', m.match_date, d.match_date)) AS apart, d.home_xg, d.away_xg
      FROM matches m JOIN domestic d ON d.home_team = m.home_team AND d.away_team = m.away_team AND abs(date_diff('day', m.match_date, d.match_date)) <= 1),
    {", ".join(f"""l{r} AS (SELECT * FROM c{r} QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY apart, other) = 1),
    r{r} AS (SELECT * FROM c{r} QUALIFY row_number() OVER (PARTITION BY other ORDER BY apart, match_id) = 1),
    m{r} AS (SELECT * FROM l{r} SEMI JOIN r{r} USING (match_id, other)),
    c{r + 1} AS (SELECT * FROM c{r} WHERE match_id NOT IN (SELECT match_id FROM m{r}) AND other NOT IN (SELECT other FROM m{r}))""" for r in range(4))},
    met AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)
    SELECT m.match_id, met.apart::INT AS days_apart, round(met.home_xg, 6) AS home_xg, round(met.away_xg, 6) AS away_xg FROM matches m LEFT JOIN met ON met.match_id = m.match_id""",
)
def xg_tolerant_join(spark, sf_dir):
    """Expected goals of the same teams on the day itself or a day before or after, each used once."""
    joined = joins.merge_nearest(
        matches(spark, sf_dir), domestic(spark, sf_dir).withColumnRenamed("match_id", "xg_id"), ["home_team", "away_team"],
        "match_date", XG_NAMES, "match_id", "xg_id",
    )
    return round6(joined.select("match_id", "days_apart", *XG_NAMES), *XG_NAMES)


XG_FORM = [f"avg_{kind}_{w}" for w in (3, 5, 10) for kind in ("xg_for", "xg_against", "over", "defence")]


@query(
    "xg_form",
    f"""WITH {MATCHES_CTE}, {DOMESTIC_CTE},
    r AS (SELECT strftime(date_trunc('month', match_date), '%Y-%m-%d') || '_' || CAST(home_team % 12 AS VARCHAR) || '_' || CAST(away_team % 12 AS VARCHAR) AS k,
                 home_xg, away_xg FROM domestic
          QUALIFY row_number() OVER (PARTITION BY k ORDER BY match_date DESC, match_id DESC) = 1),
    x AS (SELECT m.*, r.home_xg, r.away_xg FROM matches m JOIN r ON r.k = strftime(date_trunc('month', match_date), '%Y-%m-%d') || '_' || CAST(home_team % 12 AS VARCHAR) || '_' || CAST(away_team % 12 AS VARCHAR)),
    p AS (SELECT match_id, match_date, TRUE AS is_home, home_team AS team, home_goals - home_xg AS over_x, away_xg - away_goals AS defence_x, home_xg AS xg_for_x, away_xg AS xg_against_x FROM x
          UNION ALL SELECT match_id, match_date, FALSE, away_team, away_goals - away_xg, home_xg - home_goals, away_xg, home_xg FROM x),
    f AS (SELECT match_id, is_home, team, {", ".join(
        f"avg({kind}_x) OVER (w ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS avg_{kind}_{w}"
        for w in (3, 5, 10) for kind in ("xg_for", "xg_against", "over", "defence"))}
      FROM p WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id))
    SELECT match_id, is_home, team, {sql_rounded(XG_FORM)} FROM f""",
)
def xg_form(spark, sf_dir):
    """Expected-goal form; matches without expected goals leave before the windows."""
    known = xg_joined(spark, sf_dir).dropna(subset=XG_NAMES)
    sides = reshape.goal_sides({"xg": ("home_xg", "away_xg")})
    rows = reshape.participants(known, ["match_id", "match_date"], sides).withColumns(
        {"over": F.col("goals_for") - F.col("xg_for"), "defence": F.col("xg_against") - F.col("goals_against")}
    )
    numbered = sequences.number(rows, ["team"], SERIES_ORDER, F.col("match_date"))
    trailing = {n: sequences.trailing_mean(n[4:].rsplit("_", 1)[0], int(n.rsplit("_", 1)[1])) for n in XG_FORM}
    formed = sequences.form(numbered, ["team"], "seq", trailing)
    return round6(formed.select("match_id", "is_home", "team", *XG_FORM), *XG_FORM)


@query(
    "hourly_lookup",
    """WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS BIGINT) AS hr, round(avg(value), 6) AS v FROM events GROUP BY ALL),
    a AS (SELECT user_id, day, list(hr ORDER BY hr) AS hours, list(v ORDER BY hr) AS vals FROM h GROUP BY ALL),
    p AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CAST((event_id % 24) AS BIGINT) AS kickoff FROM events WHERE event_type = 'purchase')
    SELECT p.event_id, p.kickoff, CASE WHEN list_contains(hours, kickoff) THEN vals[list_position(hours, kickoff)]
           ELSE vals[least(kickoff + 1, len(vals))] END AS value FROM p JOIN a USING (user_id, day)""",
)
def hourly_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    hourly = events.groupBy("user_id", "day", F.hour("ts").cast("long").alias("hr")).agg(F.round(F.avg("value"), 6).alias("v"))
    listed = F.array_sort(F.collect_list(F.struct("hr", "v")))  # at most 24 entries a day
    days = hourly.groupBy("user_id", "day").agg(listed.alias("l")).select("user_id", "day", F.col("l.hr").alias("hours"), F.col("l.v").alias("vals"))
    asked = events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "day", (F.col("event_id") % 24).alias("kickoff"))
    return asked.join(days, ["user_id", "day"]).select(
        "event_id", "kickoff", reshape.hourly_value(F.col("hours"), F.col("vals"), F.col("kickoff")).alias("value")
    )


@query(
    "availability_summary",
    """SELECT CAST(u.c_custkey AS BIGINT) AS team, count(e.event_id) FILTER (WHERE event_type = 'error' AND value <= 50) AS injured,
       count(e.event_id) FILTER (WHERE event_type = 'signup') AS suspended, count(e.event_id) FILTER (WHERE event_type = 'error' AND value > 50) AS key_players_out
    FROM customer u LEFT JOIN events e ON e.user_id = u.c_custkey GROUP BY u.c_custkey""",
)
def availability_summary(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("team")).agg(
        F.count_if((kind == "error") & (value <= 50)).alias("injured"),
        F.count_if(kind == "signup").alias("suspended"),
        F.count_if((kind == "error") & (value > 50)).alias("key_players_out"),
    )
    teams = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team"))
    return counts.join(teams, "team", "right").fillna(0)


@query(
    "imputed_form",
    f"""WITH {PARTICIPANTS_CTE}, {DOMESTIC_STATE}, g AS (SELECT *, home_goals + away_goals AS total_goals FROM matches),
    e AS (SELECT match_id, {", ".join(
        f"coalesce(CASE WHEN count({k}_goals) OVER w >= 5 THEN avg({k}_goals) OVER w END, "
        f"(SELECT avg({k}_goals) FROM g)) AS comp_{k}" for k in ("home", "away"))}
        FROM g WINDOW w AS (PARTITION BY league_code ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT match_id, is_home, round(coalesce(dom_avg_for, comp_home), 6) AS dom_avg_for,
           round(coalesce(dom_avg_against, comp_away), 6) AS dom_avg_against, round(coalesce(dom_home_pct, 0), 6) AS dom_home_pct
    FROM dom_asof JOIN e USING (match_id)
    WHERE coalesce(dom_total_games, 0) >= 2 OR match_id % 3 = 0""",
)
def imputed_form(spark, sf_dir):
    """Missing domestic form filled by column name: goals for, goals against, anything else zero."""
    rows = participants(spark, sf_dir).select("match_id", "is_home", "team", "match_date")
    dom = reshape.participants(domestic(spark, sf_dir), ["match_id", "match_date"], reshape.goal_sides())
    found = with_domestic_form(rows, dom.drop("opponent"))
    means = league_means(matches(spark, sf_dir), minimum=5).select("match_id", *LEAGUE_NAMES[:2])
    joined = found.join(means, "match_id")
    filled = impute_by_name(joined, ["dom_avg_for", "dom_avg_against", "dom_home_pct"], *LEAGUE_NAMES[:2])
    kept = filled.filter((F.coalesce("dom_total_games", F.lit(0)) >= 2) | (F.col("match_id") % 3 == 0))
    names_ = ["dom_avg_for", "dom_avg_against", "dom_home_pct"]
    return round6(kept.select("match_id", "is_home", *names_), *names_)


def impute_by_name(df: DataFrame, columns, home_mean: str, away_mean: str) -> DataFrame:
    """``*for*`` columns take the home mean, ``*against*`` the away mean, others zero."""

    def fill(name: str):
        if "for" in name:
            return F.col(home_mean)
        return F.col(away_mean) if "against" in name else F.lit(0)

    return df.withColumns({c: F.coalesce(F.col(c), fill(c)) for c in columns})
