"""Queries that conform tables: dates, seasons, labels, splits, filters, prices, imputation, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.functions import conform
from matchspark.functions.poisson import clip
from matchspark.operators import evaluation, names, reshape
from matchspark.plans.catalog import query, table
from matchspark.plans.views import MATCHES_CTE, matches, round6


@query(
    "best_odds",
    f"""WITH {MATCHES_CTE} SELECT match_id, round(greatest(over_odds, CASE WHEN match_id % 4 <> 0 THEN over_odds * 1.07e0 - 0.1e0 END, 1.5e0 + match_id % 3 * 0.1e0), 6) AS best_over_odds,
        round(greatest(under_odds, CASE WHEN match_id % 4 <> 0 THEN under_odds * 1.02e0 END), 6) AS best_under_odds,
        CASE WHEN over_odds IS NOT NULL THEN round(least(greatest(over_odds, 1.5e0), 2.2e0), 6) END AS clipped, 2.5e0 AS market_total_line FROM matches""",
)
def best_odds(spark, sf_dir):
    key, over, under = F.col("match_id"), F.col("over_odds"), F.col("under_odds")
    df = matches(spark, sf_dir).select(
        "match_id", over,
        over.cast("string").alias("A>2.5"),
        F.when(key % 4 == 0, "n/a").otherwise((over * 1.07 - 0.1).cast("string")).alias("B>2.5"),
        (F.lit(1.5) + key % 3 * F.lit(0.1)).alias("C>2.5"),
        F.coalesce(under, F.lit(float("nan"))).alias("A<2.5"),
        F.when(key % 4 == 0, "").otherwise((under * 1.02).cast("string")).alias("B<2.5"),
    )
    return df.select(
        "match_id",
        F.round(conform.best_price(df, conform.with_suffix(df, ">2.5")), 6).alias("best_over_odds"),
        F.round(conform.best_price(df, ["A<2.5", "B<2.5", "absent<2.5"]), 6).alias("best_under_odds"),
        F.round(clip(F.col("over_odds"), 1.5, 2.2), 6).alias("clipped"),
        F.lit(2.5).alias("market_total_line"),
    )


@query(
    "split_assign",
    f"""WITH {MATCHES_CTE} SELECT match_id, season_code, CASE WHEN season_code >= '2000' THEN 'test' WHEN season_code = '1999' THEN 'validation' ELSE 'train' END AS dataset_split FROM matches""",
)
def split_assign(spark, sf_dir):
    name = conform.split_name(F.col("season_code"), "1999", "2000").alias("dataset_split")
    return matches(spark, sf_dir).select("match_id", "season_code", name)


@query(
    "season_code",
    """WITH d AS (SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT match_id, CASE WHEN month(d) >= 7 THEN strftime(d, '%y') || strftime(d + INTERVAL 1 YEAR, '%y') ELSE strftime(d - INTERVAL 1 YEAR, '%y') || strftime(d, '%y') END AS season,
           strftime(d, '%y') || strftime(d + INTERVAL 1 YEAR, '%y') AS from_slash, CAST(year(d) - CASE WHEN month(d) <= 7 THEN 1 ELSE 0 END AS INT) AS season_start FROM d""",
)
def season_code(spark, sf_dir):
    date = F.to_date("o_orderdate")
    slash = F.concat_ws("/", F.year(date), F.year(date) + 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("match_id"),
        conform.season_code(date).alias("season"),
        conform.season_from_slash(slash).alias("from_slash"),
        conform.season_start(date).alias("season_start"),
    )


ROUNDS = ("Group Stage - 4", "Round of 16", "Quarter-finals", "Semi-finals", "Final", "Play-offs")


@query(
    "stage_flags",
    f"""WITH {MATCHES_CTE}, r AS (SELECT *, CASE match_id % 7 {" ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROUNDS))} END AS round_name FROM matches),
    l AS (SELECT *, coalesce(lower(round_name), '') AS t FROM r)
    SELECT match_id, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS ftr,
      contains(t, 'group') AS is_group_stage, contains(t, '16') OR contains(t, 'quarter') OR contains(t, 'semi') OR contains(t, 'final') AS is_knockout,
      contains(t, 'final') AND NOT contains(t, 'semi') AS is_final,
      CASE WHEN contains(t, 'group') THEN 1 WHEN contains(t, '16') THEN 2 WHEN contains(t, 'quarter') THEN 3 WHEN contains(t, 'semi') THEN 4 WHEN contains(t, 'final') THEN 5 ELSE 1 END AS stage_importance
    FROM l""",
)
def stage_flags(spark, sf_dir):
    names_ = F.array(*[F.lit(r) for r in ROUNDS])
    flags = conform.stage(F.get(names_, (F.col("match_id") % 7).cast("int")))
    ftr = conform.result_label(F.col("home_goals"), F.col("away_goals")).alias("ftr")
    return matches(spark, sf_dir).select("match_id", ftr, *[v.alias(k) for k, v in flags.items()])


EXCLUDED = (*conform.WOMENS_WORDS, "und ", "ou ", "ción", "wfc")


@query(
    "exclude_patterns",
    f"""SELECT doc_id, lang, regexp_matches(text, '(?i)europa|conference|ation') AS mentions FROM documents
    WHERE NOT regexp_matches(lower(lang || ' ' || source || ' ' || text), '{"|".join(EXCLUDED)}')""",
)
def exclude_patterns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = docs.filter(~conform.excluded(EXCLUDED, F.col("lang"), F.col("source"), F.col("text")))
    return kept.select("doc_id", "lang", F.col("text").rlike("(?i)europa|conference|ation").alias("mentions"))


AUDITED = ["match_id", "over_odds", "under_odds", "ratio"]


@query(
    "null_audit",
    f"""WITH {MATCHES_CTE}, r AS (SELECT match_id, over_odds, under_odds, home_goals / nullif(away_goals, 0) AS ratio FROM matches),
    t AS (SELECT count(*) AS all_rows, count(*) FILTER (WHERE over_odds IS NOT NULL AND under_odds IS NOT NULL AND ratio IS NOT NULL) AS complete_rows FROM r)
    SELECT all_rows, complete_rows, c.col AS "column", c.nulls, round(1 - c.nulls / all_rows, 6) AS filled_share FROM t, (
      {" UNION ALL ".join(f"SELECT '{c}' AS col, count(*) - count({c}) AS nulls FROM r" for c in AUDITED)}) c""",
)
def null_audit(spark, sf_dir):
    df = matches(spark, sf_dir).withColumn("ratio", conform.ratio(F.col("home_goals"), F.col("away_goals")))
    return round6(evaluation.null_audit(df.select(*AUDITED)), "filled_share").orderBy(F.desc("nulls"), "column")


@query(
    "zero_variance",
    """SELECT round(var_samp(l_quantity), 6) AS quantity, round(var_samp(l_discount), 6) AS discount, round(var_samp(l_linenumber * 0), 6) AS nothing,
       var_samp(l_quantity) > 0 AS keep_quantity, var_samp(l_discount) > 0 AS keep_discount, var_samp(l_linenumber * 0) > 0 AS keep_nothing FROM lineitem""",
)
def zero_variance(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), (F.col("l_linenumber") * 0).alias("nothing")
    )
    return df.agg(
        *[F.round(F.var_samp(c), 6).alias(c) for c in df.columns],
        *[(F.var_samp(c) > 0).alias(f"keep_{c}") for c in df.columns],
    )


@query(
    "parse_dates",
    """WITH d AS (SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT match_id, d AS match_date, date_diff('day', d, DATE '2001-08-01') AS days_old, strftime(d, '%Y-%m-%d') AS day_text,
      CASE WHEN strftime(d, '%m-%d') <> '02-29' THEN make_date(CASE WHEN month(d) < 6 THEN 1999 ELSE 1998 END, month(d), day(d)) END AS rolled, '13:30' AS kickoff, 13 AS kickoff_hour, round(exp(-0.0018e0 * greatest(0, date_diff('day', d, DATE '2001-08-01'))), 6) AS weight,
      d + CAST((5 - isodow(d) + 7) % 7 AS INT) AS friday, d + CAST((5 - isodow(d) + 7) % 7 AS INT) + 3 AS monday
    FROM d WHERE match_id % 4 < 3""",
)
def parse_dates(spark, sf_dir):
    date, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    text = (
        F.when(key % 4 == 0, F.date_format(date, "dd/MM/yyyy"))
        .when(key % 4 == 1, F.date_format(date, "d/M/yy"))
        .when(key % 4 == 2, F.date_format(date, "yyyy-MM-dd"))
        .otherwise("to be announced")
    )
    df = table(spark, sf_dir, "orders").select(
        key.alias("match_id"), text.alias("text"),
        F.concat(F.lit("Lør. "), F.date_format(date, "dd/MM"), F.lit(" 13:30")).alias("partial"),
    )
    parsed = df.withColumn("match_date", conform.parse_date(F.col("text"))).dropna(subset=["match_date"])
    day = F.col("match_date")
    friday, monday = conform.weekend(day)
    reference = F.lit("2001-08-01").cast("date")
    return parsed.select(
        "match_id", "match_date",
        F.datediff(reference, day).cast("long").alias("days_old"),
        F.date_format(day, "yyyy-MM-dd").alias("day_text"),
        conform.rolled_date(F.col("partial"), F.lit("1998-06-15").cast("date")).alias("rolled"),
        conform.clock(F.col("partial")).alias("kickoff"),
        conform.kickoff_hour(conform.clock(F.col("partial"))).alias("kickoff_hour"),
        F.round(conform.decay(day, reference), 6).alias("weight"),
        friday.alias("friday"), monday.alias("monday"),
    )


@query(
    "conform_columns",
    """SELECT concat_ws('_', o_orderstatus, CAST(year(o_orderdate) AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)) AS match_id,
       o_custkey AS "home_HomeTeam", o_totalprice AS "home_FTHG", CAST(o_orderdate AS DATE) AS "Date", CAST(substring(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS INT) AS "home_start_year" FROM orders""",
)
def conform_columns(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("League"), F.to_date("o_orderdate").alias("Date"), F.col("o_custkey").alias("Home"),
        F.col("o_totalprice").alias("HG"), F.col("o_orderkey").alias("away"),
    )
    named = raw.withColumnsRenamed({k: v for k, v in conform.EXTRA_LEAGUE_COLUMNS.items() if k in raw.columns})
    keyed = named.withColumn("match_id", match_key("Div", F.year("Date"), "Date", "HomeTeam", "away"))
    narrow = keyed.select("match_id", "HomeTeam", "FTHG", "Date", F.substring(F.col("Date").cast("string"), 1, 4).cast("int").alias("start_year"))
    return reshape.prefixed(narrow, "home_", exempt=["match_id", "Date"])


def match_key(league, season, date, home, away):
    """Stable match id from business keys."""
    return F.concat_ws("_", league, season, F.date_format(date, "yyyy-MM-dd"), home, away)


@query(
    "semi_date_window",
    f"""WITH {MATCHES_CTE}, known AS (SELECT n_nationkey * 4 AS team FROM nation)
    SELECT match_id, match_date, home_team, home_team IN (SELECT team FROM known) AND away_team IN (SELECT team FROM known) AS both_known FROM matches
    WHERE league_code IN ('L0', 'L2', 'L9') AND match_date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31'
      AND match_date >= (SELECT max(match_date) FROM matches) - 1095 AND home_team IN (SELECT team FROM known)""",
)
def semi_date_window(spark, sf_dir):
    df = matches(spark, sf_dir)
    leagues = df.filter(F.col("league_code").isin("L0", "L2", "L9"))
    dated = leagues.filter(F.col("match_date").between(F.lit("1999-01-01").cast("date"), F.lit("2001-12-31").cast("date")))
    latest = df.agg(F.max("match_date").alias("d")).scalar()
    recent = dated.filter(F.col("match_date") >= F.date_sub(latest, 1095))
    known = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 4).cast("long").alias("team"))
    homes = recent.join(known, recent["home_team"] == known["team"], "left_semi")
    aways = known.select(F.col("team").alias("away_team"), F.lit(True).alias("both_known"))
    joined = homes.join(aways, "away_team", "left")
    return joined.select("match_id", "match_date", "home_team", F.coalesce("both_known", F.lit(False)).alias("both_known"))


@query(
    "impute_rules",
    f"""WITH {MATCHES_CTE} SELECT match_id, round(over_odds, 6) AS home_avg_odds, round(coalesce(under_odds, 0), 6) AS home_adv_odds, coalesce(CASE WHEN match_id % 3 > 0 THEN match_id % 3 END, 0) AS home_injury_count
    FROM matches WHERE over_odds IS NOT NULL AND (coalesce(home_goals, 0) >= 3 OR coalesce(away_goals, 0) >= 3)""",
)
def impute_rules(spark, sf_dir):
    df = matches(spark, sf_dir).select(
        "match_id", "home_goals", "away_goals", F.col("over_odds").alias("home_avg_odds"), F.col("under_odds").alias("home_adv_odds"),
        F.when(F.col("match_id") % 3 > 0, F.col("match_id") % 3).alias("home_injury_count"),
    )
    features = conform.feature_columns(df.columns)
    kept = conform.complete_core(df, features)
    some = (F.coalesce("home_goals", F.lit(0)) >= 3) | (F.coalesce("away_goals", F.lit(0)) >= 3)
    return round6(kept.filter(some).select("match_id", *features), "home_avg_odds", "home_adv_odds")


@query(
    "clean_names",
    r"""WITH n AS (SELECT p_partkey AS id, 'England  ' || p_name || '  (H)[a]' AS raw FROM part),
    a AS (SELECT DISTINCT p_name AS raw, upper(p_name) AS canonical FROM part WHERE p_type = 'PROMO')
    SELECT n.id, coalesce(upper(a.canonical), regexp_replace(n.raw, '^England  (.*)  \(H\)\[a\]$', '\1')) AS cleaned,
       round(CAST(p_size AS DOUBLE) + 0.25, 6) AS price, CAST(p_size AS INT) AS goals_home, 2 AS goals_away, p_name AS inner_text, p_name AS bare, p_retailprice AS stripped, 'Munchen fussball' AS folded
    FROM n JOIN part ON p_partkey = n.id LEFT JOIN a ON a.raw = p_name""",
)
def clean_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    aliases = part.filter(F.col("p_type") == "PROMO").select(F.col("p_name").alias("raw"), F.upper("p_name").alias("canonical")).distinct()
    size = F.col("p_size").cast("string")
    goals = conform.score(F.concat(size, F.lit("–2 a.e.t. 9-9")))
    df = part.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("England  "), "p_name", F.lit("  (H)[a]")).alias("cleaned"),
        conform.price_after(F.concat(F.lit("Over 2.5 "), size, F.lit(",25")), "2.5").alias("price"),
        goals[0].alias("goals_home"), goals[1].alias("goals_away"),
        conform.quoted(F.concat(F.lit('uid=1 text "'), "p_name", F.lit('"'))).alias("inner_text"),
        names.strip_country_code(F.concat("p_name", F.lit(" (ENG)"))).alias("bare"),
        conform.stripped_number(F.concat(F.format_number("p_retailprice", 2), F.lit("%"))).alias("stripped"),
        names.fold_letters(F.lit("München fußball")).alias("folded"),
    )
    return names.cleaned(df, "cleaned", aliases)


@query(
    "canonical_names",
    """WITH a AS (SELECT p_name AS raw, min(p_brand) AS canonical FROM part WHERE p_size > 40 GROUP BY 1)
    SELECT p_partkey AS id, coalesce(a.canonical, p_name) AS name FROM part LEFT JOIN a ON a.raw = p_name""",
)
def canonical_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    aliases = part.filter(F.col("p_size") > 40).groupBy(F.col("p_name").alias("raw")).agg(F.min("p_brand").alias("canonical"))
    return names.canonical(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "name", aliases)


@query(
    "derived_labels",
    f"""WITH {MATCHES_CTE}, t AS (SELECT *, home_goals + away_goals AS total FROM matches)
    SELECT match_id, CAST(total > 1.5e0 AS INT) AS over_1_5, CAST(total > 2.5e0 AS INT) AS over_2_5, 1 - CAST(total > 3.5e0 AS INT) AS under_3_5,
      CASE WHEN match_id % 2 = 0 AND match_id % 3 = 0 THEN 'Dom' WHEN match_id % 2 = 0 OR match_id % 3 = 0 THEN 'Mix' ELSE 'Euro' END || CASE WHEN match_id % 5 = 0 THEN '+DC' ELSE '' END AS data_source,
      home_goals - away_goals AS goals_diff, round(home_goals / nullif(away_goals, 0), 6) AS goal_ratio FROM t""",
)
def derived_labels(spark, sf_dir):
    key, total = F.col("match_id"), F.col("home_goals") + F.col("away_goals")
    df = reshape.with_differences(matches(spark, sf_dir), ["goals"])
    return df.select(
        "match_id", (total > 1.5).cast("int").alias("over_1_5"), (total > 2.5).cast("int").alias("over_2_5"),
        (1 - (total > 3.5).cast("int")).alias("under_3_5"),
        conform.source_tag(key % 2 == 0, key % 3 == 0, key % 5 == 0).alias("data_source"), "goals_diff",
        F.round(conform.ratio(F.col("home_goals"), F.col("away_goals")), 6).alias("goal_ratio"),
    )
