"""Conforming expressions: dates, seasons, labels, numbers from text, filters, splits, column rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_FIRST = ("d/M/yyyy", "d/M/yy", "yyyy-MM-dd")

# Words that mark a women's competition.
WOMENS_WORDS = ("women", "kvinner", "feminine", "femminile", "femenino", "frauen", "wfc", "wsl")

# Single-file league columns and their standard names.
EXTRA_LEAGUE_COLUMNS = {
    "Country": "Country", "League": "Div", "Date": "Date", "Time": "Time", "Home": "HomeTeam", "Away": "AwayTeam",
    "HG": "FTHG", "AG": "FTAG", "Res": "FTR", "PH": "PSH", "PD": "PSD", "PA": "PSA", "MaxH": "MaxH", "MaxD": "MaxD",
    "MaxA": "MaxA", "AvgH": "AvgH", "AvgD": "AvgD", "AvgA": "AvgA",
}


# --- dates and seasons


def parse_date(text: Column, formats: Sequence[str] = DAY_FIRST) -> Column:
    """First format that parses, row by row; null if none does. Two-digit years 69 to 99 lie in the 1900s."""
    return F.coalesce(*[_parsed(text, f) for f in formats])


# What each pattern token looks like in text.
TOKENS = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MM": r"\d{2}", "M": r"\d{1,2}", "dd": r"\d{2}", "d": r"\d{1,2}"}


def _parsed(text: Column, pattern: str) -> Column:
    """Parse only text of the pattern's shape: a failed parse costs far more than a regular expression."""
    separator = "/" if "/" in pattern else "-"
    shape = separator.join(TOKENS[token] for token in pattern.split(separator))
    date = F.when(text.rlike(f"^{shape}$"), F.try_to_date(text, pattern))
    if "yyyy" in pattern:
        return date
    return F.when(F.year(date) >= 2069, F.add_months(date, -1200)).otherwise(date)


def season_code(date: Column) -> Column:
    """'2425' for July 2024 to June 2025."""
    start = F.year(date) - F.when(F.month(date) >= 7, 0).otherwise(1)
    return F.concat(F.right(start.cast("string"), F.lit(2)), F.right((start + 1).cast("string"), F.lit(2)))


def season_from_slash(text: Column) -> Column:
    """'2012/2013' to '1213'; null for any other shape."""
    parts = F.split(text, "/")
    code = F.concat(F.right(parts[0], F.lit(2)), F.right(F.get(parts, F.lit(1)), F.lit(2)))
    return F.when(F.size(parts) == 2, code)


def season_start(date: Column) -> Column:
    """First year of the running season; July still belongs to the old one."""
    return F.year(date) - F.when(F.month(date) <= 7, 1).otherwise(0)


def rolled_date(text: Column, today: Column) -> Column:
    """Date of a 'dd/mm' in text; a month before the current one means next year."""
    day = F.regexp_extract(text, r"(\d{1,2})/(\d{1,2})", 1).try_cast("int")
    month = F.regexp_extract(text, r"(\d{1,2})/(\d{1,2})", 2).try_cast("int")
    year = F.year(today) + F.when(month < F.month(today), 1).otherwise(0)
    return F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")


def clock(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d{1,2}:\d{2})", 1), F.lit(""))


def kickoff_hour(time: Column, default: int = 15) -> Column:
    return F.coalesce(F.split(time, ":")[0].try_cast("int"), F.lit(default))


def weekend(today: Column) -> tuple[Column, Column]:
    """The Friday on or after ``today`` and the Monday after it."""
    friday = F.next_day(F.date_sub(today, 1), "FRI")
    return friday, F.date_add(friday, 3)


def decay(date: Column, reference: Column, rate: float = 0.0018) -> Column:
    return F.exp(-rate * F.greatest(F.lit(0), F.datediff(reference, date)))


# --- numbers and words


def number(value: Column) -> Column:
    """Double or null; text that is no number and NaN become null."""
    parsed = value.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


# Text that is a number. A cast that fails costs far more than this check.
NUMERIC = {"double": r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$", "int": r"^[+-]?\d+$"}


def number_text(text: Column, kind: str = "double") -> Column:
    """Number of a text that is nothing else, null otherwise."""
    return F.when(text.rlike(NUMERIC[kind]), text.try_cast(kind))


def stripped_number(text: Column, kind: str = "double") -> Column:
    """Number after removing thousands commas and percent signs, else 0."""
    bare = F.regexp_replace(text, "[,%]" if kind == "double" else ",", "")
    return F.coalesce(number_text(bare, kind), F.lit(0).cast(kind))


def price_after(text: Column, line: str) -> Column:
    """Decimal number that follows the line token, e.g. 1.75 in 'Over 2.5 1.75'."""
    token = line.replace(".", r"\.")
    return F.regexp_extract(F.translate(text, ",", "."), token + r"\D+(\d+\.\d+)", 1).try_cast("double")


def quoted(text: Column) -> Column:
    """Text between the first double quotes, else the text itself."""
    inner = F.regexp_extract(text, '"([^"]+)"', 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def score(text: Column) -> tuple[Column, Column]:
    """Goals of the first score in text; shoot-out and extra-time words and dash kinds do not matter."""
    plain = F.regexp_replace(F.regexp_replace(text, r" (pen\.|a\.e\.t\.).*$", ""), "[–—]", "-")
    pattern = r"^\s*(\d+)\s*-\s*(\d+)"
    return tuple(F.regexp_extract(plain, pattern, i).try_cast("int") for i in (1, 2))


def ratio(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom, F.lit(0))


def best_price(df: DataFrame, columns: Iterable[str]) -> Column:
    """Highest of the columns present, null if none has a number."""
    present = [number(F.col(f"`{c}`")) for c in columns if c in df.columns]
    if not present:
        return F.lit(None).cast("double")
    return F.greatest(*present, F.lit(None).cast("double"))


def with_suffix(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


# --- labels


def result_label(home_goals: Column, away_goals: Column) -> Column:
    return F.when(home_goals > away_goals, "H").when(home_goals < away_goals, "A").otherwise("D")


def stage(round_text: Column, legacy: bool = True) -> dict[str, Column]:
    """Stage flags and importance 1 to 5. Legacy reads any '16' or 'final' anywhere in the text."""
    text = F.coalesce(F.lower(round_text), F.lit(""))
    group, quarter, semi = text.contains("group"), text.contains("quarter"), text.contains("semi")
    sixteen = text.contains("16") if legacy else text.rlike(r"\b(round of 16|last 16|1/8)\b")
    final = text.contains("final") if legacy else text.rlike(r"\bfinal\b")
    importance = (
        F.when(group, 1).when(sixteen, 2).when(quarter, 3).when(semi, 4).when(final, 5).otherwise(1)
    )
    return {
        "is_group_stage": group,
        "is_knockout": sixteen | quarter | semi | final,
        "is_final": final & ~semi,
        "stage_importance": importance,
    }


def source_tag(home_fallback: Column, away_fallback: Column, strengths_used: Column) -> Column:
    base = F.when(home_fallback & away_fallback, "Dom").when(home_fallback | away_fallback, "Mix").otherwise("Euro")
    return F.concat(base, F.when(strengths_used, "+DC").otherwise(""))


def split_name(season: Column, validation: str, test: str) -> Column:
    return F.when(season >= test, "test").when(season == validation, "validation").otherwise("train")


# --- filters and column rules


def excluded(words: Sequence[str], *texts: Column) -> Column:
    """Does the joined lower-case text hold any of the words? Null texts count as empty."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    return joined.rlike("|".join(words))


def within_days_of_latest(df: DataFrame, date: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the table's latest date."""
    latest = df.agg(F.max(date).alias("d")).scalar()
    return df.filter(F.col(date) >= F.date_sub(latest, days))


# Feature name prefixes and single names.
FEATURE_PREFIXES = (
    "home_avg_", "away_avg_", "home_ema_", "away_ema_", "home_recent_", "away_recent_", "league_avg_",
    "home_adv_", "away_adv_", "weather_",
)
ABSENCE_FEATURES = (
    "home_injury_count", "away_injury_count", "home_injury_severity", "away_injury_severity",
    "home_suspended_count", "away_suspended_count", "injury_count_diff", "injury_severity_diff",
    "home_manager_tenure_days", "away_manager_tenure_days", "home_new_manager", "away_new_manager",
    "home_experienced_manager", "away_experienced_manager", "manager_tenure_diff",
)
OPTIONAL_PREFIXES = ("home_adv_", "away_adv_", "weather_")
EUROPEAN_PREFIXES = ("home_euro_", "away_euro_", "home_dom_", "away_dom_", "comp_avg_")
EUROPEAN_NAMES = (
    "is_group_stage", "is_knockout", "is_final", "stage_importance", "home_european_matches", "away_european_matches",
)


def feature_columns(
    columns: Iterable[str],
    prefixes: Sequence[str] = FEATURE_PREFIXES,
    names: Sequence[str] = ("home_matches_played", "away_matches_played", *ABSENCE_FEATURES),
) -> list[str]:
    return sorted(c for c in columns if c.startswith(tuple(prefixes)) or c in names)


def is_optional(column: str) -> bool:
    return column in ABSENCE_FEATURES or "xg" in column.lower() or column.startswith(OPTIONAL_PREFIXES)


def complete_core(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Drop rows missing a core feature; missing optional ones become 0."""
    optional = [c for c in features if is_optional(c)]
    kept = df.dropna(subset=[c for c in features if c not in optional])
    return kept.fillna(0, subset=optional) if optional else kept
