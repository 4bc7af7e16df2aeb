"""Match rows to participant rows and back, price columns to rows, array lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def participants(
    matches: DataFrame,
    shared: Sequence[str],
    sides: dict[str, tuple[str, str]],
    flag: str = "is_home",
) -> DataFrame:
    """Two rows per match in one pass over it.

    ``sides`` maps an output column to its (home row, away row) source columns,
    e.g. ``{"team": ("home_team", "away_team"), "opponent": ("away_team", "home_team")}``.
    """
    home = F.struct(F.lit(True).alias(flag), *[F.col(h).alias(n) for n, (h, _) in sides.items()])
    away = F.struct(F.lit(False).alias(flag), *[F.col(a).alias(n) for n, (_, a) in sides.items()])
    return matches.select(*shared, F.inline(F.array(home, away)))


def goal_sides(extra: dict[str, tuple[str, str]] | None = None) -> dict[str, tuple[str, str]]:
    """Sides for a match table with home/away team and goals; ``extra`` adds paired statistics."""
    sides = {
        "team": ("home_team", "away_team"),
        "opponent": ("away_team", "home_team"),
        "goals_for": ("home_goals", "away_goals"),
        "goals_against": ("away_goals", "home_goals"),
    }
    for name, (home, away) in (extra or {}).items():
        sides[f"{name}_for"] = (home, away)
        sides[f"{name}_against"] = (away, home)
    return sides


def back_to_matches(
    rows: DataFrame,
    match: Sequence[str],
    features: Sequence[str],
    carried: dict[str, str] | None = None,
    flag: str = "is_home",
) -> DataFrame:
    """Participant features side by side per match: one hash aggregate, no self-join.

    ``match`` lists the columns both rows share, the unique match key first;
    ``carried`` renames home-row columns that become columns of the match.
    Rows move before they are folded: a match's two rows seldom meet earlier, and a fold there
    would hold every row of its task at the width of both sides.
    """
    at_home, away = F.col(flag), ~F.col(flag)
    picks = [F.max(F.when(at_home, F.col(c))).alias(n) for c, n in (carried or {}).items()]
    picks += [F.max(F.when(at_home, F.col(c))).alias(f"home_{c}") for c in features]
    picks += [F.max(F.when(away, F.col(c))).alias(f"away_{c}") for c in features]
    return rows.repartition(*match).groupBy(*match).agg(*picks)


def price_rows(df: DataFrame, lines: dict[float, tuple[str, str]], keep: Sequence[str]) -> DataFrame:
    """One row per line with both prices; a line missing either price is left out."""
    options = F.array(
        *[
            F.struct(
                F.lit(float(line)).alias("line"),
                F.col(over).alias("over_odds"),
                F.col(under).alias("under_odds"),
            )
            for line, (over, under) in lines.items()
        ]
    )
    return df.select(*keep, F.inline(options)).dropna(subset=["over_odds", "under_odds"])


def side_rows(keep: Sequence[str | Column], options: dict[str, dict[str, Column]], df: DataFrame) -> DataFrame:
    """One row per named option, each with the given columns."""
    structs = [
        F.struct(F.lit(name).alias("selection"), *[c.alias(n) for n, c in columns.items()])
        for name, columns in options.items()
    ]
    return df.select(*keep, F.inline(F.array(*structs)))


def with_differences(df: DataFrame, names: Sequence[str], suffix: str = "_diff") -> DataFrame:
    """home minus away for each paired column."""
    return df.withColumns({f"{n}{suffix}": F.col(f"home_{n}") - F.col(f"away_{n}") for n in names})


def prefixed(df: DataFrame, prefix: str, exempt: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in exempt else f"{prefix}{c}") for c in df.columns])


def hourly_value(hours: Column, values: Column, hour: Column) -> Column:
    """Value at ``hour`` if listed, else at index min(hour, n - 1); parallel arrays."""
    found = F.array_position(hours, hour)
    index = F.when(found > 0, found).otherwise(F.least(hour + 1, F.size(values)).cast("long"))
    return F.when(F.size(values) > 0, F.element_at(values, index.cast("int")))
