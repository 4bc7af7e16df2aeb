"""Name cleaning and resolution. Names are resolved once per distinct value, then joined back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.session import cut

# Country words that may lead a team name.
COUNTRIES = (
    "England", "Spain", "Germany", "Italy", "France", "Netherlands", "Portugal", "Belgium", "Scotland",
    "Austria", "Switzerland", "Ukraine", "Turkey", "Greece", "Czech Republic", "Poland", "Sweden", "Norway",
    "Denmark", "Hungary", "Bulgaria", "Romania", "Azerbaijan", "Latvia", "Israel", "Cyprus",
    "Northern Ireland", "Republic of Ireland", "Ireland", "Wales", "Iceland", "Slovenia", "Armenia",
    "Bosnia and Herzegovina", "Moldova", "Kazakhstan",
)
# Folded letters and what they become.
FOLD_FROM = "öøåüäçşíáéóúýñłąęřěščžğ"
FOLD_TO = "ooauacsiaeouynlaeresczg"


def fold_letters(name: Column) -> Column:
    return F.translate(F.replace(name, F.lit("ß"), F.lit("ss")), FOLD_FROM, FOLD_TO)


def strip_country_code(name: Column) -> Column:
    """"Team (XXX)" to "Team"."""
    return F.regexp_replace(name, r"\s*\([A-Z]{3}\)$", "")


def collapse_blanks(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def without_marks(name: Column) -> Column:
    """Blanks collapsed; (H)/(A) and [a] marks removed."""
    bare = F.regexp_replace(collapse_blanks(name), r"\s*\([HA]\)\s*", "")
    return F.regexp_replace(bare, r"\[[a-z]\]", "")


def without_country(name: Column) -> Column:
    return F.regexp_replace(name, "^(?:" + "|".join(COUNTRIES) + ") ", "")


def cleaned(df: DataFrame, column: str, aliases: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Cleaned name: marks off, alias of the full name, else of the name without its country, else letters folded."""
    marked = df.withColumn("__full", without_marks(F.col(column))).withColumn("__short", without_country(F.col("__full")))
    result = F.trim(fold_letters(F.col("__short")))
    if aliases is not None:
        for name in ("__full", "__short"):
            renamed = aliases.select(F.col("raw").alias(name), F.col("canonical").alias(f"{name}_alias"))
            marked = marked.join(renamed, name, "left")
        result = F.coalesce("__full_alias", "__short_alias", result)
    return marked.select(*[c for c in df.columns if c != (out or column)], result.alias(out or column))


def canonical(df: DataFrame, column: str, aliases: DataFrame, out: str | None = None) -> DataFrame:
    """Alias table lookup; a name without an entry stays as it is."""
    renamed = aliases.select(F.col("raw").alias(column), F.col("canonical").alias("__canonical"))
    joined = df.join(renamed, column, "left")
    kept = [c for c in df.columns if c != (out or column)]
    return joined.select(*kept, F.coalesce("__canonical", column).alias(out or column))


def unmapped(names: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    known = aliases.select(F.col("raw").alias(column))
    return names.select(column).distinct().join(known, column, "left_anti")


def _parts(text: Column, shortest: Column, longest: Column) -> Column:
    """Distinct substrings of ``text`` with a length between the bounds."""
    size = F.length(text)

    def starting_at(i: Column) -> Column:
        longest_here = F.least(longest, size - i + 1)
        lengths = F.when(longest_here >= shortest, F.sequence(shortest, longest_here)).otherwise(F.array().cast("array<int>"))
        return F.transform(lengths, lambda n: F.substring(text, i, n))

    starts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, starting_at)))


def substrings(df: DataFrame, column: str) -> DataFrame:
    """Every row once per distinct substring of a (short) name column, as ``part``."""
    size = F.greatest(F.length(column), F.lit(1))
    return df.select("*", F.explode(_parts(F.col(column), F.lit(1), size)).alias("part"))


def resolve(names: DataFrame, targets: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Target for each distinct name: equal, else alias, else one contains the other (any case).

    ``names`` has ``name``, ``targets`` has ``target``, ``aliases`` has ``raw,
    canonical, rank``. Ties go to the smallest length difference, then the first
    name. Containment is an equality join on substrings, so no pair of names is
    compared that does not match; for names inside a target only the best target
    per substring is kept before the join. The distinct names are written to the
    shared folder once, so the tables they come from are read once.
    """
    names = cut(names.select("name").distinct(), "names")
    targets = cut(targets.select("target").distinct(), "targets")

    def hit(tier: int, rank: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), rank.cast("int").alias("rank"), F.col("target")).alias("hit")

    sure = [names.join(targets, F.col("name") == F.col("target")).select("name", hit(0, F.lit(0)))]
    if aliases is not None:
        listed = names.join(aliases.withColumnRenamed("raw", "name"), "name")
        found = listed.join(targets, F.col("canonical") == F.col("target"))
        sure.append(found.select("name", hit(1, F.col("rank"))))
    certain = cut(reduce(DataFrame.unionByName, sure), "certain")
    open_names = names.join(certain.select("name"), "name", "left_anti")

    def parts(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
        """Substrings no shorter or longer than the names they are to meet."""
        size = F.length(other_column)
        bounds = other.filter(size > 0).agg(F.min(size).alias("low"), F.max(size).alias("high"))
        bounded = df.withColumns(
            {
                "__low": F.coalesce(bounds.select("low").scalar(), F.lit(1)),
                "__high": F.coalesce(bounds.select("high").scalar(), F.lit(0)),
            }
        )
        found = _parts(F.lower(column), F.col("__low"), F.col("__high"))
        return bounded.select(column, F.explode(found).alias("part"))

    inside_name = (
        parts(open_names, "name", targets, "target")
        .join(targets.withColumn("part", F.lower("target")), "part")
        .select("name", hit(2, F.length("name") - F.length("target")))
    )
    best = (
        parts(targets, "target", open_names, "name")
        .groupBy("part")
        .agg(F.min(F.struct(F.length("target").alias("size"), "target")).alias("best"))
    )
    inside_target = (
        open_names.withColumn("part", F.lower("name"))
        .join(best, "part")
        .select("name", F.col("best.target").alias("target"))
        .select("name", hit(2, F.length("target") - F.length("name")))
    )
    hits = certain.unionByName(inside_name).unionByName(inside_target)
    return hits.groupBy("name").agg(F.min("hit").alias("hit")).select("name", "hit.target", "hit.tier")
