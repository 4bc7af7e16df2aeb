"""Match records from line-oriented text: one row per page in, one row per match out.

A page is one input row. Odds pages are read by one fold over their lines with a small state and a
dictionary of labels, which emits the page's records; results listings use array functions, and
a window over the page for the state that flows down it (headers, dates). No text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.functions import conform
from matchspark.operators import names
from matchspark.sources.pages import emitted

# Words that mark a league line, month names, result labels of the page.
LEAGUE_WORDS = ("League", "Liga", "Serie", "Bundesliga", "Ligue", "Premiership", "Championship")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
RESULT_LABELS = {"home_odds": "H", "draw_odds": "U", "away_odds": "B"}
ANCHOR = r"\d{1,2}/\d{1,2}\s+\d{1,2}:\d{2}"
GOAL_LINES = ("1.5", "2.5", "3.5")
# Characters that count as white space at the ends of a line.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def page_lines(text: str) -> Column:
    """Non-empty stripped lines of a page as an array."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: stripped(x)), lambda x: x != "")


def lines(pages: DataFrame, entity: Sequence[str], text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Non-empty stripped lines as rows ``pos, line``."""
    numbered = F.posexplode(page_lines(text)).alias("pos", "line")
    return pages.select(*entity, *keep, numbered).withColumn("pos", F.col("pos").cast("long"))


def carried(rows: DataFrame, entity: Sequence[str], states: dict[str, Column]) -> DataFrame:
    """Last seen value of each state at or above the line."""
    down = Window.partitionBy(*entity).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[F.last(v, ignorenulls=True).over(down).alias(n) for n, v in states.items()])


def blocks(pages: DataFrame, entity: Sequence[str], text: str, anchor: str) -> DataFrame:
    """Blocks opened by lines matching ``anchor``, as ``block`` (from 1) and ``lines`` (the anchor first).

    Lines above the first anchor are left out.
    """
    cut = pages.select(*entity, page_lines(text).alias("__lines"))
    starts = F.filter(F.transform("__lines", lambda x, i: F.when(x.rlike(anchor), i + 1)), lambda i: i.isNotNull())
    cut = cut.withColumn("__starts", starts)

    def block(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get("__starts", i + 1), F.size("__lines") + 1)
        return F.struct((i + 1).cast("long").alias("block"), F.slice("__lines", start, end - start).alias("lines"))

    return cut.select(*entity, F.inline(F.transform("__starts", block)))


Record = dict[str, object]


def folded(pages: DataFrame, entity: Sequence[str], text: str, read: Callable[[list[str]], Iterator[Record]], schema: str) -> DataFrame:
    """``entity`` and the records that one fold over the non-empty stripped lines of each page emits."""
    return emitted(pages, text, entity, lambda page: read([x for x in (line.strip(BLANKS) for line in page.split("\n")) if x]), schema)


def in_blocks(lines: Iterable[str], least: int) -> Iterator[tuple[int, list[str]]]:
    """Blocks of lines from one date-time line up to the next, numbered from 1; those of fewer lines are left out."""
    number, block = 0, []
    for line in lines:
        if _ANCHOR.search(line):
            if len(block) >= least:
                yield number, block
            number, block = number + 1, []
        if number:
            block.append(line)
    if len(block) >= least:
        yield number, block


_ANCHOR = re.compile(ANCHOR, re.ASCII)
_LEAGUE = re.compile("|".join(LEAGUE_WORDS))
_NUMBER = re.compile(conform.NUMERIC["double"], re.ASCII)
_PRICE = re.compile(r"odds\s+([\d.]+)", re.ASCII)
_QUOTED = re.compile(r'"([^"]+)"')
ODDS = [f"{side}_{g.replace('.', '_')}" for g in GOAL_LINES for side in ("over", "under")]


def _decimal(text: str | None) -> float | None:
    """Number of a text that is nothing else."""
    try:
        return float(text) if text is not None and _NUMBER.search(text) else None
    except ValueError:
        return None


def _goal_line(line: str) -> str | None:
    return next((g for g in GOAL_LINES if g in line or g.replace(".", ",") in line), None)


def _price_labels(line: str) -> Iterator[str]:
    for name, label in RESULT_LABELS.items():
        if line == label:
            yield name
    goals = _goal_line(line)
    for side in ("over", "under"):
        if goals and (side in line or side.capitalize() in line):
            yield f"{side}_{goals.replace('.', '_')}"


def _labelled(lines: list[str]) -> Iterator[Record]:
    for number, block in in_blocks(lines, 3):
        record: Record = {"block": number, "first": block[0], "home_team": block[1], "away_team": block[2]}
        for line, below in zip(block[3:], [*block[4:], None]):
            if "league" not in record and _LEAGUE.search(line):
                record["league"] = line
            value = _decimal(below and below.replace(",", "."))
            if value is not None:
                record |= dict.fromkeys(_price_labels(line), value)
        yield record


def _inline(lines: list[str]) -> Iterator[Record]:
    for number, block in in_blocks(lines, 2):
        record: Record = {"block": number, "first": block[0], "home_team": block[1], "away_team": (block[2:3] or [None])[0]}
        if len(block) > 3 and _LEAGUE.search(block[3]):
            record["league"] = block[3]
        for line in block:
            lower, plain = line.lower(), line.replace(",", ".")
            side = "over" if "over" in lower else "under" if "under" in lower else None
            for goals in GOAL_LINES if side else ():
                price = re.search(re.escape(goals) + r"[^0-9]+([0-9]+\.[0-9]+)", plain)
                if price:
                    record[f"{side}_{goals.replace('.', '_')}"] = float(price[1])
        yield record


def _quoted(line: str | None) -> str | None:
    found = _QUOTED.search(line or "")
    return found[1] if found else line and line.strip(" ")


def _listed(market: str) -> Callable[[list[str]], Iterator[Record]]:
    def read(lines: list[str]) -> Iterator[Record]:
        for number, block in in_blocks(lines, 1):
            at = lambda i: block[i] if i < len(block) else None
            record: Record = {"block": number, "first": block[0], "home_team": _quoted(at(1)), "away_team": _quoted(at(2)), "league": _quoted(at(3))}
            headings = [i for i, line in enumerate(block) if market in line]
            channels = [line for line in block[4 : headings[0] if headings else None] if not line.startswith("uid=")]
            record["tv_channel"] = channels[-1] if channels else None
            for goals in GOAL_LINES:
                here = next((i for i in headings if goals in block[i]), None)
                for side, below in (("over", 2), ("under", 4)):
                    price = _PRICE.search(at(here + below) or "") if here is not None else None
                    record[f"{side}_{goals.replace('.', '_')}"] = _decimal(price and price[1])
            yield record

    return read


PRICES = ", ".join(f"{name} double" for name in ODDS)


def _dated(found: DataFrame, entity: Sequence[str], today: Column) -> DataFrame:
    rest = [c for c in found.columns if c not in (*entity, "block", "first")]
    date = [conform.rolled_date(F.col("first"), today).alias("date"), conform.clock(F.col("first")).alias("time")]
    return found.select(*entity, "block", *date, *rest)


def odds_pages(pages: DataFrame, entity: Sequence[str], text: str, today: Column) -> DataFrame:
    """Odds page: a date-time line opens a match; teams follow, then labels whose value is the next line.

    The last value of a label wins; the first league line after the teams is the
    league. A match ends where the next one opens.
    """
    results = ", ".join(f"{name} double" for name in RESULT_LABELS)
    schema = f"block long, first string, home_team string, away_team string, league string, {results}, {PRICES}"
    return _dated(folded(pages, entity, text, _labelled, schema), entity, today)


def inline_odds(pages: DataFrame, entity: Sequence[str], text: str, today: Column) -> DataFrame:
    """Odds page whose over/under lines carry their own price, e.g. 'Over 2.5 1.75'; the last line of a kind wins.

    The fourth line is the league if it holds a league word.
    """
    schema = f"block long, first string, home_team string, away_team string, league string, {PRICES}"
    return _dated(folded(pages, entity, text, _inline, schema), entity, today)


def listed_odds(
    pages: DataFrame, entity: Sequence[str], text: str, today: Column, market: str = "TOTALT"
) -> DataFrame:
    """Page of quoted lines: teams, league, then one market heading per goal line with two priced buttons below it."""
    schema = f"block long, first string, tv_channel string, home_team string, away_team string, league string, {PRICES}"
    return _dated(folded(pages, entity, text, _listed(market), schema), entity, today)


def groups_of(text: Column, pattern: str, count: int) -> Column:
    """Groups of a whole-text match as an array, from one run of the pattern; null without a match."""
    joined = F.regexp_replace(text, pattern, "\x01".join(f"${i}" for i in range(1, count + 1)))
    parts = F.split(joined, "\x01")
    return F.when(F.size(parts) == count, parts)


def results_text(
    pages: DataFrame, entity: Sequence[str], text: str, competition: str, season: str, aliases: DataFrame | None = None
) -> DataFrame:
    """Results listing: heading lines set the round, date lines the date, match lines emit a record under both."""
    rows = lines(pages, entity, text, keep=[c for c in (competition, season) if c not in entity])
    line = F.col("line")
    rows = rows.filter(~line.startswith("=") & ~line.startswith("#"))
    dated = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(\w+)/(\d+)(?:\s+(\d{4}))?"
    rows = rows.withColumn("__dated", line.rlike(dated))
    month_word = F.substring(F.lower(F.regexp_extract(line, dated, 1)), 1, 3)
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month_word)
    month = F.when(place > 0, place).otherwise(1)
    # the year the season begins in
    first = F.coalesce(F.regexp_extract(F.col(season), r"(\d{4})", 1).try_cast("int"), F.split(season, "-")[0].try_cast("int"))
    turn = F.when((month_word.isin(*MONTHS[:5])) & F.col(season).contains("-"), 1).otherwise(0)
    year = F.coalesce(F.regexp_extract(line, dated, 3).try_cast("int"), first + turn)
    date = F.try_to_date(F.concat_ws("-", year, month, F.regexp_extract(line, dated, 2)), "y-M-d")
    states = {
        "round": F.when(line.startswith("»"), stripped(F.replace(line, F.lit("»"), F.lit("")))),
        "__date": F.when(F.col("__dated"), F.struct(date.alias("d"))),
    }
    under = carried(rows, entity, states)
    record = r"^(?:\d{2}\.\d{2}\s+)?(.+?)\s+v\s+(.+?)\s+(\d+-\d+.*)$"
    parsed = under.filter(~line.startswith("»") & ~F.col("__dated")).withColumn("__parts", groups_of(line, record, 3))
    goals = conform.score(F.col("__parts")[2])
    found = parsed.select(
        *entity,
        *[c for c in (competition, season) if c not in entity],
        "pos",
        F.col("__date.d").alias("match_date"),
        stripped(F.col("__parts")[0]).alias("home_team"),
        stripped(F.col("__parts")[1]).alias("away_team"),
        goals[0].alias("home_goals"),
        goals[1].alias("away_goals"),
        F.coalesce("round", F.lit("")).alias("round"),
    )
    found = found.dropna(subset=["match_date", "home_goals", "away_goals"])
    for side in ("home_team", "away_team"):
        found = coded_name(found, side, aliases)
    return found


def coded_name(df: DataFrame, column: str, aliases: DataFrame | None) -> DataFrame:
    """Alias of the full name, else the name without its country code, resolved on distinct names.

    A bare name found inside an alias key takes that entry; the shortest such key wins.
    """
    bare = names.strip_country_code(F.col(column))
    if aliases is None:
        return df.withColumn(column, bare)
    distinct = df.select(F.col(column).alias("name")).distinct()
    exact = aliases.select(F.col("raw").alias("name"), F.col("canonical").alias("__exact"))
    coded = distinct.filter(F.col("name").rlike(r"\([A-Z]{3}\)$")).select(
        "name", names.strip_country_code(F.col("name")).alias("part")
    )
    inside = names.substrings(aliases, "raw").groupBy("part").agg(
        F.min_by("canonical", F.struct(F.length("raw"), "raw")).alias("__inside")
    )
    coded = coded.join(inside, "part", "left").select("name", F.col("__inside"))
    resolved = distinct.join(exact, "name", "left").join(coded, "name", "left").select(
        F.col("name").alias(column),
        F.coalesce("__exact", "__inside", names.strip_country_code(F.col("name"))).alias("__name"),
    )
    kept = [F.col("__name").alias(c) if c == column else F.col(c) for c in df.columns]
    return df.join(resolved, column, "left").select(*kept)


def results_prose(pages: DataFrame, entity: Sequence[str], text: str, season: str = "2025-26") -> DataFrame:
    """'Team Country | 2–0 | Country Team' lines under 'Matchday n' headings.

    The date is an estimate: two matchdays a month, on the 22nd and the 15th, from September of the season's first year.
    """
    line = F.col("line")
    day = F.regexp_extract(line, r"(?i)matchday\s*(\d+)", 1).try_cast("int")
    rows = carried(lines(pages, entity, text), entity, {"matchday": day})
    country = "(?:" + "|".join(sorted(names.COUNTRIES, key=len, reverse=True)) + ")"
    name = r"[A-Za-zÀ-ÿ\s\-'\.]+"
    record = rf"^.*?({name}?)\s+{country}\s*\|\s*(\d+)\s*[-–]\s*(\d+)\s*\|\s*{country}\s+({name}).*$"
    matchday = F.coalesce("matchday", F.lit(1))
    first = F.make_date(F.lit(int(season[:4])), F.lit(9), F.lit(15))
    months = F.floor((matchday - 1) / 2).cast("int")
    approximate = F.date_add(F.add_months(first, months), matchday % 2 * 7)
    parsed = rows.filter(line.contains("|")).withColumn("__parts", groups_of(line, record, 4))
    parts = F.col("__parts")
    found = parsed.filter(parts.isNotNull()).select(
        *entity,
        "pos",
        approximate.alias("date"),
        stripped(parts[0]).alias("home_team"),
        stripped(parts[3]).alias("away_team"),
        parts[1].try_cast("int").alias("home_goals"),
        parts[2].try_cast("int").alias("away_goals"),
        F.concat(F.lit("Matchday "), matchday).alias("round"),
        F.lit(season).alias("season"),
    )
    for side in ("home_team", "away_team"):
        found = names.cleaned(found, side)
    return found.filter((F.col("home_team") != "") & (F.col("away_team") != ""))
