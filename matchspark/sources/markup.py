"""Records from JSON and HTML held in columns."""

from __future__ import annotations

import html as html_text
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions import conform
from matchspark.sources.pages import emitted

FIXTURE = """fixture struct<id: bigint, date: string, venue: struct<name: string>>,
  league struct<id: bigint, name: string, season: string, round: string>,
  teams struct<home: struct<id: bigint, name: string>, away: struct<id: bigint, name: string>>,
  goals struct<home: int, away: int>,
  score struct<halftime: struct<home: int, away: int>>"""

EXPECTED = """array<struct<datetime: string, h: struct<title: string>, a: struct<title: string>,
  goals: struct<h: string, a: string>, xG: struct<h: string, a: string>>>"""


# Script variable, cell class and row classes of the pages read.
SCRIPT_VARIABLE = "datesData"
PLAYER_CELL = "hauptlink"
PLAYER_ROW = r'class="[^"]*\b(?:odd|even)\b'


def fixtures(df: DataFrame, column: str, keep: Sequence[str] = (), played: bool = True) -> DataFrame:
    """Nested fixture JSON to flat rows; ``played`` leaves out those without a score."""
    parsed = df.select(*keep, F.from_json(column, FIXTURE).alias("j"))
    flat = parsed.select(
        *keep,
        F.col("j.fixture.id").alias("match_id"),
        F.substring("j.fixture.date", 1, 10).alias("match_date"),
        F.col("j.league.name").alias("competition_code"),
        F.col("j.league.id").alias("competition_id"),
        F.col("j.league.season").alias("season"),
        F.col("j.league.round").alias("round"),
        F.col("j.teams.home.name").alias("home_team"),
        F.col("j.teams.away.name").alias("away_team"),
        F.col("j.teams.home.id").alias("home_team_id"),
        F.col("j.teams.away.id").alias("away_team_id"),
        F.col("j.goals.home").alias("home_goals"),
        F.col("j.goals.away").alias("away_goals"),
        F.col("j.score.halftime.home").alias("half_home"),
        F.col("j.score.halftime.away").alias("half_away"),
        F.col("j.fixture.venue.name").alias("venue"),
        F.coalesce(F.col("j.league.round").contains("Final"), F.lit(False)).alias("is_neutral"),
    )
    return flat.dropna(subset=["home_goals", "away_goals"]) if played else flat


def unescaped(text: Column) -> Column:
    r"""Text with ``\xNN`` escapes decoded, by way of a JSON string."""
    plain = F.replace(F.replace(text, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))
    unicode = F.regexp_replace(plain, r"\\x([0-9A-Fa-f]{2})", r"\\u00$1")
    return F.from_json(F.concat(F.lit('["'), unicode, F.lit('"]')), "array<string>")[0]


def script_matches(df: DataFrame, html: str, keep: Sequence[str] = (), variable: str = SCRIPT_VARIABLE) -> DataFrame:
    """Expected-goal matches from JSON held in a script tag; elements with bad numbers are left out."""
    raw = F.regexp_extract(html, rf"var\s+{variable}\s*=\s*JSON\.parse\('(.+?)'\)", 1)
    rows = df.filter(F.col(html).contains(variable)).select(*keep, F.inline(F.from_json(unescaped(raw), EXPECTED)))
    number = lambda c, kind: F.coalesce(F.col(c), F.lit("0")).try_cast(kind)
    home_xg, away_xg = number("xG.h", "double"), number("xG.a", "double")
    flat = rows.select(
        *keep,
        F.try_to_date(F.substring("datetime", 1, 10), "yyyy-MM-dd").alias("match_date"),
        F.coalesce("h.title", F.lit("")).alias("home_team"),
        F.coalesce("a.title", F.lit("")).alias("away_team"),
        number("goals.h", "int").alias("home_goals"),
        number("goals.a", "int").alias("away_goals"),
        home_xg.alias("home_xg"),
        away_xg.alias("away_xg"),
        (home_xg + away_xg).alias("total_xg"),
        (home_xg - away_xg).alias("xg_diff"),
    )
    return flat.dropna(subset=["match_date", "home_goals", "away_goals", "home_xg", "away_xg"])


# --- HTML


def text_of(markup: Column) -> Column:
    """Text of a fragment: tags out, common entities decoded, ends stripped."""
    text = F.regexp_replace(markup, r"<[^>]*>", "")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def plain(markup: str) -> str:
    """Text of a fragment: tags out, character references decoded, ends stripped."""
    if "<" in markup:
        markup = _ANY_TAG.sub("", markup)
    if "&" in markup:
        markup = html_text.unescape(markup)
    return markup.replace("\xa0", " ").strip()


_ANY_TAG = re.compile(r"<[^>]*>")
_TABLE_TAG = re.compile(r"""<(/?)(table|tr|td|th)\b((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.I)
_SPAN = re.compile(r"""(?<![\w-])(col|row)span\s*=\s*["']?\s*(\d{1,5})""", re.I)
_STAT = re.compile(r'data-stat="([^"]*)"')
CELL_TYPE = "struct<attributes: string, stat: string, inner: string, text: string>"


def _emitted(df: DataFrame, html: str, keep: Sequence[str], read: Callable[[str], Iterable[dict]], schema: str) -> DataFrame:
    """``keep`` and ``position`` with the records that one pass over each page emits."""
    numbered = lambda page: ({"position": i, **record} for i, record in enumerate(read(page)))
    return emitted(df, html, keep, numbered, f"position long, {schema}")


def elements(df: DataFrame, html: str, tag: str, keep: Sequence[str] = (), with_attributes: str = "") -> DataFrame:
    """Each ``<tag …>…</tag>`` of a page as ``position, attributes, inner, text``; ``with_attributes`` filters by a pattern."""
    opens, closes = re.compile(rf"<{tag}\b([^>]*)>", re.I), re.compile(rf"</{tag}\s*>", re.I)

    def read(page: str) -> Iterator[dict]:
        at = 0
        while (start := opens.search(page, at)) and (end := closes.search(page, start.end())):
            inner = page[start.end() : end.start()]
            yield {"attributes": start[1], "inner": inner, "text": plain(inner)}
            at = end.end()

    found = _emitted(df, html, keep, read, "attributes string, inner string, text string")
    return found.filter(F.col("attributes").rlike(with_attributes)) if with_attributes else found


def links(df: DataFrame, html: str, keep: Sequence[str] = ()) -> DataFrame:
    target = F.regexp_extract("attributes", r"""(?i)href\s*=\s*["']([^"']*)["']""", 1)
    return elements(df, html, "a", keep).select(*keep, "position", target.alias("href"), F.col("text").alias("label"))


class _Table:
    """An open table: its open row and cell, and cells that reach down into later rows."""

    def __init__(self):
        self.row: dict | None = None
        self.cell: dict | None = None
        self.down: dict[int, tuple[int, dict]] = {}

    def close_cell(self, page: str, at: int) -> None:
        if self.cell is not None:
            self.cell["inner"] = "".join(self.cell.pop("pieces")) + page[self.cell.pop("from") : at]
            self.cell["text"] = plain(self.cell["inner"])
            self.row["cells"].append(self.cell)
            self.cell = None

    def close_row(self, page: str, at: int) -> None:
        self.close_cell(page, at)
        if self.row is None:
            return
        placed: list[dict] = []

        def reach() -> None:
            while len(placed) in self.down:
                left, cell = self.down.pop(len(placed))
                if left > 1:
                    following[len(placed)] = (left - 1, cell)
                placed.append(cell)

        following: dict[int, tuple[int, dict]] = {}
        for cell in self.row["cells"]:
            reach()
            spans = {k.lower(): int(n) for k, n in _SPAN.findall(cell["attributes"])} if cell["attributes"] and "span" in cell["attributes"].lower() else {}
            for _ in range(max(1, min(spans.get("col", 1), 1000))):
                if spans.get("row", 1) > 1:
                    following[len(placed)] = (spans["row"] - 1, cell)
                placed.append(cell)
        reach()
        self.down = {**self.down, **following}
        self.row["cells"] = placed
        self.row = None


#: A row of whole cells that hold text alone, read at once; and its cells.
_PLAIN_ROW = re.compile(r"<tr>((?:\s*+<t[dh]>[^<]*+</t[dh]>)*+)\s*+</tr>", re.I)
_PLAIN_CELL = re.compile(r"<t[dh]>([^<]*+)", re.I)


def _grid(page: str) -> list[dict]:
    """Rows of all tables in page order: attributes and cells, of plain rows what their cells hold as ``inners``."""
    rows: list[dict] = []
    tables = [_Table()]
    at = 0
    while m := _TABLE_TAG.search(page, at):
        at = m.end()
        end, tag, top = bool(m[1]), m[2].lower(), tables[-1]
        if tag == "table" and not end:
            if top.cell is not None:
                top.cell["pieces"].append(page[top.cell["from"] : m.start()])
            tables.append(_Table())
        elif tag == "table":
            top.close_row(page, m.start())
            if len(tables) > 1:
                tables.pop()
                if tables[-1].cell is not None:
                    tables[-1].cell["from"] = m.end()
        elif tag == "tr":
            top.close_row(page, m.start())
            if not end and not top.down and (whole := _PLAIN_ROW.match(page, m.start())):
                rows.append({"attributes": "", "inners": _PLAIN_CELL.findall(whole[1])})
                at = whole.end()
            elif not end:
                top.row = {"attributes": m[3], "cells": []}
                rows.append(top.row)
        elif end:
            top.close_cell(page, m.start())
        elif top.row is not None:
            top.close_cell(page, m.start())
            named = _STAT.search(m[3]) if m[3] else None
            top.cell = {"attributes": m[3], "stat": named[1] if named else "", "from": m.end(), "pieces": []}
    for table in reversed(tables):
        table.close_row(page, len(page))
    return rows


def table_grid(page: str) -> list[dict]:
    """Rows of all tables in page order: attributes and cells, each cell at all places of its row that it spans.

    A table inside a cell has rows of its own and is no part of the cell; ends may be missing.
    """
    rows = _grid(page)
    for row in rows:
        if "inners" in row:
            row["cells"] = [{"attributes": "", "stat": "", "inner": x, "text": plain(x)} for x in row.pop("inners")]
    return rows


def rows_with_cells(df: DataFrame, html: str, keep: Sequence[str] = (), row_class: str = "") -> DataFrame:
    """Table rows as ``position, attributes, cells``, see :func:`table_grid`."""
    rows = _emitted(df, html, keep, table_grid, f"attributes string, cells array<{CELL_TYPE}>")
    return rows.filter(F.col("attributes").rlike(row_class)) if row_class else rows


def cell_text(i: int) -> Column:
    return F.get("cells", F.lit(i))["text"]


def stat(name: str) -> Column:
    """Text of the last cell marked with the statistic, null if empty or absent."""
    marked = F.filter("cells", lambda c: c["stat"] == name)
    return F.nullif(F.get(F.reverse(marked), F.lit(0))["text"], F.lit(""))


def stat_matches(df: DataFrame, html: str, keep: Sequence[str] = (), minimum_cells: int = 8) -> DataFrame:
    """Played matches with expected goals from rows whose cells name their statistic."""
    rows = rows_with_cells(df, html, keep).filter(
        ~F.col("attributes").contains("thead") & (F.size("cells") >= minimum_cells)
    )
    goals = conform.score(stat("score"))
    flat = rows.select(
        *keep,
        stat("date").alias("match_date"),
        F.coalesce(stat("home_team"), stat("squad_a")).alias("home_team"),
        F.coalesce(stat("away_team"), stat("squad_b")).alias("away_team"),
        goals[0].alias("home_goals"),
        goals[1].alias("away_goals"),
        F.coalesce(stat("home_xg"), stat("xg_a")).try_cast("double").alias("home_xg"),
        F.coalesce(stat("away_xg"), stat("xg_b")).try_cast("double").alias("away_xg"),
    )
    return flat.dropna()


# Cell numbers of the possession table and their kinds.
POSSESSION = {
    "possession_pct": (2, "double"), "touches": (3, "int"), "touches_def_3rd": (5, "int"), "touches_mid_3rd": (6, "int"),
    "touches_att_3rd": (7, "int"), "touches_att_pen": (8, "int"), "progressive_carries": (13, "int"),
    "progressive_passes_received": (15, "int"),
}


# Cell numbers of the other tables and their kinds.
PASSING = {
    "passes_completed": (3, "int"), "passes_attempted": (4, "int"), "pass_completion_pct": (5, "double"),
    "progressive_passes": (16, "int"), "passes_into_final_third": (14, "int"), "passes_into_penalty_area": (15, "int"),
}
DEFENSIVE = {
    "tackles": (2, "int"), "tackles_won": (3, "int"), "tackles_def_3rd": (4, "int"), "tackles_mid_3rd": (5, "int"),
    "tackles_att_3rd": (6, "int"), "interceptions": (14, "int"), "blocks": (11, "int"), "clearances": (18, "int"),
}
SHOOTING = {
    "goals": (2, "int"), "shots": (3, "int"), "shots_on_target": (4, "int"), "shots_on_target_pct": (5, "double"),
    "xg": (10, "double"), "npxg": (11, "double"), "xg_per_shot": (13, "double"),
}
#: Cells that a row of each table has at least.
LAYOUTS = {"possession": (POSSESSION, 15), "passing": (PASSING, 20), "defensive": (DEFENSIVE, 20), "shooting": (SHOOTING, 15)}


def team_statistics(
    df: DataFrame, html: str, layout: dict[str, tuple[int, str]], keep: Sequence[str] = (), minimum_cells: int = 15
) -> DataFrame:
    """Team rows by cell number; commas and percent signs dropped, anything else not a number is 0.

    Only the texts of these cells leave the task that reads a page.
    """
    places = sorted({0, *(i for i, _ in layout.values())})
    named = [(f"__cell{i}", i) for i in places]

    def read(page: str) -> Iterator[dict]:
        for row in _grid(page):
            inners = row.get("inners")
            n = len(row["cells"] if inners is None else inners)
            if n >= minimum_cells:
                text = (lambda i: plain(inners[i])) if inners is not None else (lambda i: row["cells"][i]["text"])
                yield {name: text(i) for name, i in named if i < n}

    rows = emitted(df, html, keep, read, ", ".join(f"{name} string" for name, _ in named))
    return rows.select(
        *keep,
        F.col("__cell0").alias("team"),
        *[conform.stripped_number(F.col(f"__cell{i}"), kind).alias(n) for n, (i, kind) in layout.items()],
    )


def table_statistics(df: DataFrame, html: str, table: str, keep: Sequence[str] = ()) -> DataFrame:
    """Team rows of one of the ``LAYOUTS``; the defensive one with the share of tackles won."""
    layout, cells = LAYOUTS[table]
    found = team_statistics(df, html, layout, keep, cells)
    if table != "defensive":
        return found
    return found.withColumn("tackles_won_pct", won_share(F.col("tackles_won"), F.col("tackles")))


def won_share(won: Column, tackles: Column) -> Column:
    """Share won in percent, 0 without any."""
    return F.when(tackles > 0, won / tackles * 100).otherwise(0.0)


def absences(df: DataFrame, html: str, keep: Sequence[str] = ()) -> DataFrame:
    """Injured and suspended players from odd/even rows with a linked name."""
    rows = rows_with_cells(df, html, keep, row_class=PLAYER_ROW)
    linked = F.get(F.filter("cells", lambda c: c["attributes"].contains(PLAYER_CELL) & c["inner"].rlike("(?i)<a\\b")), F.lit(0))
    texts = F.transform("cells", lambda c: c["text"])
    suspended = F.exists(texts, lambda t: F.lower(t).rlike("suspension|red card|yellow"))
    other = F.filter("cells", lambda c: c["attributes"].contains("class=") & ~c["attributes"].contains(PLAYER_CELL))
    plain = F.filter(F.transform(other, lambda c: c["text"]), lambda t: F.length(t).between(4, 49))
    found = rows.withColumn("__name", linked).filter(F.col("__name").isNotNull())
    return found.select(
        *keep,
        "position",
        text_of(F.regexp_extract("__name.inner", r"(?is)<a\b[^>]*>(.*?)</a>", 1)).alias("player_name"),
        F.when(suspended, "Suspension").otherwise("Injury").alias("injury_type"),
        F.coalesce(F.lower(F.get(F.reverse(plain), F.lit(0))), F.lit("")).alias("description"),
        F.lit(False).alias("is_key_player"),
    )


def managers(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """Manager or head coach from the first infobox row naming one; ``[n]`` notes removed."""
    box = df.select(*keep, F.regexp_extract(html, r'(?is)<table[^>]*class="[^"]*infobox[^"]*"[^>]*>(.*?)</table>', 1).alias("box"))
    rows = rows_with_cells(box, "box", keep)
    value = cell_text(1)
    named = rows.filter(F.lower(cell_text(0)).rlike("manager|head coach") & value.isNotNull())
    first = F.min_by(F.regexp_replace(value, r"\[.*?\]", ""), "position").alias("manager")
    return named.groupBy(*keep).agg(first).filter(F.col("manager") != "")
