"""Table readers: irregular CSV folders, ordered fallbacks, optional side tables, typed files."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.functions import conform
from matchspark.session import cut

# Columns a match file must have.
REQUIRED = ("Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG")


def match_folder(
    spark: SparkSession, folder: str, required: Sequence[str] = REQUIRED, naming: str = r"([^_/]+)_([^/]+)\.csv$"
) -> DataFrame | None:
    """All ``league_season.csv`` files of a folder as one text-typed table; None if no file is usable.

    Each file is one row of the scan and is parsed where it is read, once: UTF-8, else latin-1; quoted fields
    may hold commas, quotes and line ends; rows with too many fields are dropped, short rows keep nulls, files without
    rows or without a required column are skipped. The driver sees the distinct column names, no paths; a file has to
    fit in a task. ``naming`` finds league and season in a file's path.
    """
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(folder)
    files = read.select("path", F.regexp_extract("path", naming, 1).alias("league"), F.regexp_extract("path", naming, 2).alias("season"), "content")
    needed = set(required)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for league, season, content in zip(*(batch.column(i) for i in (1, 2, 3))):
                names, rows = csv_rows(content.as_py())
                if not needed <= set(names):
                    continue
                for start in range(0, len(rows), 5000):
                    part = rows[start : start + 5000]
                    fields = pa.array([list(zip(names, r)) for r in part], pa.map_(pa.string(), pa.string()))
                    columns = [pa.array([x.as_py()] * len(part), pa.string()) for x in (league, season)]
                    yield pa.RecordBatch.from_arrays([*columns, fields], ["league_code", "season_code", "fields"])

    # one file a batch: a task holds the bytes of one at a time
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        parsed = cut(files.mapInArrow(parse, "league_code string, season_code string, fields map<string,string>"), "folder")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    names = [r[0] for r in parsed.select(F.explode(F.map_keys("fields"))).distinct().collect()]
    if not names:
        return None
    ordered = sorted(names, key=lambda n: (list(required).index(n) if n in needed else len(needed), n))
    return parsed.select(*[F.try_element_at("fields", F.lit(n)).alias(n) for n in ordered], "league_code", "season_code")


def csv_rows(content: bytes) -> tuple[list[str], list[list[str | None]]]:
    """Column names and rows of a file; unnamed columns are left out, empty fields are null."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    lines = csv.reader(io.StringIO(text, newline=""))
    header = next(lines, [])
    names = named(header)
    shown = [i for i, n in enumerate(names) if not n.startswith("_c")]
    rows = []
    for row in lines:
        if row and len(row) <= len(names):
            rows.append([(row[i] or None) if i < len(row) else None for i in shown])
    return [names[i] for i in shown], rows


def header_names(line: str) -> list[str]:
    """Column names of a plain header line."""
    return named(line.rstrip("\r").split(","))


def named(cells: Sequence[str]) -> list[str]:
    """Column names of a header: no byte-order mark, repeated names numbered, empty ones by place."""
    names: list[str] = []
    for i, name in enumerate(cells):
        name = (name if i else name.lstrip("\ufeffï»¿")).strip().strip('"') or f"_c{i}"
        repeats = sum(1 for n in names if n == name or n.startswith(f"{name}."))
        names.append(f"{name}.{repeats}" if repeats else name)
    return names


def typed_matches(raw: DataFrame) -> DataFrame:
    """Dates parsed day-first, goals as integers, statistics as doubles, stable match id, total goals."""
    numeric = [c for c in ("HS", "AS", "HST", "AST", "HC", "AC", "HF", "AF") if c in raw.columns]
    typed = raw.withColumns(
        {
            "Date": conform.parse_date(F.col("Date")),
            **{c: conform.number(F.col(c)).cast("int") for c in ("FTHG", "FTAG")},
            **{c: conform.number(F.col(c)) for c in numeric},
        }
    ).dropna(subset=["Date"])
    key = F.concat_ws(
        "_", "league_code", "season_code", F.date_format("Date", "yyyy-MM-dd"), "HomeTeam", "AwayTeam"
    )
    return typed.withColumns({"match_id": key, "total_goals": F.col("FTHG") + F.col("FTAG")})


def narrow_matches(raw: DataFrame) -> DataFrame:
    """The five required columns, complete rows only."""
    rows = raw.select(*REQUIRED).dropna()
    return rows.withColumns(
        {"Date": conform.parse_date(F.col("Date")), **{c: conform.number(F.col(c)).cast("int") for c in ("FTHG", "FTAG")}}
    ).dropna()


def optional_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame | None:
    """The table, or None if nothing is there."""
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def first_available(
    spark: SparkSession, paths: Sequence[str], required: Sequence[str] = (), fmt: str = "parquet", **options
) -> DataFrame:
    """First table that exists and has the required columns."""
    for path in paths:
        found = optional_table(spark, path, fmt, **options)
        if found is not None and set(required) <= set(found.columns):
            return found
    raise FileNotFoundError(f"none of {list(paths)} with columns {list(required)}")


def fixtures_csv(spark: SparkSession, path: str) -> DataFrame:
    """Upcoming fixtures with numeric prices; fails if there are none."""
    df = spark.read.csv(path, header=True)
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
    prices = [c for c in ("best_over_odds", "best_under_odds", "market_total_line") if c in df.columns]
    typed = df.withColumns({c: conform.number(F.col(c)) for c in prices})
    if "Date" in df.columns:
        typed = typed.withColumn("Date", conform.parse_date(F.col("Date")))
    if typed.isEmpty():
        raise ValueError(f"no fixtures in {path}")
    return typed


def fixtures_any(spark: SparkSession, stem: str, multiline: bool = True) -> DataFrame | None:
    """``stem.csv`` if present, else ``stem.json`` (one array or object over several lines, or one object a line)."""
    found = optional_table(spark, f"{stem}.csv", "csv", header=True)
    return found if found is not None else optional_table(spark, f"{stem}.json", "json", multiLine=multiline)


def test_predictions(df: DataFrame) -> DataFrame:
    """Rows of the test split with at least one price."""
    if "dataset_split" in df.columns:
        df = df.filter(F.col("dataset_split") == "test")
    prices = [c for c in ("best_over_odds", "best_under_odds") if c in df.columns]
    return df.withColumns({c: conform.number(F.col(c)) for c in prices}).dropna(how="all", subset=prices)


def side_tables(spark: SparkSession, folder: str, names: Sequence[str], fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    """Those of the side tables that exist."""
    found = {n: optional_table(spark, f"{folder}/{n}", fmt, **options) for n in names}
    return {n: t for n, t in found.items() if t is not None}


def seed_matches(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Curated rows as a table with result label and total goals."""
    df = spark.createDataFrame(list(rows), schema)
    return df.withColumns(
        {"FTR": conform.result_label(F.col("FTHG"), F.col("FTAG")), "total_goals": F.col("FTHG") + F.col("FTAG")}
    )


def pages_folder(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """Each text file of a folder as one row ``page, text``."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter=glob).select(
        F.col("_metadata.file_name").alias("page"), F.col("value").alias("text")
    )


def parse_pages(spark: SparkSession, folder: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All pages of a folder through one parser at once."""
    return parse(pages_folder(spark, folder))
