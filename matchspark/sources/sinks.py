"""Writers: stage tables, season partitions, model bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.functions import conform
from matchspark.operators import upserts
from matchspark.session import cut
from matchspark.sources import files


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Overwrite one stage's table."""
    df.write.format(fmt).options(**options).mode("overwrite").save(path)


def write_partitions(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "parquet", **options) -> None:
    """Replace only the partitions present in ``df``. Rebalancing splits a hot partition over several files."""
    spread = df.hint("rebalance", *columns)
    writer = spread.write.format(fmt).options(partitionOverwriteMode="dynamic", **options)
    writer.partitionBy(*columns).mode("overwrite").save(path)


def with_season(df: DataFrame) -> DataFrame:
    """Season code from a ``Season`` column such as 2012/2013, else from the date; rows without one are dropped."""
    if "Season" in df.columns:
        code = conform.season_from_slash(F.col("Season"))
    else:
        code = conform.season_code(conform.parse_date(F.col("Date")))
    return df.withColumn("season_code", code).drop("Season").dropna(subset=["season_code"])


def write_seasons(df: DataFrame, path: str, current: str) -> None:
    """Split a many-season table by league and season; closed seasons already stored stay as they are."""
    named = df.withColumnsRenamed({k: v for k, v in conform.EXTRA_LEAGUE_COLUMNS.items() if k in df.columns})
    seasoned = with_season(named)
    stored = files.optional_table(df.sparkSession, path)
    if stored is not None:
        closed = stored.filter(F.col("season_code") != current).select("league_code", "season_code").distinct()
        # partition values are read as numbers, which lose their leading zeros
        closed = closed.withColumn("season_code", F.lpad(F.col("season_code").cast("string"), 4, "0"))
        seasoned = cut(seasoned.join(closed, ["league_code", "season_code"], "left_anti"), "seasons")
    write_partitions(seasoned, path, ["league_code", "season_code"])


def upsert_seasons(
    spark: SparkSession, fresh: DataFrame, path: str, season: str, key: Sequence[str], order: Sequence[Column]
) -> None:
    """Replace the fresh rows' seasons in a stored table, one row per key."""
    stored = files.optional_table(spark, path)
    if stored is None:
        merged = fresh.filter(F.lit(False)).unionByName(upserts.upsert(fresh, fresh, season, key, order))
    else:
        affected = stored.join(fresh.select(season).distinct(), season, "left_semi")
        merged = upserts.upsert(affected, fresh, season, key, order)
    write_partitions(cut(merged, "upsert"), path, [season])


def save_bundle(
    path: str,
    models: dict[str, PipelineModel],
    features: Sequence[str],
    metrics: DataFrame | None = None,
    calibrator: IsotonicRegressionModel | None = None,
    strengths: DataFrame | None = None,
) -> None:
    """Models, feature list and, where given, metrics, calibrator and team strengths under one folder."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")
    spark = SparkSession.active()
    spark.createDataFrame([(i, f) for i, f in enumerate(features)], "place int, feature string").write.mode(
        "overwrite"
    ).parquet(f"{path}/features")
    if calibrator is not None:
        calibrator.write().overwrite().save(f"{path}/calibrator")
    for name, table in (("metrics", metrics), ("strengths", strengths)):
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str, names: Sequence[str]) -> tuple[dict[str, PipelineModel], list[str]]:
    models = {n: PipelineModel.load(f"{path}/{n}") for n in names}
    rows = spark.read.parquet(f"{path}/features").orderBy("place").collect()
    return models, [r["feature"] for r in rows]


def load_calibrator(spark: SparkSession, path: str) -> IsotonicRegressionModel | None:
    """The bundle's calibrator, or None if it was saved without."""
    stored = files.optional_table(spark, f"{path}/calibrator/metadata", "text")
    return None if stored is None else IsotonicRegressionModel.load(f"{path}/calibrator")


def load_strengths(spark: SparkSession, path: str) -> DataFrame | None:
    """The bundle's team strengths, or None if it was saved without."""
    return files.optional_table(spark, f"{path}/strengths")
