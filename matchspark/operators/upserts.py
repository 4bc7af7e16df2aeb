"""Incremental maintenance of season-partitioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.operators import sequences


def seasons_to_refresh(wanted: DataFrame, cached: DataFrame, season: str, current: Column) -> DataFrame:
    """Wanted seasons that are current or not cached yet."""
    have = cached.select(season).distinct().withColumn("__cached", F.lit(True))
    joined = wanted.select(season).distinct().join(have, season, "left")
    return joined.filter(F.col("__cached").isNull() | (F.col(season) == current)).select(season)


def upsert(cached: DataFrame, fresh: DataFrame, season: str, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Fresh rows replace all cached rows of their seasons; the last row per key stays."""
    refreshed = fresh.select(season).distinct()
    kept = cached.join(refreshed, season, "left_anti").withColumn("__fresh", F.lit(0))
    both = kept.unionByName(fresh.withColumn("__fresh", F.lit(1)), allowMissingColumns=True)
    return sequences.dedupe(both, key, [F.col("__fresh"), *order], keep="last").drop("__fresh")
