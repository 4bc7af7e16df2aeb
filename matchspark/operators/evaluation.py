"""Calibration, return and error reports; table audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edges of the value buckets.
EDGES = ((0.0, 0.02), (0.02, 0.05), (0.05, 0.10), (0.10, 0.15), (0.15, 0.20), (0.20, 1.0))


def bin_number(probability: Column, bins: int) -> Column:
    """Equal-width bin, the last one closed; edges are i * (1 / bins) as computed in doubles."""
    step = 1.0 / bins
    guess = F.floor(probability * bins)
    below = F.when(probability < guess * F.lit(step), 1).otherwise(0)
    above = F.when(probability >= (guess + 1) * F.lit(step), 1).otherwise(0)
    return F.least(guess - below + above, F.lit(bins - 1))


def calibration_bins(df: DataFrame, keys: Sequence[str], probability: str, outcome: str, bins: int = 10) -> DataFrame:
    p, y = F.col(probability), F.col(outcome)
    table = (
        df.dropna(subset=[probability, outcome])
        .groupBy(*keys, bin_number(p, bins).alias("bin"))
        .agg(
            F.avg(p).alias("mean_predicted"),
            F.avg(y).alias("hit_rate"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return table.withColumn("error", F.abs(F.col("mean_predicted") - F.col("hit_rate"))).withColumn(
        "grade", grade(F.col("error"))
    )


def calibration_summary(df: DataFrame, keys: Sequence[str], probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """Brier score, log loss and expected calibration error, folded per bin first: one shuffle of bin rows."""
    p, y = F.col(probability), F.col(outcome)
    bounded = [F.least(F.greatest(v, F.lit(1e-10)), F.lit(1.0)) for v in (p, 1.0 - p)]
    loss = y * F.ln(bounded[0]) + (1 - y) * F.ln(bounded[1])
    per_bin = (
        df.dropna(subset=[probability, outcome])
        .groupBy(*keys, bin_number(p, bins).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(p).alias("p"),
            F.sum(y).alias("y"),
            F.sum(F.pow(p - y, F.lit(2))).alias("square"),
            F.sum(loss).alias("loss"),
        )
    )
    n = F.sum("n")
    return per_bin.groupBy(*keys).agg(
        n.alias("n"),
        (F.sum("p") / n).alias("mean_predicted"),
        (F.sum("y") / n).alias("hit_rate"),
        (F.sum("square") / n).alias("brier"),
        (-F.sum("loss") / n).alias("log_loss"),
        (F.sum(F.abs(F.col("p") - F.col("y"))) / n).alias("ece"),
    )


def grade(error: Column) -> Column:
    return (
        F.when(error < 0.03, "EXCELLENT").when(error < 0.05, "GOOD").when(error < 0.10, "OK").otherwise("POOR")
    )


def edge_buckets(
    df: DataFrame, keys: Sequence[str], probability: str, outcome: str, odds: str, minimum: int = 5
) -> DataFrame:
    """Return by size of the edge p - 1/odds; buckets of fewer than ``minimum`` bets are left out."""
    p, y, o = F.col(probability), F.col(outcome), F.col(odds)
    edge = p - 1.0 / o
    bucket = F.coalesce(*[F.when((edge >= low) & (edge < high), i) for i, (low, high) in enumerate(EDGES)])
    labels = F.array(*[F.lit(f"{low * 100:.0f}%-{high * 100:.0f}%") for low, high in EDGES])
    profit = F.when(y == 1, o - 1.0).otherwise(-1.0)
    return (
        df.dropna(subset=[probability, outcome, odds])
        .withColumn("bucket", bucket)
        .dropna(subset=["bucket"])
        .groupBy(*keys, "bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(y).alias("hit_rate"),
            F.avg(o).alias("avg_odds"),
            F.avg(p).alias("avg_probability"),
            F.avg(1.0 / o).alias("avg_implied"),
            F.avg(profit).alias("roi"),
            F.sum(profit).alias("total_profit"),
        )
        .filter(F.col("n") >= minimum)
        .withColumn("edge_range", labels[F.col("bucket")])
        .withColumn("profitable", F.col("roi") > 0)
    )


def errors(predicted: Column, actual: Column) -> dict[str, Column]:
    """MAE, RMSE, bias and means as aggregates over rows holding both values."""
    gap = predicted - actual
    both = gap.isNotNull()
    return {
        "mae": F.avg(F.abs(gap)),
        "rmse": F.sqrt(F.avg(F.pow(gap, F.lit(2)))),
        "bias": F.avg(gap),
        "mean_predicted": F.avg(F.when(both, predicted)),
        "mean_actual": F.avg(F.when(both, actual)),
    }


def accuracy(predicted: Column, actual: Column) -> Column:
    """Share of right calls; rows with a missing call do not count."""
    return F.avg((predicted == actual).cast("double"))


def compare_models(df: DataFrame, models: dict[str, tuple[str, str]], actual: tuple[str, str]) -> DataFrame:
    """Errors per model from one pass, with mean RMSE and its gain over the worst model."""
    aggregates = {}
    for model, predicted in models.items():
        for side, p, a in zip(("home", "away"), predicted, actual):
            for name, value in errors(F.col(p), F.col(a)).items():
                aggregates[f"{model}|{side}_{name}"] = value
    one = df.agg(*[v.alias(k) for k, v in aggregates.items()])
    fields = sorted({k.split("|")[1] for k in aggregates})
    rows = F.array(
        *[F.struct(F.lit(m).alias("model"), *[F.col(f"{m}|{f}").alias(f) for f in fields]) for m in models]
    )
    worst = F.greatest(*[(F.col(f"{m}|home_rmse") + F.col(f"{m}|away_rmse")) / 2 for m in models]).alias("__worst")
    table = one.select(worst, F.inline(rows)).withColumn("mean_rmse", (F.col("home_rmse") + F.col("away_rmse")) / 2)
    return table.withColumn("gain_pct", (F.col("__worst") - F.col("mean_rmse")) / F.col("__worst") * 100).drop("__worst")


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls and filled share per column, most nulls first, from one aggregate; plus complete rows."""
    columns = list(columns or df.columns)
    counts = [F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(columns)]
    complete = F.count_if(~_any([F.col(c).isNull() for c in columns])).alias("complete_rows")
    one = df.agg(F.count(F.lit(1)).alias("all_rows"), complete, *counts)
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("nulls")) for i, c in enumerate(columns)]
    )
    return one.select("all_rows", "complete_rows", F.inline(rows)).withColumn(
        "filled_share", 1.0 - F.col("nulls") / F.col("all_rows")
    )


def varying_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose values vary: one aggregate, one row to the driver."""
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def _any(flags: list[Column]) -> Column:
    result = flags[0]
    for flag in flags[1:]:
        result = result | flag
    return result
