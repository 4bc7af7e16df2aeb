"""Value, stake and settlement expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.poisson import clip, single_rate_under


@dataclass(frozen=True)
class Rules:
    """Selection limits and staking parameters."""

    target_line: float = 2.5
    min_edge: float = 0.10
    min_probability: float = 0.35
    max_probability: float = 0.75
    kelly_share: float = 0.15
    max_fraction: float = 0.05
    bankroll: float = 10_000.0
    path_fraction: float = 0.10


def expected_value(probability: Column, odds: Column) -> Column:
    """p * odds - 1."""
    return probability * odds - 1.0


def probability_edge(probability: Column, odds: Column) -> Column:
    """p - 1 / odds."""
    return probability - 1.0 / odds


def kelly(probability: Column, odds: Column) -> Column:
    """Full Kelly fraction, zero at odds of one or less."""
    gain = odds - 1.0
    full = F.greatest(F.lit(0.0), (probability * gain - (1.0 - probability)) / gain)
    return F.when(odds <= 1.0, 0.0).otherwise(full)


def kelly_stake(full: Column, share: float = 0.15, cap: float = 0.05) -> Column:
    return F.least(full * share, F.lit(cap))


def edge_stake(edge: Column, odds: Column, share: float = 0.25, cap: float = 0.05) -> Column:
    """Stake from the probability edge: min(share * edge / (odds - 1), cap)."""
    return F.least(F.when(odds > 1.0, edge / (odds - 1.0)).otherwise(0.0) * share, F.lit(cap))


def report_stake(probability: Column, odds: Column, share: float = 0.25, cap: float = 0.05) -> Column:
    raw = share * (probability - (1.0 - probability) / (odds - 1.0))
    return F.when(odds > 1.0, F.greatest(F.lit(0.0), F.least(F.lit(cap), raw))).otherwise(0.0)


def settle(total: Column, line: Column, selection: Column) -> Column:
    """Won? A push (total equals line) is a loss; null when there is no total."""
    won = F.when(selection == "Over", total > line).otherwise(total < line)
    return F.when(total.isNotNull(), won)


def profit(won: Column, stake: Column, odds: Column) -> Column:
    return F.when(won.isNull(), 0.0).when(won, stake * (odds - 1.0)).otherwise(-stake)


def pick_signals(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Best over/under option per match that passes the limits, with its stake.

    Expects ``pred_total_goals, line, over_odds, under_odds`` and the nullable
    ``cal_over_prob, cal_under_prob``, which replace the model on the target line.
    Over is kept on equal value.
    """
    on_target = F.abs(F.col("line") - rules.target_line) < 1e-6
    priced = df.withColumn("__under", single_rate_under(F.col("line"), F.col("pred_total_goals")))
    model = {"over": 1.0 - F.col("__under"), "under": F.col("__under")}
    columns = {}
    for side in ("over", "under"):
        calibrated = F.when(on_target, F.col(f"cal_{side}_prob"))
        chosen = clip(F.coalesce(calibrated, model[side]), 1e-4, 1 - 1e-4)
        columns[f"{side}_prob"] = F.when(F.col(f"{side}_odds").isNotNull(), chosen)
    priced = priced.withColumns(columns)
    options = []
    for rank, side in enumerate(("Over", "Under")):
        p, odds = F.col(f"{side.lower()}_prob"), F.col(f"{side.lower()}_odds")
        options.append(
            F.struct(
                expected_value(p, odds).alias("edge"),
                F.lit(-rank).alias("rank"),
                F.lit(side).alias("selection"),
                p.alias("probability"),
                odds.alias("odds"),
            )
        )
    allowed = F.filter(
        F.array(*options),
        lambda o: o["probability"].between(rules.min_probability, rules.max_probability)
        & (o["edge"] >= rules.min_edge),
    )
    # a generator of at most one row: a filter here would be pushed below and price every option again
    best = F.inline(F.array_compact(F.array(F.array_max(allowed))))
    fraction = kelly_stake(kelly(F.col("probability"), F.col("odds")), rules.kelly_share, rules.max_fraction)
    return (
        priced.select(*df.columns, *columns, best)
        .drop("rank")
        .withColumn("stake_fraction", fraction)
        .withColumn("stake", F.col("stake_fraction") * rules.bankroll)
    )
