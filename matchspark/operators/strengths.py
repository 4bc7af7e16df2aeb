"""Time-weighted attack and defense strengths with low-score correlation, fitted by Spark jobs.

The matches are first compressed to weights per (home, away, score), which are
all the likelihood needs. Each sweep then takes one Newton step for every
team's attack, one for every team's defense, and one for the two scalars. Given
the other block, teams are independent, so a step is one aggregate per team.
Strengths and scalars stay a table; the driver reads one row per sweep to see
whether it moved.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions import conform
from matchspark.functions.poisson import clip, low_score_factor, pmf
from matchspark.session import cut

RIDGE = 0.001


class Strengths(NamedTuple):
    teams: DataFrame  # team, attack, defense
    home_advantage: float
    rho: float
    loss: float  # of the step before the last
    converged: bool
    levels: DataFrame  # as teams, before centring, with advantage and rho
    weights: DataFrame  # what was fitted: summed weight of each pairing and score


def score_weights(matches: DataFrame, rate: float = 0.0018) -> DataFrame:
    """Summed time-decay weight per (home, away, score), relative to the latest match."""
    latest = matches.agg(F.max("match_date").alias("d")).scalar()
    weight = conform.decay(F.col("match_date"), latest, rate)
    known = matches.dropna(subset=["home_team", "away_team", "home_goals", "away_goals", "match_date"])
    return known.groupBy("home_team", "away_team", "home_goals", "away_goals").agg(F.sum(weight).alias("weight"))


def _rated(weights: DataFrame, teams: DataFrame) -> DataFrame:
    """Scores with expected goals and the slopes of the log-likelihood in log expected goals and rho.

    The two scalars are read from the team table, not written into the plan:
    the generated code stays the same from sweep to sweep and is compiled once.
    """
    home = teams.select(
        F.col("team").alias("home_team"), F.col("attack").alias("home_att"), F.col("defense").alias("home_def"),
        "advantage", "rho",
    )
    away = teams.select(
        F.col("team").alias("away_team"), F.col("attack").alias("away_att"), F.col("defense").alias("away_def")
    )
    joined = weights.join(home, "home_team").join(away, "away_team")
    home_log = F.col("home_att") + F.col("away_def") + F.col("advantage")
    away_log = F.col("away_att") + F.col("home_def")
    rated = joined.withColumns({"l": clip(F.exp(home_log), 0.01, 6.0), "m": clip(F.exp(away_log), 0.01, 6.0)})
    # where expected goals or the correlation are held at a bound, they do not follow the parameters
    free = {"l": F.exp(home_log).between(0.01, 6.0), "m": F.exp(away_log).between(0.01, 6.0)}
    h, a, lam, mu, rho = (F.col(c) for c in ("home_goals", "away_goals", "l", "m", "rho"))
    factor = low_score_factor(h, a, lam, mu, rho)
    rated = rated.withColumn("tau", F.greatest(factor, F.lit(0.001)))
    follows = (factor > 0.001).cast("double")

    def cell(i: int, j: int, value: Column) -> Column:
        return F.when((h == i) & (a == j), value).otherwise(0.0)

    in_home = cell(0, 0, -lam * mu * rho) + cell(0, 1, lam * rho)
    in_away = cell(0, 0, -lam * mu * rho) + cell(1, 0, mu * rho)
    in_rho = cell(0, 0, -lam * mu) + cell(0, 1, lam) + cell(1, 0, mu) + cell(1, 1, F.lit(-1.0))
    chance = F.col("tau") * pmf(h.cast("int"), lam) * pmf(a.cast("int"), mu)
    return rated.withColumns(
        {
            "home_slope": F.when(free["l"], h - lam + follows * in_home / F.col("tau")).otherwise(0.0),
            "away_slope": F.when(free["m"], a - mu + follows * in_away / F.col("tau")).otherwise(0.0),
            "rho_slope": follows * in_rho / F.col("tau"),
            "loss": -F.col("weight") * F.ln(F.greatest(chance, F.lit(1e-10))),
        }
    )


def _team_step(weights: DataFrame, teams: DataFrame, block: str) -> DataFrame:
    """One Newton step of ``attack`` or ``defense`` for every team; its size is kept as ``{block}_move``."""
    home_owner, away_owner = ("home_team", "away_team") if block == "attack" else ("away_team", "home_team")
    shares = F.array(
        F.struct(F.col(home_owner).alias("team"), F.col("home_slope").alias("slope"), F.col("l").alias("curve")),
        F.struct(F.col(away_owner).alias("team"), F.col("away_slope").alias("slope"), F.col("m").alias("curve")),
    )
    sums = (
        _rated(weights, teams)
        .select("weight", F.inline(shares))
        .groupBy("team")
        .agg(F.sum(F.col("weight") * F.col("slope")).alias("slope"), F.sum(F.col("weight") * F.col("curve")).alias("curve"))
    )
    raw = (F.col("slope") - 2 * RIDGE * F.col(block)) / (F.col("curve") + 2 * RIDGE)
    move = f"{block}_move"
    moved = teams.drop(move).join(sums, "team").withColumn(move, clip(raw, -1.0, 1.0))
    return moved.withColumn(block, F.col(block) + F.col(move)).drop("slope", "curve")


def _scalar_step(weights: DataFrame, teams: DataFrame) -> DataFrame:
    """One Newton step of home advantage, the common level of attack and correlation, within their bounds.

    Advantage and level pull on the same home goals, so both are solved for at once: away goals set the level.
    """
    w = F.col("weight")
    totals = _rated(weights, teams).agg(
        F.struct(
            F.try_divide(F.sum(w * F.col("home_slope")), F.sum(w * F.col("l"))).alias("home"),
            F.sum(w * F.col("away_slope")).alias("away"),
            F.sum(w * F.col("m")).alias("curve"),
            F.try_divide(F.sum(w * F.col("rho_slope")), F.sum(w * F.pow("rho_slope", F.lit(2)))).alias("rho"),
            F.sum("loss").alias("loss"),
        )
    ).scalar()
    held = teams.agg(F.struct(F.sum("attack").alias("attack"), F.count(F.lit(1)).alias("n"))).scalar()
    level = (totals["away"] - 2 * RIDGE * held["attack"]) / (totals["curve"] + 2 * RIDGE * held["n"])
    level = clip(F.coalesce(level, F.lit(0.0)), -1.0, 1.0)
    advantage = F.coalesce(totals["home"], F.lit(0.0)) - level
    rho = F.coalesce(totals["rho"], F.lit(0.0))
    return teams.withColumns(
        {
            "attack": F.col("attack") + level,
            "advantage": clip(F.col("advantage") + advantage, -0.5, 1.5),
            "rho": clip(F.col("rho") + rho, -0.5, 0.5),
            "scalar_move": F.greatest(F.abs(level), F.abs(advantage), F.abs(rho)),
            "loss": totals["loss"],
        }
    )


def fit(matches: DataFrame, rate: float = 0.0018, sweeps: int = 30, tolerance: float = 1e-5) -> Strengths:
    """Strengths, home advantage and correlation; attack and defense are centred after the fit.

    Raising every attack and lowering every defense alike changes no expected goals; only the ridge
    holds that direction, so each sweep sets it by the ridge's own minimum instead of creeping along.
    ``converged`` tells whether the last sweep's moves were below ``tolerance`` within ``sweeps``.
    """
    weights = cut(score_weights(matches, rate), "weights")
    names = weights.select(F.col("home_team").alias("team")).union(weights.select("away_team")).distinct()
    start = {"attack": 0.0, "defense": 0.0, "advantage": 0.25, "rho": -0.1}
    teams = cut(names.withColumns({k: F.lit(v) for k, v in start.items()}), "strengths")
    moves = F.greatest(*[F.max(F.abs(f"{m}_move")) for m in ("attack", "defense", "scalar")])
    for _ in range(sweeps):
        teams = cut(_team_step(weights, teams, "attack"), "attack", teams)
        teams = cut(_team_step(weights, teams, "defense"), "defense", teams)
        half = teams.agg(((F.avg("defense") - F.avg("attack")) / 2).alias("half")).scalar()
        level = teams.withColumns({"attack": F.col("attack") + half, "defense": F.col("defense") - half})
        teams = cut(_scalar_step(weights, level), "strengths", teams)
        last = teams.agg(moves.alias("move"), *[F.first(c).alias(c) for c in ("advantage", "rho", "loss")]).first()
        if last["move"] < tolerance:
            break
    mean = teams.agg(F.struct(F.avg("attack").alias("attack"), F.avg("defense").alias("defense"))).scalar()
    centred = teams.select("team", *[(F.col(c) - mean[c]).alias(c) for c in ("attack", "defense")])
    return Strengths(centred, last["advantage"], last["rho"], last["loss"], last["move"] < tolerance, teams, weights)


def expected_for(fitted: Strengths) -> DataFrame:
    """(team, expected): weighted goals that the fit gives each team, with the ridge's share.

    At the optimum they equal the weighted goals that the team scored.
    """
    rated = _rated(fitted.weights, fitted.levels)
    w = F.col("weight")
    sides = F.array(
        F.struct(F.col("home_team").alias("team"), (w * (F.col("home_goals") - F.col("home_slope"))).alias("goals")),
        F.struct(F.col("away_team").alias("team"), (w * (F.col("away_goals") - F.col("away_slope"))).alias("goals")),
    )
    sums = rated.select(F.inline(sides)).groupBy("team").agg(F.sum("goals").alias("goals"))
    both = sums.join(fitted.levels.select("team", "attack"), "team")
    return both.select("team", (F.col("goals") + 2 * RIDGE * F.col("attack")).alias("expected"))
