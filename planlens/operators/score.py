"""Rubric scores and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.plans.corpus import prediction
from planlens.plans.schema import SEVERITY_POINTS

#: Severity of each kind of violation.
SEVERITY = {"unknown_tool": "critical", "missing_param": "high", "type_mismatch": "high", "forward_ref": "critical", "nonexistent_ref": "critical"}


def rubric(violations: DataFrame, plans: DataFrame, key: str = "plan_id") -> DataFrame:
    """``max(0, 100 - points)`` of each plan and the prediction of its band."""
    points = F.lit(0)
    for kind, severity in SEVERITY.items():
        points = F.when(F.col("kind") == kind, SEVERITY_POINTS[severity]).otherwise(points)
    lost = violations.groupBy(key).agg(F.sum(points).alias("lost"), F.count("*").alias("n_issues"))
    out = plans.select(key).join(lost, key, "left")
    score = F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0))).cast("int")
    return out.select(key, F.coalesce("n_issues", F.lit(0)).alias("n_issues"), score.alias("rubric_score")).withColumn("prediction", prediction(F.col("rubric_score")))


def reward(score: Column) -> Column:
    return score / 100.0


def reward_v2(score: Column, n_steps: Column, n_gold: Column, error_type: Column) -> Column:
    """Score share, less a penalty for step counts off by two or more and for wrong tools under 0.8; from 0 to 1."""
    base = score / 100.0
    delta = F.abs(n_steps - n_gold)
    steps = F.when((n_gold <= 0) | (delta <= 1), 0.0).otherwise(F.greatest(F.lit(-0.15), -0.05 * (delta - 1)))
    wrong = F.when((error_type == "wrong_tool") & (base < 0.8), -0.10).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + steps + wrong))


def uct(value: Column, visits: Column, parent_visits: Column, c: float = 1.414) -> Column:
    """Upper confidence of a search node; infinite if it was never visited."""
    return F.when(visits == 0, F.lit(float("inf"))).otherwise(value + c * F.sqrt(F.ln(parent_visits) / visits))


def node_value(mean_score: Column, consistency: Column) -> Column:
    return 0.5 * mean_score / 100 + 0.5 * consistency


def prior_score(q: Column, prior: Column, visits: Column, parent_visits: Column, weight: float = 1.0) -> Column:
    """Selection score of a child by its value, prior (1e-6 at least) and visits, without jitter."""
    kept = F.when(prior > 0, prior).otherwise(F.lit(1e-6))
    return q + weight * kept * F.sqrt(F.ln(F.greatest(parent_visits, F.lit(1)) + 1)) / (1 + visits)


def backpropagated(rollouts: DataFrame, path: list[str], reward: str) -> DataFrame:
    """``(path..., visits, q)`` of every node on the rollouts' paths, the root (all
    null) included: a running mean of rewards ends at their mean, so one pass of
    a rollup gives what updates along each path would."""
    out = rollouts.rollup(*path).agg(F.count("*").alias("visits"), F.avg(reward).alias("q"), F.grouping_id().alias("_g"))
    return out.withColumn("depth", F.lit(len(path)) - F.bit_count("_g")).drop("_g")


def descend(nodes: DataFrame, path: list[str], prior: str) -> DataFrame:
    """``(path...)`` of the leaf that is reached from the root by the best child at
    every level. ``nodes`` has a row a node, with nulls beyond its depth."""
    at = None
    for depth in range(1, len(path) + 1):
        level = nodes.where(F.col(path[depth - 1]).isNotNull())
        for c in path[depth:]:
            level = level.where(F.col(c).isNull())
        if at is None:
            at = best_child(level.withColumn("_root", F.lit(0)), ["_root"], path[0], prior).select(path[0])
        else:
            at = best_child(level.join(at, path[: depth - 1], "left_semi"), path[: depth - 1], path[depth - 1], prior)
    return at.select(*path)


def best_child(nodes: DataFrame, parent: list[str], child: str, prior: str) -> DataFrame:
    """Each parent's child of the greatest value, then visits, then prior (ties: the first by name)."""
    key = F.struct("q", "visits", prior)
    top = nodes.groupBy(*parent).agg(F.max(key).alias("_top"))
    return nodes.join(top, parent).where((F.col("q") == F.col("_top.q")) & (F.col("visits") == F.col("_top.visits")) & F.col(prior).eqNullSafe(F.col(f"_top.{prior}"))).groupBy(*parent).agg(F.min(child).alias(child))
