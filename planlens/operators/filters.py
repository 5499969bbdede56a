"""Which plans, queries and steps take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def perfect(error_type: Column, score: Column, least: int = 100) -> Column:
    """No error and a full score."""
    return (error_type == "none") & (score >= least)


def perfect_by_type(error_type: Column, score: Column, least: int = 95) -> Column:
    """No error by type; where no type is known, a score of ``least`` or more."""
    return F.coalesce(error_type == "none", score >= least, F.lit(False))


def of_score(score: Column, least: float | None = None, most: float | None = None) -> Column:
    """A score in the closed range; null never is."""
    inside = score.isNotNull()
    if least is not None:
        inside &= score >= least
    return inside & (score <= most) if most is not None else inside


def covered(plans: DataFrame, tools: DataFrame, key: str = "plan_id", steps: str = "steps", name: str = "tool_name") -> DataFrame:
    """Plans of which every step's tool is in ``tools``; plans without steps are not."""
    used = plans.select(key, F.explode(F.array_distinct(F.col(steps)["tool_name"])).alias(name))
    missing = used.join(tools.select(name).distinct(), name, "left_anti").select(key).distinct()
    return plans.where(F.size(steps) > 0).join(missing, key, "left_anti")


def organic_failure(plan_text: Column, functional_match: Column, correct: Column | None = None) -> Column:
    """Whether a plan that a model wrote fails without a judge: by its match with the gold
    plan, or, where runs are at hand, by their being ``correct`` (null: not run, a failure).
    Null for empty plans, which fail to parse and count as neither."""
    failed = functional_match.eqNullSafe(F.lit(False)) if correct is None else ~F.coalesce(correct, F.lit(False))
    return F.when(F.coalesce(F.trim(plan_text), F.lit("")) != "", failed)


def stop(score: Column, least: int = 100) -> Column:
    """Whether a search may end."""
    return score >= least


def reflect(score: Column, under: int = 70) -> Column:
    return score < under


def revise(score: Column, under: int = 60) -> Column:
    return score < under


def handled(error_type: Column, exact: Column, functional: Column) -> Column:
    """Whether a plan for a query with an error type was made right; null without an error."""
    return F.when(error_type != "none", exact | functional)


def agrees(score: Column, reference: Column, least: int = 80) -> Column:
    """Whether a judge's verdict is the reference's."""
    return (score >= least) == (reference >= least)
