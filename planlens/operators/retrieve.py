"""Tool retrieval over embeddings within one query's small catalog."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import greedy_assign


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hard_negatives(tools: DataFrame, group: str, id_col: str, vec: str, k: int) -> DataFrame:
    """For each tool the ``k`` most similar others of its group (ties: smaller id)."""
    a = tools.select(group, F.col(id_col).alias("tool"), F.col(vec).alias("va"))
    b = tools.select(group, F.col(id_col).alias("other"), F.col(vec).alias("vb"))
    s = a.join(b, group).where("tool <> other").withColumn("sim", F.round(dot(F.col("va"), F.col("vb")), 6))
    w = Window.partitionBy(group, "tool").orderBy(F.desc("sim"), "other")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, "tool", "rank", "other", "sim")


def unit(v: Column) -> Column:
    """A vector of norm one; the zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def sgc_retrieve(tools: DataFrame, group: str, id_col: str, vec: str, steps: DataFrame, pos: str, step_vec: str, hops: int = 2) -> DataFrame:
    """``(group, pos, tool)``: each step's best tool of its group after ``hops``
    rounds of smoothing over the complete graph, each tool once until all are used.

    One round gives every tool the mean of all, and more change nothing; without a
    round (``hops`` 0) tools keep their own vectors. Vectors are scaled to norm one;
    scores are compared at nine places, ties go to the smaller id. A group is one
    query's catalog and steps, which are few."""
    own = tools.select(group, F.col(id_col).alias("id"), unit(F.col(vec)).alias("v"))
    if hops:
        dims = own.select(group, F.posexplode("v").alias("d", "x")).groupBy(group, "d").agg(F.avg("x").alias("x"))
        mean = dims.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("d", "x")))["x"].alias("m"))
        own = own.join(mean, group).select(group, "id", unit(F.col("m")).alias("v"))
    listed = own.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("t"))
    wanted = steps.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), unit(F.col(step_vec)).alias("v")))).alias("s"))
    scores = F.transform("s", lambda s: F.transform("t", lambda t: dot(t["v"], s["v"])))
    rows = listed.join(wanted, group).select(group, scores.alias("scores"), F.col("t.id").alias("tools"))
    return greedy_assign(rows, group, "scores", "tools")


def kmeans(tools: DataFrame, group: str, id_col: str, vec: str, rounds: int = 50) -> DataFrame:
    """``(group, id, cluster)``: k-means with ``max(1, n div 3)`` clusters for each
    group, one query's catalog. Centres begin at the first tool and then the one
    farthest from all centres (ties: the smaller id); an empty cluster keeps its centre."""

    def settle(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(id_col)
        x = np.stack(f[vec].to_list()).astype(float)
        far = lambda c: ((x[:, None] - x[c][None]) ** 2).sum(2).min(1)
        chosen = [0]
        while len(chosen) < max(1, len(x) // 3):
            chosen.append(int(far(chosen).argmax()))
        centres, label = x[chosen], None
        for _ in range(rounds):
            new = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            centres = np.stack([x[label == k].mean(0) if (label == k).any() else c for k, c in enumerate(centres)])
        return pd.DataFrame({group: f[group], id_col: f[id_col], "cluster": label})

    kind = {c: t for c, t in tools.dtypes}
    return tools.select(group, id_col, vec).groupBy(group).applyInPandas(settle, f"{group} {kind[group]}, {id_col} {kind[id_col]}, cluster int")


def smoothed(tools: DataFrame, group: str, vec: str) -> DataFrame:
    """One hop over an all-ones normalised graph: the group's mean vector."""
    e = tools.select(group, F.posexplode(vec).alias("dim", "x"))
    m = e.groupBy(group, "dim").agg(F.round(F.sum(F.col("x").cast("double").cast("decimal(28,12)")).cast("double") / F.count("*"), 6).alias("mean"))
    return m


def round_robin(tools: DataFrame, group: str, id_col: str) -> DataFrame:
    """Cluster labels dealt in order over ``max(1, n div 3)`` clusters."""
    w = Window.partitionBy(group)
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / 3))
    return tools.select(group, id_col, ((F.row_number().over(w.orderBy(id_col)) - 1) % k).cast("int").alias("cluster"))
