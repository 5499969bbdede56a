"""Tree search in rounds over a table of nodes: all queries' trees grow by one leaf a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.sources.scratch import drop, keep

from .score import prior_score


def grow(candidates: DataFrame, query: str, rounds: int, depth: int, weight: float = 1.0) -> DataFrame:
    """``(query, node, parent, prior, visits, q)`` of the nodes in each query's tree.

    ``candidates`` has ``query, node, parent, prior, reward``: every node that a tree can
    hold, the root without a parent; ``depth`` is the largest one below the root. A round
    goes down from the root to the child of the best ``prior_score`` (ties: the smaller
    node) until a node has no children in the tree; that leaf is rated by its reward, its
    candidates enter with no visits, and each node on the way counts one visit more and
    takes the reward into its mean ``q``.

    A round is ``depth`` joins by (query, parent), and each is written, so that lineage
    stays short; no tree is gathered in one task. Queries without a root have no tree.
    The candidates are written first: what derives them runs once, not once a round.
    Only a leaf's own candidates are looked up in them, as the tree has its reward.
    Trees compress so well that their files look small enough to broadcast, hence the hints.
    """
    all_ = keep(candidates.select(F.col(query).alias("query"), "node", "parent", "prior", "reward"), "candidates")
    below = all_.where("parent is not null")
    entered = lambda df: df.select("query", "node", "parent", "prior", "reward", F.lit(0).cast("bigint").alias("visits"), F.lit(0.0).alias("q"))
    tree = keep(entered(all_.where("parent is null")), "tree")
    for _ in range(rounds):
        at = tree.where("parent is null").select("query", F.col("node").alias("at"), F.col("visits").alias("above"), F.array("node").alias("path"), F.col("reward").alias("gain"))
        for _ in range(depth):
            kids = tree.select("query", F.col("parent").alias("at"), F.col("node").alias("child"), F.col("visits").alias("own"), "q", "prior", "reward")
            rate = prior_score(F.col("q"), F.col("prior"), F.col("own"), F.col("above"), weight)
            met = at.join(kids.hint("merge"), ["query", "at"], "left").withColumn("rate", rate)
            best = F.min_by(F.struct("child", "own", "reward"), F.when(F.col("child").isNotNull(), F.struct(-F.col("rate"), F.col("child"))))
            met = met.groupBy("query").agg(F.first("at").alias("at"), F.first("above").alias("above"), F.first("path").alias("path"), F.first("gain").alias("gain"), best.alias("b"))
            at = met.select("query", F.coalesce("b.child", "at").alias("at"), F.coalesce("b.own", "above").alias("above"), F.when(F.col("b.child").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("b.child"))).alias("path"), F.when(F.col("b.child").isNull(), F.col("gain")).otherwise(F.col("b.reward")).alias("gain"))
        at = keep(at, "ways")
        passed = at.select("query", F.explode("path").alias("node"), "gain")
        moved = tree.join(passed.hint("merge"), ["query", "node"], "left")
        moved = moved.withColumn("q", F.when(F.col("gain").isNull(), F.col("q")).otherwise(F.col("q") + (F.col("gain") - F.col("q")) / (F.col("visits") + 1))).withColumn("visits", F.col("visits") + F.when(F.col("gain").isNull(), 0).otherwise(1))
        # a leaf that was a leaf before has its candidates in the tree only if it has none
        fresh = below.join(at.select("query", F.col("at").alias("parent")).hint("merge"), ["query", "parent"], "left_semi")
        old, tree = tree, keep(moved.select(*tree.columns).union(entered(fresh).select(*tree.columns)), "tree")
        drop(old)
        drop(at)
    drop(all_)
    return tree.select(F.col("query").alias(query), "node", "parent", "prior", "visits", "q")
