"""Selection among candidates, pairs, splits and samples."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of_n(df: DataFrame, query: str, idx: str, score: str, confidence: str, text: str) -> DataFrame:
    """Per query: most score, then most confidence, then the shorter text, then the lowest index. A partially aggregated max, no window."""
    key = F.struct(F.col(score), F.col(confidence), -F.length(text), -F.col(idx))
    first = F.min_by(score, idx)
    return df.groupBy(query).agg(F.max_by(idx, key).alias("best_idx"), F.max(score).alias("best_score"), first.alias("first_score"), F.count("*").alias("n_candidates"))


def preference_pairs(df: DataFrame, query: str, order: str, score: str, gap: int = 15) -> DataFrame:
    """Pairs i < j of a query whose scores differ by ``gap`` or more; the better is chosen. Candidates per query are few."""
    a = df.select(query, F.col(order).alias("i"), F.col(score).alias("si"))
    b = df.select(query, F.col(order).alias("j"), F.col(score).alias("sj"))
    p = a.join(b, query).where((F.col("i") < F.col("j")) & (F.abs(F.col("si") - F.col("sj")) >= gap))
    up = F.col("si") > F.col("sj")
    return p.select(query, F.when(up, F.col("i")).otherwise(F.col("j")).alias("chosen"), F.when(up, F.col("j")).otherwise(F.col("i")).alias("rejected"), F.abs(F.col("si") - F.col("sj")).alias("margin"))


def hash_rank(seed: str, key: Column) -> Column:
    """A seeded order that other engines can repeat."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary"))


def split_groups(groups: DataFrame, key: str, shares: tuple[float, float] = (0.8, 0.1), seed: str = "42") -> DataFrame:
    """``(key, split)`` of exact sizes floor(n*r) for distinct keys, r as the decimal
    that it is written as: 90,000 * 0.7 is 63,000, not 62,999. Ranks come
    from counts of hash buckets first, so no task ranks all keys."""
    rows = groups.select(key).distinct().withColumn("_h", hash_rank(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy("_b").agg(F.count("*").alias("c"))  # at most 4,096 rows
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("c").over(Window.partitionBy()))
    ranked = rows.join(F.broadcast(before), "_b").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1)
    a, b = (F.floor(F.col("total") * F.lit(Decimal(repr(r)))) for r in shares)
    return ranked.select(key, F.when(F.col("rank") < a, "train").when(F.col("rank") < a + b, "val").otherwise("test").alias("split"))


def stratified(df: DataFrame, stratum: str, key: str, k: int, seed: str = "42") -> DataFrame:
    """``k`` rows of each stratum by seeded rank, one per (key, stratum)."""
    w = Window.partitionBy(stratum).orderBy(hash_rank(seed, F.col(key)), key)
    return df.dropDuplicates([stratum, key]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_per(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def ranked_candidates(df: DataFrame, group: str, score: str, order: str, value: str, most: int | None = None) -> DataFrame:
    """``(group, candidates)``: each group's structs ``score, order, value``, the best
    first, equal ones in their order. A group is one query's candidates."""
    best = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"), F.col(value).alias("v"))))
    rows = df.groupBy(group).agg((F.slice(best, 1, most) if most else best).alias("c"))
    return rows.select(group, F.transform("c", lambda x: F.struct((-x["s"]).alias(score), x["o"].alias(order), x["v"].alias(value))).alias("candidates"))


def joined_with_missing(rows: DataFrame, lookup: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(inner join, ``(key, n)`` of what the lookup lacks)."""
    missing = rows.join(lookup.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))
    return rows.join(lookup, key), missing


def uncovered_groups(groups: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """``(key, fault)``: keys that a manifest lacks, has twice or has without need; none if it is sound."""
    n = manifest.groupBy(key).agg(F.count("*").alias("n"))
    both = groups.select(key).distinct().withColumn("known", F.lit(True)).join(n, key, "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "twice")
    return both.select(key, fault.alias("fault")).where("fault is not null")


def numbered(df: DataFrame, group: str, order: str, name: str, width: int = 4096) -> DataFrame:
    """``df`` plus its rows' numbers from 0 in each group, by a whole-number ``order``.
    Runs of ``width`` orders are counted first, so no task ranks a whole group."""
    rows = df.withColumn("_b", F.floor(F.col(order) / width))
    w = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(group, "_b").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(group, "_b").orderBy(order)) - 1
    return rows.join(counts.drop("_c"), [group, "_b"]).withColumn(name, F.col("_before") + inside).drop("_b", "_before")


def concat_with_offset(df: DataFrame, batch: str, local_id: str) -> DataFrame:
    """Global ids over batches in order: each is offset by what the ids of those before reach."""
    sizes = df.groupBy(batch).agg((F.max(local_id) + 1).alias("size"))
    offset = F.coalesce(F.sum("size").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(sizes.select(batch, offset.alias("offset")), batch).withColumn("global_id", F.col("offset") + F.col(local_id))


def join_by_steps(gold: DataFrame, pred: DataFrame, query: str, steps: str, order: str, value: str) -> DataFrame:
    """``gold`` plus ``value`` of the prediction of the same query and the same
    tools by step id; of several the last in ``order``. Rows without one go."""
    key = F.to_json(F.array_sort(F.transform(steps, lambda s: F.struct(s["step_id"].alias("i"), s["tool_name"].alias("t")))))
    last = pred.groupBy(query, key.alias("_steps")).agg(F.max_by(value, order).alias(value))
    return gold.withColumn("_steps", key).join(last, [query, "_steps"]).drop("_steps")


def disagreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(side, n)``: distinct keys only in ``a``, only in ``b`` and in both."""
    tagged = a.select(key, F.lit(1).alias("s")).union(b.select(key, F.lit(2).alias("s")))
    where = tagged.groupBy(key).agg(F.bit_or("s").alias("s"))
    one = where.agg(*(F.count_if(F.col("s") == i).alias(n) for i, n in ((1, "only_a"), (2, "only_b"), (3, "both"))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(n).alias("n")) for n in ("only_a", "only_b", "both")))).alias("x")).select("x.*")


def leaking_groups(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups whose rows lie in more than one split; none if a split is sound."""
    return rows.groupBy(group).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b").select(group)
