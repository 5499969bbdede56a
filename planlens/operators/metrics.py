"""Judge, calibration and agreement statistics as single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlens.plans.schema import ECE_EDGES


def r6(c: Column) -> Column:
    return F.round(c, 6)


def share(condition: Column) -> Column:
    """Share of rows on which a condition holds; null counts as not."""
    return F.sum(F.coalesce(condition, F.lit(False)).cast("bigint")) / F.count("*")


def judge_errors(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """n, mae, rmse, acc_at_15 and Pearson's r, from integer sums."""
    g, p = F.col(gold).cast("bigint"), F.col(pred).cast("bigint")
    n = F.count("*").cast("double")
    sums = df.groupBy(*by).agg(n.alias("n"), F.sum(F.abs(g - p)).alias("a"), F.sum((g - p) * (g - p)).alias("q"), F.sum((F.abs(g - p) <= 15).cast("bigint")).alias("k"), F.sum(g).alias("g"), F.sum(p).alias("p"), F.sum(g * g).alias("gg"), F.sum(p * p).alias("pp"), F.sum(g * p).alias("gp"))
    r = F.expr("try_divide(n * gp - g * p, sqrt(n * gg - cast(g as double) * g) * sqrt(n * pp - cast(p as double) * p))")
    return sums.select(*by, F.col("n").cast("bigint").alias("n"), r6(F.col("a") / F.col("n")).alias("mae"), r6(F.sqrt(F.col("q") / F.col("n"))).alias("rmse"), r6(F.col("k") / F.col("n")).alias("acc_at_15"), r6(r).alias("pearson"))


def prf(df: DataFrame, gold: str, pred: str, classes: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class, absent ones included."""
    both = df.select(F.explode(F.array(F.struct(F.col(gold).alias("c"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(pred)).cast("int").alias("t")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    counts = both.groupBy("c").agg(F.sum("g").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("tp"))
    dim = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    out = dim.join(counts, dim["class"] == counts["c"], "left").fillna(0, ["support", "predicted", "tp"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return out.select("class", "support", r6(p).alias("precision"), r6(r).alias("recall"), r6(ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))).alias("f1"))


def averaged(by_class: DataFrame) -> DataFrame:
    """``macro_precision, macro_recall, macro_f1, weighted_f1, support`` of ``prf()``'s
    classes: plain means over the classes that occur, and F1 weighted by support."""
    seen = by_class.where("support > 0")
    mean = lambda c: r6(F.avg(c))
    weighted = r6(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")))
    return seen.agg(mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"), mean("f1").alias("macro_f1"), weighted.alias("weighted_f1"), F.sum("support").alias("support"))


def ece(df: DataFrame, confidence: str, correct: Column) -> DataFrame:
    """Expected calibration error over ten bins ``[lo, hi)``; confidence 1.0 is in no bin but counts in n."""
    bin_ = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(ECE_EDGES, ECE_EDGES[1:], strict=False)):
        bin_ = F.when((F.col(confidence) >= lo) & (F.col(confidence) < hi), i).otherwise(bin_)
    n = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("k"), F.sum(F.round(F.col(confidence) * 10000).cast("bigint")).alias("c"), F.sum(correct.cast("bigint")).alias("t"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("c") / 10000 - F.col("t"))).otherwise(0.0)
    return n.agg(F.sum("k").alias("n"), r6(F.sum(gap) / F.sum("k")).alias("ece"))


def auc(df: DataFrame, score: str, positive: Column, *by: str) -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties; null if a class is empty.

    Equal scores are counted first, so ranking runs over distinct scores only."""
    keys = [*by] or [F.lit(1).alias("_all")]
    c = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(positive.cast("bigint")).alias("p"), F.sum((~positive).cast("bigint")).alias("n"))
    part = [*by] or ["_all"]
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*part).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = c.withColumn("u", F.col("p") * (2 * below + F.col("n"))).groupBy(*part).agg(F.sum("u").alias("u"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return u.select(*by, "n_pos", "n_neg", r6(F.try_divide(F.col("u").cast("double"), 2.0 * F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and Cohen's kappa (1 where chance agreement is 1)."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("k"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("k").alias("x"), F.lit(0).cast("bigint").alias("y")), F.struct(F.col("b").alias("c"), F.lit(0).cast("bigint").alias("x"), F.col("k").alias("y")))).alias("s")).groupBy("s.c").agg(F.sum("s.x").alias("x"), F.sum("s.y").alias("y"))
    chance = sides.agg(F.sum(F.col("x") * F.col("y")).alias("e"))
    total = pairs.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("k")).otherwise(0)).alias("o"))
    both = total.join(chance, F.lit(True))  # one row each
    po, pe = F.col("o") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return both.select("n", r6(po).alias("agreement"), r6(F.when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe))).alias("kappa"))


def agreements(sheets: dict[str, DataFrame], item: str, labels: list[str]) -> DataFrame:
    """``(label, a, b, n, agreement, kappa)`` for each label and each pair of annotators:
    over the items that both have marked, Cohen's kappa (1 where chance agreement is 1).

    ``sheets``: a table of ``item`` and ``labels`` by annotator, in order; items and labels
    that are null do not count, and of an item that repeats in a sheet the greatest mark
    stands. Pairs without common items have no row. One join by item for all pairs; no list of marks is made.
    """
    names = list(sheets)
    marks = [df.groupBy(F.col(item).alias("item")).agg(*(F.max(c).alias(c) for c in labels)).where("item is not null").withColumn("who", F.lit(i)) for i, df in enumerate(sheets.values())]
    every = marks[0]
    for df in marks[1:]:
        every = every.union(df)
    long = every.select("item", "who", F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("mark")) for c in labels))).alias("m")).select("item", "who", "m.*").where("mark is not null")
    side = lambda x: long.select("item", "label", F.col("who").alias(x), F.col("mark").alias(f"m{x}"))
    pairs = side("a").join(side("b"), ["item", "label"]).where("a < b").groupBy("label", "a", "b", "ma", "mb").agg(F.count("*").alias("k"))
    by = ["label", "a", "b"]
    total = pairs.groupBy(by).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("ma") == F.col("mb"), F.col("k")).otherwise(0)).alias("same"))
    one = lambda m, x: pairs.groupBy(*by, F.col(m).alias("mark")).agg(F.sum("k").alias(x))
    chance = one("ma", "x").join(one("mb", "y"), [*by, "mark"]).groupBy(by).agg(F.sum(F.col("x") * F.col("y")).alias("e"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("e", F.lit(0)) / (F.col("n") * F.col("n"))
    name = lambda c: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1).alias(c)
    return total.join(chance, by, "left").select("label", name("a"), name("b"), "n", r6(po).alias("agreement"), r6(F.when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe))).alias("kappa"))


def upper_median(name: str) -> Column:
    """``sorted[n // 2]``, by counts of distinct values, not a list: the lower one of the two from above."""
    return F.expr(f"percentile_disc(0.5) within group (order by {name} desc)")


def rollouts(df: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, n, mean, std, lo, hi)`` of a group's rewards."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def goldilocks(stats: DataFrame, least: float, most: float, spread: float) -> DataFrame:
    """Groups that are neither saturated nor hopeless: a mean in the closed range or a wide spread."""
    return stats.where(F.col("mean").between(least, most) | (F.col("std") > spread))


def distribution(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """``(column, n, pct)`` for every name, also one that never occurs; shares are of all rows."""
    one = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(column) == n).alias(n) for n in names))
    row = lambda n: F.struct(F.lit(n).alias(column), F.col(n).alias("n"), F.round(100.0 * F.col(n) / F.col("_n"), 1).alias("pct"))
    return one.select(F.explode(F.array(*map(row, names))).alias("x")).select("x.*")


def legacy_binary(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row over three classes (success, uncertain, failure): rows whose prediction
    is uncertain are left out, uncertain gold rows count as wrong."""
    g, p = F.col(gold), F.col(pred)
    told, right, yes = p != "uncertain", g == p, p == "success"
    n = lambda e: F.count_if(e)
    return df.agg(n(told).alias("n_confident"), r6(n(told) / F.count("*")).alias("coverage"), r6(F.try_divide(n(told & right), n(told))).alias("legacy_binary_accuracy"), r6(F.try_divide(n(yes & right), n(yes))).alias("legacy_binary_precision"))


def detection(pairs: DataFrame, by: str, score: str, gold: str, least: float = 80) -> DataFrame:
    """``(by, n, detection, separation, gold_pass)`` of faulty plans beside their gold
    plan's score: the share scored low, the mean gap, the share of gold scored high."""
    s, g = F.col(score), F.col(gold)
    return pairs.groupBy(by).agg(F.count("*").alias("n"), r6(share(s < least)).alias("detection"), r6(F.sum(g - s) / F.count("*")).alias("separation"), r6(share(g >= least)).alias("gold_pass"))


def consistency(plans: DataFrame, group: str, order: str, tools: str) -> DataFrame:
    """``(group, consistency)``: mean over pairs of a group's plans, which are one
    query's few candidates, of the share of positions with the same tool."""
    one = lambda o, t: plans.select(group, F.col(order).alias(o), F.col(tools).alias(t))
    same = F.expr("size(filter(arrays_zip(x, y), z -> z.x = z.y))")
    longest = F.greatest(F.size("x"), F.size("y"))
    like = F.round(F.coalesce(F.try_divide(same, longest), F.lit(0.0)), 6)
    pairs = one("i", "x").join(one("j", "y"), group).where("i < j").select(group, like.alias("s"))
    return pairs.groupBy(group).agg(r6(F.avg("s")).alias("consistency"))


def bands(df: DataFrame, score: str, cuts: dict[str, tuple[float, float]]) -> DataFrame:
    """``(band, n)`` with a row for every band, ``lo <= score < hi``."""
    one = df.agg(*(F.sum(((F.col(score) >= lo) & (F.col(score) < hi)).cast("bigint")).alias(k) for k, (lo, hi) in cuts.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias("n")) for k in cuts))).alias("x")).select("x.*")
