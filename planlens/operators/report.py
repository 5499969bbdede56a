"""Tables over per-plan results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlens.plans.schema import CATEGORIES

from .metrics import r6, upper_median


def stats_by_type(df: DataFrame, ratios: dict[str, Column], by: str = "error_type") -> DataFrame:
    """n and mean of each ratio by type and overall (type ``ALL``), in one pass of grouping sets."""
    cols = df.select(F.col(by), *(c.cast("double").alias(k) for k, c in ratios.items()))
    sets = cols.groupingSets([[by], []], by)
    means = [r6(F.sum(F.round(F.col(k) * 1_000_000_000).cast("bigint")) / F.count("*") / 1e9).alias(k) for k in ratios]
    out = sets.agg(F.grouping(by).alias("_all"), F.count("*").alias("n"), *means)
    return out.withColumn(by, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by))).drop("_all")


def category(error_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, types in CATEGORIES.items():
        out = F.when(error_type.isin(*types), name).otherwise(out)
    return out


def category_error_rate(by_type: DataFrame, rate: str, n: str = "n") -> DataFrame:
    """Error rate of each category, weighted by its types' counts."""
    c = by_type.withColumn("category", category(F.col("error_type"))).where("category is not null")
    return c.groupBy("category").agg(F.sum(n).alias("n"), r6(F.sum(F.round(F.col(rate) * F.col(n)).cast("bigint")) / F.sum(n)).alias("error_rate"))


def gains(df: DataFrame, key: str, method: str, value: str, baseline: str) -> DataFrame:
    """Points that each other method gains over ``baseline``, by key."""
    base = df.where(F.col(method) == baseline).select(key, F.col(value).alias("_base"))
    return df.where(F.col(method) != baseline).join(base, key).select(key, method, r6(100 * (F.col(value) - F.col("_base"))).alias("gain_pts"))


def diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    a = before.select(*keys, *(F.col(v).alias(f"{v}_before") for v in values))
    b = after.select(*keys, *(F.col(v).alias(f"{v}_after") for v in values))
    return a.join(b, keys).select("*", *(r6(F.col(f"{v}_after") - F.col(f"{v}_before")).alias(f"{v}_delta") for v in values))


def corpus_report(plans: DataFrame, issues: DataFrame, key: str = "plan_id", clean: tuple[str, ...] = ("none", "parameter_typo"), most: float = 95) -> DataFrame:
    """n, mean score and mean number of issues of each error type, and whether
    its injector is suspicious: a mean over ``most`` where errors should show."""
    counts = issues.groupBy(key).agg(F.count("*").alias("k"))
    by = plans.select(key, "error_type", "quality_score").join(counts, key, "left").groupBy("error_type")
    n = F.count("*")
    mean = F.sum("quality_score") / n
    return by.agg(n.alias("n"), r6(mean).alias("avg_score"), r6(F.sum(F.coalesce("k", F.lit(0))) / n).alias("avg_issues"), ((mean > most) & ~F.first("error_type").isin(*clean)).alias("suspicious"))


def shares_of(df: DataFrame, column: Column, names: list[str]) -> DataFrame:
    """``(name, n, pct)`` of the rows with each name, absent ones included, in one pass."""
    one = df.agg(*(F.count_if(column == n).alias(f"c{i}") for i, n in enumerate(names)), F.count("*").alias("_n"))
    rows = (F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("n"), F.round(F.try_divide(100.0 * F.col(f"c{i}"), F.col("_n")), 1).alias("pct")) for i, n in enumerate(names))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def execution_summary(runs: DataFrame, key: str = "query_id", order: str = "ordinal") -> DataFrame:
    """Coverage, completion and accuracy of runs (columns exec_status, strict,
    lenient), accuracy among those that a judge passes or fails and among
    functional matches, and that of each query's first run. Uncovered runs count
    in the coverage only; an empty condition gives null."""
    r = runs.withColumn("_c", F.col("exec_status") != "uncovered")
    first = F.min_by(F.struct("strict", "_c"), F.when(F.col("_c"), F.col(order)))
    by = r.groupBy(key).agg(
        F.count("*").alias("n"),
        *(F.count_if(F.expr(f"_c and {e}")).alias(k) for k, e in {"covered": "true", "ok": "exec_status = 'ok'", "strict": "strict", "lenient": "lenient", "jp": "judge_success", "jps": "judge_success and strict", "jf": "judge_success is false", "jfs": "judge_success is false and strict", "fm": "functional_match", "fms": "functional_match and strict"}.items()),
        first.alias("first"),
    )
    total = {c: F.sum(c) for c in ("n", "covered", "ok", "strict", "lenient", "jp", "jps", "jf", "jfs", "fm", "fms")}
    rate = lambda a, b: r6(F.try_divide(a, b))
    return by.agg(
        total["n"].alias("n_records"),
        total["covered"].alias("n_covered"),
        *(rate(total[a], total[b]).alias(k) for k, (a, b) in {"coverage": ("covered", "n"), "completion": ("ok", "covered"), "strict_accuracy": ("strict", "covered"), "lenient_accuracy": ("lenient", "covered"), "strict_given_judge_pass": ("jps", "jp"), "strict_given_judge_fail": ("jfs", "jf"), "strict_given_functional_match": ("fms", "fm")}.items()),
        F.count_if(F.col("covered") > 0).alias("n_unique_queries"),
        rate(F.count_if((F.col("covered") > 0) & F.col("first.strict")), F.count_if(F.col("covered") > 0)).alias("strict_unique_queries"),
    )


def selection_gain(best: DataFrame, least: int = 80) -> DataFrame:
    """What picking the best of n gains over the first sample (columns best_score,
    first_score): success shares and mean scores, and their differences in points."""
    n = F.count("*")
    a, b = F.count_if(F.col("best_score") >= least), F.count_if(F.col("first_score") >= least)
    sa, sb = F.sum("best_score"), F.sum("first_score")
    return best.agg(n.alias("n"), r6(a / n).alias("best_success"), r6(b / n).alias("first_success"), r6(100 * (a - b) / n).alias("success_gain_pts"), r6(sa / n).alias("best_mean"), r6(sb / n).alias("first_mean"), r6((sa - sb) / n).alias("score_gain_pts"))


def valid_block(compared: DataFrame, score: str = "judge_score") -> DataFrame:
    """One row: sizes, the judge's scores over all rows, structural means over valid ones."""
    valid = lambda c: r6(F.avg(F.when(F.col("valid"), F.col(c).cast("double")))).alias(c)
    return compared.agg(
        F.count("*").alias("n"),
        F.count_if("valid").alias("n_valid"),
        *map(valid, ("exact_tool_accuracy", "param_accuracy", "exact_match")),
        r6(F.avg(score)).alias("mean_judge_score"),
        F.min(score).alias("least_judge_score"),
        F.max(score).alias("most_judge_score"),
        r6(F.stddev_pop(score)).alias("judge_score_std"),
        F.count_if(F.col("gen_n_steps") == 0).alias("n_empty"),
        r6(F.avg((F.col("gen_n_steps") == F.col("gold_n_steps")).cast("int"))).alias("same_length"),
    )


def _long(one: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """``(section, name, value)`` of a table of one row; ``names`` are by column."""
    rows = (F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c, (s, n) in names.items())
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def results_block(results: DataFrame, predictions: tuple[str, ...] = ("yes", "likely_yes", "uncertain", "likely_no", "no"), least: float = 80) -> DataFrame:
    """``(section, name, value)``: a method's results as one block of statistics.

    ``results`` has the flags ``judge_success, error_type_handled, judge_full_parse,
    exact_match, functional_match, param_only_match, step_count_match``, the scores
    ``best_score, first_score, mean_score`` (of all candidates), the shares
    ``functional_tool_accuracy, param_accuracy, dependency_accuracy`` and ``prediction``.
    Sections: size, accuracy, scores, structural, tool_accuracy (a histogram, its inner
    bins closed below) and predictions (counts, and shares in percent). One aggregate
    over the rows; no rows give zero counts and null means.
    """
    mean = lambda c: F.avg(F.col(c).cast("double"))
    n = F.count("*")
    rate = lambda e: 100 * F.try_divide(F.count_if(e).cast("double"), n)
    tool = F.col("functional_tool_accuracy")
    inner = lambda lo, hi: F.count_if((tool >= lo) & (tool < hi))
    cells = {
        ("size", "n"): n,
        **{("accuracy", k): mean(c) for k, c in {"judge_success_rate": "judge_success", "error_handled_rate": "error_type_handled", "judge_full_parse_rate": "judge_full_parse"}.items()},
        ("accuracy", "first_success_rate"): F.try_divide(F.count_if(F.col("first_score") >= least).cast("double"), n),
        ("accuracy", "gain_pts"): mean("best_score") - mean("first_score"),
        ("scores", "best_mean"): mean("best_score"), ("scores", "best_median"): F.median("best_score"), ("scores", "best_std"): F.stddev_pop("best_score"),
        ("scores", "first_mean"): mean("first_score"), ("scores", "mean_of_n"): mean("mean_score"),
        ("scores", "pct_success"): rate(F.col("best_score") >= least), ("scores", "pct_full"): rate(F.col("best_score") == 100),
        **{("structural", c): mean(c) for c in ("exact_match", "functional_match", "param_only_match", "step_count_match", "functional_tool_accuracy", "param_accuracy", "dependency_accuracy")},
        ("tool_accuracy", "0.0"): F.count_if(tool == 0), ("tool_accuracy", "0-0.2"): F.count_if((tool > 0) & (tool < 0.2)), ("tool_accuracy", "0.2-0.5"): inner(0.2, 0.5),
        ("tool_accuracy", "0.5-0.8"): inner(0.5, 0.8), ("tool_accuracy", "0.8-1.0"): inner(0.8, 1.0), ("tool_accuracy", "1.0"): F.count_if(tool == 1),
        **{("predictions", p): F.count_if(F.col("prediction") == p) for p in predictions},
        **{("predictions", f"{p} %"): rate(F.col("prediction") == p) for p in predictions},
    }
    names = {f"c{i}": k for i, k in enumerate(cells)}
    one = results.agg(*(e.alias(c) for c, e in zip(names, cells.values(), strict=True)))
    return _long(one, names).select("section", "name", r6(F.col("value")).alias("value"))


def dataset_statistics(plans: DataFrame, issues: DataFrame) -> DataFrame:
    """``(section, name, value)`` of a corpus: plans by ``error_type`` and by ``prediction``,
    the mean, least, largest and upper median ``quality_score``, and ``issues`` by
    ``severity`` and ``type``. Names are those that occur; null names and scores do not count."""
    by = lambda df, c, s: df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(s).alias("section"), "name", "value")
    score = F.col("quality_score")
    one = plans.agg(F.avg(score).alias("mean"), F.min(score).alias("min"), F.max(score).alias("max"), upper_median("quality_score").alias("median"))
    scores = _long(one, {c: ("quality_scores", c) for c in one.columns}).withColumn("value", r6(F.col("value")))
    return by(plans, "error_type", "error_types").union(scores).union(by(plans, "prediction", "success_predictions")).union(by(issues, "severity", "issue_severities")).union(by(issues, "type", "issue_types"))


def failure_report(records: DataFrame, failed: Column, by: str, score: str = "judge_score", least: float = 80) -> DataFrame:
    """``(by, n_records, n_failures, judge_mean_on_failures, flag_rate_on_failures,
    judge_mean_on_non_failures)``: what a judge says of failures found without it, a row
    a method and one of null ``by`` for all. Rows whose ``failed`` is null count in
    ``n_records`` only; means over no rows are null, null scores in none."""
    rows = records.select(F.col(by).alias(by), F.col(score).cast("double").alias("s"), failed.alias("f"))
    on = lambda f: r6(F.avg(F.when(F.col("f") == f, F.col("s"))))
    flagged = r6(F.avg(F.when(F.col("f"), (F.col("s") < least).cast("int"))))
    cells = (F.count("*").alias("n_records"), F.count_if("f").alias("n_failures"), on(True).alias("judge_mean_on_failures"), flagged.alias("flag_rate_on_failures"), on(False).alias("judge_mean_on_non_failures"))
    return rows.groupBy(by).agg(*cells).where(F.col(by).isNotNull()).union(rows.select(F.lit(None).cast(rows.schema[by].dataType).alias(by), "s", "f").groupBy(by).agg(*cells))


def issue_order(issues: DataFrame, kind: str = "type") -> DataFrame:
    """``(kind, n, rank)``: issues by type, the most frequent first, ties by name."""
    counts = issues.groupBy(kind).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), kind)))  # as many rows as types


def within_failure_budget(calls: DataFrame, failed: Column, most: float = 0.05) -> DataFrame:
    """``calls`` as they are, if at most a share ``most`` of them failed; else an error."""
    n, bad = calls.agg(F.count("*"), F.count_if(failed)).first()
    if n and bad / n > most:
        raise RuntimeError(f"{bad} of {n} calls failed, over {most:.0%}")
    return calls
