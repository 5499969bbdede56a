"""Structural comparison of a generated plan with its gold plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .parse import once
from .schema import STOP_WORDS

_STOP = "array(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def normal(v: str) -> str:
    """SQL: trimmed, without quotes at the ends, lower case, single spaces."""
    return rf"regexp_replace(lower(btrim(btrim(btrim({v}), '\"\'' ))), '\\s+', ' ')"


def keywords(v: str) -> str:
    return rf"array_distinct(filter(split(btrim(regexp_replace(lower({v}), '[^a-z0-9\\s]', ' ')), '\\s+'), w -> length(w) > 2 and not array_contains({_STOP}, w)))"


def functional(a: str, b: str) -> str:
    """SQL: Jaccard of keywords to three places; 0 if either has none."""
    # a one-element transform names both sets, so that each is made once
    return f"transform(array(named_struct('a', {keywords(a)}, 'b', {keywords(b)})), w -> if(size(w.a) = 0 or size(w.b) = 0, 0.0D, round(size(array_intersect(w.a, w.b)) / cast(size(array_union(w.a, w.b)) as double), 3)))[0]"


def refs(p: str) -> str:
    return rf"array_distinct(flatten(transform(filter({p}, x -> contains(x.v, '{{{{')), x -> regexp_extract_all(x.v, '(\\{{\\{{\\d+\\}}\\}})', 1))))"


def compare(df: DataFrame, gen: str = "steps", gold: str = "gold_steps", empty_dependency: float = 0.0) -> DataFrame:
    """``df`` plus the structural metrics of array ``gen`` against array ``gold``.

    Steps align by position. Counts are summed before they are divided, so the
    ratios do not depend on an order of summing. An empty side gives zeros and
    ``valid`` false; its dependency accuracy is ``empty_dependency``.
    """
    zipped = f"filter(arrays_zip({gen}, {gold}), z -> z.{gen} is not null and z.{gold} is not null)"
    z = f"transform({zipped}, z -> named_struct('a', z.{gen}, 'b', z.{gold}))"
    # the first parameter of the same name holds or is held; equal ones need no cleaning
    va, vb = normal("q.v"), normal("p.v")
    alike = f"q.v = p.v or exists(array(named_struct('a', {va}, 'b', {vb})), w -> contains(w.a, w.b) or contains(w.b, w.a))"
    shared = f"filter(z.b.params, p -> exists(slice(filter(z.a.params, q -> q.k = p.k), 1, 1), q -> {alike}))"
    refers = f"transform(array(named_struct('a', {refs('z.a.params')}, 'b', {refs('z.b.params')})), r -> named_struct('all', size(r.b), 'right', size(array_intersect(r.b, r.a))))[0]"
    per = f"""transform(transform({z}, z -> named_struct('a', z.a, 'b', z.b, 'r', {refers})), z -> named_struct(
        'tool', cast(lower(btrim(z.a.tool_name)) = lower(btrim(z.b.tool_name)) as int),
        'func', {functional("z.a.tool_name", "z.b.tool_name")},
        'keys', size(z.b.params), 'right', size({shared}),
        'deps', z.r.all, 'deps_right', z.r.right))"""
    out = once(df, "_per", F.expr(per)).withColumn("_ok", F.expr(f"size({gen}) > 0 and size({gold}) > 0"))
    total = lambda f, kind="bigint": f"aggregate(_per, cast(0 as {kind}), (a, x) -> a + x.{f})"
    gate = lambda e, other="0.0D": F.expr(f"if(_ok, {e}, {other})")
    out = (
        out.withColumn("gen_n_steps", F.size(gen))
        .withColumn("gold_n_steps", F.size(gold))
        .withColumn("valid", F.col("_ok"))
        .withColumn("step_count_match", F.expr(f"_ok and size({gen}) = size({gold})"))
        .withColumn("exact_tool_accuracy", gate(f"{total('tool')} / cast(size({gold}) as double)"))
        .withColumn("functional_tool_accuracy", gate(f"{total('func', 'double')} / size({gold})"))
        .withColumn("param_accuracy", gate(f"coalesce(try_divide(cast({total('right')} as double), {total('keys')}), 0.0D)"))
        .withColumn("dependency_accuracy", gate(f"coalesce(try_divide(cast({total('deps_right')} as double), {total('deps')}), 1.0D)", f"{empty_dependency}D"))
    )
    return (
        out.withColumn("exact_match", F.expr("step_count_match and exact_tool_accuracy = 1 and param_accuracy = 1"))
        .withColumn("functional_match", F.expr("step_count_match and functional_tool_accuracy >= 0.5 and param_accuracy >= 0.5"))
        .withColumn("param_only_match", F.expr("_ok and param_accuracy >= 0.5"))
        .drop("_per", "_ok")
    )


def compare_counts(df: DataFrame, gen: str = "steps", gold: str = "gold_steps") -> DataFrame:
    """``df`` plus the plainer comparison of fine-tuned planners: ``valid``, ``error``
    (null if valid), ``step_count_match``, counts and shares of right tools and parameters,
    and ``exact_match``, which a plan without parameters never reaches.

    Steps align by position; tools are equal but for case and space; a value is right if
    it holds the gold one or is held by it, once quotes at the ends, case and runs of space are gone.
    """
    bare = lambda v: rf"regexp_replace(lower(btrim(btrim(btrim({v}), '\"'), '\'')), '\\s+', ' ')"
    flat = lambda v: f"btrim({bare(v)})"
    pairs = f"filter(arrays_zip({gen}, {gold}), z -> z.{gen} is not null and z.{gold} is not null)"
    z = f"transform({pairs}, z -> named_struct('a', z.{gen}, 'b', z.{gold}))"
    right = f"filter(z.b.params, p -> exists(z.a.params, q -> q.k = p.k and exists(array(named_struct('x', {flat('q.v')}, 'y', {flat('p.v')})), w -> contains(w.x, w.y) or contains(w.y, w.x))))"
    per = f"transform({z}, z -> named_struct('tool', cast(lower(btrim(z.a.tool_name)) = lower(btrim(z.b.tool_name)) as int), 'all', size(z.b.params), 'right', size({right})))"
    out = once(df, "_per", F.expr(per)).withColumn("valid", F.expr(f"size({gen}) > 0 and size({gold}) > 0"))
    total = lambda f: F.expr(f"if(valid, aggregate(_per, 0L, (a, x) -> a + x.{f}), 0L)")
    out = out.withColumns({"correct_tools": total("tool"), "total_params": total("all"), "correct_params": total("right")})
    out = out.withColumns({
        "error": F.expr(f"case when size({gen}) = 0 then 'No steps generated' when size({gold}) = 0 then 'No ground truth steps' end"),
        "step_count_match": F.expr(f"valid and size({gen}) = size({gold})"),
        "tool_accuracy": F.expr(f"if(valid, correct_tools / size({gold}), 0.0D)"),
        "param_accuracy": F.expr("coalesce(try_divide(correct_params, total_params), 0.0D)"),
    })
    return out.withColumn("exact_match", F.expr("step_count_match and tool_accuracy = 1 and param_accuracy = 1")).drop("_per")


def step_details(df: DataFrame, gen: str = "steps", gold: str = "gold_steps", *keys: str) -> DataFrame:
    """One row per aligned position with the sorted missing, extra and incorrect
    parameters; incorrect are those of both sides of which neither value holds the other."""
    n = f"greatest(size({gen}), size({gold}))"
    rows = df.where(f"{n} > 0").select(*keys, gen, gold, F.explode(F.expr(f"sequence(0, {n} - 1)")).alias("pos"))
    rows = rows.select(*keys, "pos", F.expr(f"get({gen}, pos)").alias("a"), F.expr(f"get({gold}, pos)").alias("b"))
    va, vb = normal("p.v"), normal("get(filter(b.params, q -> q.k = p.k), 0).v")
    apart = f"not exists(array(named_struct('a', {va}, 'b', {vb})), w -> contains(w.a, w.b) or contains(w.b, w.a))"
    wrong = f"if(a is null or b is null, null, array_join(array_sort(transform(filter(a.params, p -> exists(b.params, q -> q.k = p.k) and {apart}), p -> p.k)), ','))"
    diff = lambda x, y: F.expr(f"if(a is null or b is null, null, array_join(array_sort(array_except({x}.params.k, {y}.params.k)), ','))")
    return rows.select(*keys, "pos", F.expr("coalesce(lower(btrim(a.tool_name)) = lower(btrim(b.tool_name)), false)").alias("exact_tool_correct"), diff("b", "a").alias("missing"), diff("a", "b").alias("extra"), F.expr(wrong).alias("incorrect"))


def with_gold(df: DataFrame, last: bool = False) -> DataFrame:
    """Join each plan to its query's perfect plan (the first by slot, or the
    last), falling back to its own steps where the query has none."""
    perfect = F.expr("query_id is not null and error_type = 'none' and size(steps) > 0")
    pick = F.max_by if last else F.min_by
    # over a window, as a join with the table itself would make and parse it twice
    first = lambda c: pick(F.when(perfect, F.col(c)), F.when(perfect, F.col("slot"))).over(Window.partitionBy("query_id"))
    out = df.select("query_id", *(c for c in df.columns if c != "query_id"), first("steps").alias("perfect_steps"), first("plan_text").alias("perfect_text"))
    return out.withColumn("gold_steps", F.coalesce("perfect_steps", "steps")).withColumn("gold_text", F.coalesce("perfect_text", "plan_text"))
