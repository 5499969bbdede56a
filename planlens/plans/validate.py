"""Static validation of plans against a tool catalog, and their dependency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, *keys: str, steps: str = "steps") -> DataFrame:
    """``keys`` and one row per step."""
    return df.select(*keys, F.explode(steps).alias("s")).select(*keys, "s.*")


#: SQL: the kind of a literal as it stands in a plan.
_KIND = """case when {0} rlike '^-?[0-9]+$' then 'integer' when {0} rlike '^-?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' then 'number'
  when {0} rlike '^(?i)(true|false)$' then 'boolean' when {0} rlike '(?s)^\\\\[.*\\\\]$' then 'array' when {0} rlike '(?s)^\\\\{{.*\\\\}}$' then 'object' else 'string' end"""
#: SQL: the references in a step's parameters.
_REFS = r"transform(flatten(transform(params, p -> regexp_extract_all(p.v, '\\{\\{(\\d+)\\}\\}', 1))), r -> cast(r as int))"


def violations(steps: DataFrame, catalog: DataFrame, key: str = "plan_id") -> DataFrame:
    """``(key, pos, kind, detail)``: unknown_tool (which ends a step's checks),
    missing_param, type_mismatch, forward_ref, nonexistent_ref.

    ``catalog`` has ``tool_name, required`` (names) and ``types`` (name to type).
    Every declared parameter is checked but texts and lists that hold a reference; objects
    are checked whatever they hold: an integer is a number
    too, ``any`` is everything; undeclared ones are not. ``steps`` has ``last_step``,
    the plan's largest step id: what lies beyond it does not exist."""
    kind = _KIND.format("trim(p.v)")
    fits = f"(types[p.k] in ({kind}, 'any') or (types[p.k] = 'number' and {kind} = 'integer'))"
    row = lambda kind, detail: f"named_struct('kind', '{kind}', 'detail', {detail})"
    found = f"""if(required is null, array({row("unknown_tool", "tool_name")}), concat(
      transform(array_except(required, params.k), x -> {row("missing_param", "x")}),
      transform(filter(params, p -> types[p.k] is not null and (p.v not like '%{{{{%' or trim(p.v) rlike '^[{{][^{{]') and not {fits}), p -> {row("type_mismatch", "p.k")}),
      transform(filter({_REFS}, r -> r >= step_id), r -> {row("forward_ref", "cast(r as string)")}),
      transform(filter({_REFS}, r -> r > last_step), r -> {row("nonexistent_ref", "cast(r as string)")})))"""
    return steps.join(catalog, "tool_name", "left").select(key, "pos", F.explode(F.expr(found)).alias("x")).select(key, "pos", "x.*")


def checked(plans: DataFrame, catalog: DataFrame, key: str = "plan_id", steps: str = "steps") -> DataFrame:
    """``(key, ok, errors)``, a row a plan: all violations as ``pos:kind:detail``,
    sorted, and ``cycle``. A plan without steps has no errors."""
    rows = plans.select(key, F.array_max(F.col(steps)["step_id"]).alias("last_step"), F.explode(steps).alias("s")).select(key, "last_step", "s.*")
    found = violations(rows, catalog, key).select(key, F.concat_ws(":", F.col("pos").cast("string"), "kind", "detail").alias("e"))
    found = found.union(cyclic(rows, key).select(key, F.lit("cycle"))).groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("errors"))
    none = F.array().cast("array<string>")
    return plans.select(key).join(found, key, "left").select(key, F.col("errors").isNull().alias("ok"), F.coalesce("errors", none).alias("errors"))


def gated(rows: DataFrame, reports: DataFrame, gold: str, key: str = "plan_id") -> DataFrame:
    """Rows whose gold plan (``gold``: its key) has no errors; rows without gold go."""
    return rows.join(reports.where("ok").select(F.col(key).alias(gold)), gold, "left_semi")


def refers(value: Column) -> Column:
    """Whether a JSON or plain text value holds a reference, at any depth."""
    return F.coalesce(value.rlike(r"\{\{\d+\}\}|\$var_?\d+\.\w+\$"), F.lit(False))


def edges(steps: DataFrame, key: str = "plan_id") -> DataFrame:
    """``(key, src, dst)``: step ``src`` refers to the output of step ``dst``."""
    refs = F.explode(F.expr(r"array_distinct(flatten(transform(params, p -> regexp_extract_all(p.v, '\\{\\{(\\d+)\\}\\}', 1))))"))
    return steps.select(key, F.col("step_id").alias("src"), refs.alias("dst")).withColumn("dst", F.col("dst").cast("int"))


def cyclic(steps: DataFrame, key: str = "plan_id") -> DataFrame:
    """Keys whose graph has a cycle. A plan's edges are few, so each plan is
    settled in its own row: nodes without open dependencies are removed until
    none are left or nothing changes; as many rounds as a plan has edges suffice."""
    graph = edges(steps, key).groupBy(key).agg(F.collect_set(F.struct("src", "dst")).alias("e"))
    pruned = F.expr(_PRUNED)
    return graph.where(F.size(pruned) > 0).select(key)


#: SQL: the edges ``e`` from which a cycle is reached.
_PRUNED = "aggregate(sequence(1, size(e)), e, (g, i) -> filter(g, x -> exists(g, y -> y.src = x.dst)))"


def first_cycles(steps: DataFrame, key: str = "plan_id") -> DataFrame:
    """``(key, start, cycle)`` of the plans that have a cycle: the first step, in
    order, from which one is reached, and the cycle that a search from there meets
    first, following references in the order in which they are written. ``cycle`` begins
    and ends with the same step id.

    Of steps with the same id the last one counts; references to no step lead nowhere.
    Edges from which no cycle is reached are pruned first, so that the search never
    turns back: it walks from step to step until one repeats, within its own row.
    """
    refs = F.expr(r"flatten(transform(params, p -> regexp_extract_all(p.v, '\\{\\{(\\d+)\\}\\}', 1)))")
    rows = steps.select(key, "pos", "step_id", F.transform(refs, lambda r: r.try_cast("int")).alias("refs"))
    last = rows.groupBy(key, "step_id").agg(F.max_by("refs", "pos").alias("refs"), F.min("pos").alias("pos"))
    plans = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "step_id", "refs"))).alias("s"))
    plans = plans.withColumn("e", F.expr("flatten(transform(s, n -> transform(n.refs, r -> named_struct('src', n.step_id, 'dst', r))))"))
    plans = plans.where("size(e) > 0").withColumn("e", F.expr(_PRUNED)).where("size(e) > 0")
    plans = plans.withColumn("start", F.expr("filter(s, n -> exists(e, x -> x.src = n.step_id))[0].step_id"))
    step = "if(array_position(p, p[size(p) - 1]) < size(p), p, array_append(p, filter(e, x -> x.src = p[size(p) - 1])[0].dst))"
    plans = plans.withColumn("path", F.expr(f"aggregate(sequence(1, size(s) + 1), array(start), (p, i) -> {step})"))
    at = "array_position(path, path[size(path) - 1])"
    return plans.select(key, "start", F.expr(f"slice(path, cast({at} as int), size(path))").alias("cycle"))
