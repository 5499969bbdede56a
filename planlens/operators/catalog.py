"""Tool catalogs: schemas, names and the assignment of steps to tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.functions import text


def parameters(schema: Column) -> Column:
    """Parameters of a tool from its JSON: either ``properties`` with ``required``
    (all, if it is missing) or a flat object, whose parameters are all required.
    Entries are an object with ``type`` or the type itself; no type is ``any``.
    Array of structs ``name, type, required`` in order of name; null for no object."""
    full = F.get_json_object(schema, "$.properties")
    props = F.map_entries(F.from_json(F.coalesce(full, schema), "map<string,string>"))
    listed = F.from_json(F.get_json_object(schema, "$.required"), "array<string>")
    required = lambda n: F.when(full.isNull() | listed.isNull(), True).otherwise(F.array_contains(listed, n))

    def kind(v: Column) -> Column:
        inner = F.get_json_object(F.when(v.startswith("{"), v), "$.type")
        return F.coalesce(inner, F.when(~v.startswith("{") & (v != ""), F.btrim(v, F.lit('"'))), F.lit("any"))

    return F.array_sort(F.transform(props, lambda e: F.struct(e["key"].alias("name"), kind(e["value"]).alias("type"), required(e["key"]).alias("required"))))


def made_name(name: Column) -> Column:
    """An API name for a natural one: lower case, other characters as underscores, 60 at most."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(plain == "", "unnamed_tool").otherwise(F.substring(plain, 1, 60))


def by_api_name(tools: DataFrame, key: str, name: str, order: str, api: str) -> DataFrame:
    """``(key, api)`` and the other columns of the first tool of each API name; a tool
    without one is named by its natural ``name``. A partially aggregated minimum: no
    task sorts a catalog."""
    rest = [c for c in tools.columns if c not in (key, api)]
    named = tools.withColumn(api, F.coalesce(F.when(F.col(api) != "", F.col(api)), made_name(F.col(name))))
    first = named.groupBy(key, F.col(api)).agg(F.min_by(F.struct(*rest), order).alias("t"))
    return first.select(key, api, *(F.col(f"t.{c}") for c in rest))


def remapped(rows: DataFrame, name: str, names: DataFrame, nl: str, api: str, compatible: bool = False) -> DataFrame:
    """``rows`` plus ``tier`` (exact, normalized or none) and ``api_name``: the API
    name of the equal natural name, else of one that is equal when normalised. Of
    several names the least API name stands, so that no row is multiplied."""
    key = text.normal_name(F.col(nl), compatible)
    exact = names.groupBy(F.col(nl).alias("_nl")).agg(F.min(api).alias("_exact"))
    loose = names.groupBy(key.alias("_key")).agg(F.min(api).alias("_loose"))
    out = rows.join(exact, F.col(name) == F.col("_nl"), "left").withColumn("_own", text.normal_name(F.col(name), compatible))
    out = out.join(loose, F.col("_own") == F.col("_key"), "left")
    tier = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "normalized").otherwise("none")
    return out.select(*rows.columns, tier.alias("tier"), F.coalesce("_exact", "_loose").alias("api_name"))


def remap_steps(plans: DataFrame, names: DataFrame, nl: str, api: str, key: str = "plan_id", steps: str = "steps") -> DataFrame:
    """``(key, steps, n_exact, n_normalized, n_none, n_left)``: plans with API names in
    their steps, counters by tier, and how many steps still have a sentence for a name."""
    rows = plans.select(key, F.explode(steps).alias("s")).withColumn("_name", F.col("s.tool_name"))
    done = remapped(rows, "_name", names, nl, api).withColumn("s", F.col("s").withField("tool_name", F.coalesce("api_name", "_name")))
    count = lambda t: F.count_if(F.col("tier") == t).alias(f"n_{t}")
    left = F.count_if(text.is_sentence_name(F.col("s.tool_name"))).alias("n_left")
    return done.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias(steps), *map(count, ("exact", "normalized", "none")), left)


def gold_name(name: Column, tools: Column) -> Column:
    """API name of a gold step's name among ``tools`` (array of structs ``key, api``
    in order): the equal key's, else that of the first key that contains the name
    or is contained in it; the name itself without one."""
    known = F.filter(tools, lambda t: t["api"].isNotNull() & (t["api"] != ""))
    same = F.get(F.filter(known, lambda t: t["key"] == name), F.lit(0))["api"]
    near = F.get(F.filter(known, lambda t: t["key"].contains(name) | name.contains(t["key"])), F.lit(0))["api"]
    return F.coalesce(same, near, name)


def greedy_assign(rows: DataFrame, group: str, steps: str, tools: str) -> DataFrame:
    """``(group, pos, tool)``: steps in order take the tool of the highest score,
    ties to the first; a tool is used once until all have been.

    ``steps`` is an array of score arrays (one per step, in order of tools) and
    ``tools`` the names. A query's catalog is small, so each settles in its row;
    scores are compared at nine places, as equal ones differ by rounding."""
    n = F.size(tools)
    state = F.struct(F.array().cast("array<int>").alias("picked"))

    def take(s: Column, scores: Column) -> Column:
        free = lambda i: (F.size(s["picked"]) >= n) | ~F.array_contains(s["picked"], i)
        ranked = F.transform(scores, lambda x, i: F.struct(free(i).cast("int").alias("f"), F.round(x, 9).alias("x"), (-i).alias("i")))
        return F.struct(F.concat(s["picked"], F.array(-F.array_max(ranked)["i"])).alias("picked"))

    picked = F.aggregate(F.col(steps), state, take)["picked"]
    out = rows.where(n > 0).select(group, tools, F.posexplode(picked).alias("pos", "at"))
    return out.select(group, "pos", F.get(F.col(tools), F.col("at")).alias("tool"))
