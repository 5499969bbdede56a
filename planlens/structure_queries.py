"""Registered queries: typed values, cycles, places, names beyond ASCII, restarted streams, graphs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planlens.functions import literals, text
from planlens.operators import graph, search
from planlens.operators.metrics import r6
from planlens.plans import corpus, parse, render, validate
from planlens.queries import _STEPS
from planlens.registry import query
from planlens.sources import io
from planlens.sources.scratch import keep, scratch
from planlens.streaming import running, stateful

# -- typed values ------------------------------------------------------------------

_NAME = "replace(p_name, '''', '')"


def _literals(spark, sf_dir) -> DataFrame:
    """Python literals from the parts: nested, with tuples, signs, escapes, None, and some that are none."""
    p = corpus.spread(corpus.table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit("'"), F.lit("")).alias("name"), F.col("p_size").cast("int").alias("size")))
    nested = F.concat(F.lit("{'n': ("), F.col("p_partkey").cast("string"), F.lit(", -"), F.col("size").cast("string"), F.lit(".5e1,), \"it's\": ['"), "name", F.lit("' '\\n\\x41', None], 7: {'deep': [[], {}, (True)]}, }"))
    broken = F.concat(F.lit("['"), "name", F.lit("', "), F.col("size").cast("string"))
    return p.withColumn("code", F.when(F.col("p_partkey") % 5 == 0, broken).when(F.col("p_partkey") % 5 == 1, F.concat("size", F.lit(", "), F.lit("0x1F, .25"))).otherwise(nested))


@query(f"""select p_partkey, case when p_partkey % 5 = 0 then null when p_partkey % 5 = 1 then 'array' else 'object' end as kind,
  case when p_partkey % 5 > 1 then p_partkey::bigint end as first, case when p_partkey % 5 > 1 then -10.0 * p_size - 5 when p_partkey % 5 = 1 then 0.25 end::double as second,
  case when p_partkey % 5 > 1 then {_NAME} || chr(10) || 'A' end as words, case when p_partkey % 5 > 1 then true end as deep from part""")
def literal_values(spark, sf_dir):
    """Literals as VARIANT: what stands at paths of each, null where the text is no literal."""
    v = _literals(spark, sf_dir).select("p_partkey", literals.literal(F.col("code")).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    kind = F.when(F.schema_of_variant("v").startswith("ARRAY"), "array").when(F.col("v").isNotNull(), "object")
    return v.select("p_partkey", kind.alias("kind"), get("$.n[0]", "bigint").alias("first"), F.coalesce(get("$.n[1]", "double"), get("$[2]", "double")).alias("second"), get('$["it\'s"][0]', "string").alias("words"), get("$['7'].deep[2]", "boolean").alias("deep"))


@query(f"""select p_partkey, case when p_partkey % 5 = 0 then null when p_partkey % 5 = 1 then '[' || p_size || ', 31, 0.25]'
  else '{{''n'': [' || p_partkey || ', -' || (p_size * 10 + 5) || '.0], "it''s": [''' || {_NAME} || '\\nA'', None], ''7'': {{''deep'': [[], {{}}, True]}}}}' end as printed from part""")
def literal_roundtrip(spark, sf_dir):
    """Literals read and printed again as Python prints them; tuples come back as lists."""
    p = _literals(spark, sf_dir)
    return p.select("p_partkey", literals.python_repr(literals.json_of_literal(F.col("code"))).alias("printed"))


@query(f"""with {_STEPS} select plan_id, md5(string_agg('Step ' || pos || ': {{{{' || pos || '}}}} = ' || tool_name || '(a=''{{{{' || pos || '}}}}'', b=[' || qty || ', ' || qty || '.5, ''' || flag || '''], c={{''k'': ' || case when qty % 2 = 0 then 'True' else 'None' end || '}}, d="' || status || '''s")', chr(10) order by pos)) as text_md5
  from v_steps group by plan_id""")
def typed_plan_strings(spark, sf_dir):
    """Plan text of typed parameters, as Python prints them."""
    s = corpus.raw_steps(spark, sf_dir)
    ref = F.concat(F.lit("{{"), F.col("pos").cast("string"), F.lit("}}"))
    param = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    value = lambda c: F.replace(F.replace(F.to_json(F.array(c)), F.lit("["), F.lit("")), F.lit("]"), F.lit(""))
    mixed = F.concat(F.lit("["), F.col("qty").cast("string"), F.lit(","), (F.col("qty") + 0.5).cast("string"), F.lit(","), value(F.col("flag")), F.lit("]"))
    typed = F.to_json(F.to_variant_object(F.struct(F.when(F.col("qty") % 2 == 0, True).alias("k"))))
    params = F.array(param("a", value(ref)), param("b", F.to_json(F.parse_json(mixed))), param("c", typed), param("d", value(F.concat("status", F.lit("'s")))))
    step = F.struct("pos", F.col("pos").alias("step_id"), ref.alias("output_variable"), "tool_name", params.alias("params"))
    steps = s.groupBy("plan_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return steps.select("plan_id", F.md5(render.typed_plan_string(F.col("steps")).cast("binary")).alias("text_md5"))


# -- cycles, places, names ------------------------------------------------------------

_REFS = """refs as (select plan_id, pos, unnest(case plan_id % 5 when 0 then case when pos > 0 then [pos - 1, 99] else [99] end when 1 then case when pos = n - 1 then [0, pos] else [pos + 1, 0] end
    when 2 then [(pos + 1) % n] when 3 then [case when pos % 2 = 0 then pos + 1 else pos - 1 end, pos] else case when pos = 1 then [3] when pos = 3 then [2, 1] when pos = 2 then [99] else [1] end end) as dst,
    generate_subscripts([1, 2], 1) as o from (select plan_id, pos, count(*) over (partition by plan_id) as n from v_steps))"""


@query(f"""with recursive {_STEPS}, {_REFS},
  e as (select r.plan_id, r.pos, r.dst, r.o from refs r join v_steps s on s.plan_id = r.plan_id and s.pos = r.dst),
  reach as (select plan_id, pos as a, dst as b from e union select r.plan_id, r.a, e.dst from reach r join e on e.plan_id = r.plan_id and e.pos = r.b),
  looped as (select distinct r.plan_id, r.a from reach r join reach c on c.plan_id = r.plan_id and c.a = c.b and (r.b = c.a)),
  next as (select e.plan_id, e.pos, e.dst from e join looped l on l.plan_id = e.plan_id and l.a = e.dst qualify row_number() over (partition by e.plan_id, e.pos order by e.o) = 1),
  walk as (select plan_id, min(a) as start, [min(a)] as path from looped group by plan_id
    union all select w.plan_id, w.start, list_append(w.path, n.dst) from walk w join next n on n.plan_id = w.plan_id and n.pos = w.path[len(w.path)] where list_position(w.path, w.path[len(w.path)]) = len(w.path))
  select plan_id, start, array_to_string(path[list_position(path, path[len(path)]):], '>') as cycle from walk where list_position(path, path[len(path)]) < len(path)""")
def first_cycles(spark, sf_dir):
    """Which cycle: plans of chains, self-loops, long cycles, pairs and cycles behind a step."""
    s = corpus.raw_steps(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("plan_id")))
    ref = lambda c: F.concat(F.lit("x={{"), c.cast("string"), F.lit("}}"))
    pos, n = F.col("pos"), F.col("n")
    kind = F.col("plan_id") % 5
    nowhere = F.lit("y={{99}}")
    args = (
        F.when(kind == 0, F.when(pos > 0, F.concat_ws(", ", ref(pos - 1), nowhere)).otherwise(nowhere))
        .when(kind == 1, F.when(pos == n - 1, F.concat(F.lit("x={{0}}, y={{"), pos.cast("string"), F.lit("}}"))).otherwise(F.concat(ref(pos + 1), F.lit(", y={{0}}"))))
        .when(kind == 2, ref((pos + 1) % n))
        .when(kind == 3, F.concat(ref(F.when(pos % 2 == 0, pos + 1).otherwise(pos - 1)), F.lit(", y={{"), pos.cast("string"), F.lit("}}")))
        .otherwise(F.when(pos == 1, "x={{3}}").when(pos == 3, "x=[{{2}}, {{1}}]").when(pos == 2, nowhere).otherwise("x={{1}}"))
    )
    line = F.concat(F.lit("Step "), pos.cast("string"), F.lit(": {{"), pos.cast("string"), F.lit("}} = "), "tool_name", F.lit("("), args, F.lit(")"))
    texts = s.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l")).select("plan_id", F.array_join("l.line", "\n").alias("plan_text"))
    found = validate.first_cycles(validate.exploded(parse.once(texts, "steps", parse.parse_plan("plan_text")), "plan_id"))
    return found.select("plan_id", "start", F.array_join(F.transform("cycle", lambda c: c.cast("string")), ">").alias("cycle"))


@query("""with o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as place from orders), c as (select c_custkey, row_number() over (order by c_custkey) - 1 as place from customer)
  select place, o_orderkey::bigint as o_orderkey, c_custkey::bigint as c_custkey from o full join c using (place)""")
def positional_join(spark, sf_dir):
    """Two folders cut into different numbers of files, joined by place; no ordinal is stored."""
    left, right = scratch(spark, "left"), scratch(spark, "right")
    corpus.table(spark, sf_dir, "orders").select("o_orderkey").repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(left)
    corpus.table(spark, sf_dir, "customer").select("c_custkey").repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").write.parquet(right)
    out = io.join_by_place(spark, left, right, "full")
    return out.select("place", F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("c_custkey").cast("bigint").alias("c_custkey"))


@query("select p_partkey, case when p_partkey % 2 = 0 then lower(p_name) || ' fi 2 caf' || chr(233) else lower(p_name) || ' ' || chr(233) || ' kg 123' end as name from part")
def compatible_names(spark, sf_dir):
    """Names in Unicode's compatible form: full width, a ligature, a circled digit, a mark of its own; no Python."""
    p = corpus.table(spark, sf_dir, "part")
    wide = F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    odd = F.when(F.col("p_partkey") % 2 == 0, F.concat(wide, F.lit(" \ufb01 \u2461 CAFE\u0301\uff1f"))).otherwise(F.concat(F.lit(" "), wide, F.lit(" \u00c9 \u338f \uff11\uff12\uff13!. ")))
    return p.select("p_partkey", text.normal_name(odd, True).alias("name"))


# -- streams and graphs ----------------------------------------------------------------


@query("""with e as (select event_id, user_id, row_number() over w as i, avg(value) over (w rows between 9 preceding and current row) as mean,
    max(value) over (w rows between 4 preceding and current row) as recent, max(value) over (w rows between unbounded preceding and 5 preceding) as base from events window w as (partition by user_id order by ts, event_id)),
  s as (select user_id, min(i) as stop_at from e where base is not null and recent - base < 0.5 group by user_id)
  select event_id, i as n, round(mean, 6) as last10, coalesce(i >= stop_at, false) as stop from e left join s using (user_id)""")
def stream_restarted(spark, sf_dir):
    """Running means and early stops by micro-batches: half of the events, then a new query
    that goes on from the checkpoint with the rest."""
    source, sink, checkpoint = (scratch(spark, n) for n in ("events", "sink", "checkpoint"))
    parts = stateful.waves(corpus.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "ts", 4)
    for half in (parts[:2], parts[2:]):
        for part in half:  # a part follows the one before, as files by their time
            part.repartition(3).write.mode("append").parquet(source)
        stream = running.read_stream(spark, source, "event_id bigint, user_id bigint, ts timestamp_ntz, value double", 3)
        stateful.run_batches(stateful.running(stream, "user_id", ["ts", "event_id"], "value"), sink, checkpoint)
    return stateful.read_batches(spark, sink).select("event_id", "n", r6(F.col("mean")).alias("last10"), "stop")


_EDGES = """uses as (select distinct l_orderkey as g, l_partkey as item from lineitem), chain as (select lag(item) over (partition by g order by item) as src, item as dst from uses),
  once as (select src, dst, count(*) as weight from chain where src is not null group by all), edges as (select * from once union all select dst, src, weight from once),
  own as (select i, j, sin(i * 8 + j) as w from range(64) a(i), range(8) b(j)), others as (select i, j, cos(i + j * 3) as w from range(64) a(i), range(8) b(j)),
  own2 as (select i, j, sin(i + j) as w from range(8) a(i), range(4) b(j)), others2 as (select i, j, cos(i * j) as w from range(8) a(i), range(4) b(j)),
  v as (select vec_id as id, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings)"""


def _layer_sql(name: str, rows: str, own: str, others: str, relu: bool) -> str:
    total = "greatest(sum(x), 0)" if relu else "sum(x)"
    return f"""{name}_m as (select dst as id, i, sum(weight * x) / sum(weight) as x from edges join {rows} r on r.id = src group by dst, i),
  {name} as (select id, i, {total} as x from (select id, j as i, x * w as x from {rows} join {own} using (i) union all select id, j, x * w from {name}_m join {others} using (i)) group by id, i)"""


_TWO_LAYERS = f"with {_EDGES}, {_layer_sql('h', 'v', 'own', 'others', True)}, {_layer_sql('z', 'h', 'own2', 'others2', False)}, unit as (select id, i, coalesce(x / nullif(sqrt(sum(x * x) over (partition by id)), 0), x) as x from z)"


def _matrix(n, m, f):
    return [[f(i, j) for j in range(m)] for i in range(n)]


def _two_layers(spark, sf_dir, known: bool = False) -> DataFrame:
    """``(id, v)``; with ``known`` only of nodes that have a vector of their own."""
    uses = corpus.table(spark, sf_dir, "lineitem")
    parts = graph.parts_for(uses.count())
    linked = graph.links(uses, "l_partkey", "l_orderkey", parts)
    v = corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    h = graph.link_layer(v, linked, parts, _matrix(64, 8, lambda i, j: math.sin(i * 8 + j)), _matrix(64, 8, lambda i, j: math.cos(i + j * 3)))
    z = graph.link_layer(h, linked, parts, _matrix(8, 4, lambda i, j: math.sin(i + j)), _matrix(8, 4, lambda i, j: math.cos(i * j)), relu=False, among="known" if known else None)
    return z.select("id", graph.unit(F.col("v")).alias("v"))


@query(f"{_TWO_LAYERS} select id, round(max(case when i = 0 then x end), 6) as x0, round(max(case when i = 3 then x end), 6) as x3, count(*) as n from unit group by id")
def message_passing(spark, sf_dir):
    """Two layers over vectors, whose edges are parts of orders used one after the other."""
    v = _two_layers(spark, sf_dir)
    return v.select("id", r6(F.col("v")[0]).alias("x0"), r6(F.col("v")[3]).alias("x3"), F.size("v").cast("bigint").alias("n"))


@query(f"""{_TWO_LAYERS}, t as (select a.vec_id as triplet, a.vec_id as anchor, min(b.vec_id) as positive, min(c.vec_id) as negative from embeddings a join embeddings b on b.label = a.label and b.vec_id > a.vec_id join embeddings c on c.label = (a.label + 1) % 10 and c.vec_id > a.vec_id group by a.vec_id)
  select triplet, round(-ln(1 / (1 + exp(-sum(a.x * (p.x - n.x)))) + 1e-8), 6) as loss from t join unit a on a.id = anchor join unit p on p.id = positive and p.i = a.i join unit n on n.id = negative and n.i = a.i group by triplet""")
def triplet_loss(spark, sf_dir):
    """The ranking loss of triplets: the next row of a row's label against the next one of another."""
    e = corpus.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    points = e.select(F.col("label").alias("key"), F.col("vec_id").alias("at"))
    asked = lambda key, as_: e.select(key.alias("key"), F.col("vec_id").alias("at"), F.struct("vec_id", "label").alias("row"), F.lit(as_).alias("as"))
    found = graph.following(points, asked(F.col("label"), "positive").union(asked((F.col("label") + 1) % 10, "negative")))
    both = found.groupBy("row").agg(*[F.min(F.when(F.col("as") == c, F.col("next"))).alias(c) for c in ("positive", "negative")]).where("positive is not null and negative is not null")
    triplets = both.groupBy(F.col("row.vec_id").alias("triplet")).agg(F.min("positive").alias("positive"), F.min("negative").alias("negative")).withColumn("anchor", F.col("triplet"))
    rows = keep(graph.long(_two_layers(spark, sf_dir, known=True), "id", "v"), "layers")
    return graph.ranking_loss(triplets, rows).select("triplet", r6(F.col("loss")).alias("loss"))


_CANDIDATES = """cand as (select o_orderkey // 10 as query_id, 0 as node, null::int as parent, 1.0::double as prior, 0.5::double as reward from orders where o_orderkey % 10 = 0
    union all select o_orderkey // 10, (o_orderkey % 10 + 1)::int, 0, ((o_orderkey * 7 % 13) / 20)::double, ((floor(o_totalprice)::bigint % 21) / 20)::double from orders
    union all select o_orderkey // 10, ((o_orderkey % 10 + 1) * 100 + l_linenumber)::int, (o_orderkey % 10 + 1)::int, (min(l_partkey) % 11 / 10)::double, (min(l_suppkey) % 17 / 16)::double from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, l_linenumber),
  t0 as materialized (select *, 0::bigint as visits, 0.0::double as q from cand where parent is null)"""
_ROUNDS, _DEPTH = 4, 2


def _round_sql(r: int) -> str:
    ways = [f"w{r}_0 as (select query_id, node as at, visits as above, [node] as path from t{r} where parent is null)"]
    ways += [
        f"""w{r}_{d + 1} as materialized (select w.query_id, coalesce(k.node, w.at) as at, coalesce(k.visits, w.above) as above, case when k.node is null then path else list_append(path, k.node) end as path
    from w{r}_{d} w left join t{r} k on k.query_id = w.query_id and k.parent = w.at
    qualify row_number() over (partition by w.query_id order by -(k.q + greatest(k.prior, 1e-6) * sqrt(ln(greatest(w.above, 1) + 1)) / (1 + k.visits)), k.node) = 1)"""
        for d in range(_DEPTH)
    ]
    grown = f"""t{r + 1} as materialized (select t.query_id, t.node, t.parent, t.prior, t.reward, t.visits + (c.node is not null)::int as visits, case when c.node is null then t.q else t.q + (c.reward - t.q) / (t.visits + 1) end as q
    from t{r} t left join w{r}_{_DEPTH} w on w.query_id = t.query_id and list_contains(w.path, t.node) left join cand c on c.query_id = w.query_id and c.node = w.at
    union all select c.*, 0, 0.0 from cand c join w{r}_{_DEPTH} w on w.query_id = c.query_id and w.at = c.parent)"""
    return ", ".join([*ways, grown])


@query(f"with {_CANDIDATES}, {', '.join(map(_round_sql, range(_ROUNDS)))} select query_id, node, visits, round(q, 6) as q from t{_ROUNDS}")
def tree_rounds(spark, sf_dir):
    """Rounds of tree search for every query at once: its orders are the root's children, their lines the leaves."""
    o = corpus.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.expr("o_orderkey div 10").alias("query_id"), (F.col("o_orderkey") % 10 + 1).cast("int").alias("slot"))
    lines = corpus.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    named = lambda df, node, parent, prior, reward: df.select("query_id", node.cast("int").alias("node"), parent.cast("int").alias("parent"), prior.cast("double").alias("prior"), reward.cast("double").alias("reward"))
    roots = named(o.where("slot = 1"), F.lit(0), F.lit(None), F.lit(1.0), F.lit(0.5))
    first = named(o, F.col("slot"), F.lit(0), F.col("o_orderkey") * 7 % 13 / 20, F.floor("o_totalprice") % 21 / 20)
    second = named(o.join(lines, "o_orderkey"), F.col("slot") * 100 + F.col("l_linenumber"), F.col("slot"), F.col("part") % 11 / 10, F.col("supp") % 17 / 16)
    grown = search.grow(roots.union(first).union(second), "query_id", _ROUNDS, _DEPTH)
    return grown.select("query_id", "node", "visits", r6(F.col("q")).alias("q"))
