"""Registered queries: extraction, rendering, catalogs, grounded runs, search, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlens.operators import catalog, execute, metrics, report, score, select
from planlens.operators.metrics import r6
from planlens.plans import corpus, extract, inject, parse, render, validate
from planlens.plans.schema import ERROR_TYPES
from planlens.queries import _PLANS, _STEPS, _VIOL, steps_of
from planlens.registry import query

_TEXT_MD5 = f"with {_PLANS} select plan_id, md5(plan_text) as text_md5 from v_plans where plan_text <> ''"


def md5(c):
    return F.md5(c.cast("binary"))


def texts(spark, sf_dir):
    return corpus.plans(spark, sf_dir).where("plan_text <> ''").select("plan_id", "plan_text")


# -- extraction -----------------------------------------------------------------


@query(_TEXT_MD5)
def react_extract(spark, sf_dir):
    """Steps between thoughts, behind ``Action:`` in two spellings."""
    noisy = F.array_join(F.transform(F.split("plan_text", "\n"), lambda x, i: F.concat(F.lit("Thought: what next?\n"), F.when(i % 2 == 0, "Action: ").otherwise("  ACTION:  "), x)), "\n")
    return texts(spark, sf_dir).select("plan_id", md5(extract.react_plan(noisy)).alias("text_md5"))


@query(_TEXT_MD5)
def step_lines_only(spark, sf_dir):
    noisy = F.concat(F.lit("Plan:\n\n"), F.replace("plan_text", F.lit("\n"), F.lit("  \n- note\n ")), F.lit("\nDone."))
    return texts(spark, sf_dir).select("plan_id", md5(extract.step_lines(noisy)).alias("text_md5"))


@query(_TEXT_MD5)
def step_assign(spark, sf_dir):
    """Lines without ``{{N}} =`` get it back."""
    bare = F.transform(F.split("plan_text", "\n"), lambda x: F.regexp_replace(x, r"\{\{\d+\}\} = ", ""))
    return texts(spark, sf_dir).select("plan_id", md5(F.array_join(F.transform(bare, extract.assign), "\n")).alias("text_md5"))


@query(f"with {_STEPS} select plan_id, count(*)::int as n_mixed, ((count(*) + 1) // 2)::int as n_strict, string_agg('{{{{' || pos || '}}}}', ',' order by pos) as variables from v_steps group by plan_id")
def plan_parse_mixed(spark, sf_dir):
    """Every second line lacks its assignment: strict parsing loses it, the mixed dialect does not."""
    half = F.array_join(F.transform(F.split("plan_text", "\n"), lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, r"\{\{\d+\}\} = ", "")).otherwise(x)), "\n")
    t = parse.once(texts(spark, sf_dir).select("plan_id", half.alias("t")), "m", parse.parse_plan("t", "mixed"))
    return t.select("plan_id", F.size("m").alias("n_mixed"), F.size(parse.parse_plan("t")).alias("n_strict"), F.array_join("m.output_variable", ",").alias("variables"))


@query(f"with {_STEPS} select plan_id, pos, case when pos % 4 = 3 then null else 'Step ' || pos || ': {{{{' || pos || '}}}} = ' || tool_name || '(arg_0=' || qty || ')' end as line from v_steps")
def first_step_forms(spark, sf_dir):
    """A canonical step, one with a named variable, one without, and none."""
    s = corpus.raw_steps(spark, sf_dir)
    call = F.concat("tool_name", F.lit("(arg_0="), "qty", F.lit(")"))
    form = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("{{"), "pos", F.lit("}} = "), call)).when(F.col("pos") % 4 == 1, F.concat(F.lit("out = "), call)).when(F.col("pos") % 4 == 2, call).otherwise(F.lit("no call"))
    return s.select("plan_id", "pos", extract.first_step(F.concat(F.lit("Let me think.\n  Step "), "pos", F.lit(": "), form, F.lit("  \nStep 9: {{9}} = later)"))).alias("line"))


@query("select event_id, case when event_id % 4 = 0 then 'caller' else ['caller', 'conclusion', 'give up', 'caller', 'give up', 'conclusion'][(event_id % 6)::int + 1] end as decision from events")
def planner_decision(spark, sf_dir):
    said = ["Thought\nNext: caller", "Next: caller\nNext: conclusion", "**Next: give up**", "no decision", "  next: giveup, then conclusion", "Next: conclusion, not give up\n"]
    e = corpus.table(spark, sf_dir, "events").select("event_id")
    text = F.element_at(F.array(*map(F.lit, said)), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", extract.decision(text, F.col("event_id") % 4).alias("decision"))


@query("""select p_partkey, case p_partkey % 5 when 0 then 'COMPLETE' when 2 then 'Step 0: {{0}} = a' || p_partkey || '(x=1)' else 'Step 0: {{0}} = a' || p_partkey || '(x=1)|Step 0: {{0}} = b' || p_partkey || '(y=2)' end as candidates from part""")
def candidate_list(spark, sf_dir):
    """Marked candidates with repeats, a call made before and a broken one; unmarked ones; too many; COMPLETE."""
    k = F.col("p_partkey").cast("string")
    a, a2, b, c = (F.concat(F.lit(x), k, F.lit(y)) for x, y in (("Step 0: {{0}} = a", "(x=1)"), ("Step 0: A", "(x=1)"), ("Step 0: v = b", "(y=2)"), ("Step 0: c", "(z=3)")))
    marked = F.concat(F.lit("Ideas\nCandidate 1: "), a, F.lit("\nCandidate 2: "), a2, F.lit("\nCandidate 3: "), b, F.lit("\nCandidate 4: broken\nCandidate 5: "), c)
    mod = F.col("p_partkey") % 5
    text = F.when(mod == 0, F.concat(marked, F.lit("\n candidate 6:complete"))).when(mod == 1, F.concat_ws("\n", a, a2, b, c)).otherwise(marked)
    prior = F.array(F.concat(F.lit("Step 7: {{7}} = C"), k, F.lit("(z=3)")))
    p = corpus.table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), prior.alias("prior"), F.when(mod == 2, 1).otherwise(3).alias("n"))
    found = F.slice(extract.candidates(F.col("text"), 3, F.col("prior")), F.lit(1), F.col("n"))
    return p.select("p_partkey", F.array_join(found, "|").alias("candidates"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'Step 2: {{2}} = ' || replace(p_name, ' ', '_') || '(a=1, b=(2))' when 1 then 'Step 2: {{2}} = ' || replace(p_name, ' ', '_') || '(tool a=1)' end as line from part")
def step_repair(spark, sf_dir):
    broken = F.element_at(F.array(*map(F.lit, ["Stp wrong ( a=1, b=(2) ) ", "Step 3: tool a=1", "nothing", "Step 3: tool"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = corpus.table(spark, sf_dir, "part")
    return p.select("p_partkey", extract.repair(broken, F.lit(2), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("line"))


@query("select p_partkey, '{{0}} and f({{1}},{{0}}) of ' || p_partkey || ' but $var_9.x$' as value from part")
def label_refs(spark, sf_dir):
    value = F.concat(F.lit("$var_1.result$ and f($var2.out$,$var1.a$) of "), "p_partkey", F.lit(" but $var_9.x$"))
    return corpus.table(spark, sf_dir, "part").select("p_partkey", extract.label_refs(value, F.array(F.lit("$var_1"), F.lit("$var_2"))).alias("value"))


@query("""select event_id, [100, 0, 50, 50, 77][m + 1] as quality_score, ['yes', 'uncertain', 'likely_no', 'uncertain', 'no'][m + 1] as success_prediction, [1.0, 0.5, 0.05, 0.5, 0.2][m + 1]::double as confidence, m = 4 as rescued from (select event_id, (event_id % 5)::int as m from events)""")
def annotation_normalise(spark, sf_dir):
    m = (F.col("event_id") % 5 + 1).cast("int")
    pick = lambda xs: F.element_at(F.array(*(F.lit(x).cast("string") for x in xs)), m)
    a = extract.annotation(pick(["120", "-3", "abc", None, "50"]), pick(["yes", "maybe", "likely_no", None, "no"]), pick(["1.5", "x", "0.05", None, "0.1"]), pick([None, None, "score 5", "", '{"quality_score": 77, cut']))
    return corpus.table(spark, sf_dir, "events").select("event_id", a.alias("a")).select("event_id", "a.*")


@query(f"""with {_PLANS}, t as (select case when plan_text = '' then 0 else len(string_split(plan_text, chr(10))) end as k from v_plans)
  select count(*) as n, sum(k)::bigint as headers, sum(k - (k + 1) // 2)::bigint as missing_assign, count(*) filter (k >= 1) as strict_nonempty, count(*) filter (k >= 1) as robust_nonempty, count(*) filter (k = 0) as still_empty from t""")
def rescue_counters(spark, sf_dir):
    """Counters of the robust parser over a corpus, and what it recovers."""
    half = F.array_join(F.transform(F.split("plan_text", "\n"), lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, r"\{\{\d+\}\} = ", "")).otherwise(x)), "\n")
    t = corpus.plans(spark, sf_dir).select(half.alias("t"))
    t = parse.once(t, "robust", parse.parse_plan("t", "robust")).withColumn("d", parse.diagnostics("t")).withColumn("strict", F.size(parse.parse_plan("t")))
    return t.agg(F.count("*").alias("n"), F.sum("d.headers").alias("headers"), F.sum("d.missing_assign").alias("missing_assign"), F.count_if(F.col("strict") > 0).alias("strict_nonempty"), F.count_if(F.size("robust") > 0).alias("robust_nonempty"), F.count_if(F.size("robust") == 0).alias("still_empty"))


# -- rendering and catalogs -----------------------------------------------------


def _rendered(first: int, mixed: str) -> str:
    return f"'Step ' || (pos + {first}) || ': {{{{' || pos || '}}}} = ' || tool_name || '(arg_0=' || qty || ', ref={{{{' || pos || '}}}}, mixed={mixed}, note=''' || flag || ', ' || status || ''', its=\"it''s\")'"


@query(f"with {_STEPS} select plan_id, md5(string_agg({_rendered(0, chr(39) * 2 + 'see {{0}}' + chr(39) * 2)}, chr(10) order by pos)) as training_md5, md5(string_agg({_rendered(1, 'see {{0}}')}, chr(10) order by pos)) as selection_md5 from v_steps group by plan_id")
def plan_strings(spark, sf_dir):
    """Two serialisers: they differ in step numbers and in the quoting of texts that hold a reference."""
    p = lambda k, v, is_text=True: F.struct(F.lit(k).alias("k"), v.alias("v"), F.lit(is_text).alias("is_text"))
    params = F.array(p("arg_0", F.col("qty").cast("string"), False), p("ref", F.concat(F.lit("{{"), "pos", F.lit("}}"))), p("mixed", F.lit("see {{0}}")), p("note", F.concat("flag", F.lit(", "), "status")), p("its", F.lit("it's")))
    step = F.struct("pos", F.col("pos").alias("step_id"), "tool_name", params.alias("params"), F.concat(F.lit("{{"), "pos", F.lit("}}")).alias("output_variable"))
    s = corpus.raw_steps(spark, sf_dir).groupBy("plan_id").agg(F.array_sort(F.collect_list(step)).alias("s"))
    return s.select("plan_id", md5(render.plan_string(F.col("s"))).alias("training_md5"), md5(render.plan_string(F.col("s"), anywhere=True, first=1)).alias("selection_md5"))


@query("""with t as (select p_partkey // 10 as g, replace(p_name, ' ', '_') as name, min(p_partkey) as k from part group by 1, 2),
  l as (select g, k, '- ' || name || '(arg_0: integer (required), note: ' || case when k % 2 = 0 then 'string' else 'any' end || ')' as marked, '- ' || name || '(arg_0: integer, note: ' || case when k % 2 = 0 then 'string' else 'any' end || ')' as plain from t)
  select g as query_id, md5('Available Tools:' || chr(10) || string_agg(marked, chr(10) order by k)) as prompt_md5, md5('Available Tools:' || chr(10) || string_agg(plain, chr(10) order by k)) as judge_md5 from l group by g""")
def tool_list_prompt(spark, sf_dir):
    param = lambda n, t: F.struct(F.lit(n).alias("name"), t.alias("type"))
    tool = F.struct("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.array(param("arg_0", F.lit("integer")), param("note", F.when(F.col("p_partkey") % 2 == 0, "string"))).alias("params"), F.array(F.lit("arg_0")).alias("required"))
    t = corpus.table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 10").alias("query_id")).agg(F.array_sort(F.collect_list(tool)).alias("t"))
    return t.select("query_id", md5(render.tool_list(F.col("t"))).alias("prompt_md5"), md5(render.tool_list(F.col("t"), marks=False)).alias("judge_md5"))


@query("""select p_partkey, 'a' as name, 'integer' as type, true as required from part union all
  select p_partkey, 'b', case when p_partkey % 3 = 2 then 'string' else 'any' end, p_partkey % 3 <> 0 from part""")
def catalog_schema(spark, sf_dir):
    """Parameters from a JSON schema with and without ``required`` and from a flat object."""
    forms = ['{"properties": {"a": {"type": "integer"}, "b": {"description": "x"}}, "required": ["a"]}', '{"properties": {"a": {"type": "integer"}, "b": {}}}', '{"a": {"type": "integer"}, "b": "string"}']
    p = corpus.table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 3 + 1).cast("int")).alias("schema"))
    return p.select("p_partkey", F.explode(catalog.parameters(F.col("schema"))).alias("x")).select("p_partkey", "x.*")


@query("select p_partkey, case p_partkey % 3 when 0 then 'api_b' when 1 then 'api_a' else 'zzz' end as name from part")
def gold_name_remap(spark, sf_dir):
    """A gold step's name to its tool: equal, else contained either way, else as it is."""
    tool = lambda k, a: F.struct(k.alias("key"), F.lit(a).alias("api"))
    tools = F.array(tool(F.lit("zzz no api"), None), tool(F.concat("p_name", F.lit(" of x")), "api_a"), tool(F.col("p_name"), "api_b"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" of"))).otherwise(F.lit("zzz"))
    return corpus.table(spark, sf_dir, "part").select("p_partkey", catalog.gold_name(name, tools).alias("name"))


_FREE = "case when len(picked) >= 4 or not list_contains(picked, {j}) then 1 else 0 end"
_RANKED = ", ".join("{'f': " + _FREE.format(j=j) + f", 'x': (s.qty * {j + 3}) % 7, 'i': {-j}}}" for j in range(4))


@query(f"""with recursive {_STEPS}, g as (select plan_id, -1 as pos, []::int[] as picked from (select distinct plan_id from v_steps)
  union all select g.plan_id, g.pos + 1, list_append(picked, -(list_max([{_RANKED}])).i) from g join v_steps s on s.plan_id = g.plan_id and s.pos = g.pos + 1)
  select plan_id, pos, 'tool' || picked[-1] as tool from g where pos >= 0""")
def greedy_assign(spark, sf_dir):
    """Steps take the best tool not yet used; from the fifth on all are free."""
    s = corpus.raw_steps(spark, sf_dir)
    row = F.struct("pos", F.array(*(((F.col("qty") * (j + 3)) % 7).cast("double") for j in range(4))).alias("x"))
    rows = s.groupBy("plan_id").agg(F.array_sort(F.collect_list(row)).alias("r")).select("plan_id", F.col("r.x").alias("scores"), F.array(*(F.lit(f"tool{j}") for j in range(4))).alias("tools"))
    return catalog.greedy_assign(rows, "plan_id", "scores", "tools")


# -- candidates, joins and sets -------------------------------------------------

_SHARES = {"none": 0.15, "type_mismatch": 0.10, "missing_dependency": 0.10, "wrong_tool": 0.15, "parameter_typo": 0.10, "circular_dependency": 0.05, "inefficient_order": 0.10, "incomplete_plan": 0.10, "unnecessary_steps": 0.10, "forward_reference": 0.05}
_CHANGED = "case error_type when 'none' then true when 'type_mismatch' then true when 'wrong_tool' then others when 'parameter_typo' then true when 'inefficient_order' then false else k >= 2 end"


@query(f"""with {_PLANS}, t as (select plan_id // 10 as q, count(distinct tool_name) > 1 as others from v_steps group by 1), n as (select plan_id, count(*) as k, any_value(others) as others from v_steps join t on q = plan_id // 10 group by 1), c(slot, error_type) as (values {", ".join(f"({i}, '{t}')" for i, t in enumerate(ERROR_TYPES))})
  select v_plans.query_id, c.slot::int as slot, c.error_type, {_CHANGED.replace("error_type", "c.error_type")} as changed, (k + case c.error_type when 'incomplete_plan' then case when k >= 2 then -1 else 0 end when 'unnecessary_steps' then case when k >= 2 then 1 else 0 end else 0 end)::int as n_steps
  from v_plans join n using (plan_id), c where v_plans.slot = 0""")
def quota_candidates(spark, sf_dir):
    """Ten candidates of each gold plan by quota."""
    gold = corpus.parsed(spark, sf_dir).where("slot = 0 and size(steps) > 0").select("query_id", "steps")
    out = inject.candidates(gold.join(corpus.query_tools(spark, sf_dir), "query_id"), 10, _SHARES)
    return out.select("query_id", "slot", "error_type", "changed", F.size("injected").alias("n_steps"))


@query(f"""with {_PLANS}, k as (select p.plan_id, query_id, judge_score, (select list(pos || '=' || tool_name order by pos) from v_steps s where s.plan_id = p.plan_id) as key from v_plans p),
  pred as (select query_id, key, judge_score as score, plan_id * 2 as ord from k union all select query_id, key, judge_score + 1, plan_id * 2 + 1 from k where plan_id % 3 = 0),
  l as (select query_id, key, max_by(score, ord) as score from pred group by query_id, key)
  select k.plan_id, l.score::int as score from k join l on l.query_id = k.query_id and l.key is not distinct from k.key""")
def keyed_last_wins(spark, sf_dir):
    """Predictions joined on query and steps; of repeated ones the last counts."""
    p = corpus.parsed(spark, sf_dir).select("plan_id", "query_id", "judge_score", "steps")
    again = F.array(F.struct(F.col("judge_score").alias("score"), (F.col("plan_id") * 2).alias("ord")), F.when(F.col("plan_id") % 3 == 0, F.struct((F.col("judge_score") + 1).alias("score"), (F.col("plan_id") * 2 + 1).alias("ord"))))
    pred = p.select("query_id", "steps", F.explode(F.array_compact(again)).alias("x")).select("query_id", "steps", "x.*")
    return select.join_by_steps(p.select("plan_id", "query_id", "steps"), pred, "query_id", "steps", "ord", "score").select("plan_id", F.col("score").cast("int").alias("score"))


@query("""with a as (select distinct o_orderkey // 10 as q from orders where o_orderstatus = 'F'), b as (select distinct o_orderkey // 10 as q from orders where o_totalprice > 200000)
  select 'only_a' as side, count(*) as n from (from a except from b) union all select 'only_b', count(*) from (from b except from a) union all select 'both', count(*) from (from a intersect from b)""")
def split_disagreement(spark, sf_dir):
    o = corpus.table(spark, sf_dir, "orders").withColumn("q", F.expr("o_orderkey div 10"))
    return select.disagreement(o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 200000"), "q")


@query("select o_orderkey // 10 as query_id from orders group by 1 having count(distinct o_orderstatus) > 1")
def split_leaks(spark, sf_dir):
    """Queries whose plans fall in several splits (here: by order status)."""
    o = corpus.table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 10").alias("query_id"), F.col("o_orderstatus").alias("split"))
    return select.leaking_groups(o, "query_id")


# -- grounded runs --------------------------------------------------------------

_GROUNDED = f"""{_PLANS}, n as (select plan_id, count(*) as k, min_by(tool_name, pos) as t0, max_by(tool_name, pos) as t1 from v_steps group by 1),
runs as (select plan_id, k, case when plan_id % 4 = 1 and k >= 2 and t0 <> t1 then 'tool_error' when plan_id % 4 = 2 then 'unknown_tool' when plan_id % 4 = 3 then 'unresolved_ref' else 'ok' end as exec_status,
  'value' || case when plan_id % 4 = 1 and k >= 2 then 0 else k - 1 end || 'of' || plan_id as out from n)"""


def grounded(spark, sf_dir):
    """Runs against known answers: right plans, and ones whose last step has a
    made-up value, calls no tool or refers to no step."""
    s = corpus.raw_steps(spark, sf_dir)
    step = F.struct("pos", "tool_name")
    g = s.groupBy("plan_id").agg(F.sort_array(F.collect_list(step)).alias("s")).withColumn("kind", F.col("plan_id") % 4).withColumn("last", F.size("s") - 1)
    answer = lambda i: F.concat(F.lit("value"), i.cast("string"), F.lit("of"), F.col("plan_id").cast("string"))
    hops = F.transform("s", lambda x: F.struct(x["tool_name"].alias("tool"), F.concat(F.lit("what is hop "), x["pos"], F.lit("?")).alias("question"), answer(x["pos"]).alias("answer")))
    g = g.withColumn("hops", hops).withColumn("gold", answer(F.col("last")))

    def line(x):
        end = x["pos"] == F.col("last")
        tool = F.when(end & (F.col("kind") == 2), "no_such_tool").otherwise(x["tool_name"])
        value = F.when(end & (F.col("kind") == 3), "{{99}}").when((x["pos"] == 0) | (end & (F.col("kind") == 1)), "'made up'").otherwise(F.concat(F.lit("{{"), x["pos"] - 1, F.lit("}}")))
        return F.concat(F.lit("Step "), x["pos"], F.lit(": {{"), x["pos"], F.lit("}} = "), tool, F.lit("(q="), value, F.lit(")"))

    g = g.select("plan_id", "hops", "gold", F.lit("which one?").alias("question"), F.array_join(F.transform("s", line), "\n").alias("t"))
    return execute.execute_grounded(parse.once(g, "steps", parse.parse_plan("t")).drop("t"))


@query(f"with {_GROUNDED} select plan_id, exec_status, case when exec_status = 'ok' then out end as exec_output from runs")
def exec_grounded(spark, sf_dir):
    return grounded(spark, sf_dir).select("plan_id", "exec_status", "exec_output")


_RATE = "round(count(*) filter ({a}) / nullif(count(*) filter ({b}), 0), 6) as {k}"


@query(f"""with {_GROUNDED}, r as (select p.query_id, p.slot, coalesce(exec_status, 'uncovered') as st, coalesce(exec_status = 'ok' and out = 'value' || (k - 1) || 'of' || p.plan_id, false) as s, judge_score >= 80 as j, slot % 2 = 0 as f from v_plans p left join runs using (plan_id)),
  u as (select query_id, min_by(s, slot) as s from r where st <> 'uncovered' group by 1)
  select count(*) as n_records, count(*) filter (st <> 'uncovered') as n_covered, {_RATE.format(a="st <> 'uncovered'", b="true", k="coverage")}, {_RATE.format(a="st = 'ok'", b="st <> 'uncovered'", k="completion")}, {_RATE.format(a="s", b="st <> 'uncovered'", k="strict_accuracy")}, {_RATE.format(a="s", b="st <> 'uncovered'", k="lenient_accuracy")},
  {_RATE.format(a="s and j", b="j and st <> 'uncovered'", k="strict_given_judge_pass")}, {_RATE.format(a="s and not j", b="not j and st <> 'uncovered'", k="strict_given_judge_fail")}, {_RATE.format(a="s and f", b="f and st <> 'uncovered'", k="strict_given_functional_match")},
  (select count(*) from u) as n_unique_queries, (select round(avg(s::int), 6) from u) as strict_unique_queries from r""")
def exec_conditional(spark, sf_dir):
    """Accuracy overall, given the judge's verdict or a match (here: even slots), and of first runs."""
    g = grounded(spark, sf_dir)
    strict, lenient = execute.answers_match(F.col("exec_output"), F.col("gold"))
    g = g.select("plan_id", "exec_status", strict.alias("strict"), lenient.alias("lenient"))
    p = corpus.plans(spark, sf_dir).select("plan_id", "query_id", F.col("slot").alias("ordinal"), (F.col("judge_score") >= 80).alias("judge_success"), (F.col("slot") % 2 == 0).alias("functional_match"))
    return report.execution_summary(p.join(g, "plan_id", "left").withColumn("exec_status", F.coalesce("exec_status", F.lit("uncovered"))))


@query(f"with {_GROUNDED}, d(name) as (values ('ok'), ('parse_empty'), ('unknown_tool'), ('unresolved_ref'), ('call_error'), ('tool_error'), ('timeout')) select name, count(plan_id) as n, round(100.0 * count(plan_id) / (select count(*) from runs), 1)::double as pct from d left join runs on exec_status = name group by name")
def exec_failures(spark, sf_dir):
    return report.shares_of(grounded(spark, sf_dir), F.col("exec_status"), ["ok", "parse_empty", "unknown_tool", "unresolved_ref", "call_error", "tool_error", "timeout"])


# -- reports and search ---------------------------------------------------------


@query(f"""with {_PLANS}, c as (select query_id, max(judge_score) as b, min_by(judge_score, slot) as f from v_plans where slot < 5 group by 1)
  select count(*) as n, round(avg((b >= 80)::int), 6) as best_success, round(avg((f >= 80)::int), 6) as first_success, round(100.0 * (count(*) filter (b >= 80) - count(*) filter (f >= 80)) / count(*), 6)::double as success_gain_pts, round(avg(b), 6) as best_mean, round(avg(f), 6) as first_mean, round((sum(b) - sum(f)) / count(*), 6) as score_gain_pts from c""")
def best_of_n_gain(spark, sf_dir):
    best = select.best_of_n(corpus.plans(spark, sf_dir).where("slot < 5"), "query_id", "slot", "judge_score", "confidence", "plan_text")
    return report.selection_gain(best)


@query(f"""with {_PLANS}, t as (select (judge_score >= 80)::int as a, (quality_score >= 80)::int as b from v_plans), m as (select count(*) as n, avg((a = b)::int) as po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) as pe from t)
  select n, round(po, 6) as agreement, round((po - pe) / (1 - pe), 6) as kappa from m""")
def two_judge_agreement(spark, sf_dir):
    p = corpus.plans(spark, sf_dir).select((F.col("judge_score") >= 80).alias("a"), (F.col("quality_score") >= 80).alias("b"))
    return metrics.kappa(p, "a", "b")


@query(f"""with {_VIOL}, {_PLANS.replace(_STEPS + ',', '')}, l as (select plan_id, count(*) as k from viol group by 1)
  select error_type, count(*) as n, round(avg(quality_score), 6) as avg_score, round(sum(coalesce(k, 0)) / count(*), 6) as avg_issues, avg(quality_score) > 95 and error_type not in ('none', 'parameter_typo') as suspicious from v_plans left join l using (plan_id) group by error_type""")
def corpus_report(spark, sf_dir):
    issues = validate.violations(steps_of(spark, sf_dir), corpus.catalog(spark, sf_dir))
    return report.corpus_report(corpus.plans(spark, sf_dir), issues)


@query(f"""with {_VIOL}, d(name) as (values ('critical'), ('high'), ('medium'), ('low')), s as (select case kind when 'unknown_tool' then 'critical' else 'high' end as severity from viol)
  select name, count(severity) as n, round(100.0 * count(severity) / (select count(*) from s), 1)::double as pct from d left join s on severity = name group by name""")
def issue_severities(spark, sf_dir):
    """Every severity gets a row, also one that never occurs."""
    issues = validate.violations(steps_of(spark, sf_dir), corpus.catalog(spark, sf_dir))
    severity = F.element_at(F.create_map(*(F.lit(x) for kv in score.SEVERITY.items() for x in kv)), F.col("kind"))
    return report.shares_of(issues, severity, ["critical", "high", "medium", "low"])


@query("""with m as (select user_id, avg(value) as mean, stddev_pop(value) as std from events group by 1)
  select count(*) as n, round(avg(mean), 4) as mean_of_means, round(avg(std), 4) as mean_std, round(count(*) filter (mean >= 80) / count(*), 6) as share_saturated, round(count(*) filter (mean <= 20) / count(*), 6) as share_hopeless from m""")
def rollout_saturation(spark, sf_dir):
    m = corpus.table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    n = F.count("*")
    return m.agg(n.alias("n"), F.round(F.avg("mean"), 4).alias("mean_of_means"), F.round(F.avg("std"), 4).alias("mean_std"), r6(F.count_if(F.col("mean") >= 80) / n).alias("share_saturated"), r6(F.count_if(F.col("mean") <= 20) / n).alias("share_hopeless"))


_NODES = "n as (select user_id, event_type, count(*) as visits, round(avg(round(value * 100)::bigint), 6) as q, length(event_type) / 10.0 as prior from events group by 1, 2)"


def _rewards(spark, sf_dir):
    """Rewards in whole hundredths, so that means do not depend on an order of summing."""
    return corpus.table(spark, sf_dir, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


@query("select user_id, event_type, case when user_id is null then 0 when event_type is null then 1 else 2 end::int as depth, count(*) as visits, round(avg(round(value * 100)::bigint), 6) as q from events group by rollup (user_id, event_type)")
def search_backprop(spark, sf_dir):
    """Events as rollouts through a user and a type: visits and values of all nodes up to the root."""
    out = score.backpropagated(_rewards(spark, sf_dir), ["user_id", "event_type"], "cents")
    return out.select("user_id", "event_type", F.col("depth").cast("int").alias("depth"), "visits", r6(F.col("q")).alias("q"))


def _nodes(spark, sf_dir):
    n = score.backpropagated(_rewards(spark, sf_dir), ["user_id", "event_type"], "cents")
    return n.where("depth = 2").select("user_id", "event_type", "visits", r6(F.col("q")).alias("q"), (F.length("event_type") / 10.0).alias("prior"))


@query(f"with {_NODES}, p as (select user_id, sum(visits) as pv from n group by 1) select user_id, event_type, round(q + 1.5 * prior * sqrt(ln(pv + 1)) / (1 + visits), 4)::double as score from n join p using (user_id)")
def search_selection(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    parents = n.groupBy("user_id").agg(F.sum("visits").alias("pv"))
    s = score.prior_score(F.col("q"), F.col("prior"), F.col("visits"), F.col("pv"), 1.5)
    return n.join(parents, "user_id").select("user_id", "event_type", F.round(s, 4).alias("score"))


@query(f"with {_NODES} select user_id, event_type from n qualify row_number() over (partition by user_id order by q desc, visits desc, prior desc, event_type) = 1")
def search_best_child(spark, sf_dir):
    return score.best_child(_nodes(spark, sf_dir), ["user_id"], "event_type", "prior")
