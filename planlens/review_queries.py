"""Registered queries: agreement of several annotators, blocks of statistics, the plainer comparison, faulty texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens import sql
from planlens.operators import catalog, execute, filters, metrics, report
from planlens.operators.metrics import r6
from planlens.plans import compare, corpus, extract, inject, parse, render, validate
from planlens.queries import _N, _PLANS, _STEPS
from planlens.registry import query

# -- agreement ---------------------------------------------------------------------------

_MARKS = """m as (select o_orderkey as item, 0 as who, case when o_custkey % 3 = 0 then 'no' else 'yes' end as acceptable, 'e' || (o_custkey % 4) as error_type from orders where o_orderkey % 5 <> 1
  union all select o_orderkey, 1, case when o_custkey % 3 = 0 or o_orderkey % 7 = 0 then 'no' else 'yes' end, 'e' || (case when o_orderkey % 4 = 0 then 0 else o_custkey % 4 end) from orders where o_orderkey % 5 <> 2
  union all select o_orderkey, 2, 'yes', case when o_orderkey % 3 = 0 then null else 'e' || (o_custkey % 2) end from orders where o_orderkey % 5 = 4)"""


@query(f"""with {_MARKS}, long as (select item, who, 'acceptable' as label, acceptable as mark from m union all select item, who, 'error_type', error_type from m where error_type is not null),
  p as (select a.label, a.who as a, b.who as b, a.mark as ma, b.mark as mb from long a join long b on a.item = b.item and a.label = b.label and a.who < b.who),
  o as (select label, a, b, count(*) as n, avg((ma = mb)::int) as po from p group by all),
  x as (select label, a, b, ma as mark, count(*) as k from p group by all), y as (select label, a, b, mb as mark, count(*) as k from p group by all),
  e as (select o.label, o.a, o.b, coalesce(sum(x.k::double * y.k), 0) as s from o left join x using (label, a, b) left join y using (label, a, b, mark) group by all)
  select label, ['A', 'B', 'gpt'][a + 1] as a, ['A', 'B', 'gpt'][b + 1] as b, n, round(po, 6) as agreement, round(case when s / n / n >= 1 then 1.0 else (po - s / n / n) / (1 - s / n / n) end, 6) as kappa from o join e using (label, a, b)""")
def three_annotators(spark, sf_dir):
    """Sheets of two people and a model over different items, by item: acceptance and error type."""
    o = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    kind = lambda c: F.concat(F.lit("e"), c.cast("string")).alias("error_type")
    no = lambda c: F.when(c, "no").otherwise("yes").alias("acceptable")
    sheets = {
        "A": o.where("k % 5 <> 1").select("k", no(F.col("c") % 3 == 0), kind(F.col("c") % 4)),
        "B": o.where("k % 5 <> 2").select("k", no((F.col("c") % 3 == 0) | (F.col("k") % 7 == 0)), kind(F.when(F.col("k") % 4 == 0, 0).otherwise(F.col("c") % 4))),
        "gpt": o.where("k % 5 = 4").select("k", F.lit("yes").alias("acceptable"), F.when(F.col("k") % 3 != 0, kind(F.col("c") % 2)).alias("error_type")),
    }
    return metrics.agreements(sheets, "k", ["acceptable", "error_type"])


# -- blocks of statistics -------------------------------------------------------------------

_RESULTS = f"""{_PLANS}, r as (select judge_score >= 80 as judge_success, slot % 3 = 0 as error_type_handled, plan_id % 9 > 0 as judge_full_parse, slot = 0 as exact_match, slot < 4 as functional_match, slot < 6 as param_only_match, slot % 2 = 0 as step_count_match,
  judge_score as best_score, greatest(judge_score - slot, 0) as first_score, judge_score / 2.0 as mean_score, [0, 0.1, 0.2, 0.4, 0.5, 0.75, 0.8, 0.9, 1, 1][slot + 1]::double as functional_tool_accuracy, slot / 10.0 as param_accuracy, confidence as dependency_accuracy, judge_prediction as prediction from v_plans)"""


def _cells() -> str:
    flags = {"judge_success_rate": "judge_success", "error_handled_rate": "error_type_handled", "judge_full_parse_rate": "judge_full_parse"}
    t = "functional_tool_accuracy"
    cells = [("size", "n", "count(*)")]
    cells += [("accuracy", k, f"avg({c}::int)") for k, c in flags.items()]
    cells += [("accuracy", "first_success_rate", "avg((first_score >= 80)::int)"), ("accuracy", "gain_pts", "avg(best_score) - avg(first_score)")]
    cells += [("scores", "best_mean", "avg(best_score)"), ("scores", "best_median", "median(best_score)"), ("scores", "best_std", "stddev_pop(best_score)"), ("scores", "first_mean", "avg(first_score)"), ("scores", "mean_of_n", "avg(mean_score)")]
    cells += [("scores", "pct_success", "100 * avg((best_score >= 80)::int)"), ("scores", "pct_full", "100 * avg((best_score = 100)::int)")]
    cells += [("structural", c, f"avg({c}::int)") for c in ("exact_match", "functional_match", "param_only_match", "step_count_match")]
    cells += [("structural", c, f"avg({c})") for c in (t, "param_accuracy", "dependency_accuracy")]
    cells += [("tool_accuracy", "0.0", f"count(*) filter ({t} = 0)"), ("tool_accuracy", "0-0.2", f"count(*) filter ({t} > 0 and {t} < 0.2)"), ("tool_accuracy", "1.0", f"count(*) filter ({t} = 1)")]
    cells += [("tool_accuracy", f"{lo}-{hi}", f"count(*) filter ({t} >= {lo} and {t} < {hi})") for lo, hi in (("0.2", "0.5"), ("0.5", "0.8"), ("0.8", "1.0"))]
    for p in ("yes", "likely_yes", "uncertain", "likely_no", "no"):
        cells += [("predictions", p, f"count(*) filter (prediction = '{p}')"), ("predictions", f"{p} %", f"100 * avg((prediction = '{p}')::int)")]
    return " union all ".join(f"select '{s}' as section, '{n}' as name, round(({e})::double, 6) as value from r" for s, n, e in cells)


@query(f"with {_RESULTS} {_cells()}")
def results_block(spark, sf_dir):
    """The whole block of statistics of a method's results."""
    p = corpus.plans(spark, sf_dir)
    slot, judged = F.col("slot"), F.col("judge_score")
    tool = F.element_at(F.array(*(F.lit(float(x)) for x in (0, 0.1, 0.2, 0.4, 0.5, 0.75, 0.8, 0.9, 1, 1))), slot + 1)
    rows = p.select(
        (judged >= 80).alias("judge_success"), (slot % 3 == 0).alias("error_type_handled"), (F.col("plan_id") % 9 > 0).alias("judge_full_parse"), (slot == 0).alias("exact_match"), (slot < 4).alias("functional_match"), (slot < 6).alias("param_only_match"), (slot % 2 == 0).alias("step_count_match"),
        judged.alias("best_score"), F.greatest(judged - slot, F.lit(0)).alias("first_score"), (judged / 2).alias("mean_score"), tool.alias("functional_tool_accuracy"), (slot / 10).alias("param_accuracy"), F.col("confidence").alias("dependency_accuracy"), F.col("judge_prediction").alias("prediction"),
    )
    return report.results_block(rows)


_ISSUES = "i as (select ['critical', 'high', 'medium', 'low'][(qty % 4)::int + 1] as severity, 't' || (pos % 5) as type from v_steps where qty % 5 = 0)"


@query(f"""with {_PLANS}, {_ISSUES} select 'error_types' as section, error_type as name, count(*)::double as value from v_plans group by 2 union all select 'success_predictions', prediction, count(*) from v_plans group by 2
  union all select 'quality_scores', unnest(['mean', 'min', 'max', 'median']), unnest([round(avg(quality_score), 6), min(quality_score), max(quality_score), list_sort(list(quality_score))[count(*) // 2 + 1]]) from v_plans
  union all select 'issue_severities', severity, count(*) from i group by 2 union all select 'issue_types', type, count(*) from i group by 2""")
def dataset_statistics(spark, sf_dir):
    return report.dataset_statistics(corpus.plans(spark, sf_dir), _issues(spark, sf_dir))


def _issues(spark, sf_dir) -> DataFrame:
    s = corpus.raw_steps(spark, sf_dir).where("qty % 5 = 0")
    severity = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), F.col("qty") % 4 + 1)
    return s.select(severity.alias("severity"), F.concat(F.lit("t"), (F.col("pos") % 5).cast("string")).alias("type"))


@query(f"with {_STEPS}, {_ISSUES} select type, count(*) as n, row_number() over (order by count(*) desc, type)::int as rank from i group by type")
def issue_order(spark, sf_dir):
    return report.issue_order(_issues(spark, sf_dir))


_FAILED = """r as (select 'm' || (slot % 3) as method, judge_score as s, case when trim(plan_text) <> '' then case when plan_id % 4 = 3 then true else plan_id % 4 = 1 end end as f from v_plans)"""
_FAIL_CELLS = "count(*) as n_records, count(*) filter (f) as n_failures, round(avg(s) filter (f), 6) as judge_mean_on_failures, round(avg((s < 80)::int) filter (f), 6) as flag_rate_on_failures, round(avg(s) filter (not f), 6) as judge_mean_on_non_failures from r"


@query(f"with {_PLANS}, {_FAILED} select method, {_FAIL_CELLS} group by method union all select null, {_FAIL_CELLS}")
def failures_by_execution(spark, sf_dir):
    """What a judge says of plans whose run was wrong or missing, by method and in all."""
    p = corpus.plans(spark, sf_dir)
    correct = F.when(F.col("plan_id") % 4 != 3, F.col("plan_id") % 4 != 1)
    failed = filters.organic_failure(F.col("plan_text"), F.lit(True), correct)
    return report.failure_report(p.withColumn("method", F.concat(F.lit("m"), (F.col("slot") % 3).cast("string"))), failed, "method")


# -- comparison, catalogs, checks ---------------------------------------------------------

_PAIRS = """g as (select *, count(*) over (partition by plan_id) as n from v_steps),
  al as (select *, not (pos % 4 = 3) as has_note, pos % 3 = 1 as far from g where plan_id % 6 > 0 and (plan_id % 3 > 0 or pos < n - 1))"""


@query(f"""with {_STEPS}, {_PAIRS},
  c as (select plan_id, max(n) as n, (select count(*) from al b where b.plan_id = g.plan_id) as k from g group by plan_id),
  t as (select plan_id, sum((plan_id % 5 > 0 or pos > 0)::int) as tools, sum(2) as keys, sum((not far)::int + has_note::int) as good from al group by plan_id)
  select c.plan_id, k > 0 as valid, case when k = 0 then 'No steps generated' end as error, k > 0 and k = n as step_count_match, coalesce(tools, 0)::bigint as correct_tools, coalesce(keys, 0)::bigint as total_params, coalesce(good, 0)::bigint as correct_params,
    round(coalesce(tools, 0) / n, 6) as tool_accuracy, round(coalesce(good / keys, 0), 6) as param_accuracy, coalesce(k > 0 and k = n and tools = n and good = keys, false) as exact_match
  from c left join t using (plan_id)""")
def plain_comparison(spark, sf_dir):
    """Plans against gold ones that differ in tools, values, parameters and length, or are empty."""
    s = corpus.raw_steps(spark, sf_dir)
    param = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    gold = F.struct("pos", F.col("tool_name"), F.array(param("a", F.concat(F.lit("'V "), F.col("qty").cast("string"), F.lit("'"))), param("note", F.col("flag"))).alias("params"))
    value = F.when(F.col("pos") % 3 == 1, "other").otherwise(F.concat(F.lit('" v   '), F.col("qty").cast("string"), F.lit(' "')))
    tool = F.when((F.col("plan_id") % 5 == 0) & (F.col("pos") == 0), "wrong").otherwise(F.concat(F.lit(" "), F.upper("tool_name")))
    note = F.when(F.col("pos") % 4 == 3, "b").otherwise("note")
    made = F.struct("pos", tool.alias("tool_name"), F.array(param("a", value), F.struct(note.alias("k"), F.lower("flag").alias("v"))).alias("params"))
    sorted_ = lambda c: F.array_sort(F.collect_list(c))
    plans = s.groupBy("plan_id").agg(sorted_(gold).alias("gold_steps"), sorted_(made).alias("steps"))
    steps = F.when(F.col("plan_id") % 6 == 0, F.slice("steps", 1, 0)).when(F.col("plan_id") % 3 == 0, F.slice("steps", F.lit(1), F.size("steps") - 1)).otherwise(F.col("steps"))
    out = compare.compare_counts(plans.withColumn("steps", steps))
    return out.select("plan_id", "valid", "error", "step_count_match", "correct_tools", "total_params", "correct_params", r6(F.col("tool_accuracy")).alias("tool_accuracy"), r6(F.col("param_accuracy")).alias("param_accuracy"), "exact_match")


@query("""with p as (select p_size as query_id, p_partkey as o, 'What is ' || p_name || '?' as nl, case when p_partkey % 3 = 0 then 'api_' || p_brand when p_partkey % 3 = 1 then '' end as api from part),
  n as (select query_id, o, nl, coalesce(nullif(api, ''), left(trim(regexp_replace(lower(nl), '[^a-z0-9_]+', '_', 'g'), '_'), 60)) as api from p)
  select query_id, api, min(o) as o, arg_min(nl, o) as nl from n group by 1, 2""")
def catalog_by_made_name(spark, sf_dir):
    """Tools by API name, where some have none or an empty one and are named by their question."""
    p = corpus.table(spark, sf_dir, "part")
    api = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("api_"), "p_brand")).when(F.col("p_partkey") % 3 == 1, "")
    tools = p.select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("o"), F.concat(F.lit("What is "), "p_name", F.lit("?")).alias("nl"), api.alias("api"))
    return catalog.by_api_name(tools, "query_id", "nl", "o", "api").select("query_id", "api", "o", "nl")


@query(f"with {_STEPS} select plan_id, pos, k as detail from v_steps, (values ('object'), ('pure'), ('text'), ('list')) t(k) where k = 'object' and plan_id % 3 = 0")
def validate_objects_with_references(spark, sf_dir):
    """An object that holds a reference is checked like any other; references, texts and lists with one are not."""
    s = corpus.raw_steps(spark, sf_dir)
    ref = F.concat(F.lit("{{"), F.greatest(F.col("pos") - 1, F.lit(0)).cast("string"), F.lit("}}"))
    values = {"object": F.concat(F.lit("{'k': '"), ref, F.lit("'}")), "pure": ref, "text": F.concat(F.lit("'see "), ref, F.lit("'")), "list": F.concat(F.lit("["), ref, F.lit("]"))}
    params = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()))
    tool = F.concat(F.lit("t"), (F.col("plan_id") % 3).cast("string"))
    steps = s.select("plan_id", "pos", (F.col("pos") + 1).alias("step_id"), tool.alias("tool_name"), params.alias("params"), F.lit(99).alias("last_step"))
    types = lambda t: F.create_map(*(F.lit(x) for k in values for x in (k, t if k == "object" else "integer")))
    tools = spark.range(3).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tool_name"), F.array().cast("array<string>").alias("required"), F.when(F.col("id") == 0, types("array")).otherwise(types("object")).alias("types"))
    return validate.violations(steps, tools).where("kind = 'type_mismatch'").select("plan_id", "pos", "detail")


@query(f"""with {_STEPS} select plan_id, count(*) as n, min(tool_name) as least_tool, count(*) filter (pos % 4 = 0)::bigint as unclosed, count(*) filter (pos % 4 in (1, 2))::bigint as alt_var,
    string_agg('{{{{' || pos || '}}}}', ',' order by pos) as variables, string_agg(qty || ')', ',' order by pos) filter (pos % 4 = 3) as deep, string_agg('{{{{' || (pos - 1) || '}}}}', ',' order by pos) filter (pos % 4 = 1) as refs from v_steps group by plan_id""")
def robust_faults(spark, sf_dir):
    """Calls without an end, ``{N}`` and ``result_N`` variables, marked-up headers, brackets that close too often."""
    s = corpus.raw_steps(spark, sf_dir)
    pos, tool, qty = F.col("pos").cast("string"), F.col("tool_name"), F.col("qty").cast("string")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kind = F.col("pos") % 4
    line = (
        F.when(kind == 0, say("Step ", pos, ": {{", pos, "}} = ", tool, "(a=", qty, ", b='x y'"))
        .when(kind == 1, say("**Action ", pos, ":** {", pos, "} = ", tool, "(a={", (F.col("pos") - 1).cast("string"), "}, b=1);"))
        .when(kind == 2, say("### Call ", pos, " - result_", pos, " = ", tool, "(a=1, b=[2, 3]))."))
        .otherwise(say("- Operation ", pos, ") {{", pos, "}} = ", tool, "(a=", qty, "), b=2)"))
    )
    texts = s.groupBy("plan_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", line.alias("l"))))["l"], "\n").alias("t"))
    read = parse.once(texts, "steps", parse.parse_plan("t", "robust")).withColumn("d", parse.diagnostics("t"))
    arg = lambda rest, k: F.expr(f"nullif(array_join(transform(filter(steps, s -> s.pos % 4 = {rest}), s -> filter(s.params, p -> p.k = '{k}')[0].v), ','), '')")
    return read.select("plan_id", F.size("steps").cast("bigint").alias("n"), F.array_min("steps.tool_name").alias("least_tool"), F.col("d.unclosed").cast("bigint").alias("unclosed"), F.col("d.alt_var").cast("bigint").alias("alt_var"), F.array_join("steps.output_variable", ",").alias("variables"), arg(3, "a").alias("deep"), arg(1, "a").alias("refs"))


@query(f"""with {_PLANS} select plan_id, md5('Query: ' || query_id || chr(10) || chr(10) || 'Available Tools:' || chr(10) || '- t(a: any)' || chr(10) || chr(10) || 'Plan to Evaluate:' || chr(10) || plan_text || chr(10) || chr(10) ||
  'Please evaluate this plan and provide:' || chr(10) || '1. Quality score (0-100)' || chr(10) || '2. Success prediction (yes/likely_yes/uncertain/likely_no/no)' || chr(10) || '3. Detailed reasoning' || chr(10) || '4. List of issues (if any)' || chr(10) || '5. Confidence (0.0-1.0)' || chr(10) || chr(10) ||
  'Format your response as JSON:' || chr(10) || '{{' || chr(10) || '  "quality_score": <int>,' || chr(10) || '  "success_prediction": "<string>",' || chr(10) || '  "reasoning": "<string>",' || chr(10) || '  "issues": [...],' || chr(10) || '  "confidence": <float>' || chr(10) || '}}') as request_md5 from v_plans""")
def judge_requests(spark, sf_dir):
    """The message that asks a judge about a plan."""
    p = corpus.plans(spark, sf_dir)
    text = render.judge_request(F.col("query_id").cast("string"), F.lit("Available Tools:\n- t(a: any)"), F.col("plan_text"))
    return p.select("plan_id", F.md5(text.cast("binary")).alias("request_md5"))


# -- injectors -----------------------------------------------------------------------------

_KINDS = ("type_mismatch", "inefficient_order", "incomplete_plan", "unnecessary_steps")


@query(f"""with {_N}, d as (select plan_id, k, unnest(range(25)) as t from n where k >= 2), r as (select plan_id, k, t, e, row_number() over (partition by plan_id, t order by md5(plan_id || '|' || t || '|' || e)) as i from d, (values {', '.join(f"('{e}')" for e in _KINDS)}) v(e)),
  g as (select plan_id, k, t, list_sort(list(e)) as e from r where i <= 2 group by all having not list_contains(list(e), 'inefficient_order')), f as (select plan_id, k, min(t) as t, arg_min(e, t) as e from g group by 1, 2)
  select plan_id, t::int as tried, array_to_string(e, ',') as errors, (k + list_contains(e, 'unnecessary_steps')::int - list_contains(e, 'incomplete_plan')::int)::int as n_steps from f""")
def compound_with_tries(spark, sf_dir):
    """Two errors a plan, drawn anew while one of them changes nothing: these plans have no order to spoil."""
    p = corpus.parsed(spark, sf_dir).where("size(steps) > 0").select("plan_id", "steps")
    p = inject.compound_tried(p, 2, _KINDS)
    return p.select("plan_id", "tried", F.array_join(F.array_sort("errors"), ",").alias("errors"), F.size("injected").alias("n_steps"))


@query(f"""with {_N}, t as (select distinct plan_id // 10 as q, tool_name as x, case length(tool_name) % 4 when 0 then [] when 1 then ['other'] when 2 then ['arg_0', 'zzz'] else ['arg_0', 'arg_1', 'note'] end as req from v_steps),
  m as (select plan_id, plan_id // 10 as q, tool_name as own, case when pos > 0 then ['arg_0', 'arg_1', 'note'] else ['arg_0', 'note'] end as held from s where pos = mid),
  o as (select plan_id, x, case when len(req) = 0 or list_sort(req) = list_sort(held) then 2 when list_has_any(req, held) then 1 else 0 end as rank, md5(own || x) as h from m join t using (q) where x <> own)
  select m.plan_id, count(x) > 0 as changed, coalesce(arg_min(x, rank || h), any_value(own)) as tool, coalesce(min(rank), -1)::int as rank from m left join o using (plan_id) group by m.plan_id""")
def wrong_tool_by_rank(spark, sf_dir):
    """The middle step calls a tool that requires none of its parameters, else some, else what takes them all."""
    need = lambda t: F.when(F.length(t) % 4 == 0, F.array().cast("array<string>")).when(F.length(t) % 4 == 1, F.array(F.lit("other"))).when(F.length(t) % 4 == 2, F.array(F.lit("arg_0"), F.lit("zzz"))).otherwise(F.array(F.lit("arg_0"), F.lit("arg_1"), F.lit("note")))
    tools = corpus.query_tools(spark, sf_dir).select("query_id", F.transform("all_tools", lambda t: F.struct(t.alias("name"), need(t).alias("required"))).alias("specs"))
    p = corpus.parsed(spark, sf_dir).where("size(steps) > 0").join(tools, "query_id")
    p = parse.once(p, "i", inject.injector("wrong_tool", specs="specs"))
    middle = F.get(F.col("i.steps"), F.expr("size(steps) div 2"))
    p = p.select("plan_id", "i.changed", middle["tool_name"].alias("tool"), middle["params"]["k"].alias("held"), "specs")
    req = F.get(F.filter("specs", lambda t: t["name"] == F.col("tool")), 0)["required"]
    rank = F.when(~F.col("changed"), -1).when((F.size(req) == 0) | (F.array_sort(req) == F.array_sort("held")), 2).when(F.arrays_overlap(req, "held"), 1).otherwise(0)
    return p.select("plan_id", "changed", "tool", rank.alias("rank"))


# -- runs that end oddly, SQL, training rows -----------------------------------------------


@query("""select p_partkey, case p_partkey % 7 when 0 then 'tool_error' when 1 then 'timeout' when 5 then 'call_error' when 6 then 'unresolved_ref' else 'ok' end as exec_status,
  case p_partkey % 7 when 2 then (p_size + 2)::varchar when 3 then (p_size / 4.0)::double::varchar when 4 then 'n' || (p_size + 1) || '.' end as exec_output,
  case p_partkey % 7 when 0 then 0 when 5 then 1 when 6 then 1 end::int as failed from part""")
def exec_edges(spark, sf_dir):
    """Outputs that tell of an error, plans that are too long, a call repeated without the argument
    it refuses, arguments by position, a reference inside a text, a division by zero, a missing output."""
    p = corpus.spread(corpus.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").cast("string").alias("n"), F.replace("p_name", F.lit("'"), F.lit("")).alias("name")))
    say = lambda *parts: F.concat(*(F.lit(x) if x != "n" and x != "name" else F.col(x) for x in parts))
    long_ = "\n".join(f"Step {i}: {{{{{i}}}}} = negate(number=1)" for i in range(201))
    kinds = [
        say("Step 0: {{0}} = add(arg_0='Error: ', arg_1='", "name", "')"),
        F.lit(long_),
        say("Step 0: {{0}} = add(arg_0=", "n", ", arg_1=2, extra_flag=3)"),
        say("Step 0: {{0}} = speed(arg_0=", "n", ", arg_1=4)"),
        say("Step 0: {{0}} = add(arg_0=", "n", ", arg_1=1)\nStep 1: {{1}} = add(arg_0='n{{0}}', arg_1='.')"),
        say("Step 0: {{0}} = subtract(arg_0=", "n", ", arg_1=", "n", ")\nStep 1: {{1}} = divide(arg_0=1, arg_1={{0}})"),
        say("Step 0: {{0}} = negate(number=", "n", ")\nStep 1: {{1}} = negate(number={{5}})"),
    ]
    text = F.element_at(F.array(*kinds), (F.col("p_partkey") % 7 + 1).cast("int"))
    out = execute.execute(parse.once(p.select("p_partkey", text.alias("t")), "steps", parse.parse_plan("t")).select("p_partkey", "steps"))
    return out.select("p_partkey", "exec_status", "exec_output", F.col("exec_failed_step").alias("failed"))


@query(f"with {_STEPS} select tool_name, count(*) as n, sum(qty)::bigint as qty, count(distinct plan_id) as plans from v_steps group by tool_name")
def sql_surface(spark, sf_dir):
    """Plans parsed and counted in SQL alone, by the table function over the view of plans."""
    sql.register(spark, sf_dir)
    return spark.sql("""select s.tool_name, count(*) as n, sum(cast(filter(s.params, p -> p.k = 'arg_0')[0].v as bigint)) as qty, count(distinct plan_id) as plans
      from plans, lateral parse_plan(plan_text) s group by s.tool_name""")


@query("""with t as (select p_partkey, p_size::int as n from part) select p_partkey, case when n < 20 then least(n + n % 7, 20)::int end as length, case when n < 20 then least(n, 20)::int end as ignored, case when n < 20 and n % 7 > 0 then 1000::int end as first_label from t""")
def masked_training_rows(spark, sf_dir):
    """Token rows whose prompt is ignored by the loss; rows that hold no more than a prompt go."""
    p = corpus.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("n"))
    ids = lambda n, first: F.transform(F.array_repeat(F.lit(0), n), lambda _, i: i + first)
    row = render.masked_labels(ids(F.col("n"), 1), ids(F.col("n") % 7, 1000), 20)
    p = p.select("p_partkey", row.alias("r"))
    told = F.filter("r.labels", lambda x: x != -100)
    return p.select("p_partkey", F.when(F.col("r").isNotNull(), F.size("r.ids")).alias("length"), F.when(F.col("r").isNotNull(), F.size("r.labels") - F.size(told)).alias("ignored"), F.get(told, 0).alias("first_label"))


@query("""select p_partkey, '{"a":["{{0}} of ' || p_size || '",{"k":"{{1}}","l":[[1,"x{{1}}y"]]}],"b":"$var_7.z$","{{0}}":null}' as arguments from part""")
def label_refs_nested(spark, sf_dir):
    """Labels in the strings and keys of nested arguments; those without a step stay."""
    p = corpus.table(spark, sf_dir, "part")
    text = F.concat(F.lit('{"a":["$var_1.result$ of '), F.col("p_size").cast("string"), F.lit('",{"k":"$var2.x$","l":[[1,"x$var_2.y$y"]]}],"b":"$var_7.z$","$var1.q$":null}'))
    return p.select("p_partkey", extract.label_refs(text, F.array(F.lit("$var_1"), F.lit("$var2"))).alias("arguments"))
