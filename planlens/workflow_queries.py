"""Registered queries: sources and sinks, validation of faulty plans, filters, names, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlens.functions import maths, text
from planlens.operators import catalog, execute, filters, metrics, report, retrieve, score, select
from planlens.operators.metrics import r6
from planlens.plans import compare, corpus, extract, inject, parse, render, validate
from planlens.queries import _COMPARE, _PLANS, _STEPS, _injected, _line, compared
from planlens.registry import query
from planlens.sources import io
from planlens.sources.scratch import scratch

_ORDERS = "select o_orderkey, o_custkey, o_orderpriority as name from orders"


def orders(spark, sf_dir) -> DataFrame:
    return corpus.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("name"))


# -- sources and sinks: written, read back and compared with the table ---------------


def _record(alias="r") -> Column:
    return F.struct("o_orderkey", "o_custkey", "name").alias(alias)


_ELEMENT = "struct<o_orderkey:bigint,o_custkey:bigint,name:string>"
_WIDE = "select o_orderkey::bigint as o_orderkey, o_custkey::bigint as o_custkey, o_orderpriority as name from orders"


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"), "name")


def _bucketed(spark, sf_dir) -> DataFrame:
    """Orders in lists of bounded length: one file of records each."""
    return orders(spark, sf_dir).groupBy((F.col("o_orderkey") % 997).alias("b")).agg(F.collect_list(_record()).alias("data"))


@query(_WIDE)
def io_envelope(spark, sf_dir):
    """``{metadata, data: [...]}`` documents, gzipped, with their own record type."""
    path = scratch(spark, "envelope")
    io.write_json(_bucketed(spark, sf_dir).select(F.create_map(F.lit("b"), F.col("b").cast("string")).alias("metadata"), "data"), path, gzip=True)
    records, _ = io.read_envelope(spark, path, f"metadata map<string,string>, data array<{_ELEMENT}>", lines=True)
    return _typed(records)


def _one_value(spark, sf_dir, name: str, record: Column, head: str, tail: str) -> DataFrame:
    """All orders as files of one JSON value each: ``head``, records between commas, ``tail``."""
    path = scratch(spark, name)
    w = Window.partitionBy("b").orderBy("o_orderkey")
    first, last = F.lag("o_orderkey").over(w).isNull(), F.lead("o_orderkey").over(w).isNull()
    rows = orders(spark, sf_dir).withColumn("b", F.col("o_orderkey") % 3)
    text = rows.select("b", "o_orderkey", F.concat(F.when(first, head).otherwise(","), record, F.when(last, tail).otherwise("")).alias("value"))
    text.repartition("b").sortWithinPartitions("b", "o_orderkey").select("b", "value").write.partitionBy("b").text(path)
    return _typed(io.read_any_json(spark, path, _ELEMENT))


@query(_WIDE)
def io_json_list(spark, sf_dir):
    """Bare lists, each a file that several tasks read."""
    return _one_value(spark, sf_dir, "list", F.to_json(_record()), "[", "]")


@query(_WIDE)
def io_json_data(spark, sf_dir):
    """Lists under ``data``, beside keys that also hold lists and objects."""
    return _one_value(spark, sf_dir, "data", F.to_json(_record()), '{"version":[[1],{"data":[]}],"data":[', '],"note":"}]{\\"data\\":["}')


@query(_WIDE)
def io_json_by_key(spark, sf_dir):
    """Objects of records by key."""
    return _one_value(spark, sf_dir, "by-key", F.concat(F.lit('"k'), F.col("o_orderkey").cast("string"), F.lit('": '), F.to_json(_record())), "{", "}")


@query(_WIDE)
def io_json_or_jsonl(spark, sf_dir):
    """Files of one record a line, read by the reader of any JSON."""
    path = scratch(spark, "lines")
    orders(spark, sf_dir).select(F.to_json(_record()).alias("value")).write.text(path)
    return _typed(io.read_any_json(spark, path, _ELEMENT))


@query(_WIDE)
def io_jsonl(spark, sf_dir):
    path = scratch(spark, "jsonl")
    io.write_json(orders(spark, sf_dir), path)
    return io.read_jsonl(spark, path, "o_orderkey bigint, o_custkey bigint, name string")


@query("select o_orderkey::bigint as o_orderkey, o_custkey::bigint as o_custkey, o_orderpriority as name, o_orderkey % 2 = 0 as even from orders")
def io_nested_parquet(spark, sf_dir):
    """Structs that one producer writes as such and another as JSON text."""
    path = scratch(spark, "nested")
    one = orders(spark, sf_dir).select(_record("a"), F.to_json(F.struct((F.col("o_orderkey") % 2 == 0).alias("even"))).alias("b"))
    one.write.parquet(path)
    back = io.read_nested_parquet(spark, path, {"a": _ELEMENT, "b": "struct<even:boolean>"})
    return back.select(F.col("a.o_orderkey").cast("bigint").alias("o_orderkey"), F.col("a.o_custkey").cast("bigint").alias("o_custkey"), "a.name", "b.even")


@query("select max(case when o_orderkey % 3 > 0 then 'b' else 'a' end) filter (o_orderkey % 3 > 0) as most from orders")
def io_probe(spark, sf_dir):
    """The most frequent value of one column of a wide table."""
    path = scratch(spark, "probe")
    orders(spark, sf_dir).withColumn("kind", F.when(F.col("o_orderkey") % 3 > 0, "b").otherwise("a")).write.parquet(path)
    return spark.createDataFrame([(io.probe_mode(spark, path, "kind"),)], "most string")


@query("select o_orderkey::bigint as o_orderkey, 'a \"b\"' || chr(10) || 'c, ' || o_orderpriority as note from orders where o_orderkey % 3 < 2")
def io_sheet(spark, sf_dir):
    """Cells with quotes and line ends; rows without an answer go."""
    path = scratch(spark, "sheet")
    answer = F.when(F.col("o_orderkey") % 3 == 0, " Yes").when(F.col("o_orderkey") % 3 == 1, "no").otherwise("")
    io.write_sheet(orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit('a "b"\nc, '), "name").alias("note"), answer.alias("human_acceptable")), path)
    return io.read_sheet(spark, path).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "note")


@query("select 'm' || (o_orderkey % 3) as method, 'r' || (o_orderkey % 2) as run, count(*) as n, sum(o_custkey)::bigint as total from orders group by all")
def io_results(spark, sf_dir):
    """Result files by glob, the method from inside the file."""
    path = scratch(spark, "results")
    rows = orders(spark, sf_dir).groupBy((F.col("o_orderkey") % 3).alias("m"), (F.col("o_orderkey") % 2).alias("r")).agg(F.collect_list(F.struct(F.col("o_custkey").alias("c"))).alias("rows"))
    files = rows.groupBy("m").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("r"), F.col("r").cast("string")), "rows"))).alias("runs"))
    files.select(F.to_json(F.struct(F.struct(F.concat(F.lit("m"), F.col("m").cast("string")).alias("method")).alias("config"), "runs")).alias("value"), "m").write.partitionBy("m").text(path)
    return io.read_results(spark, f"{path}/*/*", "struct<c:bigint>").groupBy(F.regexp_replace("method", r" \[.*", "").alias("method"), "run").agg(F.count("*").alias("n"), F.sum("c").alias("total"))


@query(_WIDE)
def io_first_existing(spark, sf_dir):
    found = io.first_existing(spark, [f"{sf_dir}/none/orders.parquet", f"{sf_dir}/orders.parquet"])
    return _typed(spark.read.parquet(found).withColumnRenamed("o_orderpriority", "name"))


_SPLIT = "with g as (select distinct o_orderkey // 10 as query_id from orders), r as (select query_id, row_number() over (order by md5('42' || query_id::varchar), query_id) - 1 as i, count(*) over () as n from g)"


@query(f"{_SPLIT} select query_id::varchar as query_id, case when i < floor(n * 0.7) then 'train' when i < floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as split from r")
def io_split_manifest(spark, sf_dir):
    """Groups split 70/15/15; the manifest is written and read back."""
    path = scratch(spark, "manifest")
    groups = orders(spark, sf_dir).select(F.expr("o_orderkey div 10").alias("query_id"))
    io.write_manifest(select.split_groups(groups, "query_id", (0.7, 0.15)), path, "query_id", "42", (0.7, 0.15))
    return io.read_manifest(spark, path, "query_id")


@query(f"{_SPLIT}, s as (select query_id, case when i < floor(n * 0.7) then 'train' when i < floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as split from r) select split, count(*) as n, sum(o_orderkey)::bigint as total from orders join s on query_id = o_orderkey // 10 group by split")
def io_splits(spark, sf_dir):
    """Rows by the split of their group, a folder a split, joined back."""
    path = scratch(spark, "splits")
    rows = orders(spark, sf_dir).withColumn("query_id", F.expr("o_orderkey div 10"))
    io.write_splits(rows.join(select.split_groups(rows, "query_id", (0.7, 0.15)), "query_id"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("bigint").alias("total"))


@query("select 'new' as version, count(*) as n from orders where o_orderkey % 2 = 0 union all select 'bak', count(*) from orders")
def io_backup(spark, sf_dir):
    """A table that is replaced twice keeps its first state."""
    path, rows = scratch(spark, "backup"), orders(spark, sf_dir)
    for part in (rows, rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 2 = 0")):
        io.write_with_backup(part, path)
    one = lambda v, p: spark.read.parquet(p).agg(F.lit(v).alias("version"), F.count("*").alias("n"))
    return one("new", path).union(one("bak", path + ".bak"))


@query(_WIDE + " where o_orderkey % 4 <> 1")
def io_resume(spark, sf_dir):
    rows = orders(spark, sf_dir)
    return _typed(io.resume(rows, rows.where("o_orderkey % 4 = 1"), ["o_orderkey"]))


@query(f"with {_PLANS} select 'orders' as data_source, query_id, plan_id, md5(plan_text) as text_md5, 'user' as last_role, quality_score from v_plans where plan_text <> ''")
def io_training_rows(spark, sf_dir):
    path = scratch(spark, "training")
    p = corpus.plans(spark, sf_dir).where("plan_text <> ''").select("*", F.col("plan_id").cast("string").alias("query"), F.lit("train").alias("split"))
    io.training_rows(p, F.lit("orders"), "Plan.").write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("data_source", "extra_info.query_id", F.col("prompt")[1]["content"].cast("bigint").alias("plan_id"), F.md5(F.col("reward_model.ground_truth").cast("binary")).alias("text_md5"), F.col("prompt")[1]["role"].alias("last_role"), "extra_info.quality_score")


# -- faulty plans: ids from 1, every type, missing and extra parameters ---------------

_LITERALS = (("integer", "12"), ("string", "'txt'"), ("array", "[1, 2]"), ("boolean", "True"), ("number", "1.5"), ("object", '{"a": 1}'))
_TYPES = ("integer", "number", "string", "array", "boolean", "object", "any")
_KINDS = "[" + ", ".join(f"'{k}'" for k, _ in _LITERALS) + "]"
_FAULTS = f"""{_STEPS}, d as (select plan_id, pos, pos + 1 as step_id, tool_name, {_KINDS}[(plan_id + pos) % 6 + 1] as kind, ['{"', '".join(_TYPES)}'][plan_id % 7 + 1] as want,
    (plan_id + pos) % 3 > 0 as noted, pos > 0 as back, plan_id % 7 = 3 and pos = 0 as ahead, plan_id % 11 = 5 as nowhere, count(*) over (partition by plan_id) as last, plan_id % 13 = 4 as unknown from v_steps),
viol as (select plan_id, pos, 'unknown_tool' as kind, tool_name || '_x' as detail from d where unknown
  union all select plan_id, pos, 'missing_param', 'note' from d where not unknown and not noted
  union all select plan_id, pos, 'type_mismatch', 'arg_0' from d where not unknown and not (kind = want or want = 'any' or (want = 'number' and kind = 'integer'))
  union all select plan_id, pos, 'forward_ref', '2' from d where not unknown and ahead
  union all select plan_id, pos, 'nonexistent_ref', '2' from d where not unknown and ahead and last < 2
  union all select plan_id, pos, 'forward_ref', '999' from d where not unknown and nowhere
  union all select plan_id, pos, 'nonexistent_ref', '999' from d where not unknown and nowhere)"""


def faulty(spark, sf_dir) -> DataFrame:
    """Plans whose steps count from 1 and whose literals are of every kind; some lack
    a parameter, refer forward or to no step, or call an unknown tool."""
    s = corpus.raw_steps(spark, sf_dir)
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    value = F.get(F.array(*(F.lit(v) for _, v in _LITERALS)), ((F.col("plan_id") + F.col("pos")) % 6).cast("int"))
    maybe = lambda on, p: F.when(on, F.array(p)).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    params = F.concat(
        F.array(pair("arg_0", value), pair("undeclared", F.lit("[1"))),
        maybe((F.col("plan_id") + F.col("pos")) % 3 > 0, pair("note", F.lit("'n'"))),
        maybe(F.col("pos") > 0, pair("arg_1", F.concat(F.lit("[1, {{"), F.col("pos").cast("string"), F.lit("}}]")))),
        maybe((F.col("plan_id") % 7 == 3) & (F.col("pos") == 0), pair("ahead", F.lit("{{2}}"))),
        maybe(F.col("plan_id") % 11 == 5, pair("nowhere", F.lit("see {{999}}"))),
    )
    name = F.when(F.col("plan_id") % 13 == 4, F.concat("tool_name", F.lit("_x"))).otherwise(F.col("tool_name"))
    step = F.struct("pos", (F.col("pos") + 1).cast("int").alias("step_id"), name.alias("tool_name"), params.alias("params"), F.lit("").alias("output_variable"))
    return s.select("plan_id", step.alias("s")).groupBy("plan_id").agg(F.array_sort(F.collect_list("s")).alias("steps"))


def _typed_violations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Plans, and a catalog that asks for another type of ``arg_0`` by plan: it is keyed by tool and plan."""
    p = faulty(spark, sf_dir)
    want = F.get(F.array(*map(F.lit, _TYPES)), (F.col("plan_id") % 7).cast("int"))
    keyed = p.select("plan_id", F.transform("steps", lambda s: s.withField("tool_name", F.concat(s["tool_name"], F.lit("#"), (F.col("plan_id") % 7).cast("string")))).alias("steps"))
    tools = corpus.raw_steps(spark, sf_dir).select("tool_name").distinct().crossJoin(spark.range(7).withColumnRenamed("id", "plan_id"))  # seven types a tool
    cat = tools.select(F.concat("tool_name", F.lit("#"), F.col("plan_id").cast("string")).alias("tool_name"), F.array(F.lit("arg_0"), F.lit("note")).alias("required"), F.create_map(F.lit("arg_0"), want, F.lit("note"), F.lit("string"), F.lit("arg_1"), F.lit("integer")).alias("types"))
    return keyed, cat


@query(f"with {_FAULTS} select plan_id, pos, kind, detail from viol")
def validate_faulty(spark, sf_dir):
    """Every declared parameter against every type; references where ids begin at 1."""
    plans, cat = _typed_violations(spark, sf_dir)
    rows = plans.select("plan_id", F.array_max("steps.step_id").alias("last_step"), F.explode("steps").alias("s")).select("plan_id", "last_step", "s.*")
    return validate.violations(rows, cat).withColumn("detail", F.regexp_replace("detail", "#[0-9]$", ""))


_REPORT = f"{_FAULTS}, n as (select plan_id, count(*) as n from viol group by 1), p as (select distinct plan_id from v_steps), rep as (select plan_id, coalesce(n, 0) + (plan_id % 7 = 3 and exists (select 1 from v_steps v where v.plan_id = p.plan_id and pos = 1))::int as n_errors from p left join n using (plan_id))"


@query(f"with {_REPORT} select plan_id, n_errors = 0 as ok, n_errors::int as n_errors from rep")
def validate_report(spark, sf_dir):
    """(ok, errors) a plan; a forward reference to the next step closes a cycle."""
    plans, cat = _typed_violations(spark, sf_dir)
    return validate.checked(plans, cat).select("plan_id", "ok", F.size("errors").alias("n_errors"))


@query(f"with {_REPORT} select o_orderkey as plan_id from orders join rep on rep.plan_id = o_orderkey // 32 * 32 + 1 where n_errors = 0")
def gold_gate(spark, sf_dir):
    """Candidates of which the gold plan is valid."""
    plans, cat = _typed_violations(spark, sf_dir)
    rows = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.expr("o_orderkey div 32 * 32 + 1").alias("gold_id"))
    return validate.gated(rows, validate.checked(plans, cat), "gold_id").select("plan_id")


@query(f"with {_STEPS} select plan_id, pos, pos % 3 = 0 or pos % 3 = 1 as refers from v_steps")
def recursive_refs(spark, sf_dir):
    """References deep in JSON, in a text and none."""
    s = corpus.raw_steps(spark, sf_dir)
    deep = F.to_json(F.struct(F.array(F.struct(F.lit("{{4}}").alias("x"))).alias("a")))
    value = F.when(F.col("pos") % 3 == 0, deep).when(F.col("pos") % 3 == 1, F.lit("take $var_2.result$ twice")).otherwise(F.lit('{"a": ["{4}", "$var"]}'))
    return s.select("plan_id", "pos", validate.refers(value).alias("refers"))


@query(f"with {_STEPS} select plan_id, pos, case when pos % 4 = 0 then 2 else 1 end as n_params, case when pos % 4 = 0 then '12' else '' end || ['0', '0.0', 'False', '[]', '{{}}', ''''''][pos % 6 + 1] as filled from v_steps")
def default_fill(spark, sf_dir):
    """Required parameters that are missing get a literal of their type."""
    s = corpus.raw_steps(spark, sf_dir)
    have = F.when(F.col("pos") % 4 == 0, F.array(F.struct(F.lit("arg_0").alias("k"), F.lit("12").alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    kind = F.get(F.array(*map(F.lit, ("integer", "number", "boolean", "array", "object", "string"))), (F.col("pos") % 6).cast("int"))
    required = F.when(F.col("pos") % 4 == 0, F.array(F.lit("arg_0"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    filled = render.defaults(have, required, F.create_map(F.lit("x"), kind))
    return s.select("plan_id", "pos", F.size(filled).alias("n_params"), F.array_join(filled["v"], "").alias("filled"))


@query(f"with {_STEPS} select plan_id, pos, case when pos < 2 then 'out' || pos end as expected_output from v_steps")
def expected_outputs(spark, sf_dir):
    p = corpus.parsed(spark, sf_dir).where("size(steps) > 0")
    done = p.select("plan_id", F.explode(render.with_expected(F.col("steps"), F.array(F.lit("out0"), F.lit("out1")))).alias("s"))
    return done.select("plan_id", F.col("s.step_id").alias("pos"), "s.expected_output")


# -- filters ---------------------------------------------------------------------------


@query(f"with {_PLANS} select plan_id, error_type = 'none' and quality_score >= 100 as perfect, coalesce(case when plan_id % 3 > 0 then error_type = 'none' end, quality_score >= 95) as by_type, quality_score between 40 and 75 as in_range, quality_score >= 60 as least_60 from v_plans")
def plan_filters(spark, sf_dir):
    p = corpus.plans(spark, sf_dir)
    known = F.when(F.col("plan_id") % 3 > 0, F.col("error_type"))
    q = F.col("quality_score")
    return p.select("plan_id", filters.perfect(F.col("error_type"), q).alias("perfect"), filters.perfect_by_type(known, q).alias("by_type"), filters.of_score(q, 40, 75).alias("in_range"), filters.of_score(q, 60).alias("least_60"))


@query(f"with {_STEPS}, t as (select replace(p_name, ' ', '_') as tool_name, min(p_partkey) as k from part group by 1) select plan_id from v_steps join t using (tool_name) group by plan_id having bool_and(k % 5 > 0)")
def covered_plans(spark, sf_dir):
    """Plans of which every tool is implemented."""
    tools = corpus.table(spark, sf_dir, "part").groupBy(F.replace("p_name", F.lit(" "), F.lit("_")).alias("tool_name")).agg(F.min("p_partkey").alias("k")).where("k % 5 > 0")
    return filters.covered(corpus.parsed(spark, sf_dir), tools).select("plan_id")


@query(f"with {_PLANS} select plan_id, judge_score >= 100 as stop, judge_score < 70 as reflect, judge_score < 60 as revise, (judge_score >= 80) = (quality_score >= 80) as agrees from v_plans")
def search_predicates(spark, sf_dir):
    s = F.col("judge_score")
    return corpus.plans(spark, sf_dir).select("plan_id", filters.stop(s).alias("stop"), filters.reflect(s).alias("reflect"), filters.revise(s).alias("revise"), filters.agrees(s, F.col("quality_score")).alias("agrees"))


@query(f"with {_COMPARE} select plan_id, case when error_type <> 'none' then exact_match or functional_match end as handled from v_cmp")
def error_type_handled(spark, sf_dir):
    return compared(spark, sf_dir).select("plan_id", filters.handled(F.col("error_type"), F.col("exact_match"), F.col("functional_match")).alias("handled"))


@query("select p_partkey, p_partkey % 3 = 0 as sentence, p_partkey % 2 = 0 as question from part")
def sentence_names(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "part").select("p_partkey")
    five, four = F.lit("who is the first one"), F.lit("first of the four")
    return p.select("p_partkey", text.is_sentence_name(F.when(F.col("p_partkey") % 3 == 0, five).otherwise(four)).alias("sentence"), text.is_sentence_name(F.when(F.col("p_partkey") % 2 == 0, F.lit("Which?")).otherwise(F.lit("Which"))).alias("question"))


# -- aggregates -------------------------------------------------------------------------

_PAIR = f"with {_PLANS}, c as (select distinct prediction as c from v_plans), t as (select c, count(*) filter (prediction = c) as support, count(*) filter (judge_prediction = c) as predicted, count(*) filter (prediction = c and judge_prediction = c) as tp from c, v_plans group by c), s as (select support, round(coalesce(tp / nullif(predicted, 0), 0), 6) as p, round(tp / support, 6) as r, round(2 * tp / (predicted + support), 6) as f from t)"


@query(f"{_PAIR} select round(avg(p), 6) as macro_precision, round(avg(r), 6) as macro_recall, round(avg(f), 6) as macro_f1, round(sum(f * support) / sum(support), 6) as weighted_f1, sum(support)::bigint as support from s")
def judge_prf_averages(spark, sf_dir):
    p = corpus.plans(spark, sf_dir)
    return metrics.averaged(metrics.prf(p, "prediction", "judge_prediction", ["yes", "likely_yes", "uncertain", "likely_no", "no", "none of these"]))


@query(f"with {_COMPARE} select count(*) as n, count(*) filter (valid) as n_valid, round(avg(exact_tool) filter (valid), 6) as exact_tool_accuracy, round(avg(params) filter (valid), 6) as param_accuracy, round(avg(exact_match::int) filter (valid), 6) as exact_match, round(avg(judge_score), 6) as mean_judge_score, min(judge_score) as least_judge_score, max(judge_score) as most_judge_score, round(stddev_pop(judge_score), 6) as judge_score_std, count(*) filter (gen_n = 0) as n_empty, round(avg((gen_n = gold_n)::int), 6) as same_length from v_cmp")
def valid_rows_block(spark, sf_dir):
    """The statistics block over all rows, structural ones over valid rows only."""
    return report.valid_block(compared(spark, sf_dir))


@query(f"with {_PLANS}, r as (select query_id, list(plan_id order by judge_score desc, slot) as l from v_plans group by 1) select query_id, l[1] as best, l[2] as second, len(l)::int as n from r")
def ranked_candidates(spark, sf_dir):
    """A query's candidates by score, equal ones in their order."""
    done = select.ranked_candidates(corpus.plans(spark, sf_dir), "query_id", "judge_score", "slot", "plan_id")
    at = lambda i: F.get("candidates", F.lit(i))["plan_id"]
    return done.select("query_id", at(0).alias("best"), at(1).alias("second"), F.size("candidates").alias("n"))


@query(f"with {_PLANS} select query_id, arg_min(plan_id, slot) as plan_id from v_plans group by query_id")
def first_per_query(spark, sf_dir):
    return select.first_per(corpus.plans(spark, sf_dir), "query_id", "slot").select("query_id", "plan_id")


@query(f"with {_PLANS}, s as (select error_type, round(avg(judge_score), 6) as accuracy from v_plans group by 1) select error_type, accuracy, row_number() over (order by accuracy desc nulls last, error_type) as rank from s")
def summary_sorted(spark, sf_dir):
    from pyspark.sql import Window

    by = corpus.plans(spark, sf_dir).groupBy("error_type").agg(r6(F.avg("judge_score")).alias("accuracy"))  # a row a type
    return by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("accuracy"), "error_type")).cast("bigint"))


@query("select 'joined' as side, count(*) as n from orders join customer on c_custkey = o_custkey where c_custkey % 3 > 0 union all select 'missing', count(*) from orders where o_custkey % 3 = 0 or o_custkey not in (select c_custkey from customer) union all select 'missing keys', count(distinct o_custkey) from orders where o_custkey % 3 = 0 or o_custkey not in (select c_custkey from customer)")
def join_with_missing(spark, sf_dir):
    o = corpus.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = corpus.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).where("k % 3 > 0")
    both, missing = select.joined_with_missing(o, c, "k")
    rows = both.agg(F.lit("joined").alias("side"), F.count("*").alias("n"))
    return rows.union(missing.agg(F.lit("missing"), F.coalesce(F.sum("n"), F.lit(0)))).union(missing.agg(F.lit("missing keys"), F.count("*")))


@query("with g as (select distinct o_orderkey // 10 as query_id from orders) select query_id, case when query_id % 50 = 1 then 'missing' else 'twice' end as fault from g where query_id % 50 in (1, 2) union all select -1, 'unknown'")
def split_coverage(spark, sf_dir):
    """A manifest with gaps, repeats and a stranger."""
    g = orders(spark, sf_dir).select(F.expr("o_orderkey div 10").alias("query_id")).distinct()
    m = g.where("query_id % 50 <> 1").union(g.where("query_id % 50 = 2")).union(spark.createDataFrame([(-1,)], "query_id bigint"))
    return select.uncovered_groups(g, m, "query_id")


@query(f"with {_PLANS}, f as (select *, (judge_score < 3)::int as bad from v_plans) select count(*) as n from f")
def failure_budget(spark, sf_dir):
    """Few calls failed, so all rows stay."""
    p = corpus.plans(spark, sf_dir)
    return report.within_failure_budget(p, F.col("judge_score") < 0, 0.05).agg(F.count("*").alias("n"))


@query(f"with {_PLANS} select plan_id, case when slot = 0 then 'Infinity'::double else round(judge_score / 100.0 + 1.414 * sqrt(ln(10) / slot), 6) end as uct, round(0.5 * judge_score / 100 + 0.5 * confidence, 6)::double as value from v_plans")
def search_values(spark, sf_dir):
    p = corpus.plans(spark, sf_dir)
    u = score.uct(F.col("judge_score") / 100, F.col("slot"), F.lit(10))
    return p.select("plan_id", F.when(u < float("inf"), r6(u)).otherwise(u).alias("uct"), r6(score.node_value(F.col("judge_score"), F.col("confidence"))).alias("value"))


# -- text, names, retrieval ---------------------------------------------------------------


@query(f"with {_PLANS} select plan_id, case when plan_id % 4 = 3 then null else quality_score end as quality_score, case when plan_id % 4 = 3 then null else prediction end as prediction from v_plans")
def json_annotations(spark, sf_dir):
    """Whole annotations out of talk, fences, trailing commas and braces in strings."""
    p = corpus.plans(spark, sf_dir)
    body = F.concat(F.lit('{"quality_score": '), F.col("quality_score").cast("string"), F.lit(', "reasoning": "a } b \\" {", "issues": [{"type": "x",},], "success_prediction": "'), "prediction", F.lit('",}'))
    said = F.when(F.col("plan_id") % 4 == 0, body).when(F.col("plan_id") % 4 == 1, F.concat(F.lit("It's \"fine\":\n```json\n"), body, F.lit("\n``` and {more}"))).when(F.col("plan_id") % 4 == 2, F.concat(F.lit("} so "), body, body)).otherwise(F.concat(F.lit("none { "), F.lit('"a": 1')))
    found = text.json_object(said)
    kind = "struct<quality_score:int,success_prediction:string>"
    one = p.select("plan_id", F.from_json(found, kind).alias("j"))
    return one.select("plan_id", "j.quality_score", F.col("j.success_prediction").alias("prediction"))


_TIER = "case p_partkey % 4 when 0 then 'exact' when 3 then 'none' else 'normalized' end"


@query(f"select p_partkey, {_TIER} as tier, case p_partkey % 4 when 3 then null else replace(lower(p_name), ' ', '_') end as api_name from part")
def name_remap_nfkc(spark, sf_dir):
    """Names in full-width letters and with closing marks; colliding names do not multiply rows."""
    p = corpus.table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    names = p.select(F.col("name").alias("nl"), F.replace("name", F.lit(" "), F.lit("_")).alias("api"))
    wide = F.translate("name", "abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + i) for i in range(26)))
    k = F.col("p_partkey") % 4
    asked = p.select("p_partkey", F.when(k == 0, F.col("name")).when(k == 1, F.concat(F.lit(" "), F.upper("name"), F.lit(" ?"))).when(k == 2, F.concat(wide, F.lit(":"))).otherwise(F.lit("no such tool")).alias("name"))
    return catalog.remapped(asked, "name", names.union(names), "nl", "api", compatible=True)[["p_partkey", "tier", "api_name"]]


@query(f"with {_STEPS}, t as (select distinct replace(p_name, ' ', '_') as tool_name from part) select plan_id, count(*) filter (pos % 3 = 0) as n_exact, count(*) filter (pos % 3 = 1) as n_normalized, count(*) filter (pos % 3 = 2) as n_none, count(*) filter (pos % 3 = 2) as n_left, md5(string_agg(case when pos % 3 = 2 then 'who is the next of these ' || pos else tool_name end, ',' order by pos)) as tools from v_steps group by plan_id")
def remap_dataset(spark, sf_dir):
    """Plans with sentences for tool names; what no name is known for is counted."""
    s = corpus.raw_steps(spark, sf_dir)
    spoken = lambda c: F.concat(F.lit("What is the "), F.replace(c, F.lit("_"), F.lit(" ")), F.lit(" of it?"))
    k = F.col("pos") % 3
    name = F.when(k == 0, spoken("tool_name")).when(k == 1, F.upper(spoken("tool_name"))).otherwise(F.concat(F.lit("who is the next of these "), F.col("pos").cast("string")))
    step = F.struct(F.col("pos").alias("pos"), name.alias("tool_name"))
    plans = s.groupBy("plan_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    names = s.select("tool_name").distinct().select(spoken("tool_name").alias("nl"), F.col("tool_name").alias("api"))
    done = catalog.remap_steps(plans, names, "nl", "api")
    return done.select("plan_id", "n_exact", "n_normalized", "n_none", "n_left", F.md5(F.array_join("steps.tool_name", ",").cast("binary")).alias("tools"))


def _tools(spark, sf_dir):
    return corpus.table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 20").alias("query_id"), "vec_id", "embedding")


@query("with t as (select vec_id // 20 as query_id, vec_id, row_number() over (partition by vec_id // 20 order by vec_id) - 1 as i from embeddings) select query_id, (i // 2)::int as pos, vec_id as tool from (select query_id, i * 2 as i, vec_id from t where i < 3)")
def sgc_retrieve(spark, sf_dir):
    """After smoothing all tools of a query score alike: steps take them in order."""
    t = _tools(spark, sf_dir)
    steps = t.where("vec_id % 20 < 3").select("query_id", (F.col("vec_id") % 20).cast("int").alias("pos"), F.col("embedding").alias("s"))
    return retrieve.sgc_retrieve(t, "query_id", "vec_id", "embedding", steps, "pos", "s")


@query("select vec_id // 20 as query_id, (vec_id % 20)::int as pos, vec_id as tool from embeddings where vec_id % 20 < 5")
def cosine_assign(spark, sf_dir):
    """Without smoothing a step finds the tool whose vector it repeats, scaled."""
    t = _tools(spark, sf_dir)
    steps = t.where("vec_id % 20 < 5").select("query_id", (F.col("vec_id") % 20).cast("int").alias("pos"), F.transform("embedding", lambda x: 3 * x).alias("s"))
    return retrieve.sgc_retrieve(t, "query_id", "vec_id", "embedding", steps, "pos", "s", hops=0)


@query("select vec_id // 20 as query_id, count(*) as n, least(count(*), greatest(1, count(*) // 3))::bigint as clusters, 0::bigint as misplaced from embeddings group by 1")
def kmeans_groups(spark, sf_dir):
    """Clusters a query and how many tools have a nearer centre than their own."""
    t = _tools(spark, sf_dir)
    c = retrieve.kmeans(t, "query_id", "vec_id", "embedding")
    rows = t.join(c, ["query_id", "vec_id"])
    dims = rows.select("query_id", "cluster", F.posexplode("embedding").alias("d", "x")).groupBy("query_id", "cluster", "d").agg(F.avg("x").alias("x"))
    centres = dims.groupBy("query_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("d", "x")))["x"].alias("m"))
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    every = rows.select("query_id", "vec_id", F.col("cluster").alias("own"), "embedding").join(centres, "query_id").select("query_id", "vec_id", "own", "cluster", far("embedding", "m").alias("d"))
    best = every.groupBy("query_id", "vec_id", "own").agg(F.min("d").alias("least"), F.min(F.when(F.col("own") == F.col("cluster"), F.col("d"))).alias("d"))
    return best.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("own").alias("clusters"), F.count_if(F.col("d") > F.col("least") + 1e-6).alias("misplaced"))


@query("select p_partkey, substr(regexp_replace(regexp_replace(lower('-- ' || p_name || ' / No. ' || p_partkey || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) as key from part")
def sanitized_keys(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "part")
    return p.select("p_partkey", text.sanitize_key(F.concat(F.lit("-- "), "p_name", F.lit(" / No. "), F.col("p_partkey").cast("string"), F.lit("!"))).alias("key"))


# -- parsing and execution of faulty text ---------------------------------------------------


@query(f"with {_STEPS}, n as (select plan_id, count(*) as k from v_steps group by 1) select plan_id, k::int as n_steps from n")
def count_steps(spark, sf_dir):
    p = corpus.plans(spark, sf_dir).where("plan_text <> ''")
    return p.select("plan_id", parse.count_steps("plan_text").cast("int").alias("n_steps"))


_STATUS = ("ok", "unknown_tool", "unresolved_ref", "call_error", "ok", "ok", "call_error", "ok", "parse_empty", "ok", "ok")
_LINES = (
    "Step 0: {{0}} = power(base=1000, exponent=2)",
    "Step 0: {{0}} = teleport(arg_0=1)",
    "Step 0: {{0}} = add(arg_0={{3}}, arg_1=1)",
    "Step 0: {{0}} = divide(arg_0=1, arg_1=0)",
    "Step 0: {{0}} = choose(n=600, r=2)",
    "Step 0: {{0}} = add(arg_0='7', arg_1='1,000')",
    "Step 0: {{0}} = power(base=10, exponent=1000000)",
    "Step 0: {{0}} = negate(arg_0=5)\nStep 1: {{1}} = max_number(numbers=['{{0}}', 3, 4])",
    "no steps at all",
    "Step 0: {{5}} = add(arg_0=2, arg_1=3)\nStep 1: {{6}} = multiply(arg_0={{5}}, arg_1={{5}})",
    "Step 0: {{0}} = multiply(arg_0='ab', arg_1=3)",
)
_OUTPUTS = ("1000000", None, None, None, "179700", "1007", None, "4", None, "25", "ababab")
_LIST = lambda xs: "[" + ", ".join("null" if x is None else f"'{x}'" for x in xs) + "]"


@query(f"select o_orderkey as plan_id, {_LIST(_STATUS)}[o_orderkey % 11 + 1] as exec_status, {_LIST(_OUTPUTS)}[o_orderkey % 11 + 1] as exec_output from orders")
def exec_statuses(spark, sf_dir):
    """Plans that end in every way, with types to coerce and bounds to keep."""
    line = F.get(F.array(*map(F.lit, _LINES)), (F.col("o_orderkey") % 11).cast("int"))
    p = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), line.alias("t"))
    specs = {"add": {"types": {"arg_0": "integer", "arg_1": "integer"}}}
    return execute.execute(parse.once(p, "steps", parse.parse_plan("t")).select("plan_id", "steps"), specs=specs).select("plan_id", "exec_status", "exec_output")


_ROBUST = (
    ("```\nStep 0: {{0}} = f(a=1)\n```", 1),
    ("- Step 0: {{0}} = f(a=1)\n* Step 1: {{1}} = g(b={{0}});", 2),
    ("Step 0: {{0}} = f(a=1)\n\nthen nothing", 1),
    ("", 0),
)


@query("select o_orderkey as plan_id, [1, 2, 1, 0][o_orderkey % 4 + 1]::int as n_steps from orders")
def robust_dialect(spark, sf_dir):
    """Fences, bullets and closing semicolons around steps."""
    said = F.get(F.array(*(F.lit(t) for t, _ in _ROBUST)), (F.col("o_orderkey") % 4).cast("int"))
    p = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), said.alias("t"))
    return p.select("plan_id", F.size(parse.parse_plan("t", "robust")).alias("n_steps"))


@query(f"with {_STEPS}, s as (select plan_id, pos from v_steps) select plan_id, pos, case pos % 4 when 0 then 'x' when 1 then 'y' when 2 then 'x' end as tool from s")
def canonical_forms(spark, sf_dir):
    """A step as it should be, with a bare name, without a variable, and none."""
    n = F.col("pos").cast("string")
    k = F.col("pos") % 4
    line = F.when(k == 0, F.concat(F.lit("Step "), n, F.lit(": {{9}} = x(a='b = c')"))).when(k == 1, F.concat(F.lit("Step "), n, F.lit(": out = y()"))).when(k == 2, F.concat(F.lit("Step "), n, F.lit(":x(a=1) "))).otherwise(F.concat(F.lit("Step "), n, F.lit(": 1 + f = z(a)")))
    s = corpus.raw_steps(spark, sf_dir).select("plan_id", "pos", extract.canonical_step(line).alias("line"))
    tool = F.regexp_extract("line", r"\}\} = ([a-z])\(", 1)
    return s.select("plan_id", "pos", F.when(F.col("line").isNotNull(), tool).alias("tool"))



# -- injection by declared type, and the rest of the math functions ---------------------------

_BY_TYPE = "case when pos = mid then case when plan_id % 3 = 0 then '42' else '''invalid_string''' end else qty::varchar end"


@query(_injected(_line(a=_BY_TYPE), changed="true"))
def inject_type_by_spec(spark, sf_dir):
    """A text is put where the catalog asks for a number, a number where it asks for a text."""
    p = corpus.parsed(spark, sf_dir).where("size(steps) > 0")
    kind = F.when(F.col("plan_id") % 3 == 0, "string").when(F.col("plan_id") % 3 == 1, "number").otherwise("array")
    types = F.map_from_entries(F.transform(F.array_distinct("steps.tool_name"), lambda t: F.struct(F.concat(t, F.lit(".arg_0")), kind)))
    done = inject.inject(p.withColumn("types", types), "type_mismatch", types="types")
    return done.select("plan_id", "changed", F.md5(parse.format_plan("injected").cast("binary")).alias("text_md5"))


_MATH = {
    "negate": "-a", "inverse": "1.0 / a", "negate_prob": "1 - b / 10.0", "floor": "floor(a / b)", "lcm": "lcm(a, b)", "min_number": "least(a, b)",
    "speed": "a / b", "rectangle_area": "a * b", "rectangle_perimeter": "2 * (a + b)", "triangle_area": "a * b / 2", "rhombus_area": "a * b / 2",
    "square_area": "a * a", "square_perimeter": "4 * a", "square_edge_by_area": "sqrt(a)", "square_edge_by_perimeter": "a / 4", "circumface": "2 * pi() * a",
    "surface_sphere": "4 * pi() * a * a", "volume_cylinder": "pi() * a * a * b", "surface_cylinder": "2 * pi() * a * (a + b)", "volume_cone": "pi() * a * a * b / 3",
    "volume_cube": "a * a * a", "surface_cube": "6 * a * a", "cube_edge_by_volume": "pow(a, 1.0 / 3)", "power": "pow(a, b)", "subtract": "a - b",
    "permutation": "(b + 2) * (b + 1)", "choose": "(b + 2) * (b + 1) / 2", "factorial": "factorial(b::int)", "reminder": "a % b", "log": "trunc(ln(a + 0.5) / ln(2))",
}
_MATH_SQL = ", ".join(f"round(({e})::double, 4) as {k}" for k, e in _MATH.items())


@query(f"with t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_quantity)::bigint as a, l_linenumber::bigint as b from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_MATH_SQL} from t")
def math_formulas(spark, sf_dir):
    t = corpus.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_quantity").alias("a"), F.col("l_linenumber").cast("bigint").alias("b"))
    a, b = F.col("a"), F.col("b")
    special = {
        "inverse": (a.cast("double"),), "negate_prob": (b / 10,), "floor": (a / b,), "min_number": (F.array(a, b),), "permutation": ((b + 2).cast("int"), F.lit(2)),
        "choose": ((b + 2).cast("int"), F.lit(2)), "factorial": (b.cast("int"),), "log": (a + 0.5, F.lit(2)),
    }
    two = {"lcm", "speed", "rectangle_area", "rectangle_perimeter", "triangle_area", "rhombus_area", "volume_cylinder", "surface_cylinder", "volume_cone", "power", "subtract", "reminder"}
    value = lambda k: maths.MATH[k](*special.get(k, (a, b) if k in two else (a,)))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.round(value(k).cast("double"), 4).alias(k) for k in _MATH))


# -- faulty plans beside their gold, descent in a search tree ---------------------------------


@query(f"with {_STEPS} select plan_id, pos, case when pos % 3 = 1 then 'note' else '' end as missing, case when pos % 3 = 1 then 'x' else '' end as extra, case when pos % 3 = 0 then 'note' else '' end as incorrect, pos % 3 < 2 as exact_tool_correct from v_steps")
def step_details_faulty(spark, sf_dir):
    """Plans with wrong, missing and extra parameters and other tools, against themselves."""
    p = corpus.parsed(spark, sf_dir).where("size(steps) > 0")
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"))

    def spoiled(s: Column) -> Column:
        other = F.filter(s["params"], lambda q: q["k"] != "note")
        params = F.when(s["pos"] % 3 == 0, F.concat(other, F.array(pair("note", "'none of it'")))).when(s["pos"] % 3 == 1, F.concat(other, F.array(pair("x", "1")))).otherwise(s["params"])
        name = F.when(s["pos"] % 3 == 2, F.concat(s["tool_name"], F.lit("_x"))).otherwise(F.concat(F.lit(" "), F.upper(s["tool_name"])))
        return s.withField("params", params).withField("tool_name", name)

    rows = p.select("plan_id", F.transform("steps", spoiled).alias("steps"), F.col("steps").alias("gold_steps"))
    return compare.step_details(rows, "steps", "gold_steps", "plan_id").select("plan_id", "pos", "missing", "extra", "incorrect", "exact_tool_correct")


_NODE = "select {0}, count(*) as visits, avg(l_quantity)::double as q from lineitem group by {0}"


@query(f"with a as ({_NODE.format('l_returnflag')}), b as ({_NODE.format('l_returnflag, l_linestatus')}), x as (select l_returnflag from a order by q desc, visits desc, l_returnflag limit 1), c as ({_NODE.format('l_returnflag, l_linestatus, l_linenumber')}), y as (select * from b where l_returnflag in (select l_returnflag from x) order by q desc, visits desc, l_linestatus limit 1) select l_returnflag, l_linestatus, l_linenumber from c where (l_returnflag, l_linestatus) in (select l_returnflag, l_linestatus from y) order by q desc, visits desc, l_linenumber limit 1")
def search_descent(spark, sf_dir):
    """From the root to the leaf of the best child at every level."""
    path = ["l_returnflag", "l_linestatus", "l_linenumber"]
    nodes = score.backpropagated(corpus.table(spark, sf_dir, "lineitem").select(*path, F.col("l_quantity").cast("double").alias("reward")), path, "reward")
    return score.descend(nodes.withColumn("prior", F.lit(0.5)), path, "prior")
