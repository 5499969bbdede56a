"""Plan operators on hand inputs and properties."""

import gzip
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from planlens.functions import maths, text
from planlens import sql
from planlens.operators import catalog, execute, metrics, report, select
from planlens.plans import compare, extract, inject, parse, render, validate
from planlens.sources import io
from planlens.streaming import running

P1 = "Step 0: {{0}} = unique_common_values(list1=[1, 2, 3], list2=[4, 5, 6])\nStep 1: {{1}} = swap_by_index(values={{0}}, i=0, j=1)"
P2 = P1.replace("{{0}} = ", "").replace("{{1}} = ", "")
P3 = P1.replace("{{0}} =", "var0 =").replace("{{1}} =", "var1 =").replace("values={{0}}", "values=var0")
V = "Step 0: {{0}} = add(arg_0=2, arg_1=3)\nStep 1: {{1}} = multiply(arg_0={{0}}, arg_1=4)\nStep 2: {{2}} = add(arg_0={{1}}, arg_1=1)"


def parsed(spark, *texts, dialect="strict"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "plan_id int, t string")
    return parse.once(df, "steps", parse.parse_plan("t", dialect)).orderBy("plan_id")


def steps(spark, t, dialect="strict"):
    return [(s.step_id, s.tool_name, {p.k: p.v for p in s.params}, s.output_variable) for s in parsed(spark, t, dialect=dialect).first().steps]


def test_dialects(spark):
    want = [(0, "unique_common_values", {"list1": "[1, 2, 3]", "list2": "[4, 5, 6]"}, "{{0}}"), (1, "swap_by_index", {"values": "{{0}}", "i": "0", "j": "1"}, "{{1}}")]
    assert steps(spark, P1) == want and steps(spark, P1, "lenient") == want and steps(spark, P1, "robust") == want
    assert steps(spark, P2) == [] and steps(spark, P2, "lenient") == want and steps(spark, P2, "robust") == want
    assert steps(spark, P3, "robust") == want
    assert steps(spark, "```python\n**Action 3)** {1} = f(a={0}, b='x)', c=[1, 2]\n```", "robust")[0][1] == "f"
    assert steps(spark, "prose\n\nStep x: {{0}} = f()\n  Step 4: {{4}} = g()  ") == [(4, "g", {}, "{{4}}")]
    assert steps(spark, None) == [] and steps(spark, "", "robust") == []


def test_arguments(spark):
    assert steps(spark, "Step 0: {{0}} = f(a='x, y', b=[1,2], c=g(1,2), junk, a=last)")[0][2] == {"a": "last", "b": "[1,2]", "c": "g(1,2)"}


def split_slowly(text):
    pieces, depth, quote = [""], 0, ""
    for c in text:
        if quote or c in "'\"":
            quote = "" if c == quote else (quote or c)
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            pieces.append("")
            continue
        pieces[-1] += c
    return pieces


def test_splitting_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "b=", ",", ", ", "'", "'x, y'", '"', '"p,"', "(", ")", "[", "]", "{{1}}", "{", "}", " ", "\n"], k=rng.randrange(14))) for _ in range(1500)]
    texts += ["k=v, " * 1000, "k='" + "v, " * 900 + "', z=1", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", F.expr(parse.split_args("t")).alias("p"))
    for r in df.collect():
        assert [x for x in r.p if x] == [x for x in split_slowly(r.t) if x], r.t


def test_round_trip(spark):
    df = parsed(spark, P1, V).withColumn("again", parse.format_plan("steps"))
    assert all(r.t == r.again for r in df.collect())


def test_gold_against_itself(spark):
    r = compare.compare(parsed(spark, V).withColumn("gold_steps", F.col("steps"))).first()
    assert r.exact_match and (r.exact_tool_accuracy, r.param_accuracy, r.dependency_accuracy) == (1, 1, 1)
    assert r.functional_tool_accuracy == 1 and r.functional_match
    e = compare.compare(parsed(spark, "").withColumn("gold_steps", F.col("steps"))).first()
    assert not e.valid and e.dependency_accuracy == 0 and not e.exact_match


@pytest.mark.parametrize("kind", ["type_mismatch", "missing_dependency", "parameter_typo", "circular_dependency", "incomplete_plan", "unnecessary_steps", "forward_reference"])
def test_injectors_change_the_text(spark, kind):
    df = inject.inject(parsed(spark, V), kind).withColumn("new", parse.format_plan("injected"))
    r = df.first()
    assert r.changed and r.new != r.t
    if kind == "circular_dependency":
        assert validate.cyclic(validate.exploded(df.select("plan_id", F.col("injected").alias("steps")), "plan_id")).count() == 1
    if kind == "unnecessary_steps":
        assert r.new.split("\n")[1:] == ["Step 1: {{1}} = add(arg_0=2, arg_1=3)", "Step 2: {{2}} = multiply(arg_0={{0}}, arg_1=4)", "Step 3: {{3}} = add(arg_0={{2}}, arg_1=1)"]


def test_order_injection(spark):
    assert not inject.inject(parsed(spark, V), "inefficient_order").first().changed
    free = V.replace("multiply(arg_0={{0}}", "multiply(arg_0=9")
    assert [s.step_id for s in inject.inject(parsed(spark, free), "inefficient_order").first().injected] == [1, 0, 2]
    assert inject.inject_first(parsed(spark, V), ["inefficient_order", "incomplete_plan"]).first().injected_type == "incomplete_plan"


def test_wrong_tool(spark):
    df = parsed(spark, V).withColumn("all_tools", F.array(*map(F.lit, ("add", "multiply", "negate"))))
    assert inject.inject(df, "wrong_tool").first().injected[1].tool_name in ("add", "negate")


def test_wrong_tool_prefers_what_fails(spark):
    spec = lambda n, *r: F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, r)).cast("array<string>").alias("required"))
    for specs, want in (([spec("multiply", "z"), spec("a", "arg_0", "arg_1"), spec("b", "arg_0"), spec("c", "x"), spec("d")], "c"), ([spec("a", "arg_1", "arg_0"), spec("b", "arg_0"), spec("d")], "b"), ([spec("a", "arg_1", "arg_0")], "a")):
        r = parsed(spark, V).withColumn("specs", F.array(*specs)).select(inject.injector("wrong_tool", specs="specs").alias("r")).first().r
        assert r.changed and r.steps[1].tool_name == want


def test_typos(spark):
    typo = lambda t: inject.inject(parsed(spark, t), "parameter_typo").select("changed", parse.format_plan("injected").alias("t")).first()
    assert typo("Step 0: {{0}} = f(a='abc', b='word', c=1)").t == "Step 0: {{0}} = f(a='abc', b='woxrd', c=1)"
    assert typo("Step 0: {{0}} = f(a=2.5)").t == "Step 0: {{0}} = f(a=2.75)" and typo("Step 0: {{0}} = f(a=-3)").t == "Step 0: {{0}} = f(a=-2)"
    assert typo("Step 0: {{0}} = f(a='abc')\nStep 1: {{1}} = g(s='words', n=9)").t.endswith("g(s='words', n=10)") and not typo("Step 0: {{0}} = f(a='abc')").changed


def test_first_family(spark):
    made = lambda t, kind: parsed(spark, t).select(inject.injector_v1(kind).alias("r")).select("r.changed", parse.format_plan("r.steps").alias("t")).first()
    two = "\n".join(V.split("\n")[:2])
    assert made(two, "missing_dependency").t.endswith("multiply(arg_0='hardcoded_value', arg_1=4)") and not made(V.split("\n")[0], "missing_dependency").changed
    assert made(two, "type_mismatch").t.endswith("multiply(arg_0={{0}}, arg_1='invalid_string')") and made("Step 0: {{0}} = f(a='x')", "type_mismatch").t == "Step 0: {{0}} = f(a=42)"
    assert made("Step 0: {{0}} = f(n=12345, a='word')", "parameter_typo").t == "Step 0: {{0}} = f(n=12345, a='woxrd')" and not made(V, "parameter_typo").changed
    assert not made(two, "inefficient_order").changed and not made(two, "forward_reference").changed and made(two, "incomplete_plan").changed


def test_quota():
    slots = inject.quota_slots(10, {"none": 0.15, "a": 0.5, "b": 0.1, "c": 0.1})
    assert slots == ["none", "a", "a", "a", "a", "b", "c", "a", "b", "c"]


def test_split_sizes_are_of_decimal_shares(spark):
    """In doubles 10 * 0.7 is 7.0, but 90 * 0.7 is 62.99 and more."""
    out = select.split_groups(spark.range(90).withColumnRenamed("id", "k"), "k", (0.7, 0.15))
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 63, "val": 13, "test": 14}


def test_metrics(spark):
    s = spark.createDataFrame([(100, True), (90, True), (80, True), (80, False), (70, False)], "s int, p boolean")
    assert metrics.auc(s, "s", F.col("p")).first().auc == round(5.5 / 6, 6)
    one = spark.createDataFrame([("y", "y")] * 3, "a string, b string")
    assert metrics.kappa(one, "a", "b").first().kappa == 1
    sure = spark.createDataFrame([(1.0,)], "c double")
    assert metrics.ece(sure, "c", F.lit(True)).first().ece == 0
    assert spark.range(1, 5).agg(metrics.upper_median("id")).first()[0] == 3
    cand = spark.createDataFrame([(0, 0, 90, 0.5, "aaa"), (0, 1, 90, 0.5, "aa"), (0, 2, 80, 0.9, "a")], "q int, i int, s int, c double, t string")
    assert select.best_of_n(cand, "q", "i", "s", "c", "t").first().best_idx == 1


def test_execution(spark):
    got = [tuple(r)[-3:] for r in execute.execute(parsed(spark, V, "", V.replace("multiply", "nope"), V.replace("{{0}},", "{{7}},"), "Step 0: {{0}} = divide(arg_0=1, arg_1=0)").drop("t")).orderBy("plan_id").collect()]
    assert got == [("ok", "21", None), ("parse_empty", None, None), ("unknown_tool", None, 1), ("unresolved_ref", None, 1), ("call_error", None, 0)]
    pair = spark.createDataFrame([("71.42857", "71.4", True, True), (" 'Paris' ", "paris", True, True), ("in Paris", "Paris", False, True), ("1", "2", False, False), (None, "2", False, False)], "got string, gold string, s boolean, l boolean")
    strict, lenient = execute.answers_match(F.col("got"), F.col("gold"))
    assert pair.where((strict != F.col("s")) | (lenient != F.col("l"))).count() == 0


ARGS = {"max_number": ([7, -2],), "min_number": ([7, -2],), "permutation": (5, 2), "choose": (5, 2), "factorial": (5,), "log": (100, 3), "gcd": (12, 18), "lcm": (4, 6), "floor": (2.7,), "sqrt": (17,), "negate": (3,), "inverse": (4,), "negate_prob": (0.3,), "square_area": (3,), "square_perimeter": (3,), "square_edge_by_area": (9,), "square_edge_by_perimeter": (8,), "circle_area": (2,), "circumface": (2,), "surface_sphere": (2,), "volume_sphere": (2,), "volume_cube": (2,), "surface_cube": (2,), "cube_edge_by_volume": (27,)}


def test_math_agrees_with_the_interpreter(spark):
    assert set(maths.MATH) == set(execute.REGISTRY) and len(maths.MATH) == 40
    lit = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)
    cols = [maths.MATH[n](*map(lit, ARGS.get(n, (7, -2)))).cast("double").alias(n) for n in maths.MATH]
    row = spark.range(1).select(*cols).first()
    for n, fn in execute.REGISTRY.items():
        assert math.isclose(row[n], float(fn(*ARGS.get(n, (7, -2)))), rel_tol=1e-9), n


def test_text(spark):
    t = spark.createDataFrame([("Ｆoo？", "What is it?")], "a string, b string")
    r = t.select(text.nfkc(F.col("a")).alias("n"), text.is_sentence_name(F.col("b")).alias("s"), text.sanitize_key(F.col("b")).alias("k")).first()
    assert tuple(r) == ("Foo?", True, "what_is_it")


def test_sources(spark, tmp_path):
    record = {"query_id": 1, "query": "q", "plan": {"steps": [], "error_type": "none"}, "annotation": {"quality_score": 90}}
    (tmp_path / "e.json").write_text(json.dumps({"metadata": {"model": "m"}, "data": [record]}, indent=1))
    with gzip.open(tmp_path / "z.json.gz", "wt") as f:
        json.dump({"metadata": {}, "data": [record, record]}, f)
    assert io.read_envelope(spark, str(tmp_path / "e.json"))[0].first().annotation.quality_score == 90
    assert io.read_envelope(spark, str(tmp_path / "z.json.gz"))[0].count() == 2
    forms = {"list": '[{"a": 1}, {"a": 2}]', "data": '{"data": [{"a": 1}, {"a": 2}]}', "keys": '{"x": {"a": 1}, "y": {"a": 2}}', "lines": '{"a": 1}\n\n{"a": 2}\n'}
    for name, body in forms.items():
        (tmp_path / name).write_text(body)
        assert sorted(r.a for r in io.read_any_json(spark, str(tmp_path / name), "struct<a:int>").collect()) == [1, 2], name
    sheet = spark.createDataFrame([("1", 'a\n"b"', "yes"), ("2", "c", "maybe")], "item_id string, plan string, human_acceptable string")
    io.write_sheet(sheet, str(tmp_path / "sheet"))
    assert [r.plan for r in io.read_sheet(spark, str(tmp_path / "sheet")).collect()] == ['a\n"b"']
    for n in (1, 2, 3):
        io.write_with_backup(spark.range(n), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3 and spark.read.parquet(str(tmp_path / "t.bak")).count() == 1
    spark.createDataFrame([('{"a": 1}',)], "x string").write.parquet(str(tmp_path / "n"))
    assert io.read_nested_parquet(spark, str(tmp_path / "n"), {"x": "struct<a:int>"}).first().x.a == 1
    (tmp_path / "r1.json").write_text(json.dumps({"config": {"method": "m"}, "runs": {"full": [{"q": 1}]}}))
    (tmp_path / "r2.json").write_text(json.dumps({"config": {"method": "m"}, "runs": {"full": [{"q": 2}]}}))
    assert sorted(r.method for r in io.read_results(spark, str(tmp_path / "r?.json"), "struct<q:int>").collect()) == ["m", "m [r2]"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id)").alias("ts"), F.col("id").alias("v"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = running.read_stream(spark, str(tmp_path / "in"), "ts timestamp_ntz, v bigint", 2)
    running.run_available(running.windowed_counts(stream, "ts", "v", "1 hour", "500 hours"), str(tmp_path / "out"), str(tmp_path / "cp"))
    stream.sparkSession.read.parquet(str(tmp_path / "in")).count()
    batch = running.windowed_counts(rows, "ts", "v", "1 hour")
    assert sum(r.n for r in batch.collect()) == 200


def test_extraction(spark):
    one = lambda c, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(c).first()[0]
    c = F.col
    assert one(extract.first_step(c("c0")), "Step 0: {{0}} = f(a='(')\nStep 1: g()") == "Step 0: {{0}} = f(a='(')"
    assert one(extract.first_step(c("c0")), "Step 4: x1 = f() ") == "Step 4: {{4}} = f()" and one(extract.first_step(c("c0")), "nothing") is None
    assert one(extract.assign(c("c0")), "  Step 2 : f(x) ") == "Step 2: {{2}} = f(x)" and one(extract.assign(c("c0")), "Note: x") == "Note: x"
    assert one(extract.react_plan(c("c0")), None) == "" and one(extract.step_lines(c("c0")), "a\n Step 1: x\n") == "Step 1: x"
    assert one(extract.decision(c("c0"), F.lit(1)), None) == "caller" and one(extract.decision(c("c0"), F.lit(1)), "NEXT: Give Up before conclusion") == "give up"
    assert one(extract.candidates(c("c0"), 2), None) == [] and one(extract.candidates(c("c0"), 2), "no\nCandidate 3: COMPLETED") == []
    assert one(extract.repair(c("c0"), F.lit(0), F.lit("t")), None) is None
    assert one(extract.label_refs(c("c0"), F.array(F.lit("$var1"))), "$var_1.x$$var_1.y$, $var_2.z$") == "{{0}}{{0}}, $var_2.z$"
    a = one(extract.annotation(c("c0"), c("c0"), c("c0"), c("c0")), None)
    assert tuple(a) == (50, "uncertain", 0.5, False)
    assert one(extract.annotation(F.lit("50"), F.lit("yes"), F.lit("0"), c("c0")), "quality_score: 999").quality_score == 100


def test_rendering(spark):
    row = lambda c: spark.range(1).select(c).first()[0]
    for x in ("a", "it's", 'say "x"', "both ' and \"", "back\\slash", "two\nlines\tand tabs", ""):
        assert row(render.literal(F.lit(x))) == repr(x)
    ids = lambda *x: F.array(*map(F.lit, x))
    assert tuple(row(render.masked_labels(ids(1, 2), ids(3, 4), 3))) == ([1, 2, 3], [-100, -100, 3])
    assert row(render.masked_labels(ids(1, 2), ids(3), 2)) is None
    assert [m.role for m in row(render.chat(F.lit("s"), F.lit("u")))] == ["system", "user"]


def test_catalogs(spark):
    t = spark.createDataFrame([(1, 2, "x", "b"), (1, 1, "x", "a"), (1, 3, "y", "c")], "q int, ord int, api string, nl string")
    assert sorted((r.api, r.nl) for r in catalog.by_api_name(t, "q", "nl", "ord", "api").collect()) == [("x", "a"), ("y", "c")]
    s = spark.createDataFrame([(None,), ("{}",), ('{"a": "int", "b": null}',)], "s string").select(catalog.parameters(F.col("s")).alias("p")).collect()
    assert s[0].p is None and s[1].p == [] and [(x.name, x.type) for x in s[2].p] == [("a", "int"), ("b", "any")]
    g = spark.createDataFrame([(1, [[0.1, 0.1], [0.9, 0.9], [0.0, 0.2]], ["u", "v"]), (2, [[1.0]], [])], "q int, s array<array<double>>, t array<string>")
    assert [r.tool for r in catalog.greedy_assign(g, "q", "s", "t").orderBy("pos").collect()] == ["u", "v", "v"]


def call(pos, tool, **params):
    return {"pos": pos, "step_id": pos, "tool_name": tool, "params": [{"k": k, "v": v} for k, v in params.items()], "output_variable": f"{{{{{pos}}}}}"}


def test_interpreter_calls():
    run = execute.run_plan
    assert run([call(0, "subtract", arg_1="1", arg_0="5"), call(1, "power", arg_0="{{0}}", arg_1="2")]) == ("ok", "16", None)
    assert run([call(0, "add", arg_0="1", other="2")])[0] == "call_error" and run([call(0, "add", arg_0="{{3}}", arg_1="2")])[0] == "unresolved_ref"
    assert run([call(0, "max_number", numbers="[1, '{{9}}']")])[0] == "unresolved_ref" and run([call(0, "t", a="1")], {"t": lambda a: {"error": "no"}})[0] == "tool_error"
    picky = {"t": lambda a, opt=None: {"error": "bad opt"} if opt else {"result": {"value": a}}}
    assert run([call(0, "t", a="4", opt="2")], picky, {"t": {"required": ["a"]}}) == ("ok", "4", None)
    assert run([call(0, "add", arg_0="'1,000'", arg_1="2")], specs={"add": {"types": {"arg_0": "integer"}}}) == ("ok", "1002", None)
    big = [call(0, "power", base="500", exponent="500"), call(1, "power", base="{{0}}", exponent="500")]
    assert run(big)[0] == "call_error" and run(big[:1])[1] and run([call(0, "multiply", arg_0="'ab'", arg_1="999999999")])[0] == "call_error"
    assert run([call(i, "negate", number="1") for i in range(201)])[0] == "timeout"


def test_grounded_runs():
    hops = [{"tool": "find", "question": "who?", "answer": "Alan Dale"}, {"tool": "born", "question": "when?", "answer": "1947"}]
    run = execute.run_grounded
    assert run([call(0, "find", q="'x'"), call(1, "born", p="{{0}}")], hops, "q") == ("ok", "1947", None)
    assert run([call(0, "find", q="'x'"), call(1, "when?", p="['Mr {{0}}']")], hops, None)[0] == "ok"
    assert run([call(0, "find", q="'x'"), call(1, "born", p="'Bob'")], hops, "q") == ("tool_error", None, 1)
    assert run([call(0, "born", p="'big show'")], hops, "The big  show now")[0] == "ok" and run([call(0, "zz")], hops, "")[0] == "unknown_tool"
    assert run([], hops, "")[0] == "parse_empty" and run([call(0, "find")], [], "")[0] == "uncovered"


def test_sql_surface(spark):
    sql.register(spark)
    spark.createDataFrame([(1, V), (2, None), (3, P2)], "i int, t string").createOrReplaceTempView("written")
    assert [tuple(r) for r in spark.sql("select i, pos, tool_name from written, lateral parse_plan(t) order by 1, 2").collect()] == [(1, 0, "add"), (1, 1, "multiply"), (1, 2, "add")]
    assert spark.sql("select count(*) from written, lateral parse_plan_mixed(t)").first()[0] == 5


def test_failure_budget(spark):
    calls = spark.range(100).withColumn("failed", F.col("id") < 6)
    assert report.within_failure_budget(calls.where("id > 0"), F.col("failed") & (F.col("id") > 2)).count() == 99
    with pytest.raises(RuntimeError):
        report.within_failure_budget(calls, F.col("failed"))


def test_json_in_blocks(spark, tmp_path):
    """Files of every form, cut at blocks of a few hundred bytes, against Python's own reader."""
    import random

    rng = random.Random(3)
    parts = ['a', '"', "\\", "{", "}", "[", "]", ",", ":", " ", "\n", "é", "data", '"data":[', "}]", "\\}"]
    text = lambda: "".join(rng.choices(parts, k=rng.randrange(9)))
    record = lambda i: {"a": i, "t": text(), "n": {"x": 2 * i, "l": [text() for _ in range(rng.randrange(3))]}}
    dump = lambda o: json.dumps(o, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
    want, at = [], 0
    for k in range(4):
        for form in ("list", "data", "first", "items", "lines", "empty"):
            n = {"empty": 0, "lines": 20}.get(form, (1, 2, 25, 40)[k])
            rows = [record(at + i) for i in range(n)]
            at += n
            meta = {"m": {"q": text(), "z": {"w": [1, [2]]}}, "v": [[{"a": 5}], "}"]}
            value = {"data": {**meta, "data": rows, "tail": {"data": [{"a": 1}]}}, "first": {"data": rows, "m": [{}]}, "items": {f'{i}"{text()}': r for i, r in enumerate(rows)}, "empty": {**meta, "data": []}}.get(form, rows)
            (tmp_path / f"{form}{k}").write_text("\n".join(json.dumps(r) for r in rows) + "\n" if form == "lines" else dump(value) + rng.choice(["", "\n"]), encoding="utf-8")
            want += rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        got = io.read_any_json(spark, str(tmp_path), "struct<a:bigint,t:string,n:struct<x:bigint,l:array<string>>>").drop("key")
        assert sorted((r.asDict(True) for r in got.collect()), key=lambda r: r["a"]) == want
        records, meta = io.read_envelope(spark, str(tmp_path / "data3"), "metadata struct<q:string>, data array<struct<a:bigint>>")
        assert [r.ord for r in records.orderBy("ord").collect()] == list(range(40)) and meta.count() == 1
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "data3")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
