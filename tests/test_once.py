"""Work that is done once, where it was done over and over; results as before."""

import ast
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planlens import queries
from planlens.functions import literals
from planlens.operators import execute
from planlens.plans import compare, corpus, inject, parse
from planlens.sources import blocks

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def steps_of(spark, *texts):
    return parse.once(spark.createDataFrame(list(enumerate(texts)), "plan_id long, t string"), "steps", parse.parse_plan("t")).drop("t")


@pytest.fixture
def plans(spark):
    return steps_of(
        spark,
        "Step 0: {{0}} = a(x=1, y=2)\nStep 1: {{1}} = b(x={{0}})\nStep 2: {{2}} = c(x={{0}}, y={{1}})",
        "Step 0: {{0}} = a(x=1)\nStep 1: {{1}} = b(x=2)",  # nothing refers: the last step refers to itself
        "Step 0: {{0}} = a()\nStep 1: {{1}} = b()",
        "Step 0: {{0}} = a(x=1)",
        "",
    )


def test_circular_dependency_matches_no_pattern_made_per_row(plans):
    out = inject.inject(plans, "circular_dependency")
    assert " LIKE concat" not in plan_of(out)
    got = {r["plan_id"]: (r["changed"], r["t"]) for r in out.select("plan_id", "changed", parse.format_plan("injected").alias("t")).collect()}
    assert got[0] == (True, "Step 0: {{0}} = a(x={{1}}, y=2)\nStep 1: {{1}} = b(x={{0}})\nStep 2: {{2}} = c(x={{0}}, y={{1}})")
    assert got[1] == (True, "Step 0: {{0}} = a(x=1)\nStep 1: {{1}} = b(x={{1}})")
    assert [got[i][0] for i in (2, 3, 4)] == [False] * 3


def test_compound_tries_stay_in_their_row(plans):
    got = inject.compound_tried(plans, 2, ("type_mismatch", "inefficient_order", "unnecessary_steps", "incomplete_plan"))
    assert "Join" not in plan_of(got) and "Aggregate" not in plan_of(got)
    rows = {r["plan_id"]: r for r in got.collect()}
    assert set(rows) == {0, 1, 2}  # one step leaves only the mismatch, no step nothing
    assert list(rows[0]["errors"]) in (["type_mismatch", "unnecessary_steps"], ["type_mismatch", "incomplete_plan"], ["unnecessary_steps", "incomplete_plan"])
    assert all(r["tried"] < 25 for r in rows.values())


def test_wrong_tool_without_requirements_ranks_nothing(plans):
    out = inject.inject(plans.withColumn("all_tools", F.array(F.lit("a"), F.lit("b"), F.lit("z"))), "wrong_tool")
    assert "array_union" not in plan_of(out)
    got = {r["plan_id"]: r["changed"] for r in out.collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False}
    assert not any(r["changed"] for r in inject.inject(plans.withColumn("all_tools", F.array(F.lit("b"), F.lit("b"))), "wrong_tool").where("plan_id < 3").collect())


def test_pieces_above_the_list_are_folded_once(spark, tmp_path, monkeypatch):
    kept, keep = {}, blocks.keep
    monkeypatch.setattr(blocks, "keep", lambda df, name: kept.setdefault(name, keep(df, name)))
    (tmp_path / "f.json").write_text('{"k0": {"a": "x]}{\\"", "b": 1}, "k1": {"a": "{", "b": 2},\n "data2": {"a": "}", "b": 3}, "k3": {"a": "", "b": 4, "c": [{"d": 1}]}}')
    records, _ = blocks.documents(spark, str(tmp_path), ["a"])
    assert {r["form"] for r in records.collect()} == {"items"} and records.count() == 4
    assert kept["objects"].where("from_in is not null").count() < kept["objects"].where("from_out is not null").count()


def test_a_plan_that_is_settled_is_not_written_again(spark, monkeypatch):
    kept, keep = {}, execute.keep
    monkeypatch.setattr(execute, "keep", lambda df, name: kept.setdefault(name, keep(df, name)))
    p = steps_of(spark, "Step 0: {{0}} = add(arg_0=1, arg_1=2)", "Step 0: {{0}} = add(arg_0='a', arg_1='b')")
    assert {r["plan_id"]: r["exec_output"] for r in execute.execute(p).collect()} == {0: "3", 1: "ab"}
    assert [r["n"] for r in kept["ran"].select(F.size("row.steps").alias("n"), "ran.left").orderBy("left").collect()] == [None, 1] or kept["ran"].where("row.steps is not null").count() == 1


def test_small_tables_are_spread(spark):
    assert corpus.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_objects_of_arrow_columns():
    kind = pa.list_(pa.struct([("a", pa.string()), ("b", pa.list_(pa.struct([("c", pa.int32())])))]))
    rows = [[{"a": "x", "b": [{"c": 1}, {"c": None}]}, {"a": None, "b": None}], None, [], [None, {"a": "y", "b": []}], [{"a": "z", "b": [None]}]]
    column = pa.array(rows, kind)
    for part in (column, column[1:], column[2:4], column[:0]):
        assert execute._objects(part) == part.to_pylist()


@pytest.mark.parametrize("text", ["'a'", '"a b"', "''", "'it\\'s'", "'a' 'b'", "'a\nb'", "\"it's\"", "'", "x'", "'''a'''"])
def test_literals_as_the_parser_reads_them(text):
    try:
        want = ast.literal_eval(text)
    except (ValueError, SyntaxError):
        want = text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text
    assert execute.literal(text) == want


def test_floats_and_texts_as_python_prints_them(spark):
    r = random.Random(5)
    numbers = [f"{r.choice(['', '-'])}{r.randrange(10 ** r.randrange(1, 16))}.{r.randrange(10 ** r.randrange(1, 9))}" for _ in range(300)]
    numbers += [f"{r.randrange(1, 10 ** r.randrange(1, 8))}.{r.randrange(1000)}e{r.randrange(-12, 20)}" for _ in range(300)]
    numbers += ["0.0", "-0.0", "0.0001", "0.00009", "1e15", "1e16", "999999999999999.0", "9999999999999999.0", "1.50", "-12.500e1", "0.1e-3", "5e-324", "1.7e308", "123456789012345e-19"]
    df = spark.createDataFrame([(x,) for x in numbers], "t string")
    for x, got in df.select("t", literals.python_repr(F.col("t")).alias("p")).collect():
        assert got == repr(float(x)), x
    texts = ["", "plain", "it's", 'say "x"', "it's \"x\"", "back\\slash", "tab\t", "é x", "new\nline", "​", "a  b"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", F.expr("substr(to_json(array(t)), 2, length(to_json(array(t))) - 2)").alias("j"))
    for x, got in df.select("t", literals.python_repr(F.col("j")).alias("p")).collect():
        assert got == repr(x)


def test_gold_plans_come_without_reading_plans_twice(spark):
    assert plan_of(queries.compared(spark, SF)).count("o_orderkey#") and plan_of(queries.compared(spark, SF)).count("Relation [o_orderkey") == 1


def test_gold_by_window_as_by_join(spark):
    rows = [(1, 0, "a", "x"), (1, 1, "none", "y"), (1, 2, "none", "z"), (2, 0, "a", "x"), (None, 0, "none", "x"), (None, 1, "a", "y"), (3, 0, "none", None), (3, 1, "none", "w")]
    df = spark.createDataFrame(rows, "query_id long, slot int, error_type string, plan_text string").withColumn("steps", F.when(F.col("plan_text").isNull(), F.array().cast("array<string>")).otherwise(F.array("plan_text")))
    for last, want in ((False, ["y", "y", "y", "x", "x", "y", "w", "w"]), (True, ["z", "z", "z", "x", "x", "y", "w", "w"])):
        got = {(r["query_id"], r["slot"]): r["gold_steps"] for r in compare.with_gold(df, last).collect()}
        assert [got[q, s] for q, s, *_ in rows] == [[w] for w in want]


def test_lines_and_calls_with_spaces_around_them(spark):
    text = "  Step 0: {{0}} = a(x=1)  \t\r\n\tStep 1: {{1}} =b (x='p)', x=2, y= q )\x0b \n\nStep 2: {{2}} = c(x=(1) y\nStep 3: {{3}} = d()\r"
    s = steps_of(spark, text).first()["steps"]
    assert [(x["pos"], x["step_id"], x["tool_name"], [(p["k"], p["v"]) for p in x["params"]]) for x in s] == [(0, 0, "a", [("x", "1")]), (1, 1, "b", [("x", "2"), ("y", "q")]), (2, 3, "d", [])]
