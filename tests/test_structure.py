"""Typed values, names, cycles, streams, judges and graphs against Python."""

import ast
import json
import random
import threading
import unicodedata
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from planlens.functions import literals, text
from planlens.operators import execute, graph, search
from planlens.plans import validate
from planlens.registry import ORACLES
from planlens.sources import io, judge
from planlens.streaming import running, stateful

ODD = ["1, 2", "(1)", "(1,)", "()", "[]", "{}", "", ",", "(,)", "[1,,2]", "[1 2]", "'a' 'b'", "'a'\"b\"", "u'x'", r"r'\n'", "'''a\nb'''", r"'\x41é\U0001F600\101'", r"'\q'", "'\\\nx'",
       "0x1F", "0b101", "0o17", "1_000", "1__0", "01", "00", "1.", "  .5", "1e5", "1E+5", "-1", "+1", "--1", "foo", "[1", "1]", "(1]", "'a", "{1:2,1:3}", "{'a':1,}", "{:1}", "{'a':}", "{'a':1,'a':2}",
       "[(1,2),{'a':[None,True]}]", "-'a'", "[-1,-2.5]", " 1", "1 ", "'a':1", "[1,2,]", "{1:2,'1':3}", "{1.5:2}", "{True:1}", "{None:1}", "0xFFFFFFFFFFFFFFFF", "1.5.2", "1abc", "true", "nan", "f'a'", "1e", "[1]x", r"'\xg'", "'\\u12'"]
REFUSED = ["{'a'}", "b'x'", "{1, 2}", "1+2j", "3j", "{(1, 2): 3}", r"'\N{BULLET}'", r"'\ud83d'"]


def _value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind < 2:
        return rng.choice([0, 1, -5, 12345678901234567890, 10**30, 0.0, -0.0, 1.5, 1e16, 1e-5, 123456789.125, -2.5e-7, 1e22, 1 / 3, 5e-324, 1.7976931348623157e308, 2e-3, 100.0])
    if kind == 2:
        return rng.choice([True, False, None])
    if kind < 6:
        return "".join(rng.choices(["a", "'", '"', "\\", "\n", "é", "😀", "\x07", " ", " ", "{", "]", ",", "\t", "\x7f", "\xa0", "0"], k=rng.randrange(7)))
    if kind < 8:
        return (list, tuple)[kind - 6](_value(rng, depth + 1) for _ in range(rng.randrange(4)))
    return {rng.choice([f"k{i}", "x'y", i, True]): _value(rng, depth + 1) for i in range(rng.randrange(4))}


def _jsonable(v):
    if isinstance(v, (tuple, list)):
        return [_jsonable(x) for x in v]
    return {next(iter(json.loads(json.dumps({k: 0})))): _jsonable(x) for k, x in v.items()} if isinstance(v, dict) else v


@pytest.mark.filterwarnings("ignore::SyntaxWarning")
def test_literals(spark):
    rng = random.Random(5)
    codes = [repr(_value(rng)) for _ in range(150)] + ODD + REFUSED
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, t string").repartition(4)
    out = rows.select("t", literals.json_of_literal(F.col("t")).alias("j")).select("*", literals.python_repr(F.col("j")).alias("r"), F.try_parse_json("j").isNotNull().alias("v")).collect()
    for r in out:
        try:
            want = _jsonable(ast.literal_eval(r.t)) if r.t not in REFUSED else ...
        except (SyntaxError, ValueError):
            want = ...
        assert (r.j is None) == (want is ...) and r.v == (want is not ...), r.t
        assert r.r is None if want is ... else repr(json.loads(r.j)) == repr(want) == r.r, r.t
    plain = spark.createDataFrame([("'it''s",), (" x y ",), ("[1",), ("'a b'",), (None,)], "t string")
    assert [r[0] for r in plain.select(F.to_json(literals.literal_or_text(F.col("t")))).collect()] == ['"\'it\'\'s"', '"x y"', '"[1"', '"a b"', None]


def test_nfkc(spark, tmp_path):
    import pandas as pd

    known = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    rng = random.Random(1)
    marks = [c for c in known if unicodedata.combining(c)]
    texts = known + ["".join(rng.choice(rng.choice([known, marks])) for _ in range(rng.randrange(9))) for _ in range(5000)]
    pd.DataFrame({"t": texts}).to_parquet(tmp_path / "t.parquet")
    rows = spark.read.parquet(str(tmp_path / "t.parquet")).select("t", text.nfkc(F.col("t")).alias("n"))
    assert all(r.n == unicodedata.normalize("NFKC", r.t) for r in rows.collect())
    assert spark.createDataFrame([(None,)], "t string").select(text.nfkc(F.col("t"))).first()[0] is None
    assert "Python" not in rows._jdf.queryExecution().toString()


def _first_cycle(steps):
    """A plain depth-first search in step order."""
    edges = {}
    for s in steps:
        edges[s[0]] = s[1]

    def walk(node, path, seen):
        seen.add(node)
        for to in edges.get(node, []):
            if to in path or to == node:
                whole = [*path, node]
                return whole[whole.index(to) :] + [to]
            if to not in seen and (found := walk(to, [*path, node], seen)):
                return found
        return None

    seen = set()
    for s in steps:
        if s[0] not in seen and (found := walk(s[0], [], seen)):
            return s[0], found
    return None


def test_first_cycles(spark):
    rng = random.Random(2)
    plans = [[(i, [rng.randrange(n + 1) for _ in range(rng.choice([0, 1, 1, 2]))]) for i in range(n)] for n in (rng.randrange(1, 8) for _ in range(150))]
    plans.append([(i, [(i + 1) % 60]) for i in range(60)])
    rows = [(p, at, s, [(f"k{j}", f"[{{{{{r}}}}}]") for j, r in enumerate(refs)]) for p, steps in enumerate(plans) for at, (s, refs) in enumerate(steps)]
    steps = spark.createDataFrame(rows, "plan_id int, pos int, step_id int, params array<struct<k:string,v:string>>")
    got = {r.plan_id: (r.start, r.cycle) for r in validate.first_cycles(steps).collect()}
    assert got == {p: found for p, s in enumerate(plans) if (found := _first_cycle(s))}
    assert {r.plan_id for r in validate.cyclic(steps).collect()} == set(got)


def test_guard_reads_arguments_by_name():
    call = lambda name, **a: execute.invoke(name, execute.REGISTRY[name], a)
    for swapped in ({"base": 2, "exponent": 10**9}, {"exponent": 10**9, "base": 2}, {"arg_0": 2, "arg_1": 10**9}, {"arg_1": 10**9, "arg_0": 2}):
        with pytest.raises(ValueError, match="out of bounds"):
            call("power", **swapped)
    assert call("power", base=1, exponent=200_000) == 1 and call("power", exponent=200_001, base=-1) == -1 and call("power", base=0, exponent=200_000) == 0
    assert call("power", exponent=3, base=200_000) == 8 * 10**15
    assert call("choose", r=2, n=10**6) == call("choose", n=10**6, r=2) == 499999500000
    for args in ({"n": 10**6, "r": 5 * 10**5}, {"r": 5 * 10**5, "n": 10**6}):
        with pytest.raises(ValueError, match="out of bounds"):
            call("choose", **args)
    with pytest.raises(ValueError, match="out of bounds"):
        call("factorial", n=10**6)


def test_join_by_place(spark, tmp_path):
    left, right = str(tmp_path / "l"), str(tmp_path / "r")
    spark.range(0, 100, 1, 5).write.parquet(left)
    spark.range(1000, 1070, 1, 3).withColumnRenamed("id", "other").write.parquet(right)
    rows = io.join_by_place(spark, left, right, "full").orderBy("place").collect()
    assert [(r.place, r.id, r.other) for r in rows] == [(i, i, 1000 + i if i < 70 else None) for i in range(100)]


def test_stream_repeats_a_batch_without_harm(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("source", "sink", "checkpoint"))
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), rng.choice([None, 1.0, 2.0, 3.0])) for i in range(90)]
    events = spark.createDataFrame(rows, "id bigint, k bigint, x double")

    def go():
        stream = running.read_stream(spark, source, "id bigint, k bigint, x double", 1)
        stateful.run_batches(stateful.running(stream, "k", ["id"], "x", last=4, recent=2, least=1.5), sink, checkpoint)

    for low in (0, 30):
        events.where(F.col("id").between(low, low + 29)).coalesce(1).write.mode("append").parquet(source)
        go()
    (tmp_path / "checkpoint" / "commits" / "1").unlink()  # as if the driver was lost before the second batch was committed
    (tmp_path / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    events.where("id >= 60").coalesce(1).write.mode("append").parquet(source)
    go()
    got = {r.id: (r.n, r.mean, r.stop) for r in stateful.read_batches(spark, sink).collect()}
    want = {}
    for k in range(3):
        xs, stop = [], False
        for i, _, x in (r for r in rows if r[1] == k):
            xs.append(x)
            last, new, old = ([v for v in part if v is not None] for part in (xs[-4:], xs[-2:], xs[:-2]))
            stop = stop or bool(new and old and max(new) - max(old) < 1.5)
            want[i] = (len(xs), sum(last) / len(last) if last else None, stop)
    assert stateful.read_batches(spark, sink).count() == 90 and _rounded(got) == _rounded(want)


def _rounded(rows):
    return {k: tuple(round(x, 9) if isinstance(x, float) and x == x else None if x != x else x for x in v) for k, v in rows.items()}


class _Judge(BaseHTTPRequestHandler):
    seen: dict = {}
    broken = True

    def do_POST(self):  # noqa: N802
        ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
        n = self.seen[ask] = self.seen.get(ask, 0) + 1
        number = int(ask.split()[-1])
        if number % 5 == 0 and (n == 1 or (self.broken and number % 10 == 0)):
            return self.send_error(503)
        body = [f'```json\n{{"quality_score": {number}, "confidence": 7,}}\n```', f'well: "quality_score": {number} "oops', "no score"][number % 3 if number > 90 else 0]
        answer = b"[]" if number == 1 else json.dumps({"choices": [{"message": {"content": body}}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(answer)

    def log_message(self, *_):
        pass


def test_judge(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Judge)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    asks = spark.range(100).select("id", judge.request("Judge.", F.concat(F.lit("plan "), F.col("id").cast("string"))).alias("body")).repartition(3)
    path = str(tmp_path / "answers")
    limits = {"parallel": 4, "timeout": 5, "tries": 2, "pause": 0.01}
    try:
        with pytest.raises(RuntimeError, match="judge calls failed"):
            judge.judge(spark, asks, url, path, ["id"], most_failed=0.05, **limits)
        asked, _Judge.broken = dict(_Judge.seen), False
        rows = {r.id: r for r in judge.judge(spark, asks, url, path, ["id"], most_failed=0.9, **limits).collect()}
    finally:
        server.shutdown()
    assert set(rows) == set(range(100)) and rows[50].quality_score == 50 and rows[50].full_parse and rows[50].confidence == 1.0
    assert rows[10].attempts == 1 and rows[5].attempts == 2  # answered in the second run, and at its second try
    assert [(rows[i].quality_score, rows[i].full_parse, rows[i].call_failed) for i in (91, 92, 93)] == [(91, False, False), (0, False, True), (93, True, False)]
    assert rows[1].call_failed and rows[1].error.startswith("not an answer") and rows[1].attempts == 1
    again = {k for k, n in _Judge.seen.items() if n > asked.get(k, 0)}
    assert again == {f"plan {i}" for i in (*range(0, 100, 10), 1, 92, 95, 98)}  # only what had failed
    dead = judge.annotated(judge.call(asks.limit(2), url, ["id"], tries=1, timeout=1)).collect()
    assert all(r.call_failed and r.quality_score == 0 and r.error for r in dead)


def test_graph(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, [0.0, 0.0])], "id int, v array<double>")
    e = spark.createDataFrame([(1, 3, 1.0), (2, 3, 3.0), (2, 1, 1.0), (9, 1, 5.0)], "src int, dst int, weight double")
    rows = graph.long(v, "id", "v")
    assert {r.id: r.v for r in graph.wide(graph.neighbour_means(rows, e)).collect()} == {3: [2.5, -0.25], 1: [3.0, -1.0]}
    w = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0)], "i int, j int, w double")
    assert {r.id: r.x for r in graph.layer(rows, e, w, w).collect()} == {1: 5.0, 2: 2.0, 3: 2.25}
    loss = graph.ranking_loss(spark.createDataFrame([(7, 1, 2, 3)], "triplet int, anchor int, positive int, negative int"), rows).first()
    assert loss.loss == pytest.approx(0.31326167)


def test_tree_rounds(spark):
    rng = random.Random(9)
    rows = []
    for q in range(6):
        nodes, level = [(q, 0, None, 1.0, rng.random())], [0]
        for _ in range(3):
            level = [len(nodes) - 1 for parent in level for _ in range(rng.randrange(0, 4)) if not nodes.append((q, len(nodes), parent, rng.random(), rng.random()))]
        rows += nodes
    c = spark.createDataFrame(rows, "query_id int, node int, parent int, prior double, reward double")
    got = {(r.query_id, r.node): (r.visits, r.q) for r in search.grow(c, "query_id", rounds=5, depth=3).collect()}
    assert _rounded(got) == _rounded(_grown(rows, 5))


def _grown(rows, rounds):
    """The same rounds in plain Python."""
    import math

    out = {}
    for q in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == q}
        tree = {0: [0, 0.0]}
        for _ in range(rounds):
            path = [0]
            while kids := [n for n in tree if mine[n][2] == path[-1]]:
                above = tree[path[-1]][0]
                rate = lambda n: tree[n][1] + max(mine[n][3], 1e-6) * math.sqrt(math.log(max(above, 1) + 1)) / (1 + tree[n][0])  # noqa: B023, E731
                path.append(min(kids, key=lambda n: (-rate(n), n)))
            reward = mine[path[-1]][4]
            for n in mine:
                if mine[n][2] == path[-1]:
                    tree[n] = [0, 0.0]
            for n in path:
                visits, mean = tree[n]
                tree[n] = [visits + 1, mean + (reward - mean) / (visits + 1)]
        out |= {(q, n): tuple(v) for n, v in tree.items()}
    return out


def test_typed_plans_equal_the_interpreter(spark):
    """The fold against the interpreter, on plans of numbers and on others, which it leaves."""
    from planlens.operators import typed

    rng = random.Random(7)
    numeral = lambda: rng.choice(["0", "1", "-3", "7", "12345678901", "999999999999999999", "2.5", "-0.0", "0.1", "1000000.0", " 4 ", "3.0"])
    plans = []
    for _ in range(300):
        steps = []
        for at in range(rng.randrange(5)):
            tool = rng.choice([*typed.TOOLS, "add", "subtract", "divide", "nothing" if rng.random() < 0.2 else "multiply"])
            names = typed.TOOLS.get(tool, (("x",), None))[0]
            value = lambda at=at: f"{{{{{rng.randrange(at + (rng.random() < 0.1))}}}}}" if at and rng.random() < 0.6 else numeral()
            params = [(k, value()) for k in names]
            if rng.random() < 0.15:
                params = rng.choice([[("arg_0", "1"), ("arg_1", "2")], params[:-1], [(k, rng.choice(["'4'", "[1, 2]", "+5", "1e3", "None"])) for k, _ in params], [*params, ("zz", "1")]])
            steps.append((at, at, f" {tool} " if rng.random() < 0.1 else tool, params, rng.choice([f"{{{{{at}}}}}", None, f"{{{{{max(at - 1, 0)}}}}}"] if rng.random() < 0.2 else [f"{{{{{at}}}}}"])))
        plans.append(steps)
    schema = "id int, left string, row string, steps array<struct<pos:int,step_id:int,tool_name:string,params:array<struct<k:string,v:string>>,output_variable:string>>"
    df = spark.createDataFrame([(i, "l", "r", s) for i, s in enumerate(plans)], schema).repartition(3)
    rows = {r.id: r for r in execute.execute(df).collect()}
    as_dicts = lambda s: [{"step_id": x[1], "tool_name": x[2], "params": [{"k": k, "v": v} for k, v in x[3]], "output_variable": x[4]} for x in s]
    for i, s in enumerate(plans):
        assert (rows[i].exec_status, rows[i].exec_output, rows[i].exec_failed_step) == execute.run_plan(as_dicts(s)), s
    assert len(rows) == len(plans) and rows[0].left == "l" and rows[0].row == "r"
    left = df.select(typed.run(F.col("steps"), list(execute.REGISTRY), 200).alias("r")).where("r.left").count()
    assert 20 < left < 150
    plain = df.where(F.col("id").isin([i for i, s in enumerate(plans) if all(t in ("add", "subtract") and all(k in ("arg_0", "arg_1") and v.strip().isdigit() for k, v in p) and len(p) == 2 for _, _, t, p, _ in s)]))
    assert "Python" not in execute.execute(plain)._jdf.queryExecution().toString()


def test_rounds_of_search_derive_candidates_once(spark, monkeypatch):
    """Rounds read what is written; none broadcasts a tree, whose files look small."""
    plans, real = [], search.keep

    def spied(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        return real(df, name)

    monkeypatch.setattr(search, "keep", spied)
    c = spark.range(8).select(F.lit(1).alias("q"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.lit(0)).cast("bigint").alias("parent"), (F.col("id") / 10).alias("prior"), (F.col("id") / 20).alias("reward"))
    assert search.grow(c, "q", rounds=2, depth=1).count() == 8
    assert sum("Range (" in p for p in plans) == 1 and not any("BroadcastHashJoin" in p for p in plans)


def test_edges_are_derived_once(spark):
    """Both directions and all layers read written edges; the uses are shuffled once, by group."""
    uses = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 4), (2, 1), (2, 2)], "g int, item int")
    edges = graph.co_use(uses, "item", "g")
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 2), (2, 1, 2), (2, 4, 1), (4, 2, 1)]
    assert "Window" not in edges._jdf.queryExecution().optimizedPlan().toString()


def test_link_layers_are_layers(spark, monkeypatch):
    """Blocks of few links give what layers over counted edges give; nulls, short and repeated rows as in the SQL."""
    monkeypatch.setattr(graph, "LINKS_A_BLOCK", 8)
    rng = random.Random(4)
    uses = spark.createDataFrame([(g, rng.randrange(40) if g else 7) for g in range(60) for _ in range(rng.randrange(6))], "g int, item int")
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(0, 60, 3)] + [(3, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(vectors, "id int, v array<double>")
    own, others = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(3)], [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(3)]
    table = lambda m: spark.createDataFrame([(i, j, w) for i, r in enumerate(m) for j, w in enumerate(r)], "i int, j int, w double")
    parts = graph.parts_for(uses.count())
    assert parts > 4
    linked = graph.links(uses, "item", "g", parts)
    want = {r.id: r.v for r in graph.wide(graph.layer(graph.long(v, "id", "v"), graph.co_use(uses, "item", "g"), table(own), table(others), relu=False)).collect()}
    got = graph.link_layer(v, linked, parts, own, others, relu=False)
    assert {r.id: r.v for r in got.collect()} == {k: pytest.approx(x) for k, x in want.items()}
    assert {r.id for r in got.where("known").collect()} == {i for i, _ in vectors}
    few = graph.link_layer(v.withColumn("some", F.col("id") < 30), linked, parts, own, others, relu=False, among="some")
    assert {r.id: r.v for r in few.collect()} == {k: pytest.approx(x) for k, x in want.items() if k < 30 and k % 3 == 0}
    odd = spark.createDataFrame([(1, None), (2, [2.0]), (3, [None, 1.0, 5.0]), (4, [])], "id int, v array<double>")
    alone = graph.link_layer(odd, linked.where("false"), parts, [[1.0], [10.0]], [[1.0], [1.0]])
    assert {r.id: r.v for r in alone.collect()} == {1: [0.0], 2: [2.0], 3: [10.0], 4: [0.0]}


def test_message_passing_shuffles_links_once(spark, monkeypatch, tmp_path):
    """Both layers read one exchange of the links, and vectors are summed a block before they are shuffled."""
    from planlens import structure_queries

    rng = random.Random(5)
    spark.createDataFrame([(g, rng.randrange(50)) for g in range(4000) for _ in range(4)], "l_orderkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(64)], i % 10) for i in range(50)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    df = structure_queries.message_passing(spark, str(tmp_path))
    assert df.count() == 50
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 2
    assert plan.count("FileScan parquet [l_orderkey") == 1
    assert "Join" not in plan


def test_common_links_are_counted_before_the_shuffle(spark):
    uses = spark.range(3000).selectExpr("id as g", "explode(array(1, 2, 3 + id % 2)) as item")
    rows = graph.links(uses, "item", "g", 4).collect()
    assert len(rows) < 100
    count = {}
    for r in rows:
        count[r.a, r.b] = count.get((r.a, r.b), 0) + r.times
    assert count == {(1, 2): 3000, (2, 3): 1500, (2, 4): 1500}


def test_triplets_have_no_window(spark, tmp_path):
    """Partners that lie far apart are found, over the ends of spans too."""
    from planlens import structure_queries

    far = [(0, 1), (5, 2), (70, 1), (200_000, 2), (200_000, 1), (900_000, 1), (900_001, 2), (-70_000, 1)]
    duck = pytest.importorskip("duckdb").connect()
    rng = random.Random(6)
    spark.createDataFrame([(1, 0), (1, 70), (1, 200_000), (2, 5), (2, 900_000)], "l_orderkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(64)], c) for i, c in far], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for t in ("lineitem", "embeddings"):
        duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = dict(duck.sql(ORACLES["triplet_loss"]).fetchall())
    assert set(want) == {-70_000, 0, 70, 200_000}
    assert {r.triplet: r.loss for r in structure_queries.triplet_loss(spark, str(tmp_path)).collect()} == want


def test_following(spark):
    rng = random.Random(7)
    at = [(rng.randrange(3), rng.randrange(-3, 3) * graph.SPAN + rng.randrange(40)) for _ in range(80)]
    points, asks = at[:40], at[40:] + at[:5]
    got = graph.following(spark.createDataFrame(points, "key int, at bigint"), spark.createDataFrame([(k, a, i) for i, (k, a) in enumerate(asks)], "key int, at bigint, i int"))
    want = {i: min((a for c, a in points if c == k and a > x), default=None) for i, (k, x) in enumerate(asks)}
    assert {r.i: r.next for r in got.collect()} == want
