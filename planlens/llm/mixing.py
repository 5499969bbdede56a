"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources they belong
to). A pattern can give its words once at cost 1, a second time at cost 3 and so
on (convex repetition costs); sources take up to their targets. Successive
shortest paths route the flow between the patterns and sources, which are few.
The routed amount of a pattern is then met by whole documents in a seeded order.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, materialize

#: Hash buckets in which the seeded order is cut before single documents are.
BUCKETS = 4096
#: Documents a pattern that may fill its gap.
FILL = 4
#: Patterns that the flow takes; it runs on the driver.
MAX_PATTERNS = 4096


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("bigint")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Split ``share * sum(sizes)`` by weight; what a source's limit of ``most *
    size`` cuts off is reshared among the others until none is above."""
    out, open_, left = [0.0] * len(sizes), [i for i in range(len(sizes)) if weights[i] > 0], share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[float], passes: int) -> list[dict[int, float]]:
    """Flow of each pattern to each of its sources at least total cost.

    Pass ``k`` (from 0) of a pattern costs ``2k + 1`` a word. Successive shortest
    augmenting paths over the residual graph, with potentials."""
    n, m = len(capacity), len(quota)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    edges: list[list] = []  # to, capacity, cost

    def edge(a: int, b: int, cap: float, cost: int) -> None:
        graph[a].append(len(edges))
        edges.append([b, cap, cost])
        graph[b].append(len(edges))
        edges.append([a, 0.0, -cost])

    for p in range(n):
        for k in range(passes):
            edge(source, p, float(capacity[p]), 2 * k + 1)
    routes = []
    for p in range(n):
        for s in members[p]:
            routes.append((p, s, len(edges)))
            edge(p, n + s, float(capacity[p]) * passes, 0)
    for s in range(m):
        edge(n + s, sink, float(quota[s]), 0)
    potential = [0] * len(graph)
    while True:
        dist, via = {source: 0}, {}
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in graph[u]:
                v, cap, cost = edges[e]
                new = d + cost + potential[u] - potential[v]
                if cap > 1e-6 and new < dist.get(v, float("inf")):
                    dist[v], via[v] = new, e
                    heapq.heappush(heap, (new, v))
        if sink not in dist:
            break
        for v in range(len(graph)):
            potential[v] += dist.get(v, dist[sink])
        # Push along every shortest path of this length (blocking flow by depth-first search).
        while True:
            stack, seen, back = [source], {source}, {}
            while stack and sink not in back:
                u = stack.pop()
                for e in graph[u]:
                    v, cap, cost = edges[e]
                    if v not in seen and cap > 1e-6 and cost + potential[u] - potential[v] == 0:
                        seen.add(v)
                        back[v] = e
                        stack.append(v)
            if sink not in back:
                break
            path, v = [], sink
            while v != source:
                path.append(back[v])
                v = edges[back[v] ^ 1][0]
            push = min(edges[e][1] for e in path)
            for e in path:
                edges[e][1] -= push
                edges[e ^ 1][1] += push
    out: list[dict[int, float]] = [{} for _ in range(n)]
    for p, s, e in routes:
        if edges[e ^ 1][1] > 0:
            out[p][s] = edges[e ^ 1][1]
    return out


def _shared_plan(found: list, weights: Sequence[float], share: float, most: int) -> dict[str, dict]:
    """Amounts by pattern, by min-cost flow."""
    names = sorted({s for r in found for s in r["pattern"] or []}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(names)}
    members = [[*dict.fromkeys(index[s] for s in r["pattern"] or [])] for r in found]
    sizes = [0] * len(names)
    for r, m in zip(found, members, strict=True):
        for s in m:
            sizes[s] += r["size"]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, most)
    flow = min_cost_flow([r["size"] for r in found], members, goal, most)
    plan: dict[str, dict] = {}
    for r, m, f in zip(found, members, flow, strict=True):
        amount = sum(f.values())
        full = min(int((amount + 0.5) // r["size"]), most) if r["size"] else 0
        part = max(0.0, amount - full * r["size"]) if full < most else 0.0
        plan[r["_mix_key"]] = {"source_size": sizes[m[0]] if m else 0, "target": goal[m[0]] if m else 0.0, "full": full, "part": part, "gap": part}
    return plan


def mix(docs: DataFrame, size: Column, pattern: Column, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 42, id_col: str = "doc_id", tie: Column | None = None) -> DataFrame:
    """``docs`` plus ``size``, ``source_size``, ``target``, ``taken``.

    ``pattern`` is an array of source names; sources in code-point order, null
    last, weigh ``weights`` in turn. ``source_size`` and ``target`` are those of
    the first source in a document's pattern. ``taken`` counts the words the mix
    takes of a document: whole passes only, ``most`` at most. The seeded order is
    a hash of the id and of ``tie`` (by default the size): documents are taken
    while their running size fits the pattern's flow, then up to ``FILL`` more
    whose sizes close the gap best; equal gaps go to the lesser hash.

    Rows of null id and repeated rows are documents of their own (rows equal in
    id and ``tie`` are taken alike, so many of them may miss a target by their
    size); null and empty patterns take nothing; null and empty texts have no
    words; a very long text is one document, which is taken whole or not; empty
    tables give no rows. Columns named like the new ones are replaced, others stay
    whatever their names. Over ``MAX_PATTERNS`` patterns raise ValueError, as the
    flow runs on the driver. The result is the same in any partitioning.
    """
    spark = docs.sparkSession
    new = ("size", "source_size", "target", "taken")
    own = [c for c in docs.columns if c.lower() not in new]
    # The user's columns travel in one struct, so that no name can clash.
    keyed = docs.select(F.struct(*own).alias("_mix_row") if own else F.lit(None).alias("_mix_row"), size.alias("size"), pattern.alias("_mix_pattern"), F.xxhash64(F.lit(seed), docs[id_col], tie if tie is not None else size).alias("_mix_hash"))
    keyed = keyed.withColumn("_mix_key", F.to_json(F.struct("_mix_pattern"), {"ignoreNullFields": "false"})).withColumn("_mix_bucket", F.shiftrightunsigned("_mix_hash", 52))
    slim = materialize(keyed.select("_mix_key", "_mix_pattern", "_mix_bucket", "_mix_hash", "size"), "mix")

    # Patterns are few by contract of this operator; documents never get here.
    found = slim.groupBy("_mix_key").agg(F.first("_mix_pattern").alias("pattern"), F.sum("size").alias("size")).orderBy("_mix_key").limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    plan = _shared_plan(found, weights, share, most)

    def planned(columns: Sequence[str], kinds: str) -> DataFrame:
        rows = [(k, *(v.get(c) for c in columns)) for k, v in plan.items()]
        return F.broadcast(spark.createDataFrame(rows, "_mix_key string, " + kinds))

    # The part: whole buckets of the seeded order, then documents of the bucket in which it ends.
    by_bucket = Window.partitionBy("_mix_key").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = slim.groupBy("_mix_key", "_mix_bucket").agg(F.sum("size").alias("n")).withColumn("cum", F.sum("n").over(by_bucket))
    over = cum.join(planned(["part"], "part double"), "_mix_key").where("cum > part")
    for r in over.groupBy("_mix_key").agg(F.min("_mix_bucket").alias("edge"), F.min_by(F.col("cum") - F.col("n"), "_mix_bucket").alias("before")).collect():
        plan[r["_mix_key"]] |= {"edge": r["edge"], "before": r["before"], "gap": plan[r["_mix_key"]]["part"] - r["before"]}
    # Within that bucket again by the next bits of the hash, then document by document.
    finer = F.shiftrightunsigned(F.shiftleft("_mix_hash", 12), 52)
    ends = slim.join(planned(["part", "edge", "before"], "part double, edge bigint, before bigint"), "_mix_key").where("_mix_bucket = edge").withColumn("fine", finer)
    by_fine = Window.partitionBy("_mix_key").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    steps = ends.groupBy("_mix_key", "fine").agg(F.sum("size").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(by_fine), F.lit(0)))
    in_fine = Window.partitionBy("_mix_key", "fine").orderBy("_mix_hash")
    ends = ends.join(steps.select("_mix_key", "fine", "ahead"), ["_mix_key", "fine"]).withColumn("reached", F.col("before") + F.col("ahead") + F.sum("size").over(in_fine)).where("reached <= part")
    for r in ends.groupBy("_mix_key").agg(F.max("reached").alias("reached"), F.max("_mix_hash").alias("last")).collect():
        plan[r["_mix_key"]] |= {"last": r["last"], "gap": plan[r["_mix_key"]]["part"] - r["reached"]}

    taken_more = F.expr("coalesce(case when edge is null then part > 0.5 else _mix_bucket < edge or (_mix_bucket = edge and _mix_hash <= last) end, false) or array_contains(picks, _mix_hash)")
    columns, kinds = ["full", "part", "edge", "last", "gap", "picks"], "full int, part double, edge bigint, last bigint, gap double, picks array<bigint>"
    for v in plan.values():
        v["picks"] = []
    for fits in (*("size <= gap",) * (FILL - 1), "abs(gap - size) < gap"):
        if all(v["gap"] < 1 for v in plan.values()):
            break
        free = slim.join(planned(columns, kinds), "_mix_key").where(~taken_more).where("size > 0 and gap > 0.5").where(fits)
        for r in free.groupBy("_mix_key").agg(F.min_by(F.struct("size", "_mix_hash"), F.struct(F.abs(F.col("gap") - F.col("size")), F.col("_mix_hash"))).alias("p")).collect():
            v = plan[r["_mix_key"]]
            v["picks"].append(r["p"]["_mix_hash"])
            v["gap"] -= r["p"]["size"]
    discard(slim)
    done = keyed.join(planned([*columns, "source_size", "target"], kinds + ", source_size bigint, target double"), "_mix_key")
    passes = F.least(F.col("full") + taken_more.cast("int"), F.lit(most))
    return done.select(*(F.col("_mix_row").getField(c).alias(c) for c in own), "size", "source_size", "target", (passes * F.col("size")).cast("bigint").alias("taken"))


def materialize_mix(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of a mix: a document as often as it is taken, ``columns`` only. A
    document without words is taken as it costs nothing. No rows, no rows."""
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr("taken div size")).cast("int")
    return mixed.select(*columns, F.explode(F.array_repeat(F.lit(1), times)).alias("_mix_n")).select(*columns)
