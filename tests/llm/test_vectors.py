"""Operators 11 to 13 against brute force and in edge cases."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlens.llm import embedding_dedup, hard_negatives, lexical

ROW = "vec_id bigint, embedding array<double>, label bigint, c string, y string, q string, ball string, id string, rank string"
REST = ("x",) * 6


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, *REST) for i, v, lab in rows], ROW).repartition(3)


def usable(v):
    return bool(v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v))


# -- 11: near duplicates ------------------------------------------------------------


def components(rows, cosine):
    """(n_links, component_id) by id, all pairs compared."""
    fine = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if i is not None and usable(v)}
    links = {i: {j for j, w in fine.items() if j != i and len(w) == len(v) and v @ w >= cosine} for i, v in fine.items()}
    root = {}
    for i in sorted(fine):
        todo = [i] if i not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return {i: (len(links.get(i, ())), root.get(i, i)) for i, _, _ in rows if i is not None}


def planted(seed, n=250, dim=24):
    """Random rows, and groups whose members lie around the threshold of 0.9: some link, some only by others."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    rows = [unit(rng.standard_normal(dim)) for _ in range(n)]
    for size, spread in ((2, 0.1), (30, 0.15), (60, 0.28), (40, 0.36), (20, 0.5)):
        centre = unit(rng.standard_normal(dim))
        rows += [unit(centre + spread * rng.standard_normal(dim) / math.sqrt(dim)) * rng.uniform(0.1, 9) for _ in range(size)]
    rows += [rows[3]] * 4 + [rows[5] * 8]
    order = rng.permutation(len(rows))
    return [(int(i), rows[j].tolist(), 0) for i, j in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_against_all_pairs(spark, seed):
    rows = planted(seed)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_groups(vectors_of(spark, rows)).collect()}
    want = components(rows, 0.9)
    found, all_ = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in got)  # nothing below the threshold
    assert found >= 0.99 * all_ and sum(got[i][1] == want[i][1] for i in got) >= 0.99 * len(got)


def test_near_groups_where_balls_must_be_opened(spark):
    """Members of a large ball that a vector outside links only in part."""
    step = math.radians(12.5)
    turn = lambda a: [math.cos(a), math.sin(a), 0.0]
    rows = [(i, turn(a), 0) for i, a in enumerate([0.0] + [step * k / 40 for k in range(1, 41)] + [step + math.radians(20) + step * k / 40 for k in range(40)])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_groups(vectors_of(spark, rows), recall=0.999999).collect()}
    assert got == components(rows, 0.9)


def test_plan_keeps_the_promised_recall():
    for n in (2, 500, 10**5, 10**9):
        width, m, tables = embedding_dedup.plan(n, 0.9)
        assert 1 - (1 - embedding_dedup.share(math.sqrt(0.2), width) ** m) ** tables >= 0.999
        assert n * embedding_dedup.share(math.sqrt(2), width) ** m <= n**0.4 + 1
    rng = np.random.default_rng(0)
    a, off = rng.standard_normal((2, 200_000)), rng.random(200_000) * 2.0
    x, y = np.array([1.0, 0.0]), np.array([0.9, math.sqrt(0.19)])
    assert abs((np.floor((x @ a + off) / 2) == np.floor((y @ a + off) / 2)).mean() - embedding_dedup.share(np.linalg.norm(x - y), 2.0)) < 0.01


def test_near_groups_edges(spark):
    tiny, huge = 5e-324, 1.7e308
    rows = [(0, [1, 0], 0), (1, [1, 0], 0), (1, [1, 0], 0), (2, None, 0), (3, [], 0), (4, [0, 0], 0), (5, [1, None], 0), (6, [1, float("nan")], 0), (7, [1, float("inf")], 0), (None, [1, 0], 0), (8, [tiny, 0], 0), (9, [huge, 0], 0), (10, [1, 0, 0], 0), (11, [0, -huge], 0), (-5, [2, 0], 0)]
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_groups(vectors_of(spark, rows)).collect())
    linked = [(i, 4, -5, i == -5) for i in (0, 1, 1, 8, 9, -5)]
    alone = [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 10, 11)] + [(None, 0, None, True)]
    assert got == collections.Counter(linked + alone)
    out = embedding_dedup.near_groups(vectors_of(spark, []))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == 0


# -- 12: hard negatives ----------------------------------------------------------------


def mined(rows, anchor, positives=5, negatives=10, least=30, most=90):
    whole = list(dict.fromkeys((i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)))
    out = []
    for i, lab, v in whole:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in whole if j != i and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            fits = [(-t, j) for t, j, other in scored if other != lab and least * -s <= 100 * -t <= most * -s][:negatives]
            out += [(i, p, r, j, -s, t) for r, (t, j) in enumerate(fits, 1)]
    return collections.Counter(out)


def found(df):
    return collections.Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize(("seed", "first", "segment"), [(1, 16_384, 4096), (2, 20, 16), (3, 1, 8)])
def test_mine_against_brute_force(spark, monkeypatch, seed, first, segment):
    """With small segments a query goes through several rounds and leaves annuli out."""
    monkeypatch.setattr(hard_negatives, "FIRST", first)
    monkeypatch.setattr(hard_negatives, "SEGMENT", segment)
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 8)) * 2
    rows = [(i, (centres[rng.integers(6)] + rng.standard_normal(8) * rng.choice([0.1, 1.0])).round(rng.integers(0, 3)).tolist(), int(rng.integers(4))) for i in range(300)]
    rows += [(300 + i, rows[7][1], int(rng.integers(4))) for i in range(20)]
    got = found(hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == mined(rows, lambda i: i % 20 == 0) and len(got) > 200


def test_mine_broadcasts_no_rows(spark, monkeypatch):
    """Asking rows become a row a segment, more than any estimate: no round may send them through the driver."""
    plans, real = [], hard_negatives.materialize

    def spied(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        return real(df, name)

    monkeypatch.setattr(hard_negatives, "materialize", spied)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(300)]
    assert hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0).count() > 0
    joins = [p for p in plans if "Join" in p]
    assert joins and not [p for p in joins if "BroadcastHashJoin" in p]


def test_searches_leave_far_segments_out(spark):
    """Once the best rows are certain, segments that cannot hold better ones are not visited."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-20, 20, (200, 4)) + c for c in np.array([[900, 0, 0, 0], [0, 900, 0, 0], [0, 0, 900, 0], [0, 0, 0, 900]])])
    space = hard_negatives.Space(x[::25], float((x**2).sum(1).max()))
    d = space.distances(x.astype(float), True)
    pivot, near = d.argmin(1), d.min(1)
    rings = {}
    for p, r, z in zip(pivot.tolist(), space.ring(near).tolist(), near.tolist(), strict=True):
        n, a, b = rings.get((p, r), (0, z, z))
        rings[p, r] = (n + 1, min(a, z), max(b, z))
    directory = hard_negatives.Directory(rings)
    q = x[:1].astype(float)
    best = sorted((x @ x[0]).tolist(), reverse=True)[:5]
    row = {"near": space.distances(q, False)[0].tolist(), "square": float((q**2).sum()), "seen": 0, "k": 5, "lows": [-(1 << 62)], "highs": [1 << 62], "tops": [{"scores": best}]}
    take, _, done, _ = hard_negatives._wanted(space, directory, row, 1 << 40)
    seg = [directory.of[p, r] for p, r in zip(pivot.tolist(), space.ring(near).tolist(), strict=True)]
    assert done and directory.rows[take].sum() <= 250 and {s for s, v in zip(seg, x @ x[0], strict=True) if v >= best[-1]} <= set(take.tolist())


def test_mine_edges(spark):
    nan = float("nan")
    rows = [(0, [1, 0], 1), (1, [1, 0], 1), (1, [1, 0], 1), (2, [0.5, 0], 2), (3, [0.5, 0], 2), (4, None, 1), (5, [1, nan], 1), (6, [1, None], 2), (7, [0.5, 0], None), (8, [], 1), (None, [1, 0], 1), (9, [1, 0, 0], 1), (10, [-1, 0], 1), (20, [0, 0], 3), (21, [0, 0], 3), (30, [-1, 0], 4), (31, [1, 0], 4), (40, [3, 1, 1], 5)]
    got = found(hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0))
    assert got == mined(rows, lambda i: i % 10 == 0) and (0, 1, 1, 2, 65536, 32768) in got
    big = [(i, [2.0**16 + i, -(2.0**14)], i % 2) for i in range(30)]  # sums beyond 2^48
    assert found(hard_negatives.mine(vectors_of(spark, big), F.col("vec_id") == 0, least=10, most=100)) == mined(big, lambda i: i == 0, least=10, most=100)
    beyond = [(i, [2.0**19 + i / 256, 7.0], i % 2) for i in range(30)]  # and beyond 2^53
    assert found(hard_negatives.mine(vectors_of(spark, beyond), F.col("vec_id") == 0, least=10, most=100)) == mined(beyond, lambda i: i == 0, least=10, most=100)
    assert hard_negatives.mine(vectors_of(spark, []), F.col("vec_id") == 0).count() == 0
    with pytest.raises(ArithmeticError):
        hard_negatives.mine(vectors_of(spark, [(0, [1e300], 0)]), F.col("vec_id") == 0)


# -- 13: ranked search --------------------------------------------------------------------

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(t):
    return _TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def ranked(docs, items, k=10):
    own = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item, t in items:
        scored = []
        for (i, c), size in zip(own, sizes, strict=True):
            m = 100 - 90 + (90 * size * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x in set(plain_terms(t)) if x in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return collections.Counter(out)


def test_terms():
    for t in ["", "a-B c_D", "É1é, Ⅷ漢字!x", "\x00a\x7fb", "x" * 5000, "A.B c d"]:
        assert [w.decode() for w in lexical.terms(t)] == plain_terms(t)
    assert lexical.terms(None) == []


@pytest.mark.parametrize(("shard", "items", "vocabulary"), [(16_384, 1024, 1 << 18), (7, 2, 1 << 18), (50, 3, 0)])
def test_search_against_brute_force(spark, monkeypatch, shard, items, vocabulary):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", items)
    monkeypatch.setattr(lexical, "VOCABULARY", vocabulary)
    rng = random.Random(shard)
    words = [f"w{i}" for i in range(60)] + ["É", "漢字", "The", "the"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choices(words, [1 / (1 + i) for i in range(len(words))], k=n))
    docs = [(i, text(rng.choice([1, 3, 8, 40]))) for i in range(150)] + [(500 + i, "w1 w2 w3") for i in range(30)]  # many ties
    docs += [(7, "w5 w6"), (None, "w1 w2 w3"), (None, None), (900, None), (901, ""), (902, "-- !"), (903, text(20_000))]
    asked = [(i, text(rng.choice([1, 4, 30]))) for i in range(9)] + [(3, "w1"), (20, None), (21, "nowhere"), (None, "W3 w3, w2")]
    d = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], "doc_id bigint, text string, item string, score string, id string").repartition(3)
    q = spark.createDataFrame([(i, t, "x", "y") for i, t in asked], "item_id bigint, text string, name string, rank string")
    got = collections.Counter(tuple(r) for r in lexical.search(d, q).select("item_id", "rank", "doc_id", "score").collect())
    assert got == ranked(docs, asked)


def test_probed_lists_are_as_good_as_all(spark):
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        lists = []
        for _ in range(int(rng.integers(1, 9))):
            docs = np.flatnonzero(rng.random(n) < rng.random())
            if len(docs):
                impact = rng.integers(1, rng.choice([3, 1000]), len(docs))
                lists.append((docs, impact, int(impact.max())))
        score = np.zeros(n, np.int64)
        for docs, impact, _ in lists:
            score[docs] += impact
        k = int(rng.integers(1, 5))
        least = max(1, int(rng.integers(0, 2000)) * int(rng.integers(0, 2)))
        at, got = lexical.best(lists, n, k, least)
        want = [i for i in np.lexsort((np.arange(n), -score))[:k].tolist() if score[i] >= least]
        assert set(want) <= set(at.tolist()) and (got == score[at]).all()


def test_search_edges(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    out = lexical.search(d, q)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert lexical.search(some, q.where("false")).count() == 0
    assert [tuple(r) for r in lexical.search(some, q, k=3).select("rank", "doc_id").collect()] == [(1, 1)]
