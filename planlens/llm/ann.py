"""Approximate nearest neighbours by a forest of hash prefixes.

A tree labels every vector with a long string of ``DEPTH`` symbols and keeps the
strings sorted, so that all strings with a given prefix are one slice. A symbol
is the largest of ``DIMS`` random projections and its sign, which tells vectors
apart better than as many signs. A query descends each tree to its longest prefix
and then all trees ascend together, tree by tree and symbol by symbol, until their
slices hold ``need`` candidates.

* Equal vectors are one: a class keeps its ``k + 1`` smallest ids, which is all
  that any query can ask of it.
* The sizes of slices at the upper symbols are a histogram of bounded size, which
  tells each query where to stop before any vector moves. Below it each tree goes
  on down by itself while its slice still holds its share of ``need``.
* Each tree's sorted strings are cut into cells at prefixes, of ``CELL`` rows at
  most; a prefix with more rows than that at the histogram's last symbol is dealt
  to several cells. Every cell is built once a tree, and a query visits only
  the cells of its slices, so work is in proportion to rows times trees and to
  queries times ``need``.
* Cells score candidates in half precision and keep some more than ``k``; the best
  of all trees are scored again on the original vectors.

Largest inner product is reduced to angles by one more coordinate that lifts all
vectors to the same norm. Vectors are scaled by their largest component, so that
no norm under- or overflows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Trees, symbols of a hash string, projections of a symbol.
TREES, DEPTH, DIMS = 64, 6, 8
BITS = DIMS.bit_length()
#: Candidates that a query's slices hold over all trees: so many at least, and one in
#: SHARE of the rows. Random vectors need that share at any size (see README for recall).
NEED, SHARE = 13_000, 4
#: Rows of a cell, queries that visit a cell at once, symbols of the histogram at most.
CELL, QUERIES, UPPER = 4096, 8192, 4
#: Candidates kept beyond k until they are scored exactly; queries merged at a time.
SPARE, MERGED = 11, 512
#: Rows hashed at a time.
CHUNK = 1024


def usable(vectors: DataFrame, id_col: str, vec: str) -> DataFrame:
    """``(id, v array<double>, top)`` of the vectors that take part; ``top`` is the largest component's size."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = F.array_max(F.transform("v", F.abs))
    return v.where(~bad).withColumn("top", top).where("top > 0").dropDuplicates(["id", "v"])


def norm(v: str, top: str) -> Column:
    """The norm, at most the largest double."""
    unit = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / F.col(top)) * (x / F.col(top))))
    return F.least(F.col(top) * unit, F.lit(1.7976931348623157e308))


class Trees:
    """Hash strings: one whole number a tree, the first symbol highest."""

    def __init__(self, dim: int, lift: float, trees: int, seed: int):
        self.trees, self.lift = trees, lift
        self.planes = np.random.default_rng([seed, dim]).standard_normal((dim + 1, trees * DEPTH * DIMS)).astype(np.float32)

    def codes(self, unit: np.ndarray, top: np.ndarray | None) -> np.ndarray:
        """points x trees. ``unit`` times ``top`` are the vectors; queries have no ``top`` and are not lifted."""
        if top is None:
            points = np.c_[unit, np.zeros(len(unit))]
        else:
            x = unit * (top / self.lift)[:, None]
            points = np.c_[x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))]
        out = np.empty((len(points), self.trees), np.int64)
        for at in range(0, len(points), CHUNK):
            p = (points[at : at + CHUNK].astype(np.float32) @ self.planes).reshape(-1, self.trees, DEPTH, DIMS)
            best = np.abs(p).argmax(3)
            sign = np.take_along_axis(p, best[..., None], 3)[..., 0] > 0
            symbols = 2 * best + sign
            out[at : at + CHUNK] = symbols @ (1 << BITS * np.arange(DEPTH - 1, -1, -1, dtype=np.int64))
        return out


class Upper:
    """Sizes of slices by their first symbols, and what follows from them."""

    def __init__(self, counts: np.ndarray, asked: np.ndarray, levels: int, need: int):
        self.levels, self.need = levels, need
        self.sizes = [counts.reshape(len(counts), 1 << BITS * n, -1).sum(2) for n in range(levels + 1)]
        mine = [asked.reshape(len(asked), 1 << BITS * n, -1).sum(2) for n in range(levels + 1)]
        # A prefix's cell is the shortest one that is small enough.
        last = 1 << BITS * levels
        prefix = np.arange(last)
        self.level = np.full(counts.shape, levels, np.int64)
        for n in range(levels, -1, -1):
            self.level[self.sizes[n][:, prefix >> BITS * (levels - n)] <= CELL] = n
        self.start = prefix >> BITS * (levels - self.level) << BITS * (levels - self.level)
        tree = np.arange(len(counts))[:, None]
        self.cell = (tree * last + self.start) * (levels + 1) + self.level
        self.parts = np.maximum(1, -(-counts // CELL)) * (self.level == levels) + (self.level < levels)
        # Queries of a cell, as many as begin with the symbols before its last one.
        self.blocks = np.ones(counts.shape, np.int64)
        for n in range(levels + 1):
            above = max(0, n - 1)
            seen = mine[above][:, prefix >> BITS * (levels - above)]
            self.blocks = np.where(self.level == n, np.maximum(1, -(-seen // QUERIES)), self.blocks)

    def stops(self, codes: np.ndarray) -> np.ndarray:
        """points x trees: symbols of the prefix at which a query's trees stop; -1
        for trees that another one, which holds all rows, makes needless."""
        at = [self.sizes[n][np.arange(codes.shape[1]), codes >> BITS * (DEPTH - n)] for n in range(self.levels + 1)]
        stop = np.full(codes.shape, self.levels)
        total = at[self.levels].sum(1)
        for n in range(self.levels - 1, -1, -1):
            more = at[n] - at[n + 1]
            before = total[:, None] + np.cumsum(more, 1) - more
            up = before < self.need
            stop[up] = n
            total = total + (more * up).sum(1)
        all_ = (stop == 0).any(1)
        stop[all_, 1:], stop[all_, 0] = -1, 0
        return stop


def _hashed(points: DataFrame, dim: int, make: Trees, lifted: bool) -> DataFrame:
    """``(id, top, codes binary, vector binary)``: hash strings, and the vector
    scaled by its largest component, rows in half and queries in single precision."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = np.float16 if lifted else np.float32
        for whole in batches:
            for i in range(0, len(whole), CHUNK):
                b = whole.slice(i, CHUNK)
                top = b.column("top").to_numpy()
                unit = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) / top[:, None]
                codes = make.codes(unit, top if lifted else None).astype("<i4")
                cols = [b.column("id"), b.column("top"), pa.array([r.tobytes() for r in codes]), pa.array([r.tobytes() for r in unit.astype(kind)])]
                yield pa.RecordBatch.from_arrays(cols, ["id", "top", "codes", "vector"])

    return materialize(points.select("id", "v", "top").mapInArrow(run, "id bigint, top double, codes binary, vector binary"), "hashed")


def _stack(column, kind: str) -> np.ndarray:
    """The rows of a binary column, all of one length, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the places that hold it."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else []
    for s, e in zip(edges, [*edges[1:], len(keys)], strict=True):
        yield int(keys[order[s]]), order[s:e]


def _histogram(hashed: DataFrame, make: Trees, levels: int) -> np.ndarray:
    """Points by tree and first ``levels`` symbols: at most trees * 16^levels numbers."""
    last = 1 << BITS * levels

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(make.trees * last, np.int64)
        for b in batches:
            codes = _stack(b.column("codes"), "<i4") >> BITS * (DEPTH - levels)
            total += np.bincount((codes + last * np.arange(make.trees)).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(make.trees * last, np.int64)
    rows = hashed.select("codes").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(make.trees, last)


_PACKED = "cell bigint, part int, block int, q boolean, ids binary, codes binary, stops binary, vectors binary, tops binary"


def _deal(hashed: DataFrame, dim: int, make: Trees, upper: Upper, queries: bool) -> DataFrame:
    """Points packed by cell, part (of its rows) and block (of its queries), a row a batch."""
    levels, last = upper.levels, 1 << BITS * upper.levels

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in _PACKED.split(", ")]
        for whole in batches:
            for i in range(0, len(whole), 4 * CHUNK):
                b = whole.slice(i, 4 * CHUNK)
                ids, top, codes = b.column("id").to_numpy(), b.column("top").to_numpy(), _stack(b.column("codes"), "<i4").astype(np.int64)
                half = _stack(b.column("vector"), "<f4" if queries else "<f2")
                stops = upper.stops(codes) if queries else None
                mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                out: list[tuple] = []

                def pack(cell: int, part: int, block: int, at: np.ndarray, t: int) -> None:
                    own = stops[at, t].astype(np.int8).tobytes() if queries else None
                    out.append((cell, part, block, queries, ids[at].tobytes(), codes[at, t].astype(np.int32).tobytes(), own, half[at].tobytes(), None if queries else top[at].tobytes()))

                def split(n: int, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
                    return _groups(np.zeros(len(at), np.int64)) if n == 1 else _groups((mixed[at] % np.uint64(n)).astype(np.int64))

                for t in range(make.trees):
                    prefix = codes[:, t] >> BITS * (DEPTH - levels)
                    if not queries:
                        for cell, at in _groups(upper.cell[t, prefix]):
                            p = prefix[at[0]]
                            for part, some in split(int(upper.parts[t, p]), at):
                                for block in range(int(upper.blocks[t, p])):
                                    pack(cell, part, block, at[some], t)
                        continue
                    # queries by slice: a slice may hold several cells
                    shift = BITS * (levels - np.maximum(stops[:, t], 0))
                    slices = np.where(stops[:, t] < 0, -1, (prefix >> shift << shift) * (levels + 1) + stops[:, t])
                    for key, at in _groups(slices):
                        if key < 0:
                            continue
                        lo = key // (levels + 1)
                        cells = slice(lo, lo + (1 << BITS * (levels - key % (levels + 1))))
                        firsts = np.unique(upper.start[t, cells])
                        for p in firsts[firsts < last].tolist():
                            if not upper.sizes[int(upper.level[t, p])][t, p >> BITS * (levels - int(upper.level[t, p]))]:
                                continue
                            for block, some in split(int(upper.blocks[t, p]), at):
                                for part in range(int(upper.parts[t, p])):
                                    pack(int(upper.cell[t, p]), part, block, at[some], t)
                if out:
                    cols = [pa.array(c, f) for c, f in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 5), strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return hashed.mapInArrow(run, _PACKED)


def _visit(f: pd.DataFrame, dim: int, keep: int, share: int, levels: int, merged: int) -> pd.DataFrame:
    """The best ``keep`` candidates of each query of a cell, packed by query."""
    mine, theirs = f[~f["q"]], f[f["q"]]
    done: list[tuple] = []
    if len(mine) and len(theirs):
        whole = lambda g, c, kind: np.frombuffer(b"".join(g[c]), kind)
        codes = whole(mine, "codes", np.int32)
        order = np.argsort(codes, kind="stable")
        codes, ids, top = codes[order], whole(mine, "ids", np.int64)[order], whole(mine, "tops", np.float64)[order]
        x = whole(mine, "vectors", np.float16).reshape(-1, dim)[order].astype(np.float32)
        qids, want, stop = whole(theirs, "ids", np.int64), whole(theirs, "codes", np.int32).astype(np.int64), whole(theirs, "stops", np.int8).astype(np.int64)
        q = whole(theirs, "vectors", np.float32).reshape(-1, dim)

        def bounds(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            shift = BITS * (DEPTH - n)
            low = want >> shift << shift
            return np.searchsorted(codes, low), np.searchsorted(codes, low + (np.int64(1) << shift))

        lo, hi = bounds(stop)
        deep = stop == levels
        for n in range(levels + 1, DEPTH + 1):  # below the histogram, while enough are left
            a, b = bounds(np.full(len(want), n))
            deep &= b - a >= share
            lo, hi = np.where(deep, a, lo), np.where(deep, b, hi)
        same = (top == top[0]).all()
        for key, at in _groups(lo * (len(codes) + 1) + hi):
            a, b = divmod(key, len(codes) + 1)
            if a >= b:
                continue
            score = (q[at] @ x[a:b].T).astype(np.float64) if not same else q[at] @ x[a:b].T
            if not same:
                score *= top[a:b]
            n = min(keep, b - a)
            best = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < b - a else np.broadcast_to(np.arange(n), score.shape)
            scores = np.take_along_axis(score, best, 1).astype(np.float64) * (top[0] if same else 1.0)
            found = ids[a:b][best]
            done += [(int(qids[i]), found[j].tobytes(), scores[j].tobytes()) for j, i in enumerate(at)]
    out = pd.DataFrame(done, columns=["id", "ids", "scores"])
    out.insert(0, "bucket", (out["id"].to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % merged if len(out) else 0)
    return out


def _best(f: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The best ``keep`` different candidates of each query over its cells."""
    out = []
    for name, g in f.groupby("id", sort=False):
        ids, scores = np.frombuffer(b"".join(g["ids"]), np.int64), np.frombuffer(b"".join(g["scores"]), np.float64)
        ids, first = np.unique(ids, return_index=True)
        at = np.argsort(-scores[first], kind="stable")[:keep]
        out.append(pd.DataFrame({"query": name, "found": ids[at]}))
    return pd.concat(out) if out else pd.DataFrame({"query": [], "found": []})


def _search(rows: DataFrame, asked: DataFrame, dim: int, n: int, lift: float, keep: int, trees: int, need: int, seed: int) -> DataFrame:
    """``(query, found)``: representatives of classes, for vectors of one dimension."""
    levels = 1
    while levels < UPPER and trees * (n >> BITS * levels) > need:
        levels += 1
    make = Trees(dim, lift, trees, seed)
    m = asked.count()
    rows, asked = _hashed(rows, dim, make, True), _hashed(asked, dim, make, False)
    upper = Upper(_histogram(rows, make, levels), _histogram(asked, make, levels), levels, need)
    dealt = _deal(rows, dim, make, upper, False).union(_deal(asked, dim, make, upper, True))
    merged = max(1, -(-m // MERGED))
    visit = lambda f: _visit(f, dim, keep, max(1, need // trees), levels, merged)
    found = dealt.groupBy("cell", "part", "block").applyInPandas(visit, "bucket bigint, id bigint, ids binary, scores binary")
    return found.groupBy("bucket").applyInPandas(lambda f: _best(f, keep), "query bigint, found bigint")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec: str = "embedding", trees: int = TREES, need: int | None = None, seed: int = 42) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` (same
    columns) the ``k`` rows of ``vectors`` of largest inner product that the
    forest finds, those of the query's own id left out, ties to the smaller id. ``need``
    is what a query's slices hold in all; by default ``NEED`` or one in ``SHARE`` rows.

    Vectors that are null, zero or hold null or non-finite parts, and null ids,
    take no part; a query finds only vectors of its own dimension, of which there
    should be few, as each is a search of its own. Rows that repeat id and vector
    count once; an id with several vectors is that many rows. Empty tables give no
    rows. Other columns are ignored, whatever their names.
    """
    first = Window.partitionBy("v").orderBy("id")
    near = usable(vectors, id_col, vec).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    classes = near.groupBy("v", "top").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = materialize(classes.select(F.col("ids")[0].alias("id"), "ids", "v", "top", norm("v", "top").alias("norm"), F.size("v").alias("dim")), "vectors")
    # a class is named by its smallest id and, as an id may have several vectors, a hash of the vector
    classes = classes.withColumn("id", F.xxhash64("id", "v"))
    asked = materialize(usable(queries, id_col, vec).withColumn("key", F.xxhash64(F.lit("q"), "v")), "queries")
    asked_v = asked.groupBy("v", "top").agg(F.min("key").alias("id")).withColumn("dim", F.size("v"))
    stats = classes.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("lift")).collect()
    parts = [_search(classes.where(F.col("dim") == r["dim"]), asked_v.where(F.col("dim") == r["dim"]), r["dim"], r["n"], r["lift"], k + 1 + SPARE, trees, need or max(NEED, r["n"] // SHARE), seed) for r in stats]
    empty = vectors.sparkSession.createDataFrame([], "query bigint, found bigint")
    found = materialize(functools.reduce(DataFrame.union, parts, empty), "found")
    pairs = found.join(asked_v.select(F.col("id").alias("query"), F.col("v").alias("qv")), "query")
    pairs = pairs.join(classes.select(F.col("id").alias("found"), "ids", "v"), "found")
    dot = F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.select("query", "ids", dot.alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    scored = scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
    lists = scored.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    every = F.flatten(F.transform("near", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("s"), i.alias("i")))))
    out = asked.select("id", F.col("key").alias("query")).join(lists, "query").select("id", every.alias("near"))
    mine = F.slice(F.array_sort(F.filter("near", lambda c: c["i"] != F.col("id"))), 1, k)
    ranked = out.groupBy("id").agg(F.flatten(F.collect_list(mine)).alias("near")).select("id", F.slice(F.array_sort("near"), 1, k).alias("near"))
    ranked = ranked.select(F.col("id").alias("query_id"), F.posexplode("near").alias("rank", "c"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("c.i").alias("vec_id"), (-F.col("c.s")).alias("score"))
