"""Hard negatives by exact searches over one-dimensional distance keys.

Largest inner product becomes nearest distance by one more coordinate that lifts all
rows to the same norm. Each row is stored under the nearest of ``PIVOTS`` rows and
its distance from it, in that order: a segment is a pivot and an interval of
distances, of ``SEGMENT`` rows about, and is cut into blocks of as many.

Of a segment at distances ``[a, b]`` from a pivot that is ``d`` from the query, all
rows are at ``max(0, d - b, a - d)`` or more and at ``d + b`` or less. A query visits
segments by that least distance, ``FIRST`` rows at first and ``GROWTH`` times as many
in each round, leaving out annuli that its range of scores excludes, until the
next segment is too far to hold anything better than the last row it keeps: the
result is exact. Within a round blocks return only what beats the best so far.

Scores are whole numbers. They are products of doubles while all sums stay below
2^53, and of 64-bit integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import _groups
from .common import discard, materialize

#: Pivots of a dimension, intervals of the directory's finest distances, rows of a segment and of a block.
PIVOTS, RINGS, SEGMENT = 32, 1024, 4096
#: Rows that a query visits in the first round, growth, queries of a block.
FIRST, GROWTH, QUERIES = 16_384, 8, 1024
_LOW, _HIGH = -(1 << 62), 1 << 62


def _int_rows(vectors: DataFrame, id_col: str, vec: str, label: str, scale: int) -> DataFrame:
    """``(id, label, v)`` of the rows that take part, each once, with whole components."""
    raw = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vec).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = raw.where("id is not null and label is not null and v is not null and size(v) > 0").where(~bad)
    return fine.withColumn("v", F.transform("v", lambda x: F.floor(scale * x))).dropDuplicates(["id", "label", "v"])


def _matrix(column: object, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Whole inner products; ``exact`` says that doubles hold all sums."""
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if exact else q.astype(np.int64) @ x.astype(np.int64).T


class Space:
    """Pivots of a dimension, and distances in the lifted space."""

    def __init__(self, sample: np.ndarray, top: float):
        self.pivots, self.top = sample.astype(np.float64), top  # top: largest squared norm
        self.lift = np.sqrt(np.maximum(0.0, top - (self.pivots**2).sum(1)))
        self.reach = 2 * np.sqrt(top) + 1e-9

    def distances(self, v: np.ndarray, lifted: bool) -> np.ndarray:
        """Rows x pivots. Queries are not lifted."""
        own = (v**2).sum(1)
        last = np.sqrt(np.maximum(0.0, self.top - own)) if lifted else np.zeros(len(v))
        square = own + last**2
        return np.sqrt(np.maximum(0.0, square[:, None] + self.top - 2 * (v @ self.pivots.T + last[:, None] * self.lift)))

    def ring(self, near: np.ndarray) -> np.ndarray:
        return np.minimum(RINGS - 1, (near / self.reach * RINGS).astype(np.int64))


class Directory:
    """Segments by number: pivot, least and largest distance, rows; at most pivots * RINGS."""

    def __init__(self, rings: dict[tuple[int, int], tuple[int, float, float]]):
        self.of: dict[tuple[int, int], int] = {}
        pivot, low, high, rows = [], [], [], []
        for (p, r), (n, a, b) in sorted(rings.items()):
            if pivot and pivot[-1] == p and rows[-1] + n <= SEGMENT:
                rows[-1], high[-1] = rows[-1] + n, max(high[-1], b)
            else:
                pivot.append(p), low.append(a), high.append(b), rows.append(n)
            self.of[p, r] = len(pivot) - 1
        self.pivot, self.rows = np.array(pivot, np.int64), np.array(rows, np.int64)
        self.low, self.high = np.array(low), np.array(high)
        self.parts = np.maximum(1, -(-self.rows // SEGMENT))


_BLOCK = "seg int, part int, ids binary, labels binary, vectors binary"


def _store(rows: DataFrame, dim: int, space: Space, seed: int) -> tuple[DataFrame, Directory]:
    """Blocks of rows by distance key, written, and their directory."""

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            d = space.distances(_matrix(b.column("v"), dim).astype(np.float64), True)
            pivot = d.argmin(1)
            near = d[np.arange(len(d)), pivot]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "v")), pa.array(pivot.astype(np.int32)), pa.array(space.ring(near).astype(np.int32)), pa.array(near)], ["id", "label", "v", "pivot", "ring", "near"])

    keys = materialize(rows.mapInArrow(keyed, "id bigint, label bigint, v array<bigint>, pivot int, ring int, near double"), "distance-keys")
    rings = keys.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("near").alias("a"), F.max("near").alias("b")).collect()
    directory = Directory({(r["pivot"], r["ring"]): (r["n"], r["a"], r["b"]) for r in rings})
    segment = np.full((len(space.pivots), RINGS), -1, np.int32)
    for (p, r), s in directory.of.items():
        segment[p, r] = s

    def dealt(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            seg = segment[b.column("pivot").to_numpy(), b.column("ring").to_numpy()]
            mixed = b.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            part = (mixed % directory.parts[seg].astype(np.uint64)).astype(np.int32)
            ids, labels, v = b.column("id").to_numpy(), b.column("label").to_numpy(), _matrix(b.column("v"), dim)
            out = [(int(seg[at[0]]), int(part[at[0]]), ids[at].tobytes(), labels[at].tobytes(), v[at].tobytes()) for _, at in _groups(seg.astype(np.int64) << 32 | part)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["seg", "part", "ids", "labels", "vectors"])

    # a block is a list of pieces, which hold as many rows in all as a part has
    packed = keys.mapInArrow(dealt, _BLOCK).groupBy("seg", "part").agg(F.collect_list(F.struct("ids", "labels", "vectors")).alias("pieces"))
    blocks = materialize(packed, "blocks")
    discard(keys)
    return blocks, directory


_ASK = "ask bigint, own_id bigint, label bigint, v array<bigint>, same boolean, k int, lows array<bigint>, highs array<bigint>"
_STATE = _ASK + ", near array<double>, square double, seen int, tops array<struct<ids:array<bigint>,scores:array<bigint>>>, done boolean"
_ASKED = "seg int, asks binary, own_ids binary, own binary, q binary, lows binary, highs binary, wants int, same boolean, k int"


def _order(directory: Directory, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments by least distance of a query, those distances, and the largest ones."""
    d = near[directory.pivot]
    least = np.maximum(0.0, np.maximum(d - directory.high, directory.low - d))
    order = np.argsort(least, kind="stable")
    return order, least[order], (d + directory.high)[order]


def _wanted(space: Space, directory: Directory, row: dict, rows: int) -> tuple[np.ndarray, int, bool, list[int]]:
    """Segments to visit now, how far the order was read, whether the query is done
    after them, and the score to beat of each range."""
    order, least, most = _order(directory, np.array(row["near"]))
    slack = 1e-9 * (row["square"] + space.top) + 1
    high = np.floor((row["square"] + space.top - least**2) / 2 + slack)
    low = np.floor((row["square"] + space.top - most**2) / 2 - slack)
    beat = [max(a, t["scores"][-1] if len(t["scores"]) >= row["k"] else _LOW) for a, t in zip(row["lows"], row["tops"], strict=True)]
    useful = np.zeros(len(order), bool)
    for to_beat, a, b in zip(beat, row["lows"], row["highs"], strict=True):
        if a <= b:
            useful |= (high >= to_beat) & (low <= b)
    left = np.flatnonzero(useful[row["seen"] :]) + row["seen"]
    size = np.cumsum(directory.rows[order[left]])
    take = left[: int(np.searchsorted(size, rows)) + 1]
    return order[take], int(take[-1]) + 1 if len(take) else len(order), len(take) == len(left), beat


def _round(blocks: DataFrame, space: Space, directory: Directory, state: DataFrame, dim: int, rows: int, exact: bool) -> DataFrame:
    """The state after each query has visited its next ``rows`` rows."""

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for i in range(0, len(whole), QUERIES):
                some = whole.slice(i, QUERIES).to_pylist()
                by: dict[tuple, list[int]] = {}
                beats = []
                for j, r in enumerate(some):
                    segments, _, _, beat = _wanted(space, directory, r, rows)
                    beats.append(beat)
                    for s in segments.tolist():
                        by.setdefault((s, len(beat), r["same"], r["k"]), []).append(j)
                out = []
                for (s, wants, same, k), at in by.items():
                    whole_numbers = lambda c, at=at: np.array([some[j][c] for j in at], np.int64).tobytes()
                    out.append((s, *(whole_numbers(c) for c in ("ask", "own_id", "label", "v")), np.array([beats[j] for j in at], np.int64).tobytes(), whole_numbers("highs"), wants, same, k))
                if out:
                    kinds = (pa.int32(), *[pa.binary()] * 6, pa.int32(), pa.bool_(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _ASKED.split(", ")])

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                ids, labels, x = (np.frombuffer(b"".join(p[c] for p in r["pieces"]), np.int64) for c in ("ids", "labels", "vectors"))
                asks, own_ids, own, q = (np.frombuffer(r[c], np.int64) for c in ("asks", "own_ids", "own", "q"))
                lows, highs = (np.frombuffer(r[c], np.int64).reshape(len(asks), -1) for c in ("lows", "highs"))
                score = _products(q.reshape(-1, dim), x.reshape(-1, dim), exact)
                fits = ((labels == own[:, None]) == r["same"]) & (ids != own_ids[:, None])
                out: list[tuple] = []
                for j in range(len(asks)):
                    for w in range(r["wants"]):
                        at = np.flatnonzero(fits[j] & (score[j] >= lows[j, w]) & (score[j] <= highs[j, w]))
                        if len(at):
                            s, i = score[j][at], ids[at]
                            if len(at) > r["k"]:
                                keep = s >= np.partition(s, len(s) - r["k"])[len(s) - r["k"]]
                                s, i = s[keep], i[keep]
                            best = np.lexsort((i, -s))[: r["k"]]
                            out.append((int(asks[j]), w, i[best].tolist(), s[best].tolist()))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["ask", "want", "ids", "scores"])

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            done = []
            schema = pa.schema([f for f in b.schema if f.name != "found"])
            for r in b.to_pylist():
                _, seen, last, _ = _wanted(space, directory, r, rows)
                tops = [[*zip((-s for s in t["scores"]), t["ids"], strict=True)] for t in r["tops"]]
                for f in r.pop("found") or []:
                    tops[f["want"]] += [(-s, i) for s, i in zip(f["scores"], f["ids"], strict=True)]
                tops = [sorted(t)[: r["k"]] for t in tops]
                r |= {"seen": seen, "done": last, "tops": [{"ids": [i for _, i in t], "scores": [-s for s, _ in t]} for t in tops]}
                done.append(r)
            yield pa.RecordBatch.from_pylist(done, schema)

    # a few asking rows become a row a segment, which the planner's sizes do not know: neither side may be broadcast
    met = state.mapInArrow(ask, _ASKED).join(blocks.hint("merge"), "seg").drop("seg", "part")
    met = met.mapInArrow(meet, "ask bigint, want int, ids array<bigint>, scores array<bigint>")
    found = met.groupBy("ask").agg(F.collect_list(F.struct("want", "ids", "scores")).alias("found"))
    return state.join(found.hint("merge"), "ask", "left").mapInArrow(merge, _STATE)


def _search(blocks: DataFrame, space: Space, directory: Directory, asks: DataFrame, dim: int, exact: bool) -> DataFrame:
    """``asks`` (state without progress) with ``tops``: the best rows of each range."""

    def start(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            v = _matrix(b.column("v"), dim).astype(np.float64)
            d = space.distances(v, False)
            cols = [pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), pa.array(d.ravel())), pa.array((v**2).sum(1))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "near", "square"])

    state = asks.select(*(c.split()[0] for c in _ASK.split(", "))).mapInArrow(start, _ASK + ", near array<double>, square double")
    none = F.struct(F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<bigint>").alias("scores"))
    state = materialize(state.select("*", F.lit(0).alias("seen"), F.transform("lows", lambda _: none).alias("tops"), F.lit(False).alias("done")), "asks")
    rows, done = FIRST, None
    while True:
        after = materialize(_round(blocks, space, directory, state, dim, rows, exact), "asks")
        discard(state)
        ended = after.where("done")
        done = ended if done is None else done.union(ended)
        state = after.where("not done")
        if state.isEmpty():
            return done
        state, rows = materialize(state, "asks"), rows * GROWTH


def _of_dim(rows: DataFrame, anchors: DataFrame, dim: int, top: int, positives: int, negatives: int, least: int, most: int, seed: int) -> DataFrame:
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id", "label", "v").limit(PIVOTS).select("v").collect()
    space = Space(np.array([r["v"] for r in sample]), float(top))
    exact = top < 1 << 53
    blocks, directory = _store(rows, dim, space, seed)
    whole = lambda x: F.array(F.lit(x).cast("bigint"))
    asks = anchors.select("ask", F.col("id").alias("own_id"), "label", "v", F.lit(True).alias("same"), F.lit(positives).alias("k"), whole(_LOW).alias("lows"), whole(_HIGH).alias("highs"))
    first = _search(blocks, space, directory, asks, dim, exact)
    first = materialize(first.select("ask", "own_id", "label", "v", F.col("tops")[0].alias("top")).where(F.size("top.ids") > 0), "positives")
    hundredth = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))  # noqa: E731 - rounds down
    scores = F.col("top.scores")
    lows, highs = F.transform(scores, lambda p: -hundredth(-least * p)), F.transform(scores, lambda p: hundredth(most * p))
    asks = first.select("ask", "own_id", "label", "v", F.lit(False).alias("same"), F.lit(negatives).alias("k"), lows.alias("lows"), highs.alias("highs"))
    found = _search(blocks, space, directory, asks, dim, exact).select("ask", "tops")
    pairs = first.select("ask", "own_id", "top").join(found.hint("merge"), "ask")
    each = pairs.select("own_id", F.explode(F.arrays_zip(F.col("top.ids").alias("positive"), F.col("top.scores").alias("score"), F.col("tops").alias("found"))).alias("p"))
    each = each.select("own_id", F.col("p.positive").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(F.arrays_zip(F.col("p.found.ids").alias("i"), F.col("p.found.scores").alias("s"))).alias("rank", "n"))
    return each.select(F.col("own_id").alias("anchor_id"), "positive_id", (F.col("rank") + 1).alias("rank"), F.col("n.i").alias("negative_id"), "positive_score", F.col("n.s").alias("negative_score"))


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", seed: int = 42) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become floor(``scale`` * x); a score is the inner product of whole
    vectors. For each row where ``anchors`` holds and each of its best ``positives``
    other rows of its label: the best ``negatives`` rows of other labels whose score is
    from ``least`` to ``most`` hundredths of the positive's. Higher scores first, ties
    to the smaller id. All of it is exact.

    Rows with null id, null label, null or empty vector or null or non-finite
    components take no part. Rows that repeat id, label and vector count once; rows of
    the anchor's own id are not its others. An anchor meets rows of its own dimension,
    of which there should be few, as each is a search of its own. Scores of 2^55 or more
    raise ArithmeticError. Empty tables give no rows. Other columns are ignored,
    whatever their names; ids and labels are whole numbers.
    """
    spark = vectors.sparkSession
    rows = materialize(_int_rows(vectors, id_col, vec, label, scale), "whole-vectors")
    asked = vectors.where(anchors).select(id_col, vec, label)
    asked = materialize(_int_rows(asked, id_col, vec, label, scale).withColumn("ask", F.monotonically_increasing_id()), "anchors")
    square = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)"))
    kinds = rows.groupBy(F.size("v").alias("dim")).agg(F.max(square).alias("top")).collect()
    out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    for r in kinds:
        if r["top"] >= 1 << 55:
            raise ArithmeticError(f"scores of vectors of {r['dim']} components need more than 55 bits")
        own, mine_ = (t.where(F.size("v") == r["dim"]) for t in (rows, asked))
        out = out.union(_of_dim(own, mine_, r["dim"], int(r["top"]), positives, negatives, least, most, seed))
    return out
