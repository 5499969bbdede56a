"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

A table's key is the whole numbers floor((a v + b) / w) of ``m`` random projections
of the normalised vector; ``plan`` sets ``m`` and the number of tables by the number
of vectors, so that a pair exactly at the threshold shares a key with probability
``RECALL`` at every size, and a key holds about ``n ** 0.4`` unrelated vectors.

* Vectors of one direction are one: they are grouped before anything else moves.
* Groups of near copies become balls. In the first tables each vector looks at the
  vector of least random rank under its key, and joins the ball of the least that
  is within half of the threshold's angle. All members of a ball are linked, which
  needs no comparison of pairs. Tables hold a ball once a key, however many members.
* Balls that share a key are compared by sign sketches of 256 bits, within the join;
  what may be near is a pair of balls. Vectors move after that, once a pair.
* A member and a ball are linked, or not, as a whole where the angle to the ball's
  centre tells so by the triangle inequality; else the member meets the ball's
  members in blocks, which emit counts and no pairs.

The cosine is that of the vectors in double precision, scaled by powers of two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components

#: Chance that a pair at the threshold shares a key; width of a bucket in distances at the threshold.
RECALL, WIDTH = 0.999, 6.0
#: Tables in which vectors look for a ball; bits of a sketch, and standard deviations that a sketch may be off.
BALL_TABLES, BITS, OFF = 6, 256, 5.5
#: Members of a block; rows hashed at a time.
BLOCK, CHUNK = 1024, 1024
#: Angles closer than this are told apart by the members.
SLACK = 1e-7


def share(distance: float, width: float) -> float:
    """Chance that one p-stable number is equal for two points."""
    t = width / distance
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, cosine: float, recall: float = RECALL) -> tuple[float, int, int]:
    """Width, numbers of a key and tables for ``n`` vectors."""
    near = math.sqrt(2 - 2 * cosine)
    width = WIDTH * near
    m = max(1, math.ceil(0.6 * math.log(max(n, 2)) / -math.log(share(math.sqrt(2), width))))
    return width, m, math.ceil(math.log(1 - recall) / math.log(1 - share(near, width) ** m))


def scaled(vec: str) -> Column:
    """The vector scaled by a power of two, or null where it takes no part."""
    v = F.col(vec).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = F.array_max(F.transform(v, F.abs))
    power = F.pow(F.lit(2.0), -F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.floor(F.log2(top)).cast("double"))))
    # the power is bound once, or each component would find the largest anew
    whole = F.transform(F.array(power), lambda p: F.transform(v, lambda x: x * p))[0]
    return F.when(v.isNotNull() & ~bad & (top > 0), whole)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _hashed(classes: DataFrame, width: float, m: int, tables: int, seed: int) -> DataFrame:
    """``classes`` with ``keys`` (one a table) and a sign sketch of four longs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made: dict[int, tuple[np.ndarray, ...]] = {}
        for whole in batches:
            for i in range(0, len(whole), CHUNK):
                b = whole.slice(i, CHUNK)
                y = b.column("y")
                dims = np.diff(np.r_[y.offsets.to_numpy()])
                flat = y.flatten().to_numpy(zero_copy_only=False)
                starts = np.r_[0, np.cumsum(dims)][:-1]
                keys, sketch = np.empty((len(b), tables), np.int64), np.empty((len(b), BITS // 64), np.int64)
                for dim in np.unique(dims).tolist():
                    if dim not in made:
                        rng = np.random.default_rng([seed, dim])
                        made[dim] = rng.standard_normal((dim, tables * m)), rng.random(tables * m) * width, rng.integers(1, 1 << 62, (tables, m)) * 2 + 1, rng.standard_normal((dim, BITS))
                    a, off, mix, signs = made[dim]
                    at = np.flatnonzero(dims == dim)
                    x = flat[starts[at, None] + np.arange(dim)]
                    x = x / np.sqrt((x * x).sum(1))[:, None]
                    whole_numbers = np.floor((x @ a + off) / width).astype(np.int64).reshape(-1, tables, m)
                    key = np.full((len(at), tables), dim, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(tables, dtype=np.uint64)
                    for j in range(m):
                        key = (key ^ whole_numbers[:, :, j].astype(np.uint64)) * mix[:, j].astype(np.uint64)
                        key ^= key >> np.uint64(32)
                    keys[at] = key.view(np.int64)
                    sketch[at] = np.packbits(x @ signs > 0, axis=1).view(np.int64)
                cols = [pa.ListArray.from_arrays(np.arange(0, (len(b) + 1) * tables, tables, dtype=np.int32), pa.array(keys.ravel())), *(pa.array(sketch[:, j]) for j in range(4))]
                yield pa.RecordBatch.from_arrays([b.column("c"), y, b.column("n"), b.column("least"), *cols], ["c", "y", "n", "least", "keys", "s0", "s1", "s2", "s3"])

    made = classes.mapInArrow(run, "c bigint, y array<double>, n bigint, least bigint, keys array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    return materialize(made.withColumn("rank", F.xxhash64("c", F.lit(seed))).withColumn("norm", F.sqrt(dot("y", "y"))), "hashed")


def _differ(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.col(f"{a}.s{j}").bitwiseXOR(F.col(f"{b}.s{j}"))) for j in range(4)), F.lit(0))


def _bits(angle: float) -> float:
    """Bits in which sketches at this angle differ, at most, but for chance."""
    p = min(0.5, angle / math.pi)
    return BITS * p + OFF * math.sqrt(BITS * p * (1 - p))


def _members(hashed: DataFrame, half: float) -> DataFrame:
    """Classes with ``ball`` (class of its centre) and ``near``, the cosine to it."""
    firsts = hashed.select("c", "rank", "s0", "s1", "s2", "s3", F.explode(F.slice("keys", 1, BALL_TABLES)).alias("key"))
    lead = firsts.groupBy("key").agg(F.min(F.struct("rank", "c", "s0", "s1", "s2", "s3")).alias("l")).select("key", F.col("l.*"))
    close = (F.col("a.rank") > F.col("b.rank")) & (_differ("a", "b") <= int(_bits(half)))
    tried = firsts.alias("a").join(lead.alias("b"), (F.col("a.key") == F.col("b.key")) & close).select("a.c", F.col("b.c").alias("l"), F.col("b.rank").alias("r")).distinct()
    centre = hashed.select(F.col("c").alias("l"), F.col("y").alias("ly"), F.col("norm").alias("ln"))
    tried = tried.join(centre, "l").join(hashed.select("c", "y", "norm"), "c").where(F.size("y") == F.size("ly"))
    cosine = dot("y", "ly") / (F.col("norm") * F.col("ln"))
    joined = tried.select("c", "r", "l", cosine.alias("near")).where(F.col("near") >= math.cos(half) + SLACK).groupBy("c").agg(F.min(F.struct("r", "l", "near")).alias("t"))
    found = hashed.join(joined, "c", "left")
    own = found.select(*hashed.columns, F.coalesce("t.l", "c").alias("ball"), F.coalesce("t.near", F.lit(1.0)).alias("near"))
    return materialize(own, "members")


def _tiles(partial: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """``(c, q, n)``: rows linked to ``c`` in ball ``q``, of ``partial(c, y, norm, q)``, by blocks."""

    def packed(df: DataFrame, *more: str) -> DataFrame:
        sizes = df.groupBy("q").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        dealt = df.join(sizes, "q").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))
        return dealt.groupBy("q", "block").agg(F.collect_list(F.struct("c", "y", "norm", *more)).alias("all"))

    mine = packed(partial).select("q", F.col("all").alias("a"))
    theirs = packed(members.withColumnRenamed("ball", "q").join(partial.select("q").distinct(), "q"), "n").select("q", F.col("all").alias("b"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def parts(rows: object, i: int) -> tuple:
            rows = rows[i].values
            return rows.field("c").to_numpy(), np.array(rows.field("y").to_pylist()), rows.field("norm").to_numpy(), rows

        for batch in batches:
            for i in range(len(batch)):
                c, x, nx, _ = parts(batch.column("a"), i)
                _, y, ny, rows = parts(batch.column("b"), i)
                linked = ((x @ y.T) / (nx[:, None] * ny) >= cosine) @ rows.field("n").to_numpy()
                at = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays([pa.array(c[at]), pa.array(np.full(len(at), batch.column("q")[i].as_py())), pa.array(linked[at])], ["c", "q", "n"])

    return mine.join(theirs, "q").select("q", "a", "b").mapInArrow(run, "c bigint, q bigint, n bigint")


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", cosine: float = 0.9, recall: float = RECALL, seed: int = 42) -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, ``n_links`` (other vectors of
    cosine ``cosine`` or more that are found), ``component_id`` (smallest id
    reachable by links, itself included) and ``kept`` (it is its own component's id).

    Vectors that are null, zero, empty or hold null or non-finite components link
    with nothing, nor do rows of null id, which are kept; vectors link with those of
    their own dimension. Rows that repeat id and vector are one vector, and each has
    its row; an id with several vectors is that many, which share a component only if
    they link. An empty table gives no rows. Other columns are ignored, whatever their
    names. Ids are bigint; ``cosine`` is above 0 and below 1.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), scaled(vec).alias("y"))
    once = rows.where("id is not null and y is not null").groupBy("id", "y").agg(F.count("*").alias("copies"))
    classes = once.groupBy("y").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "directions")
    width, m, tables = plan(classes.count(), cosine, recall)
    angle = math.acos(cosine)
    half = angle / 2
    hashed = _hashed(classes, width, m, tables, seed)
    members = _members(hashed, half)
    balls = members.groupBy("ball").agg(F.sum("n").alias("size"), F.count("*").alias("heads"), F.min("c").alias("first"), F.min("near").alias("near"), F.min("least").alias("least"))
    centre = hashed.select(F.col("c").alias("ball"), F.col("y").alias("qy"), F.col("norm").alias("qn"), "s0", "s1", "s2", "s3")
    radius = F.when((F.col("heads") == 1) & (F.col("first") == F.col("ball")), 0.0).otherwise(F.acos(F.least("near", F.lit(1.0))) + SLACK)
    balls = materialize(balls.join(centre, "ball").withColumn("radius", radius), "balls")
    # tables hold a ball once a key; a ball's own bits allow for its radius
    spread = F.ceil(F.col("radius") * (BITS / math.pi * 1.25))
    brief = balls.select("ball", "heads", "s0", "s1", "s2", "s3", spread.cast("int").alias("spread"))
    posted = members.select("ball", F.explode("keys").alias("key"), "c").join(brief, "ball")
    keep = ["key", "ball", "s0", "s1", "s2", "s3", "spread"]
    posted = posted.where("heads = 1").select(keep).union(posted.where("heads > 1").select(keep).dropDuplicates(["key", "ball"]))
    posted = materialize(posted, "tables")
    near = (F.col("a.ball") < F.col("b.ball")) & (_differ("a", "b") <= int(_bits(angle)) + F.col("a.spread") + F.col("b.spread"))
    met = posted.alias("a").join(posted.alias("b"), (F.col("a.key") == F.col("b.key")) & near).select(F.col("a.ball").alias("p"), F.col("b.ball").alias("q"))
    met = materialize(met.distinct(), "met")
    both = met.union(met.select("q", "p"))
    own = members.select(F.col("ball").alias("p"), "c", "y", "norm")
    target = balls.select(F.col("ball").alias("q"), "qy", "qn", "size", "radius")
    faced = both.join(target, "q").join(own, "p").where(F.size("y") == F.size("qy"))
    faced = faced.select("p", "q", "c", "y", "norm", "size", "radius", (dot("y", "qy") / (F.col("norm") * F.col("qn"))).alias("to"))
    gap = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("to"))))
    whole = F.when(F.col("radius") == 0, F.col("to") >= cosine).otherwise(gap + F.col("radius") + SLACK <= angle)
    open_ = ~whole & (F.col("radius") > 0) & (gap - F.col("radius") - SLACK <= angle)
    faced = materialize(faced.select("p", "q", "c", "size", whole.alias("whole"), F.when(open_, F.col("y")).alias("y"), "norm").where(F.col("whole") | F.col("y").isNotNull()), "faced")
    tiles = materialize(_tiles(faced.where("not whole").select("c", "y", "norm", "q"), members, cosine), "tiles")
    ball_of = members.select("c", F.col("ball").alias("p"))
    edges = faced.where("whole").select(F.col("p").alias("u"), F.col("q").alias("v")).union(tiles.select("c", F.col("q").alias("v")).join(ball_of, "c").select(F.col("p").alias("u"), "v"))
    roots = connected_components(edges).select(F.col("node").alias("ball"), "root")
    rooted = balls.select("ball", "size", "least").join(roots, "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("ball", "size", "component_id")
    counted = faced.where("whole").select("c", F.col("size").alias("n")).union(tiles.select("c", "n")).groupBy("c").agg(F.sum("n").alias("others"))
    result = members.select("c", "y", "ball").join(named, "ball").join(counted, "c", "left")
    result = materialize(result.select("y", "component_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links")), "linked")
    for table in (classes, hashed, members, balls, posted, met, faced, tiles):
        discard(table)
    out = rows.join(result, "y", "left")
    fine = F.col("id").isNotNull() & F.col("component_id").isNotNull()
    component = F.when(fine, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.when(fine, F.col("links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
