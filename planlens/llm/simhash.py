"""SimHash near-duplicates by a byte-position inverted index.

A fingerprint has eight positional bytes. Two fingerprints that differ in at
most ``d`` bits differ in at most ``d`` bytes, so at least ``8 - d`` positional
bytes agree: that is the guaranteed minimum of the count filter. Tallying over
single-byte posting lists would compare a share of all pairs, so the index is
keyed by *sets* of positional bytes of exactly that minimum size: a pair
meets under some key exactly when its tally reaches the minimum. For ``d = 2``
that is 28 keys of 48 bits a fingerprint, and a posting list holds at most
65,536 distinct fingerprints whatever the corpus, because only 16 bits are free.

Within a list each pair that can link is verified on all bits, but a list emits
a spanning forest of its links rather than the links themselves, so a group of
near copies gives rows in proportion to its members and keeps its connectivity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions
from .components import connected_components

WIDTH = 8
#: Shingles hashed at a time; bounds a worker's memory on very long texts.
BLOCK = 1 << 16
#: Shingles compared by Jaccard similarity; minhash bands that find the pairs (at 0.8 all but 0.04 %).
WORDS, BANDS, ROWS = 5, 20, 5


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text; 0 if it is null or has no words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle)), strict=False))
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    counts = np.zeros((WIDTH, 8), np.int64)
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        h = np.fromiter(islice(map(xxhash.xxh64_intdigest, grams, repeat(seed)), size), np.uint64, size)
        planes = h.view(np.uint8).reshape(size, WIDTH)
        if size < 256:
            counts += np.unpackbits(planes, axis=1, bitorder="little").sum(0, dtype=np.int64).reshape(WIDTH, 8)
        else:
            for k in range(WIDTH):
                counts[k] += np.bincount(planes[:, k], minlength=256) @ bits
    return int.from_bytes(np.packbits((2 * counts > n).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` without its text, plus ``fp bigint`` (the fingerprint's bits)."""
    import pyarrow as pa

    keep = [c for c in docs.columns if c not in (text, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in b.column(text)]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fp], [*keep, "fp"])

    schema = docs.select(*keep, F.lit(0).cast("bigint").alias("fp")).schema
    return docs.select(*keep, text).mapInArrow(run, schema)


def tally(differing: np.ndarray) -> np.ndarray:
    """How many positional bytes pairs share, by the bits in which they differ."""
    return (np.ascontiguousarray(differing).view(np.uint8).reshape(*differing.shape, WIDTH) == 0).sum(-1)


def _linked(differing: np.ndarray, most: int) -> np.ndarray:
    """The count filter, then the check of all bits."""
    return (tally(differing) >= WIDTH - most) & (np.bitwise_count(differing) <= most)


def _forest(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) links of one posting list: sorted distinct fingerprints."""
    n = len(fps)
    roots = np.arange(n)
    if n <= 256:
        near = _linked(fps[:, None] ^ fps[None, :], most)
        step = lambda r: np.where(near, r[None, :], n).min(1)
    else:  # probe the free bits instead of comparing all pairs
        free = int(np.bitwise_or.reduce(fps ^ fps[0]))
        bits = [1 << i for i in range(64) if free >> i & 1]
        flips = [sum(c) for k in range(1, most + 1) for c in combinations(bits, k)]
        neighbours = []
        for x in flips:
            other = fps ^ np.uint64(x)
            at = np.minimum(np.searchsorted(fps, other), n - 1)
            neighbours.append(np.where(fps[at] == other, at, np.arange(n)))

        def step(r: np.ndarray) -> np.ndarray:
            out = r.copy()
            for x in neighbours:
                np.minimum(out, out[x], out=out)
            return out

    while True:
        new = step(roots)
        new = np.minimum(new, new[new])
        if (new == roots).all():
            break
        roots = new
    linked = roots != np.arange(n)
    return fps[linked], fps[roots[linked]]


def links(distinct: DataFrame, most: int = 2) -> DataFrame:
    """``distinct(fp)`` to ``(u, v)``: links whose closure is the closure of all
    pairs at ``most`` or fewer differing bits."""
    import pyarrow as pa

    spark = distinct.sparkSession
    need = WIDTH - most
    masks = [sum(0xFF << 8 * k for k in kept) for kept in combinations(range(WIDTH), need)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entry = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(signed)))).alias("e")
    posted = distinct.select("fp", entry).select("fp", "e.mask", "e.bytes")
    posted = posted.repartition(partitions(spark), "mask", "bytes").sortWithinPartitions("mask", "bytes", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in (*batches, None):
            if b is not None:
                new = [b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "bytes", "fp")]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if not held or not len(held[0]):
                continue
            mask, key, fp = held
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            if b is not None:  # the last list may go on in the next batch
                held = [x[starts[-1] :] for x in held]
                ends, starts = starts[1:], starts[:-1]
            else:
                ends = np.r_[starts[1:], len(fp)]
            fp = fp.view(np.uint64)
            size = ends - starts
            two = starts[size == 2]
            close = _linked(fp[two] ^ fp[two + 1], most)
            us, vs = [fp[two + 1][close]], [fp[two][close]]
            for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
                u, v = _forest(np.sort(fp[s:e]), most)
                us.append(u)
                vs.append(v)
            u, v = (np.concatenate(x).view(np.int64) for x in (us, vs))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return posted.mapInArrow(run, "u bigint, v bigint")


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted; words as in ``fingerprint``."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingle = min(shingle, len(words))
    grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of ``ROWS`` minima each; equal with probability J ** ROWS."""
    rng = np.random.default_rng(7)
    flip, factor = (rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        x = (hashes[at : at + 1024, None] ^ flip) * factor
        np.minimum(least, (x ^ x >> np.uint64(32)).min(0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def similar_texts(docs: DataFrame, text: str, shingle: int, jaccard: float) -> DataFrame:
    """``(x, y)``: hashes of texts whose shingle sets have exact Jaccard similarity
    ``jaccard`` or more; their closure is that of all such pairs that share a band's key.

    In a list each text first meets the least and the three before it, which is all
    of a list of five. In longer lists whoever is not yet linked to most of the list
    then meets all that it is not linked to, and whose number of shingles allows it:
    nothing is left out but pairs whose ends are linked already."""
    import pyarrow as pa

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ths, keys, sizes = [], [], []
            for th, t in zip(b.column("th").to_pylist(), b.column("text"), strict=True):
                h = shingles(t.as_py(), shingle)
                if len(h):
                    ths.append(np.full(BANDS, th, np.int64))
                    keys.append(bands(h).view(np.int64))
                    sizes.append(np.full(BANDS, len(h), np.int64))
            if ths:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ths, keys, sizes)], ["th", "key", "n"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for s, t in zip(b.column("s"), b.column("t"), strict=True):
                u, v = shingles(s.as_py(), shingle), shingles(t.as_py(), shingle)
                both = len(np.intersect1d(u, v, assume_unique=True))
                near.append(both >= jaccard * (len(u) + len(v) - both) - 1e-9)
            yield b.select(["x", "y"]).filter(pa.array(near, pa.bool_()))

    texts = docs.select(F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    def compared(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("x", "y")).alias("th")).distinct()
        # copies collapse where they are read, before the shuffle
        known = materialize(texts.dropDuplicates(["th"]).join(wanted, "th", "left_semi"), "texts")
        filled = pairs.join(known.select(F.col("th").alias("x"), F.col("text").alias("s")), "x")
        filled = filled.join(known.select(F.col("th").alias("y"), F.col("text").alias("t")), "y").select("x", "y", "s", "t")
        return materialize(filled.mapInArrow(verified, "x bigint, y bigint"), "similar")

    posted = materialize(texts.mapInArrow(keyed, "th bigint, key bigint, n bigint").distinct(), "bands")
    lists = posted.groupBy("key").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.count("*").alias("c"))
    lists = materialize(lists.where("lo <> hi"), "lists")
    before = [F.lag("th", k).over(Window.partitionBy("key").orderBy("th")) for k in (1, 2, 3)]
    pairs = posted.join(lists.select("key", "lo"), "key").select("th", F.array("lo", *before).alias("xs")).select("th", F.explode("xs").alias("x"))
    pairs = materialize(pairs.where("x <> th").select("x", F.col("th").alias("y")).distinct(), "pairs")
    near = compared(pairs)
    long = lists.where("c > 5").select("key")
    if long.isEmpty():
        return near
    comps = connected_components(near.select(F.col("x").alias("u"), F.col("y").alias("v")))
    placed = posted.join(long, "key", "left_semi").join(comps.withColumnRenamed("node", "th"), "th", "left")
    placed = materialize(placed.select("key", "th", "n", F.coalesce("root", "th").alias("root")), "placed")
    main = placed.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"))
    own = placed.join(main, "key").where("root <> main").select("key", "main", F.col("th").alias("x"), F.col("n").alias("xn"), F.col("root").alias("xr"))
    met = own.join(placed.withColumnsRenamed({"th": "y", "n": "yn", "root": "yr"}), "key")
    # of two that are both off the main group one order is enough
    met = met.where((F.col("xr") != F.col("yr")) & ((F.col("yr") == F.col("main")) | (F.col("x") < F.col("y"))))
    met = met.where(F.least("xn", "yn") >= jaccard * F.greatest("xn", "yn") - 1e-9)
    rest = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    rest = materialize(rest.join(pairs, ["x", "y"], "left_anti"), "rest")
    return near.union(compared(rest))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 2, jaccard: float | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fingerprint`` (16 lower-case
    hex digits), ``component_id`` (smallest id reachable over links).

    Null and wordless texts have fingerprint zero and link like any other; rows
    with equal texts or ids each get their row; null ids stay null and never
    name a component unless all its ids are null; an empty table gives no rows;
    other columns of ``docs`` are ignored. With ``jaccard``, texts whose
    ``WORDS``-word shingles are that similar link too.
    """
    own = docs.select(id_col, text, *([F.xxhash64(text).alias("_th")] if jaccard else []))
    fps = materialize(fingerprints(own, text, shingle), "fps")
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    edges = links(distinct.select("fp"), most)
    if jaccard:
        of = fps.select("_th", "fp").distinct()
        near = similar_texts(docs, text, WORDS, jaccard)
        near = near.join(of.select(F.col("_th").alias("x"), F.col("fp").alias("u")), "x").join(of.select(F.col("_th").alias("y"), F.col("fp").alias("v")), "y")
        edges = edges.union(near.select("u", "v"))
    comps = connected_components(edges)
    rooted = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(named, "fp").select(id_col, hexed, "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 2, jaccard: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component the row
    with the smallest id. Rows with a null id stay; of rows that repeat the
    staying id one stays, any of them. Null, empty and wordless texts are one
    component. Very long texts are hashed in blocks. An empty table gives no rows."""
    groups = simhash_groups(docs, id_col, text, shingle, most, jaccard)
    stay = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("id")).distinct()
    # the input's columns travel in one struct, so that no name can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id")).join(stay.withColumn("stays", F.lit(True)), "id", "left")
    kept = rows.where(F.col("stays") | F.col("id").isNull()).withColumn("own", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    return kept.dropDuplicates(["id", "own"]).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
