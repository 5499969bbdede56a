"""Exact duplicates by counting quotient filters and byte verification.

1. Every text gets a 64-bit fingerprint. Each partition builds a counting
   quotient filter of its fingerprints, cut by leading bits into segments.
2. Segments of all partitions merge by their sorted remainders; counts add up.
   Quotient and remainder together are the whole fingerprint, so nothing is lost.
3. Fingerprints with a merged count above one route their texts to byte
   verification. A map-side prefilter holds the leading ``PREFILTER_BITS`` bits
   of such fingerprints, at most 2^20 numbers whatever the corpus, and is what
   is broadcast. What passes is grouped by its bytes, pre-aggregated per
   partition, so a group of copies sends one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

PREFILTER_BITS = 20
#: Leading bits that are a filter's quotients.
QUOTIENT_BITS = 16
#: Distinct fingerprints that a merged segment is meant to hold.
SEGMENT_KEYS = 1 << 16


class CountingQuotientFilter:
    """A set of 64-bit fingerprints with counts.

    The leading ``q`` bits of a fingerprint are its quotient, the others its
    remainder. ``runends[i]`` is where the run of quotient ``i`` ends in the
    slots; the remainders of a run are sorted; ``counts`` lies beside the slots.
    """

    def __init__(self, q: int, runends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.runends, self.remainders, self.counts = q, runends, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, q: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        keys = fingerprints[order]
        each = np.ones(len(keys), np.int64) if counts is None else counts[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        keys, each = keys[starts], np.add.reduceat(each, starts) if len(keys) else each
        r = np.uint64(64 - q)
        runs = np.bincount((keys >> r).astype(np.int64), minlength=1 << q)
        return cls(q, np.cumsum(runs), keys & np.uint64((1 << (64 - q)) - 1), each)

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(1 << self.q, dtype=np.uint64), np.diff(self.runends, prepend=0))
        return (quotients << np.uint64(64 - self.q)) | self.remainders

    def count(self, fingerprint: int) -> int:
        i, rest = fingerprint >> 64 - self.q, fingerprint & (1 << 64 - self.q) - 1
        lo, hi = int(self.runends[i - 1]) if i else 0, int(self.runends[i])
        at = lo + int(np.searchsorted(self.remainders[lo:hi], np.uint64(rest)))
        return int(self.counts[at]) if at < hi and int(self.remainders[at]) == rest else 0

    def join(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' slots in one, without sorting: each remainder of ``other``
        is placed among the sorted ones of the same quotient's run."""
        mine, theirs = self.fingerprints(), other.fingerprints()
        at = np.searchsorted(mine, theirs)
        known = np.zeros(len(theirs), bool)
        inner = at < len(mine)
        known[inner] = mine[at[inner]] == theirs[inner]
        counts = self.counts.copy()
        counts[at[known]] += other.counts[known]
        new = ~known
        runs = np.bincount((theirs[new] >> np.uint64(64 - self.q)).astype(np.int64), minlength=1 << self.q)
        return CountingQuotientFilter(self.q, self.runends + np.cumsum(runs), np.insert(self.remainders, at[new], other.remainders[new]), np.insert(counts, at[new], other.counts[new]))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter with the summed counts; halves of the list merge first, so
        that a slot moves a logarithmic number of times."""
        if len(filters) < 2:
            return filters[0]
        mid = len(filters) // 2
        return cls.merge(filters[:mid]).join(cls.merge(filters[mid:]))

    def segments(self, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leading ``bits`` <= q, fingerprints, counts) of non-empty segments."""
        keys = self.fingerprints()
        heads = keys >> np.uint64(64 - bits)
        starts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]]) if len(keys) else []
        for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
            yield int(heads[s]), keys[s:e], self.counts[s:e]


def merged_counts(fps: DataFrame, segment_bits: int) -> DataFrame:
    """``fps(fp bigint)`` to ``(fp, n)`` for the fingerprints counted above one."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One filter a partition; batches merge as they come.
        own: list[CountingQuotientFilter] = []
        for f in frames:
            own.append(CountingQuotientFilter.build(f["fp"].to_numpy(np.int64).view(np.uint64), QUOTIENT_BITS))
            if len(own) == 16:
                own = [CountingQuotientFilter.merge(own)]
        if own:
            rows = [(s, k.tobytes(), c.tobytes()) for s, k, c in CountingQuotientFilter.merge(own).segments(segment_bits)]
            yield pd.DataFrame(rows, columns=["segment", "keys", "counts"])

    def merge(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        parts = [CountingQuotientFilter.build(np.frombuffer(k, np.uint64), QUOTIENT_BITS, np.frombuffer(c, np.int64)) for k, c in zip(f["keys"], f["counts"], strict=True)]
        one = CountingQuotientFilter.merge(parts)
        many = one.counts > 1
        return pd.DataFrame({"fp": one.fingerprints()[many].view(np.int64), "n": one.counts[many]})

    cut = fps.select("fp").mapInPandas(build, "segment int, keys binary, counts binary")
    return cut.groupBy("segment").applyInPandas(merge, "fp bigint, n bigint")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep_id`` (largest id of the
    rows with this text), ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their bytes are. A null text counts as the empty one.
    A null id is smaller than any other; if a group has only null ids,
    ``keep_id`` is null and all its rows are kept. Rows that repeat the largest
    id are all kept. An empty table gives no rows; other columns are ignored,
    whatever their names. Very long texts are compared whole, in the JVM.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select(F.col(id_col).alias("id"), body.alias("body")).withColumn("fp", F.xxhash64("body"))
    keys = materialize(hashed.select("id", "fp", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha")), "keys")

    bits = min(16, max(8, (keys.count() // SEGMENT_KEYS).bit_length()))
    repeated = materialize(merged_counts(keys, bits), "repeated")

    head = F.shiftrightunsigned("fp", 64 - PREFILTER_BITS)
    heads = repeated.select(head.alias("head")).distinct()
    routed = hashed.join(F.broadcast(heads), head == F.col("head"), "left_semi")
    # Byte verification: the bytes are the grouping key.
    verified = (
        routed.groupBy("body")
        .agg(F.count("*").alias("n"), F.max("id").alias("keep_id"))
        .where("n > 1")
        .select("n", "keep_id", F.xxhash64("body").alias("g_fp"), F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("g_sha"))
    )
    out = keys.join(verified, (keys.fp == F.col("g_fp")) & (keys.sha == F.col("g_sha")), "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
