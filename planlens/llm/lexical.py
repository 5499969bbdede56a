"""Ranked lexical search by MaxScore over shards of an inverted index.

Documents are cut into shards of bounded size; a shard is one row that holds its
documents' ids and lengths and, for each term, the sorted places and frequencies of
the documents that hold it. Counts of the corpus (documents, terms, document
frequencies) are sums over all shards.

Within a shard an item's terms are ordered by their upper bounds, the largest
impact of any document of the shard. Lists are added up from the top while a
document that none of them holds could still reach the ``k``-th best score: these
are the essential ones. The others are only probed, for documents whose score with
all bounds left could still reach it. A task carries each item's ``k``-th best
score on from shard to shard.

Items are asked in blocks of bounded size, so that neither the driver nor a task
holds more than a block; what tasks return is ``k`` rows an item at most.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Documents and bytes of text of a shard; one document at least.
SHARD_DOCS, SHARD_BYTES = 16_384, 64 << 20
#: Items and bytes of terms of a block, about.
BLOCK_ITEMS, BLOCK_BYTES = 1024, 8 << 20
#: If the items' terms are no more and no longer than this, the index holds no others.
VOCABULARY, VOCABULARY_BYTES = 1 << 18, 16 << 20
#: Lists between two looks at the k-th best score.
LOOK = 4

#: ASCII other than letters and digits parts terms; A-Z become lower case; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


_SHARD = "ids binary, nulls binary, lens binary, terms array<binary>, counts array<int>, docs binary, tfs binary, n_docs bigint, n_terms bigint"


def index(docs: DataFrame, id_col: str, text: str, only: set[bytes] | None = None) -> DataFrame:
    """Shards of ``docs``, written. With ``only``, no other terms are listed; lengths count all."""

    def shard(ids: list, lens: list, posted: dict) -> object:
        import pyarrow as pa

        names = sorted(posted)
        flat = [x for t in names for x in posted[t]]
        pairs = np.array(flat, np.int32).reshape(-1, 2)
        row = (
            np.array([0 if i is None else i for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.bool_).tobytes(), np.array(lens, "<i8").tobytes(),
            names, [len(posted[t]) for t in names], pairs[:, 0].tobytes(), pairs[:, 1].tobytes(), sum(n > 0 for n in lens), sum(lens),
        )
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _SHARD.split(", ")])

    def run(batches: Iterator) -> Iterator:
        ids, lens, posted, size = [], [], {}, 0
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                words = terms(t.as_py())
                for word, n in Counter(words).items():
                    if only is None or word in only:
                        posted.setdefault(word, []).append((len(ids), n))
                ids.append(i)
                lens.append(len(words))
                size += sum(map(len, words)) + len(words)
                if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield shard(ids, lens, posted)
                    ids, lens, posted, size = [], [], {}, 0
        if ids:
            yield shard(ids, lens, posted)

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return materialize(own.mapInArrow(run, _SHARD), "shards")


def best(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all documents of a shard that can be among the ``k``
    best and score ``least`` or more, ties of the k-th included.

    ``lists`` are (places, impacts, largest impact)."""
    lists = sorted(lists, key=lambda x: -x[2])
    left = sum(x[2] for x in lists)
    score = np.zeros(n_docs, np.int64)
    at = 0
    for docs, impact, bound in lists:  # essential
        if left < least:
            break
        score[docs] += impact
        left -= bound
        at += 1
        if at % LOOK == 0 and n_docs > k:
            least = max(least, int(np.partition(score, n_docs - k)[n_docs - k]))
    some = np.flatnonzero(score)
    some = some[score[some] + left >= least]
    for docs, impact, bound in lists[at:]:  # probed
        if not len(some):
            break
        place = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
        hit = docs[place] == some
        score[some[hit]] += impact[place[hit]]
        left -= bound
        if len(some) > k:
            now = score[some]
            least = max(least, int(np.partition(now, len(now) - k)[len(now) - k]))
        some = some[score[some] + left >= least]
    if len(some) > k:
        now = score[some]
        some = some[now >= np.partition(now, len(now) - k)[len(now) - k]]
    return some, score[some]


def _rank(shards: DataFrame, items: list[tuple[int, list[tuple[bytes, int]]]], n: int, total: int, k: int) -> DataFrame:
    """``(item, id, score)``: the ``k`` best documents of each item in each task's shards."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[int, tuple[np.ndarray, ...]] = {}
        for b in batches:
            for row in b.to_pylist():
                ids, nulls = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], np.bool_)
                norm = 8 * (100 - 90 + 90 * np.frombuffer(row["lens"], "<i8") * n // total) if total else np.zeros(len(ids), np.int64)
                docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32)
                ends = np.cumsum(row["counts"], dtype=np.int64)
                where = {t: i for i, t in enumerate(row["terms"])}
                known: dict[bytes, tuple[np.ndarray, np.ndarray, int]] = {}
                for item, asked in items:
                    lists = []
                    for term, weight in asked:
                        if term not in where or not weight:
                            continue
                        if term not in known:
                            i = where[term]
                            s = slice(int(ends[i]) - row["counts"][i], int(ends[i]))
                            tf = tfs[s].astype(np.int64)
                            impact = weight * (1_000_000_000 * tf // (1000 * tf + norm[docs[s]]))
                            known[term] = docs[s], impact, int(impact.max())
                        lists.append(known[term])
                    before = found.get(item)
                    least = max(1, int(before[2][k - 1])) if before and len(before[2]) >= k else 1
                    at, score = best(lists, len(ids), k, least)
                    if len(at):
                        own = (ids[at], nulls[at], score)
                        every = [np.concatenate(x) for x in zip(before, own, strict=True)] if before else own
                        order = np.lexsort((every[0], every[1], -every[2]))[:k]
                        found[item] = tuple(x[order] for x in every)
        for item, (i, null, score) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), item)), pa.array(i, mask=null), pa.array(score)], ["item", "id", "score"])

    return shards.select("ids", "nulls", "lens", "terms", "counts", "docs", "tfs").mapInArrow(run, "item bigint, id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_col, rank, doc_id, score)``: the ``k`` documents of highest score
    above 0 for each row of ``items``, equal scores by ascending id.

    A term's weight is floor(1000 * ln((2N+2) / (2df+1))), a document's score the
    sum over the item's distinct terms of weight * (10^9 tf div (1000 tf + 8 m))
    with m = 10 + (90 n N) div L. Null, empty and wordless texts have no terms: such
    documents count for nothing and such items return nothing. Rows that repeat are
    rows of their own, of ``docs`` and ``items``; null ids stand after others of equal
    score. Long texts are read whole. Empty tables give no rows. Other columns are
    ignored, whatever their names; ids of documents are bigint.
    """
    spark = docs.sparkSession

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            own = [sorted(set(terms(t.as_py()))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(own, pa.list_(pa.binary()))], ["item", "terms"])

    asked = items.select(F.col(item_col).alias("name"), F.col(item_text).cast("string").alias("text"))
    asked = materialize(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    words = materialize(asked.select("item", "text").mapInArrow(split, "item bigint, terms array<binary>").select("item", F.explode("terms").alias("term")), "item-terms")
    distinct = words.select("term").distinct()
    held, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    only = {bytes(r[0]) for r in distinct.collect()} if held <= VOCABULARY and size <= VOCABULARY_BYTES else None
    shards = index(docs, id_col, text, only)
    n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counted = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighed = materialize(words.join(counted, "term").select("item", "term", weight.alias("weight")), "weighed")
    many, bytes_ = weighed.agg(F.count_distinct("item"), F.coalesce(F.sum(F.length("term") + 16), F.lit(0))).first()
    blocks = max(1, -(-many // BLOCK_ITEMS), -(-bytes_ // BLOCK_BYTES))
    lists = weighed.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    lists = materialize(lists.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "item-blocks")
    done = []
    for block in range(blocks):
        own = [(r["item"], [(bytes(t["term"]), t["weight"]) for t in r["terms"]]) for r in lists.where(F.col("block") == block).collect()]
        done.append(materialize(_rank(shards, own, n, total, k), "ranked"))
    for table in (words, weighed, lists, shards):
        discard(table)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = functools.reduce(DataFrame.union, done).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked, "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias("doc_id"), "score")
