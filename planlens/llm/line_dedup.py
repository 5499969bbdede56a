"""Repeated passages by winnowing over words; DataFrame functions only.

Texts are sequences of words, whatever lines they stand in, so that a passage is
found wherever in a line it begins or ends.

* Winnowing. A place is marked by the hash of its word. Each window of
  ``min_words`` words selects the lowest mark (ties: the leftmost) that has
  ``GRAM`` words in the window; these words are the fingerprint. Equal windows
  select alike, so a passage of ``min_words`` words that occurs twice has a
  fingerprint at the same word of both. Consecutive windows that select one place
  are a block, and a row: its place, its fingerprint and one hash of its words.
* Joining positions. Fingerprints at one place only are done with. Equal blocks of
  one fingerprint match whole; all but the first, by id and place, are later.
* Extending. Where a fingerprint has different blocks, a match ends inside them:
  the first of each kind goes on a word at a time both ways, its windows being
  compared one by one.
* Deleting. Later windows that overlap or touch make one run, the maximal match.

So a word goes if it lies in a window of ``min_words`` words that occurs earlier in
the corpus. A text of fewer words is compared whole with other such texts.

Words are compared by 64-bit hashes. No pair of documents is ever formed: a
passage in a third of all documents costs rows in proportion, and keys that hold
more than 1/``HOT`` of the rows, which are under ``HOT``, are joined by broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, materialize

MIN_WORDS = 50
#: Words of a fingerprint: at most ``GRAM``, or more where a window would have over ``SPAN`` + 1 marks.
GRAM, SPAN = 16, 64
#: Neighbours with which a mark is compared before all of a window.
NEAR = 3
#: Windows that begin in a piece of a text.
PIECE = 1 << 16
#: Keys with over a share of 1 / HOT of all rows are joined by broadcast.
HOT = 1000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _words(text: Column) -> Column:
    """The words of a text; one empty word if it has none."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), f"[{SPACE}]+")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _hashed(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _names(docs: DataFrame, id_col: str, text: str) -> list[Column]:
    """``id, th``: what tells documents apart."""
    return [F.col(id_col).alias("id"), F.xxhash64(text).alias("th")]


def pieces(docs: DataFrame, id_col: str, text: str, min_words: int) -> DataFrame:
    """``(id, th, at, h)``: hashes of the words of texts, in pieces such that
    every window lies in the one in which it begins; texts without words have none."""
    most = PIECE + min_words - 1
    cut = lambda v, i: F.struct((i * PIECE).alias("at"), F.slice(v, i * PIECE + 1, F.lit(most)).alias("h"))
    one = lambda v: F.array(F.struct(F.lit(0).alias("at"), v.alias("h")))
    all_ = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - min_words) / PIECE).cast("int")), lambda i: cut(v, i))
    found = _let(_hashed(F.col(text)), lambda v: F.when(F.size(v) <= most, one(v)).otherwise(all_(v)))
    rows = docs.where(F.col(text).rlike(f"[^{SPACE}]")).select(*_names(docs, id_col, text), F.explode(found).alias("p"))
    return rows.select("id", "th", "p.at", "p.h")


def _begins(h: Column, i: Column, m: Column, span: int) -> Column:
    """Whether the window from word ``i``, whose mark is ``m``, selects another mark
    than the one before: of the marks of both, the lowest is the first, which leaves,
    or the last, which comes in. Most places are told by the ``NEAR`` marks beside."""
    leaves, enters = F.get(h, i - 1), F.get(h, i + (span - 1))
    near = range(1, min(NEAR, span - 1))
    first = (leaves <= F.least(m, m, *(F.get(h, i + d) for d in near))) & (leaves <= F.array_min(F.slice(h, i + 1, F.lit(span))))
    last = (enters < F.least(F.get(h, i + (span - 2)), *(F.get(h, i + (span - 2 - d)) for d in near), leaves)) & (enters < F.array_min(F.slice(h, i, F.lit(span))))
    return (i == 0) | first | last


def blocks(cut: DataFrame, min_words: int) -> DataFrame:
    """``(id, th, p, n, fp, content, whole)``: windows from word ``p`` to ``p + n``
    that select one fingerprint, its hash and that of all their words. Shorter
    texts have one row, of all their words, and are ``whole``."""
    gram = _gram(min_words)
    span, h, a, c, m, x = min_words - gram + 1, F.col("h"), F.col("a"), F.col("c"), F.col("m"), F.col("x")
    last, own = F.size(h) - min_words, ["id", "th", "at", "h", "a"]
    # A row a word, none of which is stored, in one generated loop. The JVM compiles methods of
    # up to 8,000 bytes only, so there are no long chains of cases in it.
    rows = cut.select("id", "th", "at", "h", F.posexplode("h").alias("a", "m"))
    rows = rows.where((a == 0) | ((a <= last) & _begins(h, a, m, span)))
    rows = rows.select(*own, F.slice(h, a + 1, F.lit(span)).alias("w")).select(*own, "w", F.array_min("w").alias("m"))
    rows = rows.select(*own, "m", (a + F.array_position("w", m).cast("int") - 1).alias("x"), a.alias("c"))
    # windows go on until a lower mark comes in, which is searched for by halves, or the mark leaves
    for d in reversed(range((span - 1).bit_length())):
        lower = F.array_min(F.slice(h, c + (span + 1), F.lit(1 << d))) < m
        rows = rows.select(*own, "m", "x", F.when(lower, c).otherwise(c + (1 << d)).alias("c"))
    whole = F.size(h) < min_words
    rows = rows.select(*own, "x", F.when(whole, last).otherwise(F.least(c, x, last) - a).alias("n"))
    fp = F.when(whole, F.xxhash64(F.lit("whole"), "h")).otherwise(F.xxhash64(F.slice(h, x + 1, F.lit(gram))))
    content = F.xxhash64(F.slice(h, a + 1, F.col("n") + min_words))
    return rows.select("id", "th", (F.col("at") + a).alias("p"), "n", fp.alias("fp"), content.alias("content"), whole.alias("whole"))


def _gram(min_words: int) -> int:
    return max(min(GRAM, (min_words + 1) // 2), min_words - SPAN)


class _Order:
    """The order of places in the corpus: by id, then by word. One number where
    ids are distinct and fit beside the words' numbers, a struct otherwise."""

    def __init__(self, docs: DataFrame, found: DataFrame, id_col: str):
        r = found.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max(F.col("p") + F.greatest("n", F.lit(0))).alias("p"), F.count("*").alias("n"), F.count("id").alias("m")).first()
        self.bits = max(1, (r["p"] or 0).bit_length())
        fits = r["n"] == r["m"] and r["n"] > 0 and -(1 << 63 - self.bits) <= r["a"] and r["b"] < 1 << 63 - self.bits
        self.plain = fits and dict(docs.dtypes)[id_col] in ("bigint", "int") and docs.groupBy(id_col).count().where("count > 1").isEmpty()

    def of(self) -> Column:
        if self.plain:
            return F.shiftleft("id", self.bits).bitwiseOR(F.col("p").cast("bigint"))
        return F.struct("id", "p", "th")

    def word(self, o: Column) -> Column:
        return o.bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int") if self.plain else o["p"]

    def next(self, o: str, i: str) -> Column:
        """The place ``i`` words on."""
        if self.plain:
            return F.col(o) + F.col(i)
        return F.struct(F.col(o)["id"].alias("id"), (F.col(o)["p"] + F.col(i)).alias("p"), F.col(o)["th"].alias("th"))

    def doc(self, o: Column) -> Column:
        return F.shiftright(o, self.bits) if self.plain else F.struct(o["id"].alias("id"), o["th"].alias("th"))

    def named(self, id_col: str, text: str) -> Column:
        own = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"))
        return (F.col(id_col).cast("bigint") if self.plain else own).alias("doc")


def _joined(rows: DataFrame, ones: DataFrame, key: Sequence[str], some: Column | str = "true") -> DataFrame:
    """Inner join of ``rows`` with ``some`` on ``key`` with ``ones``, a row a key,
    whose ``_n`` is the key's number of rows. ``rows`` is a written table. Keys with
    over a share of 1 / HOT of its rows are at most HOT and are broadcast, the
    others go by shuffle: no task gets a hot key."""
    few, ones = rows.count() // HOT, materialize(ones, "ones")
    hot, rest = ones.where(F.col("_n") > few), ones.where(F.col("_n") <= few)
    rows = rows.where(some)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def _firsts(rows: DataFrame, key: Sequence[str], *more: Column) -> DataFrame:
    """A row for each ``key``: the first place ``_lo`` of it in the order ``o``, the last, and their number."""
    return rows.groupBy(*key).agg(F.min("o").alias("_lo"), F.max("o").alias("_hi"), F.count("*").alias("_n"), *more)


def _later(rows: DataFrame, firsts: DataFrame, key: Sequence[str], some: Column | str = "true") -> DataFrame:
    """``rows``, a written table, with ``some`` but for the first of each ``key``."""
    return _joined(rows, firsts.where("_lo <> _hi").select(*key, "_lo", "_n"), key, some).where("o <> _lo").select(*rows.columns)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, Column]:
    """``(doc, runs)``: runs of words (structs ``s, e``, counted from 0 in the
    text) that repeat earlier ones; and ``doc`` of a row of ``docs``. Rows of equal
    id and text are one document."""
    found = materialize(blocks(pieces(docs, id_col, text, min_words), min_words), "blocks")
    order = _Order(docs, found, id_col)
    placed = found.withColumn("o", order.of()).drop("id", "th", "p")
    shared = _firsts(placed, ["fp"]).where("_lo <> _hi").select("fp", "_n")
    kept = materialize(_joined(placed, shared, ["fp"]).drop("_n"), "shared")
    discard(found)
    p = order.word(F.col("o"))
    # a run as one number: collected and sorted faster than a struct
    part = [order.doc(F.col("o")).alias("doc"), F.shiftleft(p.cast("bigint"), 32).bitwiseOR((p + F.col("n") + min_words - 1).cast("bigint")).alias("run")]
    key = ["fp", "content"]
    firsts = materialize(_firsts(kept, key, F.first("n").alias("n"), F.first("whole").alias("whole")), "firsts")
    parts = _later(kept, firsts, key).select(*part)
    # Where blocks differ, the windows of the first of each kind: any other occurrence of a window is later.
    mixed = firsts.where("not whole").groupBy("fp").agg(F.count("*").alias("_n")).where("_n > 1")
    open_ = _joined(firsts.drop("_n").withColumnRenamed("_lo", "o"), mixed, ["fp"])
    open_ = open_.groupBy(order.doc(F.col("o")).alias("_doc")).agg(F.collect_set(F.struct("o", "n")).alias("open"))
    texts = docs.select(order.named(id_col, text), F.col(text).alias("text"))
    texts = texts.join(open_, F.col("doc") == F.col("_doc"))
    windows = texts.select("open", F.explode(F.array(_hashed(F.col("text")))).alias("h")).select("h", F.explode("open").alias("w"))
    windows = windows.select("h", "w.*").select("h", "o", F.explode(F.sequence(F.lit(0), "n")).alias("i"))
    content = F.xxhash64(F.slice("h", p + F.col("i") + 1, F.lit(min_words)))
    windows = materialize(windows.select(order.next("o", "i").alias("o"), content.alias("content")), "windows")
    again = _later(windows, _firsts(windows, ["content"]), ["content"]).withColumn("n", F.lit(0))
    by_doc = parts.union(again.select(*part)).groupBy("doc").agg(F.sort_array(F.collect_list("run")).alias("v"))
    return by_doc.select("doc", _chains(F.col("v")).alias("runs")), order.named(id_col, text)


def _chains(parts: Column) -> Column:
    """Sorted runs of words (``s`` in the upper half of a number, ``e`` in the lower) as structs, joined where they overlap or touch."""
    run = "struct<s:int,e:int>"
    state = F.struct(F.lit(None).cast(run).alias("now"), F.array().cast(f"array<{run}>").alias("done"))
    closed = lambda acc: F.concat(acc["done"], F.array(acc["now"]))

    def step(acc: Column, x: Column) -> Column:
        now, s, e = acc["now"], F.shiftright(x, 32).cast("int"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        wider = F.struct(now["s"].alias("s"), F.greatest(now["e"], e).alias("e"))
        own = F.struct(s.alias("s"), e.alias("e"))
        apart = F.struct(own.alias("now"), F.when(now.isNull(), acc["done"]).otherwise(closed(acc)).alias("done"))
        return F.when(s <= now["e"] + 1, F.struct(wider.alias("now"), acc["done"].alias("done"))).otherwise(apart)

    return F.aggregate(parts, state, step, closed)


def _line_of_words(lines: Column) -> Column:
    """The number of its line, for each word."""

    def numbers(line: Column, i: Column) -> Column:
        return _let(_words(line), lambda ws: F.array_repeat(i, F.when(ws[0] == "", 0).otherwise(F.size(ws))))

    return F.flatten(F.transform(lines, numbers))


def _ranges(text: Column, runs: Column) -> Column:
    """Runs of words as ``a, b, head, tail``: lines from ``a`` to ``b`` but for
    the first ``head`` words of ``a`` and the last ``tail`` words of ``b``."""

    def range_(r: Column, of: Column, back: Column) -> Column:
        a, b = F.get(of, r["s"]), F.get(of, r["e"])
        head = (r["s"] + 1 - F.array_position(of, a)).cast("int")
        tail = (F.size(of) - r["e"] - F.array_position(back, b)).cast("int")
        return F.struct(a.alias("a"), b.alias("b"), head.alias("head"), tail.alias("tail"))

    def last(of: Column) -> Column:
        return _let(F.reverse(of), lambda back: F.transform(runs, lambda r: range_(r, of, back)))

    return _let(_line_of_words(_lines(text)), last)


def _without(text: Column, cut: Column) -> Column:
    """``text`` without the ranges ``cut``; a word goes with the white space
    after it, lines of which nothing is left go whole."""

    def rest(line: Column, i: Column, on: Column) -> Column:
        # words with the white space after them; null if the line goes
        def left(ws: Column) -> Column:
            n = F.size(ws)
            gone = lambda j: F.exists(on, lambda r: (j >= F.when(i == r["a"], r["head"]).otherwise(0)) & (j < n - F.when(i == r["b"], r["tail"]).otherwise(0)))
            return _let(F.filter(ws, lambda w, j: ~gone(j)), lambda kept: F.when(F.size(kept) > 0, F.array_join(kept, "")))

        return _let(F.regexp_extract_all(line, F.lit(f"(^[{SPACE}]*)?[^{SPACE}]+[{SPACE}]*"), F.lit(0)), left)

    def one(line: Column, i: Column) -> Column:
        on = F.filter(cut, lambda r: i.between(r["a"], r["b"]))
        gone = lambda r: ((i > r["a"]) | (r["head"] == 0)) & ((i < r["b"]) | (r["tail"] == 0))
        return _let(on, lambda o: F.when(F.size(o) == 0, line).when(F.exists(o, gone), F.lit(None)).otherwise(rest(line, i, o)))

    return F.array_join(F.filter(F.transform(_lines(text), one), lambda x: x.isNotNull()), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs cut from ``text``, plus ``removed``
    (array of structs ``a, b, head, tail``: the line ranges of the deleted runs
    and the words that stay at the start of ``a`` and at the end of ``b``).

    Null texts stay null and texts without words stay as they are. A text of under
    ``min_words`` words goes whole if an earlier text is equal in words; in longer
    texts, repeats of fewer words stay. Very long texts are taken in pieces that
    overlap by a window. Lines without words survive outside runs. Rows that repeat id and text are one document and
    are cut alike; null ids come first in corpus order. Passages repeated inside
    a document count as later too. An empty table gives no rows. Other columns
    stay; one named ``removed`` is replaced.
    """
    runs, named = repeated_runs(docs, id_col, text, min_words)
    keep = [c for c in docs.columns if c != "removed"]
    # the input's columns travel in one struct, so that no name can clash
    out = docs.select(F.struct(*keep).alias("row"), named.alias("name")).join(runs.select(F.col("doc").alias("name"), "runs"), "name", "left")
    body = F.col("row").getField(text)
    none = F.array().cast("array<struct<a:int,b:int,head:int,tail:int>>")
    cut = F.when(F.col("runs").isNull(), none).otherwise(_ranges(body, F.col("runs")))
    done = F.when(F.col("runs").isNull(), F.struct(body.alias("t"), none.alias("r"))).otherwise(_let(cut, lambda c: F.struct(_without(body, c).alias("t"), c.alias("r"))))
    # a generator, so that the cut is computed once
    out = out.select("row", F.explode(F.array(done)).alias("done"))
    return out.select(*(F.col("done.t").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in keep), F.col("done.r").alias("removed"))
