"""URL filters by a ratio of character language models; DataFrame functions only.

Two variable-order Markov models with Witten-Bell smoothing, one of accepted and
one of rejected URLs, give each character its log-likelihood ratio after up to
``ORDER`` characters. URLs are written over 32 symbols, so there are at most
32^(ORDER + 1) grams (2^20 for order 3) whatever the corpus: that bounds what is
broadcast. A URL's score is the mean over its characters; the cut between the
classes is the score at which the balanced error over the labelled URLs is least.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ORDER = 3
#: Times that a context must occur in a class to have a say; shorter ones stand in for it.
LEAST = 2
#: Score bins a unit, for the calibration.
BINS = 200
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LETTERS.upper()


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains if the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query's contract (fixed values).
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LETTERS)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def apply_rules(host_col: Column, path_col: Column, rules: Sequence[Rule]) -> Column:
    """Struct ``rule, verdict`` of the longest fitting rule (ties: block first, then by name); nulls if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        fits = ((host_col == r.host) | host_col.endswith("." + r.host)) & path_col.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """The whole URL over 32 symbols: a-z, ``0`` for digits, ``/ . - _``, else ``%``. ``_`` pads the start."""
    low = F.translate(F.coalesce(url, F.lit("")), _UPPER + "123456789", _LETTERS + "000000000")
    return F.concat(F.lit("_" * ORDER), F.regexp_replace(low, "[^a-z0/._-]", "%"))


def _grams(urls: DataFrame, order: int, *keys: str) -> DataFrame:
    """``keys``, ``gram``: each character with the ``order`` before it."""
    at = F.explode(F.sequence(F.lit(1), F.length("s") - ORDER))
    return urls.where(F.length("s") > ORDER).select(*keys, "s", at.alias("i")).select(*keys, F.expr(f"substring(s, i + {ORDER - order}, {order + 1})").alias("gram"))


def model(labelled: DataFrame, seen: DataFrame) -> DataFrame:
    """``(gram, ratio)`` for each gram of full order in ``seen(s)``.

    ``labelled(s, accepted boolean, n bigint)`` holds distinct URLs with the
    number of rows of each. The order varies with the context: the longest one of
    up to ``ORDER`` characters that occurs ``LEAST`` times is smoothed by the shorter ones, from
    the uniform distribution upwards: p = (c + t * lower) / (n + t), where n counts
    what followed the context and t its different successors."""
    counts = _grams(labelled, ORDER, "accepted", "n").groupBy("gram").agg(*(F.sum(F.when(F.col("accepted") == F.lit(a), F.col("n")).otherwise(0)).alias(c) for a, c in ((True, "c1"), (False, "c0"))))
    counts = materialize(counts, "grams")
    table = _grams(seen, ORDER).select("gram").distinct()
    table = table.withColumn("p1", F.lit(1 / 32)).withColumn("p0", F.lit(1 / 32))
    for order in range(ORDER + 1):
        g = counts.groupBy(F.expr(f"substring(gram, {ORDER - order + 1}, {order + 1})").alias("g")).agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
        context = g.groupBy(F.expr(f"left(g, {order})").alias("x")).agg(*(f(c).alias(n) for c, f, n in (("c1", F.sum, "n1"), ("c0", F.sum, "n0"))), *(F.sum((F.col(c) > 0).cast("bigint")).alias(n) for c, n in (("c1", "t1"), ("c0", "t0"))))
        # at most 32^(order + 1) and 32^order rows
        table = table.withColumn("g", F.expr(f"substring(gram, {ORDER - order + 1}, {order + 1})")).withColumn("x", F.expr(f"left(g, {order})"))
        table = table.join(F.broadcast(g), "g", "left").join(F.broadcast(context), "x", "left")
        for k in "10":
            c, n, t = (F.coalesce(F.col(v + k), F.lit(0)) for v in "cnt")
            table = table.withColumn("p" + k, F.when(n >= LEAST, (c + t * F.col("p" + k)) / (n + t)).otherwise(F.col("p" + k)))
        table = table.select("gram", "p1", "p0")
    return table.select("gram", (F.ln("p1") - F.ln("p0")).alias("ratio"))


def score(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """``urls(s)`` to ``(s, score)``: mean ratio over the characters of each
    distinct ``s``; 0 for an empty one."""
    rows = urls.select("s").distinct()
    total = _grams(rows.where(F.length("s") > ORDER), ORDER, "s").join(F.broadcast(ratios), "gram").groupBy("s").agg(F.sum("ratio").alias("sum"))
    return rows.join(total, "s", "left").select("s", F.coalesce(F.col("sum") / (F.length("s") - ORDER), F.lit(0.0)).alias("score"))


def cut(scored: DataFrame) -> float:
    """``scored(score, accepted, n)`` to the score from which URLs are accepted.

    Bins are at most as many as ratios differ, far fewer than URLs; between
    equally good cuts the middle one is taken. With one class or none it is 0."""
    bins = scored.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("r"))
    rows = sorted((r["bin"], r["a"], r["r"]) for r in bins.collect())
    all_a, all_r = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not all_a or not all_r:
        return 0.0
    best, at, a, rej = 2.0, [], 0, 0
    for b, x, y in [*rows, (rows[-1][0] + 1, 0, 0)]:
        error = a / all_a + (all_r - rej) / all_r  # accepted below the cut, rejected above
        if error < best - 1e-12:
            best, at = error, [b]
        elif abs(error - best) <= 1e-12:
            at.append(b)
        a, rej = a + x, rej + y
    return (at[0] + at[-1]) / 2 / BINS


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", keep: Sequence[str] = ("page_id",), labelled: DataFrame | None = None) -> DataFrame:
    """``keep`` columns plus ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    A rule's verdict stands; other URLs are judged by the language models. Their
    training URLs are ``labelled(url, accepted boolean)`` (its other columns are
    ignored), by default the URLs
    on which a rule decides. The models see the whole URL, with scheme, query and
    fragment. URLs without ``://`` have empty host and path and are judged by
    their text; null URLs by an empty one, whose score is 0; all rows stay, repeated ones too; without labels of both kinds the score decides at 0.
    Of rules that are equally long a blocking one wins, then the later by name. Very
    long URLs cost rows in proportion to their length. No pages, no rows. ``keep``
    columns named like the new ones are replaced.
    """
    at, way = host(F.col(url)), path(F.col(url))
    keep = [c for c in keep if c.lower() not in ("host", "path", "rule", "verdict", "score")]
    # the user's columns travel in one struct, so that no name can clash
    own = F.struct(*keep) if keep else F.lit(None)
    rows = pages.select(own.alias("_own"), at.alias("host"), way.alias("path"), symbols(F.col(url)).alias("s"))
    rows = rows.withColumn("r", apply_rules(F.col("host"), F.col("path"), rules))
    rows = rows.select("_own", "host", "path", "s", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("_ruled"))
    distinct = materialize(rows.groupBy("s", "_ruled").agg(F.count("*").alias("n")), "urls")
    if labelled is None:
        marked = distinct.where(F.col("_ruled").isNotNull()).select("s", (F.col("_ruled") == "allow").alias("accepted"), "n")
    else:
        given = labelled.where(F.col("accepted").isNotNull()).select(symbols(F.col("url")).alias("s"), "accepted")
        marked = given.groupBy("s", "accepted").agg(F.count("*").alias("n"))
    every = distinct.select("s").union(marked.select("s"))
    scores = materialize(score(every, materialize(model(marked, every), "ratios")), "scores")
    limit = cut(marked.join(scores, "s"))
    out = rows.join(scores, "s")
    judged = F.when(F.col("score") >= limit, F.lit("allow")).otherwise(F.lit("block"))
    return out.select(*(F.col("_own").getField(c).alias(c) for c in keep), "host", "path", "rule", F.coalesce("_ruled", judged).alias("verdict"), "score")
