"""Quality scores by compression with dictionaries of good and bad text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold
from .compression import PASSAGE_CHARS, PASSAGES, DictionaryModel, cached_model, dictionaries, sample_passages


LEVEL = 9
_REPEATS = re.compile(r"(?<!\S)(\S+)((?:\s+\1(?!\S))+)")


def canonical(text: str) -> str:
    """Words that repeat the one before them become a count, ``=1 =2`` and so on
    (anew after 64), which a dictionary can hold whatever the word is."""
    return _REPEATS.sub(lambda m: m[1] + "".join(f" ={i % 64 + 1}" for i in range(len(m[2].split()))), text)


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries and the logistic calibration of the size difference."""

    dictionaries: dict[str, bytes]
    slope: float
    offset: float


def difference(sizes: Sequence[int]) -> float:
    """Normalised difference of compressed sizes (bad less good): above zero if good text explains it better."""
    bad, good = sizes
    return (bad - good) / max(1, bad + good)


def calibrate(xs: Sequence[float], ys: Sequence[int], rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of P(1 | x) by Newton steps on classes of equal weight."""
    if not xs:
        return 1.0, 0.0
    n1 = sum(ys)
    n0 = len(ys) - n1
    if not n1 or not n0:
        return 0.0, 20.0 if n1 else -20.0
    scale = max(1e-6, (sum(x * x for x in xs) / len(xs)) ** 0.5)
    a = b = 0.0
    for _ in range(rounds):
        ga, gb, haa, hab, hbb = ridge * a, 0.0, ridge, 0.0, 1e-9
        for x, y in zip(xs, ys, strict=True):
            x /= scale
            w = 0.5 / (n1 if y else n0)
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, a * x + b))))
            ga, gb = ga + w * (p - y) * x, gb + w * (p - y)
            v = w * p * (1 - p)
            haa, hab, hbb = haa + v * x * x, hab + v * x, hbb + v
        det = haa * hbb - hab * hab
        if abs(det) < 1e-18:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 4.0 / max(1e-9, abs(da), abs(db)))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a / scale, b


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", passages: int = PASSAGES, chars: int = PASSAGE_CHARS) -> QualityModel:
    """Dictionaries and calibration from at most ``2 * passages`` passages of
    each label: the odd ones make the dictionaries, the even ones calibrate."""
    # Ids are drawn from the labels alone, so that no text is shuffled to find its
    # label: what is broadcast is at most 6 * passages ids a label.
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label).alias("_label"), F.xxhash64(F.lit("label"), id_col).alias("_h"))
    counts = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    unit = F.shiftrightunsigned("_h", 11) / float(1 << 53)
    drawn = [marked.where((F.col("_label") == k) & (unit < 5.0 * passages / n)).orderBy("_h", "_id").limit(6 * passages) for k, n in sorted(counts.items())]
    if not drawn:
        return QualityModel({}, 0.0, 0.0)
    ids = drawn[0] if len(drawn) == 1 else drawn[0].union(drawn[1])
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(ids.drop("_h")), F.col("_doc") == F.col("_id"))
    found = sample_passages(rows, "_label", "_text", F.col("_id"), 2 * passages, chars)
    made = dictionaries({k: [canonical(t) for t in found.get(k, [])[::2]] for k in ("0", "1")})
    if not all(made.values()):
        return QualityModel({}, 0.0, 0.0)
    model = DictionaryModel(made, LEVEL)
    xs, ys = [], []
    for k in ("0", "1"):
        for t in found[k][1::2]:
            xs.append(difference(model.sizes(canonical(t))))
            ys.append(int(k))
    return QualityModel(made, *calibrate(xs, ys))


def score(docs: DataFrame, model: QualityModel, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1, calibrated) and ``predicted`` (1 from 0.5).

    A null text counts as empty; the empty text has difference 0, so its score is
    the calibration's at 0. A model without both labels scores 0.5, one with a
    single label that label. Equal sizes are a difference of 0; very long texts are
    compressed in chunks, to the end; no rows give none. Rows keep their number; clashing columns are replaced; ``drop_text`` leaves the text out.
    """
    import pyarrow as pa

    keep = [c for c in docs.columns if c not in ("score", "predicted") and not (drop_text and c == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cached_model(model.dictionaries, LEVEL) if model.dictionaries else None
        for b in batches:
            out = []
            for t in b.column(text):
                body = t.as_py()
                x = difference(m.sizes(canonical(body))) if m and body else 0.0
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, model.slope * x + model.offset)))))
            cols = [pa.array(out, pa.float64()), pa.array([int(p >= 0.5) for p in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, "score", "predicted"])

    schema = docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return fold(F.col(id_col), 3) == 1
