"""Text classes by compression: one zstandard raw-content dictionary a class.

A text is cut into chunks and every chunk is compressed with each class's
dictionary, so that a dictionary keeps its say in long texts too. The class
whose dictionary gives the smallest total describes the text best.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

#: Bytes compressed at a time, and zstandard's level.
CHUNK, LEVEL = 512, 6
#: Bounds of what a class's model is fitted on: passages, and characters of each.
PASSAGES, PASSAGE_CHARS = 192, 1024
#: Classes that get a dictionary, the most frequent first: at most PASSAGES * PASSAGE_CHARS characters of each reach the driver.
CLASSES = 1024


def sample_passages(rows: DataFrame, label: str, text: str, key: Column, passages: int, chars: int, classes: int = CLASSES) -> dict[str, list[str]]:
    """At most ``passages`` passages of ``chars`` characters for each label, the
    most frequent label first (ties by name). Labels beyond the ``classes`` most
    frequent have no model: fitting takes a sample whose bound this is.

    Rows are picked by the hash of ``key`` (a hash threshold drawn from the
    label's count, then the smallest hashes), a passage begins at a hashed
    place of its text. What reaches the driver is bounded by the arguments."""
    rows = rows.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(F.lit("sample"), key, F.xxhash64(text)).alias("h"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(classes).collect()}
    share = {k: min(1.0, 2.0 * passages / n) for k, n in counts.items()}
    # a map, as its size does not grow the expression tree
    limit = F.coalesce(F.create_map(*(F.lit(x) for p in share.items() for x in p))[F.col("label")], F.lit(0.0)) if share else F.lit(0.0)
    unit = F.shiftrightunsigned("h", 11) / float(1 << 53)
    span = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    at = F.pmod(F.xxhash64(F.lit("place"), "h"), span) + 1
    picked = rows.where(unit < limit).select("label", "h", F.substring("text", at, F.lit(chars)).alias("passage"))
    out: dict[str, list[str]] = {}
    for r in picked.orderBy("label", F.shiftrightunsigned("h", 11), "passage").limit(3 * passages * max(1, len(counts))).collect():
        kept = out.setdefault(r["label"], [])
        if len(kept) < passages:
            kept.append(r["passage"])
    return {k: out[k] for k in sorted(out, key=lambda k: (-counts[k], k))}


class DictionaryModel:
    """Sizes of texts under the dictionaries of several classes."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, chunk: int = CHUNK):
        import zstandard as z

        self.names, self.chunk = list(dictionaries), chunk
        self.compress = []
        for name in self.names:
            d = z.ZstdCompressionDict(dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compress.append(z.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text by class, in order of ``names``."""
        data = text.encode("utf-8", "surrogatepass")
        parts = [data[i : i + self.chunk] for i in range(0, len(data), self.chunk)]
        return [sum(len(c(p)) for p in parts) for c in self.compress]


def cached_model(dictionaries: dict[str, bytes], level: int = LEVEL) -> DictionaryModel:
    cache = worker_cache()
    key = ("zstd", level, hash(tuple(dictionaries.items())))
    if key not in cache:
        cache[key] = DictionaryModel(dictionaries, level)
    return cache[key]


def dictionaries(passages: dict[str, Sequence[str]], least: int = 1 << 14) -> dict[str, bytes]:
    """A raw dictionary a class, all cut to the shortest one's length (though not
    under ``least`` bytes), as a longer dictionary costs longer offsets."""
    joined = {k: "\n".join(v).encode("utf-8", "surrogatepass") for k, v in passages.items()}
    size = max(least, min(map(len, joined.values()), default=0))
    return {k: v[-size:] for k, v in joined.items()}
