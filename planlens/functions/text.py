"""Scalar text functions: JSON rescue, fences, names, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_fences(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "```[a-zA-Z0-9_+-]*\\n?", ""), "```", "")


def json_number(c: Column, key: str) -> Column:
    """A whole number under ``key``: from JSON, else from JSON whose trailing
    commas are dropped, else by pattern from what is left of it."""
    clean = strip_fences(c)
    fixed = F.regexp_replace(clean, ",\\s*([}\\]])", "$1")
    read = lambda x: F.get_json_object(F.when(F.try_parse_json(x).isNotNull(), x), f"$.{key}").try_cast("int")
    return F.coalesce(read(clean), read(fixed), F.regexp_extract(clean, f'"{key}"\\s*:\\s*(-?\\d+)', 1).try_cast("int"))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def sanitize_key(c: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most)


def normal_name(c: Column, compatible: bool = False) -> Column:
    """Lower case, trimmed, without closing punctuation; ``compatible``: in NFKC."""
    body = F.when(c.rlike("[^\\x00-\\x7F]"), nfkc(c)).otherwise(c) if compatible else c
    return F.lower(F.trim(F.regexp_replace(F.trim(body), "[?:.!\\s]+$", "")))


def nfkc(c: Column) -> Column:
    """Unicode's compatibility composition, by the ICU library that Spark's collations use."""
    return F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(True)))


def json_object(c: Column) -> Column:
    """The first balanced ``{...}`` of a text, braces in strings aside, without
    fences and trailing commas; null if there is none. One pass over the brace,
    quote and escape characters, not over all."""
    body = strip_fences(c)
    tokens = F.regexp_extract_all(body, F.lit(r'(?s)\\.|[{}"]|[^{}"\\]+'), F.lit(0))
    state = F.struct(F.lit(0).alias("d"), F.lit(False).alias("q"), F.lit("").alias("out"), F.lit(False).alias("end"))

    def step(s: Column, t: Column) -> Column:
        depth = s["d"] + F.when(s["q"], 0).when(t == "{", 1).when((t == "}") & (s["d"] > 0), -1).otherwise(0)
        inside = (s["d"] > 0) | (depth > 0)
        quoted = F.when((t == '"') & inside, ~s["q"]).otherwise(s["q"])
        took = F.struct(depth.alias("d"), quoted.alias("q"), F.when(inside, F.concat(s["out"], t)).otherwise(s["out"]).alias("out"), (inside & (depth == 0)).alias("end"))
        return F.when(s["end"], s).otherwise(took)

    found = F.aggregate(tokens, state, step)
    return F.when(found["end"], F.regexp_replace(found["out"], ",\\s*([}\\]])", "$1"))


def replace_names(text: Column, names: Column) -> Column:
    """Replace each ``old`` by ``new`` (structs in ``names``), longer ones first."""
    ordered = F.array_sort(names, lambda a, b: F.when(F.length(a["old"]) != F.length(b["old"]), F.length(b["old"]) - F.length(a["old"])).when(a["old"] < b["old"], -1).when(a["old"] > b["old"], 1).otherwise(0))
    return F.aggregate(ordered, text, lambda t, n: F.replace(t, n["old"], n["new"]))


def is_sentence_name(c: Column) -> Column:
    """Whether a tool's name is a sentence: over four words or a final question mark."""
    return (F.size(F.split(F.trim(c), "\\s+")) > 4) | c.endswith("?")
