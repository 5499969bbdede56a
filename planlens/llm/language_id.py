"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold
from .compression import PASSAGE_CHARS, PASSAGES, cached_model, dictionaries, sample_passages

UNKNOWN = "und"
#: Smallest lead of the best language over the second, as a share of the second's size.
MARGIN = 0.003


_NOT_LETTERS = re.compile(r"[\W\d_]+")


def canonical(text: str) -> str:
    """Lower-case letters; what lies between them is one space."""
    return _NOT_LETTERS.sub(" ", text.lower())


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", passages: int = PASSAGES, chars: int = PASSAGE_CHARS) -> dict[str, bytes]:
    """A raw-content dictionary for each non-null language of ``docs``, from at
    most ``passages`` passages of ``chars`` characters each."""
    found = sample_passages(docs, lang, text, F.col(id_col), passages, chars)
    return dictionaries({k: [canonical(t) for t in v] for k, v in found.items()})


def identify(docs: DataFrame, model: dict[str, bytes], text: str = "text", margin: float = MARGIN, drop_text: bool = False) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` (0 to 1), ``rejected``.

    The prediction is the language whose dictionary compresses the whole text
    smallest, ties to the language with most training rows. It is rejected if its lead is under
    ``margin`` or the text is null or has no letter; then without letters the
    language is ``und`` and the score 0. Without any learned language all is
    ``und``. Texts that compress alike in all languages go to the first of them;
    very long texts are compressed in chunks, to the end; repeated rows are judged
    alike; no rows give none. Rows keep their number; clashing columns are replaced; ``drop_text`` leaves the text out.
    """
    import pyarrow as pa

    new = ["lang_pred", "score", "rejected"]
    keep = [c for c in docs.columns if c not in new and not (drop_text and c == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        import regex

        m, letter = cached_model(model), regex.compile(r"\p{L}").search

        def judge(t: str | None) -> tuple[str, float, bool]:
            if not t or not m.names or not letter(t):
                return UNKNOWN, 0.0, True
            sizes = m.sizes(canonical(t))
            best = min(range(len(sizes)), key=sizes.__getitem__)
            rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
            lead = (rest - sizes[best]) / rest
            return m.names[best], 1 / (1 + math.exp(-40 * lead)), lead < margin

        for b in batches:
            rows = [judge(t.as_py()) for t in b.column(text)]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *new])

    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return fold(F.col(id_col), 5) == 0
