"""Byte-level BPE as a monoid: encode halves, join neighbours at their seam.

A text splits in half until its parts are leaves of ``LEAF`` characters, which the
library encodes. Joining two neighbours encodes a window around the seam anew;
the window grows both ways until nothing outside it can change:

* A place is a *cut* if every piece (match of the pattern) that holds the
  character before it ends there, whatever else the text holds. The tokens before
  a cut and those after it are those of the two parts by themselves. So once the
  window ends at cuts on both sides, or at the ends of the parts, all else stands.
  For the default pattern a character before white space makes a cut, and a letter
  before punctuation or a digit. A pattern without known cuts grows its windows to the
  ends of the parts, which is right but slow.
* A piece of over ``LONG`` characters that crosses the seam has no cut. Its two
  token lists join by the same idea: a list of tokens is the encoding of its bytes
  exactly when each two neighbours encode to themselves, so a window of tokens that
  is merged anew is final once the pairs at its two ends do. It doubles until then.

Decoding concatenates the bytes of tokens up the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import worker_cache

#: Characters of a leaf of the tree.
LEAF = 96
#: Characters from which a piece across a seam is joined by its tokens.
LONG = 512
#: Cuts of the default pattern: what stands before them, as a pattern. Only
#: characters whose class does not depend on the version of Unicode.
CUT = r"[\p{L}\p{N}\p{P}\p{S}](?=[ \t\n\r])|[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0400-\u0481\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3](?=[!-@\[-`{-~\u3001-\u3003\u3008-\u3011\uFF0C])"


def load_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


class MonoidBpe:
    """Encoder and decoder over ``ranks`` and a pre-tokenising ``pattern``.

    ``tokens`` and ``joined`` count the tokens returned and those that joins made."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, long: int = LONG, cut: str | None = CUT):
        import regex
        import tiktoken

        self.leaf, self.long, self.ranks = max(leaf, 2), max(long, 2), ranks
        self.whole = regex.compile(pattern).fullmatch
        self.cuts = regex.compile(cut) if cut else None
        core = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode_leaf: Callable[[str], list[int]] = core.encode_ordinary
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.tokens = self.joined = 0

    # -- encoding -------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        """Token ids (uint32) of a whole text, as one sequential pass gives them."""
        out = self._tree(text, 0, len(text))
        self.tokens += len(out)
        return np.array(out, np.uint32)

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.encode_leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of ``text[lo:hi]`` from those of its parts, in place of ``left``."""
        a, b = self._before(text, lo, mid), self._after(text, mid, hi)
        head, tail = text[a:mid], text[mid:b]
        if b - a > self.long and self.whole(head + tail) and self.whole(head) and self.whole(tail):
            i, j = self._last(left, head), self._first(right, tail)
            window = self.join_tokens(left[len(left) - i :], right[:j])
        else:
            if b - a > 2 * self.leaf:  # counting bytes is cheaper than encoding anew
                i, j = self._last(left, head), self._first(right, tail)
            else:
                i, j = len(self.encode_leaf(head)), len(self.encode_leaf(tail))
            window = self.encode_leaf(head + tail)
            self.joined += len(window)
        del left[len(left) - i :]
        left += window
        left += right[j:]
        return left

    def _before(self, text: str, lo: int, mid: int) -> int:
        """The last cut before ``mid`` with both its characters in the part, else ``lo``."""
        span = 16
        while self.cuts and mid - lo > 1:
            at = max(lo, mid - span)
            found = at
            for m in self.cuts.finditer(text, at, mid):
                found = m.end()
            if found > at:
                return found
            if at == lo:
                break
            span *= 4
        return lo

    def _after(self, text: str, mid: int, hi: int) -> int:
        """The first cut after ``mid`` with both its characters in the part, else ``hi``."""
        found = self.cuts.search(text, mid, hi) if self.cuts else None
        return found.end() if found else hi

    def _last(self, tokens: list[int], part: str) -> int:
        """How many of the last ``tokens`` make ``part``."""
        left, n = len(part.encode("utf-8")), 0
        while left > 0:
            n += 1
            left -= len(self.bytes_of[tokens[-n]])
        return n

    def _first(self, tokens: list[int], part: str) -> int:
        left, n = len(part.encode("utf-8")), 0
        while left > 0:
            left -= len(self.bytes_of[tokens[n]])
            n += 1
        return n

    def merge(self, data: bytes) -> list[int]:
        """Encoding of one short run of bytes: the lowest ranked pair merges first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(x + y, len(self.ranks)), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def _fits(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens encode to themselves."""
        found = self.pairs.get((a, b))
        if found is None:
            found = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.pairs) < 1 << 18:
                self.pairs[a, b] = found
        return found

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encodings of parts of one piece."""
        if not left or not right or self._fits(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            window = self.merge(b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j]))
            ok_left = i >= len(left) or self._fits(left[-i - 1], window[0])
            ok_right = j >= len(right) or self._fits(window[-1], right[j])
            if ok_left and ok_right:
                self.joined += len(window)
                return left[: len(left) - i] + window + right[j:]
            i = i if ok_left else min(len(left), 2 * i)
            j = j if ok_right else min(len(right), 2 * j)

    # -- decoding -------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, concatenated up a tree of halves."""
        return self._concat(ids.tolist())

    def _concat(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self._concat(ids[:mid]) + self._concat(ids[mid:])


def codec(vocabulary: str | None = None, pattern: str | None = None, leaf: int = LEAF) -> MonoidBpe:
    """The codec of a rank file, once a worker. By default the public
    multilingual file and its pattern."""
    cache = worker_cache()
    key = ("bpe", vocabulary, pattern, leaf)
    if key not in cache:
        import public_tokenizers as public

        with open(vocabulary or public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            own = pattern not in (None, public.PATTERN)
            cache[key] = MonoidBpe(load_ranks(f.read()), pattern or public.PATTERN, leaf, cut=None if own else CUT)
    return cache[key]


def encode_documents(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """``docs`` without ``text``, plus ``n_tokens bigint``, ``ids_sha256``,
    ``decoded_sha256`` and, if asked for, ``token_ids binary`` (little-endian
    uint32). No shuffle: every row is encoded where it is read.

    A null text counts as empty: no tokens, the digests of nothing. Columns of
    ``docs`` that clash with the new names are replaced; rows repeat as given; an
    empty table gives no rows. A very long text is one row of one task, whose
    memory is in proportion to it. Encoding is a function: ties cannot arise.
    """
    import pyarrow as pa

    new = ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: 4 if ids else 3]
    keep = [c for c in docs.columns if c != text and c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        bpe = codec(vocabulary, pattern)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                rows: list[tuple] = []
                for t in part.column(text):
                    tokens = bpe.encode(t.as_py() or "")
                    raw = tokens.astype("<u4").tobytes()
                    rows.append((len(tokens), sha256(raw).hexdigest(), sha256(bpe.decode(tokens)).hexdigest(), raw)[: len(new)])
                cols = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *cols], [*keep, *new])

    from pyspark.sql import functions as F

    kinds = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "token_ids": "binary"}
    schema = docs.select(*keep, *(F.lit(None).cast(kinds[c]).alias(c) for c in new)).schema
    return docs.select(*keep, text).mapInArrow(run, schema)
