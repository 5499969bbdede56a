"""Operators for training data against brute force, round trips and edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planlens.llm import ann, byte_bpe, components, exact_dedup, language_id, line_dedup, mixing, quality, simhash, token_counts, url_filter

DOC = "doc_id bigint, text string, lang string, source string, fp string, size int, removed string, score string"


def docs_of(spark, texts, source="s", ids=None):
    rows = [(i if ids is None else ids[i], t, "en", source, "x", 1, "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def words(n, rng):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


LONG = words(30_000, random.Random(5))
EDGE = [None, "", " ", "a", "a", "é ", "A\tb\u00a0c\x0b", "\x1c\u0085", "x" * 5000, LONG, LONG, "<|endoftext|>", "漢字 😀"]


@pytest.fixture(scope="module")
def edge(spark):
    d = docs_of(spark, EDGE)
    return d.union(spark.createDataFrame([(None, "n", None, None, None, None, None, None), (3, "a", "en", "s", "x", 1, "y", "z")], DOC))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# -- 3 and 1: byte BPE, token counts ------------------------------------------


def plain():
    import public_tokenizers as public
    import tiktoken

    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = byte_bpe.load_ranks(f.read())
    return ranks, public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


RANKS, PATTERN, REFERENCE = plain()
SMALL = byte_bpe.MonoidBpe(RANKS, PATTERN, leaf=8, long=2)
PIECES = st.sampled_from(["a", "e", "th", "ing", " ", "  ", "\n", "\r\n", "\t", "'", "'re", "'ll", "1", "22", "é", "漢", "😀", "!", "...", "\u00a0", "\u3000", "aaaa"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(PIECES, max_size=60).map("".join), st.text(max_size=60).filter(lambda t: not re.search("[\ud800-\udfff]", t))))
def test_monoid_encoding_equals_sequential_encoding(text):
    ids = SMALL.encode(text)
    assert ids.tolist() == REFERENCE.encode_ordinary(text)
    assert SMALL.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.text("abcdeth", min_size=2, max_size=200), st.data())
def test_token_lists_of_one_piece_join(piece, data):
    cut = data.draw(st.integers(0, len(piece)))
    a, b = (REFERENCE.encode_ordinary(x) for x in (piece[:cut], piece[cut:]))
    assert SMALL.merge(piece.encode()) == REFERENCE.encode_ordinary(piece)
    assert SMALL.join_tokens(a, b) == REFERENCE.encode_ordinary(piece)


def test_joins_reach_all_but_the_shortest_texts():
    """Shipped sizes: words, white space, script without spaces, one huge piece, and a pattern without known cuts."""
    rng = random.Random(2)
    texts = [words(4000, rng), "\n \t" * 900, "漢字かな交じり文、" * 300, "漢" * 3000, "x" * 5000, "a1" * 3000, "don't we'll 's'" * 200, "é" * 97]
    for made in (byte_bpe.MonoidBpe(RANKS, PATTERN), byte_bpe.MonoidBpe(RANKS, PATTERN, cut=None)):
        for t in texts:
            made.joined = 0
            ids = made.encode(t)
            assert ids.tolist() == REFERENCE.encode_ordinary(t) and made.joined
            assert made.decode(ids) == t.encode()


def test_encode_documents(edge, empty):
    rows = byte_bpe.encode_documents(edge).collect()
    want = collections.Counter()
    for r in edge.collect():
        ids = REFERENCE.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert byte_bpe.encode_documents(empty).count() == 0


def test_token_counts(edge, empty):
    got = collections.Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(edge, block_tokens=64).collect())
    assert got == collections.Counter((r.doc_id, len(REFERENCE.encode_ordinary(r.text or ""))) for r in edge.collect())
    assert token_counts.token_counts(empty).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from([7, 1, 2]), max_size=60), st.integers(1, 9), st.integers(1, 3))
def test_separator_scan_of_raw_blocks(spark, tokens, block, run):
    data = np.array(tokens, "<u2")
    parts = [data[i : i + block] for i in range(0, len(data), block)] or [data]
    blocks = spark.createDataFrame([("f", i, bytearray(p.tobytes())) for i, p in enumerate(parts)], "file string, block bigint, payload binary")
    got = token_counts.document_spans(token_counts.separators(blocks, 7, 2), run_blocks=run).orderBy("ordinal").collect()
    want, start = [], 0
    for i, t in enumerate(tokens):
        if t == 7:
            want.append((len(want), start, i - start, True))
            start = i + 1
    if start < len(tokens):
        want.append((len(want), start, len(tokens) - start, False))
    assert [(r.ordinal, r.start, r.n_tokens, r.complete) for r in got] == want


def test_raw_token_files(spark, tmp_path):
    np.array([5, 6, 7, 7, 8], "<u2").tofile(tmp_path / "a.bin")
    blocks = token_counts.read_token_files(spark, str(tmp_path / "a.bin"), block_tokens=2)
    spans = token_counts.document_spans(token_counts.separators(blocks, 7, 2)).orderBy("ordinal").collect()
    assert [(r.n_tokens, r.complete) for r in spans] == [(2, True), (0, True), (1, False)]


# -- 2: exact dedup -------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3), max_size=30), min_size=1, max_size=4))
def test_counting_quotient_filters_merge_losslessly(parts):
    cqf = exact_dedup.CountingQuotientFilter
    one = cqf.merge([cqf.build(np.array(p, np.uint64), 8) for p in parts])
    want = collections.Counter(x for p in parts for x in p)
    assert dict(zip(one.fingerprints().tolist(), one.counts.tolist(), strict=True)) == dict(want)
    assert all(one.count(k) == v for k, v in want.items())
    assert one.count(12345678901234567) == want[12345678901234567]


def test_exact_groups(edge, empty):
    rows = edge.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    want = collections.Counter()
    for r in rows:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want[r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in exact_dedup.exact_groups(edge).collect()) == want
    assert exact_dedup.exact_groups(empty).count() == 0


# -- 4: SimHash -----------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.integers(0, 2**64 - 1))
def test_tally_of_shared_bytes(xs, y):
    want = [sum(a == b for a, b in zip(x.to_bytes(8, "little"), y.to_bytes(8, "little"), strict=True)) for x in xs]
    assert simhash.tally(np.array(xs, np.uint64) ^ np.uint64(y)).tolist() == want
    for n, x in zip(want, xs, strict=True):  # the guarantee: two bits spoil two bytes at most
        assert n >= 6 or (x ^ y).bit_count() > 2


def slow_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for t in [*EDGE[:9], "One two THREE four", words(700, random.Random(1))]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_links_keep_all_components(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(5):  # chains, and one crowd within two bytes
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            x ^= 1 << rng.randrange(64) ^ (1 << rng.randrange(64))
    fps |= {0xABCD << 32 | rng.getrandbits(16) for _ in range(900)}
    fps = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2]
    want = closure(fps, pairs)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.links(spark.createDataFrame([(sign(f),) for f in fps], "fp bigint"))
    assert links.count() < 30 * len(fps)
    got = closure(fps, [(r.u % 2**64, r.v % 2**64) for r in links.collect()])
    assert got == want
    roots = {r.node % 2**64: r.root % 2**64 for r in components.connected_components(links).collect()}
    parts = collections.defaultdict(set)
    for n in fps:
        parts[roots.get(n, n)].add(n)
    assert sorted(map(sorted, parts.values())) == sorted(sorted(k for k in fps if want[k] == r) for r in set(want.values()))


def test_simhash_groups(spark, edge, empty):
    rows = edge.collect()
    fp = [slow_fingerprint(r.text) if r.text != LONG else simhash.fingerprint(LONG) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    part = closure(range(len(rows)), pairs)
    least = {p: min((rows[i].doc_id for i in part if part[i] == p and rows[i].doc_id is not None), default=None) for p in part.values()}
    want = collections.Counter((r.doc_id, f"{fp[i]:016x}", least[part[i]]) for i, r in enumerate(rows))
    assert collections.Counter(tuple(r) for r in simhash.simhash_groups(edge).collect()) == want
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.near_dedup(edge).collect()
    assert collections.Counter(r.doc_id for r in kept) == collections.Counter({x for x in least.values() if x is not None}) + collections.Counter([None])


def test_pipeline_links_edited_copies(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    texts = []
    for _ in range(12):
        w = words(300, rng).split()
        texts.append(" ".join(w))
        for edits in (1, 3, 5, 9, 20):
            e = list(w)
            for k in rng.sample(range(300), edits):
                e[k] = "edited"
            texts.append(" ".join(e))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = set(closure(range(len(texts)), pairs).values())
    assert len(want) == 36  # nine and twenty edits are too many
    docs = docs_of(spark, texts).withColumn("n_chars", F.lit(1).cast("bigint"))
    assert {r.doc_id for r in pipeline.near(spark, docs, "").collect()} == want


# -- 5: line dedup ----------------------------------------------------------------


def slow_removed(rows, g=50):
    """Lines in windows of g words (forward or backward) that occur earlier."""
    lines = {}
    for key in sorted({(r.doc_id, r.text) for r in rows}, key=lambda k: (k[0] is not None, k[0] or 0)):
        raw = [x.strip(" \t\n\x0b\x0c\r") for x in (key[1] or "").split("\n")]
        lines[key] = [(i, x, len(re.split(r"[\x20\x09-\x0D]+", x))) for i, x in enumerate(raw) if x]
    seen, out = {}, collections.defaultdict(set)
    found = []
    for key, own in lines.items():
        for way in (0, 1):
            seq = own[::-1] if way else own
            for k in range(len(seq)):
                n, m = 0, k
                while m < len(seq) and n < g:
                    n += seq[m][2]
                    m += 1
                if n >= g:
                    part = sorted(seq[k:m])
                    found.append((key, way, part[0][0], part[-1][0], tuple(x for _, x, _ in part)))
    for key, way, a, _, content in found:
        rank = (key[0] is not None, key[0] or 0, a)
        seen[way, content] = min(seen.get((way, content), rank), rank)
    whole = set()
    for key, own in lines.items():  # shorter texts are compared whole
        content = tuple((key[1] or "").split())
        if own and len(content) < g:
            if content in whole:
                out[key] = {i for i, _, _ in own}
            whole.add(content)
    for key, way, a, b, content in found:
        if (key[0] is not None, key[0] or 0, a) != seen[way, content]:
            out[key] |= {i for i, _, _ in lines[key] if a <= i <= b}
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = ["\n".join(words(rng.randint(1, 30), rng) for _ in range(rng.randint(1, 8))) for _ in range(4)] + ["short.", words(60, rng)]
    texts = []
    for _ in range(25):
        parts = [rng.choice(shared) if rng.random() < 0.5 else words(rng.randint(1, 25), rng) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice(["\n", "\n\n", " \n"]).join(parts))
    return texts + ["\n".join(["same line again"] * 60), None, "", "\n\n"]


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_brute_force(spark, seed):
    d = docs_of(spark, passages(seed))
    want = slow_removed(d.collect())
    assert sum(map(len, want.values())) > 20
    for r in line_dedup.dedup_lines(d).collect():
        before = d.where(F.col("doc_id") == r.doc_id).first().text
        gone = {i for x in r.removed for i in range(x.a, x.b + 1) if before.split("\n")[i].strip()}
        assert gone == want[r.doc_id, before]
        if before is None:
            assert r.text is None
        else:
            cut = {i for x in r.removed for i in range(x.a, x.b + 1)}
            assert r.text == "\n".join(x for i, x in enumerate(before.split("\n")) if i not in cut)


def test_line_dedup_edges(edge, empty):
    out = line_dedup.dedup_lines(edge)
    assert out.count() == edge.count() and set(out.columns) == set(edge.columns)
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert texts[9] == LONG and texts[10] == "" and texts[0] is None and texts[3] == "a"
    assert line_dedup.dedup_lines(empty).count() == 0


def slow_words(rows, g=50):
    """Words that stay of each text, when those in windows of g words that occur earlier go."""
    seen, left = set(), {}
    for i, text in sorted(rows):
        own = text.split()
        gone, n = set(), min(g, len(own))  # shorter texts are compared whole
        for k in range(len(own) - n + 1 if own else 0):
            part = tuple(own[k : k + n])
            if part in seen:
                gone.update(range(k, k + n))
            seen.add(part)
        left[i] = [w for k, w in enumerate(own) if k not in gone]
    return left


def test_line_dedup_inside_lines(spark):
    rng = random.Random(11)
    shared = [words(n, rng) for n in (49, 50, 51, 64, 130)]
    rows = []
    for i in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.5 else words(rng.randint(1, 25), rng) for _ in range(rng.randint(1, 7))]
        text = " ".join(parts).split(" ")
        rows.append((i, "".join(w + rng.choice([" "] * 9 + ["\n", "  ", "\n\n"]) for w in text)))
    want = slow_words(rows)
    assert sum(len(t.split()) - len(want[i]) for i, t in rows) > 500
    before = dict(rows)
    cut = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    for r in cut:
        assert r.text.split() == want[r.doc_id]
        assert r.removed or r.text == before[r.doc_id]
    assert any(x.head and x.tail for r in cut for x in r.removed)
    one = [(1, "p q " + shared[1] + " r s\nt"), (2, "u  " + shared[1] + "\nv\n\n w")]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(one, "doc_id bigint, text string")).collect()} == {1: one[0][1], 2: "u  \nv\n\n w"}


def test_line_dedup_short_texts(spark):
    """Copies of a short text go, a passage in a longer one does not; ids may repeat."""
    rng = random.Random(5)
    short, long = "one two\nthree\nfour five", words(80, rng)
    rows = [(i, short) for i in range(20)] + [(20, "six " + short), (21, long), (22, short + " " + words(60, rng)), (21, "x " + long), (-(1 << 62), "y " + long)]
    got = collections.defaultdict(list)
    for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got[r.doc_id].append(r.text)
    assert got[0] == [short] and got[20] == [rows[20][1]] and got[22] == [rows[22][1]]
    assert all(got[i] == [""] for i in range(1, 20))
    assert got[-(1 << 62)] == ["y " + long] and sorted(got[21]) == ["", "x "]


def test_line_dedup_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PIECE", 70)
    rng = random.Random(12)
    shared = [words(n, rng) for n in (50, 75, 210)]
    rows = [(i, " ".join(rng.choice(shared) if rng.random() < 0.4 else words(rng.randint(1, 60), rng) for _ in range(9))) for i in range(25)]
    rows.append((25, " ".join(["again"] * 400)))
    want = slow_words(rows)
    for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert r.text.split() == want[r.doc_id]


@pytest.mark.parametrize("min_words", [1, 2, 3, 8, 50, 120])
def test_line_dedup_selects_in_generated_code(spark, min_words):
    """A window is in one block, that of its lowest mark; no place is told by an interpreted
    lambda, and the JVM compiles methods of up to 8,000 bytes only."""
    rng, gram = random.Random(13), line_dedup._gram(min_words)
    texts = [[rng.randint(-9, 9) for _ in range(300)], [7] * 200, [rng.getrandbits(60) for _ in range(400)], list(range(150)), list(range(150, 0, -1)), [1] * (min_words - 1)]
    cut = spark.createDataFrame([(i, i, 0, h) for i, h in enumerate(texts) if h], "id bigint, th bigint, at int, h array<bigint>")
    found = line_dedup.blocks(cut, min_words)
    execution = found._jdf.queryExecution()
    assert "lambda" not in execution.optimizedPlan().toString()
    code = execution.debug().codegenToSeq().iterator()
    while code.hasNext():
        assert code.next()._3().maxMethodCodeSize() < 8000
    want = collections.Counter()
    for i, h in enumerate(texts):
        at = None
        for k in range(len(h) - min_words + 1):
            now = min(range(k, k + min_words - gram + 1), key=lambda x: (h[x], x))
            if now != at:
                at, begin = now, k
            want[i, begin] += 1
    rows = found.collect()
    assert {(r.id, r.p): r.n + 1 for r in rows if not r.whole} == want
    assert [(r.id, r.p, r.n) for r in rows if r.whole] == [(5, 0, -1)] * (min_words > 1)


@pytest.mark.parametrize("min_words", [1, 5, 120])
def test_line_dedup_window_sizes(spark, min_words):
    rng = random.Random(14)
    shared = [words(n, rng) for n in (5, 7, 120, 150)]
    rows = [(i, " ".join(rng.choice(shared) if rng.random() < 0.5 else words(rng.randint(1, 20), rng) for _ in range(7))) for i in range(20)]
    want = slow_words(rows, min_words)
    for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=min_words).collect():
        assert r.text.split() == want[r.doc_id]


# -- 6 and 7: compression ---------------------------------------------------------

EN = "the and of to that with this from have which people about their would there".split()
DE = "der die und das nicht mit eine auch werden sich haben durch einen oder schon".split()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    make = lambda v, n: " ".join(rng.choices(v, k=n))
    rows = [(i, make(EN if i % 2 else DE, rng.randint(20, 80)), "en" if i % 2 else "de", "s", "x", 1, "y", "z") for i in range(300)]
    return spark.createDataFrame(rows, DOC)


def test_language(spark, labelled, edge, empty):
    held = language_id.held_out()
    model = language_id.fit(labelled.where(~held), passages=40, chars=200)
    out = language_id.identify(labelled, model).where(held).collect()
    assert len(out) > 30 and all(r.lang_pred == r.lang and 0 <= r.score <= 1 and not r.rejected for r in out)
    got = language_id.identify(edge, model).collect()
    assert len(got) == edge.count()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and r.lang_pred in ("und", "en", "de")
    assert language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(edge, language_id.fit(empty)).collect()} == {"und"}


def plain_sizes(dictionaries, text, level):
    """Compressed sizes by class, with a dictionary of one's own for every chunk."""
    import zstandard as z

    data, out = text.encode(), []
    for d in dictionaries.values():
        n = 0
        for i in range(0, len(data), 512):
            own = z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=level)
            n += len(z.ZstdCompressor(dict_data=own, level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[i : i + 512]))
        out.append(n)
    return out


def test_compression_against_brute_force(spark, labelled):
    """Whole texts, chunk by chunk: language by the smallest sum, quality by the calibrated difference."""
    rows = labelled.limit(40).collect()
    d = labelled.where(F.col("doc_id").isin([r.doc_id for r in rows])).union(labelled.limit(1).select(F.lit(-1).alias("doc_id"), F.concat_ws(" ", F.array_repeat("text", 60)).alias("text"), *labelled.columns[2:]))
    langs = language_id.fit(labelled, passages=30, chars=150)
    for r in language_id.identify(d, langs).collect():
        sizes = plain_sizes(langs, language_id.canonical(r.text), 6)
        two = sorted(sizes)
        assert r.lang_pred == list(langs)[sizes.index(two[0])]
        lead = (two[1] - two[0]) / two[1]
        assert r.rejected == (lead < language_id.MARGIN) and r.score == pytest.approx(1 / (1 + np.exp(-40 * lead)))
    model = quality.fit(labelled, labelled.select("doc_id", (F.col("lang") == "en").cast("int").alias("quality")), passages=30, chars=150)
    for r in quality.score(d, model).collect():
        bad, good = plain_sizes(model.dictionaries, quality.canonical(r.text), quality.LEVEL)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.slope * (bad - good) / (bad + good) + model.offset))))


def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, 12345, None)], "doc_id bigint").select("doc_id", language_id.held_out().alias("h"))
    assert all(r.h == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in rows.collect())


def test_quality(spark, labelled, edge, empty):
    marks = labelled.select("doc_id", (F.col("lang") == "en").cast("int").alias("quality"))
    held = quality.held_out()
    model = quality.fit(labelled.where(~held), marks.where(~held), passages=40, chars=200)
    out = quality.score(labelled, model).where(held).collect()
    assert len(out) > 50 and all(r.predicted == (r.lang == "en") == (r.score >= 0.5) for r in out)
    got = quality.score(edge, model).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, model).count() == 0
    assert {r.score for r in quality.score(edge, quality.fit(empty, marks)).collect()} == {0.5}


# -- 8: URL filter ------------------------------------------------------------------


def test_url_rules_and_model(spark):
    urls = ["http://A.Org/x", "https://m.example.org/es/1?x", "http://example.org/en/12", "http://example.org/en/2", "ftp://x.com/fr/a#b", "http://y.com/de/", "http://notorg/x", "http://z.com/frx", None, "no scheme", "", "http://h?q://x/fr/", "a://b://c/d", "http://example.org\n/es/x"] + ["http://good%d.net/fr/" % i for i in range(3)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls[:2])], "page_id bigint, url string, host string")
    got = {(r.page_id): r for r in url_filter.filter_urls(pages).collect()}
    assert len(got) == len(urls) + 2
    want = {0: ("org/", "allow"), 1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: ("com/fr/", "allow"), 5: ("com/de/", "block")}
    for i, (rule, verdict) in want.items():
        assert (got[i].rule, got[i].verdict) == (rule, verdict)
    for i in (6, 7, 8, 9, 10, 11):
        assert got[i].rule is None and got[i].verdict in ("allow", "block")
    assert (got[0].host, got[0].path) == ("a.org", "/x") and (got[4].host, got[4].path) == ("x.com", "/fr/a")
    assert (got[8].host, got[8].path, got[9].host, got[11].host, got[11].path) == ("", "", "", "h", "")
    assert (got[12].host, got[12].path) == ("b:", "//c/d")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_model_sees_the_whole_url(spark):
    urls = ["http://x.net/p?good", "http://x.net/p?evil", "http://x.net/p#good", "http://x.net/p#evil", "good", "evil", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    marks = [(f"{k}{s}http://y.net/{i}?{k}#{k}", k == "good") for i, s in enumerate("abcd") for k in ("good", "evil")]
    got = {r.page_id: r for r in url_filter.filter_urls(pages, (), labelled=spark.createDataFrame(marks, "url string, accepted boolean")).collect()}
    assert all(got[i].score > got[i + 1].score for i in (0, 2, 4))
    assert (got[4].verdict, got[5].verdict) == ("allow", "block")
    assert (got[0].host, got[0].path) == ("x.net", "/p") and got[6].score == 0


def test_url_model_against_brute_force(spark):
    rng = random.Random(2)
    good, bad = (["".join(rng.choices(v, k=8)) for _ in range(30)] for v in ("abc/", "bcd.",))
    pad = "_" * url_filter.ORDER
    rows = [(pad + u, a, 1 + len(u) % 3) for us, a in ((good, True), (bad, False)) for u in set(us)]
    marked = spark.createDataFrame(rows, "s string, accepted boolean, n bigint")
    seen = spark.createDataFrame([(pad + u,) for u in (*good, *bad, "zzabc")], "s string").distinct()

    def prob(side, gram):
        p = 1 / 32
        for k in range(url_filter.ORDER + 1):
            ctx, after = gram[url_filter.ORDER - k : -1], collections.Counter()
            for s, a, n in rows:
                if a == side:
                    for i in range(url_filter.ORDER, len(s)):
                        if s[i - k : i] == ctx:
                            after[s[i]] += n
            n, t = sum(after.values()), len(after)
            p = (after[gram[-1]] + t * p) / (n + t) if n >= url_filter.LEAST else p
        return p

    ratios = {r.gram: r.ratio for r in url_filter.model(marked, seen).collect()}
    assert len(ratios) > 50
    for g in list(ratios)[::7]:
        assert ratios[g] == pytest.approx(np.log(prob(True, g)) - np.log(prob(False, g)), abs=1e-9)


def test_url_cut_and_verdicts_against_brute_force(spark):
    """The cut is the middle of the bins of least balanced error; verdicts follow from mean ratios."""
    rng = random.Random(3)
    urls = [f"http://{rng.choice(['good', 'fine'])}{i}.net/{rng.choice('ab')}" for i in range(40)] + [f"http://{rng.choice(['evil', 'fine'])}{i}.biz/{rng.choice('bc')}" for i in range(40)] + ["http://long.net/" + "a" * 20_000, "x"]
    pages = spark.createDataFrame([(i, u, 1, 2, 3) for i, u in enumerate(urls)], "page_id bigint, url string, host int, s int, r int")
    marks = [(u, i < 40) for i, u in enumerate(urls[:80])]
    labelled = spark.createDataFrame(marks, "url string, accepted boolean")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, (), keep=("page_id", "s", "r", "host"), labelled=labelled).collect()}
    assert got[0].s == 2 and got[0].r == 3 and got[0].host.startswith(("good", "fine"))
    scores = {u: got[i].score for i, u in enumerate(urls)}
    bins = collections.Counter()
    for u, a in marks:
        bins[int(np.floor(scores[u] * url_filter.BINS)), a] += 1
    edges = sorted({b for b, _ in bins} | {max(b for b, _ in bins) + 1})
    error = {e: sum(n for (b, a), n in bins.items() if a and b < e) / 40 + sum(n for (b, a), n in bins.items() if not a and b >= e) / 40 for e in edges}
    best = [e for e in edges if error[e] <= min(error.values()) + 1e-12]
    limit = (best[0] + best[-1]) / 2 / url_filter.BINS
    assert all((r.verdict == "allow") == (r.score >= limit) for r in got.values())


def test_rules_of_equal_length(spark):
    rules = (url_filter.Rule("allow", "a.b", "/x"), url_filter.Rule("block", "a.b", "/x"), url_filter.Rule("allow", "b", "/x/y"))
    d = spark.createDataFrame([("a.b", "/x/y"), ("c.b", "/x/y"), ("c.b", "/x")], "h string, p string")
    got = [(r.x.rule, r.x.verdict) if r.x else None for r in d.select(url_filter.apply_rules(F.col("h"), F.col("p"), rules).alias("x")).collect()]
    assert got == [("a.b/x", "block"), ("b/x/y", "allow"), None]


# -- 9: nearest neighbours -----------------------------------------------------------


@pytest.mark.parametrize(("need", "cell"), [(3000, 4096), (3000, 40), (200_000, 200)])
def test_ann(spark, monkeypatch, need, cell):
    """Slices of about two rows each, cells and crowds that are dealt out, and slices that hold all."""
    monkeypatch.setattr(ann, "CELL", cell)
    monkeypatch.setattr(ann, "QUERIES", max(8, cell // 8))
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:400] = x[100]  # a crowd of equal vectors
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0, 2.0]), (None, [1.0] * 16), (0, rows[0][1])]
    v = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(v.withColumn("ids", F.lit(1)).withColumn("v", F.lit(2)), v.where("vec_id % 20 = 0"), k=10, trees=32, need=need).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    data = np.array([r[1] for r in rows])
    hits = 0
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        found.sort()
        s = (data * data[q]).sum(1)
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-s[i], i))[:10]
        assert [f[0] for f in found] == list(range(1, 11)) and len({f[1] for f in found}) == 10 and q not in {f[1] for f in found}
        assert all(f[2] == pytest.approx(s[f[1]], rel=1e-13) for f in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({f[1] for f in found} & set(order))
    assert hits / 10 / len(got) >= 0.9
    if need > 100_000:
        assert hits == 10 * len(got)
    few = v.where("vec_id < 5")
    assert ann.search(few, few.where("vec_id = 0"), k=20).count() == 4
    assert ann.search(v.limit(0), v.limit(0)).count() == 0


def test_ann_near_the_limits_of_doubles(spark):
    rows = [(0, [1e-200, 0.0]), (20, [1e-200, 1e-201]), (40, [1e200, 1e200]), (60, [-1e200, 3e200]), (3, [5e-324, 0.0]), (4, [1e308, 1e308]), (5, [0.0, 0.0]), (0, [0.0, 1e-200])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(v, v.where("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == {0, 20, 40, 60} and all(len(x) == 3 for x in got.values())
    assert 4 in got[40] and 5 not in sum(got.values(), [])


# -- 10: mixing ----------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([10, 1000], [5, 2], 1.5, 2) == pytest.approx([20, 1495])
    assert mixing.targets([], [], 1.5, 2) == []


def test_flow_prefers_words_not_yet_used():
    # the shared pattern serves the source that has nothing else
    flow = mixing.min_cost_flow([100, 100], [[0], [0, 1]], [100, 100], 2)
    assert sum(flow[0].values()) == pytest.approx(100) and flow[1] == pytest.approx({1: 100})


def test_mix(spark, edge, empty):
    rng = random.Random(6)
    rows = [(i, words(rng.randint(0, 120), rng), rng.choice(["a", "b", "c", "d", None]) if i % 3 else "a") for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    run = lambda x: sorted(tuple(r) for r in mixing.mix(x, mixing.words(F.col("text")), F.array("source"), tie=F.xxhash64("text")).select("doc_id", "source", "size", "source_size", "target", "taken").collect())
    got = run(d.repartition(5))
    assert got == run(d.repartition(2))
    size, taken, goal = collections.Counter(), collections.Counter(), {}
    for i, s, n, whole, target, t in got:
        assert n == len(rows[i][1].split()) and t in (0, n, 2 * n)
        size[s] += n
        taken[s] += t
        goal[s] = (whole, target)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    for s, t in zip(names, want, strict=True):
        assert goal[s] == (size[s], pytest.approx(t)) and abs(taken[s] - t) <= 60  # half of the largest document
    assert sum(want) == pytest.approx(1.5 * sum(size.values()))
    out = mixing.mix(edge, mixing.words(F.col("text")), F.array("source")).collect()
    assert len(out) == edge.count() and all(r.taken <= 2 * r["size"] for r in out)
    assert mixing.mix(empty, mixing.words(F.col("text")), F.array("source")).count() == 0
    more = ["part", "full", "edge", "last", "gap", "picks", "cum", "n", "fine", "reached", "taken", "_key"]
    odd = d.select("*", *(F.lit(1).alias(c) for c in more))
    again = mixing.mix(odd, mixing.words(F.col("text")), F.array("source"), tie=F.xxhash64("text"))
    assert set(again.columns) == {*d.columns, *more, "size", "source_size", "target"}
    assert sorted(tuple(r) for r in again.select("doc_id", "source", "size", "source_size", "target", "taken").collect()) == got


def test_flow_costs_least():
    """Against every whole flow of small cases: as much as can be routed, then at least cost."""
    rng = random.Random(8)
    for _ in range(25):
        caps = [rng.randint(0, 3) for _ in range(3)]
        members = [rng.sample(range(2), rng.randint(1, 2)) for _ in caps]
        quota = [rng.randint(0, 5) for _ in range(2)]
        flow = mixing.min_cost_flow(caps, members, quota, 2)
        cost = lambda c, x: sum(2 * k + 1 for k in range(2) for _ in range(max(0, min(c, x - k * c))))
        best = (1, 0)
        routes = [(p, s) for p, m in enumerate(members) for s in m]
        for amounts in itertools.product(*(range(2 * caps[p] + 1) for p, _ in routes)):
            out, into = collections.Counter(), collections.Counter()
            for (p, s), x in zip(routes, amounts, strict=True):
                out[p] += x
                into[s] += x
            if all(out[p] <= 2 * c for p, c in enumerate(caps)) and all(into[s] <= q for s, q in enumerate(quota)):
                best = min(best, (-sum(amounts), sum(cost(c, out[p]) for p, c in enumerate(caps))))
        got = [sum(f.values()) for f in flow]
        assert (-round(sum(got)), sum(cost(c, round(x)) for c, x in zip(caps, got, strict=True))) == (min(0, best[0]), best[1] if best[0] <= 0 else 0)


# -- the pipeline --------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    body = lambda v, n: "\n".join(" ".join(rng.choices(v, k=12)) + " " + words(4, rng) for _ in range(n))
    texts = [body(EN if i % 2 else DE, rng.randint(2, 9)) for i in range(120)] + [None, "", "123 456 !!"]
    texts += [texts[3]] * 10
    rows = [(i, t, "en" if i % 2 or i > 120 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        ids = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
        if name != "byte_bpe":
            assert tuple(docs.columns) == pipeline.COLUMNS
        if name == "language_id":
            assert set(ids) == set(range(120)) | set(range(123, 133))
        if name == "line_dedup":
            assert all(r.text == "" for r in docs.where("doc_id >= 123").collect())
        if name == "simhash_near_dedup":
            assert set(ids) == set(range(120)) | {123} and max(ids.values()) == 1
        if name == "mixing":
            assert max(ids.values()) <= 2
            mixed = {r.doc_id: r.text for r in docs.collect()}
        if name == "byte_bpe":
            assert ids == collections.Counter(r.doc_id for r in before.select("doc_id").collect())
            assert all(np.frombuffer(r.token_ids, "<u4").tolist() == REFERENCE.encode_ordinary(mixed[r.doc_id]) for r in docs.collect())
    assert pipeline.run(spark, str(tmp_path)).count() == sum(ids.values())


def test_names_of_inner_columns_may_stand_in_the_input(spark):
    names = ["doc", "runs", "row", "name", "done", "_doc", "_runs", "_done", "_stay", "_null", "stays", "own", "id", "o", "fp", "th"]
    d = docs_of(spark, [LONG, LONG, "a b"]).select("doc_id", "text", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names))
    for out, left in ((line_dedup.dedup_lines(d).drop("removed"), 3), (simhash.near_dedup(d), 2)):
        rows = out.collect()
        assert out.columns == d.columns and len(rows) == left and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)


def test_similar_texts_of_long_lists(spark, monkeypatch):
    """All texts in one list: whoever is not next to its like, or to the first, is found too."""
    monkeypatch.setattr(simhash, "bands", lambda hashes: np.zeros(simhash.BANDS, np.uint64))
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(words), " ".join(words[:-1]), " ".join(words + ["z"])]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.similar_texts(docs, "text", simhash.WORDS, 0.8).collect()
    th = {r.th: r.doc_id for r in docs.select("doc_id", F.xxhash64("text").alias("th")).collect()}
    sets = [set(simhash.shingles(t, simhash.WORDS).tolist()) for t in texts]
    true = {(i, j) for i in range(36) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}

    def groups(links):
        root = list(range(36))
        for _ in root:
            for i, j in links:
                root[i] = root[j] = min(root[i], root[j])
        return root

    found = {tuple(sorted((th[r.x], th[r.y]), reverse=True)) for r in got}
    assert found <= true and groups(found) == groups(true) and len(set(groups(true))) == 12
