"""Token counts of documents in flat token files without an index.

A token file is a run of little-endian unsigned integers in which every document
ends with an end-of-document identifier. Files are read as blocks that know
nothing of documents. One vectorised scan finds the separators of each block; a
prefix scan over blocks (totals of runs of blocks first, then blocks within a
run, so that no task ever holds all blocks of one huge file) gives each block its
first token's position, the number of documents that ended before it and the
place where its first document began. Documents that span blocks come out whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import codec
from .common import materialize

#: Tokens of a block, and blocks of a run of the prefix scan.
BLOCK_TOKENS, RUN_BLOCKS = 1 << 18, 1 << 12
DTYPES = {2: "<u2", 4: "<u4"}


def flat_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", eod: int = 50256, width: int = 2, block_tokens: int = BLOCK_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """Tokenize ``docs`` into one flat file a partition: rows ``(file, block,
    payload, ids)``. ``payload`` rows are consecutive blocks of the file, cut
    anywhere; ``ids`` rows list the file's documents in order, the block then
    being the ordinal of the first. Null texts are empty documents.

    ``width`` 2 holds ids below 65,536; a vocabulary with larger ones, or in which
    ``eod`` is a token, raises ValueError."""

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        file, names = TaskContext.get().partitionId(), ["file", "block", "payload", "ids"]
        encode = codec(vocabulary).encode
        pending, held, block, ordinal = [], 0, 0, 0
        most = max(codec(vocabulary).bytes_of)
        if max(most, eod) >= 1 << 8 * width or eod in codec(vocabulary).bytes_of:
            raise ValueError(f"ids up to {max(most, eod)} need more than {width} bytes, or {eod} is a token")

        def rows(blocks: list[bytes], ids: pa.Array | None) -> pa.RecordBatch:
            nonlocal block, ordinal
            n = len(blocks)
            at = [*range(block, block + n)] + ([ordinal] if ids is not None else [])
            lists = [None] * n + ([ids.to_pylist()] if ids is not None else [])
            block += n
            ordinal += len(ids) if ids is not None else 0
            data = blocks + [None] * (len(at) - n)
            cols = [pa.array([file] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(data, pa.binary()), pa.array(lists, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names)

        def cut(last: bool) -> list[bytes]:
            nonlocal pending, held
            flat = np.concatenate(pending) if pending else np.zeros(0, np.uint32)
            whole = len(flat) if last else len(flat) // block_tokens * block_tokens
            pending, held = [flat[whole:]], len(flat) - whole
            return [flat[i : min(i + block_tokens, whole)].astype(DTYPES[width]).tobytes() for i in range(0, whole, block_tokens)]

        for b in frames:
            for t in b.column(text):
                tokens = encode(t.as_py() or "")
                pending += [tokens, np.array([eod], np.uint32)]
                held += len(tokens) + 1
                if held >= 8 * block_tokens:
                    yield rows(cut(False), None)
            yield rows(cut(False), b.column(id_col))
        yield rows(cut(True), None)

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), text).mapInArrow(run, "file int, block bigint, payload binary, ids array<bigint>")


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks ``(file string, block, payload)`` of raw token files (each under
    2 GB, the limit of Spark's binary source), cut in the JVM."""
    size = width * block_tokens
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", "length")
    block = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0)))).alias("block")
    return files.select("file", "content", block).select("file", "block", F.substring("content", F.col("block") * size + 1, F.lit(size)).alias("payload"))


def separators(blocks: DataFrame, eod: int, width: int) -> DataFrame:
    """``(file, block, n_tokens, seps array<int>)``: positions of ``eod`` within each block."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found = [], []
            for p in b.column("payload"):
                tokens = np.frombuffer(p.as_buffer() if p.is_valid else b"", DTYPES[width])
                sizes.append(len(tokens))
                found.append(np.flatnonzero(tokens == eod).astype(np.int32))
            cols = [b.column("file"), b.column("block"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["file", "block", "n_tokens", "seps"])

    kind = blocks.schema["file"].dataType.simpleString()
    return blocks.select("file", F.col("block").cast("bigint").alias("block"), "payload").mapInArrow(run, f"file {kind}, block bigint, n_tokens bigint, seps array<int>")


def _before(total: Column, w: Window) -> Column:
    return F.coalesce(total.over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def document_spans(scanned: DataFrame, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """``separators()`` to one row per document: ``(file, ordinal, start,
    n_tokens, complete)``. Tokens after the last separator of a file are a
    document that is not complete; an empty tail is none. Separators next to
    each other enclose empty documents."""
    b = scanned.withColumn("run", F.expr(f"block div {run_blocks}")).withColumn("n_seps", F.size("seps").cast("bigint"))
    b = b.withColumn("tail", F.when(F.col("n_seps") > 0, F.element_at("seps", -1).cast("bigint") + 1))
    runs = b.groupBy("file", "run").agg(
        F.sum("n_tokens").alias("r_tokens"),
        F.sum("n_seps").alias("r_seps"),
        F.max(F.when(F.col("n_seps") > 0, F.col("block"))).alias("r_last"),
        F.max("block").alias("r_block"),
    )
    w = Window.partitionBy("file").orderBy("run")
    runs = runs.select("file", "run", _before(F.sum("r_tokens"), w).alias("tokens0"), _before(F.sum("r_seps"), w).alias("seps0"), (F.max("r_block").over(Window.partitionBy("file"))).alias("end_block"))
    w = Window.partitionBy("file", "run").orderBy("block")
    b = b.join(runs, ["file", "run"]).withColumn("at", F.col("tokens0") + _before(F.sum("n_tokens"), w)).withColumn("ordinal0", F.col("seps0") + _before(F.sum("n_seps"), w))
    # Where the last document before a block ended: within the run, else in an earlier run.
    b = b.withColumn("ended", F.col("at") + F.col("tail"))
    ends = b.groupBy("file", "run").agg(F.max("ended").alias("r_ended"))
    w_runs = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "run", F.coalesce(F.max("r_ended").over(w_runs), F.lit(0)).alias("ended0"))
    inner = F.max("ended").over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = b.join(ends, ["file", "run"]).withColumn("start0", F.greatest(F.coalesce(inner, F.lit(0)), "ended0"))
    whole = b.select("file", "ordinal0", "at", "start0", "seps", F.posexplode("seps").alias("i", "sep")).select(
        "file",
        (F.col("ordinal0") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("start0")).otherwise(F.col("at") + F.get("seps", F.col("i") - 1) + 1).alias("start"),
        (F.col("at") + F.col("sep")).alias("end"),
        F.lit(True).alias("complete"),
    )
    last = b.where(F.col("block") == F.col("end_block")).select(
        "file",
        (F.col("ordinal0") + F.col("n_seps")).alias("ordinal"),
        F.coalesce("ended", "start0").alias("start"),
        (F.col("at") + F.col("n_tokens")).alias("end"),
        F.lit(False).alias("complete"),
    )
    both = whole.union(last.where("end > start"))
    return both.select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "complete")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", eod: int = 50256, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``file``, ``ordinal``, ``start``,
    ``n_tokens``, through flat files in the shared folder and the separator scan.

    Null and empty texts count no tokens; null and repeated ids keep their rows;
    an empty table gives none; other columns are ignored, whatever their names. A
    very long text spans blocks, which the scan stitches.
    """
    flat = materialize(flat_blocks(docs, id_col, text, eod, width, block_tokens), "tokens")
    scanned = materialize(separators(flat.where("payload is not null"), eod, width), "separators")
    spans = document_spans(scanned)
    names = flat.where("ids is not null").select("file", "block", F.posexplode("ids").alias("i", id_col))
    names = names.select("file", (F.col("block") + F.col("i")).alias("ordinal"), id_col)
    return spans.join(names, ["file", "ordinal"]).select(id_col, "file", "ordinal", "start", "n_tokens")
