"""A training corpus from ``documents`` in five stages, each an operator of planlens.llm.

Language ID drops what it rejects, line dedup cuts later repeated passages,
SimHash near-dedup keeps one document of each group, mixing repeats or drops
documents to meet the sources' targets, and byte-level BPE encodes the rest.

In every stage: an empty table gives no rows; very long texts are worked on whole;
columns other than those of ``documents`` are dropped, whatever their names; rows
that repeat are rows of their own unless a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlens.llm import byte_bpe, language_id, line_dedup, mixing, simhash
from planlens.llm.common import discard, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the model learns from their labels.

    Null, empty and letterless texts are rejected. Of equal sizes the most frequent
    language is first, but so narrow a lead is rejected. Null labels teach nothing."""
    model = language_id.fit(docs)
    return language_id.identify(docs, model).where(~F.col("rejected")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages are cut; every document stays, with n_chars anew.

    Null texts stay null, with null n_chars. Earlier is by id, null ids first, then by
    place; rows of equal id and text are cut alike. What is cut whole stays as an empty text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints or by 5-word Jaccard similarity of 0.8.

    The smallest id stays; rows of null id stay; of rows that repeat the staying
    id one stays. Null and wordless texts are one group."""
    return simhash.near_dedup(docs, jaccard=0.8).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Null sources are a source, the last one. Texts without words cost nothing and
    stay once. Equal places in the seeded order are taken alike."""
    mixed = mixing.mix(docs, mixing.words(F.col("text")), F.array("source"), tie=F.xxhash64("text"))
    return mixing.materialize_mix(mixed, COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids with their digests. Null texts have no tokens."""
    return byte_bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"))


#: In order: operators 6, 5, 4, 10 and 3.
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

#: Compression and hashed choices are beyond SQL. Tests hold each stage's operator against brute force and run() against the stages applied to one another.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if done is not None:
            discard(done)  # the next stage is written
        done = docs
    return docs
