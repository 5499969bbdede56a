"""Sources and sinks of corpora, results and splits, on any Hadoop path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from planlens.plans.schema import ENVELOPE

from . import blocks


def read_envelope(spark: SparkSession, path: str, schema: str = ENVELOPE, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """``{metadata, data: [...]}`` files (gzip too), or such documents a line, to (records, metadata).

    A file is read by as many tasks as it has blocks; a gzipped one by one task."""
    if lines:
        raw = spark.read.schema(schema).json(path)
        return raw.select(F.posexplode("data").alias("ord", "r")).select("ord", "r.*"), raw.select("metadata")
    fields = {f.name: f.dataType for f in StructType.fromDDL(schema).fields}
    records, rest = blocks.documents(spark, path, [])
    objects = records.where("form = 'data'").select("ord", F.from_json(_object("text"), fields["data"].elementType).alias("r"))
    head = F.from_json("text", StructType([f for f in StructType.fromDDL(schema).fields if f.name == "metadata"]))
    return objects.select("ord", "r.*"), rest.select(head["metadata"].alias("metadata"))


def _object(text: str) -> Column:
    """A record's text from its first brace on."""
    return F.regexp_replace(text, r"^[^{]*+", "")


def read_any_json(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Records of type ``element`` from an envelope, a bare list, an object of
    records (its keys become ``key``), one record or JSON lines; a line may be any
    of these. Files of one list or object are read in blocks by many tasks."""
    records, _ = blocks.documents(spark, path, _names(element))
    by_key = r'(?s)^.*?"((?:[^"\\]|\\.)*+)"\s*:\s*(\{.*)$'
    blank = F.lit(None).cast("string")
    key = F.from_json(F.concat(F.lit('["'), F.regexp_extract("text", by_key, 1), F.lit('"]')), "array<string>")[0]
    single = F.when(F.col("form") == "items", F.struct(key.alias("key"), F.from_json(F.regexp_extract("text", by_key, 2), element).alias("r"))).otherwise(F.struct(blank.alias("key"), F.from_json(_object("text"), element).alias("r")))
    own = records.where("form not in ('lines', 'one')").select(single.alias("x"))
    small = records.where("form in ('lines', 'one')").select(_object("text").alias("value"))
    in_data = F.from_json("value", f"struct<data:array<{element}>>")["data"]
    fields = F.json_object_keys("value")
    is_one = F.arrays_overlap(fields, F.lit(_names(element)))
    tag = lambda a: F.transform(a, lambda x: F.struct(blank.alias("key"), x.alias("r")))
    out = F.when(F.array_contains(fields, "data"), tag(in_data)).when(is_one, tag(F.array(F.from_json("value", element)))).otherwise(F.transform(F.map_entries(F.from_json("value", f"map<string,{element}>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("r"))))
    return own.union(small.select(F.explode(out).alias("x"))).select("x.key", "x.r.*")


def _names(element: str) -> list[str]:
    return StructType.fromDDL(element[element.index("<") + 1 : -1]).names


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_nested_parquet(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Parquet whose nested columns may have been written as JSON strings."""
    df = spark.read.parquet(path)
    strings = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    return df.withColumns({c: F.from_json(c, t) for c, t in columns.items() if c in strings})


def probe_mode(spark: SparkSession, path: str, column: str) -> str | None:
    """The most frequent value of one column; only that column is read."""
    return spark.read.parquet(path).agg(F.mode(column, True)).first()[0]


def read_results(spark: SparkSession, glob: str, record: str) -> DataFrame:
    """Result files ``{runs: {run: [record]}}`` with the method from the file's name; a method's second file is ``m [stem]``."""
    raw = spark.read.schema(f"config struct<method:string>, runs map<string,array<{record}>>").option("multiLine", True).json(glob)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.json)?(?:\.gz)?$", 1)
    raw = raw.select(stem.alias("stem"), F.coalesce("config.method", stem).alias("method"), "runs")
    files = raw.groupBy("method").agg(F.min("stem").alias("first"))  # as many rows as methods
    raw = raw.join(files, "method").withColumn("method", F.when(F.col("stem") == F.col("first"), F.col("method")).otherwise(F.concat("method", F.lit(" ["), "stem", F.lit("]"))))
    return raw.select("method", F.explode("runs").alias("run", "rows")).select("method", "run", F.posexplode("rows").alias("ord", "r")).select("method", "run", "ord", "r.*")


def read_sheet(spark: SparkSession, path: str, answer: str = "human_acceptable") -> DataFrame:
    """Annotation sheets with multi-line cells; only rows answered yes or no."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.where(F.lower(F.trim(answer)).isin("yes", "no"))


def write_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_json(df: DataFrame, path: str, gzip: bool = False) -> None:
    """JSON lines, a file a partition; null fields are written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("compression", "gzip" if gzip else "none").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_manifest(df: DataFrame, path: str, key: str, seed: str, shares: tuple[float, float], split: str = "split") -> None:
    """The split's manifest as JSON lines: one line of its seed, shares and sizes,
    then a line a key, so that no list of all keys is ever one value."""
    sizes = df.groupBy(split).agg(F.count_distinct(key).alias("n"))
    head = sizes.agg(F.map_from_entries(F.collect_list(F.struct(split, "n"))).alias("sizes"))  # a row a split
    head = head.select(F.lit(seed).alias("split_seed"), F.array(*map(F.lit, shares)).alias("split_ratios"), "sizes", F.lit(None).cast("string").alias(key), F.lit(None).cast("string").alias(split))
    rows = df.select(key, split).distinct().select(F.col(key).cast("string").alias(key), split)
    write_json(head.unionByName(rows, allowMissingColumns=True), path)


def read_manifest(spark: SparkSession, path: str, key: str, split: str = "split") -> DataFrame:
    """``(key, split)`` of a manifest."""
    return spark.read.schema(f"{key} string, {split} string").json(path).where(F.col(key).isNotNull())


def write_with_backup(df: DataFrame, path: str) -> None:
    """Replace a table: the new one is written beside it first, the old one is kept as ``.bak`` (once)."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    df.write.mode("overwrite").parquet(path + ".new")
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        if fs.exists(at(path + ".bak")):
            fs.delete(at(path), True)
        else:
            fs.rename(at(path), at(path + ".bak"))
    fs.rename(at(path + ".new"), at(path))


def numbered(spark: SparkSession, path: str, name: str = "place") -> DataFrame:
    """Parquet rows with their place, from 0: by file name, then by row in the file.

    Only the files' row counts meet in one place, a row a file; rows number themselves."""
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = df.groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return df.join(starts, "_file").withColumn(name, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def join_by_place(spark: SparkSession, left: str, right: str, how: str = "inner") -> DataFrame:
    """Rows of two Parquet folders side by side, the n-th of one with the n-th of the
    other, however each is cut into files; with ``how`` "full" the longer one's rest too."""
    return numbered(spark, left).join(numbered(spark, right), "place", how)


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    raise FileNotFoundError(candidates)


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What of ``todo`` has no result yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def training_rows(df: DataFrame, source: Column, system: str) -> DataFrame:
    """Prompt, reward model and extra info as nested training rows."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.select(
        source.alias("data_source"),
        F.array(message("system", F.lit(system)), message("user", F.col("query"))).alias("prompt"),
        F.lit("planning").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("plan_text").alias("ground_truth")).alias("reward_model"),
        F.struct("query_id", "quality_score", "error_type", "split").alias("extra_info"),
    )
