"""Scores from a judge behind HTTP: calls from partitions, with retries, a budget of failures and resumption."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlens.functions.text import clamp, json_number, json_object

from .io import resume


def request(system: str, user: Column, model: str = "judge", max_tokens: int = 300) -> Column:
    """The JSON body of a chat call without randomness."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", user)).alias("messages"), F.lit(0.0).alias("temperature"), F.lit(max_tokens).alias("max_tokens")))


def _post(url: str, body: str, timeout: float, tries: int, pause: float) -> tuple[str | None, str | None, int]:
    """(content, error, attempts). Broken connections, stalls and errors of the server are tried again."""
    error = ""
    for attempt in range(1, tries + 1):
        try:
            call = urllib.request.Request(url, body.encode("utf-8"), {"Content-Type": "application/json"})
            with urllib.request.urlopen(call, timeout=timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"].strip(), None, attempt
        except urllib.error.HTTPError as e:
            error = f"HTTP {e.code}: {e.read(200).decode('utf-8', 'replace')}"
        except (OSError, urllib.error.URLError) as e:
            error = f"{type(e).__name__}: {e}"
        except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
            return None, f"not an answer: {type(e).__name__}", attempt
        if attempt < tries:
            time.sleep(pause)
    return None, error, tries


def call(requests: DataFrame, url: str, keys: list[str], body: str = "body", parallel: int = 4, timeout: float = 120, tries: int = 3, pause: float = 2.0) -> DataFrame:
    """``keys``, ``content``, ``error`` and ``attempts``: one POST a row, ``parallel`` at a
    time from each task. A row that no try answers has an error and no content; a null
    body is not sent. The number of tasks bounds the load: repartition ``requests`` for it."""
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with ThreadPoolExecutor(parallel) as pool:
            for b in batches:
                ask = lambda t: _post(url, t, timeout, tries, pause) if t is not None else (None, "no request", 0)
                content, error, attempts = zip(*pool.map(ask, b.column(body).to_pylist()), strict=True) if len(b) else ([], [], [])
                cols = [*(b.column(k) for k in keys), pa.array(content, pa.string()), pa.array(error, pa.string()), pa.array(attempts, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, [*keys, "content", "error", "attempts"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "content string, error string, attempts int"])
    return requests.select(*keys, body).mapInArrow(run, schema)


def annotated(answers: DataFrame) -> DataFrame:
    """``answers`` with ``quality_score`` (0 to 100), ``confidence`` (0 to 1), ``full_parse``
    and ``call_failed``. JSON with a score counts in full (50 and 0.5 where fields lack); of
    other texts the score is taken by pattern, with confidence 0.5; else the call failed and scores 0."""
    found = json_object(F.col("content"))
    whole = F.when(F.try_parse_json(found).isNotNull(), found)
    field = lambda k: F.get_json_object(whole, f"$.{k}")
    rescued = json_number(F.col("content"), "quality_score")
    full = whole.isNotNull()
    score = F.when(full, F.coalesce(field("quality_score").try_cast("int"), F.lit(50))).otherwise(F.coalesce(rescued, F.lit(0)))
    failed = F.col("error").isNotNull() | (~full & rescued.isNull())
    sure = F.when(full, F.coalesce(field("confidence").try_cast("double"), F.lit(0.5))).when(failed, 0.0).otherwise(0.5)
    safe = lambda c: F.coalesce(c, F.lit(True))
    return answers.select("*", F.when(safe(failed), 0).otherwise(clamp(score, 0, 100).cast("int")).alias("quality_score"), clamp(sure, 0.0, 1.0).alias("confidence"), F.coalesce(full, F.lit(False)).alias("full_parse"), safe(failed).alias("call_failed"))


def judge(spark: SparkSession, requests: DataFrame, url: str, path: str, keys: list[str], most_failed: float = 0.1, **limits: object) -> DataFrame:
    """Annotations of all ``requests`` (``keys``, ``body``), written under ``path`` as Parquet.

    What an earlier run has answered is not asked again; what failed then is. Raises
    RuntimeError if more than ``most_failed`` of this run's calls fail; their answers are
    written all the same, so that the next run goes on from there. A row a key is returned."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    todo = resume(requests, spark.read.parquet(path).where("not call_failed"), keys) if exists else requests
    run = 0 if not exists else spark.read.parquet(path).agg(F.max("run")).first()[0] + 1
    annotated(call(todo, url, keys, **limits)).withColumn("run", F.lit(run)).write.mode("append").parquet(path)
    every = spark.read.parquet(path)
    n, failed, example = every.where(F.col("run") == run).agg(F.count("*"), F.count_if("call_failed"), F.min(F.when(F.col("call_failed"), F.coalesce("error", F.lit("unparseable"))))).first()
    if n and failed > most_failed * n:
        raise RuntimeError(f"{failed} of {n} judge calls failed, such as: {example}")
    best = every.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in every.columns if c not in keys]), F.struct(~F.col("call_failed"), "run")).alias("a"))
    return best.select(*keys, "a.*")
