"""Micro-batches with state by key, and a sink that a repeated batch leaves as it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STATE = "n long, tail array<double>, older double, stopped long"


def running(stream: DataFrame, key: str, order: list[str], value: str, last: int = 10, recent: int = 5, least: float = 0.5) -> DataFrame:
    """``(key, *order, n, mean, stop)`` of every event: its number within the key from 1,
    the mean of its last ``last`` values, and whether the key has stopped by then: once
    the largest of the last ``recent`` values exceeds the largest before them by less
    than ``least``.

    Events of a key are ordered within a micro-batch, and batches come in turn; the state
    of a key is its count, its last values and the largest of older ones. Null values
    count as events, but are in no mean and no maximum."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    keep = max(last - 1, recent)
    out = ", ".join([f"{key} {kinds[key]}", *(f"{c} {kinds[c]}" for c in order), "n long, mean double, stop boolean"])

    def step(at: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        n, tail, older, stopped = state.get if state.exists else (0, [], None, None)
        rows = pd.concat(list(batches)).sort_values(order)  # one key's events of one micro-batch
        tail, done = list(tail), []
        for *place, x in rows[[*order, value]].itertuples(index=False):
            n += 1
            tail.append(None if pd.isna(x) else float(x))
            if len(tail) > recent:
                passed = tail[-recent - 1]
                older = passed if older is None else older if passed is None else max(older, passed)
            tail = tail[-max(last, keep) :]
            seen = [v for v in tail[-last:] if v is not None]
            new = [v for v in tail[-recent:] if v is not None]
            if stopped is None and older is not None and new and max(new) - older < least:
                stopped = n
            done.append((at[0], *place, n, sum(seen) / len(seen) if seen else None, stopped is not None))
        state.update((n, tail[-keep:], older, stopped))
        yield pd.DataFrame(done, columns=[key, *order, "n", "mean", "stop"])

    return stream.select(key, *order, value).groupBy(key).applyInPandasWithState(step, out, _STATE, "append", "NoTimeout")


def run_batches(stream: DataFrame, sink: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, every: str | None = None) -> None:
    """Micro-batches to Parquet folders ``sink/batch=N``. A batch that is run again, as
    after a lost driver, replaces its own folder, so each event is in the sink once.

    Without ``every`` what is there is processed and the call returns; with it (such as
    "10 seconds") batches start at that interval until the query is stopped. Batches are as
    large as the source's own limit, such as ``maxFilesPerTrigger``."""

    def write(df: DataFrame, batch: int) -> None:
        change(df).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).start().awaitTermination()


def read_batches(spark: SparkSession, sink: str) -> DataFrame:
    """All that ``run_batches`` has written."""
    return spark.read.parquet(f"{sink}/batch=*").drop("batch")


def waves(df: DataFrame, at: str, n: int) -> list[DataFrame]:
    """``df`` in ``n`` parts that follow one another in ``at``: equal stretches of time."""
    time = F.unix_micros(F.col(at).cast("timestamp"))
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None:
        return [df]
    wave = F.least(F.lit(n - 1), F.floor((time - low) / max(1, high - low) * n))
    return [df.where(wave == i) for i in range(n)]
