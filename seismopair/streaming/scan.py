"""Streaming forms: templates over a stream of samples, and the state of failed downloads."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import templates as T

FAILURE_STATE = "count int, first timestamp, last timestamp"
FAILURE_OUT = "key string, retry_count int, first_failure_ts timestamp, last_failure_ts timestamp, next_retry_after_ts timestamp, skip boolean"


def stream_series(samples: DataFrame, chunk_s: float, overlap_s: float, step_s: float, late_s: float) -> DataFrame:
    """trace_id, start, data of a stream (trace_id, ts, value): a chunk is told once, when the watermark has passed its end; later samples are dropped."""
    rows = samples.withWatermark("ts", f"{late_s} seconds")
    span, step = f"{int((chunk_s + overlap_s) * 1e6)} microseconds", f"{int(chunk_s * 1e6)} microseconds"
    got = rows.groupBy("trace_id", F.window("ts", span, step).alias("w")).agg(F.collect_list(F.struct("ts", F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"))).alias("s"))
    start = F.unix_micros(F.col("w.start"))
    at = F.transform("s", lambda x: F.floor((F.unix_micros(x["ts"]) - start) / F.lit(step_s * 1e6)).cast("int"))
    return T.filled(got.select("trace_id", F.col("w.start").alias("start"), at.alias("at"), F.col("s.value").alias("value")), int(round((chunk_s + overlap_s) / step_s)))


def scan(samples: DataFrame, templates: DataFrame, chunk_s: float, overlap_s: float, step_s: float, late_s: float, ratio: float) -> DataFrame:
    """Detections of a stream of samples, as the batch scan tells them."""
    return T.scanned(stream_series(samples, chunk_s, overlap_s, step_s, late_s), templates, step_s, ratio)


def upsert_detections(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write detections so that a repeated batch replaces itself: each batch has a folder of its own."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return found.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_state(attempts: DataFrame, base_s: float = 60.0, max_retries: int = 5) -> DataFrame:
    """State after each batch of attempts (key, ts, ok): a failure counts up and doubles the wait, a success clears the key."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, first, last = state.get if state.exists else (0, None, None)
        for rows in batches:
            for ts, ok in sorted(zip(rows["ts"], rows["ok"], strict=True), key=lambda r: r[0]):
                ts = pd.Timestamp(ts).to_pydatetime()
                count, first, last = (0, None, None) if ok else (count + 1, first or ts, ts)
        if not count:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "retry_count": [0], "first_failure_ts": [pd.NaT], "last_failure_ts": [pd.NaT], "next_retry_after_ts": [pd.NaT], "skip": [False]})
            return
        state.update((count, first, last))
        due = last + timedelta(seconds=min(base_s * 2 ** (count - 1), 1e9))
        yield pd.DataFrame({"key": [key[0]], "retry_count": [count], "first_failure_ts": [first], "last_failure_ts": [last], "next_retry_after_ts": [due], "skip": [count >= max_retries]})

    return attempts.groupBy("key").applyInPandasWithState(fold, FAILURE_OUT, FAILURE_STATE, "update", "NoTimeout")
