"""Incremental forms of the batch operators over Structured Streaming file sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftlake.cluster import ship


def stream_table(spark: SparkSession, folder: str, schema: str, max_files: int = 16) -> DataFrame:
    """New Parquet files of a folder; the query's checkpoint makes each file count exactly once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def first_seen(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows whose key has not come within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_funnel(stream: DataFrame, *, time: str, window: str, delay: str, by: str) -> DataFrame:
    """Totals and accepted rows of decided rows by event-time window and group."""
    rows = stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), by)
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("accepted"))
    return counts.select(F.col("w.start").alias("start"), by, "total", "accepted")


def running_best(stream: DataFrame, *, key: str, step: str, score: str) -> DataFrame:
    """``key, step, score`` whenever a key's score rises above its best so far; the state is one number a key."""
    ship(stream.sparkSession)

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else float("-inf")
        for part in parts:
            rows = part.sort_values("step")
            rising = rows[rows["score"] > rows["score"].cummax().shift(fill_value=float("-inf")).clip(lower=best)]
            if len(rising):
                best = float(rising["score"].iloc[-1])
                yield pd.DataFrame({"key": k[0], "step": rising["step"], "score": rising["score"]})
        state.update((best,))

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(step).cast("long").alias("step"), F.col(score).cast("double").alias("score"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, step long, score double", "best double", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what is there and stop; run again, it goes on from the checkpoint."""
    query = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
