"""Structured Streaming forms of the batch operators (an extension: the batch functions above define the results)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watermarked(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """A stream with event time; watermarks need a timestamp with a zone, which the session's (UTC) gives. Tables stay."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if events.isStreaming else events


def debounce(events: DataFrame, user: str, ts: str, value: str, gap: str = "200 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """The last value of each run of events of a user that are less than ``gap`` apart. Works on streams and tables."""
    runs = watermarked(events, ts, delay).groupBy(F.col(user), F.session_window(ts, gap).alias("w")).agg(F.max(F.struct(ts, value)).alias("last"), F.count(F.lit(1)).alias("n"))
    return runs.select(user, F.col("last")[ts].alias("at"), F.col("last")[value].alias("value"), "n")


def tumbling_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return watermarked(events, ts, delay).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def history(events: DataFrame, user: str, ts: str, key: str, limit: int = 10) -> DataFrame:
    """(user, key, last_at, rank): per user the last ``limit`` distinct keys, newest first; of equal times the least key first.

    On a stream (output mode update) each batch gives the whole history of the users that it touches. The state holds
    ``limit`` keys per user: one that falls out can only come back by a newer event.
    """
    from graphloom.operators.view import history as of_table

    if not events.isStreaming:
        return of_table(events, user, ts, [key], limit).select(user, key, "last_at", "rank")
    slim = events.select(user, key, F.col(ts).cast("timestamp").alias("last_at"))
    out = T.StructType([*slim.schema.fields, T.StructField("rank", T.IntegerType())])
    held = T.StructType([T.StructField("keys", T.ArrayType(slim.schema[key].dataType)), T.StructField("times", T.ArrayType(T.LongType()))])

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get)) if state.exists else {}
        for batch in batches:
            newest = batch.groupby(key, dropna=False)["last_at"].max()
            for k, at in zip(newest.index, newest.astype("datetime64[us]").astype("int64")):
                last[k] = max(at, last.get(k, at))
        kept = sorted(last.items(), key=lambda item: (-item[1], item[0]))[:limit]
        state.update(([k for k, _ in kept], [int(at) for _, at in kept]))
        times = pd.to_datetime([at for _, at in kept], unit="us")
        yield pd.DataFrame({user: [group[0]] * len(kept), key: [k for k, _ in kept], "last_at": times, "rank": range(1, len(kept) + 1)}, columns=out.names)

    return slim.groupBy(user).applyInPandasWithState(update, out, held, "update", GroupStateTimeout.NoTimeout)


def upsert_sink(stream: DataFrame, path: str, key: tuple[str, ...], by: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch is reduced to the newest row per key and written under its batch id, so that a batch run
    twice overwrites itself; ``upserted`` reads the whole as one table."""
    from graphloom.operators.merge import latest

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, by).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def upserted(spark, path: str, key: tuple[str, ...], by: str) -> DataFrame:
    from graphloom.operators.merge import latest

    return latest(spark.read.parquet(path).drop("batch"), key, by)
