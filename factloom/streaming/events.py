"""Structured Streaming forms of the event operators.

Late rows are kept up to the watermark; redeliveries (same `event_id`) are dropped within it.  Results are the same as
the batch queries' once all files have been read and the watermark has passed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.measures import exact_sum

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def source(spark: SparkSession, folder: str, schema: T.StructType = EVENTS, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def clean(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events with a watermark, each `event_id` once."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).where("event_id is not null and ts is not null")
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windows(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """Events per tumbling window and kind."""
    out = events.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), exact_sum(F.col("value")).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    out = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


BUDGET = "user_id bigint, event_id bigint, cum double, exceeded boolean"


def budget(events: DataFrame, limit: float) -> DataFrame:
    """Running sum of `value` per user over all batches, and whether it passes the limit: keyed state of one number.

    Within a batch a user's events count in the order of `ts` and `event_id`; null values count as 0.
    """

    def add(key, batches, state: GroupState):
        held = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        cum = held + rows["value"].fillna(0.0).cumsum()
        state.update((float(cum.iloc[-1]),))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "cum": cum, "exceeded": cum > limit})

    each = events.where("user_id is not null").select("user_id", "event_id", "ts", "value").groupBy("user_id")
    return each.applyInPandasWithState(add, BUDGET, "held double", "append", GroupStateTimeout.NoTimeout)


def run(rows: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Read what is there now into a Parquet folder-backed table and return it; exactly once by checkpoint and commit log."""
    q = rows.writeStream.format("parquet").outputMode(mode).option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(table)
