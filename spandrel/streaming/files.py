"""New files as a bounded stream, and event windows. The windows are an extension: the batch operators never need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import nulled


def convert_new_files(spark: SparkSession, src: str, dst: str, checkpoint: str, columns: list[str], sep: str = "\t") -> int:
    """Tables that have arrived in src since the last call, appended to the Parquet dataset dst; returns the rows of this call.

    The checkpoint remembers the files, so a call that was cut short goes on where it stopped and none is taken twice.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    stream = spark.readStream.schema(schema).option("sep", sep).option("header", True).csv(src)
    q = nulled(stream).writeStream.format("parquet").option("path", dst).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(int(p["numInputRows"]) for p in q.recentProgress)


def append_distinct(spark: SparkSession, src: str, dst: str, checkpoint: str, schema: StructType, keys: list[str], time: str, delay: str) -> int:
    """Rows of Parquet files that have arrived in src since the last call and repeat no key of the delay before, appended to dst; returns the rows read.

    Keys seen are the stream's state in the checkpoint, so repeats are found from call to call, and a call that was cut short neither loses nor doubles rows.
    """
    rows = distinct_calls(spark.readStream.schema(schema).parquet(src), keys, time, delay)
    q = rows.writeStream.format("parquet").option("path", dst).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(int(p["numInputRows"]) for p in q.recentProgress)


def distinct_calls(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Rows that repeat a key within the delay are dropped; state older than that is forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, key: str, value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key, for batches and streams alike."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    w = df.groupBy(F.window(time, length), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes") -> DataFrame:
    df = events.withWatermark(time, gap) if events.isStreaming else events
    s = df.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
