"""Continuous intake of message files and their activity by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S


def message_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Messages of JSONL files as they arrive, with ``ts``."""
    rows = spark.readStream.schema(S.MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return rows.where("message_id is not null and conversation_id is not null").withColumn("ts", F.to_timestamp("created_at"))


def once(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first arrival of each message; one repeated later than ``delay`` passes again."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["message_id"])


def append_run(messages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to a table partitioned by provider until all files are read."""
    return messages.writeStream.format("parquet").partitionBy("provider").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(messages: DataFrame, size: str = "7 days", delay: str = "1 day") -> DataFrame:
    """(window, provider, author_role, n) by tumbling windows."""
    late = messages.withWatermark("ts", delay)
    return late.groupBy(F.window("ts", size), "provider", "author_role").agg(F.count("*").alias("n"))


def conversation_sessions(messages: DataFrame, gap: str = "7 days", delay: str = "1 day") -> DataFrame:
    """(session_window, conversation_id, n): a session closes after ``gap`` without a message."""
    late = messages.withWatermark("ts", delay)
    return late.groupBy(F.session_window("ts", gap), "conversation_id").agg(F.count("*").alias("n"))
