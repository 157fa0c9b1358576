"""Rules on streams: row errors as they come, and counts of broken rules by event-time window.

Row checks are stateless projections. The windowed counts keep one small state row for each open window and rule; the
watermark closes windows, so the state doesn't grow with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.check import Checker


def stream_errors(stream: DataFrame, source: str, schema: str) -> DataFrame:
    """The stream's rows that break a rule, with their errors; append mode."""
    return Checker(source).rows(stream, schema).where(F.size("errors") > 0)


def stream_counts(stream: DataFrame, source: str, schema: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``window``, ``rule`` and ``broken``: how many rows broke each rule in each window."""
    found = Checker(source).rows(stream.withWatermark(time, late), schema)
    found = found.select(F.col(time), F.explode("errors.rule").alias("rule"))
    return found.groupBy(F.window(time, window), "rule").agg(F.count(F.lit(1)).alias("broken"))


def pick_up(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes a stream's present rows to Parquet once; run again, it goes on where it stopped."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
