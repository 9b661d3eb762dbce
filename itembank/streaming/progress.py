"""The progress fold as a stream (an addition: the batch form is :func:`itembank.operators.bank.fold_progress`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Counters by user and question over a stream of outcomes; a repeated ``event_id`` counts once
    if it comes within ``delay``. Write it in update mode."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    n = lambda v: F.count_if(F.col("outcome") == v)
    return once.groupBy("user_id", "question").agg(F.count("*").alias("seen"), n("correct").alias("correct"), n("wrong").alias("wrong"))


def activity_stream(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by kind in tumbling windows; late ones beyond ``delay`` are dropped. Append mode."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "outcome").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "outcome", "n")
