"""The study log as a stream (an extension): days and daily new words with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def study_days(log: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, day, n) from a stream with user_id and ts; a day is final once the watermark has passed it."""
    rows = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    days = rows.groupBy("user_id", F.window("at", "1 day")).agg(F.count("*").alias("n"))
    return days.select("user_id", F.to_date("window.start").alias("day"), "n")


def new_words(log: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, card, at): the first row of each card of a user that arrives within the watermark."""
    rows = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.dropDuplicatesWithinWatermark(["user_id", "card"]).select("user_id", "card", "at")
