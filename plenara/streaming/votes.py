"""An extension of the vote statistics to streams: windowed counts with a watermark. The batch operators stay the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenara.functions import votes as V


def windowed_stats(votes: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and smoothed shares of each statement in each window of a stream (or table) of votes (ts, session, s, vote)."""
    counted = votes.withWatermark(time, late).groupBy(F.window(time, window), "session", "s").agg(*V.class_counts(F.col("vote")), F.count("vote").alias("seen"))
    return counted.select("window.start", "session", "s", *V.LABELS, "seen", V.laplace(F.col("agree"), F.col("seen")).alias("pa"), V.laplace(F.col("disagree"), F.col("seen")).alias("pd"))
