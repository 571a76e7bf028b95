"""Streams of pairs: an extension, batch semantics per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators.pairs import KEYS_LOOSE


def deduplicated(pairs: DataFrame, time_col: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Pairs without later copies (equal ends) that come within the watermark."""
    return pairs.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(KEYS_LOOSE)


def window_pixels(pairs: DataFrame, bin1, bin2, time_col: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(start, i, j, v): contacts per window of event time."""
    rows = pairs.withWatermark(time_col, delay).select(time_col, F.least(bin1, bin2).alias("i"), F.greatest(bin1, bin2).alias("j"))
    counted = rows.groupBy(F.window(time_col, window), "i", "j").agg(F.count("*").alias("v"))
    return counted.select(F.col("window.start").alias("start"), "i", "j", "v")
