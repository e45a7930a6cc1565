"""Readings as a stream: per-pixel functions work on a streaming frame as they are; counts per day need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeframe.functions import spectra as S


def normalised(pixels: DataFrame) -> DataFrame:
    """A streaming pixel frame with SNV spectra: narrow, so stateless."""
    return pixels.withColumn("spectrum", S.snv(F.col("spectrum")))


def windowed_stats(readings: DataFrame, at: str = "loaded_at", late: str = "1 day", window: str = "1 day") -> DataFrame:
    """window, scene, band, n, mean of a stream of readings; readings later than ``late`` are dropped."""
    return readings.withWatermark(at, late).groupBy(F.window(at, window), "scene", "band").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
