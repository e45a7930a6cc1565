"""The data model: cells (scene, y, x, band, value), pixels (scene, y, x, spectrum) and planes (scene, y, x, v).

A missing reading is an absent row or a null, never NaN, so that the aggregates of Spark ignore it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 0.0, 1.25  # physical limits of a reflectance


def valid_cells(cells: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """scene, y, x, band, value of the readings within the limits, each position once."""
    place = ["scene", "y", "x", "band"]
    kept = cells.where(F.col("value").between(low, high)).dropna(subset=place)
    return kept.groupBy(*place).agg(F.max("value").alias("value"))


def all_cells(cells: DataFrame) -> DataFrame:
    """scene, y, x, band, value of all readings that are not missing, each position once."""
    place = ["scene", "y", "x", "band"]
    return cells.where("value IS NOT NULL AND NOT isnan(value)").dropna(subset=place).groupBy(*place).agg(F.max("value").alias("value"))


def pixels(cells: DataFrame) -> DataFrame:
    """scene, y, x, bands, spectrum: one row per pixel, both arrays in the order of the bands."""
    pair = F.array_sort(F.collect_list(F.struct("band", "value")))
    return cells.groupBy("scene", "y", "x").agg(pair.alias("_p")).select("scene", "y", "x", F.col("_p.band").alias("bands"), F.col("_p.value").alias("spectrum"))


def cells_of(pixel: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """scene, y, x, band, value: the long view of a pixel frame."""
    z = F.explode(F.arrays_zip(F.col("bands").alias("band"), F.col(spectrum).alias("value")))
    return pixel.select("scene", "y", "x", z.alias("_z")).select("scene", "y", "x", "_z.band", "_z.value")


def plane(cells: DataFrame, band: int) -> DataFrame:
    """scene, y, x, v of one band."""
    return cells.where(F.col("band") == band).select("scene", "y", "x", F.col("value").alias("v"))


def extent(cells: DataFrame) -> DataFrame:
    """scene, height, width."""
    return cells.groupBy("scene").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)
