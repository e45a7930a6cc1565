"""From scenes to samples as one lazy plan: cubes, masks, rectangles, the species mapping and the samples joined to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe.frame import cells_of, extent
from cubeframe.operators.masks import top_contrast
from cubeframe.operators.regions import fixed_rects, within


def sample_matrix(cells: DataFrame, rects: DataFrame) -> DataFrame:
    """sample_id, label, scene, ordinal, y, x, band, value. rects: scene, ordinal, label, y1, y2, x1, x2.

    sample_id is a hash of the pixel and its sample, so that it is the same in every run.
    """
    s = within(cells, rects, ["ordinal", "label"])
    return s.select(F.xxhash64("scene", "ordinal", "y", "x").alias("sample_id"), "label", "scene", "ordinal", "y", "x", "band", "value")


def combined(masks: DataFrame) -> DataFrame:
    """Pixels of any of a scene's masks."""
    return masks.select("scene", "y", "x").distinct()


def masked_samples(pixel: DataFrame, masks: DataFrame, mapping: DataFrame) -> DataFrame:
    """species, ordinal, scene, y, x, spectrum: the whole frame of each mask (scene, ordinal, y, x), zero outside it.

    Masks and species meet by ordinal; those without a partner are left out.
    """
    named = masks.select("scene", "ordinal").distinct().join(mapping, ["scene", "ordinal"])
    frame = pixel.join(named, "scene").join(masks.withColumn("_in", F.lit(True)), ["scene", "ordinal", "y", "x"], "left")
    return frame.select("species", "ordinal", "scene", "y", "x", F.when(F.col("_in"), F.col("spectrum")).otherwise(F.transform("spectrum", lambda v: F.lit(0.0))).alias("spectrum"))


def sample_summary(samples: DataFrame) -> DataFrame:
    """label, samples, pixels, shapes of a sample matrix."""
    shape = samples.groupBy("label", "scene", "ordinal").agg((F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"), F.count_distinct("y", "x").alias("n"))
    return shape.groupBy("label").agg(F.count("*").alias("samples"), F.sum("n").alias("pixels"), F.count_distinct("h", "w").alias("shapes"))


def header_summary(scenes: DataFrame) -> DataFrame:
    """key, scenes: header keys and how many scenes have them."""
    return scenes.select("scene", F.explode(F.map_keys("meta")).alias("key")).groupBy("key").agg(F.count_distinct("scene").alias("scenes"))


class ScenePipeline:
    """A folder of ENVI cubes to samples: load, mask, place rectangles, join the mapping. Every step is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str, mapping: DataFrame, suffix: str = "_refl"):
        from cubeframe.sources.envi import EnviSource

        spark.dataSource.register(EnviSource)
        self.pixels = spark.read.format("envi").option("suffix", suffix).load(folder).withColumn("bands", F.sequence(F.lit(0), F.size("spectrum") - 1))
        self.mapping = mapping

    @property
    def cells(self) -> DataFrame:
        return cells_of(self.pixels)

    def masks(self, mask: Callable[[DataFrame], DataFrame] | None = None, **how) -> DataFrame:
        """scene, y, x; mask: any function from cells to true pixels, top_contrast by default."""
        return mask(self.cells) if mask else top_contrast(self.cells, **how)

    def run(self, width: int = 50, height: int = 90, min_frac: float = 0.9, **how) -> DataFrame:
        """The sample matrix. Rectangles are width lines by height samples, in this order."""
        size = extent(self.cells)
        rects = fixed_rects(self.masks(**how), (width, height), size, min_frac)
        rects = rects.withColumns({"y1": F.col("top"), "y2": F.col("top") + width, "x1": F.col("left"), "x2": F.col("left") + height})
        named = rects.join(self.mapping.withColumnRenamed("species", "label"), ["scene", "ordinal"])
        return sample_matrix(self.cells, named)
