"""Background masks: rectangles, contrast, spectral angle, high-pass, k-means and principal components.

A mask is the frame (scene, y, x) of its true pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeframe.frame import extent, pixels
from cubeframe.functions import spectra as S
from cubeframe.operators import spatial
from cubeframe.operators.stats import entropy, otsu, quantile

PIXEL = ["scene", "y", "x"]


def rectangles(size: tuple[int, int], grid: tuple[int, int], start: tuple[int, int] = (0, 0), spacing: tuple[int, int] | int = 0) -> Column:
    """Array of (rect, y0, y1, x0, x1), row by row; sizes are (height, width)."""
    if not isinstance(spacing, (int, tuple)):
        raise TypeError("spacing is a number or a pair")
    dy, dx = (spacing, spacing) if isinstance(spacing, int) else spacing
    out = []
    for r in range(grid[0]):
        for c in range(grid[1]):
            y, x = start[0] + r * (size[0] + dy), start[1] + c * (size[1] + dx)
            out.append(F.struct(*(F.lit(v).alias(n) for n, v in (("rect", r * grid[1] + c), ("y0", y), ("y1", y + size[0]), ("x0", x), ("x1", x + size[1])))))
    return F.array(*out)


def rect_split(frame: DataFrame, size: tuple[int, int], grid: tuple[int, int], start: tuple[int, int] = (0, 0), spacing: tuple[int, int] | int = 0) -> DataFrame:
    """frame with rect, the rectangle of a row-major grid that the pixel lies in; a rectangle that exceeds the image is clipped.

    The number follows from the position: no join.
    """
    dy, dx = (spacing, spacing) if isinstance(spacing, int) else spacing
    y, x = F.col("y") - start[0], F.col("x") - start[1]
    r, c = F.floor(y / (size[0] + dy)), F.floor(x / (size[1] + dx))
    inside = (y >= 0) & (x >= 0) & (r < grid[0]) & (c < grid[1]) & (y - r * (size[0] + dy) < size[0]) & (x - c * (size[1] + dx) < size[1])
    return frame.where(inside).withColumn("rect", (r * grid[1] + c).cast("int"))


def band_contrast(cells: DataFrame) -> DataFrame:
    """scene, band, contrast: standard deviation of the band scaled to 0..1; 0 for a constant band."""
    v = F.col("value")
    return cells.groupBy("scene", "band").agg(F.coalesce(F.try_divide(F.stddev_pop(v), F.max(v) - F.min(v)), F.lit(0.0)).alias("contrast"))


def contrast_votes(cells: DataFrame, top_n: int = 5, boost: tuple[float, float] = (0.3, 0.7), shadow_quantile: float = 0.1, max_band: int | None = None) -> DataFrame:
    """scene, y, x, votes: of the top_n bands by contrast, in how many the boosted reading is above Otsu's threshold."""
    used = cells if max_band is None else cells.where(F.col("band") < max_band)
    rank = F.row_number().over(Window.partitionBy("scene").orderBy(F.desc(F.round("contrast", 12)), "band"))
    top = band_contrast(used).withColumn("r", rank).where(F.col("r") <= top_n).select("scene", "band")
    kept = used.join(top, ["scene", "band"])
    limits = kept.groupBy("scene", "band").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    boosted = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("s") - boost[0]) / (boost[1] - boost[0])))
    kept = kept.join(limits, ["scene", "band"]).withColumn("s", scaled).select(*PIXEL, "band", boosted.alias("v"))
    dark = quantile(kept, ["scene", "band"], "v", shadow_quantile).withColumnRenamed("quantile", "q")
    kept = kept.join(dark, ["scene", "band"]).select(*PIXEL, "band", F.when(F.col("v") < F.col("q"), 0.0).otherwise(F.col("v")).alias("v"))
    return kept.join(otsu(kept, ["scene", "band"]), ["scene", "band"]).groupBy(*PIXEL).agg(F.count_if(F.col("v") > F.col("threshold")).alias("votes"))


def top_contrast(cells: DataFrame, top_n: int = 5, min_size: int = 500, hole_size: int = 100, crop: tuple[int, int] = (0, 0), **how) -> DataFrame:
    """Majority of the best bands, without small objects and holes; crop: lines and samples at each edge left out."""
    size = extent(cells)
    inner = cells
    if crop != (0, 0):
        y, x = F.col("y"), F.col("x")
        inner = cells.join(size, "scene").where((y >= crop[0]) & (y < F.col("height") - crop[0]) & (x >= crop[1]) & (x < F.col("width") - crop[1])).select(*cells.columns)
    mask = contrast_votes(inner, top_n, **how).where(F.col("votes") > top_n // 2).select(*PIXEL)
    return spatial.remove_small_holes(spatial.remove_small_objects(mask, min_size), hole_size, size)


def angles(pixel: DataFrame, reference: Column) -> DataFrame:
    """scene, y, x, angle: degrees to a reference spectrum (array column or literal)."""
    return pixel.select(*PIXEL, S.angle(F.col("spectrum"), reference).alias("angle"))


def spectral_angle(angle: DataFrame, mode: str = "otsu", degrees: float = 10.0, is_background: bool = True) -> DataFrame:
    """True pixels by angle: under the threshold, or not under it where the reference is the background.

    Pixels without an angle are not under any threshold, so they are foreground when the reference is the background.
    """
    if mode == "otsu":
        angle = angle.join(otsu(angle.where("angle IS NOT NULL"), ["scene"], "angle").select("scene", "threshold"), "scene")
    else:
        angle = angle.withColumn("threshold", F.lit(degrees))
    under = F.coalesce(F.col("angle") < F.col("threshold"), F.lit(False))
    return angle.where(~under if is_background else under).select(*PIXEL)


def bright(intensity: DataFrame, shadow_quantile: float = 0.1, least: float = 1e-6) -> DataFrame:
    """Pixels brighter than the quantile of their scene and than ``least``. intensity: scene, y, x, v."""
    limit = quantile(intensity, ["scene"], "v", shadow_quantile)
    return intensity.join(limit, "scene").where((F.col("v") > F.col("quantile")) & (F.col("v") > least)).select(*PIXEL)


def norms(pixel: DataFrame) -> DataFrame:
    """scene, y, x, v: the length of every spectrum, the intensity by which shadows are told from the spectral angle's pixels."""
    return pixel.select(*PIXEL, F.sqrt(F.aggregate("spectrum", F.lit(0.0), lambda s, x: s + x * x)).alias("v"))


def tidy(mask: DataFrame, size: DataFrame, min_size: int = 500, radius: int = 2, fill: bool = True, smooth_sigma: float | None = None) -> DataFrame:
    """Small objects out, holes filled, opened and closed with a disk; smoothed by a Gaussian and cut at one half if asked."""
    mask = spatial.remove_small_objects(mask, min_size)
    if fill:
        mask = spatial.fill_holes(mask, size)
    mask = spatial.closing(spatial.opening(mask, spatial.disk(radius), size), spatial.disk(radius), size)
    if smooth_sigma is None:
        return mask
    grid = spatial.complement(mask.where("false"), size)
    plane = grid.join(mask.withColumn("v", F.lit(1.0)), PIXEL, "left").select(*PIXEL, F.coalesce("v", F.lit(0.0)).alias("v"))
    return spatial.gaussian(plane, smooth_sigma).where("v > 0.5").select(*PIXEL)


def highpass(plane: DataFrame, sigma: float = 5.0) -> DataFrame:
    """scene, y, x, v: the plane less its Gaussian, scaled to 0..1 per scene."""
    low = spatial.gaussian(plane, sigma).withColumnRenamed("v", "g")
    diff = plane.join(low, PIXEL).select(*PIXEL, (F.col("v") - F.col("g")).alias("d"))
    limits = diff.groupBy("scene").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    scaled = F.try_divide(F.col("d") - F.col("lo"), F.col("hi") - F.col("lo"))
    return diff.join(limits, "scene").select(*PIXEL, F.coalesce(scaled, F.lit(0.0)).alias("v"))


def highpass_otsu(plane: DataFrame, sigma: float = 5.0, min_size: int = 500, hole_size: int = 100, invert: bool = False) -> DataFrame:
    size = extent(plane)
    high = highpass(plane, sigma)
    mask = high.join(otsu(high, ["scene"]), "scene").where("v > threshold").select(*PIXEL)
    mask = spatial.remove_small_holes(spatial.remove_small_objects(mask, min_size), hole_size, size)
    return spatial.complement(mask, size) if invert else mask


def kmeans_mask(pixel: DataFrame, size: DataFrame, target: str = "small", structure: int = 5) -> DataFrame:
    """The smallest or largest cluster of each scene, opened, then closed. pixel: scene, y, x, cluster; size: scene, height, width."""
    n = pixel.groupBy("scene", "cluster").agg(F.count("*").alias("n"))
    order = F.struct("n", "cluster") if target == "small" else F.struct("n", -F.col("cluster"))
    pick = n.groupBy("scene").agg((F.min_by if target == "small" else F.max_by)("cluster", order).alias("cluster"))
    mask = pixel.join(pick, ["scene", "cluster"]).select(*PIXEL)
    return spatial.closing(spatial.opening(mask, spatial.square(structure), size), spatial.square(structure), size)


def component_scores(components: DataFrame, mode: str = "contrast") -> DataFrame:
    """scene, band (the component), score: contrast, std, entropy or otsu. components: cells of component images."""
    v, keys = F.col("value"), ["scene", "band"]
    if mode == "otsu":
        return otsu(components.withColumnRenamed("value", "v"), keys).select(*keys, F.col("separation").alias("score"))
    if mode == "entropy":
        return entropy(components, keys, "value").withColumnRenamed("entropy", "score")
    score = F.stddev_pop(v) if mode == "std" else F.stddev_pop(v) / (F.max(v) - F.min(v) + 1e-6)
    return components.groupBy(*keys).agg(score.alias("score"))


def component_mask(components: DataFrame, selection: str | int = "contrast", mode: str = "threshold", threshold: float = 0.9, lower: float = 0.3, upper: float = 0.7) -> DataFrame:
    """True pixels of one component of each scene: that of a given number, or the best by contrast, std, entropy or otsu.

    mode ``threshold``: above its Otsu threshold; ``contrast``: above ``threshold`` once it is stretched from lower..upper to 0..1.
    """
    if mode not in ("threshold", "contrast"):
        raise ValueError(mode)
    if isinstance(selection, int):
        one = components.where(F.col("band") == selection)
    else:
        best = component_scores(components, selection).groupBy("scene").agg(F.max_by("band", F.struct(F.round("score", 12), -F.col("band"))).alias("band"))
        one = components.join(best, ["scene", "band"])
    one = one.select(*PIXEL, F.col("value").alias("v"))
    if mode == "threshold":
        return one.join(otsu(one, ["scene"]), "scene").where("v > threshold").select(*PIXEL)
    return one.where(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("v") - lower) / (upper - lower))) > threshold).select(*PIXEL)


def pca_mask(components: DataFrame, intensity: DataFrame, size: DataFrame, shadow_quantile: float = 0.1, **how) -> DataFrame:
    """component_mask, opened and closed by 3 x 3, holes filled, without the pixels darker than the quantile of their scene.

    intensity: scene, y, x, v, the mean reading of every pixel; how: see component_mask.
    """
    three = spatial.square(3)
    mask = spatial.closing(spatial.opening(component_mask(components, **how), three, size), three, size)
    limit = quantile(intensity, ["scene"], "v", shadow_quantile)
    dark = intensity.join(limit, "scene").where(F.col("v") < F.col("quantile")).select(*PIXEL)
    return spatial.fill_holes(mask, size).join(dark, PIXEL, "left_anti")


def whole_pixels(cells: DataFrame) -> DataFrame:
    """Pixels that have a reading in every band of their scene."""
    bands = cells.groupBy("scene").agg(F.count_distinct("band").alias("_b"))
    return pixels(cells).join(bands, "scene").where(F.size("spectrum") == F.col("_b")).drop("_b")
