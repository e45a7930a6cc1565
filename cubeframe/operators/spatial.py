"""Operators on image planes: filters, morphology and connected regions.

A plane is (scene, y, x, v) or, for masks, (scene, y, x) of the true pixels only: absent pixels are false. Lines of an image
are filtered as arrays (one shuffle per direction); regions are found per tile and joined across tile borders.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeframe.session import checkpointed

#: Lines and samples of a tile in which regions are found in one task.
TILE = 512


def gaussian_kernel(sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def _along(plane: DataFrame, line: str, along: str, f) -> DataFrame:
    """f over the arrays of values of every line of a dense plane."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f(np.asarray(v, float)).tolist())

    lines = plane.groupBy("scene", line).agg(F.array_sort(F.collect_list(F.struct(along, "v"))).alias("_l"))
    out = lines.select("scene", line, F.col(f"_l.{along}").alias(along), run(F.col("_l.v")).alias("v"))
    return out.select("scene", line, F.explode(F.arrays_zip(along, "v")).alias("_z")).select("scene", F.col(line), F.col(f"_z.{along}").alias(along), F.col("_z.v").alias("v")).select("scene", "y", "x", "v")


def gaussian(plane: DataFrame, sigma: float) -> DataFrame:
    """Separable Gaussian of radius int(4 sigma + 0.5), the edge sample repeated when it reflects."""
    k = gaussian_kernel(sigma)
    r = len(k) // 2
    smooth = lambda v: np.convolve(np.pad(v, r, mode="symmetric"), k, "valid")
    return _along(_along(plane, "x", "y", smooth), "y", "x", smooth)


def square(size: int) -> list[tuple[int, int]]:
    """Offsets of a size x size structure."""
    r = range(-(size // 2), size - size // 2)
    return [(dy, dx) for dy in r for dx in r]


def disk(radius: int) -> list[tuple[int, int]]:
    r = range(-radius, radius + 1)
    return [(dy, dx) for dy in r for dx in r if dy * dy + dx * dx <= radius * radius]


def _hits(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """How many true pixels each place has in reach."""
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets)))
    moved = mask.select("scene", "y", "x", o.alias("o")).select("scene", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"))
    return moved.groupBy("scene", "y", "x").agg(F.count("*").alias("n"))


def erode(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Pixels whose whole neighbourhood is true; outside the image is false."""
    return _hits(mask, offsets).where(F.col("n") == len(offsets)).select("scene", "y", "x")


def dilate(mask: DataFrame, offsets: list[tuple[int, int]], size: DataFrame) -> DataFrame:
    """Pixels with a true one in reach, within the image. size: scene, height, width."""
    near = _hits(mask, [(-a, -b) for a, b in offsets]).join(size, "scene")
    return near.where("y >= 0 AND x >= 0 AND y < height AND x < width").select("scene", "y", "x")


def opening(mask: DataFrame, offsets, size: DataFrame) -> DataFrame:
    return dilate(erode(mask, offsets), offsets, size)


def closing(mask: DataFrame, offsets, size: DataFrame) -> DataFrame:
    """Dilation, then erosion: true pixels at the border of the image are lost."""
    return erode(dilate(mask, offsets, size), offsets)


def complement(mask: DataFrame, size: DataFrame) -> DataFrame:
    grid = size.select("scene", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).select("scene", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    return grid.join(mask, ["scene", "y", "x"], "left_anti")


def _runs(y: np.ndarray, x: np.ndarray, reach: int) -> np.ndarray:
    """Root (index of the first run) of each pixel's region; pixels in raster order. reach: 1 for 8 neighbours, 0 for 4."""
    first = np.flatnonzero(np.r_[True, (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)])
    ry, a, b = y[first], x[first], x[np.r_[first[1:] - 1, len(x) - 1]]
    parent = list(range(len(first)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above = 0
    for i in range(len(first)):
        while ry[above] < ry[i] - 1 or (ry[above] == ry[i] - 1 and b[above] < a[i] - reach):
            above += 1
        j = above
        while j < i and ry[j] == ry[i] - 1 and a[j] <= b[i] + reach:
            p, q = root(j), root(i)
            parent[max(p, q)] = min(p, q)
            j += 1
    roots = np.array([root(i) for i in range(len(first))])
    return np.repeat(first[roots], np.diff(np.r_[first, len(x)]))


def _min_labels(edges: DataFrame) -> DataFrame:
    """node, low: smallest label of each region; edges (a, b) are only those across tile borders."""
    both = checkpointed(edges.union(edges.select("b", "a")).distinct().toDF("a", "b"))
    low = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(low, both["b"] == low["node"]).groupBy("a").agg(F.min("low").alias("m"))
        new = low.join(near, low["node"] == near["a"]).select("node", "low", F.least("low", "m").alias("next"))
        jump = low.select(F.col("node").alias("next"), F.col("low").alias("far"))
        new = checkpointed(new.join(jump, "next", "left").select("node", F.col("low").alias("old"), F.least("next", F.coalesce("far", "next")).alias("low")))
        if not new.where("old <> low").limit(1).count():
            return new.select("node", "low")
        low = new.select("node", "low")


def label(mask: DataFrame, neighbours: int = 8) -> DataFrame:
    """scene, y, x, label of the true pixels: label is y * 2^24 + x of the region's first pixel in raster order, within its scene."""
    reach = int(neighbours == 8)

    def per_tile(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])
        y, x = rows["y"].to_numpy(np.int64), rows["x"].to_numpy(np.int64)
        at = _runs(y, x, reach)
        return pd.DataFrame({"scene": rows["scene"].to_numpy(), "y": y, "x": x, "part": y[at] << 24 | x[at]})

    tiled = mask.select("scene", "y", "x").distinct().withColumns({"ty": F.floor(F.col("y") / TILE), "tx": F.floor(F.col("x") / TILE)})
    parts = checkpointed(tiled.groupBy("scene", "ty", "tx").applyInPandas(per_tile, "scene string, y int, x int, part bigint"))
    edge = (F.col("y") % TILE).isin(0, TILE - 1) | (F.col("x") % TILE).isin(0, TILE - 1)
    border = parts.where(edge)
    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if reach else [])
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps)))
    ahead = border.select("scene", "y", "x", F.col("part").alias("a"), o.alias("o")).select("scene", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "a")
    links = ahead.join(border.select("scene", "y", "x", F.col("part").alias("b")), ["scene", "y", "x"]).where("a <> b")
    links = checkpointed(links.select(F.struct("scene", F.col("a").alias("part")).alias("a"), F.struct("scene", F.col("b").alias("part")).alias("b")).distinct())
    if not links.limit(1).count():
        return parts.withColumnRenamed("part", "label")
    low = _min_labels(links).select(F.col("node.scene").alias("scene"), F.col("node.part").alias("part"), F.col("low.part").alias("low"))
    return parts.join(low, ["scene", "part"], "left").select("scene", "y", "x", F.coalesce("low", "part").alias("label"))


def remove_small_objects(mask: DataFrame, max_size: int, neighbours: int = 4) -> DataFrame:
    """The mask without regions of at most max_size pixels."""
    found = label(mask, neighbours)
    large = found.groupBy("scene", "label").agg(F.count("*").alias("n")).where(F.col("n") > max_size).select("scene", "label")
    return found.join(large, ["scene", "label"], "left_semi").select("scene", "y", "x")


def remove_small_holes(mask: DataFrame, max_size: int, size: DataFrame) -> DataFrame:
    """The mask with background regions of at most max_size pixels filled."""
    kept = remove_small_objects(complement(mask, size), max_size)
    return complement(kept, size)


def fill_holes(mask: DataFrame, size: DataFrame) -> DataFrame:
    """The mask with every background region filled that does not reach the border."""
    ground = label(complement(mask, size), 4).join(size, "scene")
    outer = ground.where("y = 0 OR x = 0 OR y = height - 1 OR x = width - 1").select("scene", "label").distinct()
    holes = ground.join(outer, ["scene", "label"], "left_anti").select("scene", "y", "x")
    return mask.select("scene", "y", "x").union(holes).distinct()


