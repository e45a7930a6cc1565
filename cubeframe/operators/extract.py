"""Spectra of neighbourhoods, grids of regions of interest and drawn regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeframe.operators.regions import within


def local_means(cells: DataFrame, points: DataFrame, size: int = 5, shape: str = "square") -> DataFrame:
    """scene, coord_id, band, value: mean around points (scene, coord_id, py, px): a square of odd size, or a disk of that radius.

    The neighbourhood is clipped at the image's edges; a disk keeps its centre there.
    """
    if shape not in ("square", "disk") or (shape == "square" and size % 2 == 0):
        raise ValueError("a square has an odd size; shapes are square and disk")
    k = size // 2 if shape == "square" else size
    box = points.select("scene", "coord_id", "py", "px", (F.col("py") - k).alias("y1"), (F.col("py") + k + 1).alias("y2"), (F.col("px") - k).alias("x1"), (F.col("px") + k + 1).alias("x2"))
    near = within(cells, box, ["coord_id", "py", "px"])
    if shape == "disk":
        near = near.where((F.col("y") - F.col("py")) ** 2 + (F.col("x") - F.col("px")) ** 2 <= k * k)
    return near.groupBy("scene", "coord_id", "band").agg(F.avg("value").alias("value"))


def grid_rois(cells: DataFrame, size: DataFrame, start: tuple[int, int], roi: tuple[int, int], gap: tuple[int, int], n: tuple[int, int], statistic: str = "median") -> DataFrame:
    """scene, roi_id, x0, y0, x1, y1, band, value: a column-major grid of regions; those that exceed the image are left out.

    All pairs are (lines, samples). The region follows from the position: no join but with the scenes' extents.
    """
    f = {"median": F.median, "mean": F.avg}[statistic]
    y, x = F.col("y") - start[0], F.col("x") - start[1]
    r, c = F.floor(y / (roi[0] + gap[0])), F.floor(x / (roi[1] + gap[1]))
    y0, x0 = (r * (roi[0] + gap[0]) + start[0]).cast("int"), (c * (roi[1] + gap[1]) + start[1]).cast("int")
    inside = (y >= 0) & (x >= 0) & (r < n[0]) & (c < n[1]) & (F.col("y") < y0 + roi[0]) & (F.col("x") < x0 + roi[1])
    fits = (F.col("y0") + roi[0] <= F.col("height")) & (F.col("x0") + roi[1] <= F.col("width"))
    placed = cells.where(inside).withColumns({"roi_id": (c * n[0] + r).cast("int"), "y0": y0, "x0": x0}).join(size, "scene").where(fits)
    return placed.groupBy("scene", "roi_id", "x0", "y0", (F.col("x0") + roi[1]).alias("x1"), (F.col("y0") + roi[0]).alias("y1"), "band").agg(f("value").alias("value"))


def drawn_rects(cells: DataFrame, rects: DataFrame, statistic: str = "median", min_span: int = 5) -> DataFrame:
    """scene, roi_id, band, value of rectangles by two corners (scene, roi_id, x0, y0, x1, y1), in any order; small ones are left out."""
    f = {"median": F.median, "mean": F.avg}[statistic]
    whole = {c: F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")}
    r = rects.select("scene", "roi_id", F.least(whole["y0"], whole["y1"]).alias("y1"), F.greatest(whole["y0"], whole["y1"]).alias("y2"), F.least(whole["x0"], whole["x1"]).alias("x1"), F.greatest(whole["x0"], whole["x1"]).alias("x2"))
    r = r.where((F.col("y2") - F.col("y1") >= min_span) & (F.col("x2") - F.col("x1") >= min_span))
    return within(cells, r, ["roi_id"]).groupBy("scene", "roi_id", "band").agg(f("value").alias("value"))


def drawn_polygons(cells: DataFrame, vertices: DataFrame, statistic: str = "median") -> DataFrame:
    """scene, roi_id, band, value of polygons (scene, roi_id, vertex_ord, vx, vy) of at least three vertices, by ray parity."""
    f = {"median": F.median, "mean": F.avg}[statistic]
    ring = F.array_sort(F.collect_list(F.struct("vertex_ord", "vx", "vy")))
    polygon = vertices.groupBy("scene", "roi_id").agg(ring.alias("ring"), F.min("vx").alias("lx"), F.max("vx").alias("hx"), F.min("vy").alias("ly"), F.max("vy").alias("hy"))
    polygon = polygon.where(F.size("ring") >= 3)
    box = polygon.select("scene", "roi_id", "ring", F.floor("ly").cast("int").alias("y1"), (F.floor("hy") + 1).cast("int").alias("y2"), F.floor("lx").cast("int").alias("x1"), (F.floor("hx") + 1).cast("int").alias("x2"))
    near = within(cells, box, ["roi_id", "ring"])

    def crosses(i: Column) -> Column:
        a, b = F.get("ring", i), F.get("ring", (i + 1) % F.size("ring"))
        spans = (a["vy"] > F.col("y")) != (b["vy"] > F.col("y"))
        at = (b["vx"] - a["vx"]) * F.try_divide(F.col("y") - a["vy"], b["vy"] - a["vy"]) + a["vx"]
        return spans & (F.col("x") < at)

    parity = F.size(F.filter(F.sequence(F.lit(0), F.size("ring") - 1), crosses)) % 2
    return near.where(parity == 1).groupBy("scene", "roi_id", "band").agg(f("value").alias("value"))
