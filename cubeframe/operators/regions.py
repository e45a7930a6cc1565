"""Rectangles and regions: found in masks, sized, placed and cut out of cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeframe.operators import spatial

BLOCK = 64
RECT = ["y1", "y2", "x1", "x2"]


def boxes(labelled: DataFrame) -> DataFrame:
    """scene, label, half-open box, pixels and centroid of every region."""
    return labelled.groupBy("scene", "label").agg(
        F.min("y").alias("y1"), (F.max("y") + 1).alias("y2"), F.min("x").alias("x1"), (F.max("x") + 1).alias("x2"), F.count("*").alias("n"), F.avg("y").alias("cy"), F.avg("x").alias("cx")
    )


def within(frame: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """frame's rows with the keys of every rectangle (scene, y1, y2, x1, x2 half-open) they lie in.

    An equi-join on scene and block of lines: a rectangle takes part in each block that it overlaps, so that a scene with
    many rectangles does not meet all of them.
    """
    blocks = F.sequence(F.floor(F.greatest(F.col("y1"), F.lit(0)) / BLOCK), F.floor((F.col("y2") - 1) / BLOCK))
    r = rects.where("y1 < y2 AND x1 < x2 AND y2 > 0").select("scene", *keys, *RECT, F.explode(blocks).alias("_block"))
    joined = frame.withColumn("_block", F.floor(F.col("y") / BLOCK)).join(r, ["scene", "_block"])
    return joined.where("y >= y1 AND y < y2 AND x >= x1 AND x < x2").select(*frame.columns, *keys)


def valid_regions(mask: DataFrame, min_ratio: float, n: int, strict: bool = False) -> DataFrame:
    """The n largest boxes per scene whose share of true pixels (of any region) is at least, or above, min_ratio."""
    found = boxes(spatial.label(mask, 8))
    inside = within(mask.select("scene", "y", "x"), found, ["label"]).groupBy("scene", "label").agg(F.count("*").alias("n_true"))
    area = (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    r = found.join(inside, ["scene", "label"]).withColumns({"area": area, "true_ratio": F.col("n_true") / area})
    kept = r.where(F.col("true_ratio") > min_ratio if strict else F.col("true_ratio") >= min_ratio)
    rank = F.row_number().over(Window.partitionBy("scene").orderBy(F.desc("area"), "label"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= n).select("scene", "label", *RECT, "area", "n_true", "rank")


def rect_size(regions: DataFrame, margin: int = 0) -> DataFrame:
    """scene, rect_h, rect_w: whole medians of heights and widths less two margins, at least 1."""
    side = lambda a, b: F.greatest(F.lit(1), F.floor(F.median(F.col(b) - F.col(a))).cast("int") - 2 * margin)
    return regions.groupBy("scene").agg(side("y1", "y2").alias("rect_h"), side("x1", "x2").alias("rect_w"))


def centred_rects(regions: DataFrame, height: Column, width: Column, size: DataFrame) -> DataFrame:
    """The regions' boxes replaced by rectangles of half a height and width around their centres, clamped to the image."""
    cy, cx = F.floor((F.col("y1") + F.col("y2")) / 2), F.floor((F.col("x1") + F.col("x2")) / 2)
    hh, hw = F.floor(height / 2), F.floor(width / 2)
    r = regions.join(size, "scene")
    new = {"y1": F.greatest(F.lit(0), cy - hh), "y2": F.least(F.col("height"), cy + hh), "x1": F.greatest(F.lit(0), cx - hw), "x2": F.least(F.col("width"), cx + hw)}
    return r.withColumns({k: v.cast("int") for k, v in new.items()}).drop("height", "width")


def rect_mask(mask: DataFrame, rect: tuple[int, int], size: DataFrame, min_ratio: float, n: int) -> DataFrame:
    """scene, ordinal (from 1), y1, y2, x1, x2: rectangles (height, width) about the n largest regions of the closed mask.

    The mask is closed by 3 x 3; regions count whose box is filled by more than min_ratio; ties in size go by the first pixel.
    """
    found = valid_regions(spatial.closing(mask, spatial.square(3), size), min_ratio, n, strict=True)
    placed = centred_rects(found.select("scene", F.col("rank").alias("ordinal"), *RECT), F.lit(rect[0]), F.lit(rect[1]), size)
    return placed.select("scene", "ordinal", *RECT)


def rect_pixels(rects: DataFrame) -> DataFrame:
    """scene, y, x of the pixels in any of the rectangles: the mask they make."""
    y = F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("y")
    lines = rects.where("y1 < y2 AND x1 < x2").select("scene", "x1", "x2", y)
    return lines.select("scene", "y", F.explode(F.sequence(F.col("x1"), F.col("x2") - 1)).alias("x")).distinct()


def crops(cells: DataFrame, rects: DataFrame, key: str = "ordinal") -> DataFrame:
    """scene, key, y, x, band, value: the readings of every rectangle, with places counted from its corner.

    key: what names the rectangle, such as its ordinal or its species.
    """
    corner = rects.select("scene", *RECT, F.struct(F.col(key).alias("k"), F.col("y1").alias("y0"), F.col("x1").alias("x0")).alias("_r"))
    inside = within(cells, corner, ["_r"])
    return inside.select("scene", F.col("_r.k").alias(key), (F.col("y") - F.col("_r.y0")).alias("y"), (F.col("x") - F.col("_r.x0")).alias("x"), "band", "value")


def mask_boxes(masks: DataFrame, key: str = "mask_id") -> DataFrame:
    """scene, key, box of every mask's true pixels. Empty masks have no row; the others keep their key."""
    return masks.groupBy("scene", key).agg(F.min("y").alias("y1"), (F.max("y") + 1).alias("y2"), F.min("x").alias("x1"), (F.max("x") + 1).alias("x2"))


def fixed_rects(mask: DataFrame, rect: tuple[int, int], size: DataFrame, min_frac: float = 0.9, mode: str = "column") -> DataFrame:
    """scene, group, ordinal, top, left of fixed rectangles (height, width) around region centroids.

    The centroid is rounded half to even, the rectangle moved inside the image, kept if at least min_frac of it is true.
    Rectangles are then grouped along one axis: sorted by it, a group goes on while the distance from its first member is
    within a quarter of the rectangle; groups are ordered inside along the other axis.
    """
    if mode not in ("column", "row"):
        raise ValueError(mode)
    h, w = rect
    found = boxes(spatial.label(mask, 8)).join(size, "scene")
    clamp = lambda c, d, limit: F.greatest(F.lit(0), F.least(F.rint(c).cast("int") - d // 2, F.col(limit) - d))
    found = found.select("scene", "label", clamp("cy", h, "height").cast("int").alias("top"), clamp("cx", w, "width").cast("int").alias("left"))
    rects = found.withColumns({"y1": F.col("top"), "y2": F.col("top") + h, "x1": F.col("left"), "x2": F.col("left") + w})
    hits = within(mask.select("scene", "y", "x"), rects, ["label"]).groupBy("scene", "label").agg(F.count("*").alias("hits"))
    kept = rects.join(hits, ["scene", "label"]).where(F.col("hits") >= min_frac * h * w)
    along, across, reach = ("left", "top", w // 4) if mode == "column" else ("top", "left", h // 4)
    return _in_lines(kept.select("scene", "label", "top", "left"), along, across, reach)


def _in_lines(rects: DataFrame, along: str, across: str, reach: int) -> DataFrame:
    """scene, group, ordinal, top, left. The groups are found over the distinct coordinates of a scene, at most as many as it
    has lines or samples; the rectangles themselves are only joined and numbered."""
    at = rects.groupBy("scene").agg(F.array_sort(F.collect_set(along)).alias("at"))

    def step(s: Column, a: Column) -> Column:
        new = s["anchor"].isNull() | (a - s["anchor"] > reach)
        return F.struct(F.when(new, a).otherwise(s["anchor"]).alias("anchor"), F.when(new, F.array_append(s["firsts"], a)).otherwise(s["firsts"]).alias("firsts"))

    first = F.struct(F.lit(None).cast("int").alias("anchor"), F.array().cast("array<int>").alias("firsts"))
    anchors = at.select("scene", F.posexplode(F.aggregate("at", first, step)["firsts"]).alias("group", "anchor"))
    spans = anchors.select("scene", "group", "anchor", F.explode(F.sequence(F.col("anchor"), F.col("anchor") + reach)).alias(along))
    grouped = rects.join(spans, ["scene", along])
    grouped = grouped.groupBy("scene", "label", "top", "left").agg(F.min("group").alias("group"))  # a coordinate in reach of two anchors is in the first group
    within_ = Window.partitionBy("scene", "group").orderBy(across, "label")
    sizes = grouped.groupBy("scene", "group").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("scene").orderBy("group")) - F.col("n")).drop("n")
    numbered = grouped.withColumn("in_group", F.row_number().over(within_)).join(before, ["scene", "group"])
    return numbered.select("scene", "group", (F.col("before") + F.col("in_group")).cast("int").alias("ordinal"), "top", "left")
