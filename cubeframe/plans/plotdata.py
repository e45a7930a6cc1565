"""What a plot of a cube shows, as tidy frames; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeframe.operators.stats import band_stats, histogram, quantile


def _scaled(low, high):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - low) / (high - low + 1e-8)))


def image(cells: DataFrame, bands: list[int]) -> DataFrame:
    """scene, y, x and one column per channel (c0, ...), each scaled to 0..1 within its scene. One band or three."""
    if len(bands) not in (1, 3):
        raise ValueError("an image has one band or three")
    kept = cells.where(F.col("band").isin(bands))
    limits = kept.groupBy("scene", "band").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    kept = kept.join(limits, ["scene", "band"]).withColumn("s", _scaled(F.col("low"), F.col("high")))
    return kept.groupBy("scene", "y", "x").agg(*(F.max(F.when(F.col("band") == b, F.col("s"))).alias(f"c{i}") for i, b in enumerate(bands)))


def spectra_envelope(cells: DataFrame) -> DataFrame:
    """scene, band, mean, low, high (one standard deviation), min, max."""
    s = band_stats(cells)
    return s.select("scene", "band", "mean", (F.col("mean") - F.col("std")).alias("low"), (F.col("mean") + F.col("std")).alias("high"), "min", "max")


def value_histogram(cells: DataFrame, bins: int = 100, band: int | None = None) -> DataFrame:
    return histogram(cells if band is None else cells.where(F.col("band") == band), ["scene"], "value", bins)


def slices(cells: DataFrame, n: int = 10, stride: int = 3, spacing: int = 10, mask: DataFrame | None = None) -> DataFrame:
    """scene, slice, band, z, y, x, v: n bands spread over the spectrum, every stride-th pixel, scaled per slice (0 if flat).

    The first slice is on top. mask: scene, y, x of the pixels that are shown; with it alpha is 1 for these, 0 for others.
    """
    nb = cells.groupBy("scene").agg((F.max("band") + 1).alias("nb"))
    pick = nb.select("scene", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slice"), "nb").withColumn("band", F.expr(f"cast(slice * (nb - 1) div {max(n - 1, 1)} as int)"))
    s = cells.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0)).join(pick, ["scene", "band"])
    limits = s.groupBy("scene", "slice").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    v = F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    s = s.join(limits, ["scene", "slice"]).select("scene", "slice", "band", ((F.lit(n - 1) - F.col("slice")) * spacing).alias("z"), "y", "x", v.alias("v"))
    if mask is None:
        return s
    shown = mask.select("scene", "y", "x").distinct().withColumn("alpha", F.lit(1.0))
    return s.join(shown, ["scene", "y", "x"], "left").withColumn("alpha", F.coalesce("alpha", F.lit(0.0))).select("scene", "slice", "band", "z", "y", "x", "v", "alpha")


def stack(cells: DataFrame, n: int | None = 20, stride: int = 3, spacing: float = 1) -> DataFrame:
    """scene, band, z, y, x, v, low, high: n bands spread over the spectrum (all if there are no more), every stride-th pixel.

    The first band is on top; low and high, between which colours run, are those of all bands of the drawn pixels.
    """
    drawn = cells.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0))
    limits = drawn.groupBy("scene").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    nb = cells.groupBy("scene").agg((F.max("band") + 1).alias("nb"))
    spread = F.transform(F.sequence(F.lit(0), F.lit((n or 1) - 1)), lambda k: F.floor(k * (F.col("nb") - 1) / max((n or 1) - 1, 1)).cast("int"))
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    bands = nb.select("scene", "nb", F.explode(every if n is None else F.when(F.col("nb") <= n, every).otherwise(F.array_distinct(spread))).alias("band"))
    s = drawn.join(bands, ["scene", "band"]).join(limits, "scene")
    return s.select("scene", "band", ((F.col("nb") - 1 - F.col("band")) * spacing).alias("z"), "y", "x", F.col("value").alias("v"), "low", "high")


def faces(
    cells: DataFrame, top_band: int = -1, stride: int = 2, percentiles: tuple[float, float] = (1, 99), scaling: str = "percentile", top: str = "single", rgb: tuple[int, int, int] = (0, 1, 2)
) -> DataFrame:
    """scene, face, a, b, v: five faces of the cube, clipped and scaled to 0..1 (0 where all is alike).

    scaling: between percentiles of the scene (``percentile``), its limits (``global``) or those of each face (``surface``).
    top: lines and samples of one band (``single``), of the mean of all bands (``mean``) or of three bands, as the faces top_r,
    top_g and top_b (``rgb``); front, back: samples and bands; left, right: lines and bands.
    """
    if scaling not in ("percentile", "global", "surface") or top not in ("single", "mean", "rgb"):
        raise ValueError((scaling, top))
    size = cells.groupBy("scene").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), (F.max("band") + 1).alias("nb"), F.min("value").alias("low"), F.max("value").alias("high"))
    if scaling == "percentile":
        size = size.drop("low", "high")
        for name, p in zip(("low", "high"), percentiles):
            size = size.join(quantile(cells, ["scene"], "value", p / 100).withColumnRenamed("quantile", name), "scene")
    c = cells.select("scene", "y", "x", "band", "value").join(size, "scene")
    of = lambda band: F.lit(band) if band >= 0 else F.col("nb") + band
    tops = {"single": {"top": top_band}, "rgb": dict(zip(("top_r", "top_g", "top_b"), rgb)), "mean": {}}[top]
    kinds = {name: (F.col("band") == of(band), "y", "x") for name, band in tops.items()} | {
        "front": (F.col("y") == F.col("h") - 1, "x", "band"),
        "back": (F.col("y") == 0, "x", "band"),
        "left": (F.col("x") == 0, "y", "band"),
        "right": (F.col("x") == F.col("w") - 1, "y", "band"),
    }
    face = F.array_compact(F.array(*(F.when(hit, F.struct(F.lit(k).alias("face"), F.col(a).alias("a"), F.col(b).alias("b"))) for k, (hit, a, b) in kinds.items())))
    f = c.select("scene", "value", "low", "high", F.explode(face).alias("f")).select("scene", "f.face", "f.a", "f.b", "value", "low", "high")
    if top == "mean":
        mean = cells.groupBy("scene", F.col("y").alias("a"), F.col("x").alias("b")).agg(F.avg("value").alias("value")).join(size.select("scene", "low", "high"), "scene")
        f = f.unionByName(mean.withColumn("face", F.lit("top")))
    if scaling == "surface":
        f = f.drop("low", "high").join(f.groupBy("scene", "face").agg(F.min("value").alias("low"), F.max("value").alias("high")), ["scene", "face"])
    step = (F.col("a") % stride == 0) & (~F.startswith("face", F.lit("top")) | (F.col("b") % stride == 0))
    clip = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))))
    return f.where(step).select("scene", "face", "a", "b", clip.alias("v"))


def spectrum_with_bins(spectra: DataFrame, keys: list[str], edges: list[float]) -> DataFrame:
    """keys, kind (spectrum, edge, centre), wavelength, value."""
    marks = [("edge", float(e)) for e in edges] + [("centre", (a + b) / 2) for a, b in zip(edges, edges[1:])]
    mark = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(w).alias("wavelength")) for k, w in marks)))
    lines = spectra.select(*keys).distinct().select(*keys, mark.alias("m")).select(*keys, "m.kind", "m.wavelength", F.lit(None).cast("double").alias("value"))
    return spectra.select(*keys, F.lit("spectrum").alias("kind"), "wavelength", "value").union(lines)
