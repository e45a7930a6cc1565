"""Adaptive spectral bins: edges where a spectrum, or a set of them, carries its information.

One row per band is all that reaches the driver when a binner is fitted; bins are applied as joins or aggregates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeframe.operators.spatial import gaussian_kernel
from cubeframe.operators.stats import anova_f, gradient


def gradient_bins(spectra: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """keys, bin, first, last (half-open ranks), left, right (wavelengths), value: bins of equal cumulative |gradient|.

    spectra: keys, wavelength, value. Empty bins are skipped. A constant spectrum has no gradient and is an error.
    """
    w = Window.partitionBy(*keys).orderBy("wavelength")
    g = spectra.withColumns({"i": F.row_number().over(w) - 1, "g": F.abs(gradient(F.col("value"), F.col("wavelength"), w))})
    return _equal_bins(g, keys, "g", bins)


def equalised_bins(spectra: DataFrame, keys: list[str], bins: int = 10, method: str = "intensity") -> DataFrame:
    """Bins of equal cumulative intensity or equal count, with the mean of each; empty bins are skipped."""
    if method not in ("intensity", "count"):
        raise ValueError(method)
    w = Window.partitionBy(*keys).orderBy("wavelength")
    g = spectra.withColumns({"i": F.row_number().over(w) - 1, "g": F.col("value") if method == "intensity" else F.lit(1.0)})
    return _equal_bins(g, keys, "g", bins)


def _equal_bins(g: DataFrame, keys: list[str], weight: str, bins: int) -> DataFrame:
    """Edge j is the first rank whose cumulative weight reaches j / bins of the whole; the first is 0, the last the last rank."""
    whole = Window.partitionBy(*keys)
    up = whole.orderBy("i")
    total = F.sum(weight).over(whole)
    share = F.when(total == 0, F.raise_error(F.lit("the spectrum is constant")).cast("double")).otherwise(F.sum(weight).over(up) / total)
    c = g.withColumns({"c": F.round(share, 12), "n": F.count("*").over(whole)})
    target = c.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(bins))))
    edges = target.groupBy(*keys, "j", "n").agg(F.count_if(F.col("c") < F.round(F.col("j") / bins, 12)).alias("e"))
    place = F.when(F.col("j") == 0, F.lit(0)).when(F.col("j") == bins, F.col("n") - 1).otherwise(F.least("e", F.col("n") - 1))
    edges = edges.select(*keys, "j", place.alias("e"))
    next_ = F.lead("e").over(whole.orderBy("j"))
    spans = edges.withColumns({"bin": F.col("j"), "first": F.col("e"), "last": next_}).where(F.col("last") > F.col("first")).select(*keys, "bin", "first", "last")
    met = c.join(spans, keys).where((F.col("i") >= F.col("first")) & (F.col("i") < F.col("last")))
    return met.groupBy(*keys, "bin", "first", "last").agg(F.min("wavelength").alias("left"), F.max("wavelength").alias("right"), F.avg("value").alias("value"))


def bin_centres(edges: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(edges, edges[1:])]


def binned_stats(spectra: DataFrame, keys: list[str], edges: list[float]) -> DataFrame:
    """keys, bin, left, right, mean, std (population) per half-open wavelength bin; an empty bin has nulls."""
    span = spectra.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, left double, right double")
    bounds = F.array(*(F.lit(float(e)) for e in edges))
    place = F.size(F.filter(bounds, lambda e: e <= F.col("wavelength"))) - 1  # few edges: a literal array, no join
    placed = spectra.withColumn("bin", F.when(F.col("wavelength") < edges[-1], place).otherwise(-1))
    have = placed.where("bin >= 0").groupBy(*keys, "bin").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    every = spectra.select(*keys).distinct().join(F.broadcast(span))  # a bin list is part of the call
    return every.join(have, [*keys, "bin"], "left").select(*keys, "bin", "left", "right", "mean", "std")


class AdaptiveSpectralBinner:
    """Bins by the importance of each band: std, gradient (of the mean spectrum), supervised (F statistic) or hybrid."""

    def __init__(self, n_bins: int = 20, method: str = "std", smooth_sigma: float | None = None, hybrid_alpha: float = 0.5):
        if method not in ("std", "gradient", "supervised", "hybrid"):
            raise ValueError(method)
        self.n_bins, self.method, self.smooth_sigma, self.hybrid_alpha = n_bins, method, smooth_sigma, hybrid_alpha

    def fit(self, cells: DataFrame, wavelengths: dict[int, float], label: str | None = None) -> AdaptiveSpectralBinner:
        """cells: band, value and, for supervised bins, the label."""
        stats = {r["band"]: r for r in cells.groupBy("band").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()}
        bands = sorted(stats, key=wavelengths.__getitem__)
        at = np.array([wavelengths[b] for b in bands])
        mean, std = np.array([stats[b]["m"] for b in bands]), np.array([stats[b]["s"] for b in bands])
        if self.smooth_sigma:
            k = gaussian_kernel(self.smooth_sigma)
            mean = np.convolve(np.pad(mean, len(k) // 2, mode="symmetric"), k, "valid")
        slope = np.abs(np.gradient(mean, at))
        if self.method == "supervised":
            f = {r["band"]: r["f"] for r in anova_f(cells, label).collect()}
            weight = np.array([f[b] for b in bands])
        elif self.method == "hybrid":
            weight = self.hybrid_alpha * std / (std.sum() + 1e-12) + (1 - self.hybrid_alpha) * slope / (slope.sum() + 1e-12)
        else:
            weight = std if self.method == "std" else slope
        weight = np.clip(weight, 0, None)
        if not weight.sum() > 0:
            raise ValueError("no band carries anything")
        cut = np.searchsorted(np.cumsum(weight) / weight.sum(), np.linspace(0, 1, self.n_bins + 1))
        cut = np.clip(cut, 0, len(at) - 1)
        cut[0], cut[-1] = 0, len(at) - 1
        self.edges_, self.importance_ = at[cut].tolist(), dict(zip(bands, weight.tolist()))
        return self

    def transform(self, spectra: DataFrame, keys: list[str]) -> DataFrame:
        """keys, bin, left, right, mean: of each spectrum (keys, wavelength, value); an empty bin has null."""
        return binned_stats(spectra, keys, self.edges_).drop("std")
