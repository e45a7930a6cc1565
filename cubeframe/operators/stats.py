"""Statistics per band, class and image plane. Every one is a grouped aggregate with map-side partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeframe.frame import extent

BINS = 256


def block_average(cells: DataFrame, block: int = 5) -> DataFrame:
    """Mean over blocks of lines and samples; what exceeds a multiple of the block is cropped."""
    size = extent(cells)
    inside = (F.col("y") < F.col("height") - F.col("height") % block) & (F.col("x") < F.col("width") - F.col("width") % block)
    by = [F.floor(F.col(c) / block).cast("int").alias(c) for c in ("y", "x")]
    return cells.join(size, "scene").where(inside).groupBy("scene", *by, "band").agg(F.avg("value").alias("value"))


def band_stats(cells: DataFrame) -> DataFrame:
    """scene, band, n, mean, std (population), min, max."""
    v = F.col("value")
    return cells.groupBy("scene", "band").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def snr(cells: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Per band mean / (std + 1e-8), over the pixels of the mask (scene, y, x) if one is given."""
    used = cells if mask is None else cells.join(mask, ["scene", "y", "x"], "left_semi")
    return band_stats(used).select("scene", "band", (F.col("mean") / (F.col("std") + 1e-8)).alias("snr"))


def class_variance_ratio(cells: DataFrame, label: str = "label") -> DataFrame:
    """One row: within, between and their ratio: traces of the scatter matrices, from counts and variances per class and band."""
    per = cells.groupBy(label, "band").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    whole = per.groupBy("band").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all"))
    sums = per.join(whole, "band").agg(F.sum(F.col("n") * F.col("var")).alias("within"), F.sum(F.col("n") * F.pow(F.col("mean") - F.col("all"), 2)).alias("between"))
    return sums.select("within", "between", F.try_divide("between", "within").alias("ratio"))


def min_max(cells: DataFrame) -> DataFrame:
    """(v - min) / (max - min + 1e-8) per scene and band, by a join with the aggregated limits: no scene is sorted as a whole."""
    limits = cells.groupBy("scene", "band").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    scaled = (F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1e-8)
    return cells.join(limits, ["scene", "band"]).withColumn("value", scaled).select(*cells.columns)


def mean_std(cells: DataFrame) -> DataFrame:
    """(v - mean) / (std + 1e-8) per scene and band, by a join with the aggregated parameters."""
    params = band_stats(cells).select("scene", "band", "mean", (F.col("std") + 1e-8).alias("std"))
    return cells.join(params, ["scene", "band"]).select("scene", "y", "x", "band", ((F.col("value") - F.col("mean")) / F.col("std")).alias("value"))


def histogram(values: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """keys, low, high, bin, n: occupied bins of equal width between the group's limits; the maximum is in the last bin."""
    limits = values.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    width = F.col("high") - F.col("low")
    place = F.coalesce(F.least(F.floor(F.try_divide(F.col(value) - F.col("low"), width) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    return values.where(F.col(value).isNotNull()).join(limits, keys).groupBy(*keys, "low", "high", place.alias("bin")).agg(F.count("*").alias("n"))


def otsu(values: DataFrame, keys: list[str], value: str = "v", bins: int = BINS) -> DataFrame:
    """keys, threshold, separation: Otsu's threshold is the centre of the first bin with the best split.

    Sums are kept in whole bins, so that they are exact in any order; separation is w1 * w2 * (m1 - m2)^2 in the units of the
    values. A constant group has its value and 0.
    """
    w = Window.partitionBy(*keys)
    up = w.orderBy("bin")
    h = histogram(values, keys, value, bins).withColumns({"w1": F.sum("n").over(up), "s1": F.sum(F.col("n") * F.col("bin")).over(up), "w": F.sum("n").over(w), "s": F.sum(F.col("n") * F.col("bin")).over(w)})
    apart = F.try_divide("s1", "w1") - F.try_divide(F.col("s") - F.col("s1"), F.col("w") - F.col("w1"))
    between = F.coalesce(F.col("w1") * (F.col("w") - F.col("w1")) * apart * apart, F.lit(0.0))
    step = (F.col("high") - F.col("low")) / bins
    h = h.withColumn("between", F.round(between, 3))
    best = h.groupBy(*keys, "low", "high").agg(F.max(F.struct("between", (-F.col("bin")).alias("b"))).alias("m"))
    centre = F.when(F.col("high") > F.col("low"), F.col("low") + (0.5 - F.col("m.b")) * step).otherwise(F.col("low"))
    return best.select(*keys, centre.alias("threshold"), (F.col("m.between") * step * step).alias("separation"))


#: Bins by which a group is narrowed down to the values about a quantile.
_NARROW = 1024


def quantile(values: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """keys, quantile: linear between the two observed values about rank q * (n - 1), exactly.

    Counts per bin say in which bins of a group the two ranks lie; only the distinct values of these are put in order, so
    that no task sorts or holds a whole group.
    """
    v = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    limits = v.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    place = F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low")) * _NARROW), F.lit(0))
    counted = v.groupBy(*keys, "_v").agg(F.count("*").alias("_n")).join(limits, keys).select(*keys, "_v", "_n", place.alias("_bin"))
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_in"))
    of = Window.partitionBy(*keys)
    bins = bins.withColumns({"_before": F.sum("_in").over(of.orderBy("_bin")) - F.col("_in"), "_rank": F.lit(q) * (F.sum("_in").over(of) - 1)})
    low, high = F.floor("_rank"), F.ceil("_rank")
    holds = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in"))
    few = counted.join(bins.where(holds(low) | holds(high)), [*keys, "_bin"])
    few = few.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v")))
    at = lambda r: F.min(F.when((F.col("_upto") > r) & (F.col("_upto") - F.col("_n") <= r), F.col("_v")))
    two = few.groupBy(*keys).agg(at(low).alias("_a"), at(high).alias("_b"), (F.first("_rank") - F.floor(F.first("_rank"))).alias("_f"))
    return two.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("quantile"))


def entropy(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Base-2 entropy of the distinct values."""
    n = values.groupBy(*keys, value).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return n.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def anova_f(cells: DataFrame, label: str = "label") -> DataFrame:
    """band, f: F statistic between classes; 0/0 counts as 0."""
    per = cells.groupBy("band", label).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    w = Window.partitionBy("band")
    per = per.withColumn("all", F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w))
    sums = per.groupBy("band").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("all"), 2)).alias("ssb"), F.sum(F.col("n") * F.col("var")).alias("ssw"), F.sum("n").alias("n"), F.count("*").alias("k")
    )
    f = F.try_divide(F.try_divide("ssb", F.col("k") - 1), F.try_divide("ssw", F.col("n") - F.col("k")))
    return sums.select("band", F.coalesce(f, F.when(F.col("ssb") > 0, F.lit(1.7976931348623157e308)).otherwise(F.lit(0.0))).alias("f"))


def gradient(values: Column, at: Column, w) -> Column:
    """Second-order gradient on uneven steps along an ordered window; one-sided at the ends."""
    before, after = F.lag(values).over(w), F.lead(values).over(w)
    hs, hd = at - F.lag(at).over(w), F.lead(at).over(w) - at
    middle = (hs * hs * after + (hd * hd - hs * hs) * values - hd * hd * before) / (hs * hd * (hd + hs))
    return F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), (after - values) / hd).when(after.isNull(), (values - before) / hs).otherwise(middle)
