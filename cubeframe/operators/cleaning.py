"""Defective readings of a line scanner: detection per cell, per column and per profile, and repair from neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeframe.operators.stats import band_stats

_MAD = 1.4826


def infinite(value: str = "value") -> Column:
    return F.abs(F.col(value)) == float("inf")


def bad_cells(cells: DataFrame, lower: float = 0.1, upper: float | None = None, z: float = 3.0) -> DataFrame:
    """Cells with good: not below lower, not above upper (none: the maximum, so nothing), |z| within its band at most z.

    Infinite readings are never good and have no part in the mean and deviation of their band.
    """
    stats = band_stats(cells.where(~infinite())).select("scene", "band", "mean", "std")
    dead = infinite() | (F.col("value") < lower)
    if upper is not None:
        dead = dead | (F.col("value") > upper)
    outlier = F.coalesce(F.abs(F.col("value") - F.col("mean")) / (F.col("std") + 1e-8) > z, F.lit(False))
    return cells.join(stats, ["scene", "band"], "left").select(*cells.columns, (~(dead | outlier)).alias("good"))


def _robust_z(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with z: distance from the group's median in robust deviations."""
    med = df.groupBy(*keys).agg(F.median(value).alias("_med"))
    away = df.join(med, keys).withColumn("_away", F.abs(F.col(value) - F.col("_med")))
    mad = away.groupBy(*keys).agg(F.median("_away").alias("_mad"))
    return away.join(mad, keys).withColumn("z", F.col("_away") / (F.lit(_MAD) * F.col("_mad") + 1e-9)).drop("_med", "_away", "_mad")


def line_defects(cells: DataFrame, z: float = 5.0, fraction: float = 0.9) -> DataFrame:
    """scene, band, x of columns whose median stands out in its band and whose readings stand out in most lines."""
    column = cells.groupBy("scene", "band", "x").agg(F.median("value").alias("m"))
    candidates = _robust_z(column, ["scene", "band"], "m").where(F.col("z") > z).select("scene", "band", "x")
    bands = candidates.select("scene", "band").distinct()
    rows = _robust_z(cells.join(bands, ["scene", "band"], "left_semi"), ["scene", "band", "y"], "value")
    share = rows.join(candidates, ["scene", "band", "x"], "left_semi").groupBy("scene", "band", "x").agg(F.avg((F.col("z") > z).cast("double")).alias("share"))
    return share.where(F.col("share") >= fraction).select("scene", "band", "x")


def mirrored(i: Column, n: Column) -> Column:
    """Index beyond the ends, reflected with the edge sample repeated, as often as needed."""
    k = F.pmod(i, 2 * n)
    return F.when(k < n, k).otherwise(2 * n - 1 - k)


def dead_columns(cells: DataFrame, threshold: float = 30.0, kernel: tuple[int, int] = (3, 5)) -> DataFrame:
    """scene, band, x, residual, dead: mean profile per column and band against its median-filtered neighbourhood.

    The profile leaves infinite readings out; a column with no other is dead and has no residual.
    """
    profile = cells.groupBy("scene", "band", "x").agg(F.avg(F.when(~infinite(), F.col("value"))).alias("p"))
    size = profile.groupBy("scene").agg((F.max("band") + 1).alias("nb"), (F.max("x") + 1).alias("nx"))
    hb, hx = kernel[0] // 2, kernel[1] // 2
    near = F.explode(F.array(*(F.struct(F.lit(b).alias("db"), F.lit(x).alias("dx")) for b in range(-hb, hb + 1) for x in range(-hx, hx + 1))))
    asked = profile.join(size, "scene").select("scene", "band", "x", "p", near.alias("o"), "nb", "nx")
    asked = asked.select("scene", "band", "x", "p", mirrored(F.col("band") + F.col("o.db"), F.col("nb")).alias("b2"), mirrored(F.col("x") + F.col("o.dx"), F.col("nx")).alias("x2"))
    there = profile.select("scene", F.col("band").alias("b2"), F.col("x").alias("x2"), F.col("p").alias("q"))
    smooth = asked.join(there, ["scene", "b2", "x2"]).groupBy("scene", "band", "x", "p").agg(F.median("q").alias("m"))
    resid = smooth.select("scene", "band", "x", (F.col("p") - F.col("m")).alias("residual"))
    spread = resid.groupBy("scene").agg(F.stddev_pop("residual").alias("s"))
    return resid.join(spread, "scene").select("scene", "band", "x", "residual", F.coalesce(F.abs("residual") > threshold * (F.col("s") + 1e-8), F.col("residual").isNull()).alias("dead"))


def repair(cells: DataFrame, bad: str = "bad", method: str = "spectral") -> DataFrame:
    """cells with value repaired and repaired: bad cells become the mean of their good neighbours one step away.

    spectral: along the band; spatial: along the sample; hybrid: spatial where spectral finds none. Neighbours are those of
    the original cube; a cell without any keeps its value.
    """
    if method not in ("spectral", "spatial", "hybrid"):
        raise ValueError(method)
    good = F.when(~F.col(bad), F.col("value"))

    def around(keys: list[str], along: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(along)
        sides = [F.when(F.abs(f(along).over(w) - F.col(along)) == 1, f(good).over(w)) for f in (F.lag, F.lead)]
        return F.coalesce((sides[0] + sides[1]) / 2, *sides)

    found = {"spectral": (["scene", "y", "x"], "band"), "spatial": (["scene", "y", "band"], "x")}
    used = ["spectral", "spatial"] if method == "hybrid" else [method]
    for m in used:
        cells = cells.withColumn(f"_{m}", around(*found[m]))
    fix = F.coalesce(*(F.col(f"_{m}") for m in used))
    done = F.col(bad) & fix.isNotNull()
    return cells.withColumns({"repaired": done, "value": F.when(done, fix).otherwise(F.col("value"))}).drop(*(f"_{m}" for m in used))


class DeadPixelProcessor:
    """Detection of dead columns and repair in one call; infinite readings are repaired too."""

    def __init__(self, threshold: float = 30.0, kernel: tuple[int, int] = (3, 5), method: str = "spectral"):
        self.threshold, self.kernel, self.method = threshold, kernel, method

    def identify(self, cells: DataFrame) -> DataFrame:
        return dead_columns(cells, self.threshold, self.kernel).where("dead").select("scene", "band", "x")

    def clean(self, cells: DataFrame) -> DataFrame:
        dead = self.identify(cells).withColumn("bad", F.lit(True))
        marked = cells.join(dead, ["scene", "band", "x"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)) | infinite())
        return repair(marked, "bad", self.method)


def defect_overlay(cells: DataFrame, bad: DataFrame, band: int) -> DataFrame:
    """scene, y, x, value, defect: the readings of one band, and which of them are defective. bad: scene, y, x, band."""
    marked = bad.where(F.col("band") == band).select("scene", "y", "x").distinct().withColumn("defect", F.lit(True))
    one = cells.where(F.col("band") == band).select("scene", "y", "x", "value")
    return one.join(marked, ["scene", "y", "x"], "left").withColumn("defect", F.coalesce("defect", F.lit(False)))


def first_defects(defects: DataFrame, n: int = 40) -> DataFrame:
    """scene, rank, x, band: the first n defective columns of every scene, by sample and band. defects: scene, band, x."""
    order = F.row_number().over(Window.partitionBy("scene").orderBy("x", "band"))
    return defects.withColumn("rank", order).where(F.col("rank") <= n).select("scene", "rank", "x", "band")


def defect_image(bad: DataFrame) -> DataFrame:
    """scene, y, x, bands: defective bands per pixel. bad: scene, y, x, band."""
    return bad.groupBy("scene", "y", "x").agg(F.count("*").alias("bands"))


