"""Column functions over one spectrum (array<double>): no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def std(a: Column) -> Column:
    """Population standard deviation."""
    return _let(mean(a), lambda m: F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)), F.size(a))))


def quantile(a: Column, p: float) -> Column:
    """Linear between the two nearest values."""
    at = F.lit(p) * (F.size(a) - 1)
    low = F.floor(at).cast("int")

    def between(s: Column) -> Column:
        lo, hi = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return lo + (hi - lo) * (at - low)

    return F.when(F.size(a) > 0, _let(F.array_sort(a), between))


def _guard(scale: Column, least: float) -> Column:
    return F.when(scale == 0, F.lit(least)).otherwise(scale)


def _scaled(a: Column, centre: Column, scale: Column) -> Column:
    return F.transform(F.array(F.struct(centre.alias("c"), scale.alias("s"))), lambda k: F.transform(a, lambda v: (v - k["c"]) / k["s"]))[0]


def snv(a: Column) -> Column:
    """Standard normal variate; a flat spectrum is divided by 1e-12."""
    return _scaled(a, mean(a), _guard(std(a), 1e-12))


def robust_snv(a: Column) -> Column:
    """(v - median) / (q75 - q25); a range of 0 counts as 1e-6."""
    return _scaled(a, quantile(a, 0.5), _guard(quantile(a, 0.75) - quantile(a, 0.25), 1e-6))


def rnv(a: Column) -> Column:
    """(v - median) / MAD, without 1.4826; a MAD of 0 counts as 1e-6."""
    mad = _let(quantile(a, 0.5), lambda m: quantile(F.transform(a, lambda v: F.abs(v - m)), 0.5))
    return _scaled(a, quantile(a, 0.5), _guard(mad, 1e-6))


def absorbance(a: Column, method: str = "lambert", on_invalid: str = "raise") -> Column:
    """-log10 R or (1 - R)^2 / 2R. R outside (0, 1]: an error, or null with on_invalid='null'."""
    if method not in ("lambert", "kubelka"):
        raise ValueError(method)
    f = (lambda r: -F.log10(r)) if method == "lambert" else (lambda r: (1 - r) * (1 - r) / (2 * r))
    bad = F.lit(None).cast("double") if on_invalid == "null" else F.raise_error(F.lit("reflectance outside (0, 1]")).cast("double")
    return F.transform(a, lambda r: F.when((r > 0) & (r <= 1), f(r)).otherwise(bad))


def angle(a: Column, reference: Column) -> Column:
    """Spectral angle in degrees; null where a norm is at most 1e-6."""
    cosine = F.try_divide(dot(a, reference), norm(a) * norm(reference))
    return F.when(norm(a) > 1e-6, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def euclidean(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda p, q: p - q))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def correlation(a: Column, b: Column) -> Column:
    centred = lambda v: _let(mean(v), lambda m: F.transform(v, lambda x: x - m))
    return F.try_divide(dot(centred(a), centred(b)), norm(centred(a)) * norm(centred(b)))
