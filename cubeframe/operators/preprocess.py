"""Spectral preprocessing as pyspark.ml-style estimators over a frame with a spectrum column (array<double>).

SNV, RNV and robust SNV are plain column functions (functions.spectra); those here learn something, or need a matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeframe.functions import linalg
from cubeframe.functions import spectra as S


def linear(column, matrix: np.ndarray, centre: np.ndarray | None = None):
    """Column function: (spectrum - centre) times a matrix, in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(values: pd.Series) -> pd.Series:
        x = np.stack(values.to_numpy()) if len(values) else np.zeros((0, matrix.shape[0]))
        return pd.Series(list((x if centre is None else x - centre) @ matrix))

    return run(column)


class SNV:
    """(v - mean) / std per spectrum."""

    def fit(self, df: DataFrame) -> SNV:
        return self

    def transform(self, df: DataFrame, column: str = "spectrum") -> DataFrame:
        return df.withColumn(column, S.snv(F.col(column)))


class MSC:
    """Scatter correction of row-centred spectra against a reference; the additive offset is not restored."""

    def __init__(self, reference: list[float] | None = None):
        self.reference = reference

    def fit(self, df: DataFrame, column: str = "spectrum") -> MSC:
        if self.reference is None:
            long = df.select(F.posexplode(F.transform(F.array(S.mean(F.col(column))), lambda m: F.transform(column, lambda v: v - m))[0]).alias("i", "v"))
            self.reference_ = [r["m"] for r in long.groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]  # one number per band
        else:
            size = df.select(F.size(column)).first()
            if size and size[0] != len(self.reference):
                raise ValueError("the reference has another length")
            self.reference_ = list(self.reference)
        return self

    def transform(self, df: DataFrame, column: str = "spectrum") -> DataFrame:
        r = np.array(self.reference_)
        rc, rm = r - r.mean(), float(r.mean())
        ref = F.array(*(F.lit(float(v)) for v in rc))

        def corrected(k):
            slope = F.when(k["s"] == 0, F.lit(1e-12)).otherwise(k["s"])
            return F.transform(column, lambda v: (v - k["m"] + slope * F.lit(rm)) / slope)

        mean = S.mean(F.col(column))
        centred = F.transform(F.array(mean), lambda m: F.transform(column, lambda v: v - m))[0]
        slope = S.dot(centred, ref) / F.lit(float(rc @ rc))
        return df.withColumn(column, F.transform(F.array(F.struct(mean.alias("m"), slope.alias("s"))), corrected)[0])


class SavitzkyGolay:
    """Polynomial smoothing or derivative along the bands: one matrix, learnt from the number of bands."""

    def __init__(self, window_length: int = 11, polyorder: int = 2, deriv: int = 0):
        if window_length % 2 == 0 or window_length <= polyorder:
            raise ValueError("the window is odd and above the order")
        self.window_length, self.polyorder, self.deriv = window_length, polyorder, deriv

    def fit(self, df: DataFrame, column: str = "spectrum") -> SavitzkyGolay:
        n = df.select(F.max(F.size(column))).first()[0]
        self.matrix_ = linalg.savgol_matrix(n, self.window_length, self.polyorder, self.deriv)
        return self

    def transform(self, df: DataFrame, column: str = "spectrum") -> DataFrame:
        return df.withColumn(column, linear(F.col(column), self.matrix_.T))


def asls(y: np.ndarray, lam: float, p: float, iterations: int) -> np.ndarray:
    """Asymmetric least squares baseline of each row (Eilers and Boelens 2005); all rows are solved at once, band by band."""
    n, bands = y.shape
    d = np.diff(np.eye(bands), 2, axis=0)
    penalty = lam * d.T @ d
    w = np.ones_like(y)
    for _ in range(iterations):
        z = np.linalg.solve(penalty[None] + w[:, :, None] * np.eye(bands)[None], (w * y)[:, :, None])[:, :, 0]
        w = np.where(y > z, p, np.where(y < z, 1 - p, 0.0))
    return z


def asls_baseline(df: DataFrame, column: str = "spectrum", lam: float = 1e6, p: float = 0.001, iterations: int = 10) -> DataFrame:
    """df with baseline, the asymmetric least squares baseline of its spectrum; weight 0 where both meet."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            out = []
            for i in range(0, len(values), 256):
                out += list(asls(np.stack(values.iloc[i : i + 256].to_numpy()), lam, p, iterations))
            yield pd.Series(out, dtype=object)

    return df.withColumn("baseline", run(F.col(column)))
