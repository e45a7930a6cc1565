"""Models over spectra: principal components, minimum noise fraction, PLS with cross-validation, CARS and soft PLS-DA.

Each is fitted from sums of squares and products that Spark adds up in one pass (functions.linalg.gram); only matrices of
bands by bands reach the driver. Applying a model is a product with a small matrix in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeframe.functions import linalg
from cubeframe.operators.preprocess import linear


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns whose entry of largest size is positive."""
    at = np.abs(vectors).argmax(0)
    return vectors * np.sign(vectors[at, range(vectors.shape[1])])


def pca_of(m: np.ndarray, n_components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, variances) from [1, X]'[1, X]."""
    mean, scatter = linalg.centred(m)
    value, vector = np.linalg.eigh(scatter / max(m[0, 0] - 1, 1))
    order = np.argsort(value)[::-1][:n_components]
    return mean, _signed(vector[:, order]), value[order]


def mnf_of(m: np.ndarray, noise: np.ndarray, n_components: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, eigenvalues) from [1, X]'[1, X] and the same of the differences; without any, all noise is 0."""
    mean, scatter = linalg.centred(m)
    spread = linalg.centred(noise)[1] / max(noise[0, 0] - 1, 1) if noise[0, 0] else np.zeros_like(scatter)
    value, vector = np.linalg.eigh(spread)
    white = vector @ np.diag(1 / np.sqrt(np.clip(value, 0, None) + 1e-12)) @ vector.T
    value, vector = np.linalg.eigh(white.T @ (scatter / max(m[0, 0] - 1, 1)) @ white)
    order = np.argsort(value)[::-1][:n_components]
    return mean, _signed(white @ vector[:, order]), value[order]


class PCA:
    """Principal components of a spectrum column, centred."""

    def __init__(self, n_components: int):
        self.n_components = n_components

    def fit(self, df: DataFrame, column: str = "spectrum") -> PCA:
        (_, m), = linalg.gram(df, [column]).values()
        self.mean_, self.components_, self.explained_variance_ = pca_of(m, self.n_components)
        return self

    def transform(self, df: DataFrame, column: str = "spectrum", out: str = "scores") -> DataFrame:
        return df.withColumn(out, linear(F.col(column), self.components_, self.mean_))


class MNF:
    """Minimum noise fraction: noise from differences of neighbours across and down, whitened, then components by signal."""

    def __init__(self, n_components: int | None = None):
        self.n_components = n_components

    @staticmethod
    def differences(pixel: DataFrame, column: str = "spectrum") -> DataFrame:
        """One row per pair of neighbours: the difference of their spectra."""
        parts = []
        for keys, along in ((["scene", "y"], "x"), (["scene", "x"], "y")):
            w = Window.partitionBy(*keys).orderBy(along)
            nxt = F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(column).over(w))
            parts.append(pixel.select(F.zip_with(nxt, column, lambda a, b: a - b).alias("d")).where("d IS NOT NULL"))
        return parts[0].unionByName(parts[1])

    def fit(self, pixel: DataFrame, column: str = "spectrum") -> MNF:
        (_, noise), = linalg.gram(self.differences(pixel, column), ["d"]).values()
        (_, data), = linalg.gram(pixel, [column]).values()
        self.mean_, self.components_, self.eigenvalues_ = mnf_of(data, noise, self.n_components)
        return self

    def transform(self, pixel: DataFrame, column: str = "spectrum", out: str = "mnf") -> DataFrame:
        return pixel.withColumn(out, linear(F.col(column), self.components_, self.mean_))


#: Groups of samples, by a hash, of which every round of CARS draws a share.
BUCKETS = 100


def _pls_fit(m: np.ndarray, bands: np.ndarray, components: int) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of PLS on columns scaled to unit deviation, from [1, X, y]'[1, X, y]."""
    pick = np.r_[0, 1 + bands, len(m) - 1]
    mean, s = linalg.centred(m[np.ix_(pick, pick)])
    n, k = m[0, 0], len(bands)
    scale = np.sqrt(np.diag(s) / max(n - 1, 1))
    scale[scale == 0] = 1
    s = s / np.outer(scale, scale)
    coef, _ = linalg.pls(s[:k, :k], s[:k, k:], min(components, k))
    coef = coef[:, 0] / scale[:k] * scale[k]
    return coef, mean[k] - mean[:k] @ coef


def _rmse(m: np.ndarray, bands: np.ndarray, coef: np.ndarray, intercept: float) -> float:
    """Root mean squared error on the rows of a Gram matrix."""
    w = np.zeros(len(m))
    w[0], w[1 + bands], w[-1] = -intercept, -coef, 1
    return float(np.sqrt(max(w @ m @ w, 0) / m[0, 0]))


def _folds(df: DataFrame, sample_id: str, folds: int, seed: int) -> DataFrame:
    return df.withColumn("_fold", F.pmod(F.xxhash64(sample_id, F.lit(seed)), F.lit(folds)))


def rmse_cv(df: DataFrame, target: str, column: str = "spectrum", sample_id: str = "sample_id", n_components: int = 10, n_splits: int = 5, seed: int = 42) -> float:
    """Mean over folds of the held-out RMSE of PLS. A sample's fold is a hash of its id, so it never moves."""
    rows = _folds(df.withColumn("_y", F.array(F.col(target).cast("double"))), sample_id, n_splits, seed)
    grams = [m for _, m in linalg.gram(rows, [column, "_y"], ["_fold"]).values()]
    return _cv(grams, np.arange(len(grams[0]) - 2), n_components)


def _cv(grams: list[np.ndarray], bands: np.ndarray, components: int) -> float:
    whole = sum(grams)
    return float(np.mean([_rmse(g, bands, *_pls_fit(whole - g, bands, components)) for g in grams]))


def cars(df: DataFrame, target: str, column: str = "spectrum", sample_id: str = "sample_id", n_components: int = 10, n_mc: int = 50, sample_ratio: float = 0.9, cv_splits: int = 5, seed: int = 42) -> tuple[list[int], float, list[tuple[int, int, float]]]:
    """Competitive adaptive reweighted sampling: (bands of the best round, its RMSECV, all rounds as (round, bands, RMSECV)).

    Every round fits PLS on a random share of BUCKETS groups of samples, keeps the bands of largest coefficients, fewer each round, and
    is judged by cross-validation on all. All folds' and all rounds' sums come from one pass over the data each; the
    rounds themselves are algebra on band by band matrices.
    """
    rows = df.withColumn("_y", F.array(F.col(target).cast("double")))
    folds = [m for _, m in linalg.gram(_folds(rows, sample_id, cv_splits, seed), [column, "_y"], ["_fold"]).values()]
    # a round takes buckets of samples, so that its sums are those of its buckets: no sample is copied
    buckets = linalg.gram(rows.withColumn("_bucket", F.pmod(F.xxhash64(sample_id, F.lit(seed + 1)), F.lit(BUCKETS))), [column, "_y"], ["_bucket"])
    drawn = np.random.default_rng(seed).random((n_mc, BUCKETS)) < sample_ratio
    subset = [sum(m for (b,), (_, m) in buckets.items() if drawn[i, int(b)]) for i in range(n_mc)]
    bands = np.arange(len(folds[0]) - 2)
    decay = np.log(max(len(bands) / (n_components + 1), 1)) / max(n_mc, 1)
    history, best = [], None
    for i in range(n_mc):
        coef, _ = _pls_fit(subset[i], bands, min(n_components, len(bands) - 1))
        keep = min(len(bands), max(int(len(bands) * np.exp(-decay * i)), n_components + 1))
        bands = np.sort(bands[np.lexsort((bands, -np.abs(coef)))[:keep]])
        error = _cv(folds, bands, min(n_components, max(len(bands) - 1, 1)))
        history.append((i, len(bands), error))
        if best is None or error < best[1]:
            best = (bands.tolist(), error)
    return best[0], best[1], history


class SoftPLSDA:
    """Class modelling by PLS on class membership: a spectrum belongs to every class whose ellipse it lies in, or to none."""

    def __init__(self, n_components: int = 2, alpha: float = 0.05, gamma: float = 0.05):
        self.n_components, self.alpha, self.gamma = n_components, alpha, gamma

    def fit(self, df: DataFrame, label: str = "label", column: str = "spectrum") -> SoftPLSDA:
        self.classes_ = sorted(r[0] for r in df.select(label).distinct().collect())
        hot = F.array(*(F.when(F.col(label) == F.lit(c), 1.0).otherwise(0.0) for c in self.classes_))
        per = linalg.gram(df.withColumn("_hot", hot), [column, "_hot"], [label])
        k = len(self.classes_)
        m = sum(g for _, g in per.values())
        n, b = m[0, 0], len(m) - 1 - k
        mean, s = linalg.centred(m)
        scale = np.sqrt(np.diag(s)[:b] / n)
        scale[scale == 0] = 1
        coef, _ = linalg.pls(s[:b, :b] / np.outer(scale, scale), s[:b, b:] / scale[:, None], self.n_components)
        # the predicted memberships are centred; their first k - 1 components are the model's plane
        spread = coef.T @ (s[:b, :b] / np.outer(scale, scale)) @ coef
        value, vector = np.linalg.eigh(spread)
        plane = _signed(vector[:, np.argsort(value)[::-1][: k - 1]])
        self.mean_, self.map_ = mean[:b], (coef / scale[:, None]) @ plane
        self.centres_ = (np.eye(k) - mean[b:]) @ plane
        self.inverse_, self.size_ = [], []
        for i, c in enumerate(self.classes_):
            nc, g = per[(str(c),)]
            own_mean, own = linalg.centred(g)
            away = (own_mean[:b] - self.mean_) @ self.map_ - self.centres_[i]
            scatter = self.map_.T @ own[:b, :b] @ self.map_ / nc + np.outer(away, away)
            self.inverse_.append(np.linalg.pinv(scatter + 1e-6 * np.eye(k - 1)))
            self.size_.append(nc)
        self.critical_ = linalg.chi2_quantile(1 - self.alpha, k - 1)
        self.outlier_ = [linalg.chi2_quantile((1 - self.gamma) ** (1 / nc), k - 1) for nc in self.size_]
        return self

    def distances(self, column: str = "spectrum"):
        """Column: squared distance to every class."""
        mean, to, centres, inverse = self.mean_, self.map_, self.centres_, np.stack(self.inverse_)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def run(values: pd.Series) -> pd.Series:
            x = np.stack(values.to_numpy()) if len(values) else np.zeros((0, len(mean)))
            d = ((x - mean) @ to)[:, None, :] - centres[None]
            return pd.Series(list(np.einsum("nkf,kfg,nkg->nk", d, inverse, d)))

        return run(F.col(column))

    def predict(self, df: DataFrame, column: str = "spectrum") -> DataFrame:
        """df with classes (array): all within the critical distance, or NOT_ASSIGNED."""
        names = F.array(*(F.lit(str(c)) for c in self.classes_))
        hit = F.transform(F.filter(F.arrays_zip(names.alias("c"), F.col("_d").alias("d")), lambda z: z["d"] < self.critical_), lambda z: z["c"])
        return df.withColumn("_d", self.distances(column)).withColumn("classes", F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit("NOT_ASSIGNED")))).drop("_d")

    def outliers(self, df: DataFrame, label: str = "label", column: str = "spectrum") -> DataFrame:
        """df with outlier: farther from its own class than the training size makes likely."""
        limit = F.element_at(F.create_map(*(x for c, o in zip(self.classes_, self.outlier_) for x in (F.lit(str(c)), F.lit(float(o))))), F.col(label).cast("string"))
        own = F.get("_d", F.array_position(F.array(*(F.lit(str(c)) for c in self.classes_)), F.col(label).cast("string")).cast("int") - 1)
        return df.withColumn("_d", self.distances(column)).withColumn("outlier", own > limit).drop("_d")
