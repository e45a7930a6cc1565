import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeframe.functions import linalg
from cubeframe.functions import spectra as S
from cubeframe.operators import binning, models, preprocess


def nipals(x, y, components):
    """PLS1/PLS2 by NIPALS on centred data."""
    x, y = x - x.mean(0), y - y.mean(0)
    ws, ps, qs = [], [], []
    for _ in range(components):
        u = y[:, [0]]
        for _ in range(2000):
            w = x.T @ u
            w /= np.linalg.norm(w)
            t = x @ w
            q = y.T @ t / (t.T @ t)
            new = y @ q / (q.T @ q)
            if np.linalg.norm(new - u) < 1e-13 * np.linalg.norm(new):
                break
            u = new
        p = x.T @ t / (t.T @ t)
        x, y = x - t @ p.T, y - t @ q.T
        ws.append(w), ps.append(p), qs.append(q)
    w, p, q = np.hstack(ws), np.hstack(ps), np.hstack(qs)
    return w @ np.linalg.inv(p.T @ w) @ q.T


def spectra(spark, x, **columns):
    rows = [(i, r.tolist(), *(c[i] for c in columns.values())) for i, r in enumerate(x)]
    kinds = {"label": "string", "target": "double", "y": "int", "xx": "int"}
    return spark.createDataFrame(rows, "sample_id bigint, spectrum array<double>" + "".join(f", {c} {kinds[c]}" for c in columns))


@pytest.mark.parametrize("targets", [1, 3])
def test_kernel_pls_equals_nipals(targets):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 12)) @ rng.normal(size=(12, 12))
    y = x[:, :targets] * 2 + rng.normal(size=(60, targets))
    xc, yc = x - x.mean(0), y - y.mean(0)
    assert np.allclose(linalg.pls(xc.T @ xc, xc.T @ yc, 4)[0], nipals(x, y, 4), atol=1e-8)


def test_gram_over_partitions(spark):
    x = np.random.default_rng(2).normal(size=(50, 5))
    df = spectra(spark, x, y=[i % 2 for i in range(50)]).repartition(7)
    (n, m), = linalg.gram(df, ["spectrum"]).values()
    z = np.hstack([np.ones((50, 1)), x])
    assert n == 50 and np.allclose(m, z.T @ z)
    per = linalg.gram(df, ["spectrum"], ["y"])
    assert np.allclose(sum(g for _, g in per.values()), m) and set(per) == {("0",), ("1",)}


def test_cross_validation_and_cars_find_the_bands(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 20))
    y = 3 * x[:, 4] - 2 * x[:, 11] + 0.01 * rng.normal(size=200)
    df = spectra(spark, x, target=[float(v) for v in y])
    assert models.rmse_cv(df, "target", n_components=5) < 0.3
    bands, error, history = models.cars(df, "target", n_components=2, n_mc=15)
    assert {4, 11} <= set(bands) and len(bands) < 10 and error < 0.2 and len(history) == 15
    assert [n for _, n, _ in history] == sorted((n for _, n, _ in history), reverse=True)


def test_pca_and_mnf(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) @ np.diag([5, 2, 1, 0.1]) @ np.linalg.qr(rng.normal(size=(4, 4)))[0] + 3
    df = spectra(spark, x)
    pca = models.PCA(2).fit(df)
    assert np.allclose(pca.explained_variance_, np.linalg.eigvalsh(np.cov(x.T))[::-1][:2])
    scores = np.array([r.scores for r in pca.transform(df).collect()])
    assert np.allclose(scores.mean(0), 0, atol=1e-9)
    image = rng.normal(size=(12, 10, 4)) * 0.1 + np.cumsum(rng.normal(size=(12, 10, 4)), 0)
    pix = spark.createDataFrame([("a", y, q, image[y, q].tolist()) for y in range(12) for q in range(10)], "scene string, y int, x int, spectrum array<double>")
    mnf = models.MNF().fit(pix)
    noise = np.vstack([np.diff(image, axis=0).reshape(-1, 4), np.diff(image, axis=1).reshape(-1, 4)])
    assert np.allclose(mnf.components_.T @ np.cov(noise.T) @ mnf.components_, np.eye(4), atol=1e-6)
    out = np.array([r.mnf for r in mnf.transform(pix).collect()])
    assert np.allclose(np.cov(out.T), np.diag(mnf.eigenvalues_), atol=1e-6)


def test_soft_plsda(spark):
    rng = np.random.default_rng(5)
    centre = {"a": [0, 0, 0, 0], "b": [4, 0, 1, 0], "c": [0, 4, 0, 1]}
    label = [k for k in centre for _ in range(60)]
    x = np.array([centre[k] for k in label]) + rng.normal(size=(180, 4)) * 0.3
    df = spectra(spark, x, label=label)
    model = models.SoftPLSDA(3).fit(df)
    out = model.predict(df).collect()
    assert np.mean([r.label in r.classes for r in out]) > 0.9
    far = model.predict(spectra(spark, np.array([[40.0, -40.0, 9, 9]]), label=["a"])).first()
    assert far.classes == ["NOT_ASSIGNED"]
    assert model.outliers(df).where("outlier").count() < 10


def test_chi2():
    assert abs(linalg.chi2_quantile(0.95, 1) - 3.841458820694124) < 1e-9
    assert abs(linalg.chi2_quantile(0.95, 9) - 16.918977604620448) < 1e-9


def test_savitzky_golay(spark):
    x = np.random.default_rng(6).normal(size=(3, 30))
    for deriv in (0, 1):
        m = linalg.savgol_matrix(30, 7, 2, deriv)
        poly = np.polynomial.Polynomial([1.0, -2.0, 0.5])
        at = np.arange(30.0)
        assert np.allclose(m @ poly(at), poly.deriv(deriv)(at) if deriv else poly(at))
    out = preprocess.SavitzkyGolay(7, 2).fit(spectra(spark, x)).transform(spectra(spark, x)).orderBy("sample_id").collect()
    at = np.arange(-3, 4)
    assert abs(out[0].spectrum[10] - np.polyval(np.polyfit(at, x[0, 7:14], 2), 0)) < 1e-9
    with pytest.raises(ValueError):
        preprocess.SavitzkyGolay(4, 2)


def test_asls_baseline(spark):
    t = np.linspace(0, 1, 40)
    y = 1 + t + 5 * np.exp(-(((t - 0.5) / 0.03) ** 2))
    got = np.array(preprocess.asls_baseline(spectra(spark, y[None]), lam=1e3, p=0.01).first().baseline)
    d = np.diff(np.eye(40), 2, axis=0)
    w = np.ones(40)
    for _ in range(10):
        z = np.linalg.solve(np.diag(w) + 1e3 * d.T @ d, w * y)
        w = np.where(y > z, 0.01, np.where(y < z, 0.99, 0.0))
    assert np.allclose(got, z) and abs(got[20] - 1.5) < 0.5


def test_msc_snv_and_friends(spark):
    x = np.random.default_rng(7).random((20, 9)) + 0.1
    df = spectra(spark, x)
    snv = np.array(preprocess.SNV().fit(df).transform(df).orderBy("sample_id").first().spectrum)
    assert abs(snv.mean()) < 1e-12 and abs(snv.std() - 1) < 1e-12
    xc = x - x.mean(1, keepdims=True)
    r = xc.mean(0)
    rc = r - r.mean()
    slope = xc @ rc / (rc @ rc)
    want = (xc - (xc.mean(1) - slope * r.mean())[:, None]) / slope[:, None]
    got = np.array([q.spectrum for q in preprocess.MSC().fit(df).transform(df).orderBy("sample_id").collect()])
    assert np.allclose(got, want, atol=1e-6)
    one = df.select(S.quantile(F.col("spectrum"), 0.3).alias("q"), S.robust_snv(F.col("spectrum")).alias("r"), S.correlation(F.col("spectrum"), F.col("spectrum")).alias("c"), S.cosine_distance(F.col("spectrum"), F.col("spectrum")).alias("d"), S.euclidean(F.col("spectrum"), F.col("spectrum")).alias("e"), "sample_id").orderBy("sample_id").first()
    assert abs(one.q - np.quantile(x[0], 0.3)) < 1e-12 and abs(one.c - 1) < 1e-12 and abs(one.d) < 1e-12 and one.e == 0
    assert np.allclose(one.r, (x[0] - np.median(x[0])) / (np.quantile(x[0], 0.75) - np.quantile(x[0], 0.25)))
    with pytest.raises(Exception, match="reflectance"):
        spectra(spark, np.array([[0.5, 1.5]])).select(S.absorbance(F.col("spectrum"))).collect()


def test_binner(spark):
    rng = np.random.default_rng(8)
    rows = [(i, b, float(rng.normal(0, 1 if b == 3 else 0.01)), "u" if i % 2 else "v") for i in range(80) for b in range(8)]
    long = spark.createDataFrame(rows, "sample_id int, band int, value double, label string")
    at = {b: 100.0 * b for b in range(8)}
    binner = binning.AdaptiveSpectralBinner(4, "std").fit(long, at)
    assert binner.edges_[0] == 0 and binner.edges_[-1] == 700 and binner.edges_ == sorted(binner.edges_) and 300.0 in binner.edges_
    out = binner.transform(long.select("sample_id", (F.col("band") * 100.0).cast("double").alias("wavelength"), "value"), ["sample_id"])
    assert out.count() == 80 * 4
    assert binning.bin_centres([1, 3, 7]) == [2, 5]
    with pytest.raises(ValueError):
        binning.AdaptiveSpectralBinner(4, "std").fit(long.withColumn("value", F.lit(1.0)), at)


def test_gram_refuses_ragged_arrays(spark):
    import pytest

    from cubeframe.functions import linalg

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0])], "k int, v array<double>")
    for rows in (df, df.where("k = 1").union(spark.createDataFrame([(9, None)], df.schema)).coalesce(1)):
        with pytest.raises(Exception, match="one length"):
            linalg.gram(rows.coalesce(1), ["v"])
    good = linalg.gram(df.where("k = 1").union(df.where("k = 1")).repartition(3), ["v"], ["k"])
    assert good[("1",)][0] == 2 and good[("1",)][1].tolist() == [[2, 2, 4], [2, 2, 4], [4, 4, 8]]
    assert linalg.gram(df.where("false"), ["v"]) == {}
