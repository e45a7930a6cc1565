import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeframe.frame import extent
from cubeframe.operators import masks, models, scenewise
from cubeframe.queries import reference


def scene_cells(spark, cubes):
    rows = [(s, y, x, b, float(c[y, x, b])) for s, c in cubes.items() for y, x, b in np.ndindex(c.shape)]
    return spark.createDataFrame(rows, "scene string, y int, x int, band int, value double")


def images(rows, k):
    out = {}
    for r in rows:
        out.setdefault(r.scene, {}).setdefault((r.y, r.x), [0.0] * k)[r.band] = r.value
    return out


@pytest.fixture(scope="module")
def cubes():
    rng = np.random.default_rng(11)
    return {s: 0.5 + 0.1 * rng.normal(size=(h, 5, b)) @ rng.normal(size=(b, b)) for s, h, b in (("a", 12, 4), ("b", 9, 6), ("c", 4, 5))}


@pytest.mark.parametrize("lines", [4, 32])
def test_components_are_of_each_scene_and_all_bands(spark, cubes, lines):
    blocks = scenewise.Blocks(scene_cells(spark, cubes), lines)
    pca, mnf = images(scenewise.pca(blocks, 2).collect(), 2), images(scenewise.mnf(blocks, 3).collect(), 3)
    for s, c in cubes.items():
        x = c.reshape(-1, c.shape[2])
        noise = np.vstack([np.diff(c, axis=a).reshape(-1, c.shape[2]) for a in (0, 1)])
        value, vector = np.linalg.eigh(np.cov(x.T))
        want = (x - x.mean(0)) @ models._signed(vector[:, ::-1][:, :2])
        assert np.allclose([pca[s][y, q] for y, q in np.ndindex(c.shape[:2])], want, atol=1e-8)
        value, vector = np.linalg.eigh(np.cov(noise.T))
        white = vector @ np.diag(1 / np.sqrt(value + 1e-12)) @ vector.T
        value, vector = np.linalg.eigh(np.cov((x @ white).T))
        want = (x - x.mean(0)) @ models._signed(white @ vector[:, ::-1][:, :3])
        assert np.allclose([mnf[s][y, q] for y, q in np.ndindex(c.shape[:2])], want, atol=1e-6)


def test_pixels_without_a_band_of_their_scene_are_left_out(spark, cubes):
    cells = scene_cells(spark, {"a": cubes["a"]}).where("NOT (y = 3 AND x = 2 AND band = 1)").where("y < 8 OR band > 0")
    out = scenewise.pca(scenewise.Blocks(cells, 4), 2)
    assert {(r.y, r.x) for r in out.collect()} == {(y, x) for y in range(8) for x in range(5)} - {(3, 2)}


def test_kmeans_splits_every_scene(spark):
    """Scene b differs less within than from a: one fit over both would give b a single cluster."""
    rng = np.random.default_rng(12)
    shapes = {"a": [[1, 2, 3, 4], [4, 3, 2, 1]], "b": [[4, 3, 2, 1.0], [4, 3, 1.8, 1.4]], "c": [[1, 5, 1, 5, 1], [5, 1, 1, 1, 5]]}
    truth = {s: rng.random((20, 6)) < 0.3 for s in shapes}
    cubes = {s: np.array(p)[t.astype(int)] * rng.uniform(0.9, 1.1, (20, 6, 1)) + 0.001 * rng.normal(size=(20, 6, len(p[0]))) for (s, p), t in zip(shapes.items(), truth.values())}
    for lines in (8, 32):
        got = scenewise.kmeans(scenewise.Blocks(scene_cells(spark, cubes), lines)).collect()
        for s, t in truth.items():
            mine = [(r.cluster, t[r.y, r.x]) for r in got if r.scene == s]
            assert len(mine) == 108 and len(set(mine)) == 2 and len({c for c, _ in mine}) == 2


def test_queries_cover_every_scene(spark, data):
    want = {r.scene for r in reference.cells(spark, data).select("scene").distinct().collect()}
    bands = reference.cells(spark, data).groupBy("scene").agg(F.count_distinct("band").alias("b")).select("b").distinct().count()
    assert bands > 1
    for name in ("bm5_kmeans", "bm6_component_mask", "sb7_mnf"):
        assert {r.scene for r in reference.QUERIES[name](spark, data).select("scene").distinct().collect()} == want, name


def test_kmeans_mask_is_the_smallest_cluster_of_each_scene(spark):
    truth = {s: np.zeros((16, 14), bool) for s in "ab"}
    truth["a"][3:9, 4:10] = truth["b"][6:12, 2:9] = True
    truth["a"][13, 12] = True  # removed by the opening
    shapes = {"a": [[1, 2, 3, 4], [4, 3, 2, 1]], "b": [[4, 3, 2, 1.0, 1], [4, 3, 1.8, 1.4, 1]]}
    scale = np.random.default_rng(13).uniform(0.9, 1.1, (16, 14, 1))
    scale[:2] *= 0.5  # two dark lines take up the shadow quantile
    cubes = {s: np.array(p)[truth[s].astype(int)] * scale for s, p in shapes.items()}
    cells = scene_cells(spark, cubes)
    found = scenewise.kmeans(scenewise.Blocks(cells))
    got = {(r.scene, r.y, r.x) for r in masks.kmeans_mask(found, extent(cells)).collect()}
    truth["a"][13, 12] = False
    assert got == {(s, y, x) for s, t in truth.items() for y, x in np.argwhere(t)}
    assert len({(r.scene, r.y, r.x) for r in masks.kmeans_mask(found, extent(cells), "large").collect()} & got) == 0


def test_mask_query_has_every_pixel_of_every_scene(spark, data):
    size = extent(reference.cells(spark, data)).agg(F.sum(F.col("height") * F.col("width"))).first()[0]
    out = reference.bm5_kmeans_mask(spark, data)
    assert out.columns == ["scene", "y", "x", "fg"] and out.count() == size
