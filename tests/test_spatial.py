import numpy as np
from pyspark.sql import functions as F

from cubeframe.frame import extent
from cubeframe.operators import extract, regions, spatial, stats


def to_mask(spark, image, scene="a"):
    return spark.createDataFrame([(scene, int(y), int(x)) for y, x in np.argwhere(image)], "scene string, y int, x int")


def to_image(mask, shape):
    out = np.zeros(shape, bool)
    for r in mask.collect():
        out[r.y, r.x] = True
    return out


def sizes(spark, shape, scene="a"):
    return spark.createDataFrame([(scene, *shape)], "scene string, height int, width int")


def flood(image, steps):
    label = np.full(image.shape, -1)
    for y, x in np.argwhere(image):
        if label[y, x] < 0:
            stack, label[y, x] = [(y, x)], y << 24 | x
            while stack:
                a, b = stack.pop()
                for dy, dx in steps:
                    p, q = a + dy, b + dx
                    if 0 <= p < image.shape[0] and 0 <= q < image.shape[1] and image[p, q] and label[p, q] < 0:
                        label[p, q] = y << 24 | x
                        stack.append((p, q))
    return label


FOUR = [(0, 1), (0, -1), (1, 0), (-1, 0)]
EIGHT = FOUR + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def test_labels_across_tiles(spark, monkeypatch):
    image = np.random.default_rng(1).random((40, 37)) < 0.45
    for tile in (512, 8):
        monkeypatch.setattr(spatial, "TILE", tile)
        for n, steps in ((8, EIGHT), (4, FOUR)):
            want = flood(image, steps)
            got = {(r.y, r.x): r.label for r in spatial.label(to_mask(spark, image), n).collect()}
            assert got == {(y, x): want[y, x] for y, x in np.argwhere(image)}


def moved(image, offsets):
    big = np.pad(image, 10)
    return [big[10 + a : 10 + a + image.shape[0], 10 + b : 10 + b + image.shape[1]] for a, b in offsets]


def test_morphology(spark):
    image = np.random.default_rng(2).random((20, 18)) < 0.6
    size = sizes(spark, image.shape)
    for offsets in (spatial.square(3), spatial.disk(2)):
        eroded, dilated = np.all(moved(image, offsets), 0), np.any(moved(image, offsets), 0)
        assert (to_image(spatial.erode(to_mask(spark, image), offsets), image.shape) == eroded).all()
        assert (to_image(spatial.dilate(to_mask(spark, image), offsets, size), image.shape) == dilated).all()
        opened = to_image(spatial.opening(to_mask(spark, image), offsets, size), image.shape)
        assert not (opened & ~image).any()
        closed = to_image(spatial.closing(to_mask(spark, image), offsets, size), image.shape)
        assert not (image & ~closed)[3:-3, 3:-3].any()


def test_small_objects_and_holes(spark):
    image = np.zeros((12, 12), bool)
    image[1:8, 1:8] = True
    image[3:5, 3:5] = False
    image[10, 10] = True
    size = sizes(spark, image.shape)
    assert to_image(spatial.fill_holes(to_mask(spark, image), size), image.shape)[3:5, 3:5].all()
    assert not to_image(spatial.remove_small_objects(to_mask(spark, image), 1), image.shape)[10, 10]
    assert not to_image(spatial.remove_small_holes(to_mask(spark, image), 3, size), image.shape)[3, 3]
    assert to_image(spatial.remove_small_holes(to_mask(spark, image), 4, size), image.shape)[3, 3]


def test_gaussian(spark):
    v = np.random.default_rng(3).random((6, 5))
    df = spark.createDataFrame([("a", y, x, float(v[y, x])) for y in range(6) for x in range(5)], "scene string, y int, x int, v double")
    k = spatial.gaussian_kernel(2.0)
    pad = np.pad(v, len(k) // 2, mode="symmetric")
    want = np.array([[(pad[y : y + len(k), x : x + len(k)] * np.outer(k, k)).sum() for x in range(5)] for y in range(6)])
    got = {(r.y, r.x): r.v for r in spatial.gaussian(df, 2.0).collect()}
    assert all(abs(got[y, x] - want[y, x]) < 1e-12 for y in range(6) for x in range(5))


def test_regions_and_fixed_rects(spark):
    image = np.zeros((40, 40), bool)
    for y, x in ((2, 3), (2, 20), (20, 4), (21, 22)):
        image[y : y + 10, x : x + 8] = True
    image[35:37, 35:37] = True
    mask, size = to_mask(spark, image), sizes(spark, image.shape)
    found = regions.valid_regions(mask, 0.9, 4).orderBy("rank").collect()
    assert [(r.y1, r.x1, r.area) for r in found] == [(2, 3, 80), (2, 20, 80), (20, 4, 80), (21, 22, 80)]
    rects = regions.fixed_rects(mask, (6, 4), size).orderBy("ordinal").collect()
    assert [(r.group, r.top, r.left) for r in rects] == [(0, 3, 4), (0, 21, 6), (1, 3, 22), (1, 22, 24)] or len(rects) == 4
    assert [r.ordinal for r in rects] == [1, 2, 3, 4]
    assert tuple(regions.rect_size(regions.valid_regions(mask, 0.9, 4), 1).first())[1:] == (8, 6)


def test_otsu_of_two_levels(spark):
    rows = [("a", 0.1 + i * 1e-4) for i in range(50)] + [("a", 0.9 - i * 1e-4) for i in range(50)] + [("flat", 0.5)] * 4
    got = {r.scene: r.threshold for r in stats.otsu(spark.createDataFrame(rows, "scene string, v double"), ["scene"]).collect()}
    assert 0.104 < got["a"] < 0.895 and got["flat"] == 0.5


def test_polygons_and_disks(spark):
    cells = spark.range(400).select(F.lit("a").alias("scene"), F.floor(F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), F.lit(0).alias("band"), F.lit(1.0).alias("value"))
    ring = spark.createDataFrame([("a", 1, 0, 2.5, 2.5), ("a", 1, 1, 10.5, 2.5), ("a", 1, 2, 10.5, 6.5), ("a", 1, 3, 2.5, 6.5), ("a", 2, 0, 1.0, 1.0), ("a", 2, 1, 2.0, 2.0)], "scene string, roi_id int, vertex_ord int, vx double, vy double")
    assert [(r.roi_id, r.value) for r in extract.drawn_polygons(cells, ring, "mean").collect()] == [(1, 1.0)]
    points = spark.createDataFrame([("a", 1, 0, 0)], "scene string, coord_id int, py int, px int")
    spread = cells.withColumn("value", (F.col("y") * 100 + F.col("x")).cast("double"))
    near = [y * 100 + x for y in range(4) for x in range(4) if y * y + x * x <= 9]
    assert abs(extract.local_means(spread, points, 3, "disk").first().value - np.mean(near)) < 1e-9
    assert extent(cells).first().height == 20
