import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeframe.operators import cleaning, masks, regions, stats
from cubeframe.plans import plotdata


def planes(spark, images):
    rows = [(s, y, x, float(v)) for s, m in images.items() for (y, x), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "scene string, y int, x int, v double")


def pixels(df):
    return {(r.scene, r.y, r.x) for r in df.collect()}


def sizes(spark, images):
    return spark.createDataFrame([(s, *m.shape) for s, m in images.items()], "scene string, height int, width int")


def three(m, f, outside):
    p = np.pad(m, 1, constant_values=outside)
    return f([p[1 + a : p.shape[0] - 1 + a, 1 + b : p.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)


def opened_closed(m):
    m = three(three(m, np.all, False), np.any, False)
    return three(three(m, np.any, False), np.all, False)


def filled(m):
    """Holes filled: background that no path along the four sides leads out of."""
    out, seen = [(y, x) for y in range(m.shape[0]) for x in range(m.shape[1]) if not m[y, x] and (y in (0, m.shape[0] - 1) or x in (0, m.shape[1] - 1))], set()
    while out:
        y, x = out.pop()
        if (y, x) in seen or not (0 <= y < m.shape[0] and 0 <= x < m.shape[1]) or m[y, x]:
            continue
        seen.add((y, x))
        out += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return np.array([[(y, x) not in seen for x in range(m.shape[1])] for y in range(m.shape[0])])


@pytest.mark.parametrize("q", [0, 0.1, 0.5, 0.99, 1])
def test_quantile_against_numpy(spark, q):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(0, 1, 5000), "ties": rng.choice([0.25, 0.5, 0.75], 999), "one": np.array([3.0]), "same": np.full(50, 2.0), "skew": np.r_[rng.normal(0, 1e-6, 3000), 1e6]}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("none", None)], "g string, v double")
    got = {r.g: r["quantile"] for r in stats.quantile(df, ["g"], "v", q).collect()}
    assert set(got) == set(groups) and all(abs(got[g] - np.quantile(x, q)) < 1e-9 for g, x in groups.items())


def test_component_and_pca_masks(spark):
    rng = np.random.default_rng(2)
    images = {s: np.kron(rng.random((5, 6)) > 0.4, np.ones((4, 4))) + rng.normal(0, 0.05, (20, 24)) for s in "ab"}
    dull = {s: rng.normal(0, 0.01, m.shape) for s, m in images.items()}
    light = {s: rng.random(m.shape) for s, m in images.items()}
    two = planes(spark, images).withColumn("band", F.lit(1)).union(planes(spark, dull).withColumn("band", F.lit(0))).select("scene", "y", "x", "band", F.col("v").alias("value"))
    how = {"selection": 1, "mode": "contrast", "threshold": 0.5, "lower": 0.2, "upper": 0.8}
    raw = {s: np.clip((m - 0.2) / 0.6, 0, 1) > 0.5 for s, m in images.items()}
    assert pixels(masks.component_mask(two, **how)) == {(s, y, x) for s, m in raw.items() for y, x in np.argwhere(m)}
    # Otsu's threshold is the centre of the last bin of the lower level: a pixel or two of that bin may lie above it
    above = {(s, int(y), int(x)) for s, m in images.items() for y, x in np.argwhere(m > 0.5)}
    otsu = pixels(masks.component_mask(two, "std"))
    assert above <= otsu and len(otsu - above) <= 3
    got = pixels(masks.pca_mask(two, planes(spark, light), sizes(spark, images), **how))
    want = {s: filled(opened_closed(m)) & ~(light[s] < np.quantile(light[s], 0.1)) for s, m in raw.items()}
    assert got == {(s, y, x) for s, m in want.items() for y, x in np.argwhere(m)} and got
    with pytest.raises(ValueError):
        masks.component_mask(two, mode="other")


def test_bright_and_smoothed(spark):
    rng = np.random.default_rng(3)
    images = {"a": rng.random((20, 20)), "b": np.zeros((3, 3))}
    got = pixels(masks.bright(planes(spark, images)))
    assert got == {("a", y, x) for y, x in np.argwhere(images["a"] > np.quantile(images["a"], 0.1))}
    blob = {"a": np.zeros((20, 20))}
    blob["a"][4:14, 5:15] = 1
    mask = planes(spark, blob).where("v > 0").select("scene", "y", "x")
    smooth = pixels(masks.tidy(mask, sizes(spark, blob), min_size=4, radius=1, smooth_sigma=1.0))
    assert {("a", y, x) for y in range(5, 13) for x in range(6, 14)} <= smooth <= pixels(mask)


def test_rect_mask_pixels_and_crops(spark):
    m = np.zeros((30, 30), bool)
    m[2:10, 3:9], m[15:28, 12:24], m[1:3, 20:22] = True, True, True
    mask = spark.createDataFrame([("s", int(y), int(x)) for y, x in np.argwhere(m)], "scene string, y int, x int")
    rects = regions.rect_mask(mask, (4, 6), sizes(spark, {"s": m}), 0.9, 2)
    got = [tuple(r) for r in rects.orderBy("ordinal").collect()]
    assert got == [("s", 1, 19, 23, 15, 21), ("s", 2, 4, 8, 3, 9)]
    assert pixels(regions.rect_pixels(rects)) == {("s", y, x) for _, _, a, b, c, d in got for y in range(a, b) for x in range(c, d)}
    cells = planes(spark, {"s": np.arange(900).reshape(30, 30)}).select("scene", "y", "x", F.lit(7).alias("band"), F.col("v").alias("value"))
    cut = {(r.ordinal, r.y, r.x): r.value for r in regions.crops(cells, rects).collect()}
    assert len(cut) == 48 and cut[2, 0, 0] == 4 * 30 + 3 and cut[1, 3, 5] == 22 * 30 + 20
    assert regions.rect_mask(mask.where("false"), (4, 6), sizes(spark, {"s": m}), 0.9, 2).count() == 0


def test_lines_of_rectangles_against_a_loop(spark):
    rng = np.random.default_rng(4)
    rects = [(s, i, int(t), int(x)) for s in "ab" for i, (t, x) in enumerate(zip(rng.integers(0, 40, 30), rng.integers(0, 40, 30)))]
    df = spark.createDataFrame(rects, "scene string, label bigint, top int, left int")
    for along, across in (("left", "top"), ("top", "left")):
        want = []
        for s in "ab":
            group, anchor, of = -1, None, {}
            for _, i, t, x in sorted((r for r in rects if r[0] == s), key=lambda r: (r[3] if along == "left" else r[2], r[1])):
                a = x if along == "left" else t
                if anchor is None or a - anchor > 5:
                    group, anchor = group + 1, a
                of[i] = group
            line = sorted((r for r in rects if r[0] == s), key=lambda r: (of[r[1]], r[2] if across == "top" else r[3], r[1]))
            want += [(s, of[r[1]], k, r[2], r[3]) for k, r in enumerate(line, 1)]
        assert sorted(map(tuple, regions._in_lines(df, along, across, 5).collect())) == sorted(want)


def test_defect_lists_and_plot_modes(spark):
    defects = spark.createDataFrame([("s", i % 7, i) for i in range(100)] + [("t", 1, 1)], "scene string, band int, x int")
    got = cleaning.first_defects(defects).collect()
    assert len(got) == 41 and max(r.x for r in got if r.scene == "s") == 39
    cells = planes(spark, {"s": np.arange(36.0).reshape(6, 6)}).select("scene", "y", "x", F.lit(0).alias("band"), F.col("v").alias("value"))
    over = cleaning.defect_overlay(cells, cells.where("value = 7").select("scene", "y", "x", "band"), 0)
    assert over.count() == 36 and [r.value for r in over.where("defect").collect()] == [7.0]
    mask = cells.where("x = 0").select("scene", "y", "x")
    assert {(r.x, r.alpha) for r in plotdata.slices(cells, n=1, mask=mask).collect()} == {(0, 1.0), (3, 0.0)}
    assert {r.low for r in plotdata.stack(cells).collect()} == {0.0} and plotdata.stack(cells).count() == 4
    with pytest.raises(ValueError):
        plotdata.faces(cells, top="other")
