import math
import statistics

import numpy as np
import pytest

from cubeframe.operators import cells as packing
from cubeframe.operators import spikes


def brute(rows):
    """Problem 5 by its definition."""
    v = {}
    for s, y, x, b, value, *_ in rows:
        if None not in (s, y, x, b, value) and not math.isnan(value):
            v[s, y, x, b] = value
    ok = {}
    for (s, y, x, b), value in v.items():
        if 0 <= value <= 1.25:
            ok.setdefault((s, b), []).append(value)
    out = {}
    for (s, y, x, b), value in v.items():
        run = 1
        for step in (1, -1):
            k = y + step
            while v.get((s, k, x, b)) == value:
                run, k = run + 1, k + step
        if not 0 <= value <= 1.25:
            out[s, y, x, b] = "impossible"
        elif run >= 6:
            out[s, y, x, b] = "stuck"
        else:
            med = statistics.median(ok[s, b])
            mad = statistics.median(abs(q - med) for q in ok[s, b])
            if abs(value - med) > 14.826 * mad + 1e-12:
                out[s, y, x, b] = "spike"
    return out


def scene(rng, name, lines, samples=3, bands=3):
    rows = []
    for y in range(lines):
        for x in range(samples):
            for b in range(bands):
                value = float(round(0.3 + 0.1 * b + rng.normal(0, 0.01), 4))
                if rng.random() < 0.01:
                    value = float(rng.choice([-0.1, 1.3, math.inf, -math.inf, 0.9]))
                if rng.random() < 0.01:
                    value = None
                if rng.random() < 0.01:
                    value = math.nan
                if rng.random() < 0.01:
                    continue
                rows.append((name, y, x, b, value, 1))
                if rng.random() < 0.02:
                    rows.append((name, y, x, b, value, 2))
    for x, first, n in ((0, 3, 7), (1, 8, 5), (2, 508, 8)):
        rows += [(name, y, x, 0, 0.31, 1) for y in range(first, min(first + n, lines))]
    seen = {}
    for r in rows:
        seen[r[:4] + r[5:]] = r
    return list(seen.values())


SCHEMA = "scene string, y int, x int, band int, value double, load int"


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"load_date": F.date_add(F.lit("2025-01-01").cast("date"), F.col("load")), "kind": F.lit("clash"), "score": F.lit(1), "tile": F.lit(1)})


@pytest.mark.parametrize("limit", [None, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    """limit 0: profiles of scenes with several tiles reach the tiles by shuffle instead of broadcast."""
    if limit is not None:
        monkeypatch.setattr(spikes, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(5)
    rows = scene(rng, "a", 30) + scene(rng, "b", 1100, 2, 2) + scene(rng, "c", 12)
    # deliveries of one position agree, as in the tables
    value = {}
    rows = [(*r[:4], value.setdefault(r[:4], r[4]), r[5]) for r in rows]
    rows += [(None, 1, 1, 1, 5.0, 1), ("a", None, 1, 1, 5.0, 1), ("a", 1, None, 1, 5.0, 1), ("a", 1, 1, None, 5.0, 1)]
    got = spikes.flag_readings(frame(spark, rows)).collect()
    assert {(r.scene, r.y, r.x, r.band): r.kind for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_constant_scene_single_reading_and_empty(spark):
    rows = [("a", y, 0, 0, 0.5, 1) for y in range(5)] + [("b", 0, 0, 0, 0.2, 1)]
    assert spikes.flag_readings(frame(spark, rows)).count() == 0
    assert spikes.flag_readings(frame(spark, rows).where("false")).count() == 0
    everything = spikes.flag_readings(frame(spark, rows), all_scores=True).collect()
    assert len(everything) == 6 and all(0 < r.score < 1 and r.kind == "none" for r in everything)


def test_spikes_score_above_ordinary_readings():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 4)).astype(np.float32)
    x[:, 3] = 1
    forest = spikes.grow(x[None, :128], np.array([3]))
    far = np.tile([20, 20, 20, 1], (5, 1)).astype(np.float32)
    ordinary, odd = spikes.score(forest, np.zeros(400, int), x), spikes.score(forest, np.zeros(5, int), far)
    assert odd.min() > np.quantile(ordinary, 0.99)


def test_packing_is_lossless():
    a = {"y": np.arange(5, dtype="<i4"), "value": np.array([0.1234, np.nan, np.inf, -np.inf, 1.0])}
    b = {"y": np.arange(3, dtype="<i4"), "value": np.array([1 / 3, 2**0.5, -0.0])}
    for x in (a, b, {"y": np.zeros(0, "<i4"), "value": np.zeros(0)}):
        back = packing.unpack_arrays(packing.pack_arrays(**x), y="<i4", value="<f8")
        assert all(np.array_equal(back[k], x[k], equal_nan=True) and (np.signbit(back[k]) == np.signbit(x[k])).all() for k in x)


def test_forests_do_not_depend_on_their_neighbours(spark):
    rng = np.random.default_rng(2)
    pools = rng.normal(0, 1, (3, spikes.POOL, 4)).astype(np.float32)
    seeds = np.array([11, 12, 13])
    together = spikes.grow(pools, seeds)
    for i in range(3):
        alone = spikes.grow(pools[i : i + 1], seeds[i : i + 1])
        assert all(np.array_equal(a[i], b[0]) for a, b in zip(together, alone))
    assert not np.array_equal(together[0][0], together[0][1])
    rows = [r for name in "abcdef" for r in scene(rng, name, 20)] + scene(rng, "long", 1100, 2, 2)
    df, before = frame(spark, rows).cache(), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in (2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append({tuple(r) for r in spikes.flag_readings(df.repartition(n), all_scores=True).select("scene", "y", "x", "band", "score", "kind").collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_no_reading_beyond_the_limit_scores_under_the_threshold():
    rng = np.random.default_rng(3)
    pools = np.concatenate([rng.normal(0, 1, (20, spikes.POOL, 4)), rng.choice([0, 0, 0, 50, -50, 30], (20, spikes.POOL, 4))]).astype(np.float32)
    forest = spikes.grow(pools, np.arange(40))
    x = rng.uniform(-50, 50, (40, 500, 4)).astype(np.float32)
    x[:, :, spikes.SEASON] = rng.choice([-1, 1], (40, 500)) * rng.uniform(10, 50, (40, 500))
    x[:, :250, [0, 1]] = 0
    marks = spikes.score(forest, np.repeat(np.arange(40), 500), x.reshape(-1, 4)).reshape(40, 500)
    assert (marks >= forest[3][:, None]).all() and (forest[3] > 0).all()


def test_many_faulty_readings_are_all_found(spark):
    """45 % of the readings far away form a cluster of their own; a band of deviation 0 flags all that differ."""
    rng = np.random.default_rng(6)
    rows = [("m", y, x, 0, float(round((0.9 if rng.random() < 0.45 else 0.3) + rng.normal(0, 0.001), 4)), 1) for y in range(60) for x in range(8)]
    rows += [("z", y, x, 0, 0.7 if (y * 7 + x) % 20 == 0 else 0.5, 1) for y in range(60) for x in range(8)]
    got = {(r.scene, r.y, r.x, r.band): r.kind for r in spikes.flag_readings(frame(spark, rows)).collect()}
    assert got == brute(rows)
