import math

import numpy as np
from pyspark.sql import functions as F

from cubeframe.llm import percentiles as p


def exact(values, q):
    s = sorted(values)
    return s[max(1, math.ceil(q * len(s) - 1e-9)) - 1]


def test_days_are_combined_exactly(spark):
    rng = np.random.default_rng(2)
    rows = [(int(d), g, float(round(v, 4))) for d, g, v in zip(rng.integers(0, 3, 3000), rng.choice(["a", "b"], 3000, p=[0.9, 0.1]), rng.normal(0, 1, 3000))]
    df = spark.createDataFrame(rows + [(0, "a", None), (0, "a", math.nan), (1, "b", math.inf), (1, "empty", None)], "day int, g string, v double")
    state = p.counts(df.where("day = 0"), ["g"], "v").union(p.counts(df.where("day > 0"), ["g"], "v"))
    got = {r.g: r for r in p.percentiles(state, ["g"]).collect()}
    assert set(got) == {"a", "b"}
    for g in "ab":
        v = [x for _, k, x in rows if k == g]
        assert got[g].n == len(v)
        assert all(abs(got[g][c] - exact(v, q)) < 1e-9 for c, q in p.PROBS.items())


def test_error_bound_ties_and_single_values(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, 2000).tolist()
    df = spark.createDataFrame([("a", x) for x in v] + [("tie", 0.5)] * 100 + [("one", -0.25)], "g string, v double")
    got = {r.g: r for r in p.percentiles(p.counts(df, ["g"], "v", 0.01), ["g"], step=0.01).collect()}
    assert all(abs(got["a"][c] - exact(v, q)) <= 0.005 + 1e-9 for c, q in p.PROBS.items())
    assert {got["tie"][c] for c in p.PROBS} == {0.5} and {got["one"][c] for c in p.PROBS} == {-0.25}
    assert p.percentiles(p.counts(df.where("false"), ["g"], "v"), ["g"]).count() == 0


def test_regions_days_and_repeats(spark):
    """Readings across tiles; a repeat on a later day counts once, on its first; overlapping regions of one group count once."""
    rng = np.random.default_rng(4)
    cells = [("s", y, x, b, float(round(rng.random(), 4)), 1 + y % 3) for y in range(300) for x in range(40) for b in range(2)]
    late = [(*c[:5], 9) for c in cells[::7]]
    df = spark.createDataFrame(cells + late + [("s", 1, 1, 0, None, 1), (None, 1, 1, 0, 0.5, 1), ("t", 1, 1, 0, 0.5, 1)], "scene string, y int, x int, band int, value double, d int")
    df = df.withColumn("load_date", F.date_add(F.lit("2025-01-01").cast("date"), F.col("d"))).drop("d").withColumn("group", F.lit("clash"))
    regions = [("s", 10, 200, 5, 35, 1), ("s", 100, 290, 0, 20, 1), ("s", 0, 5, 0, 40, 2), ("s", None, 5, 0, 40, 2), ("u", 0, 5, 0, 40, 3), ("s", 7, 7, 0, 40, 4)]
    state = p.region_counts(df, spark.createDataFrame(regions, "scene string, y1 int, y2 int, x1 int, x2 int, group int")).cache()
    days = {r.load_date.day for r in state.select("load_date").distinct().collect()}
    assert days == {2, 3, 4}
    got = {(r.group, r.band): r for r in p.percentiles(p.unpacked(state, ["group", "band"]), ["group", "band"]).collect()}
    assert set(got) == {(g, b) for g in (1, 2) for b in (0, 1)}
    for (g, b), r in got.items():
        v = [c[4] for c in cells if c[3] == b and any(k[5] == g and k[1] is not None and k[1] <= c[1] < k[2] and k[3] <= c[2] < k[4] for k in regions)]
        assert r.n == len(v) and all(abs(r[c] - exact(v, q)) < 1e-9 for c, q in p.PROBS.items())


def _cells(spark, rows):
    df = spark.createDataFrame(rows, "scene string, y int, x int, band int, value double, d int")
    return df.withColumn("load_date", F.date_add(F.lit("2025-01-01").cast("date"), F.col("d"))).drop("d")


def _tidy(df, keys):
    return sorted(map(tuple, df.select(*keys, "n", *p.PROBS).collect()))


def test_states_of_days_built_apart_add_up_to_the_whole(spark):
    """Day by day, each with what was delivered up to then; lines are late, repeated, and of scenes that come only once."""
    rng = np.random.default_rng(7)
    first = [(s, y, x, b, float(round(rng.random(), 4)), int(rng.integers(0, 4))) for s in ("s", "t", "u") for y in range(70) for x in range(20) for b in range(2)]
    again = [(*first[i][:5], int(first[i][5] + rng.integers(0, 3))) for i in rng.choice(len(first), 3000)] + [(*r[:5], None) for r in first[:50]]
    cells = _cells(spark, [r for r in first + again if not (r[0] == "u" and r[5] is not None and r[5] > 1)]).cache()
    regions = spark.createDataFrame([("s", 3, 66, 2, 19, 1), ("t", 0, 70, 0, 9, 1), ("u", 0, 9, 0, 20, 2)], "scene string, y1 int, y2 int, x1 int, x2 int, group int")
    for state_of in (lambda c, **how: p.region_counts(c, regions, **how), lambda c, **how: p.scene_counts(c, **how)):
        apart = None
        for d in range(6):
            day = f"2025-01-{1 + d:02d}"
            upto = cells.where(f"load_date <= '{day}'" + (" OR load_date IS NULL" if d == 5 else ""))
            part = state_of(upto, since=day)
            assert part.where(f"load_date < '{day}'").count() == 0
            apart = part if apart is None else apart.union(part)
        keys = ["group", "band"]
        whole = _tidy(p.percentiles(p.unpacked(state_of(cells), keys), keys), keys)
        assert _tidy(p.percentiles(p.unpacked(apart, keys), keys), keys) == whole and whole
    assert sum(r[2] for r in whole) == cells.select("scene", "y", "x", "band").distinct().count()


def test_any_number_of_bands(spark):
    cells = _cells(spark, [("s", y, 0, b, 0.5, 0) for y in range(3) for b in (1, 4095, 4096, 5000, 10**6)])
    regions = spark.createDataFrame([("s", 0, 3, 0, 1, 9), ("s", -5, 2, -5, 1, 8)], "scene string, y1 int, y2 int, x1 int, x2 int, group int")
    got = {(r.group, r.band): r.n for r in p.percentiles(p.unpacked(p.region_counts(cells, regions), ["group", "band"]), ["group", "band"]).collect()}
    assert got == {(g, b): n for g, n in ((9, 3), (8, 2)) for b in (1, 4095, 4096, 5000, 10**6)}
    assert p.region_counts(cells, regions.where("false")).count() == 0 and p.region_counts(cells.where("false"), regions).count() == 0


def test_a_null_day_counts(spark):
    df = spark.createDataFrame([(None, "a", 0.1), (1, "a", 0.2), (1, None, 0.3)], "day int, g string, v double")
    assert {(r.g, r.day, r.n) for r in p.counts(df, ["g"], "v", day="day").collect()} == {("a", None, 1), ("a", 1, 1)}
