import math

import pytest

from cubeframe import frame
from cubeframe.operators import cleaning

WORST = {(0, 1): -0.3, (2, 2): 1.9, (3, 0): math.inf, (1, 3): -math.inf}


@pytest.fixture
def cells(spark):
    rows = [("a", y, x, b, WORST.get((y, x), 0.5 + 0.01 * ((y + x) % 3)) if b == 1 else 0.5) for y in range(12) for x in range(6) for b in range(3)]
    rows += [("a", 0, 1, 1, -0.3), ("a", 0, 0, 2, math.nan), ("a", 1, 0, 2, None), ("b", 0, 0, 0, math.inf), (None, 0, 0, 0, 0.5)]
    return frame.all_cells(spark.createDataFrame(rows, "scene string, y int, x int, band int, value double"))


def test_the_worst_readings_are_found_and_repaired(cells):
    marked = cleaning.bad_cells(cells)
    bad = {(r.scene, r.y, r.x, r.band) for r in marked.where("NOT good").collect()}
    assert bad == {("a", y, x, 1) for y, x in WORST} | {("b", 0, 0, 0)}
    fixed = cleaning.repair(marked.selectExpr("*", "NOT good AS bad"), "bad", "hybrid").where("repaired").collect()
    assert {(r.y, r.x): r.value for r in fixed} == {k: 0.5 for k in WORST}


def test_infinite_readings_leave_profiles_and_repairs_finite(cells):
    dead = {(r.scene, r.x, r.band): r for r in cleaning.dead_columns(cells).collect()}
    assert dead["b", 0, 0].dead and dead["b", 0, 0].residual is None
    assert all(math.isfinite(r.residual) for k, r in dead.items() if k[0] == "a")
    fixed = cleaning.DeadPixelProcessor().clean(cells).where("repaired AND scene = 'a'").collect()
    assert {(r.y, r.x) for r in fixed} >= {(3, 0), (1, 3)} and all(math.isfinite(r.value) for r in fixed)
