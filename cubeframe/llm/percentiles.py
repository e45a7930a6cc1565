"""Percentiles of very large numeric columns, from counts kept per day.

State: the number of readings per (day, group, value on a grid). States of days, partitions or sites are combined by
adding counts, in any order. Values are rounded to the grid once, so that every percentile is within half a step of the
exact one (an observed value of the wanted rank); with the step at or under the precision of the data it is exact.

A reading that is delivered again on a later day belongs to its first day. The state of a day is therefore built with a
look back: ``region_counts(cells, regions, since=day)`` reads the deliveries up to that day only to recognise repeats and
counts what is new from that day on. States built so, day by day, are disjoint, and their sum is the state of the whole
table. Earlier days are read only for the scenes that the new days touch.

Percentiles: counts of the same group and value are added, sorted by value within ranges of the grid, summed per range;
the offset of a range is the sum of the ranges before it; a running sum within the range plus the offset gives each
value's last rank, and the first value that reaches a wanted rank is the percentile. A range holds a bounded number of grid values, so no window
grows with the data, however large the group.

Rank of percentile p of n values: ceil(p * n), at least 1 (an observed value, no interpolation).

Defined results: null, NaN and infinite values do not count, nor do rows with a null key; a null load_date is a day of its
own, after all others; a group without a value gives no row; an empty table gives an empty result; late and repeated
deliveries of a reading count once, on its first day; bands of any number count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeframe.operators.cells import by_tile, pack, readings, together
from cubeframe.session import BROADCAST_BYTES

PROBS = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
STEP = 1e-4
#: Grid values in a range.
RANGE = 4096
#: Size of a tile of readings in pixels; all bands of a pixel are in one tile, however many.
LINES, SAMPLES, BANDS = 64, 16, 1 << 30
#: Bytes of a scene's name in a set of names, at most.
_NAME_BYTES = 200

_REGION = {"y1": "<i4", "y2": "<i4", "x1": "<i4", "x2": "<i4", "group": "<i4"}


def _no_nulls(columns: list[str]) -> str:
    return " AND ".join(f"`{c}` IS NOT NULL" for c in columns)


def counts(values: DataFrame, keys: list[str], value: str, step: float = STEP, day: str | None = None) -> DataFrame:
    """State of any table: keys, day (if one is named; it may be null), range, bin, n. A value is bin * step, within half a step.

    Every row counts: a table in which readings repeat is freed of repeats by the caller.
    """
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf"))
    bin_ = F.round(F.col(value) / F.lit(step)).cast("bigint")
    return values.where(ok).where(_no_nulls(keys)).groupBy(*keys, *([day] if day else []), F.floor(bin_ / RANGE).alias("range"), bin_.alias("bin")).agg(F.count("*").alias("n"))


def unpacked(state: DataFrame, keys: list[str]) -> DataFrame:
    """keys, range, bin, n of a packed state (bins and ns are arrays), the rows of a range brought together while packed."""
    packed = state.select(*keys, "range", "bins", "ns").where(_no_nulls([*keys, "range"])).repartition(*keys, "range")
    return packed.select(*keys, "range", F.explode(F.arrays_zip("bins", "ns")).alias("z")).select(*keys, "range", F.col("z.bins").alias("bin"), F.col("z.ns").alias("n"))


def percentiles(state: DataFrame, keys: list[str], probs: dict[str, float] = PROBS, step: float = STEP) -> DataFrame:
    """keys, n and one column per percentile, from the added counts (keys, range, bin, n)."""
    added = state.groupBy(*keys, "range", "bin").agg(F.sum("n").alias("n"))
    per_range = added.groupBy(*keys, "range").agg(F.sum("n").alias("in_range"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.withColumns({"offset": F.coalesce(F.sum("in_range").over(before), F.lit(0)), "total": F.sum("in_range").over(Window.partitionBy(*keys))})
    # only ranges that hold a wanted rank are looked into
    rank = {c: F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(p) - F.lit(1e-9))) for c, p in probs.items()}
    wanted = F.exists(F.array(*rank.values()), lambda r: (r > F.col("offset")) & (r <= F.col("offset") + F.col("in_range")))
    ranked = added.join(per_range.where(wanted), [*keys, "range"])
    running = Window.partitionBy(*keys, "range").orderBy("bin")
    ranked = ranked.withColumn("upto", F.col("offset") + F.sum("n").over(running))
    first = lambda r: F.min(F.when((F.col("upto") >= r) & (F.col("upto") - F.col("n") < r), F.col("bin")))
    found = ranked.groupBy(*keys).agg(F.first("total").alias("n"), *(first(r).alias(c) for c, r in rank.items()))
    return found.select(*keys, "n", *(F.round(F.col(c) * F.lit(step), 12).alias(c) for c in probs))


def _touched(cells: DataFrame, since: str | None) -> DataFrame:
    """The deliveries that a state since a day needs: all of the scenes with a delivery from that day on."""
    if since is None:
        return cells
    new = cells.where((F.col("load_date") >= F.lit(since).cast("date")) | F.col("load_date").isNull()).select("scene").distinct()
    few = new.count() * _NAME_BYTES <= BROADCAST_BYTES
    return cells.join(F.broadcast(new) if few else new, "scene", "left_semi")


def _state(group: np.ndarray, band: np.ndarray, day: np.ndarray, b: np.ndarray, names: pa.Array | None = None) -> pa.RecordBatch:
    """Readings as rows (day, group, band, range) with arrays of bins and counts. names: what the groups' numbers stand for."""
    order = np.lexsort((b, day, band, group))
    cell = np.stack([group, band, day, b // RANGE, b])[:, order]
    new = np.r_[True, (cell[:, 1:] != cell[:, :-1]).any(0)] if len(b) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    n, cell = np.diff(np.r_[first, len(b)]), cell[:, first]
    part = np.flatnonzero(np.r_[True, (cell[:4, 1:] != cell[:4, :-1]).any(0)]) if len(first) else first
    offsets = pa.array(np.r_[part, len(first)].astype(np.int32))
    group = pa.array(cell[0, part].astype(np.int32))
    head = [pa.array(cell[2, part].astype(np.int32)), group if names is None else names.take(group), pa.array(cell[1, part].astype(np.int32)), pa.array(cell[3, part])]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (cell[4], n.astype(np.int64))]
    return pa.RecordBatch.from_arrays([*head, *lists], names=["day", "group", "band", "range", "bins", "ns"])


def _first_day(since: str | None) -> int:
    return -(2**31) if since is None else int(np.datetime64(since, "D").astype(int))


def _dated(counted: DataFrame) -> DataFrame:
    return counted.select(F.when(F.col("day") < 2**31 - 1, F.date_from_unix_date("day")).alias("load_date"), "group", "band", "range", "bins", "ns")


def scene_counts(cells: DataFrame, step: float = STEP, since: str | None = None) -> DataFrame:
    """load_date, group (the scene), band, range, bins, ns: packed state of all readings of the scenes. since: see above."""
    from_day = _first_day(since)

    def count(tiles: list[list[dict]]) -> pa.RecordBatch:
        k, a = readings(tiles)
        ok = np.isfinite(a["value"]) & (a["day"] >= from_day)
        bins = np.rint(a["value"][ok] / step).astype(np.int64)
        names = pa.array([rows[0]["scene"] for rows in tiles], pa.string())
        return _state(k[ok], a["band"][ok].astype(np.int64), a["day"][ok].astype(np.int64), bins, names)

    rows = together(pack(_touched(cells, since), LINES, SAMPLES, BANDS))
    return _dated(by_tile(rows, count, "day int, group string, band int, range bigint, bins array<bigint>, ns array<bigint>"))


def _members(tile: int, areas: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first of each pixel, members of each pixel, groups): the groups whose regions hold a tile's pixels, each once."""
    y0, x0 = (tile >> 32) * LINES, (tile >> 12 & (1 << 20) - 1) * SAMPLES
    pairs = []
    for r in areas:
        y, x = (np.arange(max(r[a] - at, 0), min(r[b] - at, size)) for a, b, at, size in (("y1", "y2", y0, LINES), ("x1", "x2", x0, SAMPLES)))
        pairs.append(((y[:, None] * SAMPLES + x).ravel() << 32) + (r["group"] + 2**31))
    pairs = np.unique(np.concatenate(pairs))
    n = np.bincount(pairs >> 32, minlength=LINES * SAMPLES)
    return np.cumsum(n) - n, n, (pairs & 0xFFFFFFFF) - 2**31


def region_counts(cells: DataFrame, regions: DataFrame, step: float = STEP, since: str | None = None) -> DataFrame:
    """load_date, group, band, range, bins, ns: packed state of the readings that lie in a region.

    regions: scene, y1, y2, x1, x2, group (int). Rows are parts, to be added like those of several days; each holds one range.
    since: count only what is first delivered on that day ('2025-01-31') or later; see above.

    Readings and regions meet by tile; a region takes part in every tile that it overlaps. A reading that lies in several
    regions counts once for each group among them; a delivery that is repeated counts once, on its first day.
    """
    from_day = _first_day(since)
    bounded = regions.where("scene IS NOT NULL AND group IS NOT NULL AND y1 < y2 AND x1 < x2 AND y2 > 0 AND x2 > 0")
    tile = F.shiftleft(F.col("ty").cast("bigint"), 32) + F.shiftleft(F.col("tx").cast("bigint"), 12)
    first = lambda c, size: F.floor(F.greatest(F.col(c), F.lit(0)) / size)
    last = lambda c, size: F.floor((F.col(c) - 1) / size)
    placed = (
        bounded.withColumn("ty", F.explode(F.sequence(first("y1", LINES), last("y2", LINES))))
        .withColumn("tx", F.explode(F.sequence(first("x1", SAMPLES), last("x2", SAMPLES))))
        .select("scene", tile.alias("tile"), *(F.col(c).cast("int").alias(c) for c in _REGION))
        .distinct()
    )
    none = F.lit(None)
    rows = (
        pack(_touched(cells, since), LINES, SAMPLES, BANDS).select("scene", "tile", "n", "cells", *(none.cast("int").alias(c) for c in _REGION))
        .unionByName(placed.select("scene", "tile", F.lit(0).alias("n"), none.cast("binary").alias("cells"), *_REGION))
    )

    def count(tiles: list[list[dict]]) -> pa.RecordBatch:
        areas = [[r for r in rows if r["cells"] is None] for rows in tiles]
        met = [i for i, rows in enumerate(tiles) if areas[i] and len(areas[i]) < len(rows)]
        k, a = readings([tiles[i] for i in met])
        ok = np.isfinite(a["value"]) & (a["day"] >= from_day)
        k, a = k[ok], {c: v[ok] for c, v in a.items()}
        held = [_members(tiles[i][0]["tile"], areas[i]) for i in met]
        pixel = k * (LINES * SAMPLES) + a["y"] % LINES * SAMPLES + a["x"] % SAMPLES
        offset = np.cumsum([0, *(len(g) for _, _, g in held)])
        starts, n, groups = (np.concatenate(c) if held else np.zeros(0, np.int64) for c in (tuple(f + o for (f, _, _), o in zip(held, offset)), tuple(m for _, m, _ in held), tuple(g for _, _, g in held)))
        n, starts = n[pixel], starts[pixel]
        pick = np.repeat(np.arange(len(k)), n)
        member = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(pick))
        bins = np.rint(a["value"][pick] / step).astype(np.int64)
        return _state(groups[member], a["band"][pick].astype(np.int64), a["day"][pick].astype(np.int64), bins)

    return _dated(by_tile(together(rows), count, "day int, group int, band int, range bigint, bins array<bigint>, ns array<bigint>"))
