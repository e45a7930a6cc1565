"""Implausible readings: impossible, stuck and spiking ones, relative to the normal behaviour of their own source.

The source is the scene; a band has a normal level of its own (the spectrum repeats at every pixel, so the band plays the
part of a season). Three steps:

1. Tiles of packed readings (cells.pack, with a halo of RUN - 1 lines for runs across tiles): deliveries that repeat
   count once; runs along the lines; a profile of the tile: median and median absolute deviation per band, and a bounded
   random pool of readings by smallest hash.
2. Scenes of several tiles get one profile: medians and deviations from the added counts per value on a fine grid, the
   smallest hashes of all pools. It reaches the tiles by broadcast if its counted size is small, else by shuffle.
3. An isolation forest per scene scores every reading on level, difference, seasonal and run-length features. Its draws
   are hashes of the scene's name, so that every task which holds a tile of the scene grows the same forest, whatever
   else it holds. Explicit rules for physical limits and stuck runs apply to all readings; readings that score at least
   the scene's threshold are spike candidates, which an exact check on the scene's band decides.

The threshold is read off the forest itself: the least score that a reading beyond FAR deviations can have. It is the
mean, over the trees, of the longest path to any leaf whose box reaches beyond FAR on the seasonal feature. No spike scores
less, whatever its other features, so the exact check misses none. Trees split between padded limits of their sample,
so that values outside anything sampled fall into empty leaves: a spike needs no spike in the pool to stand out.

Defined results: null and NaN are missing, give no row and end a run; rows without a position are left out; a scene whose
band has deviation 0 flags every reading that differs from its median; medians of scenes with several tiles are taken on
a grid of GRID, those of others are exact; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeframe.operators.cells import by_tile, pack, pack_arrays, readings, together, unpack_arrays
from cubeframe.session import BROADCAST_BYTES, broadcast_if_small, checkpointed

LOW, HIGH = 0.0, 1.25  # physical limits of a reflectance
RUN = 6  # lines of a stuck run
FAR = 10 * 1.4826  # deviations from the median
CLIP = 50  # features go no further, in robust deviations
SEASON, _BEYOND = 2, 9.9  # the seasonal feature; where "beyond FAR" begins on it, with room for rounding
POOL, SAMPLE, TREES, DEPTH = 128, 64, 16, 6  # readings in a scene's pool, of a tree, trees, ceil(log2(SAMPLE))
WEIGHTS = (0.2, 0.25, 0.4, 0.15)  # chance of a split on level, difference, season, run length
GRID = 1e-6  # step of the counts from which medians of scenes with several tiles are taken
LINES, SAMPLES, BANDS = 512, 32, 16
#: At most, of a scene: POOL readings and, of up to some thousand bands, a median and a deviation.
_PROFILE_BYTES = 32 << 10

_FEATURED = {"y": "<i4", "x": "<i4", "band": "<i4", "run": "<i1", "value": "<f8"}
_STATS = {"band": "<i4", "median": "<f8", "mad": "<f8"}
_POOL = {"prio": "<i8", "band": "<i4", "run": "<i1", "value": "<f8", "diff": "<f8"}


def _mix(*columns: np.ndarray) -> np.ndarray:
    """A 63-bit hash of integer columns."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h ^= c.astype(np.uint64)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(1)).astype(np.int64)


def _group_median(group: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(groups, medians); group: integers in any order."""
    order = np.lexsort((v, group))
    g, s = group[order], v[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    n = np.diff(np.r_[first, len(g)])
    return g[first], (s[first + (n - 1) // 2] + s[first + n // 2]) / 2


def _differences(source: np.ndarray, a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(whether the reading before is the same sample and band one line up, the difference to it or 0)."""
    v, follows = a["value"], np.zeros(len(source), bool)
    if not len(v):
        return follows, v
    follows[1:] = (source[1:] == source[:-1]) & (a["x"][1:] == a["x"][:-1]) & (a["band"][1:] == a["band"][:-1]) & (a["y"][1:] == a["y"][:-1] + 1)
    with np.errstate(invalid="ignore"):
        diff = np.where(follows, v - np.r_[0.0, v[:-1]], 0.0)
    diff[~np.isfinite(diff)] = 0.0
    return follows, diff


def _prepare(tiles: list[list[dict]]) -> pa.RecordBatch:
    """Step 1, over whole tiles."""
    k, a = readings(tiles)
    tile = np.array([rows[0]["tile"] for rows in tiles], np.int64)
    n = len(k)
    follows, _ = _differences(k, a)
    v = a["value"]
    starts = np.flatnonzero(~(follows & (np.r_[np.nan, v[:-1]] == v))) if n else np.zeros(0, int)
    length = np.diff(np.r_[starts, n])
    run = np.minimum(np.repeat(length, length), RUN).astype(np.int8)
    own = (a["y"].astype(np.int64) // LINES) == (tile[k] >> 32)
    k, run, a = k[own], run[own], {c: x[own] for c, x in a.items()}
    v, diff = a["value"], _differences(k, a)[1]
    ok = (v >= LOW) & (v <= HIGH)
    nb = int(a["band"].max()) + 1 if len(k) else 1
    group = (k * nb + a["band"])[ok]
    groups, med = _group_median(group, v[ok])
    dev = np.abs(v[ok] - med[np.searchsorted(groups, group)])
    _, mad = _group_median(group, dev)
    prio = _mix(a["y"], a["x"], a["band"])
    pool = np.lexsort((prio[ok], k[ok]))
    pool_k = k[ok][pool]
    rank = np.arange(len(pool)) - np.searchsorted(pool_k, pool_k)
    pool, pool_k = np.flatnonzero(ok)[pool][rank < POOL], pool_k[rank < POOL]

    every = np.arange(len(tiles) + 1)
    bounds, at, pools = np.searchsorted(k, every), np.searchsorted(groups, every * nb), np.searchsorted(pool_k, every)
    out = {c: [] for c in ("scene", "tile", "n", "cells", "stats", "pool")}
    for i, rows in enumerate(tiles):
        s, g, p = slice(bounds[i], bounds[i + 1]), slice(at[i], at[i + 1]), pool[pools[i] : pools[i + 1]]
        if s.stop == s.start:
            continue
        out["scene"].append(rows[0]["scene"])
        out["tile"].append(rows[0]["tile"])
        out["n"].append(s.stop - s.start)
        out["cells"].append(pack_arrays(y=a["y"][s], x=a["x"][s], band=a["band"][s], run=run[s], value=v[s]))
        out["stats"].append(pack_arrays(band=(groups[g] - i * nb).astype("<i4"), median=med[g], mad=mad[g]))
        out["pool"].append(pack_arrays(prio=prio[p], band=a["band"][p], run=run[p], value=v[p], diff=diff[p]))
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds)], names=list(out))


def _unpacked(rows: DataFrame, column: str, schema: str, f) -> DataFrame:
    """scene, tile and the columns that f makes of the packed arrays in a column."""

    def run(batches):
        for batch in batches:
            for scene, tile, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                a = f(blob)
                n = len(next(iter(a.values())))
                yield pa.RecordBatch.from_arrays([pa.array([scene] * n, pa.string()), pa.array([tile] * n, pa.int64()), *(pa.array(x) for x in a.values())], names=["scene", "tile", *a])

    return rows.select("scene", "tile", column).mapInArrow(run, f"scene string, tile bigint, {schema}")


def _value_counts(blob: bytes) -> dict[str, np.ndarray]:
    a = unpack_arrays(blob, **_FEATURED)
    ok = (a["value"] >= LOW) & (a["value"] <= HIGH)
    code, n = np.unique(a["band"][ok].astype(np.int64) << 32 | np.rint(a["value"][ok] / GRID).astype(np.int64), return_counts=True)
    return {"band": (code >> 32).astype(np.int32), "bin": (code & 0xFFFFFFFF).astype(np.int32), "n": n.astype(np.int32)}


def _profiles(rows: DataFrame) -> DataFrame:
    """scene, stats, pool of scenes with several tiles."""
    hist = _unpacked(rows, "cells", "band int, bin int, n int", _value_counts).groupBy("scene", "band", "bin").agg(F.sum("n").alias("n"))

    def median_of(counts: DataFrame, value: str) -> DataFrame:
        w = Window.partitionBy("scene", "band")
        run = counts.withColumns({"upto": F.sum("n").over(w.orderBy(value)), "total": F.sum("n").over(w)})
        low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
        return run.groupBy("scene", "band").agg(
            ((F.min(F.when(F.col("upto") > low, F.col(value))) + F.min(F.when(F.col("upto") > high, F.col(value)))) / 2).alias("median")
        )

    medians = median_of(hist, "bin")
    away = hist.join(medians, ["scene", "band"]).groupBy("scene", "band", F.abs(F.col("bin") - F.col("median")).alias("away")).agg(F.sum("n").alias("n"))
    mads = median_of(away, "away").withColumnRenamed("median", "mad")
    stats = medians.join(mads, ["scene", "band"]).groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("band", "median", "mad"))).alias("s"))

    pool = _unpacked(rows, "pool", "prio bigint, band int, run tinyint, value double, diff double", lambda blob: unpack_arrays(blob, **_POOL))
    order = ["prio", "band", "run", "value", "diff"]
    part = Window.partitionBy("scene", F.pmod(F.xxhash64("tile"), F.lit(256))).orderBy(*order)
    whole = Window.partitionBy("scene").orderBy(*order)
    pool = pool.withColumn("r", F.row_number().over(part)).where(F.col("r") <= POOL).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= POOL)
    pools = pool.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("p"))

    def repack(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                s, p = r["s"], r["p"]
                column = lambda rows, c, t: np.array([x[c] for x in rows], t)
                stats = pack_arrays(band=column(s, "band", "<i4"), median=column(s, "median", "<f8") * GRID, mad=column(s, "mad", "<f8") * GRID)
                out.append((r["scene"], stats, pack_arrays(**{c: column(p, c, t) for c, t in _POOL.items()})))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["scene", "stats", "pool"])

    return stats.join(pools, "scene").mapInArrow(repack, "scene string, stats binary, pool binary")


def _features(stat: dict[str, np.ndarray], band, value, diff, run) -> np.ndarray:
    """Rows of level, difference, season, run length; all but the last in robust deviations, cut at CLIP.

    A reading fails the exact check just where its season is beyond 10: (10 * 1.4826 * mad + 1e-12) / (1.4826 * mad + 1e-13).
    """
    i = np.minimum(np.searchsorted(stat["band"], band), len(stat["band"]) - 1)
    med, scale = stat["median"][i], 1.4826 * stat["mad"][i] + 1e-13
    centre = np.median(stat["median"])
    spread = 1.4826 * np.median(np.abs(stat["median"] - centre)) + 1.4826 * np.median(stat["mad"]) + 1e-9
    f = np.stack([(value - centre) / spread, diff / scale, (value - med) / scale, run], 1)
    return np.clip(f, -CLIP, CLIP).astype(np.float32)


def _average_path(n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1).astype(np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def _draws(seeds: np.ndarray, salt: int, *shape: int) -> np.ndarray:
    """Numbers in [0, 1) for every source, of the given shape, that depend on its seed and the salt alone."""
    n = int(np.prod(shape))
    which = np.arange(n, dtype=np.int64) + (salt << 32)
    h = _mix(np.repeat(seeds, n), np.tile(which, len(seeds)))
    return (h / 2.0**63).reshape(len(seeds), *shape)


def grow(pools: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Isolation forests of many sources at once. pools: (sources, POOL, features); seeds: a whole number per source.

    Returns feature and limit of the inner nodes (sources, TREES, 2^DEPTH) in heap order from 1, the path lengths of the
    leaves, and per source the least score of a reading whose seasonal feature is beyond FAR. Each tree gets SAMPLE readings
    of the pool; a node splits a random feature at a random place between the limits of its readings, padded on both sides
    by their range and half a unit at least.
    """
    s, size, nf = pools.shape
    pick = np.minimum((_draws(seeds, 1, TREES * SAMPLE) * size).astype(np.int64), size - 1)
    x = np.take_along_axis(pools, pick[:, :, None], 1).reshape(s * TREES, SAMPLE, nf)
    trees = s * TREES
    feature, limit = np.zeros((trees, 2**DEPTH), np.int32), np.zeros((trees, 2**DEPTH), np.float32)
    node = np.ones((trees, SAMPLE), np.int64)
    path, base = np.full((trees, 2), -1.0), np.arange(trees)[:, None] * 2 ** (DEPTH + 1)
    low, high = np.full((trees, 1), -np.inf, np.float32), np.full((trees, 1), np.inf, np.float32)  # seasons that reach a node
    for depth in range(DEPTH):
        m = 2**depth
        count = np.bincount((base + node).ravel(), minlength=trees * 2 ** (DEPTH + 1)).reshape(trees, -1)[:, m : 2 * m]
        path = np.where((path < 0) & (count <= 1), depth, path) if depth else np.full((trees, 1), -1.0)
        f = np.minimum(np.searchsorted(np.cumsum(WEIGHTS), _draws(seeds, 2 + 2 * depth, TREES, m), "right"), nf - 1).reshape(trees, m)
        here = node - m
        v = np.take_along_axis(x, np.take_along_axis(f, here, 1)[:, :, None], 2)[:, :, 0]
        flat = (np.arange(trees)[:, None] * m + here).ravel()
        lo, hi = np.full(trees * m, np.inf, np.float32), np.full(trees * m, -np.inf, np.float32)
        np.minimum.at(lo, flat, v.ravel())
        np.maximum.at(hi, flat, v.ravel())
        lo, hi = lo.reshape(trees, m), hi.reshape(trees, m)
        empty = lo > hi
        lo, hi = np.where(empty, 0, lo), np.where(empty, 0, hi)
        pad = np.maximum(hi - lo, 0.5)
        cut = (lo - pad + _draws(seeds, 3 + 2 * depth, TREES, m).reshape(trees, m) * (hi - lo + 2 * pad)).astype(np.float32)
        feature[:, m : 2 * m], limit[:, m : 2 * m] = f, cut
        node = 2 * node + (v >= np.take_along_axis(cut, here, 1))
        path = np.repeat(path, 2, 1)
        season = f == SEASON
        below, above = np.where(season, np.minimum(high, cut), high), np.where(season, np.maximum(low, cut), low)
        low, high = np.stack([low, above], 2).reshape(trees, -1), np.stack([below, high], 2).reshape(trees, -1)
    count = np.bincount((base + node).ravel(), minlength=trees * 2 ** (DEPTH + 1)).reshape(trees, -1)[:, 2**DEPTH :]
    path = np.where(path < 0, DEPTH + _average_path(count), path).astype(np.float32)
    reached = (low < high) & ((high > _BEYOND) | (low <= -_BEYOND))
    longest = np.where(reached, path, 0).max(1).reshape(s, TREES).sum(1)
    return feature.reshape(s, TREES, -1), limit.reshape(s, TREES, -1), path.reshape(s, TREES, -1), _as_score(longest) * (1 - 1e-5)


def _as_score(total: np.ndarray) -> np.ndarray:
    return np.exp2(-total / TREES / _average_path(np.array([SAMPLE]))[0]).astype(np.float32)


def score(forest: tuple[np.ndarray, ...], source: np.ndarray, x: np.ndarray, block: int = 32768) -> np.ndarray:
    """Isolation score of each row of x by the forest of its source: near 1 alone, under 0.5 ordinary."""
    feature, limit, path = (a.reshape(-1) for a in forest[:3])
    nf, inner = x.shape[1], 2**DEPTH
    out = np.empty(len(x), np.float32)
    for start in range(0, len(x), block):
        part = np.ascontiguousarray(x[start : start + block]).reshape(-1)
        n = len(part) // nf
        row = np.arange(n, dtype=np.int32) * np.int32(nf)
        first = source[start : start + n].astype(np.int32) * np.int32(TREES * inner)
        total = np.zeros(n, np.float32)
        for t in range(TREES):
            base = first + np.int32(t * inner)
            node = np.ones(n, np.int32)
            for _ in range(DEPTH):
                at = base + node
                node += node
                node += part.take(row + feature.take(at)) >= limit.take(at)
            total += path.take(base + node - np.int32(inner))
        out[start : start + n] = total
    return _as_score(out)


def _judge(all_scores: bool):
    """Step 3, over whole tiles: rows of flagged readings, or of all."""

    def run(tiles: list[list[dict]]) -> pa.RecordBatch:
        cells, stats, pools, names = [], [], [], []
        for rows in tiles:
            own = next(r for r in rows if r["cells"] is not None)
            whole = next((r for r in rows if r["scene_stats"] is not None), None)  # the profile of all the scene's tiles
            cells.append(unpack_arrays(own["cells"], **_FEATURED))
            names.append(own["scene"])
            stat = unpack_arrays(whole["scene_stats"] if whole else own["stats"], **_STATS)
            stats.append(stat if len(stat["band"]) else {"band": np.zeros(1, "<i4"), "median": np.zeros(1), "mad": np.full(1, np.inf)})
            pool = unpack_arrays(whole["scene_pool"] if whole else own["pool"], **_POOL)
            f = _features(stats[-1], pool["band"], pool["value"], pool["diff"], pool["run"])
            pools.append(f[np.arange(POOL) % len(f)] if len(f) else np.zeros((POOL, 4), np.float32))
        forest = grow(np.stack(pools), np.array([zlib.crc32(name.encode()) for name in names], np.int64))
        source = np.concatenate([np.full(len(c["y"]), i) for i, c in enumerate(cells)])
        a = {k: np.concatenate([c[k] for c in cells]) for k in _FEATURED}
        diff = np.split(_differences(source, a)[1], np.cumsum([len(c["y"]) for c in cells])[:-1])
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.concatenate([_features(s, c["band"], np.nan_to_num(c["value"], posinf=1e9, neginf=-1e9), d, c["run"]) for s, c, d in zip(stats, cells, diff)])
        marks = score(forest, source, x)
        v = a["value"]
        # the exact check of the candidates
        stat_of = [(np.minimum(np.searchsorted(s["band"], c["band"]), len(s["band"]) - 1)) for s, c in zip(stats, cells)]
        med = np.concatenate([s["median"][i] for s, i in zip(stats, stat_of)])
        mad = np.concatenate([s["mad"][i] for s, i in zip(stats, stat_of)])
        kind = np.zeros(len(v), np.int8)
        with np.errstate(invalid="ignore"):
            kind[(marks >= forest[3][source]) & (np.abs(v - med) > FAR * mad + 1e-12)] = 3
        kind[a["run"] >= RUN] = 2
        kind[~((v >= LOW) & (v <= HIGH))] = 1
        keep = np.arange(len(v)) if all_scores else np.flatnonzero(kind)
        label = pa.DictionaryArray.from_arrays(pa.array(kind[keep].astype(np.int8)), pa.array(["none", "impossible", "stuck", "spike"])).cast(pa.string())
        scene = pa.DictionaryArray.from_arrays(pa.array(source[keep].astype(np.int32)), pa.array(names)).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [scene, *(pa.array(a[c][keep]) for c in ("y", "x", "band")), pa.array(v[keep]), pa.array(marks[keep].astype(np.float64)), pa.array(forest[3][source[keep]].astype(np.float64)), label],
            names=["scene", "y", "x", "band", "value", "score", "threshold", "kind"],
        )

    return run


def flag_readings(cells: DataFrame, all_scores: bool = False) -> DataFrame:
    """scene, y, x, band, value, score, threshold, kind of the faulty readings; with all_scores of every reading (kind ``none``).

    The prepared tiles are written to the checkpoint folder, since profiles and scores both read them.
    """
    packed = together(pack(cells, LINES, SAMPLES, BANDS, halo=RUN - 1))
    prepared = checkpointed(by_tile(packed, _prepare, "scene string, tile bigint, n int, cells binary, stats binary, pool binary"))
    several = prepared.groupBy("scene").agg(F.count("*").alias("c")).where("c > 1").select("scene")
    n = several.count()
    none = F.lit(None).cast("binary")
    if n == 0:
        rows = prepared.withColumns({"scene_stats": none, "scene_pool": none})
    else:
        theirs = prepared.join(broadcast_if_small(several, n, 64), "scene", "left_semi")
        profiles = _profiles(theirs).withColumnsRenamed({"stats": "scene_stats", "pool": "scene_pool"})
        if n * _PROFILE_BYTES <= BROADCAST_BYTES:
            rows = prepared.join(F.broadcast(profiles), "scene", "left")
        else:
            to_tiles = theirs.select("scene", "tile").join(profiles, "scene").withColumn("n", F.lit(0))
            rows = together(prepared.unionByName(to_tiles, allowMissingColumns=True))
    return by_tile(rows, _judge(all_scores), "scene string, y int, x int, band int, value double, score double, threshold double, kind string")
