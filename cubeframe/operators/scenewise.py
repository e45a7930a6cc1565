"""Models fitted to every scene on its own, whatever its number of bands: components, minimum noise fraction, k-means.

Readings travel as blocks: all bands and samples of a few lines of a scene as one matrix in one row, so that a scene which
holds a third of all readings is many blocks. A fit adds up one small row per block, by scene; its result stays a
DataFrame with one row per scene and is joined back to the blocks. Nothing reaches the driver but counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from cubeframe.operators import models
from cubeframe.operators.cells import CELL, by_tile, pack, pack_arrays, together, unpack_arrays
from cubeframe.session import broadcast_if_small, checkpointed

#: Lines of a block; a block has also the line after its last, for differences of neighbours.
LINES = 32
_WIDE = 2**30
_PLACE = {"y": "<i4", "x": "<i4"}
_BLOCK = "scene string, tile bigint, first int, n int, bands array<int>, place binary, matrix binary"


def _matrices(lines: int):
    def run(tiles: list[list[dict]]) -> pa.RecordBatch:
        out = []
        for rows in tiles:
            parts = [unpack_arrays(r["cells"], **CELL) for r in rows]
            a = {c: np.concatenate([p[c] for p in parts]) for c in ("y", "x", "band", "value")}
            there = ~np.isnan(a["value"])
            a = {c: v[there] for c, v in a.items()}
            if not len(a["y"]):
                continue
            bands, b = np.unique(a["band"], return_inverse=True)
            place, p = np.unique(a["y"].astype(np.int64) << 32 | a["x"], return_inverse=True)
            m = np.full((len(place), len(bands)), -np.inf)
            np.maximum.at(m, (p, b), a["value"])  # of repeated deliveries the largest, as in frame.valid_cells
            m[m == -np.inf] = np.nan
            first = (rows[0]["tile"] >> 32) * lines
            at = {"y": (place >> 32).astype("<i4"), "x": (place & 0xFFFFFFFF).astype("<i4")}
            out.append((rows[0]["scene"], rows[0]["tile"], first, len(place), bands.tolist(), pack_arrays(**at), pack_arrays(v=m.ravel())))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        cols = list(zip(*out)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[f.split()[0] for f in _BLOCK.split(", ")])

    return run


class Blocks:
    """Finite readings (scene, y, x, band, value) as blocks, kept until the caller clears the cache."""

    def __init__(self, cells: DataFrame, lines: int | None = None):
        self.lines = lines or LINES
        packed = together(pack(cells.select("scene", "y", "x", "band", "value"), self.lines, _WIDE, _WIDE, halo=1))
        rows = by_tile(packed, _matrices(self.lines), _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
        bands = F.array_sort(F.array_distinct(F.flatten(F.collect_set("bands")))).alias("scene_bands")
        scenes = rows.groupBy("scene").agg(bands, F.count("*").alias("blocks"))
        self.n, self.bands = scenes.agg(F.count("*"), F.coalesce(F.max(F.size("scene_bands")), F.lit(0))).first()
        self.rows = self.with_scenes(scenes, 1, rows)

    def with_scenes(self, per_scene: DataFrame, doubles: int, rows: DataFrame | None = None) -> DataFrame:
        """Blocks joined with a row per scene that has so many doubles a band."""
        return (self.rows if rows is None else rows).join(broadcast_if_small(per_scene, self.n, 100 + 8 * doubles * self.bands), "scene")


def _whole(row: dict, lines: int, halo: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, spectra) of a block's pixels that have every band of their scene."""
    at, m = unpack_arrays(row["place"], **_PLACE), unpack_arrays(row["matrix"], v="<f8")["v"].reshape(row["n"], -1)
    keep = ~np.isnan(m).any(1) if len(row["bands"]) == len(row["scene_bands"]) else np.zeros(row["n"], bool)
    keep &= (at["y"] >= row["first"]) & (at["y"] < row["first"] + lines + halo)
    return at["y"][keep], at["x"][keep], m[keep]


def _map(rows: DataFrame, f: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """f over rows, each giving tuples of the schema."""
    to = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                out = [t for row in batch.slice(i, 200).to_pylist() for t in f(row)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), to.types)], schema=to)

    return rows.mapInArrow(run, schema)


def _by_scene(rows: DataFrame, f: Callable[[str, list[dict]], tuple], schema: str) -> DataFrame:
    """f over all rows of a scene, ordered by tile: a small row per block."""
    to = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), to.types)], schema=to)

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["scene"] != row["scene"]:
                    out.append(f(held[0]["scene"], held))
                    held = []
                    if len(out) >= 1000:
                        yield batch_of()
                        out = []
                held.append(row)
        if held:
            out.append(f(held[0]["scene"], held))
        if out:
            yield batch_of()

    return rows.repartition("scene").sortWithinPartitions("scene", "tile").mapInArrow(run, schema)


def _gram(x: np.ndarray) -> np.ndarray:
    z = np.hstack([np.ones((len(x), 1)), x])
    return z.T @ z


def _fit(blocks: Blocks, noise: bool, solve: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """scene, mean, components (row by row): solve gets the sums of spectra and of differences of neighbours."""
    lines = blocks.lines

    def sums(row: dict) -> Iterator[tuple]:
        y, x, m = _whole(row, lines, halo=True)
        own = y < row["first"] + lines
        if not own.any():
            return
        d = np.zeros((0, m.shape[1]))
        if noise:
            code = y.astype(np.int64) << 32 | x
            parts = []
            for step, ok in ((1, own), (1 << 32, own)):
                at = np.minimum(np.searchsorted(code, code + step), len(code) - 1)
                pair = ok & (code[at] == code + step)
                parts.append(m[at[pair]] - m[pair])
            d = np.concatenate(parts)
        yield row["scene"], row["tile"], _gram(m[own]).ravel().tolist(), _gram(d).ravel().tolist() if noise else None

    def add(scene: str, rows: list[dict]) -> tuple:
        square = lambda k: np.sum([r[k] for r in rows], axis=0).reshape(int(len(rows[0][k]) ** 0.5), -1)
        mean, comp = solve(square("gram"), square("noise")) if noise else solve(square("gram"))
        return scene, mean.tolist(), comp.ravel().tolist()

    partial = _map(blocks.rows, sums, "scene string, tile bigint, gram array<double>, noise array<double>")
    return _by_scene(partial, add, "scene string, mean array<double>, components array<double>")


def _apply(blocks: Blocks, fitted: DataFrame, k: int) -> DataFrame:
    """scene, y, x, band (the component), value."""
    lines = blocks.lines

    def run(row: dict) -> Iterator[tuple]:
        y, x, m = _whole(row, lines)
        if len(y):
            v = (m - np.array(row["mean"])) @ np.array(row["components"]).reshape(m.shape[1], -1)
            yield row["scene"], y.tolist(), x.tolist(), v.tolist()

    out = _map(blocks.with_scenes(fitted, k + 1), run, "scene string, y array<int>, x array<int>, v array<array<double>>")
    z = out.select("scene", F.explode(F.arrays_zip("y", "x", "v")).alias("z"))
    return z.select("scene", "z.y", "z.x", F.posexplode("z.v").alias("band", "value"))


def pca(blocks: Blocks, n_components: int) -> DataFrame:
    """scene, y, x, band, value: scores of the scene's own principal components; not more than its bands."""
    return _apply(blocks, _fit(blocks, False, lambda g: models.pca_of(g, n_components)[:2]), n_components)


def mnf(blocks: Blocks, n_components: int | None = None) -> DataFrame:
    """scene, y, x, band, value: the scene's own minimum noise fractions."""
    return _apply(blocks, _fit(blocks, True, lambda g, d: models.mnf_of(g, d, n_components)[:2]), n_components or blocks.bands)


# k-means


def _uniform(scene: str, y: np.ndarray, x: np.ndarray, *salt: int) -> np.ndarray:
    """A number in (0, 1) per pixel that depends on nothing but the pixel and the salt."""
    h = (y.astype(np.uint64) << np.uint64(32) | x.astype(np.uint64)) ^ np.uint64(zlib.crc32(repr((scene, *salt)).encode()) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2**53


def _away(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, pixels by centres."""
    return ((z[:, None, :] - centres[None]) ** 2).sum(2)


def _sums(z: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(sums, counts, inertia) of the nearest pixels of every centre."""
    d = _away(z, centres)
    hot = d.argmin(1)[:, None] == np.arange(len(centres))
    return hot.T.astype(float) @ z, hot.sum(0).astype(float), float(d.min(1, initial=np.inf).sum()) if len(z) else 0.0


def _moved(centres: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)


def kmeans(blocks: Blocks, shadow_quantile: float = 0.1, k: int = 2, seed: int = 42, runs: int = 3, rounds: int = 300, tolerance: float = 1e-4) -> DataFrame:
    """scene, y, x, cluster: k-means of every scene on its own, over the normalised spectra of its bright pixels.

    Seeds are drawn in proportion to the squared distance (k-means++), ``runs`` times; the run of least inertia stays. Each
    round adds up sums and counts by scene and cluster; a scene has converged when its centres together move by less than
    the tolerance times the mean variance of its bands. A scene of one block converges in that block. A scene without a
    pixel brighter than its quantile has no cluster.
    """
    lines = blocks.lines

    def means(row: dict) -> Iterator[tuple]:
        m = _whole(row, lines)[2]
        if len(m):
            yield row["scene"], m.mean(1).tolist()

    of_pixels = _map(blocks.rows, means, "scene string, m array<double>").select("scene", F.explode("m").alias("m"))
    state = of_pixels.groupBy("scene").agg(F.percentile("m", F.lit(shadow_quantile)).alias("limit"))
    state = state.select("scene", "limit", F.lit(None).cast("array<double>").alias("centres"), F.lit(False).alias("done"))
    state = checkpointed(state)

    def bright(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, x, m = _whole(row, lines)
        keep = m.mean(1) > row["limit"] if len(m) else np.zeros(0, bool)
        m = m[keep]
        return y[keep], x[keep], (m - m.mean(1, keepdims=True)) / (m.std(1, keepdims=True) + 1e-8)

    def centres_of(row: dict, width: int) -> np.ndarray:
        return np.array(row["centres"] or []).reshape(runs, -1, width)

    for c in range(k):

        def candidate(row: dict, c: int = c) -> Iterator[tuple]:
            y, x, z = bright(row)
            if not len(y):
                return
            old, key, pick = centres_of(row, z.shape[1]), [], []
            for i in range(runs):
                weight = _away(z, old[i]).min(1) if c else np.ones(len(z))
                with np.errstate(divide="ignore"):
                    wait = -np.log(_uniform(row["scene"], y, x, seed, i, c)) / weight
                best = wait.argmin()
                key.append(float(wait[best]))
                pick.append(z[best].tolist())
            yield row["scene"], row["tile"], key, pick, row["limit"], row["centres"]

        def choose(scene: str, rows: list[dict]) -> tuple:
            width = len(rows[0]["pick"][0])
            new = [min(rows, key=lambda r: r["key"][i])["pick"][i] for i in range(runs)]
            return scene, rows[0]["limit"], np.concatenate([centres_of(rows[0], width), np.array(new)[:, None]], 1).ravel().tolist(), False

        drawn = _map(blocks.with_scenes(state, runs * k), candidate, "scene string, tile bigint, key array<double>, pick array<array<double>>, limit double, centres array<double>")
        state = checkpointed(_by_scene(drawn, choose, "scene string, limit double, centres array<double>, done boolean"))

    def assign(row: dict) -> Iterator[tuple]:
        y, _, z = bright(row)
        if not len(y):
            return
        now, square = centres_of(row, z.shape[1]), (z**2).sum(0)
        if row["blocks"] == 1:
            least = tolerance * z.var(0).mean()
            for i in range(runs):
                for _ in range(rounds - 1):
                    new = _moved(now[i], *_sums(z, now[i])[:2])
                    moved, now[i] = ((new - now[i]) ** 2).sum(), new
                    if moved <= least:
                        break
        s = [_sums(z, c) for c in now]
        yield (row["scene"], row["tile"], np.array([a for a, _, _ in s]).ravel().tolist(), np.array([n for _, n, _ in s]).ravel().tolist(), [e for _, _, e in s],
               square.tolist(), row["limit"], now.ravel().tolist(), row["blocks"] == 1)

    def update(scene: str, rows: list[dict]) -> tuple:
        add = lambda key: np.sum([r[key] for r in rows], axis=0)
        width = len(rows[0]["square"])
        old, counts = centres_of(rows[0], width), add("counts").reshape(runs, k)
        sums, total = add("sums").reshape(runs, k, width), counts[0].sum()
        new = np.array([_moved(o, s, n) for o, s, n in zip(old, sums, counts)])
        variance = add("square") / total - (sums[0].sum(0) / total) ** 2
        done = rows[0]["alone"] or bool(((new - old) ** 2).sum((1, 2)).max() <= tolerance * variance.mean())
        best = add("inertia").argmin()
        return scene, rows[0]["limit"], (new[best] if done else new).ravel().tolist(), done

    finished = None
    for _ in range(rounds):
        rows = _map(blocks.with_scenes(state, runs * k), assign, "scene string, tile bigint, sums array<double>, counts array<double>, inertia array<double>, square array<double>, limit double, centres array<double>, alone boolean")
        state = checkpointed(_by_scene(rows, update, "scene string, limit double, centres array<double>, done boolean"))
        ready, state = state.where("done"), state.where("NOT done")
        finished = ready if finished is None else finished.unionByName(ready)
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"k-means has not converged after {rounds} rounds")

    def label(row: dict) -> Iterator[tuple]:
        y, x, z = bright(row)
        if len(y):
            yield row["scene"], y.tolist(), x.tolist(), _away(z, np.array(row["centres"]).reshape(k, -1)).argmin(1).tolist()

    out = _map(blocks.with_scenes(finished, k), label, "scene string, y array<int>, x array<int>, cluster array<int>")
    return out.select("scene", F.explode(F.arrays_zip("y", "x", "cluster")).alias("z")).select("scene", "z.y", "z.x", "z.cluster")
