"""Cube readings packed by tile: the layout that keeps billions of cells cheap to shuffle.

A reading is a row of some 40 bytes; most of a shuffle of readings is row overhead. ``pack`` gathers, map-side, the
readings of a tile (scene, block of lines, block of samples, block of bands) of each input batch into one compressed
binary row. A tile has at most lines * samples * bands cells, whatever the size of the scene, so that a scene which holds
a third of all rows is spread over many tiles. ``together`` brings the rows of a tile into one partition, in order;
``by_tile`` streams them through Arrow, some hundred thousand cells at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CODEC = "zstd"
#: Cells that are worked on at once.
BATCH = 400_000
#: Bits of a tile's number for the block of samples and the block of bands.
_XB, _BB = 20, 12


#: Decimal places that are tried before a column of doubles is kept as it is.
_PLACES = (0, 2, 4, 6)
_NAN, _INF = -(2**31), 2**31 - 1


def _as_decimals(v: np.ndarray) -> tuple[int, np.ndarray]:
    """(places, whole numbers) if every double is exactly a number of so few places, else (-1, v). Lossless."""
    finite = np.isfinite(v)
    w = v if finite.all() else np.where(finite, v, 0.0)
    if len(w) and np.abs(w).max() < 1000:
        for places in _PLACES:
            q = np.rint(w * 10.0**places)
            if not (q / 10.0**places == w).all() or (np.signbit(w) & (w == 0)).any():
                continue
            if w is not v:
                q[np.isnan(v)], q[v == np.inf], q[v == -np.inf] = _NAN, _INF, -_INF
            return places, q.astype("<i4")
    return -1, v


def pack_arrays(**arrays: np.ndarray) -> bytes:
    """Arrays of one length, one after the other, compressed. The caller knows the types and the order."""
    head, parts = b"", []
    for a in arrays.values():
        if a.dtype == np.float64:
            places, a = _as_decimals(a)
            head += bytes([places + 1])
        parts.append(np.ascontiguousarray(a).tobytes())
    raw = b"".join(parts)
    n = len(next(iter(arrays.values())))
    return n.to_bytes(4, "little") + len(raw).to_bytes(8, "little") + head + (pa.compress(raw, codec=_CODEC, asbytes=True) if raw else b"")


def unpack_arrays(blob: bytes, **types: str) -> dict[str, np.ndarray]:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:12], "little")
    doubles = [c for c, t in types.items() if t == "<f8"]
    places = {c: blob[12 + i] - 1 for i, c in enumerate(doubles)}
    raw = pa.decompress(blob[12 + len(doubles) :], decompressed_size=size, codec=_CODEC, asbytes=True) if size else b""
    out, at = {}, 0
    for c, t in types.items():
        kind = "<i4" if places.get(c, -1) >= 0 else t
        a = np.frombuffer(raw, kind, n, at)
        at += a.nbytes
        if kind != t:
            odd = np.flatnonzero((a == _NAN) | (a == _INF) | (a == -_INF))
            whole, a = a, a / 10.0 ** places[c]
            a[odd] = np.where(whole[odd] == _NAN, np.nan, np.where(whole[odd] > 0, np.inf, -np.inf))
        out[c] = a
    return out


CELL = {"y": "<i4", "x": "<i4", "band": "<i4", "day": "<i4", "value": "<f8"}


def tile_of(y, x, band, lines: int, samples: int, bands: int):
    """Number of the tile; works on numbers, numpy arrays and, with integer columns, on nothing else."""
    return ((y // lines) << (_XB + _BB)) + ((x // samples) << _BB) + band // bands


def pack(cells: DataFrame, lines: int = 512, samples: int = 32, bands: int = 16, halo: int = 0) -> DataFrame:
    """scene, tile, n, cells: readings with a position, packed. halo: lines at a tile's edge that the next one also gets.

    Rows without scene, y, x or band have no place and are left out; a null value becomes NaN. A missing load_date
    counts as the latest.
    """

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        names = t.column("scene").chunk(0).dictionary_encode()
        a = {k: t.column(k).chunk(0).to_numpy(zero_copy_only=False) for k in ("y", "x", "band", "day", "value")}
        code = names.indices.to_numpy().astype(np.int64)
        tile = tile_of(a["y"].astype(np.int64), a["x"], a["band"], lines, samples, bands)
        if halo:
            at = a["y"] % lines
            extra = [(np.flatnonzero((at < halo) & (a["y"] >= lines)), -1), (np.flatnonzero(at >= lines - halo), 1)]
            pick = np.concatenate([np.arange(len(code)), *(i for i, _ in extra)])
            shift = np.concatenate([np.zeros(len(code), np.int64), *(np.full(len(i), d) for i, d in extra)])
            if len(pick) > len(code):
                a, code, tile = {k: v[pick] for k, v in a.items()}, code[pick], tile[pick] + (shift << (_XB + _BB))
        order = np.lexsort((tile, code))
        code, tile = code[order], tile[order]
        edges = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tile[1:] != tile[:-1]), True])
        a = {k: v[order].astype(CELL[k]) for k, v in a.items()}
        scene = names.dictionary.take(pa.array(code[edges[:-1]]))
        blobs = [pack_arrays(**{k: v[i:j] for k, v in a.items()}) for i, j in zip(edges[:-1], edges[1:])]
        for i in range(0, len(blobs), 1000):
            part = slice(i, i + 1000)
            yield pa.RecordBatch.from_arrays(
                [scene[i : i + 1000].cast(pa.string()), pa.array(tile[edges[:-1]][part]), pa.array(np.diff(edges)[part].astype(np.int32)), pa.array(blobs[part], pa.binary())],
                names=["scene", "tile", "n", "cells"],
            )

    day = F.coalesce(F.unix_date("load_date"), F.lit(2**31 - 1)) if "load_date" in cells.columns else F.lit(0)
    placed = cells.where("scene IS NOT NULL AND y >= 0 AND x >= 0 AND band >= 0").select(
        "scene", F.col("y").cast("int"), F.col("x").cast("int"), F.col("band").cast("int"), day.cast("int").alias("day"),
        F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"),
    )
    return placed.mapInArrow(to_rows, "scene string, tile bigint, n int, cells binary")


def together(rows: DataFrame, *then: str) -> DataFrame:
    """All rows of a tile in one partition, one after the other, within a tile in the order of ``then``."""
    return rows.repartition("scene", "tile").sortWithinPartitions("scene", "tile", *then)


def by_tile(rows: DataFrame, f: Callable[[list[list[dict]]], pa.RecordBatch], schema: str) -> DataFrame:
    """f over lists of whole tiles, each the list of its rows, of some BATCH cells. rows: from ``together``, with n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: list[list[dict]] = []
        key, n = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if (row["scene"], row["tile"]) != key:
                    if n >= BATCH:
                        yield f(tiles)
                        tiles, n = [], 0
                    key = (row["scene"], row["tile"])
                    tiles.append([])
                tiles[-1].append(row)
                n += row["n"] or 0
        if tiles:
            yield f(tiles)

    return rows.mapInArrow(run, schema)


def readings(tiles: list[list[dict]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(number of the tile in the list, its readings) of all packed rows, missing values left out, each position once.

    Ordered by tile, sample, band, line. Of repeated deliveries the earliest with a value stays.
    """
    parts = [(k, unpack_arrays(r["cells"], **CELL)) for k, rows in enumerate(tiles) for r in rows if r["cells"] is not None]
    if not parts:
        return np.zeros(0, np.int64), {k: np.zeros(0, t) for k, t in CELL.items()}
    k = np.concatenate([np.full(len(a["y"]), k) for k, a in parts])
    a = {c: np.concatenate([p[c] for _, p in parts]) for c in CELL}
    there = ~np.isnan(a["value"])
    if not there.all():
        k, a = k[there], {c: v[there] for c, v in a.items()}
    if not len(k):
        return k, a
    y = a["y"].astype(np.int64)
    low = np.full(len(tiles), 2**31 - 1, np.int64)
    np.minimum.at(low, k, y)
    y -= low[k]  # lines within the tile: a small number
    nb, ny = int(a["band"].max()) + 1, int(y.max()) + 1
    code = ((k * (int(a["x"].max()) + 1) + a["x"]) * nb + a["band"]) * ny + y
    order = np.lexsort((a["day"], code)) if a["day"].any() else np.argsort(code, kind="stable")
    code = code[order]
    order = order[np.r_[True, code[1:] != code[:-1]]]
    return k[order], {c: v[order] for c, v in a.items()}
