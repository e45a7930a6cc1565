"""ENVI cubes: a header (.hdr) and a flat file (.raw) per scene, as a Spark data source.

    spark.dataSource.register(EnviSource)
    spark.read.format("envi").option("suffix", "_refl").load(folder)   # scene, y, x, spectrum

One task reads a block of lines of one file, whatever its interleave; nothing but headers is read on the driver. With
spark.sql.python.filterPushdown.enabled, equality on scene and comparisons on y reach the reader.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: ENVI's codes of number types (fixed values).
TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2"}
SCALE = 10000.0
#: Bytes of a cube that one task reads.
BLOCK_BYTES = 64 << 20


def parse_header(text: str) -> dict[str, str]:
    """Lower-case keys and values of ``key = value`` lines; a value in braces may span lines."""
    return {k.strip().lower(): v.strip() for k, v in re.findall(r"^([^=\n{}]+)=\s*(\{[^}]*\}|[^\n]*)", text, re.M)}


def parse_wavelengths(text: str) -> list[float]:
    braces = re.search(r"wavelength\s*=\s*\{([^}]*)\}", text)
    return [float(v) for v in braces.group(1).split(",") if v.strip()] if braces else []


@dataclass
class Layout:
    lines: int
    samples: int
    bands: int
    interleave: str
    dtype: np.dtype
    offset: int

    @classmethod
    def of(cls, meta: dict[str, str]) -> Layout:
        code = int(meta.get("data type", 0))
        if code not in TYPES:
            raise ValueError(f"data type {code} is not supported")
        interleave = meta.get("interleave", "bil").strip().lower()
        if interleave not in ("bil", "bsq", "bip"):
            raise ValueError(f"interleave {interleave} is not supported")
        dtype = np.dtype(TYPES[code]).newbyteorder(">" if meta.get("byte order", "0").strip() == "1" else "<")
        return cls(int(meta["lines"]), int(meta["samples"]), int(meta["bands"]), interleave, dtype, int(meta.get("header offset", 0)))

    def read(self, path: str, first: int, last: int) -> np.ndarray:
        """(lines, samples, bands) of a range of lines."""
        h, w, b, size = last - first, self.samples, self.bands, self.dtype.itemsize
        if self.interleave == "bsq":
            planes = [np.fromfile(path, self.dtype, h * w, offset=self.offset + size * w * (k * self.lines + first)) for k in range(b)]
            return np.stack(planes, -1).reshape(h, w, b)
        flat = np.fromfile(path, self.dtype, h * w * b, offset=self.offset + size * first * w * b)
        return flat.reshape(h, b, w).transpose(0, 2, 1) if self.interleave == "bil" else flat.reshape(h, w, b)


def find_bases(root: str, suffix: str = "_refl") -> list[tuple[str, str, str]]:
    """(scene, header, raw file) of every header whose lower-case name holds the suffix and that has a raw file beside it."""
    out = []
    for folder, _, files in sorted(os.walk(root)):
        by_name = {f.lower(): f for f in files}
        for f in sorted(files):
            low = f.lower()
            if low.endswith(".hdr") and suffix.lower() in low and (raw := by_name.get(low[:-4] + ".raw")):
                base = f[:-4]
                scene = base[: -len(suffix)] if base.lower().endswith(suffix.lower()) else base
                out.append((scene, os.path.join(folder, f), os.path.join(folder, raw)))
    names = [s for s, _, _ in out]
    return [(s if names.count(s) == 1 else os.path.join(os.path.relpath(os.path.dirname(h), root), s), h, r) for s, h, r in out]


@dataclass
class Lines(InputPartition):
    scene: str
    raw: str
    layout: Layout
    first: int
    last: int


class EnviReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.suffix = options["path"], options.get("suffix", "_refl")
        self.scaled = options.get("scale", "true").lower() == "true"
        self.scenes: set[str] | None = None
        self.low, self.high = 0, None

    def partitions(self) -> list[InputPartition]:
        out = []
        for scene, header, raw in find_bases(self.root, self.suffix):
            if self.scenes is not None and scene not in self.scenes:
                continue
            with open(header, encoding="utf-8", errors="replace") as f:
                layout = Layout.of(parse_header(f.read()))
            step = max(1, BLOCK_BYTES // max(1, layout.samples * layout.bands * layout.dtype.itemsize))
            end = layout.lines if self.high is None else min(layout.lines, self.high)
            out += [Lines(scene, raw, layout, i, min(i + step, end)) for i in range(max(0, self.low), end, step)]
        return out

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        rows = max(1, (1 << 20) // max(1, partition.layout.samples * partition.layout.bands))
        for first in range(partition.first, partition.last, rows):
            last = min(first + rows, partition.last)
            cube = partition.layout.read(partition.raw, first, last).astype(np.float64)
            cube = cube.astype(np.float32).astype(np.float64) / SCALE if self.scaled else cube
            h, w, b = cube.shape
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([partition.scene] * (h * w)),
                    pa.array(np.repeat(np.arange(first, last, dtype=np.int32), w)),
                    pa.array(np.tile(np.arange(w, dtype=np.int32), h)),
                    pa.ListArray.from_arrays(pa.array(np.arange(h * w + 1, dtype=np.int32) * b), pa.array(np.ascontiguousarray(cube).reshape(-1))),
                ],
                names=["scene", "y", "x", "spectrum"],
            )


class PushingEnviReader(EnviReader):
    """The reader where filters may be pushed down."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("scene",) and isinstance(f, EqualTo):
                self.scenes = {f.value} if self.scenes is None else self.scenes & {f.value}
            elif name == ("y",) and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), f.value + 1 if self.high is None else min(self.high, f.value + 1)
            elif name == ("y",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == ("y",) and isinstance(f, (LessThan, LessThanOrEqual)):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            yield f  # Spark checks every row again


class EnviSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "envi"

    def schema(self) -> str:
        return "scene string, y int, x int, spectrum array<double>"

    def reader(self, schema) -> DataSourceReader:
        spark = SparkSession.getActiveSession()
        push = self.options.get("pushdown") or (spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") if spark else "false")
        return (PushingEnviReader if push == "true" else EnviReader)(self.options)


def headers(spark: SparkSession, root: str, suffix: str = "_refl") -> DataFrame:
    """scene, meta, wavelengths of every header, read by Spark."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[hH][dD][rR]").format("binaryFile").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kept = texts.where(F.contains(F.lower(name), F.lit(suffix.lower()))).select(F.regexp_replace(name, f"(?i)({re.escape(suffix)})?[.]hdr$", "").alias("scene"), F.decode("content", "UTF-8").alias("text"))
    return kept.select("scene", meta_map(F.col("text")).alias("meta"), wavelength_array(F.col("text")).alias("wavelengths"))


def meta_map(text):
    """Column: header text to a map of lower-case keys; a later key wins."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?m)^([^=\n{}]+=\s*(?:\{[^}]*\}|[^\n]*))"), 1)
    entry = F.transform(pairs, lambda p: F.struct(F.lower(F.trim(F.split_part(p, F.lit("="), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v")))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def wavelength_array(text):
    """Column: the numbers within ``wavelength = { }``."""
    inside = F.regexp_extract(text, r"wavelength\s*=\s*\{([^}]*)\}", 1)
    return F.transform(F.filter(F.split(inside, ","), lambda v: F.trim(v) != ""), lambda v: F.trim(F.regexp_replace(v, r"\s", "")).try_cast("double"))


def sample_mapping(lines: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """scene, ordinal, species of mapping lines ``scene: a, b``; a line with ``=`` gives full names of abbreviations.

    Of repeated scenes the last line (by ``order``) holds. Abbreviations without a full name stay as they are.
    """
    has_names = F.contains(F.col(line), F.lit("=")) & ~F.contains(F.col(line), F.lit(":"))
    names = lines.where(has_names).select(F.explode(F.split(line, ",")).alias("p")).select(F.trim(F.split_part("p", F.lit("="), F.lit(1))).alias("_short"), F.trim(F.split_part("p", F.lit("="), F.lit(2))).alias("_full"))
    pair = F.split(F.col(line), ":", 2)
    at = F.col(order) if order else F.monotonically_increasing_id()
    of = lines.where(F.contains(F.col(line), F.lit(":"))).select(F.trim(pair[0]).alias("scene"), pair[1].alias("list"), at.alias("at"))
    last = of.groupBy("scene").agg(F.max_by("list", "at").alias("list"))
    rows = last.select("scene", F.posexplode(F.filter(F.transform(F.split("list", ","), lambda s: F.trim(s)), lambda s: s != "")).alias("p", "species"))
    full = rows.join(names.groupBy("_short").agg(F.first("_full").alias("_full")), F.col("species") == F.col("_short"), "left")
    return full.select("scene", (F.col("p") + 1).alias("ordinal"), F.coalesce("_full", "species").alias("species"))


def write_tiff(pixel: DataFrame, folder: str) -> DataFrame:
    """Write <folder>/<scene>.tif, a page of 32-bit floats per band; scene, path, pages of what was written.

    A scene is written by one task, band by band; missing pixels are NaN. For large scenes parquet is the sink.
    """

    def one(rows):
        cube = np.full((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1, len(rows["spectrum"].iloc[0])), np.nan, np.float32)
        cube[rows["y"].to_numpy(), rows["x"].to_numpy()] = np.stack(rows["spectrum"].to_numpy())
        scene = rows["scene"].iloc[0]
        path = os.path.join(folder, f"{scene}.tif")
        os.makedirs(folder, exist_ok=True)
        with open(path, "wb") as f:
            f.write(tiff_bytes(np.ascontiguousarray(cube.transpose(2, 0, 1))))
        import pandas as pd

        return pd.DataFrame({"scene": [scene], "path": [path], "pages": [cube.shape[2]]})

    return pixel.groupBy("scene").applyInPandas(one, "scene string, path string, pages int")


def tiff_bytes(stack: np.ndarray) -> bytes:
    """Baseline TIFF, little endian, one strip of float32 per page."""
    pages, h, w = stack.shape
    head, page, entries = 8, h * w * 4, 10
    ifd = 2 + entries * 12 + 4
    out = [struct.pack("<2sHI", b"II", 42, head + pages * page)]
    out += [stack[k].astype("<f4").tobytes() for k in range(pages)]
    for k in range(pages):
        # tag, type (3 short, 4 long), value: width, height, bits, compression, photometric, strip, samples, rows, bytes, float
        tags = [(256, 4, w), (257, 4, h), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, head + k * page), (277, 3, 1), (278, 4, h), (279, 4, page), (339, 3, 3)]
        after = head + pages * page + (k + 1) * ifd if k + 1 < pages else 0
        out.append(struct.pack("<H", entries) + b"".join(struct.pack("<HHII", t, kind, 1, v) for t, kind, v in tags) + struct.pack("<I", after))
    return b"".join(out)
