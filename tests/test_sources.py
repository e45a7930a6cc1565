import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeframe.plans.pipeline import ScenePipeline, combined, masked_samples
from cubeframe.sources import envi
from cubeframe.streaming import cubes

ORDER = {"bsq": (2, 0, 1), "bil": (0, 2, 1), "bip": (0, 1, 2)}


def write(folder, scene, cube, interleave="bil", code=4, extra="", name="_refl"):
    folder.mkdir(parents=True, exist_ok=True)
    h, w, b = cube.shape
    waves = ",\n ".join(str(400 + 10 * k) for k in range(b))
    (folder / f"{scene}{name}.hdr").write_text(f"ENVI\nsamples = {w}\nwavelength = {{\n {waves}}}\nlines = {h}\nBands = {b}\ndata type = {code}\ninterleave = {interleave}\n{extra}")
    cube.transpose(ORDER[interleave]).astype(envi.TYPES[code]).tofile(folder / f"{scene}{name}.RAW")


@pytest.mark.parametrize("interleave", list(ORDER))
@pytest.mark.parametrize("code", list(envi.TYPES))
def test_round_trip(spark, tmp_path, monkeypatch, interleave, code):
    monkeypatch.setattr(envi, "BLOCK_BYTES", 64)
    cube = np.random.default_rng(code).integers(0, 200, (5, 4, 3)).astype(float)
    write(tmp_path, "scene1", cube, interleave, code)
    spark.dataSource.register(envi.EnviSource)
    rows = spark.read.format("envi").option("scale", "false").load(str(tmp_path)).collect()
    assert len(rows) == 20 and all(r.scene == "scene1" and r.spectrum == cube[r.y, r.x].tolist() for r in rows)


def test_scale_pushdown_and_discovery(spark, tmp_path):
    cube = np.arange(24.0).reshape(4, 3, 2)
    write(tmp_path / "a", "scene1", cube)
    write(tmp_path / "b", "scene2", cube + 5, "bsq", 12)
    write(tmp_path / "b", "dark", cube, name="_raw")
    (tmp_path / "b" / "lonely_refl.hdr").write_text("samples = 1")
    assert [s for s, _, _ in envi.find_bases(str(tmp_path))] == ["scene1", "scene2"]
    spark.dataSource.register(envi.EnviSource)
    plain = spark.read.format("envi").load(str(tmp_path)).where("scene = 'scene2' AND y >= 2")
    want = sorted((r.y, r.x, tuple(r.spectrum)) for r in plain.collect())
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("envi").load(str(tmp_path)).where("scene = 'scene2' AND y >= 2")
        assert sorted((r.y, r.x, tuple(r.spectrum)) for r in pushed.collect()) == want
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert len(want) == 6 and abs(want[0][2][0] - np.float32(17) / 1e4) < 1e-9
    meta = {r.scene: r for r in envi.headers(spark, str(tmp_path)).where("scene <> 'lonely'").collect()}
    assert meta["scene1"].meta["bands"] == "2" and meta["scene1"].wavelengths == [400.0, 410.0]
    assert envi.parse_wavelengths("x\nwavelength = {1,\n2.5}\nfoo = 1") == [1.0, 2.5]
    with pytest.raises(ValueError):
        envi.Layout.of({"lines": "1", "samples": "1", "bands": "1"})


def test_mapping(spark):
    lines = spark.createDataFrame([("a=Alpha, b=Beta", 0), ("scene01: a, b, other", 1), ("scene02: b", 2), ("scene02: a,, c", 3), ("noise", 4)], "value string, n int")
    got = sorted(tuple(r) for r in envi.sample_mapping(lines, order="n").collect())
    assert got == [("scene01", 1, "Alpha"), ("scene01", 2, "Beta"), ("scene01", 3, "other"), ("scene02", 1, "Alpha"), ("scene02", 2, "c")]


def test_tiff(spark, tmp_path):
    cube = np.random.default_rng(1).random((3, 4, 2)).astype(np.float32)
    pix = spark.createDataFrame([("s", y, x, [float(v) for v in cube[y, x]]) for y in range(3) for x in range(4)], "scene string, y int, x int, spectrum array<double>")
    row = envi.write_tiff(pix, str(tmp_path / "out")).first()
    raw = open(row.path, "rb").read()
    at, pages = struct.unpack("<I", raw[4:8])[0], []
    while at:
        n = struct.unpack("<H", raw[at : at + 2])[0]
        tags = {t: v for t, _, _, v in (struct.unpack("<HHII", raw[at + 2 + 12 * i : at + 14 + 12 * i]) for i in range(n))}
        pages.append(np.frombuffer(raw, "<f4", tags[256] * tags[257], tags[273]).reshape(tags[257], tags[256]))
        at = struct.unpack("<I", raw[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    assert row.pages == 2 and np.array_equal(np.stack(pages, -1), cube)


def test_pipeline(spark, tmp_path):
    cube = np.full((30, 30, 3), 1000.0) + np.random.default_rng(2).random((30, 30, 3)) * 10
    cube[4:14, 4:12] += 6000
    cube[4:14, 18:26] += 6000
    write(tmp_path, "scene1", cube)
    mapping = spark.createDataFrame([("scene1", 1, "oak"), ("scene1", 2, "ash"), ("scene9", 1, "elm")], "scene string, ordinal int, species string")
    p = ScenePipeline(spark, str(tmp_path), mapping)
    rows = p.run(width=6, height=4, top_n=3, min_size=10, hole_size=5).collect()
    assert {r.label for r in rows} == {"oak", "ash"} and len(rows) == 2 * 24 * 3
    assert all(r.x < 14 for r in rows if r.label == "oak") and min(r.value for r in rows) > 0.5
    masks = p.masks(top_n=3, min_size=10, hole_size=5).withColumn("ordinal", F.lit(1))
    full = masked_samples(p.pixels, masks, mapping)
    assert full.count() == 900 and full.where("spectrum[0] > 0").count() == combined(masks).count() == 160


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 0, 0, [1.0, 2.0, 3.0])], "scene string, y int, x int, spectrum array<double>").write.parquet(str(src))
    stream = cubes.normalised(spark.readStream.schema("scene string, y int, x int, spectrum array<double>").parquet(str(src)))
    q = stream.writeStream.format("memory").queryName("snv").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert abs(sum(spark.table("snv").first().spectrum)) < 1e-9
    late = tmp_path / "late"
    spark.sql("SELECT timestamp'2025-01-01 00:00:00' AS loaded_at, 'a' AS scene, 0 AS band, 1.0D AS value UNION ALL SELECT timestamp'2025-01-05 00:00:00', 'a', 0, 3.0D").write.parquet(str(late))
    agg = cubes.windowed_stats(spark.readStream.schema("loaded_at timestamp, scene string, band int, value double").parquet(str(late)))
    q = agg.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("days").where("n = 1").count() >= 1
