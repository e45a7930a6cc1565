"""Queries of the cube toolkit over cube_cells and its neighbours, and their SQL.

Numbers are rounded to nine places (angles and deviations of deviations to fewer) so that two engines agree.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe import frame
from cubeframe.functions import spectra as S
from cubeframe.operators import binning, cleaning, extract, masks, models, preprocess, regions, scenewise, spatial, stats
from cubeframe.plans import pipeline, plotdata
from cubeframe.session import table
from cubeframe.sources import envi

QUERIES, SQL = {}, {}

#: Added before rounding in both engines: means of 64 or 128 readings of four places end in a 5 at the tenth.
_OFF_TIES = 1.7e-11

#: The valid readings, each position once.
_D = """WITH d AS (SELECT scene, y, x, band, max(value) AS value FROM cube_cells WHERE value BETWEEN 0 AND 1.25 AND scene IS NOT NULL
AND y IS NOT NULL AND x IS NOT NULL AND band IS NOT NULL GROUP BY scene, y, x, band),
size AS (SELECT scene, max(y) + 1 AS height, max(x) + 1 AS width FROM d GROUP BY scene)"""
_STATS = "s AS (SELECT scene, band, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi FROM d GROUP BY scene, band)"
_MEANS = """w AS (SELECT scene, band, max(wavelength) AS wavelength FROM wavelengths WHERE wavelength IS NOT NULL GROUP BY scene, band),
m AS (SELECT scene, wavelength, avg(value) AS value FROM d JOIN w USING (scene, band) GROUP BY scene, wavelength)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r", (\d)\) \+ 0\.0", rf" + {_OFF_TIES}, \1) + 0.0", sql)
        return f

    return add


def r(c, places: int = 9):
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(_OFF_TIES), places) + F.lit(0.0)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.valid_cells(table(spark, sf_dir, "cube_cells"))


def mean_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, wavelength, value: mean spectrum of every scene."""
    w = table(spark, sf_dir, "wavelengths").where("wavelength IS NOT NULL").groupBy("scene", "band").agg(F.max("wavelength").alias("wavelength"))
    return cells(spark, sf_dir).groupBy("scene", "band").agg(F.avg("value").alias("value")).join(w, ["scene", "band"]).groupBy("scene", "wavelength").agg(F.avg("value").alias("value"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), "label", F.col("embedding").cast("array<double>").alias("spectrum"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, ordinal, label, y1, y2, x1, x2: regions with the species typed for their sample."""
    named = table(spark, sf_dir, "mapping").where("scene IS NOT NULL AND ordinal IS NOT NULL").groupBy("scene", "ordinal").agg(F.max(F.lower(F.trim("species"))).alias("label"))
    return table(spark, sf_dir, "regions").where("y1 IS NOT NULL AND y2 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL").join(named, ["scene", "ordinal"]).select("scene", "ordinal", "label", "y1", "y2", "x1", "x2").distinct()


_SAMPLES = """n AS (SELECT scene, ordinal, max(lower(trim(species, ' '))) AS label FROM mapping WHERE scene IS NOT NULL AND ordinal IS NOT NULL GROUP BY scene, ordinal),
q AS (SELECT DISTINCT scene, ordinal, label, y1, y2, x1, x2 FROM regions JOIN n USING (scene, ordinal) WHERE y1 IS NOT NULL AND y2 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL)"""


# base


@query(_D + """ SELECT scene, CAST(y // 5 AS INTEGER) AS y, CAST(x // 5 AS INTEGER) AS x, band, round(avg(value), 9) + 0.0 AS value FROM d JOIN size USING (scene)
WHERE y < height - height % 5 AND x < width - width % 5 GROUP BY ALL""")
def bu1_block_average(spark, sf_dir):
    return stats.block_average(cells(spark, sf_dir)).withColumn("value", r("value"))


@query(_D + ", " + _SAMPLES + """ SELECT label, d.scene, ordinal, y, x, count(*) AS bands, round(sum(value), 9) + 0.0 AS total FROM d JOIN q ON d.scene = q.scene
AND y >= y1 AND y < y2 AND x >= x1 AND x < x2 GROUP BY ALL""")
def bu2_sample_rows(spark, sf_dir):
    m = pipeline.sample_matrix(cells(spark, sf_dir), samples(spark, sf_dir))
    return m.groupBy("label", "scene", "ordinal", "y", "x").agg(F.count("*").alias("bands"), r(F.sum("value")).alias("total"))


@query(_D + ", " + _STATS + " SELECT scene, band, round(mean / (std + 1e-8), 4) + 0.0 AS snr FROM s")
def bu3_snr(spark, sf_dir):
    return stats.snr(cells(spark, sf_dir)).withColumn("snr", r("snr", 4))


@query(_D + """, l AS (SELECT scene, max(sensor) AS label FROM scenes GROUP BY scene HAVING max(sensor) IS NOT NULL), c AS (SELECT label, band, value FROM d JOIN l USING (scene)),
p AS (SELECT label, band, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM c GROUP BY label, band), g AS (SELECT band, avg(value) AS a FROM c GROUP BY band),
t AS (SELECT sum(n * v) AS within, sum(n * (m - a) * (m - a)) AS between_ FROM p JOIN g USING (band))
SELECT round(within, 5) + 0.0 AS within, round(between_, 5) + 0.0 AS between, round(between_ / within, 8) + 0.0 AS ratio FROM t""")
def bu4_class_variance_ratio(spark, sf_dir):
    label = table(spark, sf_dir, "scenes").groupBy("scene").agg(F.max("sensor").alias("label")).where("label IS NOT NULL")
    v = stats.class_variance_ratio(cells(spark, sf_dir).join(label, "scene"))
    return v.select(r("within", 5).alias("within"), r("between", 5).alias("between"), r("ratio", 8).alias("ratio"))


# cleaning

_BAD = _STATS + ", bad AS (SELECT d.*, value < 0.1 OR abs(value - mean) / (std + 1e-8) > 3 AS bad FROM d JOIN s USING (scene, band))"


@query(_D + ", " + _BAD + " SELECT scene, y, x, band FROM bad WHERE bad")
def cl1_bad_cells(spark, sf_dir):
    return cleaning.bad_cells(cells(spark, sf_dir)).where("NOT good").select("scene", "y", "x", "band")


_LINES = """c AS (SELECT scene, band, x, median(value) AS m FROM d GROUP BY ALL), cm AS (SELECT scene, band, median(m) AS med FROM c GROUP BY ALL),
ca AS (SELECT *, abs(m - med) AS a FROM c JOIN cm USING (scene, band)), cz AS (SELECT scene, band, median(a) AS mad FROM ca GROUP BY ALL),
k AS (SELECT scene, band, x FROM ca JOIN cz USING (scene, band) WHERE a / (1.4826 * mad + 1e-9) > 5),
rm AS (SELECT scene, band, y, median(value) AS med FROM d GROUP BY ALL), ra AS (SELECT d.*, abs(value - med) AS a FROM d JOIN rm USING (scene, band, y)),
rz AS (SELECT scene, band, y, median(a) AS mad FROM ra GROUP BY ALL)
SELECT scene, band, x FROM ra JOIN rz USING (scene, band, y) JOIN k USING (scene, band, x) GROUP BY scene, band, x HAVING avg(CASE WHEN a / (1.4826 * mad + 1e-9) > 5 THEN 1.0 ELSE 0 END) >= 0.5"""


@query(_D + ", " + _LINES)
def cl2_line_defects(spark, sf_dir):
    return cleaning.line_defects(cells(spark, sf_dir), fraction=0.5)


_DEAD = """p AS (SELECT scene, band, x, avg(value) AS p FROM d GROUP BY ALL), z AS (SELECT scene, max(band) + 1 AS nb, max(x) + 1 AS nx FROM p GROUP BY scene),
o AS (SELECT scene, band, x, p, nb, nx, ((band + db) % (2 * nb) + 2 * nb) % (2 * nb) AS kb, ((x + dx) % (2 * nx) + 2 * nx) % (2 * nx) AS kx
  FROM p JOIN z USING (scene), (SELECT unnest([-1, 0, 1]) AS db), (SELECT unnest([-2, -1, 0, 1, 2]) AS dx)),
f AS (SELECT o.scene, o.band, o.x, o.p, median(q.p) AS m FROM o JOIN p q ON q.scene = o.scene AND q.band = CASE WHEN kb < nb THEN kb ELSE 2 * nb - 1 - kb END
  AND q.x = CASE WHEN kx < nx THEN kx ELSE 2 * nx - 1 - kx END GROUP BY ALL),
e AS (SELECT scene, stddev_pop(p - m) AS sd FROM f GROUP BY scene),
g AS (SELECT scene, band, x, p - m AS residual, abs(p - m) > {t} * (sd + 1e-8) AS dead FROM f JOIN e USING (scene))"""


@query(_D + ", " + _DEAD.format(t=30) + " SELECT scene, band, x, round(residual, 9) + 0.0 AS residual, dead FROM g")
def cl3_dead_columns(spark, sf_dir):
    return cleaning.dead_columns(cells(spark, sf_dir)).withColumn("residual", r("residual"))


_REPAIR = """b AS (SELECT *, CASE WHEN NOT bad THEN value END AS ok FROM {src}),
n AS (SELECT *, CASE WHEN lag(band) OVER a = band - 1 THEN lag(ok) OVER a END AS bl, CASE WHEN lead(band) OVER a = band + 1 THEN lead(ok) OVER a END AS bu,
  CASE WHEN lag(x) OVER c = x - 1 THEN lag(ok) OVER c END AS xl, CASE WHEN lead(x) OVER c = x + 1 THEN lead(ok) OVER c END AS xu
  FROM b WINDOW a AS (PARTITION BY scene, y, x ORDER BY band), c AS (PARTITION BY scene, y, band ORDER BY x)),
fx AS (SELECT scene, y, x, band, bad, coalesce((bl + bu) / 2, bl, bu) AS sb, coalesce((xl + xu) / 2, xl, xu) AS sx FROM n)"""


@query(_D + ", " + _BAD + ", " + _REPAIR.format(src="bad") + " SELECT scene, y, x, band, round(coalesce(sb, sx), 9) + 0.0 AS value FROM fx WHERE bad AND coalesce(sb, sx) IS NOT NULL")
def cl4_repair(spark, sf_dir):
    bad = cleaning.bad_cells(cells(spark, sf_dir)).withColumn("bad", ~F.col("good"))
    return cleaning.repair(bad, "bad", "hybrid").where("repaired").select("scene", "y", "x", "band", r("value").alias("value"))


@query(_D + ", " + _DEAD.format(t=3) + ", e2 AS (SELECT d.*, coalesce(dead, false) AS bad FROM d LEFT JOIN g USING (scene, band, x)), " + _REPAIR.format(src="e2")
       + " SELECT scene, y, x, band, round(sb, 9) + 0.0 AS value FROM fx WHERE bad AND sb IS NOT NULL")
def cl5_dead_pixel_processor(spark, sf_dir):
    return cleaning.DeadPixelProcessor(threshold=3).clean(cells(spark, sf_dir)).where("repaired").select("scene", "y", "x", "band", r("value").alias("value"))


@query(_D + ", " + _BAD + " SELECT scene, y, x, count(*) AS bands FROM bad WHERE bad GROUP BY ALL")
def cl6_defect_image(spark, sf_dir):
    return cleaning.defect_image(cl1_bad_cells(spark, sf_dir))


@query(_D + ", " + _BAD + " SELECT scene, y, x, value, bad AS defect FROM bad WHERE band = 2")
def cl6_defect_overlay(spark, sf_dir):
    return cleaning.defect_overlay(cells(spark, sf_dir), cl1_bad_cells(spark, sf_dir), 2)


@query(_D + ", " + _LINES.replace("SELECT scene, band, x FROM ra JOIN", "df AS (SELECT scene, band, x FROM ra JOIN").replace("GROUP BY ALL)\ndf", "GROUP BY ALL), df")
       + "), rk AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY x, band) AS rank FROM df) SELECT scene, rank, x, band FROM rk WHERE rank <= 40")
def cl6_first_defects(spark, sf_dir):
    return cleaning.first_defects(cl2_line_defects(spark, sf_dir))


# cleaning of all readings: those below 0, above the limit or infinite are the worst defects. cl1 to cl6 keep to the valid ones.

_ALL = """WITH d AS (SELECT scene, y, x, band, max(value) AS value FROM cube_cells WHERE value IS NOT NULL AND NOT isnan(value) AND scene IS NOT NULL
AND y IS NOT NULL AND x IS NOT NULL AND band IS NOT NULL GROUP BY scene, y, x, band)"""
_BAD_ALL = """s AS (SELECT scene, band, avg(value) AS mean, stddev_pop(value) AS std FROM d WHERE NOT isinf(value) GROUP BY scene, band),
bad AS (SELECT d.*, isinf(value) OR value < 0.1 OR coalesce(abs(value - mean) / (std + 1e-8) > 3, false) AS bad FROM d LEFT JOIN s USING (scene, band))"""
_DEAD_ALL = """p AS (SELECT scene, band, x, avg(CASE WHEN NOT isinf(value) THEN value END) AS p FROM d GROUP BY ALL)""" + _DEAD[_DEAD.index(", z AS"):].replace("abs(p - m) > {t} * (sd + 1e-8) AS dead", "coalesce(abs(p - m) > {t} * (sd + 1e-8), p IS NULL) AS dead")


def all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.all_cells(table(spark, sf_dir, "cube_cells"))


@query(_ALL + ", " + _BAD_ALL + " SELECT scene, y, x, band FROM bad WHERE bad")
def cl1_bad_cells_all(spark, sf_dir):
    return cleaning.bad_cells(all_cells(spark, sf_dir)).where("NOT good").select("scene", "y", "x", "band")


@query(_ALL + ", " + _LINES)
def cl2_line_defects_all(spark, sf_dir):
    return cleaning.line_defects(all_cells(spark, sf_dir), fraction=0.5)


@query(_ALL + ", " + _DEAD_ALL.format(t=30) + " SELECT scene, band, x, round(residual, 9) + 0.0 AS residual, dead FROM g")
def cl3_dead_columns_all(spark, sf_dir):
    return cleaning.dead_columns(all_cells(spark, sf_dir)).withColumn("residual", r("residual"))


@query(_ALL + ", " + _BAD_ALL + ", " + _REPAIR.format(src="bad") + " SELECT scene, y, x, band, round(coalesce(sb, sx), 9) + 0.0 AS value FROM fx WHERE bad AND coalesce(sb, sx) IS NOT NULL")
def cl4_repair_all(spark, sf_dir):
    bad = cleaning.bad_cells(all_cells(spark, sf_dir)).withColumn("bad", ~F.col("good"))
    return cleaning.repair(bad, "bad", "hybrid").where("repaired").select("scene", "y", "x", "band", r("value").alias("value"))


@query(_ALL + ", " + _DEAD_ALL.format(t=3) + ", e2 AS (SELECT d.*, coalesce(dead, false) OR isinf(value) AS bad FROM d LEFT JOIN g USING (scene, band, x)), " + _REPAIR.format(src="e2")
       + " SELECT scene, y, x, band, round(sb, 9) + 0.0 AS value FROM fx WHERE bad AND sb IS NOT NULL")
def cl5_dead_pixel_processor_all(spark, sf_dir):
    return cleaning.DeadPixelProcessor(threshold=3).clean(all_cells(spark, sf_dir)).where("repaired").select("scene", "y", "x", "band", r("value").alias("value"))


@query(_ALL + ", " + _BAD_ALL + " SELECT scene, y, x, count(*) AS bands FROM bad WHERE bad GROUP BY ALL")
def cl6_defect_image_all(spark, sf_dir):
    return cleaning.defect_image(cl1_bad_cells_all(spark, sf_dir))


# masks


@query(_D + """, t AS (SELECT *, y // 5 AS i, x // 4 AS j FROM d) SELECT scene, CAST(i * 3 + j AS INTEGER) AS rect, band, count(*) AS n, round(avg(value), 9) + 0.0 AS mean FROM t
WHERE i < 3 AND j < 3 AND y % 5 < 4 AND x % 4 < 3 GROUP BY ALL""")
def bm1_rect_split(spark, sf_dir):
    split = masks.rect_split(cells(spark, sf_dir), (4, 3), (3, 3), spacing=1)
    return split.groupBy("scene", "rect", "band").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


def _otsu_sql(src: str, keys: str) -> str:
    """CTEs that end in otsu(keys, threshold, separation) of src(keys, v)."""
    return f"""lim AS (SELECT {keys}, min(v) AS low, max(v) AS high FROM {src} GROUP BY {keys}),
hst AS (SELECT {keys}, low, high, coalesce(least(CAST(floor((v - low) / nullif(high - low, 0) * 256) AS BIGINT), 255), 0) AS bin, count(*) AS n FROM {src} JOIN lim USING ({keys}) WHERE v IS NOT NULL GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER u AS w1, sum(n * bin) OVER u AS s1, sum(n) OVER t AS w, sum(n * bin) OVER t AS s FROM hst
  WINDOW u AS (PARTITION BY {keys} ORDER BY bin), t AS (PARTITION BY {keys})),
btw AS (SELECT *, round(coalesce(w1 * (w - w1) * pow(s1 / w1 - (s - s1) / nullif(w - w1, 0), 2), 0), 3) AS b FROM cum),
best AS (SELECT {keys}, low, high, max(b) AS b, arg_max(bin, {{'b': b, 'n': -bin}}) AS bin FROM btw GROUP BY {keys}, low, high),
otsu AS (SELECT {keys}, CASE WHEN high > low THEN low + (bin + 0.5) * ((high - low) / 256) ELSE low END AS threshold, b * ((high - low) / 256) * ((high - low) / 256) AS separation FROM best)"""


@query(_D + ", v AS (SELECT scene, band, value AS v FROM d), " + _otsu_sql("v", "scene, band") + " SELECT scene, band, round(threshold, 9) + 0.0 AS threshold, round(separation, 5) + 0.0 AS separation FROM otsu")
def mu1_otsu(spark, sf_dir):
    o = stats.otsu(cells(spark, sf_dir).withColumnRenamed("value", "v"), ["scene", "band"])
    return o.select("scene", "band", r("threshold").alias("threshold"), r("separation", 5).alias("separation"))


@query(_D + ", " + _STATS + """, k AS (SELECT scene, band, lo, hi, row_number() OVER (PARTITION BY scene ORDER BY round(coalesce(std / nullif(hi - lo, 0), 0), 12) DESC, band) AS r FROM s),
b AS (SELECT d.scene, y, x, d.band, least(1.0, greatest(0.0, (coalesce((value - lo) / nullif(hi - lo, 0), 0) - 0.3) / 3.9999999999999997e-1)) AS v FROM d JOIN k ON d.scene = k.scene AND d.band = k.band AND r <= 5),
q AS (SELECT scene, band, quantile_cont(v, 0.1) AS q FROM b GROUP BY ALL), v AS (SELECT scene, y, x, band, CASE WHEN v < q THEN 0 ELSE v END AS v FROM b JOIN q USING (scene, band)), """
       + _otsu_sql("v", "scene, band") + " SELECT scene, y, x, count(*) FILTER (v > threshold) AS votes FROM v JOIN otsu USING (scene, band) GROUP BY ALL")
def bm2_votes(spark, sf_dir):
    return masks.contrast_votes(cells(spark, sf_dir))


@query()
def bm2_top_contrast(spark, sf_dir):
    return masks.top_contrast(cells(spark, sf_dir), min_size=4, hole_size=2)


_WHOLE = "nb AS (SELECT scene, count(DISTINCT band) AS nb FROM d GROUP BY scene), pf AS (SELECT scene, y, x FROM d JOIN nb USING (scene) GROUP BY scene, y, x, nb HAVING count(*) = nb), wd AS (SELECT d.* FROM d JOIN pf USING (scene, y, x))"


def _angles(spark, sf_dir):
    whole = masks.whole_pixels(cells(spark, sf_dir))
    mean = cells(spark, sf_dir).groupBy("scene", "band").agg(F.avg("value").alias("m")).groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("band", "m"))).alias("_r"))
    return masks.angles(whole.join(mean.select("scene", F.col("_r.m").alias("ref")), "scene").select("scene", "y", "x", "spectrum", "ref"), F.col("ref"))


@query(_D + ", " + _WHOLE + """, m AS (SELECT scene, band, avg(value) AS m FROM d GROUP BY ALL), t AS (SELECT scene, y, x, sum(value * m) AS dot, sqrt(sum(value * value)) AS nv, sqrt(sum(m * m)) AS nm FROM wd JOIN m USING (scene, band) GROUP BY ALL)
SELECT scene, y, x, round(degrees(acos(greatest(-1, least(1, dot / (nv * nm))))), 5) + 0.0 AS angle FROM t WHERE nv > 1e-6""")
def bm3_angles(spark, sf_dir):
    return _angles(spark, sf_dir).where("angle IS NOT NULL").withColumn("angle", r("angle", 5))


@query()
def bm3_spectral_angle(spark, sf_dir):
    return masks.tidy(masks.spectral_angle(_angles(spark, sf_dir)), frame.extent(cells(spark, sf_dir)), min_size=4, radius=1)


def _shadowless(spark, sf_dir):
    """Pixels less like the mean spectrum of their scene than Otsu's threshold, without shadows."""
    whole = masks.whole_pixels(cells(spark, sf_dir))
    return masks.spectral_angle(_angles(spark, sf_dir)).join(masks.bright(masks.norms(whole)), masks.PIXEL, "left_semi")


@query()
def bm3_foreground(spark, sf_dir):
    """The background mask of the spectral angle before it is cleaned, without shadows."""
    return _shadowless(spark, sf_dir)


@query(_D + ", " + _WHOLE + """, t AS (SELECT scene, y, x, sqrt(sum(value * value)) AS v FROM wd GROUP BY ALL), q AS (SELECT scene, quantile_cont(v, 0.1) AS q FROM t GROUP BY scene)
SELECT scene, y, x FROM t JOIN q USING (scene) WHERE v > q + 1e-12 AND v > 1e-6""")
def bm3_bright(spark, sf_dir):
    """The pixels that are no shadows: brighter than the tenth percentile of their scene."""
    return masks.bright(masks.norms(masks.whole_pixels(cells(spark, sf_dir))))


@query()
def bm3_spectral_angle_smooth(spark, sf_dir):
    return masks.tidy(_shadowless(spark, sf_dir), frame.extent(cells(spark, sf_dir)), min_size=4, radius=1, smooth_sigma=1.0)


def _dense(spark, sf_dir, band):
    """A band of every scene; absent pixels take the mean."""
    c = cells(spark, sf_dir)
    p, size = frame.plane(c, band), frame.extent(c)
    grid = spatial.complement(p.where("false").select("scene", "y", "x"), size)
    return grid.join(p, ["scene", "y", "x"], "left").join(p.groupBy("scene").agg(F.avg("v").alias("m")), "scene").select("scene", "y", "x", F.coalesce("v", "m").alias("v"))


@query(_D + """, p AS (SELECT scene, y, x, value AS v FROM d WHERE band = 2), pm AS (SELECT scene, avg(v) AS m FROM p GROUP BY scene),
gy AS (SELECT scene, width, unnest(range(height)) AS y FROM size), gr AS (SELECT scene, y, unnest(range(width)) AS x FROM gy),
z AS (SELECT g.scene, g.y, g.x, coalesce(p.v, m) AS v FROM gr g JOIN pm USING (scene) LEFT JOIN p ON p.scene = g.scene AND p.y = g.y AND p.x = g.x),
k0 AS (SELECT o, exp(-0.5 * (o / 5.0) * (o / 5.0)) AS e FROM (SELECT unnest(range(-20, 21)) AS o)), k AS (SELECT o, e / (SELECT sum(e) FROM k0) AS k FROM k0),
a1 AS (SELECT z.scene, z.y, z.x, height, k, ((z.y + o) % (2 * height) + 2 * height) % (2 * height) AS t FROM z JOIN size USING (scene), k),
g1 AS (SELECT a.scene, a.y, a.x, sum(a.k * z.v) AS v FROM a1 a JOIN z ON z.scene = a.scene AND z.x = a.x AND z.y = CASE WHEN t < height THEN t ELSE 2 * height - 1 - t END GROUP BY ALL),
a2 AS (SELECT g1.scene, g1.y, g1.x, width, k, ((g1.x + o) % (2 * width) + 2 * width) % (2 * width) AS t FROM g1 JOIN size USING (scene), k),
g2 AS (SELECT a.scene, a.y, a.x, sum(a.k * g1.v) AS g FROM a2 a JOIN g1 ON g1.scene = a.scene AND g1.y = a.y AND g1.x = CASE WHEN t < width THEN t ELSE 2 * width - 1 - t END GROUP BY ALL),
df AS (SELECT scene, y, x, v - g AS df FROM z JOIN g2 USING (scene, y, x)), l AS (SELECT scene, min(df) AS lo, max(df) AS hi FROM df GROUP BY scene)
SELECT scene, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(coalesce((df - lo) / nullif(hi - lo, 0), 0), 8) + 0.0 AS v FROM df JOIN l USING (scene)""")
def bm4_highpass(spark, sf_dir):
    return masks.highpass(_dense(spark, sf_dir, 2)).withColumn("v", r("v", 8))


@query()
def bm4_highpass_otsu(spark, sf_dir):
    return masks.highpass_otsu(_dense(spark, sf_dir, 2), min_size=4, hole_size=2)


def _blocks(spark, sf_dir):
    """The valid readings of every scene, whatever its number of bands."""
    return scenewise.Blocks(table(spark, sf_dir, "cube_cells").where(F.col("value").between(frame.LOW, frame.HIGH)))


@query()
def bm5_kmeans(spark, sf_dir):
    return scenewise.kmeans(_blocks(spark, sf_dir)).groupBy("scene", "cluster").agg(F.count("*").alias("n"))


@query()
def bm5_kmeans_mask(spark, sf_dir):
    """Every pixel of every scene: fg if it is in the cleaned mask of the scene's smallest cluster."""
    size = frame.extent(table(spark, sf_dir, "cube_cells").where(F.col("value").between(frame.LOW, frame.HIGH)))
    mask = masks.kmeans_mask(scenewise.kmeans(_blocks(spark, sf_dir)), size).withColumn("fg", F.lit(True))
    grid = spatial.complement(mask.where("false").select("scene", "y", "x"), size)
    return grid.join(mask, ["scene", "y", "x"], "left").withColumn("fg", F.coalesce("fg", F.lit(False)))


@query(_D + ", " + _STATS + """, en AS (SELECT scene, band, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY scene, band) AS t FROM d GROUP BY scene, band, value),
ee AS (SELECT scene, band, -sum(n / t * log2(n / t)) AS entropy FROM en GROUP BY ALL)
SELECT scene, band, round(std / (hi - lo + 1e-6), 9) + 0.0 AS contrast, round(std, 9) + 0.0 AS std, round(entropy, 9) + 0.0 AS entropy FROM s JOIN ee USING (scene, band)""")
def bm6_component_scores(spark, sf_dir):
    c = cells(spark, sf_dir)
    parts = [masks.component_scores(c, m).withColumn("score", r("score")).withColumnRenamed("score", m) for m in ("contrast", "std", "entropy")]
    return parts[0].join(parts[1], ["scene", "band"]).join(parts[2], ["scene", "band"])


@query()
def bm6_component_mask(spark, sf_dir):
    return masks.component_mask(scenewise.pca(_blocks(spark, sf_dir), 3))


def _brightness(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("scene", "y", "x").agg(F.avg("value").alias("v"))


@query()
def bm6_pca_mask(spark, sf_dir):
    return masks.pca_mask(scenewise.pca(_blocks(spark, sf_dir), 3), _brightness(spark, sf_dir), frame.extent(cells(spark, sf_dir)))


@query()
def bm6_pca_mask_contrast(spark, sf_dir):
    """The first component, stretched between fixed limits instead of cut by Otsu's threshold."""
    how = {"selection": 0, "mode": "contrast", "threshold": 0.5, "lower": -0.02, "upper": 0.02}
    return masks.pca_mask(scenewise.pca(_blocks(spark, sf_dir), 3), _brightness(spark, sf_dir), frame.extent(cells(spark, sf_dir)), **how)


def _simple_mask(spark, sf_dir):
    """Pixels whose mean reading is above the scene's Otsu threshold."""
    p = cells(spark, sf_dir).groupBy("scene", "y", "x").agg(F.avg("value").alias("v"))
    return p.join(stats.otsu(p, ["scene"]), "scene").where("v > threshold").select("scene", "y", "x")


@query()
def bm7_fixed_rects(spark, sf_dir):
    return regions.fixed_rects(_simple_mask(spark, sf_dir), (4, 3), frame.extent(cells(spark, sf_dir)), min_frac=0.5)


# regions


@query()
def mu2_valid_regions(spark, sf_dir):
    return regions.valid_regions(_simple_mask(spark, sf_dir), 0.5, 3)


@query(""" SELECT scene, CAST(greatest(1, CAST(floor(median(y2 - y1)) AS INTEGER) - 2) AS INTEGER) AS rect_h, CAST(greatest(1, CAST(floor(median(x2 - x1)) AS INTEGER) - 2) AS INTEGER) AS rect_w FROM regions
WHERE y1 IS NOT NULL AND y2 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY scene""")
def mu3_rect_size(spark, sf_dir):
    return regions.rect_size(table(spark, sf_dir, "regions").dropna(subset=regions.RECT), margin=1)


@query(_D + """ SELECT region_id, scene, greatest(0, (y1 + y2) // 2 - 2) AS y1, least(height, (y1 + y2) // 2 + 2) AS y2, greatest(0, (x1 + x2) // 2 - 1) AS x1, least(width, (x1 + x2) // 2 + 1) AS x2
FROM regions JOIN size USING (scene) WHERE y1 IS NOT NULL AND y2 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL""")
def mu4_centred_rects(spark, sf_dir):
    boxes = table(spark, sf_dir, "regions").dropna(subset=regions.RECT).drop("ordinal")
    return regions.centred_rects(boxes, F.lit(5), F.lit(3), frame.extent(cells(spark, sf_dir)))


@query(_D + """, q AS (SELECT DISTINCT scene, region_id, y1, y2, x1, x2 FROM regions WHERE y1 IS NOT NULL AND y2 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL)
SELECT q.scene, region_id, band, count(*) AS n, round(avg(value), 9) + 0.0 AS mean FROM d JOIN q ON d.scene = q.scene AND y >= y1 AND y < y2 AND x >= x1 AND x < x2 GROUP BY ALL""")
def mu6_sample_cubes(spark, sf_dir):
    inside = regions.within(cells(spark, sf_dir), table(spark, sf_dir, "regions").dropna(subset=regions.RECT).select("scene", "region_id", *regions.RECT).distinct(), ["region_id"])
    return inside.groupBy("scene", "region_id", "band").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


@query(_D + """, q AS (SELECT DISTINCT scene, region_id AS mask_id, y1, y2, x1, x2 FROM regions WHERE y1 IS NOT NULL AND y2 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL)
SELECT q.scene, mask_id, min(y) AS y1, max(y) + 1 AS y2, min(x) AS x1, max(x) + 1 AS x2 FROM d JOIN q ON d.scene = q.scene AND y >= y1 AND y < y2 AND x >= x1 AND x < x2 WHERE value > 0.5 GROUP BY ALL""")
def mu7_mask_boxes(spark, sf_dir):
    boxes = table(spark, sf_dir, "regions").dropna(subset=regions.RECT).select("scene", F.col("region_id").alias("mask_id"), *regions.RECT).distinct()
    return regions.mask_boxes(regions.within(cells(spark, sf_dir).where("value > 0.5"), boxes, ["mask_id"]))


@query()
def mu5_rect_mask(spark, sf_dir):
    """Rectangles of 4 x 3 about the three largest regions of every scene, and their readings."""
    c = cells(spark, sf_dir)
    rects = regions.rect_mask(_simple_mask(spark, sf_dir), (4, 3), frame.extent(c), 0.5, 3)
    n = regions.crops(c, rects).groupBy("scene", "ordinal").agg(F.count("*").alias("n"))
    return rects.join(n, ["scene", "ordinal"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(_D + """, q AS (SELECT DISTINCT region_id, scene, greatest(0, (y1 + y2) // 2 - 2) AS y1, least(height, (y1 + y2) // 2 + 2) AS y2, greatest(0, (x1 + x2) // 2 - 1) AS x1, least(width, (x1 + x2) // 2 + 1) AS x2
FROM regions JOIN size USING (scene) WHERE y1 IS NOT NULL AND y2 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
l AS (SELECT scene, x1, x2, unnest(range(y1, y2)) AS y FROM q) SELECT DISTINCT scene, CAST(y AS INTEGER) AS y, CAST(unnest(range(x1, x2)) AS INTEGER) AS x FROM l""")
def mu4_mask_pixels(spark, sf_dir):
    return regions.rect_pixels(mu4_centred_rects(spark, sf_dir))


@query(_D + ", " + _SAMPLES + " SELECT DISTINCT d.scene, ordinal, CAST(y - y1 AS INTEGER) AS y, CAST(x - x1 AS INTEGER) AS x, band, value FROM d JOIN q ON d.scene = q.scene AND y >= y1 AND y < y2 AND x >= x1 AND x < x2")
def mu6_crops(spark, sf_dir):
    return regions.crops(cells(spark, sf_dir), samples(spark, sf_dir)).distinct()


@query(_D + ", " + _SAMPLES + """ SELECT label, y - y1 AS y, x - x1 AS x, band, count(*) AS n, min(value) AS low, max(value) AS high FROM d JOIN q ON d.scene = q.scene AND y >= y1 AND y < y2 AND x >= x1 AND x < x2
GROUP BY ALL""")
def mu7_species_crops(spark, sf_dir):
    by_label = regions.crops(cells(spark, sf_dir), samples(spark, sf_dir), "label").groupBy("label", "y", "x", "band")
    return by_label.agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


# extraction

_POINTS = """pt AS (SELECT DISTINCT scene, region_id AS coord_id, (y1 + y2) // 2 AS py, (x1 + x2) // 2 AS px FROM regions WHERE y1 IS NOT NULL AND y2 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL)"""


def _points(spark, sf_dir):
    boxes = table(spark, sf_dir, "regions").dropna(subset=regions.RECT)
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("int")
    return boxes.select("scene", F.col("region_id").alias("coord_id"), mid("y1", "y2").alias("py"), mid("x1", "x2").alias("px")).distinct()


@query(_D + ", " + _POINTS + " SELECT d.scene, coord_id, band, round(avg(value), 9) + 0.0 AS value FROM d JOIN pt ON d.scene = pt.scene AND abs(y - py) <= 2 AND abs(x - px) <= 2 GROUP BY ALL")
def ex1_local_means(spark, sf_dir):
    return extract.local_means(cells(spark, sf_dir), _points(spark, sf_dir)).withColumn("value", r("value"))


@query(_D + ", " + _POINTS + " SELECT d.scene, coord_id, band, round(avg(value), 9) + 0.0 AS value FROM d JOIN pt ON d.scene = pt.scene AND (y - py) * (y - py) + (x - px) * (x - px) <= 9 GROUP BY ALL")
def ex1_local_means_disk(spark, sf_dir):
    return extract.local_means(cells(spark, sf_dir), _points(spark, sf_dir), 3, "disk").withColumn("value", r("value"))


@query(_D + """, t AS (SELECT d.*, y // 5 AS i, x // 4 AS j, height, width FROM d JOIN size USING (scene))
SELECT scene, CAST(j * 3 + i AS INTEGER) AS roi_id, CAST(j * 4 AS INTEGER) AS x0, CAST(i * 5 AS INTEGER) AS y0, CAST(j * 4 + 3 AS INTEGER) AS x1, CAST(i * 5 + 4 AS INTEGER) AS y1, band, round(median(value), 9) + 0.0 AS value
FROM t WHERE i < 3 AND j < 3 AND y % 5 < 4 AND x % 4 < 3 AND i * 5 + 4 <= height AND j * 4 + 3 <= width GROUP BY ALL""")
def ex2_grid_rois(spark, sf_dir):
    c = cells(spark, sf_dir)
    return extract.grid_rois(c, frame.extent(c), (0, 0), (4, 3), (1, 1), (3, 3)).withColumn("value", r("value"))


@query(_D + """, q AS (SELECT DISTINCT scene, region_id AS roi_id, y1, y2, x1, x2 FROM regions WHERE y2 - y1 >= 5 AND x2 - x1 >= 3)
SELECT d.scene, roi_id, band, round(median(value), 9) + 0.0 AS value FROM d JOIN q ON d.scene = q.scene AND y >= y1 AND y < y2 AND x >= x1 AND x < x2
WHERE (x - x1) * (y2 - y1) < (y2 - y) * (x2 - x1) AND y < y2 GROUP BY ALL""")
def ex3_drawn_polygons(spark, sf_dir):
    """Triangles of the boxes' left edge and upper right corner."""
    boxes = table(spark, sf_dir, "regions").where("y2 - y1 >= 5 AND x2 - x1 >= 3")
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("o"), F.col(a).alias("vx"), F.col(b).alias("vy")) for i, (a, b) in enumerate((("x1", "y1"), ("x2", "y1"), ("x1", "y2"))))))
    v = boxes.select("scene", F.col("region_id").alias("roi_id"), corner.alias("c")).select("scene", "roi_id", F.col("c.o").alias("vertex_ord"), F.col("c.vx").cast("double").alias("vx"), F.col("c.vy").cast("double").alias("vy"))
    return extract.drawn_polygons(cells(spark, sf_dir), v.distinct()).withColumn("value", r("value"))


@query(_D + """, q AS (SELECT DISTINCT scene, region_id AS roi_id, y1, y2, x1, x2 FROM regions WHERE y2 - y1 >= 3 AND x2 - x1 >= 3)
SELECT d.scene, roi_id, band, round(median(value), 9) + 0.0 AS value FROM d JOIN q ON d.scene = q.scene AND y >= y1 AND y < y2 AND x >= x1 AND x < x2 GROUP BY ALL""")
def ex3_drawn_rects(spark, sf_dir):
    drawn = table(spark, sf_dir, "regions").dropna(subset=regions.RECT).select("scene", F.col("region_id").alias("roi_id"), F.col("x2").alias("x0"), F.col("y2").alias("y0"), "x1", "y1").distinct()
    return extract.drawn_rects(cells(spark, sf_dir), drawn, min_span=3).withColumn("value", r("value"))


# preprocessing


@query(_D + ", " + _STATS + " SELECT scene, y, x, band, round((value - lo) / (hi - lo + 1e-8), 9) + 0.0 AS value FROM d JOIN s USING (scene, band)")
def pp1_min_max(spark, sf_dir):
    return stats.min_max(cells(spark, sf_dir)).withColumn("value", r("value"))


@query(_D + ", " + _STATS + " SELECT scene, y, x, band, round((value - mean) / (std + 1e-8), 7) + 0.0 AS value FROM d JOIN s USING (scene, band)")
def pp2_mean_std(spark, sf_dir):
    return stats.mean_std(cells(spark, sf_dir)).withColumn("value", r("value", 7))


_SPEC = """p AS (SELECT scene, y, x, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM d GROUP BY ALL),
t AS (SELECT * FROM d JOIN p USING (scene, y, x)), ma AS (SELECT scene, y, x, quantile_cont(abs(value - q2), 0.5) AS mad FROM t GROUP BY ALL)"""


def _pixelwise(spark, sf_dir, f, places):
    p = frame.pixels(cells(spark, sf_dir)).withColumn("spectrum", f(F.col("spectrum")))
    return frame.cells_of(p).withColumn("value", r("value", places))


@query(_D + ", " + _SPEC + " SELECT scene, y, x, band, round((value - m) / sd, 6) + 0.0 AS value FROM t WHERE sd > 1e-9")
def pp3_snv(spark, sf_dir):
    p = frame.pixels(cells(spark, sf_dir)).where(S.std(F.col("spectrum")) > 1e-9)
    return frame.cells_of(preprocess.SNV().fit(p).transform(p)).withColumn("value", r("value", 6))


_EMB = "WITH e AS (SELECT vec_id AS sample_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query(_EMB + """, c AS (SELECT *, avg(v) OVER (PARTITION BY sample_id) AS m FROM e), f AS (SELECT i, avg(v - m) AS r FROM c GROUP BY i), rr AS (SELECT avg(r) AS rm FROM f),
g AS (SELECT i, r, rm, r - rm AS rc FROM f, rr), s AS (SELECT sample_id, sum((v - m) * rc) / sum(rc * rc) AS s FROM c JOIN g USING (i) GROUP BY sample_id)
SELECT sample_id, CAST(i - 1 AS INTEGER) AS band, round((v - m + s * rm) / s, 4) + 0.0 AS value FROM c JOIN s USING (sample_id), rr""")
def pp4_msc(spark, sf_dir):
    x = embedded(spark, sf_dir)
    return preprocess.MSC().fit(x).transform(x).select("sample_id", F.posexplode("spectrum").alias("band", "value")).withColumn("value", r("value", 4))


@query()
def pp5_savitzky_golay(spark, sf_dir):
    x = embedded(spark, sf_dir)
    return preprocess.SavitzkyGolay(11, 2, 1).fit(x).transform(x).select("sample_id", F.posexplode("spectrum").alias("band", "value")).withColumn("value", r("value", 8))


@query(_D + " SELECT scene, y, x, band, CASE WHEN value > 0 AND value <= 1 THEN round(-log10(value), 9) + 0.0 END AS value FROM d")
def sb2_absorbance(spark, sf_dir):
    return _pixelwise(spark, sf_dir, lambda a: S.absorbance(a, on_invalid="null"), 9)


@query(_D + " SELECT scene, y, x, band, CASE WHEN value > 0 AND value <= 1 THEN round((1 - value) * (1 - value) / (2 * value), 6) + 0.0 END AS value FROM d")
def sb2_kubelka(spark, sf_dir):
    return _pixelwise(spark, sf_dir, lambda a: S.absorbance(a, "kubelka", "null"), 6)


@query()
def sb3_asls_baseline(spark, sf_dir):
    return preprocess.asls_baseline(embedded(spark, sf_dir), lam=100.0, p=0.01).select("sample_id", F.posexplode("baseline").alias("band", "value")).withColumn("value", r("value", 6))


@query(_D + ", " + _SPEC + " SELECT scene, y, x, band, round((value - q2) / (q3 - q1), 9) + 0.0 AS value FROM t WHERE q3 - q1 > 1e-9")
def sb4_robust_snv(spark, sf_dir):
    p = frame.pixels(cells(spark, sf_dir)).where(S.quantile(F.col("spectrum"), 0.75) - S.quantile(F.col("spectrum"), 0.25) > 1e-9)
    return frame.cells_of(p.withColumn("spectrum", S.robust_snv(F.col("spectrum")))).withColumn("value", r("value"))


@query(_D + ", " + _SPEC + " SELECT scene, y, x, band, round((value - q2) / mad, 9) + 0.0 AS value FROM t JOIN ma USING (scene, y, x) WHERE mad > 1e-9")
def sb5_rnv(spark, sf_dir):
    s = F.col("spectrum")
    mad = S.quantile(F.transform(F.array(S.quantile(s, 0.5)), lambda m: F.transform(s, lambda v: F.abs(v - m)))[0], 0.5)
    p = frame.pixels(cells(spark, sf_dir)).where(mad > 1e-9)
    return frame.cells_of(p.withColumn("spectrum", S.rnv(F.col("spectrum")))).withColumn("value", r("value"))


# bins and selection

_EQUAL = """tot AS (SELECT *, round(sum(g) OVER (PARTITION BY scene ORDER BY i) / sum(g) OVER (PARTITION BY scene), 12) AS c, count(*) OVER (PARTITION BY scene) AS n FROM gg),
ed AS (SELECT scene, j, n, count(*) FILTER (c < round(j / {b}.0, 12)) AS e FROM tot, (SELECT unnest(range({b} + 1)) AS j) GROUP BY ALL),
ef AS (SELECT scene, j, CASE WHEN j = 0 THEN 0 WHEN j = {b} THEN n - 1 ELSE least(e, n - 1) END AS e FROM ed),
sp AS (SELECT scene, CAST(j AS INTEGER) AS bin, e AS first, lead(e) OVER (PARTITION BY scene ORDER BY j) AS last FROM ef)
SELECT sp.scene, bin, first, last, min(wavelength) AS "left", max(wavelength) AS "right", round(avg(value), 9) + 0.0 AS value FROM sp JOIN tot ON tot.scene = sp.scene AND i >= first AND i < last WHERE last > first GROUP BY ALL"""


@query(_D + ", " + _MEANS + """, ii AS (SELECT *, row_number() OVER o - 1 AS i, lag(value) OVER o AS fb, lead(value) OVER o AS fa, wavelength - lag(wavelength) OVER o AS hs, lead(wavelength) OVER o - wavelength AS hd FROM m WINDOW o AS (PARTITION BY scene ORDER BY wavelength)),
gg AS (SELECT scene, wavelength, value, i, abs(CASE WHEN fb IS NULL AND fa IS NULL THEN 0 WHEN fb IS NULL THEN (fa - value) / hd WHEN fa IS NULL THEN (value - fb) / hs ELSE (hs * hs * fa + (hd * hd - hs * hs) * value - hd * hd * fb) / (hs * hd * (hd + hs)) END) AS g FROM ii), """
       + _EQUAL.format(b=5))
def fs1_gradient_bins(spark, sf_dir):
    return binning.gradient_bins(mean_spectra(spark, sf_dir), ["scene"], 5).withColumn("value", r("value"))


@query(_D + ", " + _MEANS + ", gg AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY wavelength) - 1 AS i, value AS g FROM m), " + _EQUAL.format(b=4))
def sb1_equalised_bins(spark, sf_dir):
    return binning.equalised_bins(mean_spectra(spark, sf_dir), ["scene"], 4).withColumn("value", r("value"))


_EDGES = [200.0, 500.0, 800.0, 1100.0, 1400.0, 1700.0]


@query(_D + ", " + _MEANS + """, b AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS bin), e AS (SELECT bin, 200.0 + 300 * bin AS l, 500.0 + 300 * bin AS h FROM b), sc AS (SELECT DISTINCT scene FROM m)
SELECT sc.scene, bin, CAST(l AS DOUBLE) AS "left", CAST(h AS DOUBLE) AS "right", round(avg(value), 9) + 0.0 AS mean, round(stddev_pop(value), 7) + 0.0 AS std FROM sc CROSS JOIN e LEFT JOIN m ON m.scene = sc.scene AND wavelength >= l AND wavelength < h GROUP BY ALL""")
def fs3_binned_stats(spark, sf_dir):
    b = binning.binned_stats(mean_spectra(spark, sf_dir), ["scene"], _EDGES)
    return b.withColumns({"mean": r("mean"), "std": r("std", 7)})


@query(_D + ", " + _MEANS + """ SELECT scene, 'spectrum' AS kind, wavelength, round(value, 9) + 0.0 AS value FROM m UNION ALL SELECT scene, 'edge', 200.0 + 300 * k, NULL FROM (SELECT DISTINCT scene FROM m), (SELECT unnest(range(6)) AS k)
UNION ALL SELECT scene, 'centre', 350.0 + 300 * k, NULL FROM (SELECT DISTINCT scene FROM m), (SELECT unnest(range(5)) AS k)""")
def fs4_spectrum_with_bins(spark, sf_dir):
    return plotdata.spectrum_with_bins(mean_spectra(spark, sf_dir), ["scene"], _EDGES).withColumn("value", r("value"))


@query()
def fs5_adaptive_binner(spark, sf_dir):
    """Bins learnt on the embeddings by the F statistic of their labels, applied to each of them."""
    long = embedded(spark, sf_dir).select("sample_id", "label", F.posexplode("spectrum").alias("band", "value"))
    at = {b: 400.0 + 10 * b for b in range(64)}
    binner = binning.AdaptiveSpectralBinner(8, "supervised").fit(long, at, "label")
    return binner.transform(long.select("sample_id", (F.col("band") * 10 + 400.0).alias("wavelength"), "value"), ["sample_id"]).withColumn("mean", r("mean"))


@query(_EMB + """, p AS (SELECT i, label, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM e GROUP BY ALL), g AS (SELECT i, avg(v) AS a FROM e GROUP BY i),
t AS (SELECT i, sum(n * (m - a) * (m - a)) AS b, sum(n * s) AS w, sum(n) AS n, count(*) AS k FROM p JOIN g USING (i) GROUP BY i)
SELECT CAST(i - 1 AS INTEGER) AS band, round((b / (k - 1)) / (w / (n - k)), 6) + 0.0 AS f FROM t""")
def fs5_anova_f(spark, sf_dir):
    return stats.anova_f(embedded(spark, sf_dir).select("label", F.posexplode("spectrum").alias("band", "value"))).withColumn("f", r("f", 6))


@query()
def fs6_rmse_cv(spark, sf_dir):
    e = models.rmse_cv(embedded(spark, sf_dir), "label")
    return embedded(spark, sf_dir).agg(F.count("*").alias("n")).withColumn("rmse", F.lit(round(e, 8)))


@query()
def fs7_cars(spark, sf_dir):
    bands, error, _ = models.cars(embedded(spark, sf_dir), "label")
    x = embedded(spark, sf_dir).select(F.posexplode("spectrum").alias("band", "v")).where(F.col("band").isin(bands))
    return x.groupBy("band").agg(F.count("*").alias("n")).withColumn("rmse", F.lit(round(error, 8)))


# models


@query()
def sb6_soft_plsda(spark, sf_dir):
    x = embedded(spark, sf_dir)
    model = models.SoftPLSDA(4).fit(x)
    return model.predict(x).select("sample_id", "label", F.array_join("classes", ",").alias("classes"))


@query()
def sb7_mnf(spark, sf_dir):
    return scenewise.mnf(_blocks(spark, sf_dir), 3).withColumn("value", r("value", 6))


# headers and samples


@query("SELECT scene, CAST(row_number() OVER (PARTITION BY scene ORDER BY band) - 1 AS INTEGER) AS band, wavelength FROM (SELECT scene, band, max(wavelength) AS wavelength FROM wavelengths WHERE wavelength IS NOT NULL AND scene IS NOT NULL GROUP BY ALL)")
def io3_header_wavelengths(spark, sf_dir):
    """Headers written from the wavelengths table and read again."""
    w = table(spark, sf_dir, "wavelengths").where("wavelength IS NOT NULL AND scene IS NOT NULL").groupBy("scene", "band").agg(F.max("wavelength").alias("w"))
    text = F.concat(F.lit("ENVI\nsamples = 1\nwavelength = {\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band", "w"))), lambda s: s["w"].cast("string")), ",\n"), F.lit("}\nbands = 2\n"))
    return w.groupBy("scene").agg(text.alias("text")).select("scene", F.posexplode(envi.wavelength_array(F.col("text"))).alias("band", "wavelength"))


@query("SELECT key, count(DISTINCT scene) AS scenes FROM (SELECT scene, unnest(map_keys(meta)) AS key FROM scenes) GROUP BY key")
def pl1_header_summary(spark, sf_dir):
    return pipeline.header_summary(table(spark, sf_dir, "scenes"))


@query(_D + ", " + _SAMPLES + """, sx AS (SELECT DISTINCT label, q.scene, ordinal, y, x FROM d JOIN q ON d.scene = q.scene AND y >= y1 AND y < y2 AND x >= x1 AND x < x2),
sh AS (SELECT label, scene, ordinal, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w, count(*) AS n FROM sx GROUP BY ALL)
SELECT label, count(*) AS samples, CAST(sum(n) AS BIGINT) AS pixels, count(DISTINCT (h, w)) AS shapes FROM sh GROUP BY label""")
def pl3_sample_summary(spark, sf_dir):
    return pipeline.sample_summary(pipeline.sample_matrix(cells(spark, sf_dir), samples(spark, sf_dir)))


# plot data


@query(_D + ", " + _STATS + """, t AS (SELECT d.scene, y, x, band, (value - lo) / (hi - lo + 1e-8) AS v FROM d JOIN s USING (scene, band) WHERE band IN (0, 3, 6))
SELECT scene, y, x, round(max(v) FILTER (band = 0), 9) + 0.0 AS c0, round(max(v) FILTER (band = 3), 9) + 0.0 AS c1, round(max(v) FILTER (band = 6), 9) + 0.0 AS c2 FROM t GROUP BY ALL""")
def vz1_image(spark, sf_dir):
    return plotdata.image(cells(spark, sf_dir), [0, 3, 6]).withColumns({c: r(c) for c in ("c0", "c1", "c2")})


@query(_D + ", " + _STATS + ' SELECT scene, band, round(mean, 9) + 0.0 AS mean, round(mean - std, 9) + 0.0 AS low, round(mean + std, 9) + 0.0 AS high, lo AS "min", hi AS "max" FROM s')
def vz2_envelope(spark, sf_dir):
    return plotdata.spectra_envelope(cells(spark, sf_dir)).withColumns({c: r(c) for c in ("mean", "low", "high")})


@query(_D + """, l AS (SELECT scene, min(value) AS low, max(value) AS high FROM d GROUP BY scene)
SELECT scene, low, high, CAST(coalesce(least(CAST(floor((value - low) / nullif(high - low, 0) * 100) AS INTEGER), 99), 0) AS INTEGER) AS bin, count(*) AS n FROM d JOIN l USING (scene) GROUP BY ALL""")
def vz3_histogram(spark, sf_dir):
    return plotdata.value_histogram(cells(spark, sf_dir))


@query(_D + """, nb AS (SELECT scene, max(band) + 1 AS nb FROM d GROUP BY scene), pk AS (SELECT scene, k AS slice, CAST(k * (nb - 1) // 9 AS INTEGER) AS band FROM nb, (SELECT CAST(unnest(range(10)) AS INTEGER) AS k)),
t AS (SELECT d.scene, slice, d.band, y, x, value FROM d JOIN pk ON pk.scene = d.scene AND pk.band = d.band WHERE y % 3 = 0 AND x % 3 = 0)
SELECT scene, slice, band, (9 - slice) * 10 AS z, y, x, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0), 9) + 0.0 AS v FROM t WINDOW w AS (PARTITION BY scene, slice)""")
def vz4_slices(spark, sf_dir):
    return plotdata.slices(cells(spark, sf_dir)).withColumn("v", r("v"))


@query(_D + """, z AS (SELECT scene, max(y) AS h, max(x) AS w, max(band) AS nb, quantile_cont(value, 0.01) AS p0, quantile_cont(value, 0.99) AS p1 FROM d GROUP BY scene),
t AS (SELECT d.*, h, w, nb, round(least(1.0, greatest(0.0, coalesce((value - p0) / nullif(p1 - p0, 0), 0))), 9) + 0.0 AS v FROM d JOIN z USING (scene))
SELECT scene, 'top' AS face, y AS a, x AS b, v FROM t WHERE band = nb AND y % 2 = 0 AND x % 2 = 0 UNION ALL SELECT scene, 'front', x, band, v FROM t WHERE y = h AND x % 2 = 0
UNION ALL SELECT scene, 'back', x, band, v FROM t WHERE y = 0 AND x % 2 = 0 UNION ALL SELECT scene, 'left', y, band, v FROM t WHERE x = 0 AND y % 2 = 0 UNION ALL SELECT scene, 'right', y, band, v FROM t WHERE x = w AND y % 2 = 0""")
def vz6_faces(spark, sf_dir):
    return plotdata.faces(cells(spark, sf_dir)).withColumn("v", r("v"))


@query(_D + """, g AS (SELECT * FROM d WHERE y % 3 = 0 AND x % 3 = 0), l AS (SELECT scene, min(value) AS low, max(value) AS high FROM g GROUP BY scene), nb AS (SELECT scene, max(band) + 1 AS nb FROM d GROUP BY scene),
pk AS (SELECT DISTINCT scene, nb, CASE WHEN nb <= 5 THEN k ELSE k * (nb - 1) // 4 END AS band FROM nb, (SELECT CAST(unnest(range(5)) AS INTEGER) AS k) WHERE nb > 5 OR k < nb)
SELECT g.scene, g.band, nb - 1 - g.band AS z, y, x, value AS v, low, high FROM g JOIN pk ON pk.scene = g.scene AND pk.band = g.band JOIN l ON l.scene = g.scene""")
def vz5_stack(spark, sf_dir):
    return plotdata.stack(cells(spark, sf_dir), n=5)


_FACES = """z AS (SELECT scene, max(y) AS h, max(x) AS w, max(band) AS nb, min(value) AS g0, max(value) AS g1 FROM d GROUP BY scene), u AS (SELECT d.*, h, w, nb, g0, g1 FROM d JOIN z USING (scene)),
t AS (SELECT scene, 'front' AS face, x AS a, band AS b, value, g0, g1 FROM u WHERE y = h UNION ALL SELECT scene, 'back', x, band, value, g0, g1 FROM u WHERE y = 0
UNION ALL SELECT scene, 'left', y, band, value, g0, g1 FROM u WHERE x = 0 UNION ALL SELECT scene, 'right', y, band, value, g0, g1 FROM u WHERE x = w"""


@query(_D + ", " + _FACES + """ UNION ALL SELECT scene, 'top', y, x, avg(value), NULL, NULL FROM d GROUP BY scene, y, x), l AS (SELECT scene, face, min(value) AS f0, max(value) AS f1 FROM t GROUP BY scene, face)
SELECT scene, face, a, b, round(coalesce((value - f0) / nullif(f1 - f0, 0), 0), 9) + 0.0 AS v FROM t JOIN l USING (scene, face) WHERE a % 2 = 0 AND (face <> 'top' OR b % 2 = 0)""")
def vz6_faces_mean_surface(spark, sf_dir):
    return plotdata.faces(cells(spark, sf_dir), scaling="surface", top="mean").withColumn("v", r("v"))


@query(_D + ", " + _FACES + """ UNION ALL SELECT scene, CASE band WHEN 0 THEN 'top_r' WHEN 3 THEN 'top_g' ELSE 'top_b' END, y, x, value, g0, g1 FROM u WHERE band IN (0, 3, 6))
SELECT scene, face, a, b, round(coalesce((value - g0) / nullif(g1 - g0, 0), 0), 9) + 0.0 AS v FROM t WHERE a % 2 = 0 AND (face NOT LIKE 'top%' OR b % 2 = 0)""")
def vz6_faces_rgb_global(spark, sf_dir):
    return plotdata.faces(cells(spark, sf_dir), scaling="global", top="rgb", rgb=(0, 3, 6)).withColumn("v", r("v"))
