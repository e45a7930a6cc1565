"""Queries of the general data problems (1, 2 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe.operators import rejects, spikes
from cubeframe.operators.packed_values import split_packed
from cubeframe.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "mapping_lines").select("line_id", "species")
    return split_packed(lines, "species", "species").select("line_id", "ordinal", "species")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(rejects.parse_lines(table(spark, sf_dir, "raw_lines"))).select("record_id", "reason")


def p2_wavelengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.wavelengths(rejects.parse_lines(table(spark, sf_dir, "raw_lines")))


def p2_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.mappings(rejects.parse_lines(table(spark, sf_dir, "raw_lines")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flag_readings(table(spark, sf_dir, "cube_cells")).select("scene", "y", "x", "band", "kind")


def p5_by_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scene and kind: readings, spike candidates and isolation scores, over all readings."""
    scored = spikes.flag_readings(table(spark, sf_dir, "cube_cells"), all_scores=True)
    return scored.groupBy("scene", "kind").agg(
        F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("threshold")).alias("candidates"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.first("threshold").alias("threshold")
    )


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_wavelengths, p2_mapping, p5_found, p5_by_scene)}

_P2 = r"""
WITH lines AS (
  SELECT record_id, record_type, coalesce(nullif(sep, ''), chr(31)) AS sep,
         CASE WHEN line_text LIKE '%' || chr(13) THEN left(line_text, length(line_text) - 1) ELSE line_text END AS l
  FROM raw_lines),
patterns AS (
  SELECT *, CASE WHEN sep = chr(9) THEN '[ \n\r\f\v]*' ELSE '[\s]*' END AS w, regexp_escape(sep) AS s FROM lines),
fielded AS (
  SELECT *, '(?:' || w || '"(?:[^"]|"")*"' || w || '|[^"' || s || ']*)' AS f FROM patterns),
cut AS (
  SELECT *, coalesce(NOT regexp_full_match(l, f || '(?:' || s || f || ')*', 's'), false) AS badly,
         regexp_extract_all(sep || l, s || '(' || f || ')', 1, 's') AS raw FROM fielded),
fields AS (
  SELECT *, list_transform(raw, lambda r: CASE WHEN regexp_matches(r, '^\s*"') THEN
           replace(regexp_extract(r, '^\s*"((?s:.*))"\s*$', 1), '""', '"') ELSE regexp_replace(r, '^\s+|\s+$', '', 'g') END) AS v
  FROM cut),
judged AS (
  SELECT *, CASE WHEN badly THEN 'quoting' WHEN l IS NULL OR len(v) <> 3 THEN 'columns'
    WHEN coalesce(regexp_full_match(v[1], 'scene[0-9]+') AND regexp_full_match(v[2], '[0-9]+') AND
      CASE WHEN record_type = 'wavelength' THEN regexp_full_match(v[3], '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
             AND TRY_CAST(v[3] AS DOUBLE) BETWEEN 200 AND 3000
           WHEN record_type = 'mapping' THEN regexp_matches(v[2], '[1-9]') AND regexp_matches(v[3], '\p{L}')
             AND NOT regexp_matches(v[3], '[\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]') ELSE false END, false) THEN NULL
    ELSE 'value' END AS reason FROM fields)
"""

SQL = {
    "p2_found": _P2 + "SELECT record_id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_wavelengths": _P2
    + "SELECT record_id, v[1] AS scene, CAST(v[2] AS BIGINT) AS band, CAST(v[3] AS DOUBLE) AS wavelength FROM judged WHERE reason IS NULL AND record_type = 'wavelength'",
    "p2_mapping": _P2
    + "SELECT record_id, v[1] AS scene, CAST(v[2] AS BIGINT) AS ordinal, v[3] AS species FROM judged WHERE reason IS NULL AND record_type = 'mapping'",
    "p5_found": """
WITH d AS (SELECT scene, y, x, band, max(value) AS v FROM cube_cells WHERE value IS NOT NULL AND NOT isnan(value)
           AND scene IS NOT NULL AND y >= 0 AND x >= 0 AND band >= 0 GROUP BY scene, y, x, band),
ok AS (SELECT * FROM d WHERE v BETWEEN 0 AND 1.25),
m AS (SELECT scene, band, median(v) AS med FROM ok GROUP BY scene, band),
a AS (SELECT scene, band, any_value(med) AS med, median(abs(v - med)) AS mad FROM ok JOIN m USING (scene, band) GROUP BY scene, band),
g AS (SELECT *, y - row_number() OVER (PARTITION BY scene, x, band, v ORDER BY y) AS g FROM d),
r AS (SELECT *, count(*) OVER (PARTITION BY scene, x, band, v, g) AS n FROM g),
k AS (SELECT r.scene, r.y, r.x, r.band, CASE WHEN NOT (v BETWEEN 0 AND 1.25) THEN 'impossible' WHEN n >= 6 THEN 'stuck'
        WHEN abs(v - med) > 14.826 * mad + 1e-12 THEN 'spike' END AS kind FROM r LEFT JOIN a USING (scene, band))
SELECT * FROM k WHERE kind IS NOT NULL""",
}
