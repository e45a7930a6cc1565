"""Queries of the problems 3, 4 and 6 to 9, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe.llm import canonical, containers, leaks, percentiles, pieces, splits
from cubeframe.llm.tokens import n_tokens
from cubeframe.session import checkpointed, table


def _species_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, y1, y2, x1, x2, group: regions with the species_id of their sample; the latest mapping entry holds."""
    mapping = canonical.with_entry(table(spark, sf_dir, "mapping").select("mapping_id", "scene", "ordinal", "species", "entered_at"), "species", table(spark, sf_dir, "species_list"))
    latest = mapping.where("species_id > 0 AND scene IS NOT NULL AND ordinal IS NOT NULL").groupBy("scene", "ordinal")
    named = latest.agg(F.max_by("species_id", F.struct(F.coalesce("entered_at", F.timestamp_seconds(F.lit(0))), "mapping_id")).alias("group"))
    return table(spark, sf_dir, "regions").join(named, ["scene", "ordinal"]).select("scene", "y1", "y2", "x1", "x2", "group")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ties = splits.scene_ties(table(spark, sf_dir, "scenes"), table(spark, sf_dir, "mapping"))
    return splits.components(ties).select(F.col("node").alias("scene"), F.col("component").alias("group_scene"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scene with its group and split; the scenes are balanced over all, their entries per species."""
    mapping = table(spark, sf_dir, "mapping")
    groups = checkpointed(splits.scene_groups(table(spark, sf_dir, "scenes"), mapping))
    entries = canonical.with_entry(mapping.select("scene", "species"), "species", table(spark, sf_dir, "species_list")).groupBy("scene", "species_id").agg(F.count("*").alias("n"))
    strata = (
        groups.select("component", F.lit("scenes").alias("kind"), F.lit("all").alias("stratum"), F.lit(1).cast("bigint").alias("weight"))
        .union(groups.join(entries, F.col("record") == F.col("scene")).where("species_id IS NOT NULL").select("component", F.lit("species"), F.col("species_id").cast("string"), "n"))
    )
    return splits.split_groups(groups, strata).select(F.col("record").alias("scene"), F.col("component").alias("group_scene"), "split")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """species_id, band, n, p01, p05, median, p95, p99, from counts per load_date; exact to half of 1e-4."""
    state = percentiles.region_counts(table(spark, sf_dir, "cube_cells"), _species_regions(spark, sf_dir))
    return percentiles.percentiles(percentiles.unpacked(state, ["group", "band"]), ["group", "band"]).withColumnRenamed("group", "species_id")


def p4_scene_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles per scene and band."""
    state = percentiles.scene_counts(table(spark, sf_dir, "cube_cells"))
    return percentiles.percentiles(percentiles.unpacked(state, ["group", "band"]), ["group", "band"]).withColumnRenamed("group", "scene")


def p4_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles per region and band."""
    regions = table(spark, sf_dir, "regions").select("scene", "y1", "y2", "x1", "x2", F.col("region_id").cast("int").alias("group"))
    state = percentiles.region_counts(table(spark, sf_dir, "cube_cells"), regions)
    return percentiles.percentiles(percentiles.unpacked(state, ["group", "band"]), ["group", "band"]).withColumnRenamed("group", "region_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical.with_entry(table(spark, sf_dir, "mapping").select("mapping_id", "species"), "species", table(spark, sf_dir, "species_list"))
    return rows.where("species_id IS NOT NULL").select("mapping_id", "species_id")


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.unmatched(table(spark, sf_dir, "mapping").select("mapping_id", "species"), "species", table(spark, sf_dir, "species_list"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, token_from, n_tokens, container: sizes by a byte-level BPE of 50,257 tokens."""
    sizes = checkpointed(table(spark, sf_dir, "documents").select("doc_id", n_tokens(F.col("text")).alias("size")))
    return containers.fill(sizes, "doc_id", "size")


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.usage(p7_containers(spark, sf_dir))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 12 and 24 words, with edits by their length."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).where("edits = 0").select("doc_id", "item_id")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_oversized(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces.split_oversized(table(spark, sf_dir, "documents"), with_text=False)
    return cut.where("cell_no > 0 AND piece = 1").select("doc_id", "cell_no").distinct()


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_splits, p4_percentiles, p4_scene_bands, p4_regions, p6_found, p6_unmatched, p7_containers, p7_usage, p8_found, p8_leaks, p9_found, p9_pieces)
}


def _percentiles_sql(source: str, key: str) -> str:
    """Percentiles of source (key, band, b) over the readings, each position once."""
    return (
        f"""WITH d AS (SELECT scene, y, x, band, CAST(round(max(value) / 1e-4) AS BIGINT) AS b FROM cube_cells WHERE value IS NOT NULL AND NOT isnan(value) AND scene IS NOT NULL
AND y >= 0 AND x >= 0 AND band >= 0 GROUP BY scene, y, x, band HAVING isfinite(max(value))), v AS ({source}),
r AS (SELECT *, row_number() OVER (PARTITION BY {key}, band ORDER BY b) AS r, count(*) OVER (PARTITION BY {key}, band) AS n FROM v),
w AS (SELECT {key}, band, max(n) AS n, """
        + ", ".join(f"min(CASE WHEN r >= ceil(n * {p} - 1e-9) THEN b END) AS {c}" for c, p in percentiles.PROBS.items())
        + f" FROM r GROUP BY {key}, band) SELECT {key}, band, n, "
        + ", ".join(f"round({c} * 1e-4, 12) AS {c}" for c in percentiles.PROBS)
        + " FROM w"
    )


SQL = {
    "p3_found": r"""
WITH RECURSIVE s AS (SELECT DISTINCT scene, session_code, recapture_of FROM scenes WHERE scene IS NOT NULL),
codes AS (
  SELECT scene, 'ses' AS kind, session_code AS code FROM s UNION ALL
  SELECT m.scene, 'sp', specimen FROM mapping m WHERE m.scene IN (SELECT scene FROM s)),
keyed AS (
  SELECT DISTINCT scene, kind, upper(regexp_replace(code, '[^\p{L}]', '', 'g')) AS letters,
         regexp_replace(regexp_extract(code, '[0-9]+'), '^0+([0-9])', '\1') AS number FROM codes WHERE regexp_matches(code, '[0-9]')),
stars AS (SELECT scene AS a, min(scene) OVER (PARTITION BY kind, letters, number) AS b FROM keyed),
refs AS (SELECT scene AS a, CAST(regexp_extract(recapture_of, '(?i)scene[^0-9A-Za-z]*([0-9]+)', 1) AS BIGINT) AS n FROM s WHERE regexp_matches(recapture_of, '(?i)scene[^0-9A-Za-z]*[0-9]')),
ties AS (SELECT a, b FROM stars UNION SELECT refs.a, s.scene FROM refs JOIN s ON CAST(regexp_extract(s.scene, '[0-9]+') AS BIGINT) = refs.n),
edges AS (SELECT a, b FROM ties WHERE a <> b UNION SELECT b, a FROM ties WHERE a <> b),
reach AS (SELECT a AS scene, a AS other FROM edges UNION SELECT r.scene, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT scene, min(other) AS group_scene FROM reach GROUP BY scene""",
    "p4_scene_bands": _percentiles_sql("SELECT scene, band, b FROM d", "scene"),
    "p4_regions": _percentiles_sql("SELECT CAST(region_id AS INTEGER) AS region_id, band, b FROM d JOIN regions r ON d.scene = r.scene AND y >= y1 AND y < y2 AND x >= x1 AND x < x2", "region_id"),
    "p9_found": """
WITH c AS (SELECT doc_id, text, unnest(cell_starts) AS a, unnest(list_concat(cell_starts[2:], [length(text)])) AS b, generate_subscripts(cell_starts, 1) AS cell_no FROM documents)
SELECT doc_id, CAST(cell_no AS INTEGER) AS cell_no FROM c WHERE strlen(substring(text, a + 1, b - a)) > 4096""",
}
