"""Grid, polygon and mask operators."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from fieldtrends.operators import spatial
from fieldtrends.session import work_folder
from fieldtrends.sources import adapters as A, observations
from fieldtrends.suite import tables as S
from fieldtrends.suite.registry import query

G = ["gridg0", "gridg1", "gridg2", "gridg3", "gridg4"]
CHECKLISTS = """points AS (SELECT group_id, lon, lat FROM (SELECT *, row_number() OVER (
    PARTITION BY group_id ORDER BY line_no, part_no, price) AS rk FROM deduped) WHERE rk = 1)"""
LAYERS = {"pa_name": "pa", "land": "land"}
GRID_SQL = ", ".join(f"{S.cell(s)} AS {g}" for g, s in zip(G, ["0.25", "1", "2", "4", "8"]))


def tags(spark, d):
    pts = spatial.checklist_points(A.deduped(spark, d), A.ORDER)
    return spatial.tag_points(pts, A.polygons(spark), LAYERS, A.GRID_SIZES)


@query("g01_tag_points", S.upto("deduped", "name", CHECKLISTS, S.EDGES, S.HITS) + f"""
  SELECT p.group_id, a.id AS pa_name, b.id AS land, {GRID_SQL}
  FROM points p LEFT JOIN hits a ON a.group_id = p.group_id AND a.layer = 'pa'
  LEFT JOIN hits b ON b.group_id = p.group_id AND b.layer = 'land'""")
def g01(spark, d):
    return tags(spark, d).select("group_id", "pa_name", "land", *G)


@query("g02_first_match", S.upto("deduped", "name", CHECKLISTS, S.EDGES, S.HITS) + """
  SELECT p.group_id, min(h.id) AS pa_name FROM points p LEFT JOIN hits h
  ON h.group_id = p.group_id AND h.layer = 'pa' GROUP BY 1""")
def g02(spark, d):
    return spatial.first_match(tags(spark, d), [F.col("pa_name").asc_nulls_last()]).select("group_id", "pa_name")


@query("g03_land_and_habitat", S.upto("masked") + "SELECT group_id, common_name, pa_name, mask_wdl, mask_crp, mask_one FROM masked")
def g03(spark, d):
    return A.masked(spark, d).select("group_id", "common_name", "pa_name", "mask_wdl", "mask_crp", "mask_one")


# two parts, one with a hole, and a plain square that overlaps both
SHAPES = {
    "reserve": [[[(70.305, 10.105), (84.205, 11.405), (82.605, 30.705), (72.105, 27.905)], [(74.205, 14.405), (79.805, 14.905), (78.905, 23.305), (74.705, 22.805)]],
                [[(86.505, 12.205), (95.405, 13.105), (91.305, 33.605)]]],
    "square": [[[(76.005, 13.005), (90.005, 13.005), (90.005, 20.005), (76.005, 20.005)]]],
}
SHAPE_EDGES = "edges AS (SELECT 'parks' AS layer, * FROM (VALUES " + ", ".join(
    f"('{pid}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)"
    for pid, parts in SHAPES.items() for part in parts for ring in part for a, b in zip(ring, ring[1:] + ring[:1])) + ") t(id, x1, y1, x2, y2))"


def geojson(shapes) -> str:
    features = [{"type": "Feature", "properties": {"name": pid}, "geometry": {"type": "MultiPolygon", "coordinates": [[[*ring, ring[0]] for ring in part] for part in parts]}}
                for pid, parts in shapes.items()]
    return json.dumps({"type": "FeatureCollection", "features": features})


def parks(spark):
    """The shapes, written as GeoJSON and read back."""
    path = f"{work_folder(spark)}/layer-{uuid.uuid4().hex}"
    spark.createDataFrame([(geojson(SHAPES),)], "value string").coalesce(1).write.text(path)
    return spatial.with_edges(observations.read_geojson_polygons(spark, path, "parks", "name"))


@query("s07_geojson_polygons", S.upto("deduped", "name", CHECKLISTS, SHAPE_EDGES, S.HITS) + """
  SELECT group_id, id AS park FROM hits""")
def s07(spark, d):
    """Checklists inside polygons with parts and holes, read from a file."""
    return spatial.tag_layer(spatial.checklist_points(A.deduped(spark, d), A.ORDER), parks(spark), "parks", "park")


@query("g07_points_in_holed", S.upto("deduped", "name", CHECKLISTS, SHAPE_EDGES, S.HITS) + """
  SELECT group_id, lon, lat FROM points WHERE group_id IN (SELECT group_id FROM hits WHERE id = 'reserve')""")
def g07_holed(spark, d):
    pts = spatial.checklist_points(A.deduped(spark, d), A.ORDER)
    return spatial.points_in(pts, parks(spark), "parks", "reserve", "group_id").select("group_id", "lon", "lat")


FLAGS = {"woodland": "mask_wdl", "cropland": "mask_crp", "ONEland": "mask_one"}
BY_MASK = """bymask AS (
  SELECT 'none' AS mask, * FROM masked UNION ALL SELECT 'woodland', * FROM masked WHERE mask_wdl = 1
  UNION ALL SELECT 'cropland', * FROM masked WHERE mask_crp = 1 UNION ALL SELECT 'ONEland', * FROM masked WHERE mask_one = 1
  UNION ALL SELECT 'PA', * FROM masked WHERE pa_name IS NOT NULL UNION ALL SELECT state, * FROM masked)"""


@query("g04_apply_mask", S.upto("masked", "name", BY_MASK) + """
  SELECT mask, count(*) AS observations, count(DISTINCT group_id) AS checklists, count(DISTINCT common_name) AS species
  FROM bymask GROUP BY mask""")
def g04(spark, d):
    return spatial.apply_mask(A.masked(spark, d), FLAGS).groupBy("mask").agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("group_id").alias("checklists"),
        F.count_distinct("common_name").alias("species"))


@query("g05_sampled_cells", S.upto("masked", "name", BY_MASK) + """
  SELECT mask, """ + ", ".join(f"count(DISTINCT {g}) AS {g}" for g in G) + " FROM bymask GROUP BY mask")
def g05(spark, d):
    return spatial.sampled_cells(spatial.apply_mask(A.masked(spark, d), FLAGS), G, ["mask"])


@query("g06_admin_mismatch", S.upto("deduped", "name", CHECKLISTS, S.EDGES, S.HITS,
       "loc AS (SELECT group_id, min(id) AS located FROM hits WHERE layer = 'pa' GROUP BY 1)",
       "t AS (SELECT d.*, located, CASE WHEN lat >= 25 AND lon < 80 THEN 'PA north' WHEN lat < 20 THEN 'PA tri' END AS declared "
       "FROM deduped d LEFT JOIN loc USING (group_id))") + """
  SELECT DISTINCT group_id, declared AS district, 'declared' AS only_by FROM t WHERE declared IS NOT NULL AND declared IS DISTINCT FROM located
  UNION ALL SELECT DISTINCT group_id, located, 'located' FROM t WHERE located IS NOT NULL AND declared IS DISTINCT FROM located""")
def g06(spark, d):
    obs = A.deduped(spark, d)
    pts = spatial.checklist_points(obs, A.ORDER)
    located = spatial.first_match(
        spatial.tag_layer(pts, A.polygons(spark), "pa", "located"), ["located"])
    declared = F.when((F.col("lat") >= 25) & (F.col("lon") < 80), "PA north").when(F.col("lat") < 20, "PA tri")
    both = obs.withColumn("declared", declared).join(located, "group_id", "left")
    return spatial.admin_mismatch(both, "declared", "located", None, ["group_id"])


@query("g07_points_in_polygon", S.upto("deduped", "name", CHECKLISTS, S.EDGES, S.HITS) + """
  SELECT group_id, lon, lat FROM points WHERE group_id IN (SELECT group_id FROM hits WHERE id = 'PA tri')""")
def g07(spark, d):
    pts = spatial.checklist_points(A.deduped(spark, d), A.ORDER)
    return spatial.points_in(pts, A.polygons(spark), "pa", "PA tri", "group_id")


OCC_SQL = """occ AS (SELECT common_name, gridg1, CASE WHEN max(all_species_reported) = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS occupancy,
    max(CASE WHEN month IN (11,12,1,2) THEN 'MW' ELSE 'MS' END) AS status FROM ana GROUP BY 1, 2)"""


def occupancy_like(spark, d, ana=None):
    return (A.analysis_table(spark, d) if ana is None else ana).groupBy("common_name", "gridg1").agg(
        F.when(F.max("all_species_reported") == 1, 1.0).otherwise(0.5).alias("occupancy"),
        F.max(F.when(F.col("month").isin(11, 12, 1, 2), "MW").otherwise("MS")).alias("status"))


@query("g08_drop_false_presence", S.upto("ana", "name", OCC_SQL) + """
  SELECT common_name, gridg1, occupancy FROM occ o WHERE NOT (occupancy = 1 AND NOT EXISTS (
    SELECT 1 FROM ana a WHERE a.common_name = o.common_name AND a.gridg1 = o.gridg1 AND a.category = 'species'))""")
def g08(spark, d):
    ana = A.analysis_table(spark, d, reuse=True, columns=["common_name", "gridg1", "category", "month", "all_species_reported"])
    truth = ana.filter("category = 'species'").select("common_name", "gridg1").distinct()
    return spatial.drop_false_presence(occupancy_like(spark, d, ana), truth).select("common_name", "gridg1", "occupancy")


@query("g09_cell_coverage", S.upto("ana") + """
  SELECT c.gridg1, coalesce(n, 0) AS lists, coalesce(n, 0) > 0 AS sampled FROM (SELECT DISTINCT gridg1 FROM ana) c
  LEFT JOIN (SELECT gridg1, count(DISTINCT group_id) AS n FROM ana WHERE all_species_reported = 1 AND year = 2000 GROUP BY 1) USING (gridg1)""")
def g09(spark, d):
    ana = A.analysis_table(spark, d)
    return spatial.cell_coverage(ana, ana.filter("all_species_reported = 1 AND year = 2000"))


@query("g10_top_priority_cells", S.upto("deduped", "part") + f"""
  SELECT state, gridg1, no_sp FROM (SELECT state, gridg1, no_sp,
      row_number() OVER (PARTITION BY state ORDER BY no_sp DESC, gridg1) AS rn
    FROM (SELECT state, {S.cell('1')} AS gridg1, count(DISTINCT common_name) AS no_sp FROM deduped
      WHERE part_no % 6 = 0 GROUP BY 1, 2)) WHERE rn <= 5""")
def g10(spark, d):
    obs = spatial.with_grids(A.deduped(spark, d, "part"), A.GRID_SIZES)
    main = A.table(spark, d, "part").select(
        F.concat(F.lit("SP"), "p_partkey").alias("species"),
        F.when(F.col("p_partkey") % 6 == 0, "High").otherwise("Low").alias("priority_status"))
    return spatial.top_priority_cells(obs, main)


@query("g11_queen_neighbours", S.upto("gridded", "name", "c AS (SELECT DISTINCT gridg1 FROM gridded)") + """
  SELECT a.gridg1, b.gridg1 AS nb_cell FROM c a JOIN c b ON a.gridg1 <> b.gridg1
  AND abs(a.gridg1 // 100000 - b.gridg1 // 100000) <= 1 AND abs(a.gridg1 % 100000 - b.gridg1 % 100000) <= 1""")
def g11(spark, d):
    return spatial.queen_neighbours(A.gridded(spark, d))


@query("g12_range_layer", S.upto("ana", "name", OCC_SQL) + """
  SELECT o.common_name, c.gridg1, o.occupancy, o.status AS seasons, FALSE AS vagrant
  FROM (SELECT DISTINCT gridg1 FROM ana) c LEFT JOIN (SELECT * FROM occ WHERE occupancy = 1) o USING (gridg1)
  UNION ALL SELECT DISTINCT common_name, gridg1, NULL, NULL, TRUE FROM ana WHERE year = 2000 AND month = 1""")
def g12(spark, d):
    ana = A.analysis_table(spark, d)
    return spatial.range_layer(occupancy_like(spark, d).filter("occupancy = 1"), ana, ana.filter("year = 2000 AND month = 1"))
