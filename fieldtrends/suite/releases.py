"""Release and attribute comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrends.operators import clean, releases as rel
from fieldtrends.sources import adapters as A
from fieldtrends.suite import tables as S
from fieldtrends.suite.registry import query

COLS = ["scientific_name", "group_id", "obs_count", "locality_id", "duration_min", "year"]
LIST = ", ".join(COLS)
RELEASES = f"""d AS (SELECT *, coalesce(group_identifier, event_id) AS group_id, year(obs_date) AS cyear,
    year(obs_date) - CASE WHEN month(obs_date) <= 5 THEN 1 ELSE 0 END AS year FROM obs),
new_ AS (SELECT scientific_name, group_id, CASE WHEN part_no % 50 = 7 THEN 'X' ELSE obs_count END AS obs_count, locality_id, duration_min, year, cyear FROM d
  WHERE exotic_code IS NULL OR exotic_code NOT IN ('X', 'P')),
old_ AS (SELECT CASE WHEN common_name = 'red widget' THEN 'Genus gone' ELSE scientific_name END AS scientific_name, group_id, obs_count, locality_id, duration_min, year, cyear FROM d WHERE year < 2000 AND reviewed = 0),
pn AS (SELECT {LIST} FROM new_ WHERE year <> 2000), po AS (SELECT {LIST} FROM old_ WHERE scientific_name IN (SELECT scientific_name FROM pn))"""


def releases(spark, d):
    obs = clean.with_date_parts(clean.with_group_id(A.observations(spark, d)))
    new = clean.quality_filter(obs.withColumns({"reviewed": F.lit(0)}), ("X", "P")).withColumn(
        "obs_count", F.when(F.col("part_no") % 50 == 7, "X").otherwise(F.col("obs_count")))
    old = obs.filter("year < 2000 AND reviewed = 0").withColumn(
        "scientific_name", F.when(F.col("common_name") == "red widget", "Genus gone").otherwise(F.col("scientific_name")))
    return old, new


@query("m28_release_delta", S.with_(S.obs(), RELEASES) + f"""
  SELECT {LIST}, 'current' AS change FROM new_ WHERE year = 2000
  UNION ALL SELECT *, 'added' FROM (SELECT * FROM pn EXCEPT SELECT * FROM po)
  UNION ALL SELECT *, 'deleted' FROM (SELECT * FROM po EXCEPT SELECT * FROM pn)""")
def m28(spark, d):
    old, new = releases(spark, d)
    return rel.release_delta(old, new, 2000, COLS)


DUP = ["common_name", "locality_id", "month", "duration_min"]
DLIST = ", ".join(DUP)
DUPS = f"""dp AS (SELECT {DLIST} FROM dated), more AS (SELECT {DLIST} FROM dp GROUP BY ALL HAVING count(*) > 1)"""


def dup_source(spark, d):
    return clean.with_date_parts(clean.with_group_id(clean.quality_filter(A.observations(spark, d))))


@query("m29_full_duplicates", S.upto("listed", "name", DUPS) + f"""
  SELECT common_name, locality_id, month, duration_min, count(*) OVER (PARTITION BY {DLIST}) AS copies FROM dp
  QUALIFY count(*) OVER (PARTITION BY {DLIST}) > 1""")
def m29(spark, d):
    src = dup_source(spark, d)
    copies, _ = rel.full_duplicates(src, src, DUP)
    n = copies.groupBy(*DUP).agg(F.count(F.lit(1)).alias("copies"))
    return n.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("i")


@query("m29_replacements", S.upto("listed", "name", DUPS) + f"""
  SELECT {DLIST}, count(*) AS n FROM dated t WHERE approved = 1 AND EXISTS (SELECT 1 FROM more m WHERE {' AND '.join(f't.{c} IS NOT DISTINCT FROM m.{c}' for c in DUP)}) GROUP BY {DLIST}""")
def m29b(spark, d):
    src = dup_source(spark, d)
    _, repl = rel.full_duplicates(src, src.filter("approved = 1"), DUP)
    return repl.groupBy(*DUP).agg(F.count(F.lit(1)).alias("n"))


ATTRS = ["iucn", "endemic_region", "habitat", "one_percent", "migratory_status"]


def new_sheet(spark, d):
    m = A.main_table(spark, d).filter("k % 41 <> 0")
    k = F.col("k")
    return m.select("species", F.when(k % 8 == 0, "Endangered").otherwise(F.col("iucn")).alias("iucn"), "endemic_region",
                    F.when(k % 15 == 0, None).otherwise(F.col("habitat")).alias("habitat"),
                    F.when(k % 6 == 0, k % 40 + 11).otherwise(F.col("one_percent")).alias("one_percent"), "migratory_status")


NEW = """sheet AS (SELECT species, CASE WHEN k % 8 = 0 THEN 'Endangered' ELSE iucn END AS iucn, endemic_region, CASE WHEN k % 15 = 0 THEN NULL ELSE habitat END AS habitat,
    CASE WHEN k % 6 = 0 THEN k % 40 + 11 ELSE one_percent END AS one_percent, migratory_status FROM main0 WHERE k % 41 <> 0)"""


@query("m30_attribute_changes", S.with_(S.MAIN0, NEW) + " UNION ALL ".join(
    f"SELECT n.species, '{a}' AS attribute, CAST(o.{a} AS VARCHAR) AS old_value, CAST(n.{a} AS VARCHAR) AS new_value FROM sheet n JOIN main0 o USING (species) WHERE o.{a} IS DISTINCT FROM n.{a}" for a in ATTRS))
def m30(spark, d):
    return rel.attribute_changes(A.main_table(spark, d), new_sheet(spark, d), "species", ATTRS)


@query("m31_refresh_attribute", S.with_(S.MAIN0, NEW) + "SELECT m.species, m.grp, s.iucn FROM main0 m LEFT JOIN sheet s USING (species)")
def m31(spark, d):
    return rel.refresh_attribute(A.main_table(spark, d).select("species", "grp", "iucn"), new_sheet(spark, d), "species", "iucn")


@query("m31_crosswalk", S.with_(S.MAIN0) + """
  SELECT species AS name, CASE WHEN k % 41 <> 0 THEN checklist_name END AS name_new, k % 41 <> 0 AS valid FROM main0""")
def m31b(spark, d):
    m = A.main_table(spark, d)
    return rel.crosswalk(m.select(F.col("species").alias("name")), m.filter("k % 41 <> 0"), "species", "checklist_name")


@query("m31_append_database", S.with_(S.MAIN0) + """
  SELECT release, count(*) AS n, count(iucn) AS with_iucn FROM (SELECT 1999 AS release, iucn FROM main0 WHERE k % 2 = 0 UNION ALL SELECT 2000, NULL FROM main0) GROUP BY 1""")
def m31c(spark, d):
    m = A.main_table(spark, d)
    db = m.filter("k % 2 = 0").select("species", "iucn").withColumn("release", F.lit(1999))
    return rel.append_database(db, m.select("species"), 2000).groupBy("release").agg(
        F.count(F.lit(1)).alias("n"), F.count("iucn").alias("with_iucn"))
