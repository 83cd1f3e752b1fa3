"""Sources and cleaning (S02-S03, S08-S11, C01-C18) over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldtrends.operators import clean, mistakes
from fieldtrends.session import work_folder
from fieldtrends.sources import adapters as A, masks, observations, sinks
from fieldtrends.suite import tables as S
from fieldtrends.suite.registry import query

RAW = ["event_id", "common_name", "line_no", "part_no"]
RAW_SQL = "event_id, common_name, line_no, part_no"


# ------------------------------------------------------------------ sources
@query("s02_union_sources", S.with_(S.obs()) + """
  SELECT category, state, count(*) AS n FROM (
    SELECT category, state FROM obs WHERE exotic_code IS NULL
    UNION ALL SELECT category, state FROM obs WHERE exotic_code IS NOT NULL) GROUP BY category, state""")
def s02(spark, d):
    obs = A.observations(spark, d)
    both = observations.union_sources(obs.filter("exotic_code IS NULL"), obs.filter("exotic_code IS NOT NULL"))
    return both.groupBy("category", "state").agg(F.count(F.lit(1)).alias("n"))


@query("s03_dimension_lookup", """
  SELECT n_name AS state, r_name AS zone, count(*) AS customers FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def s03(spark, d):
    n, r = A.table(spark, d, "nation"), A.table(spark, d, "region")
    zones = n.join(r, n.n_regionkey == r.r_regionkey)
    c = A.table(spark, d, "customer")
    return (
        c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
        .join(zones, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("state"), F.col("r_name").alias("zone"), "customers")
    )


@query("s08_mask_registry", """
  SELECT *, lpad(CAST(ord AS VARCHAR), 2, '0') || '_' || lower(mask) AS code FROM (
    SELECT * FROM (VALUES ('none','country',1,'Full country'), ('woodland','habitat',2,'Woodland'),
      ('cropland','habitat',3,'Cropland'), ('ONEland','habitat',4,'Open natural ecosystems'),
      ('PA','conservation_area',5,'Protected areas')) t(mask, mask_type, ord, label)
    UNION ALL SELECT n_name, 'state', CAST(dense_rank() OVER (ORDER BY n_name) + 5 AS INT), n_name
    FROM (SELECT DISTINCT n_name FROM nation))""")
def s08(spark, d):
    return masks.masks(A.table(spark, d, "nation"), "n_name")


@query("s09_replace_latest_year", S.upto("deduped") + """
  SELECT year, common_name, n FROM (
    SELECT year, common_name, count(*) AS n FROM deduped WHERE all_species_reported = 1 GROUP BY 1, 2)
  WHERE year <> 2000
  UNION ALL SELECT year, common_name, count(*) AS n FROM deduped WHERE year = 2000 GROUP BY 1, 2""")
def s09(spark, d):
    obs = A.deduped(spark, d)
    keys = ["year", "common_name"]
    old = obs.filter("all_species_reported = 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    new = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sinks.upsert_latest_year(old, new, A.YEARS.latest_year)


@query("s10_missing_partitions", S.with_(S.obs()) + """
  SELECT s.state, y.cyear FROM (SELECT DISTINCT state FROM obs) s
  CROSS JOIN (SELECT unnest(range(1995, 2002))::INT AS cyear) y
  WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.state = s.state AND year(o.obs_date) = y.cyear
    AND o.category = 'slash' AND o.exotic_code = 'X' AND o.reviewed = 1 AND o.approved = 1)""")
def s10(spark, d):
    obs = A.observations(spark, d).withColumn("cyear", F.year("obs_date"))
    expected = obs.select("state").distinct().withColumn("cyear", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    found = obs.filter("category = 'slash' AND exotic_code = 'X' AND reviewed = 1 AND approved = 1")
    return sinks.check_complete(expected, found, ["state", "cyear"])


@query("s11_case_studies", """
  SELECT p_type AS "case", CAST(row_number() OVER (ORDER BY p_type) - 1 AS INT) AS case_no, has_figure,
    lpad(CAST(row_number() OVER (ORDER BY p_type) - 1 AS VARCHAR), 2, '0') || '_' || p_type AS case_key,
    'data/' || lpad(CAST(row_number() OVER (ORDER BY p_type) - 1 AS VARCHAR), 2, '0') || '_' || p_type || '.csv' AS path_data,
    CASE WHEN has_figure THEN 'graphs/' || lpad(CAST(row_number() OVER (ORDER BY p_type) - 1 AS VARCHAR), 2, '0')
      || '_' || p_type || '.png' END AS path_out
  FROM (SELECT p_type, max(p_size) >= 50 AND p_type <> 'PROMO' AS has_figure FROM part GROUP BY p_type)""")
def s11(spark, d):
    cases = A.table(spark, d, "part").groupBy(F.col("p_type").alias("case")).agg(
        ((F.max("p_size") >= 50) & (F.first("p_type") != "PROMO")).alias("has_figure"))
    numbered = clean.dictionary(cases, "case", "no").withColumn("case_no", (F.col("no") - 1).cast("int"))
    return masks.case_studies(cases.join(numbered.drop("no"), "case"))


# ------------------------------------------------------------------ cleaning
@query("c01_quality_filter", S.with_(S.obs()) + f"""
  SELECT {RAW_SQL} FROM obs WHERE (reviewed = 0 OR approved = 1) AND coalesce(exotic_code, '-') <> 'X'""")
def c01(spark, d):
    return clean.quality_filter(A.observations(spark, d)).select(*RAW)


@query("c01_quality_filter_strict", S.with_(S.obs()) + f"""
  SELECT {RAW_SQL} FROM obs WHERE (reviewed = 0 OR approved = 1) AND coalesce(exotic_code, '-') NOT IN ('X', 'P')""")
def c01b(spark, d):
    return clean.quality_filter(A.observations(spark, d), ("X", "P")).select(*RAW)


@query("c02_group_id", S.with_(S.obs()) + f"SELECT {RAW_SQL}, coalesce(group_identifier, event_id) AS group_id FROM obs")
def c02(spark, d):
    return clean.with_group_id(A.observations(spark, d)).select(*RAW, "group_id")


@query("c03_date_parts", S.with_(S.obs()) + """
  SELECT DISTINCT obs_date, month(obs_date) AS month,
    day(obs_date) + [0,31,59,90,120,151,181,212,243,273,304,334][month(obs_date)] AS day,
    year(obs_date) AS cyear, year(obs_date) - CASE WHEN month(obs_date) <= 5 THEN 1 ELSE 0 END AS year FROM obs""")
def c03(spark, d):
    df = clean.with_date_parts(A.observations(spark, d))
    return df.select("obs_date", "month", "day", "cyear", "year").distinct()


@query("c04_list_length", S.upto("listed") + f"SELECT {RAW_SQL}, no_sp FROM listed")
def c04(spark, d):
    return A.listed(spark, d).select(*RAW, "no_sp")


REGIONS = [
    mistakes.RegionRule("north plains", ("NATION_1-0", "NATION_1-1", "NATION_2-2", "NATION_3-0")),
    mistakes.RegionRule("north plains", ("NATION_4-0",), state="NATION_4"),
    mistakes.RegionRule("north plains", ("NATION_5-1", "NATION_6-2"), lat_below=21.209),
    mistakes.RegionRule("coast", ("NATION_7-0", "NATION_8-1", "NATION_7-2"), lon_above=79.4),
    mistakes.RegionRule("coast", ("NATION_9-0", "NATION_10-1"), lat_above=11.1, lon_below=85.0),
]
REGION_SQL = """CASE WHEN district IN ('NATION_1-0','NATION_1-1','NATION_2-2','NATION_3-0') THEN 'north plains'
    WHEN district = 'NATION_4-0' AND state = 'NATION_4' THEN 'north plains'
    WHEN district IN ('NATION_5-1','NATION_6-2') AND lat < 21.209 THEN 'north plains'
    WHEN district IN ('NATION_7-0','NATION_8-1','NATION_7-2') AND lon > 79.4 THEN 'coast'
    WHEN district IN ('NATION_9-0','NATION_10-1') AND lat > 11.1 AND lon < 85.0 THEN 'coast' END"""


@query("c05_region", S.with_(S.obs()) + f"""
  SELECT {REGION_SQL} AS region, district, count(*) AS n, count(DISTINCT common_name) AS species FROM obs GROUP BY 1, 2""")
def c05(spark, d):
    df = mistakes.with_region(A.observations(spark, d), REGIONS)
    return df.groupBy("region", "district").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("common_name").alias("species"))


def rule(family, **kw):
    names = [f.name for f in mistakes.RULE_SCHEMA]
    return tuple({"family": family, **kw}.get(n) for n in names)


RULES = [
    rule("list", event_id="S1"), rule("list", event_id="S37"), rule("list", event_id="S140"),
    rule("species_list", common_name="red widget", event_id="S25"),
    rule("species_list", common_name="small ring", event_id="S77"),
    rule("observer", observer_id="obsr7"),
    rule("observer", observer_id="obsr12", common_name="red widget"),
    rule("admin", common_name="blue bolt", state="NATION_2"),
    rule("admin", common_name="blue bolt", district="NATION_3-1"),
    rule("admin_date", common_name="red widget", state="NATION_4", not_months=[3, 4, 10, 11]),
    rule("admin_date", common_name="blue bolt", state="NATION_5", months=[5]),
    rule("admin_date", common_name="small ring", state="NATION_6", year_after=1997),
    rule("place", common_name="small ring", region="north plains"),
    rule("place", common_name="red widget", district="NATION_7-0", lat_above=15.216),
    rule("place", common_name="blue bolt", region="coast", lon_below=90.0),
]


@query("c06_remove_mistakes", S.with_(S.obs(), "d AS (SELECT *, month(obs_date) AS month, year(obs_date) - CASE WHEN month(obs_date) <= 5 "
       "THEN 1 ELSE 0 END AS year, " + REGION_SQL + " AS region FROM obs)") + f"""
  SELECT {RAW_SQL} FROM d WHERE common_name <> 'green gear'
   AND event_id NOT IN ('S1','S37','S140')
   AND NOT (common_name = 'red widget' AND event_id = 'S25') AND NOT (common_name = 'small ring' AND event_id = 'S77')
   AND observer_id <> 'obsr7' AND NOT (observer_id = 'obsr12' AND common_name = 'red widget')
   AND NOT (common_name = 'blue bolt' AND (state = 'NATION_2' OR district = 'NATION_3-1'))
   AND NOT (common_name = 'red widget' AND state = 'NATION_4' AND month NOT IN (3,4,10,11))
   AND NOT (common_name = 'blue bolt' AND state = 'NATION_5' AND month = 5)
   AND NOT (common_name = 'small ring' AND state = 'NATION_6' AND year > 1997)
   AND NOT (common_name = 'small ring' AND coalesce(region, '') = 'north plains')
   AND NOT (common_name = 'red widget' AND district = 'NATION_7-0' AND lat > 15.216)
   AND NOT (common_name = 'blue bolt' AND coalesce(region, '') = 'coast' AND lon < 90.0)""")
def c06(spark, d):
    obs = mistakes.with_region(clean.with_date_parts(A.observations(spark, d)), REGIONS)
    rules = spark.createDataFrame(RULES, mistakes.RULE_SCHEMA)
    return mistakes.remove_mistakes(obs, rules, banned=["green gear"]).select(*RAW)


@query("c07_species_index", S.with_(S.obs()) + """
  SELECT DISTINCT common_name, scientific_name FROM obs WHERE category IN ('species', 'issf')""")
def c07(spark, d):
    return clean.species_index(A.observations(spark, d))


@query("c07_locality_index", S.with_(S.obs()) + "SELECT DISTINCT locality_id, lat, lon FROM obs")
def c07b(spark, d):
    return clean.locality_index(A.observations(spark, d))


def lump_map(spark, d):
    """Lump names that differ in the last word's group: widgets and gadgets go to one name per colour."""
    p = A.table(spark, d, "part").select("p_name").distinct()
    colour = F.split("p_name", " ")[0]
    noun = F.split("p_name", " ")[1]
    return p.filter(noun.isin("widget", "bolt")).select(
        F.col("p_name").alias("recorded"), F.concat(colour, F.lit(" gear")).alias("kept"), (noun == "bolt").alias("promote"))


@query("c08_lump_taxa", S.with_(S.obs()) + """
  SELECT CASE WHEN split_part(common_name, ' ', 2) IN ('widget', 'bolt') THEN split_part(common_name, ' ', 1) || ' gear'
      ELSE common_name END AS common_name,
    CASE WHEN split_part(common_name, ' ', 2) = 'bolt' THEN 'species' ELSE category END AS category, count(*) AS n
  FROM obs GROUP BY 1, 2""")
def c08(spark, d):
    df = clean.lump_taxa(A.observations(spark, d), lump_map(spark, d))
    return df.groupBy("common_name", "category").agg(F.count(F.lit(1)).alias("n"))


@query("c09_complete_years", S.upto("listed") + """
  SELECT year FROM listed GROUP BY year HAVING count(DISTINCT month) = 12""")
def c09(spark, d):
    return clean.complete_years(A.listed(spark, d))


@query("c10_historical_median_years", S.upto("listed") + """
  SELECT CASE WHEN year <= 1995 THEN 1 WHEN year <= 1997 THEN 2 WHEN year <= 1999 THEN 3 END AS hist_period,
    CAST(round_even(median(year), 0) AS INT) AS median_year
  FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY line_no, part_no, price) AS rn FROM listed)
  WHERE rn = 1 AND all_species_reported = 1 AND year <= 1999 GROUP BY 1""")
def c10(spark, d):
    return clean.historical_median_years(A.listed(spark, d), [1995, 1997, 1999], A.ORDER)


@query("c11_dedupe_observations", S.upto("deduped") + "SELECT group_id, common_name, line_no, part_no FROM deduped")
def c11(spark, d):
    return A.deduped(spark, d).select("group_id", "common_name", "line_no", "part_no")


@query("c12_effort_filter", S.with_(S.obs()) + f"SELECT {RAW_SQL} FROM obs WHERE distance_km IS NULL OR distance_km <= 50")
def c12(spark, d):
    return clean.effort_filter(A.observations(spark, d)).select(*RAW)


@query("c13_timegroups", S.upto("listed") + f"""
  SELECT year, {S.TIMEGROUP} AS timegroup, count(*) AS n FROM listed GROUP BY 1, 2""")
def c13(spark, d):
    return clean.with_timegroup(A.listed(spark, d), A.YEARS).groupBy("year", "timegroup").agg(F.count(F.lit(1)).alias("n"))


@query("c14_completeness", S.upto("ana") + "SELECT group_id, common_name, all_species_reported FROM ana")
def c14(spark, d):
    return A.analysis_table(spark, d).select("group_id", "common_name", "all_species_reported")


RESIDENT_SQL = "('Resident','Resident & Altitudinal Migrant','Resident & Local Migrant','Resident & Localized Summer Migrant','Altitudinal Migrant','Resident (Extirpated)')"
RARE = f"""rare AS (
  SELECT gridg4, month, common_name FROM gridded
  WHERE common_name IN (SELECT common_name FROM spmap WHERE migratory_status NOT IN {RESIDENT_SQL})
  GROUP BY 1, 2, 3 HAVING count(DISTINCT year) <= 3)"""


def vagrant_split(spark, d):
    return clean.split_vagrants(A.gridded(spark, d), A.species_map(spark, d), 3, A.YEARS.recent_start)


@query("c15_vagrants_kept", S.upto("gridded", "name", S.spmap(), RARE) + """
  SELECT group_id, common_name FROM gridded g WHERE NOT (year >= 1997 AND EXISTS (SELECT 1 FROM rare r
    WHERE r.gridg4 = g.gridg4 AND r.month = g.month AND r.common_name = g.common_name))""")
def c15(spark, d):
    return vagrant_split(spark, d)[0].select("group_id", "common_name")


@query("c15_vagrants", S.upto("gridded", "name", S.spmap(), RARE) + """
  SELECT group_id, common_name FROM gridded g WHERE year >= 1997 AND EXISTS (SELECT 1 FROM rare r
    WHERE r.gridg4 = g.gridg4 AND r.month = g.month AND r.common_name = g.common_name)""")
def c15b(spark, d):
    return vagrant_split(spark, d)[1].select("group_id", "common_name")


@query("c16_stage_stats", S.upto("gridded") + """
  SELECT 1::BIGINT AS stage_no, 'quality' AS stage, count(*) AS observations, count(DISTINCT group_id) AS checklists,
    count(DISTINCT CASE WHEN all_species_reported = 1 THEN group_id END) AS complete_checklists FROM listed
  UNION ALL SELECT 2, 'deduplicated', count(*), count(DISTINCT group_id),
    count(DISTINCT CASE WHEN all_species_reported = 1 THEN group_id END) FROM deduped
  UNION ALL SELECT 3, 'effort', count(*), count(DISTINCT group_id),
    count(DISTINCT CASE WHEN all_species_reported = 1 THEN group_id END) FROM gridded""")
def c16(spark, d):
    stages = [("quality", A.listed), ("deduplicated", A.deduped), ("effort", A.gridded)]
    return clean.stage_stats([(n, f(spark, d)) for n, f in stages])


@query("c17_encode", S.upto("gridded") + """
  SELECT sp.species_id, tg.timegroup_id,
    CAST(substr(group_id, 2) AS BIGINT) + CASE WHEN group_id LIKE 'G%' THEN 1000000000000000 ELSE 0 END AS group_no,
    CASE WHEN TRY_CAST(substr(group_id, 2) AS BIGINT) IS NULL THEN group_id END AS group_text,
    CAST(substr(observer_id, 5) AS BIGINT) AS observer_no,
    CASE WHEN obs_count = 'X' THEN 1 ELSE CAST(obs_count AS BIGINT) END AS obs_count
  FROM gridded
  JOIN (SELECT common_name, row_number() OVER (ORDER BY common_name) AS species_id FROM (SELECT DISTINCT common_name FROM gridded)) sp USING (common_name)
  JOIN (SELECT timegroup, row_number() OVER (ORDER BY timegroup) AS timegroup_id FROM (SELECT DISTINCT timegroup FROM gridded)) tg USING (timegroup)""")
def c17(spark, d):
    return clean.encode(A.gridded(spark, d))


@query("c18_season", S.upto("listed") + """
  SELECT month, CASE WHEN month IN (12,1,2) THEN 'Win' WHEN month <= 5 THEN 'Sum' WHEN month <= 8 THEN 'Mon' ELSE 'Aut' END AS season,
    count(*) AS n FROM listed GROUP BY 1, 2""")
def c18(spark, d):
    return clean.with_season(A.listed(spark, d)).groupBy("month", "season").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ files: what is written comes back
def folder(spark, name):
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_read_observations", S.with_(S.obs()) + """
  SELECT event_id, common_name, category, obs_count, locality_id, reviewed, approved, state, district, round(lat, 9) AS lat, obs_date, protocol,
    CAST(duration_min AS INT) AS duration_min, round(distance_km, 9) AS distance_km, all_species_reported, group_identifier, exotic_code FROM obs""")
def s01(spark, d):
    obs = A.observations(spark, d).withColumns({"locality_type": F.lit(" "), "number_observers": F.lit(None).cast("int")})
    path = folder(spark, "export")
    obs.select(*[F.coalesce(F.col(dst).cast("string"), F.lit("")).alias(src) for src, dst, _ in observations.EXPORT_COLUMNS],
               F.lit("unused").alias("LAST EDITED DATE")).write.option("sep", "\t").option("header", True).option("quote", "").option(
        "emptyValue", "").csv(path)
    back = observations.read_observations(spark, path)
    return back.select("event_id", "common_name", "category", "obs_count", "locality_id", "reviewed", "approved", "state", "district",
                       F.round("lat", 9).alias("lat"), "obs_date", "protocol", "duration_min", F.round("distance_km", 9).alias("distance_km"),
                       "all_species_reported", "group_identifier", "exotic_code")


@query("s04_read_partitioned", S.upto("deduped") + """
  SELECT year, state, common_name, count(*) AS n FROM deduped WHERE year IN (1998, 2000) GROUP BY 1, 2, 3""")
def s04(spark, d):
    path = folder(spark, "records")
    sinks.write_mask_table(A.deduped(spark, d).select("year", "state", "common_name", "group_id"), path, ["year"])
    return observations.read_partitioned(spark, path, year=[1998, 2000]).groupBy("year", "state", "common_name").agg(F.count(F.lit(1)).alias("n"))


@query("s05_rewrite_one_mask", S.with_(S.obs()) + """
  SELECT state AS mask, CASE WHEN state = 'NATION_3' THEN 'second' ELSE 'first' END AS run, count(*) AS n FROM obs GROUP BY 1""")
def s05(spark, d):
    path = folder(spark, "masks")
    n = A.observations(spark, d).groupBy(F.col("state").alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    sinks.write_mask_table(n.withColumn("run", F.lit("first")), path)
    sinks.write_mask_table(n.filter("mask = 'NATION_3'").withColumn("run", F.lit("second")), path, files_per_key=2)
    return observations.read_partitioned(spark, path).select("mask", "run", "n")


@query("s06_report_sheets", S.with_(S.obs()) + """
  SELECT 'by_category' AS sheet, category AS label, count(*) AS n FROM obs GROUP BY 2 UNION ALL SELECT 'by_protocol', protocol, count(*) FROM obs GROUP BY 2""")
def s06(spark, d):
    obs = A.observations(spark, d)
    path = folder(spark, "report")
    count = lambda c: obs.groupBy(F.col(c).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    sinks.write_report({"by_category": count("category"), "by_protocol": count("protocol")}, path)
    sheets = [observations.read_dim(spark, f"{path}/{s}", "label string, n bigint").withColumn("sheet", F.lit(s))
              for s in ("by_category", "by_protocol")]
    return observations.union_sources(*sheets).select("sheet", "label", "n")
