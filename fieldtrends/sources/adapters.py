"""The driver's star schema seen as field checklists: one order is a checklist, one line a record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrends.config import (
    IUCN_ORDER, PAST_TREND_STATUSES, PRIORITY_STATUSES, RANGE_STATUSES, TREND_STATUSES, YearInfo,
)
from fieldtrends.operators import clean, spatial
from fieldtrends.session import staged

GRID_SIZES = {"gridg0": 0.25, "gridg1": 1.0, "gridg2": 2.0, "gridg3": 4.0, "gridg4": 8.0}
YEARS = YearInfo(
    latest_year=2000,
    bins=(("before 1996", 1995, 1995), ("1996-1997", 1997, 1997)),
    full_years=(1995, 1996, 1997, 1998, 1999, 2000),
    recent_from=1997,
)
ORDER = ["line_no", "part_no", "price"]
SPECIES = {
    "name": "p_name",
    "fine": "concat(p_name, ' ', p_brand)",
    "part": "concat('SP', p_partkey)",
}

# Fixed fixture polygons (layer, id, ring).
POLYGONS = [
    ("pa", "PA north", [(70.005, 25.005), (76.505, 25.005), (76.505, 33.505), (70.005, 33.505)]),
    ("pa", "PA tri", [(80.005, 10.005), (92.005, 12.505), (84.505, 22.005)]),
    ("pa", "PA east", [(88.005, 20.005), (95.505, 21.005), (96.005, 30.005), (90.005, 34.005), (86.505, 27.005)]),
    ("land", "land", [(68.505, 8.505), (96.505, 8.505), (96.505, 36.505), (82.005, 36.805), (68.505, 36.505)]),
]
MIGRATORY = [
    "Resident", "Resident & Altitudinal Migrant", "Winter Migrant", "Summer Migrant",
    "Passage Migrant & Localized Winter Migrant", "Local Migrant", "Summer Migrant & Passage Migrant",
]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def polygons(spark: SparkSession) -> DataFrame:
    return spatial.polygon_layer(spark, POLYGONS)


def observations(spark: SparkSession, d: str, species: str = "name") -> DataFrame:
    """Raw records. The nation dimension has 25 rows at every scale; Catalyst broadcasts it."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    key, loc = F.col("o_orderkey"), F.col("o_custkey") % 211
    pr = F.col("o_orderpriority")
    disc = F.round(F.col("l_discount") * 100).cast("int")
    start = 240 + (key * 53) % 1200
    joined = (
        l.join(p, F.col("l_partkey") == F.col("p_partkey"))
        .join(o, F.col("l_orderkey") == key)
        .join(n, F.col("n_nationkey") == loc % 25)
    )
    return joined.select(
        F.concat(F.lit("S"), key).alias("event_id"),
        F.when(key % 10 == 0, F.concat(F.lit("G"), key)).alias("group_identifier"),
        F.expr(SPECIES[species]).alias("common_name"),
        F.concat(F.lit("Genus "), F.expr(SPECIES[species])).alias("scientific_name"),
        F.when(F.col("p_type") == "SMALL", "issf").when(F.col("p_type") == "PROMO", "slash")
        .otherwise("species").alias("category"),
        F.when(F.col("l_linenumber") == 7, "X")
        .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("obs_count"),
        F.concat(F.lit("L"), loc).alias("locality_id"),
        F.col("n_name").alias("state"),
        F.concat("n_name", F.lit("-"), loc % 3).alias("district"),
        (F.lit(68) + (loc * 7919 % 2900) / F.lit(100.0)).alias("lon"),
        (F.lit(8) + (loc * 104729 % 2900) / F.lit(100.0)).alias("lat"),
        F.concat(F.lit("obsr"), "o_custkey").alias("observer_id"),
        F.col("o_orderdate").cast("date").alias("obs_date"),
        F.format_string("%02d:%02d:00", F.floor(start / 60), start % 60).alias("start_time"),
        F.when(pr == "5-LOW", "Incidental").when(pr == "4-NOT SPECIFIED", "Historical")
        .when(pr == "3-MEDIUM", "Stationary").otherwise("Traveling").alias("protocol"),
        F.when(key % 17 != 0, (key * 37) % 90).cast("int").alias("duration_min"),
        F.when(pr == "3-MEDIUM", None).when(key % 41 == 0, F.col("o_totalprice") / 4000.0)
        .otherwise(F.col("o_totalprice") / 40000.0).alias("distance_km"),
        (F.col("o_orderstatus") != "P").cast("int").alias("all_species_reported"),
        (F.col("l_returnflag") == "R").cast("int").alias("reviewed"),
        (F.col("l_linestatus") == "F").cast("int").alias("approved"),
        F.when(disc == 10, "X").when(disc == 9, "P").when(disc == 8, "N").alias("exotic_code"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_no"),
        F.col("l_extendedprice").alias("price"),
    )


def listed(spark: SparkSession, d: str, species: str = "name") -> DataFrame:
    """Quality-filtered records with checklist key, dates and list length (before any removal)."""
    obs = clean.quality_filter(observations(spark, d, species))
    return clean.with_list_length(clean.with_date_parts(clean.with_group_id(obs)))


def deduped(spark: SparkSession, d: str, species: str = "name") -> DataFrame:
    return clean.dedupe_observations(listed(spark, d, species), YEARS.latest_year, ORDER)


def gridded(spark: SparkSession, d: str, species: str = "name") -> DataFrame:
    """Deduplicated records with grids and time groups, within the effort limit."""
    df = clean.effort_filter(spatial.with_grids(deduped(spark, d, species), GRID_SIZES))
    return clean.with_timegroup(df, YEARS)


# what the models read of the analysis table
MODEL = (
    "group_id", "common_name", "locality_id", "obs_count", "all_species_reported", "no_sp", "month", "year", "timegroup",
    "gridg1", "gridg3",
)


def analysis_table(
    spark: SparkSession, d: str, species: str = "name", reuse: bool = False, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Table the selection, trend and occupancy steps start from; ``reuse`` when a job reads it often.

    ``columns`` are those the job reads: a staged table is written whole, so others would be shuffled and written for nothing.
    """
    out = clean.check_completeness(gridded(spark, d, species), ORDER)
    if columns is not None:
        out = out.select(*columns)
    return staged(out) if reuse else out


def habitat_flags(obs: DataFrame, cell: str = "gridg1") -> DataFrame:
    """Habitat masks by cell parity."""
    gx, gy = F.floor(F.col(cell) / spatial.CELL_STRIDE), F.col(cell) % spatial.CELL_STRIDE
    return obs.select(cell).distinct().select(
        cell, (gx % 2 == 0).cast("int").alias("mask_wdl"), (gy % 2 == 0).cast("int").alias("mask_crp"),
        ((gx + gy) % 3 == 0).cast("int").alias("mask_one"),
    )


def masked(spark: SparkSession, d: str, species: str = "name") -> DataFrame:
    """Analysis table with protected area, land buffer and habitat flags."""
    ana = analysis_table(spark, d, species, reuse=True)
    pts = spatial.checklist_points(ana, ORDER)
    tags = spatial.tag_points(pts, polygons(spark), {"pa_name": "pa", "land": "land"}, {})
    tags = spatial.first_match(tags, [F.col("pa_name").asc_nulls_last(), F.col("land").asc_nulls_last()])
    return spatial.land_only_with_habitat(ana, tags, habitat_flags(ana))


def species_map(spark: SparkSession, d: str, species: str = "name") -> DataFrame:
    """Traits per species, derived from its smallest part key."""
    k = F.col("k")
    base = table(spark, d, "part").groupBy(F.expr(SPECIES[species]).alias("common_name")).agg(F.min("p_partkey").alias("k"))
    period = F.when(k % 9 == 0, "Nocturnal").otherwise("Diurnal")
    return base.select(
        "common_name", "k",
        F.concat(F.lit("Genus "), "common_name").alias("scientific_name"),
        F.element_at(F.array(*[F.lit(m) for m in MIGRATORY]), (k % 7 + 1).cast("int")).alias("migratory_status"),
        period.alias("breeding_period"), period.alias("nonbreeding_period"),
        F.when(k % 5 == 0, "Mountain").otherwise("Non-endemic").alias("endemic_region"),
        F.when(k % 4 == 0, 1).alias("essential"),
        F.when(k % 23 == 0, 1).alias("discard"),
        (k % 17 == 0).alias("misid"), (k % 2 == 0).alias("woodland"), (k % 3 == 0).alias("openland"),
    )


# ---------------------------------------------------------------- species sheet: one part, one species
HABITATS = ["Forest", "Grassland", "Wetland", "Non-specialized", "Forest & Plantation", "Open Habitat"]
RANGE_MEANS = [0, 300, 5000, 30000, 120000, 400000, 1500000]
PAST_RANGES = ["Very Restricted", "Restricted", "Data Deficient", "Moderate", "Large", "Very Large"]


def pick(values, index):
    """Element of a fixed list by a zero-based index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def main_table(spark: SparkSession, d: str) -> DataFrame:
    """Species with estimates and past statuses, before classification."""
    k, s = F.col("p_partkey"), F.col("p_size")
    est = k % 11 != 0
    lt, lh = (20 + k * 37 % 200).cast("double"), (k * 13 % 40).cast("double")
    ct, ch = (k * 29 % 120) / F.lit(10.0) - 6, (k * 7 % 50) / F.lit(10.0)
    rg = pick(RANGE_MEANS, k % 7).cast("double")
    mark = F.when(est, "X").otherwise("")
    return table(spark, d, "part").select(
        F.concat(F.lit("SP"), k).alias("species"), k.alias("k"),
        F.concat(F.lit("Genus "), k).alias("scientific_name"), F.concat(F.lit("Name "), k).alias("checklist_name"),
        F.col("p_brand").alias("order_name"), F.col("p_type").alias("grp"),
        F.when(k % 13 == 0, "").otherwise("X").alias("selected"),
        mark.alias("long_term_analysis"), mark.alias("current_analysis"),
        F.when(est, lt - lh).alias("longtermlci"), F.when(est, lt).alias("longtermmean"), F.when(est, lt + lh).alias("longtermrci"),
        F.when(est, ct - ch).alias("currentslopelci"), F.when(est, ct).alias("currentslopemean"),
        F.when(est, ct + ch).alias("currentsloperci"),
        (rg * 0.9).alias("rangelci"), rg.alias("rangemean"), (rg * 1.1).alias("rangerci"),
        F.when(k % 12 == 0, 1).alias("restricted_islands"),
        F.when(k % 97 == 0, "Extinct").otherwise(pick(IUCN_ORDER, k % 6)).alias("iucn"),
        F.when(k % 5 == 0, "Mountain").otherwise("Non-endemic").alias("endemic_region"),
        pick(HABITATS, k % 6).alias("habitat"), pick(MIGRATORY, k % 7).alias("migratory_status"),
        F.when(k % 9 == 0, k % 40 + 10).alias("one_percent"),
        F.when(s % 10 != 0, pick(PAST_TREND_STATUSES, s % 7)).alias("past_long_term_status"),
        F.when(s % 10 != 0, pick(PAST_TREND_STATUSES, (s * 3 + 1) % 7)).alias("past_current_status"),
        pick(PAST_RANGES, s % 6).alias("past_range_status"),
        F.when(s % 4 < 3, pick(PRIORITY_STATUSES, s % 4 % 3)).alias("past_priority_status"),
        pick(TREND_STATUSES, (k * 5 + s) % 7).alias("major_long_term_status"),
        pick(TREND_STATUSES, (k * 3 + s) % 7).alias("major_current_status"),
        pick(RANGE_STATUSES, (k + s) % 6).alias("major_range_status"),
        F.when(k % 10 != 0, pick(PRIORITY_STATUSES, (k + s) % 3)).alias("major_priority_status"),
        (k * 7 % 100 / F.lit(100.0)).alias("share_recent"), (k * 11 % 250 / F.lit(10.0)).alias("mean5km"),
        (k % 30 / F.lit(10.0)).alias("ci5km"), (5 + k % 12).alias("gen"),
    )


def vagrant_species(main: DataFrame) -> DataFrame:
    return main.filter(F.col("k") % 14 == 0).select("species")


def classified(spark: SparkSession, d: str) -> DataFrame:
    """Species sheet with all four statuses."""
    from fieldtrends.operators import classify as c

    main = main_table(spark, d)
    out = c.range_status(c.current_status(c.long_term_status(main)), vagrant_species(main))
    return c.priority_status(c.null_unselected(out), c.score_rules(spark))
