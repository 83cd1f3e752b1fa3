"""Cleaning of raw observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldtrends.config import CODE_MONTHS, CUMULATIVE_DAYS, RESIDENT_STATUSES, SEASONS, Completeness, YearInfo
from fieldtrends.functions.nulls import not_in, null_safe_join
from fieldtrends.functions.ranking import first_per


def quality_filter(obs: DataFrame, exotic: Sequence[str] = ("X",)) -> DataFrame:
    """C01. Keep unreviewed or approved records; drop the given exotic codes (missing codes stay)."""
    keep = (F.col("reviewed") == 0) | (F.col("approved") == 1)
    return obs.filter(keep).filter(not_in(F.col("exotic_code"), exotic))


def with_group_id(obs: DataFrame) -> DataFrame:
    """C02. Shared checklists collapse to their group identifier."""
    return obs.withColumn("group_id", F.coalesce("group_identifier", "event_id"))


def with_date_parts(obs: DataFrame, date: str = "obs_date") -> DataFrame:
    """C03. Month, day of a 365-day year, calendar year and June-May migratory year."""
    d = F.col(date)
    month = F.month(d)
    offset = F.element_at(F.array(*[F.lit(x) for x in CUMULATIVE_DAYS]), month)
    return obs.withColumns({
        "month": month,
        "day": F.dayofmonth(d) + offset,
        "cyear": F.year(d),
        "year": F.when(month > 5, F.year(d)).otherwise(F.year(d) - 1),
    })


def with_list_length(obs: DataFrame, group: str = "group_id", species: str = "common_name") -> DataFrame:
    """C04. Distinct species per checklist, on every row.

    The rows are shuffled once, by checklist; the steps that follow per checklist (C11, C14) find them in place. The
    first row of each species is counted over the checklist, so nothing is collected and the sort spills if it must.
    """
    rows = obs.repartition(group)
    first = F.row_number().over(W.partitionBy(group, species).orderBy(species)) == 1
    rows = rows.withColumn("__first", (first & F.col(species).isNotNull()).cast("bigint"))
    return rows.withColumn("no_sp", F.sum("__first").over(W.partitionBy(group))).drop("__first")


def species_index(obs: DataFrame) -> DataFrame:
    """C07. Names of recorded full species and subspecies."""
    return obs.filter(F.col("category").isin("species", "issf")).select("common_name", "scientific_name").distinct()


def locality_index(obs: DataFrame) -> DataFrame:
    """C07. Localities with coordinates."""
    return obs.select("locality_id", "lat", "lon").distinct()


def lump_taxa(obs: DataFrame, lumps: DataFrame) -> DataFrame:
    """C08. Recode names by a map (recorded, kept, promote) and promote lumped entries to species.

    The map is a hand-made dimension; Catalyst broadcasts it while it is below the session's limit.
    """
    m = lumps.select(
        F.col("recorded").alias("__rec"), F.col("kept").alias("__kept"), F.col("promote").alias("__promote")
    )
    joined = obs.join(m, F.col("common_name") == F.col("__rec"), "left")
    return joined.withColumns({
        "category": F.when(F.col("__promote"), F.lit("species")).otherwise(F.col("category")),
        "common_name": F.coalesce("__kept", "common_name"),
    }).drop("__rec", "__kept", "__promote")


def complete_years(obs: DataFrame) -> DataFrame:
    """C09. Migratory years with records in all 12 months."""
    return (
        obs.groupBy("year").agg(F.count_distinct("month").alias("n_month"))
        .filter("n_month = 12").select("year")
    )


def latest_complete_year(obs: DataFrame) -> DataFrame:
    return complete_years(obs).agg(F.max("year").alias("latest_year"))


def historical_median_years(obs: DataFrame, bounds: Sequence[int], order: Sequence) -> DataFrame:
    """C10. Half-even rounded median year of each historical period over complete checklists.

    ``bounds`` are the last years of the periods. The exact median keeps one counter per distinct
    year, so its state does not grow with the data.
    """
    lists = first_per(obs, ["group_id"], order).filter("all_species_reported = 1")
    period: Column = F.lit(None).cast("int")
    for i in range(len(bounds) - 1, -1, -1):
        period = F.when(F.col("year") <= bounds[i], F.lit(i + 1)).otherwise(period)
    return (
        lists.withColumn("hist_period", period).filter("hist_period IS NOT NULL")
        .groupBy("hist_period").agg(F.bround(F.median("year"), 0).cast("int").alias("median_year"))
    )


def dedupe_observations(obs: DataFrame, latest_year: int, order: Sequence) -> DataFrame:
    """C11. One row per (checklist, species), up to the latest complete year."""
    # the year filter comes after the pick: rows of one checklist may disagree on the date
    return first_per(obs, ["group_id", "common_name"], order).filter(F.col("year") <= latest_year)


def effort_filter(obs: DataFrame, max_km: float = 50.0) -> DataFrame:
    """C12. Drop travelling lists above a distance; an unknown distance stays."""
    return obs.filter(F.col("distance_km").isNull() | (F.col("distance_km") <= max_km))


def with_timegroup(obs: DataFrame, years: YearInfo) -> DataFrame:
    """C13. Historical bins, then single years."""
    label = F.col("year").cast("string")
    for name, last, _ in reversed(years.bins):
        label = F.when(F.col("year") <= last, F.lit(name)).otherwise(label)
    return obs.withColumn("timegroup", label)


def check_completeness(obs: DataFrame, order: Sequence[str], limits: Completeness = Completeness()) -> DataFrame:
    """C14. Demote self-declared complete lists that cannot be complete.

    The checklist-level test (no duration and very few species) looks at the first row of each checklist, in a
    window: rows that are already together per checklist (C04) are read once and not shuffled again. The rest is one CASE
    expression.
    """
    short = (
        (F.col("all_species_reported") == 1) & (F.col("protocol") != "Incidental")
        & (F.col("no_sp") <= limits.small_list) & F.col("duration_min").isNull()
    )
    flagged = obs.withColumn("__short", F.first(short).over(W.partitionBy("group_id").orderBy(*order)))
    parts = F.split(F.col("start_time"), ":")
    hr = F.try_element_at(parts, F.lit(1)).try_cast("int")
    minute = F.try_element_at(parts, F.lit(2)).try_cast("int")
    dur = F.col("duration_min")
    end = F.floor((hr * 60 + minute + dur) / 60)
    speed = F.try_divide(F.col("distance_km") * 60, dur)
    rate = F.try_divide(F.col("no_sp") * 60, dur)
    # with a zero duration both ratios are undefined here; "too short" already catches those lists
    faulty = (
        (F.col("distance_km") > limits.max_km)
        | F.coalesce(F.col("__short"), F.lit(False))
        | (speed > limits.max_speed_kmh)
        | (dur < limits.min_minutes)
        | ((rate < limits.min_species_per_hour) & (F.col("no_sp") <= limits.small_list))
        | (F.col("protocol") == "Incidental")
        | (hr.isNotNull() & (
            ((hr <= limits.night_ends) & (end <= limits.night_ends))
            | ((hr >= limits.night_starts) & (end <= 24 + limits.night_ends))
        ))
    )
    asr = F.col("all_species_reported")
    new = F.when((asr == 1) & faulty, 0).when(asr == 0, 0).otherwise(1)
    return flagged.withColumn("all_species_reported", new).drop("__short")


def split_vagrants(
    obs: DataFrame, species_map: DataFrame, max_years: int, start_year: int,
    cell: str = "gridg4", resident: Sequence[str] = tuple(RESIDENT_STATUSES),
) -> tuple[DataFrame, DataFrame]:
    """C15. Split off migrants seen in few years in a cell and month, from a start year on.

    Returns (kept, vagrants). The reference anti-joins whole rows; rows of a flagged key from the
    start year on are exactly those rows, so one flag column splits the table without a row-wide join.
    """
    migrants = species_map.filter(not_in(F.col("migratory_status"), list(resident))).select("common_name")
    keys = [cell, "month", "common_name"]
    rare = (
        obs.join(migrants, "common_name", "left_semi")
        .groupBy(*keys).agg(F.count_distinct("year").alias("nyear"))
        .filter(F.col("nyear") <= max_years).select(*keys, F.lit(True).alias("__rare"))
    )
    marked = null_safe_join(obs, rare, keys, "left")
    vagrant = F.coalesce(F.col("__rare"), F.lit(False)) & (F.col("year") >= start_year)
    return marked.filter(~vagrant).drop("__rare"), marked.filter(vagrant).drop("__rare")


def stage_stats(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """C16. Observations, checklists and complete checklists per filter stage."""
    out = None
    for i, (name, df) in enumerate(stages, 1):
        full = F.col("all_species_reported") == 1
        row = df.agg(
            F.count(F.lit(1)).alias("observations"),
            F.count_distinct("group_id").alias("checklists"),
            F.count_distinct(F.when(full, F.col("group_id"))).alias("complete_checklists"),
        ).select(F.lit(i).cast("bigint").alias("stage_no"), F.lit(name).alias("stage"), "*")
        out = row if out is None else out.unionByName(row)
    return out


SHARED_OFFSET = 10**15


def numeric_group_id(col: Column, offset: int = SHARED_OFFSET) -> Column:
    """Checklist id as BIGINT: digits after a one-letter prefix, shared lists (G) shifted by an offset that no
    numbering reaches. An id of another form gets a hash above both ranges, so it is never lost."""
    digits = F.substring(col, 2, 30).try_cast("bigint")
    plain = digits + F.when(F.substring(col, 1, 1) == "G", F.lit(offset)).otherwise(F.lit(0)).cast("bigint")
    return F.coalesce(plain, F.lit(2 * offset) + F.pmod(F.xxhash64(col), F.lit(offset // 10)))


def dictionary(df: DataFrame, col: str, out: str) -> DataFrame:
    """Dense ids of a low-cardinality column (species, time groups), by name order.

    The distinct values are the dimension, not the data; the unpartitioned rank runs over them only.
    """
    return df.select(col).distinct().withColumn(out, F.dense_rank().over(W.orderBy(col)).cast("bigint"))


def encode(obs: DataFrame) -> DataFrame:
    """C17. Compact integer encoding of species, time group, checklist and observer.

    A checklist is told by (group_no, group_text): an id that is no number keeps its text, NULL for all others, so two
    such ids that share a hash are never one checklist.
    """
    sp = dictionary(obs, "common_name", "species_id")
    tg = dictionary(obs, "timegroup", "timegroup_id")
    return (
        obs.join(sp, "common_name").join(tg, "timegroup")
        .select(
            "species_id", "timegroup_id",
            numeric_group_id(F.col("group_id")).alias("group_no"),
            F.when(F.substring("group_id", 2, 30).try_cast("bigint").isNull(), F.col("group_id")).alias("group_text"),
            F.substring("observer_id", 5, 30).try_cast("bigint").alias("observer_no"),
            F.when(F.col("obs_count") == "X", F.lit(1))
            .otherwise(F.col("obs_count").try_cast("int")).cast("bigint").alias("obs_count"),
        )
    )


def with_season(df: DataFrame, month: str = "month", name: str = "season") -> DataFrame:
    """C18. Month to season."""
    out = F.lit(None).cast("string")
    for season, months in SEASONS.items():
        out = F.when(F.col(month).isin(months), F.lit(season)).otherwise(out)
    return df.withColumn(name, out)


def code_month_filter(code: Column, month: Column) -> Column:
    """Months allowed for a migratory season code; every month for resident and plain migrant codes."""
    cond = code.isin("R", "M")
    for c, months in CODE_MONTHS.items():
        cond = cond | ((code == c) & month.isin(months))
    return cond
