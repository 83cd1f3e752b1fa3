"""Which species have enough data, and how well their range is sampled (Q01-Q16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrends.config import YearInfo
from fieldtrends.functions.ranking import first_per

SP = "common_name"


def label_dim(like: DataFrame, years: YearInfo) -> DataFrame:
    """Time-group labels with their rank and median year."""
    rows = [(l, i, m) for i, (l, m) in enumerate(zip(years.labels, years.medians), 1)]
    return like.sparkSession.createDataFrame(rows, "timegroup string, tg_no int, tg_year int")


def complete_lists(obs: DataFrame) -> DataFrame:
    return obs.filter("all_species_reported = 1")


def qualifying_records(obs: DataFrame) -> DataFrame:
    return complete_lists(obs).filter(F.col("category").isin("species", "issf"))


def time_bins(obs: DataFrame, years: YearInfo, by: Sequence[str] = ()) -> DataFrame:
    """Q01. Checklists and half-even median year per time group; empty groups are listed with NULLs."""
    bins = complete_lists(obs).groupBy(*by, "timegroup").agg(
        F.count_distinct("group_id").alias("lists"),
        F.bround(F.median("year"), 0).cast("int").alias("year"),
    )
    labels = label_dim(obs, years).select("timegroup")
    if by:
        labels = obs.select(*by).distinct().withColumn(
            "timegroup", F.explode(F.array(*[F.lit(x) for x in years.labels])))
    return labels.join(bins, [*by, "timegroup"], "left")


def sampling_frame(obs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Q02. Distinct (locality, checklist, month, time group) of complete lists."""
    return complete_lists(obs).select("locality_id", "group_id", "month", "timegroup", *extra).distinct()


def qualify_all_groups(
    obs: DataFrame, by: str, n_groups: int, localities: int, cells: int, flag: str,
    cell: str = "gridg4", from_year: int | None = None,
) -> DataFrame:
    """Q03, Q04. Species above both limits in every group of ``by`` (relational division).

    Distinct (species, group, locality, cell) first: it shrinks map-side, and the two distinct counts
    then expand a much smaller table.
    """
    base = qualifying_records(obs)
    if from_year is not None:
        base = base.filter(F.col("year") >= from_year)
    base = base.select(SP, by, "locality_id", cell).distinct()
    return (
        base.groupBy(SP, by)
        .agg(F.count_distinct("locality_id").alias("locs"), F.count_distinct(cell).alias("cells"))
        .filter((F.col("locs") > localities) & (F.col("cells") > cells))
        .groupBy(SP).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n_groups)
        .select(SP, F.lit(1).alias(flag))
    )


def restricted_candidates(
    obs: DataFrame, n_groups: int, cells: int, cell: str = "gridg4", from_year: int | None = None,
) -> DataFrame:
    """Q05, Q06. Species in at most ``cells`` cells in every time group."""
    base = qualifying_records(obs)
    if from_year is not None:
        base = base.filter(F.col("year") >= from_year)
    return (
        base.select(SP, "timegroup", cell).distinct()
        .groupBy(SP, "timegroup").agg(F.count(cell).alias("cells"))
        .filter(F.col("cells") <= cells)
        .groupBy(SP).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n_groups).select(SP)
    )


def restricted_valid(
    candidates: DataFrame, obs: DataFrame, lists: int, n_groups: int, flag: str,
    cell: str = "gridg1", from_year: int | None = None,
) -> DataFrame:
    """Q07. Candidates whose cells received more than ``lists`` checklists in every time group.

    A checklist lies in one cell (cells are tagged per checklist), so checklists are counted per
    (cell, time group) once and summed over the species' cells; no species x checklist pairs.
    """
    own = obs.join(candidates.select(SP), SP, "left_semi").select(SP, cell).distinct()
    pool = obs if from_year is None else obs.filter(F.col("year") >= from_year)
    effort = pool.groupBy(cell, "timegroup").agg(F.count_distinct("group_id").alias("n"))
    return (
        own.join(effort, cell).groupBy(SP, "timegroup").agg(F.sum("n").alias("n"))
        .filter(F.col("n") > lists)
        .groupBy(SP).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == n_groups)
        .select(SP, F.lit(1).alias(flag))
    )


def diurnal(exceptions: Sequence[str] = ()) -> Column:
    return (
        (F.col("breeding_period") != "Nocturnal") | (F.col("nonbreeding_period") != "Nocturnal")
        | F.col(SP).isin(list(exceptions))
    )


def with_flags(species_map: DataFrame, *flags: DataFrame) -> DataFrame:
    out = species_map
    for f in flags:
        out = out.join(f, SP, "left")
    return out


def species_list(
    flagged: DataFrame, obs: DataFrame, national: DataFrame | None = None, exceptions: Sequence[str] = (),
) -> DataFrame:
    """Q08. Species to analyse: essential, endemic or qualified; diurnal; not discarded; recorded here.

    With a national list (states), membership in it replaces the trait test.
    """
    enough = (F.col("ht") == 1) | (F.col("rt") == 1)
    if national is None:
        chosen = flagged.filter((F.col("essential") == 1) | (F.col("endemic_region") != "Non-endemic") | enough)
    else:
        nat = national.select(SP, F.lit(1).alias("__nat")).distinct()
        chosen = flagged.join(nat, SP, "left").filter((F.col("__nat") == 1) | enough)
    return (
        chosen.filter(diurnal(exceptions)).filter("discard IS NULL")
        .join(obs.select(SP).distinct(), SP, "left_semi").select(SP, "ht", "rt")
    )


def null_out(listed: DataFrame, species: DataFrame, keep: bool = False, cols: Sequence[str] = ("ht", "rt")) -> DataFrame:
    """Q09. Clear the flags of the given species, or (``keep``) of all others."""
    marked = listed.join(species.select(SP, F.lit(1).alias("__hit")).distinct(), SP, "left")
    stay = F.col("__hit").isNotNull() if keep else F.col("__hit").isNull()
    return marked.withColumns({c: F.when(stay, F.col(c)) for c in cols}).drop("__hit")


def null_out_nocturnal(flagged: DataFrame) -> DataFrame:
    """Q09. Clear the flags of species nocturnal in both seasons."""
    night = (F.col("breeding_period") == "Nocturnal") & (F.col("nonbreeding_period") == "Nocturnal")
    return flagged.withColumns({c: F.when(~F.coalesce(night, F.lit(False)), F.col(c)) for c in ("ht", "rt")})


def qualification_counts(flagged: DataFrame) -> DataFrame:
    """Q10. Species qualifying by data, plus endemism, plus essential status (cumulative)."""
    data = (F.col("ht") == 1) | (F.col("rt") == 1)
    endemic = (F.col("endemic_region") != "Non-endemic") | data
    essential = (F.col("essential") == 1) | endemic

    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond & diurnal()).alias(name)

    return flagged.agg(n(data, "by_data"), n(endemic, "plus_endemic"), n(essential, "plus_essential"))


def restricted_list(
    base: DataFrame, valid_h: DataFrame, valid_r: DataFrame, obs: DataFrame, misidentified: DataFrame,
    min_cells: int = 7, cell: str = "gridg1",
) -> DataFrame:
    """Q11. Restricted-range list; ``mixed`` = 1 when enough cells for a random effect.

    ``valid_h`` / ``valid_r`` carry the flags ht / rt. Species without complete lists drop out.
    """
    out = base.select(SP).distinct().join(valid_h, SP, "left").join(valid_r, SP, "left")
    out = null_out(out.filter("ht IS NOT NULL OR rt IS NOT NULL"), misidentified)
    cells = (
        complete_lists(obs).join(out.select(SP), SP, "left_semi").select(SP, cell).distinct()
        .groupBy(SP).agg(F.count(cell).alias("n"))
    )
    return out.join(cells, SP).select(SP, "ht", "rt", (F.col("n") > min_cells).cast("int").alias("mixed"))


def species_sheet(flagged: DataFrame, selected: DataFrame, restricted: DataFrame) -> DataFrame:
    """Q12. Full species sheet with X or blank marks; restricted species get their marks too."""
    r = restricted.select(SP, F.col("ht").alias("__rh"), F.col("rt").alias("__rr"))
    s = selected.select(SP, F.lit(1).alias("__sel")).distinct()
    j = flagged.select(SP, "scientific_name", "ht", "rt").join(s, SP, "left").join(r, SP, "left")

    def mark(cond: Column) -> Column:
        return F.when(cond, F.lit("X")).otherwise(F.lit(""))

    return j.select(
        SP, "scientific_name",
        mark((F.col("ht") == 1) | F.col("__rh").isNotNull()).alias("long_term_analysis"),
        mark((F.col("rt") == 1) | F.col("__rr").isNotNull()).alias("current_analysis"),
        mark(F.col("__sel") == 1).alias("selected"),
    )


def keep_habitat_marks(sheet: DataFrame, habitat_species: DataFrame) -> DataFrame:
    """Q09 on the sheet: blank the marks of species outside a habitat."""
    h = habitat_species.select(SP, F.lit(1).alias("__h")).distinct()
    cols = ("long_term_analysis", "current_analysis", "selected")
    out = sheet.join(h, SP, "left")
    return out.withColumns({c: F.when(F.col("__h") == 1, F.col(c)).otherwise(F.lit("")) for c in cols}).drop("__h")


def range_coverage(obs: DataFrame, years: YearInfo, cell: str = "gridg1") -> DataFrame:
    """Q13. Total cells, and their shares sampled in the first group, recent years (mean) and latest year."""
    base = complete_lists(obs).select(SP, "timegroup", cell).distinct()
    per = base.groupBy(SP, "timegroup").agg(F.count(cell).alias("n"))
    recent = [str(y) for y in years.recent_years]
    shares = per.groupBy(SP).agg(
        F.max(F.when(F.col("timegroup") == years.labels[0], F.col("n"))).alias("first"),
        F.avg(F.when(F.col("timegroup").isin(recent), F.col("n"))).alias("recent"),
        F.max(F.when(F.col("timegroup") == str(years.latest_year), F.col("n"))).alias("latest"),
    )
    total = base.select(SP, cell).distinct().groupBy(SP).agg(F.count(cell).alias("total_range"))
    t = F.col("total_range")
    return total.join(shares, SP).select(
        SP, "total_range", (F.col("first") / t).alias("share_first"),
        (F.col("recent") / t).alias("share_recent"), (F.col("latest") / t).alias("share_latest"),
    )


def cell_sampling(obs: DataFrame, cell: str = "gridg1", sub: str = "gridg0") -> DataFrame:
    """Q14. Mean and 95 % half-width of the sampled sub-cells over the cells of each species."""
    full = complete_lists(obs)
    sampled = full.select(cell, sub).distinct().groupBy(cell).agg(F.count(sub).alias("n"))
    return (
        full.select(SP, cell).distinct().join(sampled, cell).groupBy(SP)
        .agg(F.avg("n").alias("mean5km"), (1.96 * F.stddev_samp("n") / F.sqrt(F.count("n"))).alias("ci5km"))
    )


def is_current(listed: DataFrame, taxonomy: DataFrame, new: str) -> bool:
    """Q15. True when every listed name already exists in the newest taxonomy."""
    names = taxonomy.select(F.col(new).alias(SP)).distinct()
    return listed.select(SP).distinct().join(names, SP, "left_anti").isEmpty()


def update_taxonomy(
    listed: DataFrame, taxonomy: DataFrame, old: str, new: str, recode: DataFrame | None = None,
    order: Sequence[str] = (SP,),
) -> DataFrame:
    """Q15. Roll a species list forward to newer names; unchanged when already current.

    ``recode`` (recorded, kept) fixes names that predate the old taxonomy. Two old names that merge
    keep the first row by ``order``.
    """
    if is_current(listed, taxonomy, new):
        return first_per(listed, [SP], order)
    df = listed
    if recode is not None:
        r = recode.select(F.col("recorded").alias(SP), F.col("kept").alias("__kept"))
        df = df.join(r, SP, "left").withColumn(SP, F.coalesce("__kept", SP)).drop("__kept")
    t = taxonomy.select(F.col(old).alias(SP), F.col(new).alias("__new"))
    moved = df.join(t, SP, "left")
    picked = first_per(moved, ["__new"], list(order))
    return picked.withColumn(SP, F.col("__new")).drop("__new")


def has_runnable(listed: DataFrame, by: str = "mask") -> DataFrame:
    """Q16. Per mask: is any species marked for a trend."""
    return listed.groupBy(by).agg(F.coalesce(
        F.bool_or((F.col("ht") == 1) | (F.col("rt") == 1)), F.lit(False)).alias("runnable"))
