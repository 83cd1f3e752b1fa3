"""Input of the trend model without species x checklist rows, and its predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrends.config import SEASON_NAMES, YearInfo
from fieldtrends.functions.nulls import null_safe_join
from fieldtrends.functions.positions import by_replicate, summed, united
from fieldtrends.operators.clean import with_season
from fieldtrends.session import staged

SP = "common_name"
ERA_ALL, ERA_RECENT, ERA_LATEST = 0, 1, 2
CELLS = ["gridg3", "gridg1"]


def era(year: Column, years: YearInfo) -> Column:
    """0 before the recent window, 1 inside it, 2 in the latest year: windows become ``era >= k``."""
    return (
        F.when(year == years.latest_year, ERA_LATEST).when(year >= years.recent_start, ERA_RECENT)
        .otherwise(ERA_ALL)
    )


def model_window(listed: DataFrame, latest_only: bool = False) -> DataFrame:
    """T01. First era used per listed species: everything, the recent window or the latest year."""
    if latest_only:
        return listed.select(SP, F.lit(ERA_LATEST).alias("min_era"))
    recent = F.col("ht").isNull() & F.col("rt").isNotNull()
    return listed.select(SP, F.when(recent, ERA_RECENT).otherwise(ERA_ALL).alias("min_era"))


def window_rows(obs: DataFrame, windows: DataFrame, years: YearInfo) -> DataFrame:
    """T01. Records of listed species inside their window."""
    rows = obs.withColumn("era", era(F.col("year"), years)).join(windows, SP)
    return rows.filter(F.col("era") >= F.col("min_era"))


def species_range(obs: DataFrame, windows: DataFrame, years: YearInfo, by: Sequence[str] = ()) -> DataFrame:
    """T02. (species, 100 km cell, month) in which the species was ever reported in its window."""
    return window_rows(obs, windows, years).select(*by, SP, "gridg3", "month", "min_era").distinct()


def checklists(obs: DataFrame, years: YearInfo, by: Sequence[str] = ()) -> DataFrame:
    """Distinct checklists with the attributes the model uses."""
    return obs.select(
        *by, "group_id", *CELLS, "month", "timegroup", "no_sp", "all_species_reported",
        era(F.col("year"), years).alias("era"),
    ).distinct()


def restrict_range(obs: DataFrame, windows: DataFrame, years: YearInfo, by: Sequence[str] = ()) -> DataFrame:
    """T02. Species x checklists in range, one row each. Row-level form, for small selections;
    ``compress`` gives the model input without these rows."""
    own = species_range(obs, windows, years, by)
    lists = checklists(obs, years, by)
    return lists.join(own, [*by, "gridg3", "month"]).filter(F.col("era") >= F.col("min_era")).drop("min_era")


def fit_stats(obs: DataFrame, windows: DataFrame, years: YearInfo, by: Sequence[str] = ()) -> DataFrame:
    """T11. Records used per species: all records in its cells and months inside its window.

    Counted per (cell, month, era) first, then summed over the species' range.
    """
    own = species_range(obs, windows, years, by)
    counts = obs.groupBy(*by, "gridg3", "month", era(F.col("year"), years).alias("era")).agg(
        F.count(F.lit(1)).alias("n"))
    return (
        own.join(counts, [*by, "gridg3", "month"]).filter(F.col("era") >= F.col("min_era"))
        .groupBy(*by, SP).agg(F.sum("n").alias("data_rows"))
    )


def typical_list_length(obs: DataFrame, windows: DataFrame, years: YearInfo, by: Sequence[str] = ()) -> DataFrame:
    """T03. Median length per 25 km cell, mean per 100 km cell, half-even rounded mean of those.

    Lengths are counted per cell, month and era once for all species; the median is then taken with
    frequencies, so no checklist is repeated per species.
    """
    own = species_range(obs, windows, years, by)
    lengths = checklists(obs, years, by).groupBy(*by, *CELLS, "month", "era", "no_sp").agg(
        F.count(F.lit(1)).alias("n"))
    joined = own.join(lengths, [*by, "gridg3", "month"]).filter(F.col("era") >= F.col("min_era"))
    cell = joined.groupBy(*by, SP, *CELLS).agg(F.expr("percentile(no_sp, 0.5D, n)").alias("m"))
    coarse = cell.groupBy(*by, SP, "gridg3").agg(F.avg("m").alias("m"))
    return coarse.groupBy(*by, SP).agg(F.bround(F.avg("m"), 0).cast("bigint").alias("typical_length"))


def detected(count: str = "obs_count") -> Column:
    return (F.col(count).isNotNull() & (F.col(count) != "0")).cast("int")


def expand_absences(obs: DataFrame, windows: DataFrame, years: YearInfo, by: Sequence[str] = ()) -> DataFrame:
    """T04. Every complete checklist in range with a 1/0 for the species (row-level form)."""
    lists = restrict_range(obs, windows, years, by).filter("all_species_reported = 1")
    seen = obs.select(*by, "group_id", SP, detected().alias("seen")).groupBy(*by, "group_id", SP).agg(
        F.max("seen").alias("seen"))
    out = lists.join(seen, [*by, "group_id", SP], "left")
    return with_season(out.withColumn("seen", F.coalesce("seen", F.lit(0))))


DESIGN = ("gridg3", "gridg1", "season", "timegroup", "no_sp")


def compress(
    obs: DataFrame, windows: DataFrame, years: YearInfo, by: Sequence[str] = (), attrs: Sequence[str] = DESIGN,
) -> DataFrame:
    """T05. Binomial rows (species, cells, season, time group, list length) -> (n, k).

    Equal to grouping the absence expansion, but built from two aggregates: checklists counted per
    (cell, month, attributes) once for all species, and detections counted from presences only. The
    result is bounded by the covariate design, not by the number of checklists. ``attrs`` names the
    covariates kept; the frequency job needs the time group only.
    """
    attrs = list(attrs)
    place = [c for c in ("gridg3", "month", "era") if c not in attrs]
    full = with_season(checklists(obs, years, by).filter("all_species_reported = 1"))
    trials = full.groupBy(*by, *attrs, *place).agg(F.count(F.lit(1)).alias("n"))
    seen = with_season(window_rows(obs, windows, years))
    complete = F.col("all_species_reported") == 1
    # one row per (species, checklist) and then per design cell: the range and the detections share it
    hits = (
        seen.groupBy(*by, SP, *attrs, *place, "min_era", "group_id")
        .agg(F.max(F.when(complete, detected()).otherwise(0)).alias("seen"))
        .groupBy(*by, SP, *attrs, *place, "min_era").agg(F.sum("seen").alias("k"))
    )
    own = hits.select(*by, SP, "gridg3", "month", "min_era").distinct()
    n = (
        own.join(trials, [*by, "gridg3", "month"]).filter(F.col("era") >= F.col("min_era"))
        .groupBy(*by, SP, *attrs).agg(F.sum("n").alias("n"))
    )
    k = hits.groupBy(*by, SP, *attrs).agg(F.sum("k").alias("k"))
    out = null_safe_join(n, k, [*by, SP, *attrs], "left")
    return out.withColumn("k", F.coalesce("k", F.lit(0)).cast("bigint"))


def compress_replicates(
    obs: DataFrame, sets: DataFrame, windows: DataFrame, years: YearInfo, n: int, by: Sequence[str] = (), attrs: Sequence[str] = DESIGN,
) -> DataFrame:
    """T05 for ``n`` replicates at once: ``compress`` of every replicate, as rows (sim, species, attributes) -> (n, k).

    ``sets`` (by, group_id, sims) are the replicates of each checklist. Trials, ranges and detections are summed position by
    position, so the rows that are read and shuffled are those of one compression; only the result has a row per replicate.
    Presences on drawn checklists are found once and staged without their sets, as ranges and detections both read them.
    """
    attrs, by = list(attrs), list(by)
    place = [c for c in ("gridg3", "month", "era") if c not in attrs]
    sets = sets.select(*by, "group_id", "sims")
    full = with_season(checklists(obs, years).filter("all_species_reported = 1"))
    trials = summed(full.join(sets, "group_id"), [*by, *attrs, *place], n, name="trials")
    complete = F.col("all_species_reported") == 1
    hits = staged(
        with_season(window_rows(obs, windows, years))
        .select(SP, *attrs, *place, "min_era", "group_id", F.when(complete, detected()).otherwise(0).alias("seen"))
        .join(sets.select("group_id"), "group_id", "left_semi")
        .groupBy(SP, *attrs, *place, "min_era", "group_id").agg(F.max("seen").alias("seen"))
    ).join(sets, "group_id")
    own = united(hits, [*by, SP, "gridg3", "month", "min_era"])
    ranged = own.join(trials, [*by, "gridg3", "month"]).filter(F.col("era") >= F.col("min_era"))
    tried = summed(ranged, [*by, SP, *attrs], n, weights="trials", name="n")
    found = summed(hits.filter("seen = 1"), [*by, SP, *attrs], n, name="k")
    out = by_replicate(null_safe_join(tried, found, [*by, SP, *attrs], "left"), ["n", "k"], n)
    return out.filter("n > 0")


def reporting_frequency(binomial: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Link-scale reporting frequency and its standard error per time group, no model fitted.

    Delta method on ln(-ln(1-p)); groups without contrast (p = 0 or 1) have no finite value and stay as NULL.
    """
    g = binomial.groupBy(*by, SP, "timegroup").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    g = g.withColumn("p", F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), F.col("k") / F.col("n")))
    q = F.log(F.lit(1.0) - F.col("p"))
    return g.select(
        *by, SP, "timegroup", F.log(-q).alias("freq"),
        (F.sqrt(F.col("p") / (F.col("n") * (F.lit(1.0) - F.col("p")))) / F.abs(q)).alias("se"),
    )


def complete_sims(raw: DataFrame, sims: int, labels: DataFrame, by: Sequence[str] = (), every: DataFrame | None = None) -> DataFrame:
    """Every species with every simulation and time group; what a simulation did not estimate is NULL.

    The species are those of ``every``, or else those with any estimate. ``labels`` (timegroup, year) are a few rows and the simulation numbers an array, so species rows are
    exploded against fixed sets.
    """
    points = [F.struct(F.lit(r["timegroup"]).alias("timegroup"), F.lit(r["year"]).alias("year")) for r in labels.select("timegroup", "year").distinct().collect()]
    full = (
        (raw if every is None else every).select(*by, SP).distinct()
        .withColumn("sim", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(sims).cast("bigint"))))
        .withColumn("p", F.explode(F.array(*points))).select(*by, SP, "sim", "p.timegroup", "p.year")
    )
    return full.join(raw.drop("year"), [*by, SP, "sim", "timegroup"], "left")


# ------------------------------------------------------------------ after a fit
def prediction_grid(binomial: DataFrame, lengths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """T08. Seasons x time groups present for each species, at its typical list length.

    Both sides are label sets of one species (at most 4 seasons), so the season set is an array that
    is exploded, not a join of rows.
    """
    seasons = binomial.groupBy(*by, SP).agg(F.array_sort(F.collect_set("season")).alias("seasons"))
    groups = binomial.select(*by, SP, "timegroup").distinct()
    return (
        groups.join(seasons, [*by, SP]).join(lengths, [*by, SP])
        .withColumn("season", F.explode("seasons")).drop("seasons")
    )


def predict_fixed(grid: DataFrame, model: DataFrame, by: Sequence[str] = (), se_scale: float | Column = 1.0,
                  residual_variance: float | Column = 0.0) -> DataFrame:
    """T08. Link-scale fit and error from coefficient and covariance arrays.

    ``model`` has ``terms`` (names), ``coef`` and ``cov`` (row-major). ``se_scale`` turns the standard
    error into the reported error (1 for fixed models, about 0.643 for the 48 % half-width of mixed
    models); ``residual_variance`` is the switch that widens mixed-model intervals.
    """
    j = grid.join(model, [*by, SP])
    log_len = F.log(F.col("typical_length"))
    x = F.transform("terms", lambda t: F.when(t == F.concat(F.lit("season:"), F.col("season")), F.lit(1.0))
                    .when(t == F.concat(F.lit("length:"), F.col("season")), log_len)
                    .when(t == F.concat(F.lit("time:"), F.col("timegroup")), F.lit(1.0))
                    .otherwise(F.lit(0.0)))
    j = j.withColumn("x", x)
    dot = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    p = F.size("x")
    rows = F.transform(F.sequence(F.lit(0), p - 1), lambda i: F.aggregate(
        F.zip_with("x", F.slice("cov", i * p + 1, p), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    var = F.aggregate(F.zip_with("x", rows, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return j.withColumns({"fit": dot, "var": var}).select(
        *by, SP, "timegroup", "season", "fit",
        (F.sqrt(F.greatest(F.col("var"), F.lit(0.0)) + F.lit(residual_variance)) * F.lit(se_scale)).alias("err"),
    )


def predict_chosen(grid: DataFrame, model: DataFrame, reported: dict, by: Sequence[str] = ()) -> DataFrame:
    """T08 where every species has a model of its own: ``model`` names the kind, ``reported`` {kind: (error scale, residual variance)}."""
    scale = variance = F.lit(None).cast("double")
    for kind, (s, v) in reported.items():
        scale, variance = F.when(F.col("model") == kind, s).otherwise(scale), F.when(F.col("model") == kind, v).otherwise(variance)
    return predict_fixed(grid, model, by, scale, variance)


def average_seasons(pred: DataFrame, years: YearInfo, by: Sequence[str] = ()) -> DataFrame:
    """T09. Mean fit and error over seasons; every time group is listed, absent ones with NULLs."""
    kept = pred.filter("fit IS NOT NULL AND err IS NOT NULL AND NOT isnan(fit) AND NOT isnan(err)")
    avg = kept.groupBy(*by, SP, "timegroup").agg(F.avg("fit").alias("freq"), F.avg("err").alias("se"))
    labels = F.array(*[F.struct(F.lit(l).alias("timegroup"), F.lit(m).alias("year"))
                       for l, m in zip(years.labels, years.medians)])
    frame = pred.select(*by, SP).distinct().withColumn("l", F.explode(labels)).select(*by, SP, "l.*")
    return frame.join(avg, [*by, SP, "timegroup"], "left")


def tidy_estimates(wide: DataFrame, years: YearInfo, order: DataFrame, by: Sequence[str] = ("sim",)) -> DataFrame:
    """T10. Wide estimates (freq1..freqT, se1..seT per species) to rows, in the species list's order.

    ``order`` holds ``common_name`` and its place ``sl``.
    """
    pairs = F.array(*[
        F.struct(F.lit(i).alias("tg_no"), F.lit(l).alias("timegroup"), F.lit(m).alias("year"),
                 F.col(f"freq{i}").alias("freq"), F.col(f"se{i}").alias("se"))
        for i, (l, m) in enumerate(zip(years.labels, years.medians), 1)
    ])
    return (
        wide.withColumn("e", F.explode(pairs)).select(*by, SP, "e.*")
        .join(order.select(SP, "sl"), SP).select("sl", *by, SP, "timegroup", "year", "freq", "se")
    )


def widen_estimates(rows: DataFrame, years: YearInfo, by: Sequence[str] = ("sim",)) -> DataFrame:
    """T10. The wide import form: one row per species, fixed pivot values."""
    aggs = []
    for i, l in enumerate(years.labels, 1):
        hit = F.col("timegroup") == l
        aggs += [F.max(F.when(hit, F.col("freq"))).alias(f"freq{i}"), F.max(F.when(hit, F.col("se"))).alias(f"se{i}")]
    return rows.groupBy(*by, SP).agg(*aggs)


SEASONS = SEASON_NAMES
