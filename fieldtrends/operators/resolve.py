"""From simulated estimates to trend curves, slopes, projections and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldtrends.config import Z95, YearInfo
from fieldtrends.functions import portable
from fieldtrends.functions.maths import (
    inv_cloglog, let, line_at, line_error, line_of, mean_of, present, quantiles_of, quotient_error, spread_of, total,
)

SP = "common_name"
DENOMINATOR_SHIFT = 104729
PICK_SHIFT = 15485863
INTERVAL = (0.025, 0.975)


def year_info(complete: DataFrame, medians: DataFrame, bins: Sequence[tuple[str, int]], recent_from: int = 2015) -> YearInfo:
    """V01. YearInfo from the complete years and the historical medians (a handful of rows)."""
    years = sorted(r["year"] for r in complete.collect())
    med = {r["hist_period"]: r["median_year"] for r in medians.collect()}
    return YearInfo(
        latest_year=years[-1],
        bins=tuple((label, last, med.get(i, last)) for i, (label, last) in enumerate(bins, 1)),
        full_years=tuple(years), recent_from=recent_from,
    )


def year_table(spark, years: YearInfo) -> DataFrame:
    """V01 as rows: kind (timegroup, recent, projection), position, label, year."""
    rows = [("timegroup", i, l, m) for i, (l, m) in enumerate(zip(years.labels, years.medians), 1)]
    rows += [("recent", i, str(y), y) for i, y in enumerate(years.recent_years, 1)]
    rows += [("projection", i, str(y), y) for i, y in enumerate(years.projection_years, 1)]
    return spark.createDataFrame(rows, "kind string, pos int, label string, year int")


def combine_sims(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """V02. Mean over simulations; error = spread of the means + root mean square of their errors;
    95 % limits on the link scale, then back-transformed. One missing simulation makes all NULL."""
    whole = (F.count("freq") == F.count(F.lit(1))) & (F.count("se") == F.count(F.lit(1)))
    spread = F.when(F.count(F.lit(1)) > 1, F.stddev_samp("freq"))
    g = raw.groupBy(*by, SP, "timegroup", "year").agg(
        F.when(whole, F.avg("freq")).alias("mean_trans"),
        F.when(whole, spread + F.sqrt(F.sum(F.col("se") * F.col("se")) / F.count(F.lit(1)))).alias("se_trans"),
    )
    half = Z95 * F.col("se_trans")
    return g.withColumns({
        "lci": inv_cloglog(F.col("mean_trans") - half),
        "mean": inv_cloglog(F.col("mean_trans")),
        "rci": inv_cloglog(F.col("mean_trans") + half),
    })


def framework(trends: DataFrame, years: YearInfo, by: Sequence[str] = ()) -> DataFrame:
    """V03. Every species with every time group and projection year (a fixed label array, exploded)."""
    points = [(l, m) for l, m in zip(years.labels, years.medians)]
    points += [(str(y), y) for y in years.projection_years]
    arr = F.array(*[F.struct(F.lit(l).alias("timegroup"), F.lit(m).alias("year")) for l, m in points])
    return trends.select(*by, SP).distinct().withColumn("p", F.explode(arr)).select(*by, SP, "p.*")


def standardise(trends: DataFrame, start: int | None = None, name: str = "mean_std", by: Sequence[str] = ()) -> DataFrame:
    """V04. Baseline of the first time point per species and the value as a percentage of it.

    ``start`` gives the recent variant. Groups hold one row per time point.
    """
    df = trends.filter("mean_trans IS NOT NULL AND se_trans IS NOT NULL")
    if start is not None:
        df = df.filter(F.col("year") >= start)
    w = W.partitionBy(*by, SP).orderBy("year").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.withColumns({
        "m1": F.first("mean_trans").over(w), "s1": F.first("se_trans").over(w),
        "mean_year1": F.first("mean").over(w), "first_year": F.first("year").over(w),
    }).withColumn(name, 100 * F.col("mean") / F.col("mean_year1"))


def with_draw_key(df: DataFrame) -> DataFrame:
    """Integer key per (species, year), the base of every simulated draw: 28 bits of the name's digest.

    No ranking over all species is needed; two names with equal bits would merely share random numbers.
    """
    bits = F.conv(F.substring(F.md5(F.col(SP)), 1, 7), 16, 10).cast("bigint")
    return df.withColumn("draw_key", bits * 1000 + (F.col("year") - 1900))


def draw_ids(n: int) -> Column:
    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))
    return F.transform(numbers, lambda d: F.col("draw_key") * 10007 + d)


def drawn_values(n: int, seed, mean: str = "mean_trans", se: str = "se_trans") -> Column:
    """The n back-transformed simulated frequencies of a (species, year), as an array: rows are never multiplied by draws."""
    return F.transform(portable.normal_all(draw_ids(n), seed), lambda z: inv_cloglog(F.col(mean) + F.col(se) * z))


def drawn_ratios(n: int, seed) -> Column:
    """The n simulated ratios to the baseline."""
    base_seed = (seed if isinstance(seed, Column) else F.lit(int(seed)).cast("bigint")) + DENOMINATOR_SHIFT
    return F.zip_with(drawn_values(n, seed), drawn_values(n, base_seed, "m1", "s1"), lambda a, b: F.try_divide(a, b))


def ratio_interval(std: DataFrame, n: int, seed: int, lci: str = "lci_std", rci: str = "rci_std") -> DataFrame:
    """V05. Quantile interval of n simulated ratios to the baseline, in percent. Row by row: nothing is shuffled."""
    q = with_draw_key(std).withColumn("__q", quantiles_of(drawn_ratios(n, seed), INTERVAL))
    return q.withColumns({lci: 100 * F.get("__q", F.lit(0)), rci: 100 * F.get("__q", F.lit(1))}).drop("__q", "draw_key")


def seed_sensitivity(std: DataFrame, n: int, seeds: Sequence[int], latest: int) -> DataFrame:
    """V06. The interval of the latest year under several seeds."""
    sim = with_draw_key(std).filter(F.col("year") == latest).withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in seeds])))
    sim = sim.withColumn("q", quantiles_of(drawn_ratios(n, F.col("seed")), INTERVAL))
    return sim.select(SP, "seed", (100 * F.get("q", F.lit(0))).alias("longtermlci"), F.col("mean_std").alias("longtermmean"),
                      (100 * F.get("q", F.lit(1))).alias("longtermrci"))


def latest_values(main: DataFrame, intervals: DataFrame, latest: int) -> DataFrame:
    """V07. Interval of the latest year onto the main table."""
    last = intervals.filter(F.col("year") == latest).select(
        SP, F.col("lci_std").alias("longtermlci"), F.col("mean_std").alias("longtermmean"), F.col("rci_std").alias("longtermrci"))
    return main.join(last, SP, "left")


def zero_baseline_band(df: DataFrame, lci: str = "lci_std", mean: str = "mean_std", rci: str = "rci_std") -> DataFrame:
    """V08. The baseline year has no width."""
    base = F.col("year") == F.min("year").over(W.partitionBy(SP))
    return df.withColumns({c: F.when(base, F.col(mean)).otherwise(F.col(c)) for c in (lci, rci)})


def value_arrays(std: DataFrame, n: int, seed: int = 1, value_seed: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """V09 in the form the later steps use: per (species, year) the n simulated values and n of them at random, as arrays."""
    start = F.lit(seed + PICK_SHIFT).cast("bigint")
    picks = F.transform(portable.uniform_all(draw_ids(n), start), lambda u: F.floor(u * n).cast("int"))
    both = let(drawn_values(n, value_seed), lambda v: F.struct(v.alias("val"), F.transform(picks, lambda i: F.get(v, i)).alias("val_sample")))
    return with_draw_key(std).select(*by, SP, "year", both.alias("__v")).select(*by, SP, "year", "__v.*")


def resample_values(std: DataFrame, n: int, seed: int = 1, value_seed: int = 10) -> DataFrame:
    """V09. Per (species, year, sim): the sim's own value and one of the n values at random."""
    rows = value_arrays(std, n, seed, value_seed).select(SP, "year", F.posexplode(F.arrays_zip("val", "val_sample")).alias("i", "v"))
    return rows.select(SP, "year", (F.col("i") + 1).cast("bigint").alias("sim"), "v.val", "v.val_sample")


def by_species(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per species with its years in order and their arrays: the only shuffle of the slopes, of (species, year) rows."""
    return values.groupBy(*by, SP).agg(F.array_sort(F.collect_list(F.struct("year", "val", "val_sample"))).alias("s"))


def _sims(s: Column) -> Column:
    return F.sequence(F.lit(0), F.size(F.get(s, F.lit(0))["val"]) - 1)


def _points(s: Column, i: Column, y) -> Column:
    return F.transform(s, lambda r: F.struct(r["year"].cast("double").alias("x"), y(F.get(r["val_sample"], i)).alias("y")))


def _slopes(s: Column, scale_se: bool) -> Column:
    """Per simulation: the slope between the first two years relative to the first, in percent, and its error."""
    x1, x2 = F.get(s, F.lit(0))["year"].cast("double"), F.get(s, F.lit(1))["year"].cast("double")

    def one(line: Column) -> Column:
        f1, e1 = line_at(line, x1), line_error(line, x1)
        num, den, e2 = line_at(line, x2) - f1, F.abs(f1), line_error(line, x2)
        error = quotient_error(num, den, F.sqrt(e1 * e1 + e2 * e2), e1) * (100.0 if scale_se else 1.0)
        return F.struct((100 * F.try_divide(num, den)).alias("sl"), error.alias("slse"))

    return F.transform(_sims(s), lambda i: let(line_of(_points(s, i, lambda v: v)), one))


def _interval(slopes: Column) -> Column:
    """Mean slope over the simulations with its limits: spread of the slopes + root mean square of their errors."""
    mean = mean_of(F.transform(slopes, lambda x: x["sl"]))
    squares = present(F.transform(slopes, lambda x: x["slse"] * x["slse"]))
    error = spread_of(F.transform(slopes, lambda x: x["sl"])) + F.sqrt(F.when(F.size(squares) > 0, total(squares) / F.size(slopes)))
    return F.struct((mean - Z95 * error).alias("currentslopelci"), mean.alias("currentslopemean"), (mean + Z95 * error).alias("currentsloperci"))


def slope_interval(values: DataFrame, by: Sequence[str] = (), scale_se: bool = False) -> DataFrame:
    """V10. Slope between the first two fitted years relative to the first, in percent, over the simulations of ``value_arrays``.

    The error of the slope stays a fraction while the slope is a percentage, as in the source
    analysis; ``scale_se`` puts both on the percentage scale.
    """
    rows = by_species(values, by)
    return rows.select(*by, SP, let(_slopes(F.col("s"), scale_se), _interval).alias("r")).select(*by, SP, "r.*")


def slope_sensitivity(values: DataFrame, years: Sequence[int]) -> DataFrame:
    """V11. The slope interval with each year left out in turn (long form)."""
    rows = by_species(values).withColumn("dropped", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    rest = let(F.filter("s", lambda r: r["year"] != F.col("dropped")), lambda s: let(_slopes(s, False), _interval))
    left = rows.filter((F.size("s") > 1) | (F.get("s", F.lit(0))["year"] != F.col("dropped")))
    return left.select("dropped", SP, rest.alias("r")).select("dropped", SP, "r.*")


def sensitivity_wide(long: DataFrame, years: Sequence[int]) -> DataFrame:
    """V11. One row per species, three columns per left-out year in year order."""
    aggs = []
    for i, y in enumerate(years, 1):
        for c in ("lci", "mean", "rci"):
            aggs.append(F.max(F.when(F.col("dropped") == y, F.col(f"currentslope{c}"))).alias(f"currentslope{c}{i}"))
    return long.groupBy(SP).agg(*aggs)


def project(values: DataFrame, future: Sequence[int], start: int) -> DataFrame:
    """V12. Exponential projection as a percentage of the first year's simulated value, mean over sims."""
    rows = by_species(values).withColumn("first", F.get(F.filter("s", lambda r: r["year"] >= start), F.lit(0))["val"]).filter("first IS NOT NULL")
    ahead = F.array(*[F.lit(int(y)) for y in future])

    def one(i: Column) -> Column:
        def limits(line: Column) -> Column:
            def at(year: Column) -> Column:
                m, half, v1 = line_at(line, year), Z95 * line_error(line, year), F.get("first", i)
                return F.struct(*[(100 * F.exp(x) / v1).alias(c) for x, c in ((m - half, "l"), (m, "m"), (m + half, "r"))])

            return F.transform(ahead, at)

        return let(line_of(_points(F.col("s"), i, F.log)), limits)

    rows = rows.select(SP, F.transform(_sims(F.col("s")), one).alias("p"))

    def mean(k: int, name: str) -> Column:
        return mean_of(F.transform("p", lambda x: F.get(x, F.lit(k))[name]))

    points = F.array(*[
        F.struct(F.lit(int(y)).alias("year"), mean(k, "l").alias("lci_ext_std"), mean(k, "m").alias("mean_ext_std"), mean(k, "r").alias("rci_ext_std"))
        for k, y in enumerate(future)])
    return rows.select(SP, F.explode(points).alias("e")).select(SP, "e.*")


def combine_series(frame: DataFrame, trends: DataFrame, long_term: DataFrame, recent: DataFrame, projected: DataFrame) -> DataFrame:
    """V13. Observed, standardised, recent and projected values side by side; the combined series takes
    the projection where there is one, and its lower limit is not below zero."""
    out = frame.join(
        trends.select(SP, "year", "mean_trans", "se_trans", "lci", "mean", "rci"), [SP, "year"], "left")
    out = out.join(long_term.select(SP, "year", "lci_std", "mean_std", "rci_std"), [SP, "year"], "left")
    out = out.join(recent.select(SP, "year", "lci_std_recent", "mean_std_recent", "rci_std_recent"), [SP, "year"], "left")
    out = out.join(projected, [SP, "year"], "left")
    low = F.coalesce("lci_ext_std", "lci_std_recent")
    return out.withColumns({
        "lci_comb_std": F.when(low < 0, 0.0).otherwise(low),
        "mean_comb_std": F.coalesce("mean_ext_std", "mean_std_recent"),
        "rci_comb_std": F.coalesce("rci_ext_std", "rci_std_recent"),
    })
