"""Checklists to classified long-term trends without a model fit: the flagship job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrends.operators import classify, qualify, resample, resolve, trends
from fieldtrends.session import staged
from fieldtrends.sources import adapters as A


SIMS, DRAWS = 1000, 1000


def windows_for(spark: SparkSession, d: str) -> DataFrame:
    """Fixture windows: every third species is analysed over the recent years only."""
    m = A.species_map(spark, d)
    recent = F.col("k") % 3 == 0
    listed = m.select("common_name", F.when(~recent, 1).alias("ht"), F.lit(1).alias("rt"))
    return trends.model_window(listed)


def everything(spark: SparkSession, d: str) -> DataFrame:
    """All species over all years."""
    return A.species_map(spark, d).select("common_name", F.lit(trends.ERA_ALL).alias("min_era"))


def raw_trends(spark: SparkSession, d: str, sims: int = SIMS, seed: int = 42) -> DataFrame:
    """Replicated reporting frequencies: (sim, species, time group, year, freq, se), NULL where a replicate has no estimate."""
    ana = A.analysis_table(spark, d, reuse=True, columns=A.MODEL)
    sets = staged(resample.replicate_sets(qualify.sampling_frame(ana), sims, seed))
    species = staged(everything(spark, d))  # a row per species: its size is known, while that of its plan would follow the input
    rows = trends.compress_replicates(ana, sets, species, A.YEARS, sims, attrs=["timegroup"])
    labels = qualify.label_dim(ana, A.YEARS).select("timegroup", F.col("tg_year").alias("year"))
    return trends.complete_sims(trends.reporting_frequency(rows, ["sim"]), sims, labels)


def classified_trends(spark: SparkSession, d: str) -> DataFrame:
    """Long-term status of every recorded species: simulate, combine, standardise, interval of the latest year, classify.

    A species without an estimate in the latest year keeps NULL values and has insufficient data.
    """
    std = resolve.standardise(resolve.combine_sims(raw_trends(spark, d)))
    last = resolve.ratio_interval(std, DRAWS, 10).filter(F.col("year") == A.YEARS.latest_year)
    main = last.select("common_name", F.col("lci_std").alias("longtermlci"),
                       F.col("mean_std").alias("longtermmean"), F.col("rci_std").alias("longtermrci"))
    every = A.species_map(spark, d).select("common_name").distinct()
    return classify.long_term_status(every.join(main, "common_name", "left")).orderBy("common_name")
