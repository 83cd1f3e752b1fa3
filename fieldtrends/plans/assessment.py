"""The whole assessment as restartable stages over all masks.

Every stage writes one Parquet dataset under a shared root and is skipped when that dataset is complete
(``_SUCCESS``), so a stopped run continues where it ended. Masks and replicates are columns, not loops:
one job per stage handles all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrends.config import Completeness, YearInfo
from fieldtrends.operators import classify, clean, fits, mistakes, qualify, resample, resolve, spatial, trends
from fieldtrends.sources import sinks


@dataclass
class Inputs:
    """Tables and parameters of one assessment."""

    records: DataFrame
    polygons: DataFrame
    habitat: DataFrame
    species_map: DataFrame
    years: YearInfo
    order: Sequence[str]
    grid_sizes: dict
    lumps: DataFrame | None = None
    mistake_rules: DataFrame | None = None
    region_rules: Sequence = ()
    banned: Sequence[str] = ()
    mask_flags: dict | None = None
    sims: int = 1000
    seed: int = 1
    vagrant_years: int = 3
    interval_draws: int = 1000
    completeness: Completeness = Completeness()
    restricted: DataFrame | None = None  # range-restricted species and their ``mixed`` flag, for the model "chosen"


def done(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def content(table: DataFrame | None) -> tuple | None:
    """Names, types and a digest of the rows of a small table (rules, windows), the same in every session and for any order of rows."""
    if table is None:
        return None
    row = F.xxhash64(F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in sorted(table.columns)]), {"ignoreNullFields": "false"}))
    got = table.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("t")).first()
    return sorted(table.dtypes), got["n"], str(got["s"]), str(got["t"])


class Assessment:
    """Runs the stages; ``self.stage`` writes once and reads back the pruned table."""

    def __init__(self, inputs: Inputs, root: str, model: str = "fixed"):
        if model not in ("frequency", "fixed", "mixed", "chosen"):
            raise ValueError(f"unknown model {model!r}")
        if model == "chosen" and inputs.restricted is None:
            raise ValueError("the model 'chosen' needs the list of range-restricted species")
        self.i, self.root, self.model = inputs, root.rstrip("/"), model
        self.spark = inputs.records.sparkSession
        self.facts: list | None = None

    def stage(self, name: str, build: Callable[[], DataFrame], by: Sequence[str] = (), windows: DataFrame | None = None) -> DataFrame:
        """A stage is found again only for the same parameters and rules; from the model rows on, for the same model and windows too, by
        their rows. The record tables belong to the root: other records need another root."""
        if self.facts is None:
            i = self.i
            self.facts = [i.years, list(i.order), sorted(i.grid_sizes.items()), sorted((k, str(v)) for k, v in (i.mask_flags or {}).items()), i.sims, i.seed,
                          i.interval_draws, i.vagrant_years, i.completeness, content(i.lumps), content(i.mistake_rules), [str(r) for r in i.region_rules], sorted(i.banned)]
        facts = self.facts + ([] if windows is None else [self.model, content(windows), content(self.i.restricted if self.model == "chosen" else None)])
        path = f"{self.root}/{name}-{hashlib.sha256(repr(facts).encode()).hexdigest()[:16]}"
        if not done(self.spark, path):
            w = build().write.mode("overwrite")
            (w.partitionBy(*by) if by else w).parquet(path)
        return self.spark.read.parquet(path)

    def records(self) -> DataFrame:
        """Cleaned records, one row per (checklist, species)."""
        def build() -> DataFrame:
            df = clean.with_date_parts(clean.with_group_id(clean.quality_filter(self.i.records)))
            df = clean.with_list_length(df)
            if self.i.mistake_rules is not None:
                df = mistakes.with_region(df, self.i.region_rules)
                df = mistakes.remove_mistakes(df, self.i.mistake_rules, banned=self.i.banned).drop("region")
            if self.i.lumps is not None:
                df = clean.lump_taxa(df, self.i.lumps)
            return clean.dedupe_observations(df, self.i.years.latest_year, list(self.i.order))

        return self.stage("records", build, ["year"])

    def located(self) -> DataFrame:
        """Records on land with grids, tags and time groups."""
        def build() -> DataFrame:
            rec = self.records()
            pts = spatial.checklist_points(rec, list(self.i.order))
            tags = spatial.tag_points(pts, self.i.polygons, {"pa_name": "pa", "land": "land"}, self.i.grid_sizes)
            tags = spatial.first_match(tags, [F.col("pa_name").asc_nulls_last(), F.col("land").asc_nulls_last()])
            df = clean.effort_filter(spatial.land_only_with_habitat(rec, tags, self.i.habitat))
            return clean.with_timegroup(df, self.i.years)

        return self.stage("located", build, ["year"])

    def _split(self) -> tuple[DataFrame, DataFrame]:
        return clean.split_vagrants(self.located(), self.i.species_map, self.i.vagrant_years, self.i.years.recent_start)

    def vagrants(self) -> DataFrame:
        """Records set apart as vagrants, which the range statuses need."""
        return self.stage("vagrants", lambda: self._split()[1])

    def analysis(self) -> DataFrame:
        """Located records with checked completeness, vagrants split off."""
        return self.stage("analysis", lambda: clean.check_completeness(self._split()[0], list(self.i.order), self.i.completeness), ["year"])

    def by_mask(self) -> DataFrame:
        return spatial.apply_mask(self.analysis(), self.i.mask_flags or {})

    def time_bins(self) -> DataFrame:
        return self.stage("time_bins", lambda: qualify.time_bins(self.by_mask(), self.i.years, ["mask"]), ["mask"])

    def replicate_sets(self) -> DataFrame:
        """The replicates that drew a checklist, per mask, one bit each: the stored form is never larger than the checklists."""
        def build() -> DataFrame:
            frame = qualify.sampling_frame(self.by_mask(), ["mask"])
            return resample.replicate_sets(frame, self.i.sims, self.i.seed, ["mask", *resample.KEYS])

        return self.stage("replicate_sets", build, ["mask"])

    def replicates(self) -> DataFrame:
        """Checklist ids per mask and replicate, as rows."""
        rows = resample.replicate_numbers(self.replicate_sets(), self.i.sims)
        return rows.withColumn("sim", F.explode(F.col("sims").cast("array<bigint>"))).drop("sims")

    def binomial(self, windows: DataFrame) -> DataFrame:
        """Compressed model rows for all (mask, replicate, species)."""
        def build() -> DataFrame:
            attrs = ["timegroup"] if self.model == "frequency" else list(trends.DESIGN)
            return trends.compress_replicates(self.analysis(), self.replicate_sets(), windows, self.i.years, self.i.sims, ["mask"], attrs)

        return self.stage("binomial", build, ["mask"], windows)

    def listed(self, windows: DataFrame) -> DataFrame:
        """Every listed species in every mask that has checklists."""
        masks = F.array(*[F.lit(r["mask"]) for r in self.replicate_sets().select("mask").distinct().collect()])  # some dozens
        return windows.select("common_name").distinct().withColumn("mask", F.explode(masks))

    def fits(self, windows: DataFrame) -> DataFrame:
        """The fitted models with their kind, status and gradient, failed ones included: the log of the fits."""
        def build() -> DataFrame:
            rows, labels, by = self.binomial(windows), self.i.years.labels, ["mask", "sim"]
            if self.model == "chosen":
                return fits.fit_chosen(rows, fits.model_choice(windows, self.i.restricted), labels, by)
            kind, fit = ("fixed", fits.fit_glm) if self.model == "fixed" else ("nested", fits.fit_glmm)
            return fit(rows, labels, by).withColumn("model", F.lit(kind))

        return self.stage(f"fits_{self.model}", build, ["mask"], windows)

    def fit_stats(self, windows: DataFrame) -> DataFrame:
        """Records used per mask and species."""
        return self.stage("fit_stats", lambda: trends.fit_stats(self.by_mask(), windows, self.i.years, ["mask"]), ["mask"], windows)

    def raw_trends(self, windows: DataFrame) -> DataFrame:
        """Estimates per (mask, replicate, species, time group); NULL where a replicate has none, a failed fit included."""
        by = ["mask", "sim"]

        def build() -> DataFrame:
            rows = self.binomial(windows)
            labels = qualify.label_dim(rows, self.i.years).select("timegroup", F.col("tg_year").alias("year"))
            every = self.listed(windows)
            if self.model == "frequency":
                return trends.complete_sims(trends.reporting_frequency(rows, by), self.i.sims, labels, ["mask"], every)
            sampled = self.analysis().join(self.replicates().select("mask", "sim", "group_id"), "group_id")
            lengths = trends.typical_list_length(sampled, windows, self.i.years, by)
            model = self.fits(windows).filter("status = 'ok'").select(*by, "common_name", "model", "terms", "coef", "cov")
            pred = trends.predict_chosen(trends.prediction_grid(rows, lengths, by), model, fits.REPORTED, by)
            found = trends.average_seasons(pred, self.i.years, by).select(*by, "common_name", "timegroup", "year", "freq", "se")
            return trends.complete_sims(found, self.i.sims, labels, ["mask"], every)

        return self.stage(f"raw_trends_{self.model}", build, ["mask"], windows)

    def check(self, windows: DataFrame) -> None:
        """Refuse to go on while any planned (mask, replicate) has no model rows. A small mask may
        rightly have rows but no estimate."""
        sinks.require_complete(self.replicates(), self.binomial(windows))

    def resolved(self, windows: DataFrame) -> DataFrame:
        """Combined and standardised trends with intervals, per mask."""
        def build() -> DataFrame:
            raw = self.raw_trends(windows)
            self.check(windows)
            std = resolve.standardise(resolve.combine_sims(raw, ["mask"]), by=["mask"])
            return resolve.ratio_interval(std, self.i.interval_draws, 10)

        return self.stage(f"resolved_{self.model}", build, ["mask"], windows)

    def long_term(self, windows: DataFrame) -> DataFrame:
        """Long-term status per mask and listed species; without an estimate of the latest year the data are insufficient."""
        last = self.resolved(windows).filter(F.col("year") == self.i.years.latest_year).select(
            "mask", "common_name", F.col("lci_std").alias("longtermlci"),
            F.col("mean_std").alias("longtermmean"), F.col("rci_std").alias("longtermrci"))

        def build() -> DataFrame:
            return classify.long_term_status(self.listed(windows).join(last, ["mask", "common_name"], "left"))

        return self.stage(f"long_term_{self.model}", build, ["mask"], windows)
