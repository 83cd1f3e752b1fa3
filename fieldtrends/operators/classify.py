"""Data-driven statuses and conservation priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrends.config import (
    CURRENT_BANDS, CURRENT_BOUNDS, CURRENT_WIDTH, DECLINE, LONG_TERM_BANDS, LONG_TERM_BOUNDS,
    LONG_TERM_WIDTH, RANGE_BOUNDS, RANGE_STATUSES, RESTRICTED, TREND_STATUSES, UNCERTAIN,
)

LT, CT, RG, PR = "long_term_status", "current_status", "range_status", "priority_status"


def _graded(lci: Column, rci: Column, bounds: Sequence[float], missing: Column, wide: Column, strict: Column) -> Column:
    """Shared ladder: missing, too wide, declines by the upper limit, increases by the lower, then stable."""
    low2, low1, _, up1, up2 = bounds
    return (
        F.when(missing, "Insufficient Data").when(wide, "Trend Inconclusive")
        .when(rci <= low2, "Rapid Decline").when(rci <= low1, "Decline")
        .when(lci >= up2, "Rapid Increase").when(lci >= up1, "Increase")
        .when(strict, "Trend Inconclusive").otherwise("Stable")
    )


def long_term_status(df: DataFrame, bounds=LONG_TERM_BOUNDS, width: float = LONG_TERM_WIDTH, name: str = LT) -> DataFrame:
    """K01. Status of the change since the baseline (limits in percent of it)."""
    l, m, r = F.col("longtermlci"), F.col("longtermmean"), F.col("longtermrci")
    strict = (l > bounds[2]) | (r < bounds[2]) | (l <= bounds[0]) | (r >= bounds[4])
    wide = F.when(m == 0, r > 0).otherwise(F.try_divide(r - m, m) > width)
    return df.withColumn(name, _graded(l, r, bounds, m.isNull(), wide, strict))


def current_status(df: DataFrame, bounds=CURRENT_BOUNDS, width: float = CURRENT_WIDTH, name: str = CT) -> DataFrame:
    """K02. Status of the recent annual change (percent per year)."""
    l, m, r = F.col("currentslopelci"), F.col("currentslopemean"), F.col("currentsloperci")
    strict = (r < bounds[2]) | (l > bounds[2])
    return df.withColumn(name, _graded(l, r, bounds, m.isNull(), (r - l) > width, strict))


def recent_vagrants(vagrants: DataFrame, latest: int, years: int = 5) -> DataFrame:
    """Species reported as vagrants in the last years."""
    return vagrants.filter(F.col("year") > latest - years).select(F.col("common_name").alias("species")).distinct()


def range_status(df: DataFrame, vagrants: DataFrame, bounds=RANGE_BOUNDS, name: str = RG) -> DataFrame:
    """K03. Status of the range size; vagrants are never Historical, island species have a lower limit."""
    flagged = df.join(vagrants.select("species", F.lit(True).alias("__vag")).distinct(), "species", "left")
    l, m, r = F.col("rangelci"), F.col("rangemean"), F.col("rangerci")
    island, small, mid, large, huge = bounds
    status = (
        F.when(m.isNull(), F.lit(None).cast("string"))
        .when((m == 0) & F.col("__vag").isNull(), "Historical")
        .when(r < island, "Very Restricted").when(F.col("restricted_islands").isNull() & (r < small), "Very Restricted")
        .when(r < mid, "Restricted").when(l > huge, "Very Large").when(l > large, "Large").otherwise("Moderate")
    )
    return flagged.withColumn(name, status).drop("__vag")


def inherit_range_status(state: DataFrame, national: DataFrame) -> DataFrame:
    """K04. State rows keep a missing or Historical range status, others take the national one."""
    nat = national.select("species", F.col(RG).alias("__nat")).distinct()
    keep = F.col(RG).isNull() | (F.col(RG) == "Historical")
    return state.join(nat, "species", "left").withColumn(
        RG, F.when(keep, F.col(RG)).otherwise(F.col("__nat"))).drop("__nat")


def long_term_consensus(main: DataFrame, seeds: DataFrame) -> DataFrame:
    """K05. Status over the main run and re-seeded runs; disagreement takes the conservative side."""
    own = main.filter(F.col(LT).isNotNull() & (F.col(LT) != "Insufficient Data")).select("species", LT)
    rows = own.unionByName(seeds.select("species", LT))
    g = rows.groupBy("species").agg(F.collect_set(LT).alias("s"))
    has = lambda x: F.array_contains("s", x)
    n = F.size("s")
    safe = (
        F.when((n > 2) | has("Trend Inconclusive"), "Trend Inconclusive")
        .when((n == 2) & has("Rapid Increase") & has("Increase"), "Increase")
        .when((n == 2) & has("Rapid Decline") & has("Decline"), "Decline")
        .when(n == 2, "Trend Inconclusive").otherwise(F.array_min("s"))
    )
    g = g.select("species", safe.alias("__safe"), (n == 1).alias("__robust"))
    return main.join(g, "species", "left").withColumn(
        LT, F.when(F.col("__robust") == F.lit(False), F.col("__safe")).otherwise(F.col(LT))).drop("__safe", "__robust")


def sensitivity_statuses(wide: DataFrame, n_years: int) -> DataFrame:
    """K06. Wide leave-one-year-out intervals to (species, dropped_no, current_status)."""
    items = F.array(*[
        F.struct(F.lit(i).alias("dropped_no"), *[F.col(f"currentslope{c}{i}").alias(f"currentslope{c}") for c in ("lci", "mean", "rci")])
        for i in range(1, n_years + 1)
    ])
    long = wide.withColumn("e", F.explode(items)).select("species", "e.*")
    return current_status(long).select("species", "dropped_no", CT)


def current_consensus(main: DataFrame, dropped: DataFrame, max_inconclusive: int = 4) -> DataFrame:
    """K06. Rules over the main status and the statuses with one year left out.

    Mixed direction, or inconclusive at least ``max_inconclusive`` times, becomes inconclusive; a rapid
    main status that weakens when a year is dropped is softened by one step.
    """
    own = main.filter(F.coalesce(~F.col(CT).isin(UNCERTAIN), F.lit(True))).select("species", CT, F.lit(True).alias("is_main"))
    rest = dropped.select("species", CT, F.lit(False).alias("is_main")).join(own.select("species"), "species", "left_semi")
    any_of = lambda *v: F.coalesce(F.bool_or(F.col(CT).isin(list(v))), F.lit(False))
    main_is = lambda v: F.coalesce(F.bool_or(F.col("is_main") & (F.col(CT) == v)), F.lit(False))
    g = own.unionByName(rest).groupBy("species").agg(
        any_of("Decline", "Rapid Decline").alias("dec"), any_of("Increase", "Rapid Increase").alias("inc"),
        any_of("Stable").alias("stable"), any_of("Decline").alias("dec1"), any_of("Increase").alias("inc1"),
        F.count_if(F.col(CT) == "Trend Inconclusive").alias("n_inc"),
        main_is("Rapid Decline").alias("rapid_dec"), main_is("Rapid Increase").alias("rapid_inc"),
    )
    mixed = (F.col("dec") & (F.col("stable") | F.col("inc"))) | (F.col("inc") & (F.col("stable") | F.col("dec")))
    new = (
        F.when(mixed | (F.col("n_inc") >= max_inconclusive), "Trend Inconclusive")
        .when(F.col("rapid_dec") & F.col("dec1"), "Decline").when(F.col("rapid_inc") & F.col("inc1"), "Increase")
    )
    return main.join(g.select("species", new.alias("__new")), "species", "left").withColumn(
        CT, F.coalesce("__new", CT)).drop("__new")


def null_unselected(main: DataFrame, cols: Sequence[str] = (LT, CT, RG)) -> DataFrame:
    """K07. Clear the statuses of species that are not selected."""
    return main.withColumns({c: F.when(F.col("selected") == "X", F.col(c)) for c in cols})


def score_rules(spark) -> DataFrame:
    """A complete decision table (7 x 7 x 6 combinations) from a scoring rule.

    The published table is data: read it with ``read_dim`` and pass it to ``priority_status``. This one
    has the same shape and follows a parametrised rule: points for declines, uncertainty and small
    ranges; Historical is Low; a current trend without data against a known long-term one is undefined.
    """
    points = {"Rapid Decline": 4, "Decline": 3, "Insufficient Data": 1, "Trend Inconclusive": 1,
              "Stable": 0, "Increase": -1, "Rapid Increase": -1}
    size = {"Very Restricted": 3, "Restricted": 2, "Moderate": 1, "Large": 0, "Very Large": -1, "Historical": 0}
    rows = []
    for lt in TREND_STATUSES:
        for ct in TREND_STATUSES:
            for rg in RANGE_STATUSES:
                s = points[lt] + points[ct] + size[rg]
                p = "High" if s >= 5 else "Moderate" if s >= 3 else "Low"
                if rg == "Historical":
                    p = "Low"
                elif ct == "Insufficient Data" and lt != "Insufficient Data":
                    p = None
                rows.append((lt, ct, rg, p))
    return spark.createDataFrame(rows, f"{LT} string, {CT} string, {RG} string, {PR} string")


def priority_status(main: DataFrame, rules: DataFrame) -> DataFrame:
    """K08. Decision-table lookup on the three statuses, then overrides by threat category and endemism."""
    r = rules.select(F.col(LT).alias("__l"), F.col(CT).alias("__c"), F.col(RG).alias("__r"), F.col(PR).alias("__p"))
    j = main.drop(PR).join(
        r, F.col(LT).eqNullSafe(F.col("__l")) & F.col(CT).eqNullSafe(F.col("__c")) & F.col(RG).eqNullSafe(F.col("__r")), "left")
    both = lambda v: F.col(LT).isin(v) & F.col(CT).isin(v)
    iucn, p = F.col("iucn"), F.col("__p")
    status = (
        F.when(iucn.isin("Extinct in the Wild", "Extinct"), "Low")
        .when((both(UNCERTAIN) | both(DECLINE)) & iucn.isin("Endangered", "Critically Endangered"), "High")
        .when(both(UNCERTAIN) & F.col(RG).isin(RESTRICTED) & (iucn == "Vulnerable"), "High")
        .when(both(UNCERTAIN) & iucn.isin("Near Threatened", "Vulnerable") & (p == "Low"), "Moderate")
        .when(both(["Insufficient Data"]) & (F.col("endemic_region") != "Non-endemic") & (p == "Low"), "Moderate")
        .otherwise(p)
    )
    return j.withColumn(PR, status).drop("__l", "__c", "__r", "__p")


def to_percent_change(main: DataFrame) -> DataFrame:
    """K09. Percent of baseline to percent change; analyses without data lose their mark."""
    out = main.withColumns({c: F.col(c) - 100 for c in ("longtermlci", "longtermmean", "longtermrci")})
    none = "Insufficient Data"
    return out.withColumns({
        "long_term_analysis": F.when(F.col(LT) == none, "").otherwise(F.col("long_term_analysis")),
        "current_analysis": F.when(F.col(CT) == none, "").otherwise(F.col("current_analysis")),
    })


def inherit_national(main: DataFrame, national: DataFrame, blank: Sequence[str]) -> DataFrame:
    """K10. Sub-national rows: past and range statuses are blank, priority is the national one.

    ``main`` may hold several masks; rows of mask ``none`` keep their values.
    """
    nat = national.select("species", F.col(PR).alias("__nat")).distinct()
    sub = F.col("mask") != "none"
    out = main.join(nat, "species", "left")
    return out.withColumns({
        **{c: F.when(~sub, F.col(c)) for c in blank},
        PR: F.when(sub, F.col("__nat")).otherwise(F.col(PR)),
    }).drop("__nat")


def carry_major_statuses(main: DataFrame, past: DataFrame, taxonomy: DataFrame, old: str, new: str) -> DataFrame:
    """K11. Statuses of the last major update, re-keyed to the present names."""
    cols = [LT, CT, RG, PR]
    t = taxonomy.select(F.col(old).alias("species"), F.col(new).alias("__new"))
    p = past.join(t, "species", "left").select(
        F.col("__new").alias("species"), *[F.col(c).alias(f"major_{c}") for c in cols])
    return main.join(p, "species", "left")


def band_scale(main: DataFrame) -> DataFrame:
    """K12. Place each trend inside its status band on a common scale from -5 to 5."""
    def scale(status: str, pre: str, centre: float, bands) -> Column:
        label = F.when(F.col(status) == "Stable", F.when(F.col(f"{pre}mean") >= centre, "Stable+").when(
            F.col(f"{pre}mean") < centre, "Stable-")).otherwise(F.col(status))
        out = F.lit(None).cast("double")
        for name, low, high, use, width, offset in bands:
            out = F.when(label == name, (F.col(f"{pre}{use}") - low) / (high - low) * width + offset).otherwise(out)
        return F.when(out.isNotNull(), F.greatest(F.least(out, F.lit(5.0)), F.lit(-5.0)))

    return main.withColumns({
        "longterm_scaled": scale(LT, "longterm", 100.0, LONG_TERM_BANDS),
        "current_scaled": scale(CT, "currentslope", 0.0, CURRENT_BANDS),
    })


def inherit_range_size(main: DataFrame, national: DataFrame) -> DataFrame:
    """K13. Habitat and conservation-area rows take the national range size."""
    cols = ["rangelci", "rangemean", "rangerci"]
    nat = national.select("species", *cols).distinct()
    return main.drop(*cols).join(nat, "species", "left")
