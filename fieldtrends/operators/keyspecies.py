"""Key species per state (M11-M15). All tables here have one row per (state, species)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldtrends.config import UNCERTAIN
from fieldtrends.session import cut_lineage

PAIR = ["state", "common_name"]


def candidates(main: DataFrame) -> DataFrame:
    """Species of national concern that may be key to a state."""
    threatened = F.col("iucn").isin("Critically Endangered", "Endangered", "Vulnerable") & (F.col("priority_status") == "Moderate")
    return main.filter((F.col("selected") == "X") & (F.col("range_status") != "Historical") & (threatened | (F.col("priority_status") == "High")))


def endangered(main: DataFrame) -> DataFrame:
    return candidates(main).filter(F.col("iucn").isin("Critically Endangered", "Endangered")).select(F.col("species").alias("common_name"))


def range_share(obs: DataFrame, main: DataFrame, latest: int, cell: str = "gridg1") -> DataFrame:
    """M11. Share of each candidate's recent cells in each state, with its rank in the state.

    Ties: known current trend, known long-term trend, smaller range, name.
    """
    spec = candidates(main).select(
        F.col("species").alias("common_name"), "current_status", "long_term_status", "range_status", "rangemean")
    base = obs.filter(F.col("year") > latest - 5).join(spec.select("common_name"), "common_name", "left_semi").select(*PAIR, cell).distinct()
    total = base.select("common_name", cell).distinct().groupBy("common_name").agg(F.count(F.lit(1)).alias("total"))
    own = base.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    j = own.join(total, "common_name").join(spec, "common_name")
    unknown = lambda c: F.coalesce(F.col(c).isin(UNCERTAIN), F.lit(False)).cast("int")
    j = j.select(*PAIR, (F.col("n") / F.col("total")).alias("share"), "current_status", unknown("current_status").alias("current_sort"),
                 "long_term_status", unknown("long_term_status").alias("long_term_sort"), "range_status", "rangemean")
    w = W.partitionBy("state").orderBy(
        F.col("share").desc(), "current_sort", "long_term_sort", F.col("rangemean").asc_nulls_last(), "common_name")
    return j.withColumn("place", F.row_number().over(w).cast("bigint"))


def _rank(*order) -> Column:
    return F.row_number().over(W.partitionBy("state").orderBy(*order))


def _first(df: DataFrame, n, *order) -> DataFrame:
    return df.withColumn("__rn", _rank(*order)).filter(F.col("__rn") <= n).drop("__rn")


def _quota(df: DataFrame, with_endangered: DataFrame, n: int) -> DataFrame:
    """Rows kept per state: one place less where an endangered species can take it."""
    q = with_endangered.select("state", F.lit(n - 1).alias("__q")).distinct()
    return df.join(q, "state", "left").withColumn("__q", F.coalesce("__q", F.lit(n)))


def _add_endangered(report: DataFrame, pool: DataFrame) -> DataFrame:
    top = _first(pool.join(report.select(*PAIR), PAIR, "left_anti"), 1, F.col("share").desc(), "place")
    return report.unionByName(top.select(*report.columns))


def key_species(share: DataFrame, threatened: DataFrame, n: int = 4) -> DataFrame:
    """M12. The n key species of each state: leading species by range share, one place for an endangered
    species where there is one, open places filled from species with trends."""
    cols = share.columns
    risky = share.join(threatened, "common_name", "left_semi")
    known = F.least("current_sort", "long_term_sort") == 0
    trends = share.filter(known)
    lead = _first(trends, 1, "place").withColumn("__src", F.lit(0)).unionByName(
        share.filter(~known).withColumn("__src", F.lit(1)))
    ranked = _quota(lead, risky, n).withColumn("__rn", _rank(F.col("share").desc(), "__src", "place"))
    report = _add_endangered(ranked.filter(F.col("__rn") <= F.col("__q")).select(*cols), risky)
    # states short of n take the trend species after the first
    short = report.groupBy("state").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < n)
    extra = trends.join(short, "state").withColumn("__rn", _rank(F.col("share").desc(), "place"))
    extra = extra.filter(F.col("__rn").between(2, n - F.col("__n") + 1)).select(*cols)
    both = report.withColumn("__src", F.lit(0)).unionByName(extra.withColumn("__src", F.lit(1)))
    report = _first(both, n, F.col("share").desc(), "__src", "place").select(*cols)
    # endangered species still outside the report get the last place
    outside = risky.join(report.select(*PAIR), PAIR, "left_anti")
    cut = _quota(report, outside, n).withColumn("__rn", _rank(F.col("share").desc(), "place"))
    return _add_endangered(cut.filter(F.col("__rn") <= F.col("__q")).select(*cols), outside)


def repeated(report: DataFrame, threatened: DataFrame, max_share: float = 0.35) -> DataFrame:
    """Species repeated across states of which some state holds a small share only."""
    return (
        report.join(threatened, "common_name", "left_anti").groupBy("common_name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("share").alias("p"))
        .filter((F.col("n") > 1) & (F.col("p") < max_share)).select("common_name")
    )


def one_round(report: DataFrame, share: DataFrame, repeats: DataFrame, i: int, n: int = 4) -> DataFrame:
    """M13, round i: drop each repeated species where its share is lowest, refill from further down."""
    cols = report.columns
    worst = (
        report.join(repeats, "common_name", "left_semi")
        .groupBy("common_name").agg(F.min_by("state", F.struct("share", "state")).alias("state"))
    )
    left = report.join(worst, PAIR, "left_anti")
    short = left.groupBy("state").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < n)
    pool = share.join(left.select(*PAIR), PAIR, "left_anti").join(short, "state")
    pool = pool.withColumn("__rn", _rank(F.col("share").desc(), "place"))
    extra = pool.filter(F.col("__rn").between(i, n - F.col("__n") + i - 1)).select(*cols)
    both = left.withColumn("__src", F.lit(0)).unionByName(extra.withColumn("__src", F.lit(1)))
    return _first(both, n, F.col("share").desc(), "__src", "place").select(*cols)


def reduce_repeats(report: DataFrame, share: DataFrame, threatened: DataFrame, rounds: int = 10, n: int = 4) -> DataFrame:
    """M13. At most ``rounds`` rounds, stopping when nothing repeats. The table has n rows per state;
    it is checkpointed each round and only an emptiness flag reaches the driver."""
    out = report
    for i in range(1, rounds + 1):
        repeats = repeated(out, threatened)
        if repeats.isEmpty():
            break
        out = cut_lineage(one_round(out, share, repeats, i, n))
    return out


def fill_and_swap(report: DataFrame, initial: DataFrame, share: DataFrame, n: int = 4,
                  swap_in: float = 0.05, swap_out: float = 0.08, low: float = 0.01) -> DataFrame:
    """M13, afterwards: backfill short states, give places of small shares back to initial species
    without trends, and offer replacements for very small shares."""
    cols = report.columns
    short = report.groupBy("state").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < n)
    pool = share.join(report.select(*PAIR), PAIR, "left_anti").join(short, "state").withColumn("__rn", _rank(F.col("share").desc(), "place"))
    out = report.unionByName(pool.filter(F.col("__rn") <= n - F.col("__n")).select(*cols))
    no_trend = F.col("current_status").isin(UNCERTAIN) & F.col("long_term_status").isin(UNCERTAIN)
    offered = initial.filter(no_trend).join(out.select(*PAIR), PAIR, "left_anti").filter(F.col("share") > swap_in)
    weakest = _first(out.filter(F.col("share") < swap_out).join(offered.select("state").distinct(), "state", "left_semi"), 1, "share", "place")
    swapped = _first(offered.join(weakest.select("state"), "state", "left_semi"), 1, "place")
    out = out.join(weakest.select(*PAIR), PAIR, "left_anti").unionByName(swapped.select(*cols))
    lows = out.filter(F.col("share") < low).groupBy("state").agg(F.count(F.lit(1)).alias("__n"))
    spare = initial.join(out.select(*PAIR), PAIR, "left_anti").join(lows, "state").withColumn("__rn", _rank(F.col("share").desc(), "place"))
    out = out.unionByName(spare.filter(F.col("__rn") <= F.col("__n")).select(*cols))
    return _first(out, n, F.col("share").desc(), "place")


def apply_overrides(report: DataFrame, share: DataFrame, add: DataFrame, drop: DataFrame) -> DataFrame:
    """M14. Hand-made removals and additions; an added species keeps its share where it has one."""
    kept = report.join(drop.select(*PAIR), PAIR, "left_anti").select(*PAIR, "share")
    new = add.select(*PAIR).join(share.select(*PAIR, "share"), PAIR, "left")
    return kept.unionByName(new).distinct()


def population_exceedance(obs: DataFrame, main: DataFrame, latest: int) -> DataFrame:
    """M15. (state, species) with one count of at least 1 % of the population; uncounted records drop out."""
    lim = candidates(main).filter("one_percent IS NOT NULL").select(F.col("species").alias("common_name"), "one_percent")
    return (
        obs.filter(F.col("year") > latest - 5).filter("obs_count <> 'X'").join(lim, "common_name")
        .filter(F.col("obs_count").try_cast("bigint") >= F.col("one_percent")).select(*PAIR).distinct()
    )


def key_species_full(share: DataFrame, exceeding: DataFrame, key: DataFrame, n: int = 20, min_share: float = 0.035) -> DataFrame:
    """M15. Key species, exceeding species, and further species by share up to n per state.

    The n places are the published report size. A state that already has n takes the leading rows only
    as far as the reference's descending slice does: none here, documented difference.
    """
    base = key.select(*PAIR).unionByName(exceeding.select(*PAIR)).distinct()
    have = base.join(share.select(*PAIR, "share"), PAIR, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    taken = base.groupBy("state").agg(F.count(F.lit(1)).alias("__n"))
    rest = share.select(*PAIR, "share", "place").join(base, PAIR, "left_anti").join(taken, "state", "left")
    rest = rest.withColumn("__rn", _rank(F.col("share").desc(), "place"))
    more = rest.filter((F.col("__rn") <= n - F.coalesce("__n", F.lit(0))) & (F.col("share") >= min_share))
    return have.unionByName(more.select(*PAIR, "share"))
