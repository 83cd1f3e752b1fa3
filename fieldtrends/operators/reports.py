"""Summaries of the species sheet and report tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldtrends.config import (
    BREAKUP_ORDER, DECLINE, DOWNLIST_ORDER, HABITAT_GROUPS, IUCN_ORDER, PAST_DECLINE, PAST_TREND_STATUSES,
    PAST_UNCERTAIN, PRIORITY_STATUSES, RANGE_STATUSES, REDLIST_STEPS, TREND_STATUS_REPORT_ORDER, TREND_STATUSES,
    UNCERTAIN, UPLIST_ORDER,
)
from fieldtrends.functions.nulls import strict_avg
from fieldtrends.functions.ranking import top_n


def label_rows(df: DataFrame, labels: Sequence[str], name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, l) for i, l in enumerate(labels, 1)], f"pos int, {name} string")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.bround(F.try_divide(part * F.lit(100.0), whole), digits)


def isin(col: Column, values: Sequence[str]) -> Column:
    """Membership in which NULL is simply not a member."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


# ------------------------------------------------------------------ tabulations
def qualification_summary(main: DataFrame, range_analysed: bool = True) -> DataFrame:
    """M01. Species per analysis and how many trends are conclusive."""
    one = main.agg(
        F.count_if(F.col("selected") == "X").alias("all"),
        F.count_if(F.col("long_term_analysis") == "X").alias("lt"),
        F.count_if(F.col("current_analysis") == "X").alias("ct"),
        F.count_if(F.col("range_status").isNotNull()).alias("rg"),
        F.count_if(F.col("long_term_status") == "Trend Inconclusive").alias("lt_inc"),
        F.count_if(F.col("current_status") == "Trend Inconclusive").alias("ct_inc"),
    )
    zero = F.lit(0).cast("bigint")
    row = lambda label, n, conclusive: F.struct(
        F.lit(label).alias("analysis"), n.alias("selected"), conclusive.alias("conclusive"))
    none = F.lit(None).cast("bigint")
    rows = F.array(
        row("Assessment", F.col("all"), none),
        row("Long-term Analysis", F.col("lt"), F.col("lt") - F.col("lt_inc")),
        row("Current Analysis", F.col("ct"), F.col("ct") - F.col("ct_inc")),
        row("Range Analysis", F.col("rg") if range_analysed else zero, none),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def trend_status_table(main: DataFrame) -> DataFrame:
    """M02. Species per trend status, with the share among conclusive trends.

    The denominator is the number of analysed species minus the inconclusive ones, as published.
    """
    def tally(col: str, name: str) -> DataFrame:
        return main.groupBy(F.col(col).alias("status")).agg(F.count(F.lit(1)).alias(name))

    q = main.agg(
        (F.count_if(F.col("long_term_analysis") == "X") - F.count_if(F.col("long_term_status") == "Trend Inconclusive")).alias("lt_all"),
        (F.count_if(F.col("current_analysis") == "X") - F.count_if(F.col("current_status") == "Trend Inconclusive")).alias("ct_all"),
    )
    # one summary row meets seven labels
    lab = label_rows(main, TREND_STATUS_REPORT_ORDER, "status")
    j = lab.join(tally("long_term_status", "long_term"), "status", "left").join(
        tally("current_status", "current"), "status", "left").withColumn("__one", F.lit(1))
    j = j.join(q.withColumn("__one", F.lit(1)), "__one")
    n = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("long_term", "current")}
    unc = F.col("status").isin(UNCERTAIN)
    return j.select(
        "pos", "status", n["long_term"].alias("long_term"), n["current"].alias("current"),
        F.when(~unc & (F.col("lt_all") != 0), percent(n["long_term"], F.col("lt_all"))).alias("long_term_perc"),
        F.when(~unc & (F.col("ct_all") != 0), percent(n["current"], F.col("ct_all"))).alias("current_perc"),
    )


def label_counts(main: DataFrame, col: str, labels: Sequence[str], fill_percent: bool = True) -> DataFrame:
    """M03, M04 and others. Counts per label, zero included, with the share of the labelled total."""
    n = main.groupBy(F.col(col).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    j = label_rows(main, labels, "status").join(n, "status", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    perc = percent(F.col("n"), F.sum("n").over(W.partitionBy()))
    return j.select("pos", "status", "n", *([perc.alias("perc")] if fill_percent else []))


def range_status_table(main: DataFrame) -> DataFrame:
    """M03."""
    return label_counts(main, "range_status", RANGE_STATUSES)


def priority_table(main: DataFrame) -> DataFrame:
    """M04."""
    return label_counts(main, "priority_status", PRIORITY_STATUSES, fill_percent=False)


# ------------------------------------------------------------------ comparison of two assessments
@dataclass(frozen=True)
class Vocabulary:
    """Status names of one assessment."""

    trends: tuple = tuple(TREND_STATUSES)
    decline: tuple = tuple(DECLINE)
    uncertain: tuple = tuple(UNCERTAIN)
    strong: str = "Rapid Decline"
    stable: str = "Stable"
    mild_up: str = "Increase"
    up: tuple = field(default=("Increase", "Rapid Increase"))
    top: str = "Rapid Increase"

    def conclusive(self, without: Sequence[str] = ()) -> list[str]:
        return [t for t in self.trends if t not in self.uncertain and t not in without]


PAST_WORDS = Vocabulary(tuple(PAST_TREND_STATUSES), tuple(PAST_DECLINE), tuple(PAST_UNCERTAIN), "Strong Decline",
                        "Stable", "Moderate Increase", ("Moderate Increase", "Strong Increase"), "Strong Increase")
WORDS = Vocabulary()


def status_cols(prefix: str) -> dict[str, Column]:
    p = f"{prefix}_" if prefix else ""
    return {k: F.col(f"{p}{c}") for k, c in (
        ("lt", "long_term_status"), ("ct", "current_status"), ("rg", "range_status"), ("pr", "priority_status"))}


def breakup_reason(new: dict, old: dict, words: Vocabulary) -> Column:
    known_now = ~isin(new["lt"], UNCERTAIN) | ~isin(new["ct"], UNCERTAIN)
    unknown_then = (isin(old["lt"], words.uncertain) | old["lt"].isNull()
                    | isin(old["ct"], words.uncertain) | old["ct"].isNull())
    return (F.when(known_now & unknown_then, "Trend New").when(known_now, "Trend Different")
            .when(new["rg"] == "Very Restricted", "Range").otherwise("IUCN"))


def priority_breakup(main: DataFrame, latest: str = "", prior: str = "past", words: Vocabulary = PAST_WORDS) -> DataFrame:
    """M05. Why species are High priority: all of them, and those new since the prior assessment."""
    new, old = status_cols(latest), status_cols(prior)
    rows = main.filter(new["pr"] == "High").select(
        breakup_reason(new, old, words).alias("reason"),
        (old["pr"].isNull() | (old["pr"] != "High")).cast("int").alias("is_new"))
    g = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("is_new").alias("n_new"))
    w = W.partitionBy()
    n_new = F.when(F.col("n_new") > 0, F.col("n_new"))
    return label_rows(main, BREAKUP_ORDER, "reason").join(g, "reason").select(
        "pos", "reason", "n", percent(F.col("n"), F.sum("n").over(w)).alias("perc"),
        n_new.alias("n_new"), percent(n_new, F.sum("n_new").over(w)).alias("perc_new"))


def transition_matrix(main: DataFrame, a: str, b: str) -> DataFrame:
    """M06. Species per pair of statuses, with the share within the first."""
    g = main.filter(F.col(a).isNotNull() & (F.col(a) != "")).groupBy(
        F.col(a).alias("from_status"), F.col(b).alias("to_status")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("perc", percent(F.col("n"), F.sum("n").over(W.partitionBy("from_status"))))


def status_crosstab(main: DataFrame, row: str = "iucn", col: str = "priority_status", cols: Sequence[str] = tuple(PRIORITY_STATUSES),
                    rows: Sequence[str] = tuple(IUCN_ORDER)) -> DataFrame:
    """M07. Cross-tab with margins, row percentages and column percentages in one aggregate (rollup)."""
    kept = main.filter("selected = 'X'").filter(F.col(col).isin(list(cols))).withColumn(
        "__r", F.when(F.col(row).isin(list(rows)), F.col(row)).otherwise(F.lit("(other)")))
    g = kept.rollup("__r").agg(
        *[F.count_if(F.col(col) == c).alias(c.lower()) for c in cols], F.count(F.lit(1)).alias("total"),
        F.grouping("__r").alias("__all"))
    names = [c.lower() for c in cols]
    w = W.partitionBy()
    whole = {n: F.sum(F.when(F.col("__all") == 1, F.col(n))).over(w) for n in names}
    return g.select(
        F.when(F.col("__all") == 1, "Sum").otherwise(F.col("__r")).alias("category"), *names, "total",
        *[percent(F.col(n), F.col("total")).alias(f"{n}_row_perc") for n in names],
        *[percent(F.col(n), whole[n]).alias(f"{n}_col_perc") for n in names])


def _first_time(new, old, words):
    known_now = ~isin(new["lt"], UNCERTAIN) | ~isin(new["ct"], UNCERTAIN)
    known_then = ~isin(old["lt"], words.uncertain) | ~isin(old["ct"], words.uncertain)
    return known_now, known_then


def _reasons(new, old, words, first, second, ranges) -> Column:
    known_now, known_then = _first_time(new, old, words)
    out = (
        F.when(known_now & ~known_then, "First-time trend")
        .when(first[1], first[0]).when(second[1], second[0])
        .when(isin(old["lt"], words.uncertain) & ~isin(new["lt"], UNCERTAIN), "First-time LTT")
        .when(isin(old["ct"], words.uncertain) & ~isin(new["ct"], UNCERTAIN), "First-time CAT")
        .when(known_then & known_now, "Other changes in trends").when(known_then & ~known_now, "Loss of trends")
    )
    shift = F.lit(False)
    for o, n in ranges[1]:
        shift = shift | (isin(old["rg"], [o]) & isin(new["rg"], [n]))
    return out.when(shift, ranges[0]).otherwise("Others")


def _reason_table(main: DataFrame, chosen: DataFrame, labels: Sequence[str]) -> DataFrame:
    return label_counts(chosen, "reason", labels).select(
        "pos", F.col("status").alias("reason"), "n", F.coalesce("perc", F.lit(0.0)).alias("perc"))


def uplist_reasons(main: DataFrame, latest: str = "", prior: str = "past", words: Vocabulary = PAST_WORDS) -> DataFrame:
    """M08. Why species rose to High priority."""
    new, old = status_cols(latest), status_cols(prior)

    def worse(k: str) -> Column:
        return ((isin(new[k], [WORDS.strong]) & isin(old[k], words.conclusive([words.strong])))
                | (isin(new[k], DECLINE) & isin(old[k], words.conclusive(words.decline))))

    smaller = ("Reducing range", [("Restricted", "Very Restricted"), ("Moderate", "Restricted"), ("Large", "Moderate")])
    reason = _reasons(new, old, words, ("More decline in LTT", worse("lt")), ("More decline in CAT", worse("ct")), smaller)
    chosen = main.filter(old["pr"].isin("Low", "Moderate") & (new["pr"] == "High")).select(reason.alias("reason"))
    return _reason_table(main, chosen, UPLIST_ORDER)


def downlist_reasons(main: DataFrame, latest: str = "", prior: str = "past", words: Vocabulary = PAST_WORDS) -> DataFrame:
    """M09. Why species left High priority."""
    new, old = status_cols(latest), status_cols(prior)

    def better(k: str) -> Column:
        return ((isin(old[k], [words.strong]) & isin(new[k], WORDS.conclusive([WORDS.strong])))
                | (isin(old[k], words.decline) & isin(new[k], WORDS.conclusive(DECLINE)))
                | (isin(old[k], [*words.decline, words.stable]) & isin(new[k], WORDS.up))
                | (isin(old[k], [*words.decline, words.stable, words.mild_up]) & isin(new[k], [WORDS.top])))

    larger = ("Increasing range", [("Very Restricted", "Restricted"), ("Restricted", "Moderate"), ("Moderate", "Large"), ("Large", "Very Large")])
    reason = _reasons(new, old, words, ("Less decline in LTT", better("lt")), ("Less decline in CAT", better("ct")), larger)
    chosen = main.filter(new["pr"].isin("Low", "Moderate") & (old["pr"] == "High")).select(reason.alias("reason"))
    return _reason_table(main, chosen, DOWNLIST_ORDER)


# ------------------------------------------------------------------ red list
def redlist_category(decline: Column) -> Column:
    out = F.lit(None).cast("string")
    for limit, name in reversed(REDLIST_STEPS):
        out = F.when(decline > limit, name).otherwise(out)
    return out


def redlist(main: DataFrame, generations: DataFrame, projections: DataFrame, first_year: int, last_year: int, min_cover: float = 8.0) -> DataFrame:
    """M10. Threat category from the decline over three generations.

    ``generations`` (species, gen); ``projections`` (species, year, rci) in long form, so the column
    "of the year that fits the generation length" becomes an equi-join.
    """
    limit = 2 * (last_year - first_year) + 100
    width = F.abs(F.col("currentsloperci") - F.col("currentslopelci"))
    decliners = main.filter(
        (F.col("current_analysis") == "X") & (F.col("currentsloperci") < 0) & (F.col("mean5km") > min_cover)
        & (1.96 * F.abs("currentslopemean") > width)
        & F.col("current_status").isin("Stable", "Decline", "Rapid Decline"))
    g = generations.filter(F.col("gen") <= limit).select("species", F.greatest("gen", F.lit(10)).alias("gen"))
    d = decliners.drop("gen").join(g, "species")
    slope = F.round(100 * (1 - F.pow(1 + F.col("currentsloperci") / 100, F.col("gen"))), 0)
    d = d.withColumns({"decline": slope, "year": F.lit(first_year) + F.col("gen")})
    d = d.join(projections.select("species", "year", F.floor("rci").cast("bigint").alias("projected_decline")), ["species", "year"], "left")
    d = d.withColumns({"category": redlist_category(F.col("decline")), "category_projected": redlist_category(F.col("projected_decline"))})
    yes = lambda a, b: F.when(F.col(a) == F.col(b), "No").when(F.col(a) != F.col(b), "Yes")
    return d.select(
        "species", "gen", F.bround(100 * F.col("share_recent"), 2).alias("range_coverage"),
        F.bround(100 * F.col("mean5km") / 25, 2).alias("cell_coverage"), "current_status", "priority_status",
        F.col("decline").cast("bigint").alias("decline"), "category", "iucn", yes("category", "iucn").alias("differs"),
        "projected_decline", "category_projected", yes("category", "category_projected").alias("projection_differs"))


# ------------------------------------------------------------------ lists, contributors, composites
def list_by_group(df: DataFrame, key: str | Sequence[str], value: str, name: str = "items", sep: str = ", ") -> DataFrame:
    """M16. Sorted text list per group. The list is the result, so a group must be a report-sized set."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(name))


def contributors(
    obs: DataFrame, users: DataFrame, accounts: DataFrame, banned_names: Sequence[str] = (), cell_lists: int = 10,
    min_cells: int = 1, min_lists: int = 100, hist_year: int = 2000, hist_lists: int = 10, cell: str = "gridg1",
) -> DataFrame:
    """M17. Contributors by well-covered cells, by lists, or by historical lists; group accounts excluded.

    Checklists are reduced to distinct (observer, cell, list, historical) once, then counted.
    """
    named = users.select("observer_id", "full_name")
    banned = named.filter(F.col("full_name").isin(list(banned_names))).select("observer_id")
    base = (
        obs.select("observer_id", cell, "group_id", (F.col("year") <= hist_year).alias("hist")).distinct()
        .join(accounts.select("observer_id"), "observer_id", "left_anti").join(banned, "observer_id", "left_anti")
    )
    cells = (
        base.groupBy("observer_id", cell).agg(F.count_distinct("group_id").alias("n")).filter(F.col("n") >= cell_lists)
        .groupBy("observer_id").agg(F.count(F.lit(1)).alias("no_cells")).filter(F.col("no_cells") >= min_cells)
    )
    tot = base.groupBy("observer_id").agg(F.count_distinct("group_id").alias("tot_lists")).filter(F.col("tot_lists") >= min_lists)
    hist = (
        base.filter("hist").groupBy("observer_id").agg(F.count_distinct("group_id").alias("hist_lists"))
        .filter(F.col("hist_lists") >= hist_lists)
    )
    overall = cells.join(tot, "observer_id", "full").withColumn("by_total", F.lit("Total lists and cells"))
    hist = hist.withColumn("by_history", F.lit("Historical lists"))
    return overall.join(hist, "observer_id", "full").join(named, "observer_id", "left").select(
        "observer_id", "full_name", "no_cells", "hist_lists", "tot_lists", "by_total", "by_history")


def members(groups: DataFrame, key: str = "grp", names: str = "names", sep: str = ", ") -> DataFrame:
    """Comma-separated species lists to one row per (group, species)."""
    return groups.select(key, F.explode(F.split(names, sep)).alias("common_name"))


def composite_trends(series: DataFrame, group_members: DataFrame, key: str = "grp") -> DataFrame:
    """M18. Mean standardised series of species groups; one missing species value makes the mean NULL."""
    j = group_members.join(series, "common_name")
    cols = [c for c in ("lci_std", "mean_std", "rci_std") if c in series.columns]
    return j.groupBy(key, "year", "timegroup").agg(*[strict_avg(F.col(c)).alias(c) for c in cols])


def composite_summary(main: DataFrame, group_members: DataFrame, key: str = "grp") -> DataFrame:
    """M19. Species per composite group and priority, with their names."""
    m = main.select(F.col("species").alias("common_name"), "checklist_name", "priority_status")
    short = F.when(F.col("priority_status") == "Moderate", "MOD").otherwise(F.upper("priority_status"))
    j = group_members.join(m, "common_name").withColumn("priority", short)
    return j.groupBy(key, "priority").agg(
        F.count_distinct("checklist_name").alias("no_species"),
        F.array_join(F.array_sort(F.collect_set("checklist_name")), ", ").alias("species_list"))


def display_series(
    main: DataFrame, trends: DataFrame, kind: str, latest: int, recent_start: int, single: bool = True,
    mask_of: DataFrame | None = None,
) -> DataFrame:
    """M20. Series shown for one trend type: qualified species, up to the latest year.

    With ``mask_of`` (the country's main table) a composite keeps species qualified in both.
    """
    hide = ["Insufficient Data"] if single else UNCERTAIN
    status, mark = ("long_term_status", "long_term_analysis") if kind == "LTT" else ("current_status", "current_analysis")

    def qualified(df: DataFrame) -> DataFrame:
        return df.filter(~isin(F.col(status), hide) & (F.col(mark) == "X")).select(F.col("species").alias("common_name"))

    keep = qualified(main) if mask_of is None else qualified(main).intersect(qualified(mask_of))
    years = F.col("year") <= latest
    if kind != "LTT":
        years = years & (F.col("year") >= recent_start)
    return trends.filter(years).join(keep, "common_name", "left_semi")


def _both_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two runs side by side. Both are whole tables, and the estimated size of exploded series is far too small,
    so the join is asked to merge: neither run is sent through the driver."""
    return old.alias("o").join(new.alias("n").hint("merge"), ["common_name", "year"])


def compare_runs(old: DataFrame, new: DataFrame, baseline_year: int) -> DataFrame:
    """M21. Per species: difference of two runs of standardised series.

    Species whose series does not reach back to the baseline year are compared on the recent series.
    """
    cols = ["lci", "mean", "rci"]
    both = _both_runs(old, new)
    has = F.bool_or(F.col("year") == baseline_year).over(W.partitionBy("common_name"))
    both = both.filter(F.col("o.mean").isNotNull() & F.col("n.mean").isNotNull()).withColumn("__long", has)
    used = {f"{c}_{r}": F.when(F.col("__long"), F.col(f"{r}.{c}_std")).otherwise(F.col(f"{r}.{c}_std_recent"))
            for c in cols for r in ("o", "n")}
    u = both.select("common_name", "year", *[v.alias(k) for k, v in used.items()])
    mo, mn = F.col("mean_o"), F.col("mean_n")
    both_known = mo.isNotNull() & mn.isNotNull()
    o, n = F.when(both_known, mo), F.when(both_known, mn)  # a constant series has no correlation
    width = lambda r: F.avg(F.col(f"rci_{r}") - F.col(f"lci_{r}"))
    return u.groupBy("common_name").agg(
        F.count(F.lit(1)).alias("n_points"), F.avg(F.abs(mo - 100) + F.abs(mn - 100)).alias("mean_diff"),
        (100 * F.avg(F.try_divide(mn - mo, mo))).alias("mean_pct_diff"),
        F.try_divide(F.covar_samp(o, n), F.stddev_samp(o) * F.stddev_samp(n)).alias("corr_means"),
        F.avg(F.col("lci_n") - F.col("lci_o")).alias("lci_range_diff"), F.avg(F.col("rci_n") - F.col("rci_o")).alias("rci_range_diff"),
        width("o").alias("mean_width_old"), width("n").alias("mean_width_new"),
    ).withColumn("width_ratio", F.try_divide("mean_width_new", "mean_width_old"))


def yearly_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """M21 by year: mean and spread of the percentage difference over species."""
    j = _both_runs(old, new)
    diff = 100 * F.try_divide(F.col("n.mean_std") - F.col("o.mean_std"), F.col("o.mean_std"))
    return j.select("year", diff.alias("d")).groupBy("year").agg(
        F.avg("d").alias("mean_pct_diff"), F.stddev_samp("d").alias("sd_pct_diff"), F.count("d").alias("n"))


def extreme_changes(summary: DataFrame, n: int = 10, largest: bool = True) -> DataFrame:
    """M21. Species with the largest or smallest absolute change (top-k sort, no full sort)."""
    size = F.abs("mean_pct_diff")
    order = size.desc_nulls_last() if largest else size.asc_nulls_first()
    return summary.orderBy(order, "common_name").limit(n)


# ------------------------------------------------------------------ download, dictionary, publication
ESTIMATES = ["longtermlci", "longtermmean", "longtermrci", "currentslopelci", "currentslopemean", "currentsloperci",
             "rangelci", "rangemean", "rangerci"]


def download_table(main: DataFrame, registry: DataFrame, key_species: DataFrame) -> DataFrame:
    """M22. All masks in one table: logical marks, rounded estimates, key flag for states, labels.

    Sub-national rows without a national priority are not part of the mask; priority is the national one.
    """
    nat = main.filter("mask = 'none'").select("species", F.col("priority_status").alias("__nat")).distinct()
    key = key_species.select(F.col("state").alias("label"), "species", F.lit(True).alias("__key")).distinct()
    j = main.join(nat, "species", "left").join(registry.select("mask", "mask_type", "label", "ord"), "mask")
    j = j.filter((F.col("mask") == "none") | F.col("priority_status").isNotNull()).join(key, ["label", "species"], "left")
    flags = ("selected", "long_term_analysis", "current_analysis")
    return j.withColumns({
        **{c: F.coalesce(F.col(c) == "X", F.lit(False)) for c in flags},
        **{c: F.bround(c, 1) for c in ESTIMATES},
        "share_recent": F.bround(100 * F.col("share_recent"), 0), "mean5km": F.bround("mean5km", 0), "ci5km": F.bround("ci5km", 0),
        "restricted_islands": F.coalesce(F.col("restricted_islands") == 1, F.lit(False)),
        "is_key": F.when(F.col("mask_type") == "state", F.coalesce("__key", F.lit(False))),
        "priority_status": F.col("__nat"),
    }).drop("__nat", "__key")


def null_columns(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """M22. Columns without any value per mask: (mask, column), from one aggregate over all columns."""
    counts = df.groupBy(by).agg(*[F.count(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])
    return counts.select(by, F.explode(pairs).alias("p")).filter("p.n = 0").select(by, "p.column")


def data_dictionary(df: DataFrame, columns: Sequence[str], national: Column) -> DataFrame:
    """M23. Type, smallest and largest value and "national rows only" per column, in one pass."""
    types = dict(df.dtypes)
    aggs = []
    for c in columns:
        aggs.append(F.struct(
            F.lit(c).alias("field"), F.lit(types[c]).alias("type"), F.min(F.col(c)).cast("string").alias("min_value"),
            F.max(F.col(c)).cast("string").alias("max_value"),
            (F.count(F.when(~national, F.col(c))) == 0).alias("national_only")).alias(f"__{c}"))
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"`__{c}`") for c in columns])).alias("r")).select("r.*")


def interval_text(low: Column, high: Column, digits: int = 2) -> Column:
    fmt = f"(%.{digits}f, %.{digits}f)"
    return F.when(low.isNotNull() & high.isNotNull(), F.format_string(fmt, F.round(low, digits), F.round(high, digits)))


def publication_rows(main: DataFrame, registry: DataFrame, key_states: DataFrame) -> DataFrame:
    """M24. One row per (species, mask): interval texts, slug, national values repeated, mask lists per
    mask type, blanks for missing values."""
    reg = registry.select("mask", F.when(F.col("mask_type") == "country", "national").otherwise(F.col("mask_type")).alias("mask_type"),
                          "label", "code")
    df = main.filter("selected = 'X'").join(reg, "mask")
    has_trend = F.col("longtermmean").isNotNull() | F.col("currentslopemean").isNotNull()
    df = df.withColumns({
        "long_term_ci": interval_text(F.col("longtermlci"), F.col("longtermrci")),
        "current_ci": interval_text(F.col("currentslopelci"), F.col("currentsloperci")),
        "slug": F.regexp_replace(F.regexp_replace(F.lower("checklist_name"), " ", "-"), "'", "_"),
        "new_here": F.col("past_priority_status").isNull() & F.col("priority_status").isNotNull(),
        "only_estimated": F.when((F.col("long_term_status") == "Insufficient Data") & (F.col("current_status") == "Insufficient Data"), "No").otherwise("Yes"),
    })
    df = df.withColumn("entry", F.concat_ws("-", "code", F.when(has_trend, "est").otherwise("not"), "slug"))
    lists = df.groupBy("species").agg(*[
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("mask_type") == t, F.col("entry")))), ",").alias(f"{t}_masks")
        for t in ("national", "habitat", "conservation_area", "state")])
    nat = df.filter("mask_type = 'national'").select(
        "species", F.col("long_term_ci").alias("long_term_ci_in"), F.col("current_ci").alias("current_ci_in"), F.col("habitat").alias("habitat_in"))
    out = df.join(lists, "species").join(nat, "species", "left").join(key_states, "species", "left")
    text = ["long_term_ci", "current_ci", "long_term_ci_in", "current_ci_in", "habitat_in", "key_states", "priority_status"]
    return out.select(
        "species", "mask", "label", "slug", *[F.coalesce(c, F.lit("")).alias(c) for c in text],
        "national_masks", "habitat_masks", "conservation_area_masks", "state_masks", "only_estimated", "new_here",
        F.when(F.col("mask_type") == "national", F.col("national_masks")).otherwise(F.concat_ws("-", "code", "slug")).alias("url"))


# ------------------------------------------------------------------ state summary
def species_per_state(obs: DataFrame) -> DataFrame:
    """M25."""
    return obs.filter(F.col("category").isin("species", "issf")).groupBy("state").agg(F.count_distinct("common_name").alias("n_species"))


def key_districts(obs: DataFrame, key_species: DataFrame, latest: int, min_lists: int = 20, n: int = 2) -> DataFrame:
    """M25. Districts in which the key species of a state are reported most often."""
    pool = obs.filter((F.col("all_species_reported") == 1) & F.col("district").isNotNull() & (F.col("year") > latest - 5))
    lists = pool.groupBy("state", "district").agg(F.count_distinct("group_id").alias("lists")).filter(F.col("lists") > min_lists)
    own = pool.join(key_species.select("state", "common_name").distinct(), ["state", "common_name"], "left_semi")
    seen = own.groupBy("state", "common_name", "district").agg(F.count_distinct("group_id").alias("k"))
    freq = seen.join(lists, ["state", "district"]).withColumn("freq", F.col("k") / F.col("lists"))
    return top_n(freq, ["state", "common_name"], [F.col("freq").desc(), F.col("district")], n).select("state", "common_name", "district", "freq")


def habitat_group(col: str = "habitat") -> Column:
    out = F.col(col)
    for name, group in HABITAT_GROUPS.items():
        out = F.when(F.col(col) == name, group).otherwise(out)
    return out


def key_habitats(key_species: DataFrame, main: DataFrame, n: int = 4) -> DataFrame:
    """M25. Per state and habitat the number of key species and their leading members; species confined
    to the state always stay."""
    h = main.select(F.col("species").alias("common_name"), habitat_group().alias("habitat"))
    j = key_species.select("state", "common_name", "share").join(h, "common_name").filter(
        F.col("habitat").isNull() | (F.col("habitat") != "Non-specialized"))
    w = W.partitionBy("state", "habitat")
    j = j.withColumn("n", F.count(F.lit(1)).over(w)).withColumn(
        "rn", F.row_number().over(w.orderBy(F.col("share").desc(), "common_name")))
    return j.filter((F.col("rn") <= n) | (F.col("share") == 1)).select("state", "habitat", "common_name", "share", "n")


def priority_districts(obs: DataFrame, main: DataFrame, n: int = 3) -> DataFrame:
    """M25. Districts with most high-priority species."""
    high = main.filter("priority_status = 'High'").select(F.col("species").alias("common_name"))
    g = obs.filter("district IS NOT NULL").join(high, "common_name", "left_semi").select("state", "district", "common_name").distinct().groupBy(
        "state", "district").agg(F.count(F.lit(1)).alias("n_high"))
    return top_n(g, ["state"], [F.col("n_high").desc(), F.col("district")], n)


def low_effort_districts(districts: DataFrame, obs: DataFrame, n: int = 3) -> DataFrame:
    """M25. Districts with fewest complete checklists, including those with none."""
    g = obs.filter("all_species_reported = 1 AND district IS NOT NULL").groupBy("state", "district").agg(F.count_distinct("group_id").alias("n_lists"))
    j = districts.select("state", "district").distinct().join(g, ["state", "district"], "left").withColumn(
        "n_lists", F.coalesce("n_lists", F.lit(0)).cast("bigint"))
    return top_n(j, ["state"], ["n_lists", "district"], n)


def state_trend_summary(state_main: DataFrame, national: DataFrame, min_species: int = 150) -> DataFrame:
    """M25. Status table per state; states with few analysed species show the national statuses."""
    enough = state_main.groupBy("state").agg(
        (F.count_if((F.col("long_term_analysis") == "X") | (F.col("current_analysis") == "X")) >= min_species).alias("own"))
    nat = national.select("species", F.col("long_term_status").alias("__l"), F.col("current_status").alias("__c"))
    j = state_main.filter("selected = 'X'").join(enough, "state").join(nat, "species", "left")
    pick = lambda own, other: F.when(F.col("own"), F.col(own)).otherwise(F.col(other))
    two = F.array(F.struct(F.lit("long_term").alias("kind"), pick("long_term_status", "__l").alias("status")),
                  F.struct(F.lit("current").alias("kind"), pick("current_status", "__c").alias("status")))
    r = j.select("state", "own", F.explode(two).alias("t")).select("state", "own", "t.*").filter("status IS NOT NULL")
    level = F.when(F.col("own"), "state level").otherwise("country level")
    return r.groupBy("state", level.alias("level"), "status").agg(
        F.count_if(F.col("kind") == "long_term").alias("long_term"), F.count_if(F.col("kind") == "current").alias("current"))


# ------------------------------------------------------------------ growth, case series
def growth(a: DataFrame, b: DataFrame, key: str = "year", value: str = "lists") -> DataFrame:
    """M26. Data of a later release as a percentage of an earlier one, per period."""
    j = a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")), key)
    return j.withColumn("ratio", F.bround(100.0 * (F.col("after") - F.col("before")) / F.col("before"), 0) + 100)


def case_series(df: DataFrame, max_over: float = 0.3, max_ratio: float = 2.0) -> DataFrame:
    """M27. Series with usable intervals, marks of the years to show (the later of consecutive years),
    and the species' place by its final value."""
    wide = ((F.col("rci_std") - F.col("mean_std")) > max_over) & (F.try_divide("rci_std", "mean_std") > max_ratio)
    kept = df.filter(F.col("mean_std").isNotNull() & ~F.coalesce(wide, F.lit(False)))
    w = W.partitionBy("common_name")
    nxt = F.lead("year").over(w.orderBy("year"))
    kept = kept.withColumns({
        "shown": F.coalesce(nxt - F.col("year") >= 2, F.lit(True)),
        "__last": F.col("year") == F.max("year").over(w),
    })
    final = kept.filter("__last").select("common_name", F.col("mean_std").alias("final_value"))
    # one row per species of a case study: the overall rank is over a report-sized table
    place = final.withColumn("place", F.row_number().over(W.orderBy(F.col("final_value").desc(), "common_name")).cast("bigint"))
    return kept.drop("__last").join(place, "common_name")
