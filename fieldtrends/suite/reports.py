"""Summaries and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrends.operators import reports as r
from fieldtrends.plans import frequency as fq
from fieldtrends.operators import resolve as v
from fieldtrends.sources import adapters as A, masks
from fieldtrends.suite import tables as S
from fieldtrends.suite.registry import query
from fieldtrends.suite.resolution import COMB, LONG
from fieldtrends.suite.trend import RAWS

M = S.with_(S.MAIN)
UNC = "('Insufficient Data', 'Trend Inconclusive')"
OLDUNC = "('Data Deficient', 'Uncertain')"


@query("m01_qualification_summary", M + """
  SELECT 'Assessment' AS analysis, count(*) FILTER (WHERE selected = 'X') AS selected, NULL::BIGINT AS conclusive FROM main
  UNION ALL SELECT 'Long-term Analysis', count(*) FILTER (WHERE long_term_analysis = 'X'), count(*) FILTER (WHERE long_term_analysis = 'X')
    - count(*) FILTER (WHERE long_term_status = 'Trend Inconclusive') FROM main
  UNION ALL SELECT 'Current Analysis', count(*) FILTER (WHERE current_analysis = 'X'), count(*) FILTER (WHERE current_analysis = 'X')
    - count(*) FILTER (WHERE current_status = 'Trend Inconclusive') FROM main
  UNION ALL SELECT 'Range Analysis', count(range_status), NULL FROM main""")
def m01(spark, d):
    return r.qualification_summary(A.classified(spark, d))


LABELS = "lab AS (SELECT * FROM (VALUES (1,'Rapid Decline'),(2,'Decline'),(3,'Stable'),(4,'Increase'),(5,'Rapid Increase'),(6,'Trend Inconclusive'),(7,'Insufficient Data')) t(pos, status))"


@query("m02_trend_status_table", S.with_(S.MAIN, LABELS) + f"""
  SELECT pos, status, l AS long_term, c AS current, CASE WHEN status NOT IN {UNC} THEN round_even(100.0::DOUBLE * l / la, 1) END AS long_term_perc,
    CASE WHEN status NOT IN {UNC} THEN round_even(100.0::DOUBLE * c / ca, 1) END AS current_perc FROM (
    SELECT pos, status, (SELECT count(*) FROM main WHERE long_term_status = status) AS l, (SELECT count(*) FROM main WHERE current_status = status) AS c FROM lab),
    (SELECT count(*) FILTER (WHERE long_term_analysis = 'X') - count(*) FILTER (WHERE long_term_status = 'Trend Inconclusive') AS la,
      count(*) FILTER (WHERE current_analysis = 'X') - count(*) FILTER (WHERE current_status = 'Trend Inconclusive') AS ca FROM main)""")
def m02(spark, d):
    return r.trend_status_table(A.classified(spark, d))


@query("m03_range_status_table", M + """
  SELECT pos, status, n, round_even(100.0::DOUBLE * n / sum(n) OVER (), 1) AS perc FROM (SELECT pos, status, (SELECT count(*) FROM main WHERE range_status = status) AS n
    FROM (VALUES (1,'Historical'),(2,'Very Restricted'),(3,'Restricted'),(4,'Moderate'),(5,'Large'),(6,'Very Large')) t(pos, status))""")
def m03(spark, d):
    return r.range_status_table(A.classified(spark, d))


@query("m04_priority_table", M + """
  SELECT pos, status, (SELECT count(*) FROM main WHERE priority_status = status) AS n FROM (VALUES (1,'High'),(2,'Moderate'),(3,'Low')) t(pos, status)""")
def m04(spark, d):
    return r.priority_table(A.classified(spark, d))


def breakup_sql(new, old, unc):
    n = f"{new}_" if new else ""
    return f"""
  SELECT pos, reason, n, round_even(100.0::DOUBLE * n / sum(n) OVER (), 1) AS perc, n_new, round_even(100.0::DOUBLE * n_new / sum(n_new) OVER (), 1) AS perc_new FROM (
    SELECT reason, count(*) AS n, CASE WHEN count(*) FILTER (WHERE is_new) > 0 THEN count(*) FILTER (WHERE is_new) END AS n_new FROM (SELECT
      {old}_priority_status IS DISTINCT FROM 'High' AS is_new,
      CASE WHEN kn AND (coalesce({old}_long_term_status, 'Uncertain') IN {unc} OR {old}_long_term_status IS NULL OR coalesce({old}_current_status, '') IN {unc} OR {old}_current_status IS NULL) THEN 'Trend New'
        WHEN kn THEN 'Trend Different' WHEN {n}range_status = 'Very Restricted' THEN 'Range' ELSE 'IUCN' END AS reason
      FROM (SELECT *, coalesce({n}long_term_status, '') NOT IN {UNC} OR coalesce({n}current_status, '') NOT IN {UNC} AS kn FROM main) WHERE {n}priority_status = 'High') GROUP BY reason)
    JOIN (VALUES (1,'Trend New'),(2,'Trend Different'),(3,'Range'),(4,'IUCN')) t(pos, reason) USING (reason)"""


@query("m05_priority_breakup", M + breakup_sql("", "past", OLDUNC))
def m05(spark, d):
    return r.priority_breakup(A.classified(spark, d))


@query("m05_priority_breakup_annual", M + breakup_sql("", "major", UNC))
def m05b(spark, d):
    return r.priority_breakup(A.classified(spark, d), prior="major", words=r.WORDS)


@query("m05_priority_breakup_major", M + breakup_sql("major", "past", OLDUNC))
def m05c(spark, d):
    return r.priority_breakup(A.classified(spark, d), "major")


@query("m06_transition_matrix", M + """
  SELECT past_priority_status AS from_status, priority_status AS to_status, count(*) AS n,
    round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY past_priority_status), 1) AS perc FROM main WHERE past_priority_status IS NOT NULL GROUP BY 1, 2""")
def m06(spark, d):
    return r.transition_matrix(A.classified(spark, d), "past_priority_status", "priority_status")


@query("m06_transition_matrix_back", M + """
  SELECT priority_status AS from_status, past_priority_status AS to_status, count(*) AS n,
    round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY priority_status), 1) AS perc FROM main WHERE priority_status IS NOT NULL GROUP BY 1, 2""")
def m06b(spark, d):
    return r.transition_matrix(A.classified(spark, d), "priority_status", "past_priority_status")


CROSS = ", ".join([f"round_even(100.0::DOUBLE * {c} / total, 1) AS {c}_row_perc" for c in ("high", "moderate", "low")]
                  + [f"round_even(100.0::DOUBLE * {c} / (SELECT {c} FROM x WHERE category = 'Sum'), 1) AS {c}_col_perc" for c in ("high", "moderate", "low")])


@query("m07_status_crosstab", M + f""", kept AS (SELECT priority_status, CASE WHEN iucn = 'Extinct' THEN '(other)' ELSE iucn END AS category FROM main
    WHERE selected = 'X' AND priority_status IS NOT NULL),
  x AS (SELECT category, count(*) FILTER (WHERE priority_status = 'High') AS high, count(*) FILTER (WHERE priority_status = 'Moderate') AS moderate,
      count(*) FILTER (WHERE priority_status = 'Low') AS low, count(*) AS total FROM kept GROUP BY category
    UNION ALL SELECT 'Sum', count(*) FILTER (WHERE priority_status = 'High'), count(*) FILTER (WHERE priority_status = 'Moderate'), count(*) FILTER (WHERE priority_status = 'Low'), count(*) FROM kept)
  SELECT *, {CROSS} FROM x""")
def m07(spark, d):
    return r.status_crosstab(A.classified(spark, d))


def reason_sql(rank, where, worse, shifts, labels, shift_label):
    """Reasons against the past assessment (old status words)."""
    vals = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels, 1))
    sh = " OR ".join(f"(past_range_status = '{a}' AND range_status = '{b}')" for a, b in shifts)
    return f"""
  , b AS (SELECT *, coalesce(long_term_status, '') NOT IN {UNC} OR coalesce(current_status, '') NOT IN {UNC} AS now_,
      coalesce(past_long_term_status, '') NOT IN {OLDUNC} OR coalesce(past_current_status, '') NOT IN {OLDUNC} AS then_ FROM main WHERE {where}),
  reasons AS (SELECT CASE WHEN now_ AND NOT then_ THEN 'First-time trend' WHEN {worse.format(c='long_term')} THEN '{rank} in LTT' WHEN {worse.format(c='current')} THEN '{rank} in CAT'
      WHEN past_long_term_status IN {OLDUNC} AND coalesce(long_term_status, '') NOT IN {UNC} THEN 'First-time LTT'
      WHEN past_current_status IN {OLDUNC} AND coalesce(current_status, '') NOT IN {UNC} THEN 'First-time CAT'
      WHEN then_ AND now_ THEN 'Other changes in trends' WHEN then_ AND NOT now_ THEN 'Loss of trends' WHEN {sh} THEN '{shift_label}' ELSE 'Others' END AS reason FROM b)
  SELECT pos, reason, n, coalesce(round_even(100.0::DOUBLE * n / nullif(sum(n) OVER (), 0), 1), 0) AS perc FROM (
    SELECT pos, l.reason, count(x.reason) AS n FROM (VALUES {vals}) l(pos, reason) LEFT JOIN reasons x USING (reason) GROUP BY 1, 2)"""


WORSE = """((coalesce({c}_status, '') = 'Rapid Decline' AND past_{c}_status IN ('Moderate Decline','Stable','Moderate Increase','Strong Increase'))
    OR (coalesce({c}_status, '') IN ('Decline','Rapid Decline') AND past_{c}_status IN ('Stable','Moderate Increase','Strong Increase')))"""
BETTER = """((past_{c}_status = 'Strong Decline' AND coalesce({c}_status, '') IN ('Decline','Stable','Increase','Rapid Increase'))
    OR (past_{c}_status IN ('Moderate Decline','Strong Decline') AND coalesce({c}_status, '') IN ('Stable','Increase','Rapid Increase'))
    OR (past_{c}_status IN ('Moderate Decline','Strong Decline','Stable') AND coalesce({c}_status, '') IN ('Increase','Rapid Increase'))
    OR (past_{c}_status IN ('Moderate Decline','Strong Decline','Stable','Moderate Increase') AND coalesce({c}_status, '') = 'Rapid Increase'))"""


@query("m08_uplist_reasons", M + reason_sql("More decline", "past_priority_status IN ('Low','Moderate') AND priority_status = 'High'", WORSE,
       [("Restricted", "Very Restricted"), ("Moderate", "Restricted"), ("Large", "Moderate")], r.UPLIST_ORDER, "Reducing range"))
def m08(spark, d):
    return r.uplist_reasons(A.classified(spark, d))


@query("m09_downlist_reasons", M + reason_sql("Less decline", "priority_status IN ('Low','Moderate') AND past_priority_status = 'High'", BETTER,
       [("Very Restricted", "Restricted"), ("Restricted", "Moderate"), ("Moderate", "Large"), ("Large", "Very Large")], r.DOWNLIST_ORDER, "Increasing range"))
def m09(spark, d):
    return r.downlist_reasons(A.classified(spark, d))


def cat_sql(x):
    return f"CASE WHEN {x} > 80 THEN 'Critically Endangered' WHEN {x} > 50 THEN 'Endangered' WHEN {x} > 30 THEN 'Vulnerable' WHEN {x} > 20 THEN 'Near Threatened' WHEN {x} > 0 THEN 'Least Concern' END"


@query("m10_redlist", M + f"""
  , x AS (SELECT *, greatest(gen, 10) AS g FROM main WHERE current_analysis = 'X' AND currentsloperci < 0 AND mean5km > 8
      AND 1.96 * abs(currentslopemean) > abs(currentsloperci - currentslopelci) AND current_status IN ('Stable','Decline','Rapid Decline') AND gen <= 106),
  y AS (SELECT *, round(100 * (1 - pow(1 + currentsloperci / 100, g)), 0) AS decl, CASE WHEN g < 14 THEN CAST(floor((k * (1997 + g) % 1000) / 10.0) AS BIGINT) END AS pd FROM x)
  SELECT species, g AS gen, round_even(100 * share_recent, 2) AS range_coverage, round_even(100 * mean5km / 25, 2) AS cell_coverage, current_status, priority_status,
    CAST(decl AS BIGINT) AS decline, {cat_sql('decl')} AS category, iucn, CASE WHEN {cat_sql('decl')} = iucn THEN 'No' WHEN {cat_sql('decl')} <> iucn THEN 'Yes' END AS differs,
    pd AS projected_decline, {cat_sql('pd')} AS category_projected, CASE WHEN {cat_sql('decl')} = {cat_sql('pd')} THEN 'No' WHEN {cat_sql('decl')} <> {cat_sql('pd')} THEN 'Yes' END AS projection_differs
  FROM y""")
def m10(spark, d):
    main = A.classified(spark, d)
    proj = A.main_table(spark, d).select("species", "k", F.explode(F.sequence(F.lit(2007), F.lit(2010))).alias("year"))
    proj = proj.select("species", "year", ((F.col("k") * F.col("year") % 1000) / F.lit(10.0)).alias("rci"))
    gens = A.main_table(spark, d).select("species", "gen")
    return r.redlist(main, gens, proj, 1997, 2000)


@query("m16_list_by_group", M + """
  SELECT grp, habitat, string_agg(DISTINCT checklist_name, ', ' ORDER BY checklist_name) AS items FROM main WHERE priority_status = 'High' GROUP BY 1, 2""")
def m16(spark, d):
    return r.list_by_group(A.classified(spark, d).filter("priority_status = 'High'"), ["grp", "habitat"], "checklist_name")


@query("m17_contributors", S.upto("gridded", "name", """base AS (SELECT DISTINCT observer_id, gridg1, group_id, year <= 1996 AS hist FROM gridded
    WHERE observer_id NOT IN (SELECT 'obsr' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' OR c_name = 'Customer#000000005'))""") + """
  SELECT observer_id, c_name AS full_name, no_cells, hist_lists, tot_lists,
    CASE WHEN no_cells IS NOT NULL OR tot_lists IS NOT NULL THEN 'Total lists and cells' END AS by_total, CASE WHEN hist_lists IS NOT NULL THEN 'Historical lists' END AS by_history
  FROM (SELECT observer_id, count(*) AS no_cells FROM (SELECT observer_id, gridg1 FROM base GROUP BY 1, 2 HAVING count(DISTINCT group_id) >= 12) GROUP BY 1)
  FULL JOIN (SELECT observer_id, count(DISTINCT group_id) AS tot_lists FROM base GROUP BY 1 HAVING count(DISTINCT group_id) >= 14) USING (observer_id)
  FULL JOIN (SELECT observer_id, count(DISTINCT group_id) AS hist_lists FROM base WHERE hist GROUP BY 1 HAVING count(DISTINCT group_id) >= 5) USING (observer_id)
  LEFT JOIN (SELECT 'obsr' || c_custkey AS observer_id, c_name FROM customer) USING (observer_id)""")
def m17(spark, d):
    c = A.table(spark, d, "customer")
    oid = F.concat(F.lit("obsr"), "c_custkey").alias("observer_id")
    users = c.select(oid, F.col("c_name").alias("full_name"))
    accounts = c.filter("c_mktsegment = 'MACHINERY'").select(oid)
    return r.contributors(A.gridded(spark, d), users, accounts, ["Customer#000000005"], 12, 1, 14, 1996, 5)


def group_members(spark, d):
    """Species lists per colour, as comma-separated text, back to rows."""
    p = A.table(spark, d, "part").select("p_name").distinct()
    lists = p.groupBy(F.split("p_name", " ")[0].alias("grp")).agg(F.array_join(F.collect_set("p_name"), ", ").alias("names"))
    return r.members(lists)


@query("m18_composite_trends", S.upto("ana", "name", *RAWS, COMB, LONG) + """
  SELECT split_part(common_name, ' ', 1) AS grp, year, timegroup, CASE WHEN count(*) = count(m) THEN round(avg(m), 6) END AS mean_std
  FROM (SELECT *, CASE WHEN common_name LIKE '%widget' AND year = 1998 THEN NULL ELSE mean_std END AS m FROM lng) GROUP BY 1, 2, 3""")
def m18(spark, d):
    std = v.standardise(v.combine_sims(fq.raw_trends(spark, d)))
    gap = F.col("common_name").endswith("widget") & (F.col("year") == 1998)
    std = std.withColumn("mean_std", F.when(~gap, F.col("mean_std")))
    out = r.composite_trends(std.select("common_name", "year", "timegroup", "mean_std"), group_members(spark, d))
    return out.withColumn("mean_std", F.round("mean_std", 6))


@query("m19_composite_summary", M + """
  SELECT grp, CASE priority_status WHEN 'High' THEN 'HIGH' WHEN 'Moderate' THEN 'MOD' WHEN 'Low' THEN 'LOW' END AS priority, count(DISTINCT checklist_name) AS no_species,
    string_agg(DISTINCT checklist_name, ', ' ORDER BY checklist_name) AS species_list FROM main GROUP BY 1, 2""")
def m19(spark, d):
    main = A.classified(spark, d)
    lists = main.groupBy("grp").agg(F.array_join(F.collect_set("species"), ", ").alias("names"))
    return r.composite_summary(main, r.members(lists))


SERIES = "series AS (SELECT species AS common_name, CAST(y AS INT) AS year, (k * y % 300)::DOUBLE AS mean_std FROM main0, (SELECT unnest(range(1995, 2004)) AS y))"


def series(spark, d):
    m = A.main_table(spark, d).withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2003))))
    return m.select(F.col("species").alias("common_name"), "year", (F.col("k") * F.col("year") % 300).cast("double").alias("mean_std"))


@query("m20_display_series", S.with_(S.MAIN, SERIES) + """
  SELECT common_name, year, mean_std FROM series WHERE year BETWEEN 1997 AND 2000 AND common_name IN (
    SELECT species FROM main WHERE coalesce(current_status, '') NOT IN ('Insufficient Data', 'Trend Inconclusive') AND current_analysis = 'X'
    INTERSECT SELECT species FROM main WHERE coalesce(current_status, '') NOT IN ('Insufficient Data', 'Trend Inconclusive') AND current_analysis = 'X' AND k % 2 = 0)""")
def m20(spark, d):
    main = A.classified(spark, d)
    return r.display_series(main, series(spark, d), "CAT", 2000, 1997, single=False, mask_of=main.filter("k % 2 = 0"))


@query("m20_display_series_single", S.with_(S.MAIN, SERIES) + """
  SELECT common_name, year, mean_std FROM series WHERE year <= 2000 AND common_name IN (
    SELECT species FROM main WHERE coalesce(long_term_status, '') <> 'Insufficient Data' AND long_term_analysis = 'X')""")
def m20b(spark, d):
    return r.display_series(A.classified(spark, d), series(spark, d), "LTT", 2000, 1997)


def run(spark, d, shift):
    m = A.main_table(spark, d).withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2000)))).filter("k % 3 > 0 OR year > 1995")
    mean = 100 + ((F.col("k") * (F.col("year") + shift)) % 61).cast("double")
    half = ((F.col("k") + F.col("year") * shift) % 17 + 1).cast("double")
    return m.select(F.col("species").alias("common_name"), "year", mean.alias("mean"),
                    (mean - half).alias("lci_std"), mean.alias("mean_std"), (mean + half).alias("rci_std"),
                    (mean - 2 * half).alias("lci_std_recent"), (mean + 1).alias("mean_std_recent"), (mean + 2 * half).alias("rci_std_recent"))


def run_sql(name, shift):
    mean, half = f"100 + (k * (y + {shift}) % 61)::DOUBLE", f"((k + y * {shift}) % 17 + 1)::DOUBLE"
    return f"""{name} AS (SELECT species AS common_name, CAST(y AS INT) AS year, CASE WHEN k % 3 > 0 THEN {mean} - {half} ELSE {mean} - 2 * {half} END AS l,
    CASE WHEN k % 3 > 0 THEN {mean} ELSE {mean} + 1 END AS m, CASE WHEN k % 3 > 0 THEN {mean} + {half} ELSE {mean} + 2 * {half} END AS r, {mean} AS std
  FROM main0, (SELECT unnest(range(1995, 2001)) AS y) WHERE k % 3 > 0 OR y > 1995)"""


COMPARED = ["mean_diff", "mean_pct_diff", "corr_means", "lci_range_diff", "rci_range_diff", "mean_width_old", "mean_width_new", "width_ratio"]


@query("m21_compare_runs", S.with_(S.MAIN0, run_sql("o", 0), run_sql("n", 3)) + """
  SELECT common_name, count(*) AS n_points, round(avg(abs(o.m - 100) + abs(n.m - 100)), 6) AS mean_diff, round(100 * avg((n.m - o.m) / o.m), 6) AS mean_pct_diff,
    CASE WHEN isnan(corr(o.m, n.m)) THEN NULL ELSE round(corr(o.m, n.m), 6) END AS corr_means, round(avg(n.l - o.l), 6) AS lci_range_diff, round(avg(n.r - o.r), 6) AS rci_range_diff, round(avg(o.r - o.l), 6) AS mean_width_old,
    round(avg(n.r - n.l), 6) AS mean_width_new, round(avg(n.r - n.l) / avg(o.r - o.l), 6) AS width_ratio FROM o JOIN n USING (common_name, year) GROUP BY 1""")
def m21(spark, d):
    out = r.compare_runs(run(spark, d, 0), run(spark, d, 3), 1995)
    return out.select("common_name", "n_points", *[F.round(c, 6).alias(c) for c in COMPARED])


@query("m21_yearly_differences", S.with_(S.MAIN0, run_sql("o", 0), run_sql("n", 3)) + """
  SELECT year, round(avg(d), 6) AS mean_pct_diff, round(stddev_samp(d), 6) AS sd_pct_diff, count(d) AS n FROM (
    SELECT year, 100 * (n.std - o.std) / o.std AS d FROM o JOIN n USING (common_name, year)) GROUP BY 1""")
def m21b(spark, d):
    out = r.yearly_differences(run(spark, d, 0), run(spark, d, 3))
    return out.select("year", F.round("mean_pct_diff", 6).alias("mean_pct_diff"), F.round("sd_pct_diff", 6).alias("sd_pct_diff"), "n")


@query("m21_top_changes", S.with_(S.MAIN0, run_sql("o", 0), run_sql("n", 3)) + """
  SELECT common_name, round(p, 6) AS mean_pct_diff FROM (SELECT common_name, 100 * avg((n.m - o.m) / o.m) AS p FROM o JOIN n USING (common_name, year) GROUP BY 1)
  ORDER BY round(abs(p), 6) DESC, common_name LIMIT 10""")
def m21c(spark, d):
    out = r.compare_runs(run(spark, d, 0), run(spark, d, 3), 1995).select("common_name", F.round("mean_pct_diff", 6).alias("mean_pct_diff"))
    return r.extreme_changes(out)


MASKS = """mm AS (SELECT 'none' AS mask, 'country' AS mask_type, 'Full country' AS label, '01_none' AS code, * FROM main
  UNION ALL SELECT 'woodland', 'habitat', 'Woodland', '02_woodland', * FROM main WHERE k % 2 = 0
  UNION ALL SELECT n_name, 'state', n_name, lpad(CAST(rk + 5 AS VARCHAR), 2, '0') || '_' || lower(n_name), main.* FROM main JOIN (SELECT n_name, n_nationkey, rank() OVER (ORDER BY n_name) AS rk FROM nation) ON k % 25 = n_nationkey)"""


def by_mask(spark, d):
    main = A.classified(spark, d)
    n = A.table(spark, d, "nation")
    st = main.join(n, F.col("k") % 25 == F.col("n_nationkey")).select(F.col("n_name").alias("mask"), *main.columns)
    both = main.withColumn("mask", F.lit("none")).unionByName(main.filter("k % 2 = 0").withColumn("mask", F.lit("woodland")))
    return both.unionByName(st), masks.masks(n, "n_name")


@query("m22_download_table", S.with_(S.MAIN, MASKS) + """
  SELECT species, mask, label, selected = 'X' AS selected, long_term_analysis = 'X' AS long_term_analysis, round_even(longtermmean, 1) AS longtermmean,
    round_even(currentslopemean, 1) AS currentslopemean, round_even(100 * share_recent, 0) AS share_recent, round_even(mean5km, 0) AS mean5km, coalesce(restricted_islands = 1, FALSE) AS restricted_islands,
    CASE WHEN mask_type = 'state' THEN k % 4 = 0 END AS is_key, priority_status FROM mm WHERE mask = 'none' OR priority_status IS NOT NULL""")
def m22(spark, d):
    both, reg = by_mask(spark, d)
    key = both.filter("k % 4 = 0 AND mask NOT IN ('none', 'woodland')").select(F.col("mask").alias("state"), "species")
    return r.download_table(both, reg, key).select(
        "species", "mask", "label", "selected", "long_term_analysis", "longtermmean", "currentslopemean", "share_recent", "mean5km",
        "restricted_islands", "is_key", "priority_status")


@query("m22_null_columns", S.with_(S.MAIN, MASKS) + " UNION ALL ".join(
    f"SELECT mask, '{c}' AS \"column\" FROM mm WHERE k % 11 = 0 OR mask <> 'woodland' GROUP BY mask HAVING count(CASE WHEN k % 36 = 0 OR '{c}' <> 'restricted_islands' THEN {c} END) = 0"
    for c in ("restricted_islands", "longtermmean", "priority_status")))
def m22b(spark, d):
    both, _ = by_mask(spark, d)
    both = both.filter("k % 11 = 0 OR mask <> 'woodland'").withColumn("restricted_islands", F.when(F.col("k") % 36 == 0, F.col("restricted_islands")))
    return r.null_columns(both, "mask", ["restricted_islands", "longtermmean", "priority_status"])


DICT = ["species", "grp", "iucn", "range_status", "one_percent", "gen", "past_priority_status"]
TYPES = {"one_percent": "bigint", "gen": "bigint"}


@query("m23_data_dictionary", S.with_(S.MAIN, MASKS) + " UNION ALL ".join(
    f"SELECT '{c}' AS field, '{TYPES.get(c, 'string')}' AS type, CAST(min({e}) AS VARCHAR) AS min_value, CAST(max({e}) AS VARCHAR) AS max_value, count(CASE WHEN mask <> 'none' THEN {e} END) = 0 AS national_only FROM mm"
    for c in DICT for e in [f"CASE WHEN mask = 'none' THEN {c} END" if c.startswith("past") else c]))
def m23(spark, d):
    both, _ = by_mask(spark, d)
    national = F.col("mask") == "none"
    both = both.withColumn("past_priority_status", F.when(national, F.col("past_priority_status")))
    return r.data_dictionary(both, DICT, national)


def fmt_sql(a, b):
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN printf('(%.2f, %.2f)', round({a}, 2), round({b}, 2)) ELSE '' END"


@query("m24_publication_rows", S.with_(S.MAIN, MASKS) + f"""
  , p AS (SELECT *, replace(lower(checklist_name), ' ', '-') AS slug, {fmt_sql('longtermlci', 'longtermrci')} AS long_term_ci, {fmt_sql('currentslopelci', 'currentsloperci')} AS current_ci,
      CASE mask_type WHEN 'country' THEN 'national' ELSE mask_type END AS mt, CASE WHEN longtermmean IS NOT NULL OR currentslopemean IS NOT NULL THEN 'est' ELSE 'not' END AS e FROM mm WHERE selected = 'X'),
  l AS (SELECT species, {', '.join(f"coalesce(string_agg(CASE WHEN mt = '{t}' THEN code || '-' || e || '-' || slug END, ',' ORDER BY code), '') AS {t}_masks" for t in ('national', 'habitat', 'conservation_area', 'state'))} FROM p GROUP BY 1)
  SELECT p.species, p.mask, label, slug, long_term_ci, current_ci, long_term_ci AS long_term_ci_in, current_ci AS current_ci_in, habitat AS habitat_in,
    coalesce('NATION_' || (k % 3), '') AS key_states, coalesce(priority_status, '') AS priority_status, national_masks, habitat_masks, conservation_area_masks, state_masks,
    CASE WHEN long_term_status = 'Insufficient Data' AND current_status = 'Insufficient Data' THEN 'No' ELSE 'Yes' END AS only_estimated,
    past_priority_status IS NULL AND priority_status IS NOT NULL AS new_here, CASE WHEN mt = 'national' THEN national_masks ELSE code || '-' || slug END AS url FROM p JOIN l USING (species)""")
def m24(spark, d):
    both, reg = by_mask(spark, d)
    key = A.main_table(spark, d).select("species", F.concat(F.lit("NATION_"), F.col("k") % 3).alias("key_states"))
    return r.publication_rows(both, reg, key)


@query("m25_species_per_state", S.upto("deduped", "part") + """
  SELECT state, count(DISTINCT common_name) AS n_species FROM deduped WHERE category IN ('species', 'issf') GROUP BY 1""")
def m25(spark, d):
    return r.species_per_state(A.deduped(spark, d, "part"))


@query("m25_key_districts", S.upto("deduped", "name") + """
  , pool AS (SELECT * FROM deduped WHERE all_species_reported = 1 AND year > 1995),
  l AS (SELECT state, district, count(DISTINCT group_id) AS lists FROM pool GROUP BY 1, 2 HAVING count(DISTINCT group_id) > 20)
  SELECT state, common_name, district, round(freq, 9) AS freq FROM (SELECT *, row_number() OVER (PARTITION BY state, common_name ORDER BY freq DESC, district) AS rn FROM (
    SELECT state, common_name, district, count(DISTINCT group_id) / max(lists) AS freq FROM pool JOIN l USING (state, district) WHERE common_name LIKE 'red%' GROUP BY 1, 2, 3)) WHERE rn <= 2""")
def m25b(spark, d):
    obs = A.deduped(spark, d)
    key = obs.filter("common_name LIKE 'red%'").select("state", "common_name").distinct()
    return r.key_districts(obs, key, 2000).withColumn("freq", F.round("freq", 9))


@query("m25_key_habitats", M + """
  , j AS (SELECT 'NATION_' || (k % 25) AS state, species AS common_name, (k % 20) / 20.0 + 0.05 AS share, CASE WHEN habitat LIKE 'Forest%' THEN 'Woodland' WHEN habitat IN ('Grassland', 'Open Habitat') THEN 'Open Landscape' ELSE habitat END AS habitat
    FROM main0 WHERE habitat <> 'Non-specialized')
  SELECT state, habitat, common_name, round(share, 6) AS share, n FROM (SELECT *, count(*) OVER (PARTITION BY state, habitat) AS n, row_number() OVER (PARTITION BY state, habitat ORDER BY share DESC, common_name) AS rn FROM j) WHERE rn <= 4 OR share = 1""")
def m25c(spark, d):
    main = A.main_table(spark, d)
    key = main.select(F.concat(F.lit("NATION_"), F.col("k") % 25).alias("state"), F.col("species").alias("common_name"),
                      ((F.col("k") % 20) / F.lit(20.0) + 0.05).alias("share"))
    return r.key_habitats(key, main).withColumn("share", F.round("share", 6))


@query("m25_priority_districts", S.upto("deduped", "part", S.MAIN) + """
  SELECT state, district, n_high FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n_high DESC, district) AS rn FROM (
    SELECT state, district, count(DISTINCT common_name) AS n_high FROM deduped WHERE common_name IN (SELECT species FROM main WHERE priority_status = 'High') GROUP BY 1, 2)) WHERE rn <= 3""")
def m25d(spark, d):
    return r.priority_districts(A.deduped(spark, d, "part"), A.classified(spark, d))


@query("m25_low_effort_districts", S.upto("ana") + """
  SELECT state, district, n_lists FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n_lists, district) AS rn FROM (
    SELECT state, district, coalesce(n, 0) AS n_lists FROM (SELECT n_name AS state, n_name || '-' || i AS district FROM nation, (SELECT unnest(range(0, 4)) AS i))
    LEFT JOIN (SELECT state, district, count(DISTINCT group_id) AS n FROM ana WHERE all_species_reported = 1 GROUP BY 1, 2) USING (state, district))) WHERE rn <= 3""")
def m25e(spark, d):
    dist = A.table(spark, d, "nation").select(F.col("n_name").alias("state"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    dist = dist.select("state", F.concat_ws("-", "state", F.col("i").cast("string")).alias("district"))
    return r.low_effort_districts(dist, A.analysis_table(spark, d))


@query("m25_state_trend_summary", S.with_(S.MAIN) + """
  , st AS (SELECT *, 'NATION_' || (k % 25) AS state FROM main),
  e AS (SELECT state, count(*) FILTER (WHERE long_term_analysis = 'X' OR current_analysis = 'X') >= 74 AS own FROM st GROUP BY 1),
  t AS (SELECT state, own, 'l' AS kind, CASE WHEN own AND k % 2 = 0 THEN 'Stable' ELSE long_term_status END AS status FROM st JOIN e USING (state) WHERE selected = 'X'
    UNION ALL SELECT state, own, 'c', current_status FROM st JOIN e USING (state) WHERE selected = 'X')
  SELECT state, CASE WHEN own THEN 'state level' ELSE 'country level' END AS level, status, count(*) FILTER (WHERE kind = 'l') AS long_term, count(*) FILTER (WHERE kind = 'c') AS current
  FROM t WHERE status IS NOT NULL GROUP BY 1, 2, 3""")
def m25f(spark, d):
    nat = A.classified(spark, d)
    st = nat.withColumns({"state": F.concat(F.lit("NATION_"), F.col("k") % 25),
                          "long_term_status": F.when(F.col("k") % 2 == 0, F.lit("Stable")).otherwise(F.col("long_term_status"))})
    return r.state_trend_summary(st, nat, 74)


@query("m26_growth", S.upto("deduped") + """
  SELECT year, before, after, round_even(100.0::DOUBLE * (after - before) / before, 0) + 100 AS ratio FROM (
    SELECT year, count(DISTINCT CASE WHEN reviewed = 0 THEN group_id END) AS before, count(DISTINCT group_id) AS after FROM deduped GROUP BY 1)""")
def m26(spark, d):
    obs = A.deduped(spark, d)
    n = lambda df: df.groupBy("year").agg(F.count_distinct("group_id").alias("lists"))
    return r.growth(n(obs.filter("reviewed = 0")), n(obs))


@query("m27_case_series", S.with_(S.MAIN0) + """
  , x AS (SELECT species AS common_name, CAST(1990 + y * (1 + k % 2) AS INT) AS year, (k * (y + 3) % 97) / 10.0 AS mean_std, (k * (y + 3) % 97) / 10.0 + (k * y % 7) / 4.0 AS rci_std FROM main0, (SELECT unnest(range(0, 6)) AS y)),
  kept AS (SELECT * FROM x WHERE NOT (rci_std - mean_std > 0.3 AND coalesce(rci_std / nullif(mean_std, 0), 0) > 2)),
  f AS (SELECT common_name, arg_max(mean_std, year) AS final_value FROM kept GROUP BY 1)
  SELECT k.common_name, year, mean_std, coalesce(lead(year) OVER (PARTITION BY k.common_name ORDER BY year) - year >= 2, TRUE) AS shown, final_value, place
  FROM kept k JOIN (SELECT *, row_number() OVER (ORDER BY final_value DESC, common_name) AS place FROM f) USING (common_name)""")
def m27(spark, d):
    m = A.main_table(spark, d).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(5))))
    mean = (F.col("k") * (F.col("y") + 3) % 97) / F.lit(10.0)
    x = m.select(F.col("species").alias("common_name"), (1990 + F.col("y") * (1 + F.col("k") % 2)).cast("int").alias("year"),
                 mean.alias("mean_std"), (mean + (F.col("k") * F.col("y") % 7) / F.lit(4.0)).alias("rci_std"))
    return r.case_series(x).select("common_name", "year", "mean_std", "shown", "final_value", "place")


