"""Trend resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrends.functions import maths, portable
from fieldtrends.operators import clean, resolve as v
from fieldtrends.plans import frequency as fq
from fieldtrends.session import staged
from fieldtrends.sources import adapters as A
from fieldtrends.suite import tables as S
from fieldtrends.suite.registry import query
from fieldtrends.suite.trend import RAWS

Y = A.YEARS
N = 1000
SEED = 10


def rnd(df, cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def sql_rnd(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


INV = "(1 - exp(-exp({})))"
COMB = f"""comb0 AS MATERIALIZED (SELECT common_name, timegroup, year, CASE WHEN count(freq) = count(*) THEN avg(freq) END AS mean_trans,
    CASE WHEN count(freq) = count(*) THEN stddev_samp(freq) + sqrt(sum(se * se) / count(*)) END AS se_trans FROM raw GROUP BY 1, 2, 3),
comb AS MATERIALIZED (SELECT *, {INV.format('mean_trans - 1.96 * se_trans')} AS lci, {INV.format('mean_trans')} AS mean,
    {INV.format('mean_trans + 1.96 * se_trans')} AS rci FROM comb0)"""


def std_sql(name, where, col):
    return f"""{name} AS (SELECT c.*, f.m1, f.s1, f.first_year, 100 * mean / f.mean1 AS {col} FROM (SELECT * FROM comb WHERE {where}) c
  JOIN (SELECT common_name, arg_min(mean_trans, year) AS m1, arg_min(se_trans, year) AS s1, arg_min(mean, year) AS mean1,
    min(year) AS first_year FROM comb WHERE {where} GROUP BY 1) f USING (common_name))"""


LONG = std_sql("lng", "se_trans IS NOT NULL", "mean_std")
RECENT = std_sql("rec", "se_trans IS NOT NULL AND year >= 1997", "mean_std_recent")


def keyed(src):
    return f"""{src}k AS (SELECT s.*, ('0x' || substr(md5(common_name), 1, 7))::BIGINT * 1000 + (year - 1900) AS draw_key FROM {src} s)"""


def drawn_sql(seed, src, n=N, extra="", seed_col=None, pick=False):
    """Simulated values and ratios of a standardised table; with ``pick``, the number of a value at random."""
    s = seed_col or str(seed)
    seeds = {"u1": s, "u2": f"{s} + 7919", "u3": f"{s} + 104729", "u4": f"{s} + 104729 + 7919"} | ({"u5": "1 + 15485863"} if pick else {})
    rows = f"(SELECT * FROM {src}k CROSS JOIN (SELECT unnest(range(1, {n + 1})) AS draw) {extra})"
    more = f", 1 + CAST(floor(u5 * {n}) AS BIGINT) AS pick" if pick else ""
    return f"""{src}d AS MATERIALIZED (SELECT *, val / {INV.format('m1 + s1 * z2')} AS rat FROM (
    SELECT *, {INV.format('mean_trans + se_trans * z1')} AS val FROM (
      SELECT *, sqrt(-2.0::DOUBLE * ln(u1)) * cos(2 * pi() * u2) AS z1, sqrt(-2.0::DOUBLE * ln(u3)) * cos(2 * pi() * u4) AS z2{more}
      FROM ({portable.sql_uniforms('draw_key * 10007 + draw', seeds, rows)}))))"""


def combined(spark, d):
    return staged(v.combine_sims(fq.raw_trends(spark, d)))


def base(*more):
    return S.upto("ana", "name", *RAWS, COMB, *more)


@query("v01_year_info", S.upto("listed") + """
  , full_years AS (SELECT year FROM listed GROUP BY 1 HAVING count(DISTINCT month) = 12),
  heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY line_no, part_no, price) AS rn FROM listed)
    WHERE rn = 1 AND all_species_reported = 1),
  bins AS (SELECT 'timegroup' AS kind, CAST(p AS INT) AS pos, CASE p WHEN 1 THEN 'before 1996' ELSE '1996-1997' END AS label,
      CAST(round_even(median(year), 0) AS INT) AS year FROM (SELECT year, CASE WHEN year <= 1995 THEN 1 ELSE 2 END AS p FROM heads WHERE year <= 1997) GROUP BY p)
  SELECT * FROM bins
  UNION ALL SELECT 'timegroup', CAST(2 + row_number() OVER (ORDER BY year) AS INT), CAST(year AS VARCHAR), year FROM full_years WHERE year > 1997
  UNION ALL SELECT 'recent', CAST(row_number() OVER (ORDER BY year) AS INT), CAST(year AS VARCHAR), year FROM full_years WHERE year >= 1997
  UNION ALL SELECT 'projection', CAST(i AS INT), CAST(m + i AS VARCHAR), CAST(m + i AS INT) FROM (SELECT max(year) AS m FROM full_years), (SELECT unnest(range(1, 8)) AS i)""")
def v01(spark, d):
    obs = A.listed(spark, d)
    info = v.year_info(clean.complete_years(obs), clean.historical_median_years(obs, [1995, 1997], A.ORDER),
                       [("before 1996", 1995), ("1996-1997", 1997)], recent_from=1997)
    return v.year_table(spark, info)


C5 = ["mean_trans", "se_trans", "lci", "mean", "rci"]


@query("v02_combine_sims", base() + f"SELECT common_name, timegroup, year, {sql_rnd(C5)} FROM comb")
def v02(spark, d):
    return rnd(combined(spark, d), C5)


@query("v03_framework", base() + """
  SELECT common_name, timegroup, year FROM (SELECT DISTINCT common_name FROM comb), (SELECT timegroup, tg_year AS year FROM labels
    UNION ALL SELECT CAST(y AS VARCHAR), CAST(y AS INT) FROM (SELECT unnest(range(2001, 2008)) AS y))""")
def v03(spark, d):
    return v.framework(combined(spark, d), Y)


@query("v04_standardise", base(LONG, RECENT) + """
  SELECT common_name, year, round(mean_std, 6) AS mean_std, round(m1, 6) AS m1, round(s1, 6) AS s1, round(mean_std_recent, 6) AS mean_std_recent
  FROM lng LEFT JOIN (SELECT common_name, year, mean_std_recent FROM rec) USING (common_name, year)""")
def v04(spark, d):
    c = combined(spark, d)
    rec = v.standardise(c, Y.recent_start, "mean_std_recent").select("common_name", "year", "mean_std_recent")
    out = v.standardise(c).join(rec, ["common_name", "year"], "left")
    cols = ["mean_std", "m1", "s1", "mean_std_recent"]
    return rnd(out.select("common_name", "year", *cols), cols)


LINT = """lint AS (SELECT l.*, q.lci_std, q.rci_std FROM lng l LEFT JOIN (SELECT common_name, year, 100 * quantile_cont(rat, 0.025) AS lci_std,
    100 * quantile_cont(rat, 0.975) AS rci_std FROM lngd GROUP BY 1, 2) q USING (common_name, year))"""
INTERVAL = [LONG, keyed("lng"), drawn_sql(SEED, "lng"), LINT]


def interval(spark, d):
    return v.ratio_interval(v.standardise(combined(spark, d)), N, SEED)


CI = ["lci_std", "mean_std", "rci_std"]


@query("v05_ratio_interval", base(*INTERVAL) + f"SELECT common_name, year, {sql_rnd(CI)} FROM lint")
def v05(spark, d):
    return rnd(interval(spark, d).select("common_name", "year", *CI), CI)


SENS = drawn_sql(None, "lng", N, "CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS seed) WHERE year = 2000", "seed")


@query("v06_seed_sensitivity", base(LONG, keyed("lng"), SENS) + """
  SELECT common_name, seed::BIGINT AS seed, round(100 * quantile_cont(rat, 0.025), 6) AS longtermlci, round(min(mean_std), 6) AS longtermmean,
    round(100 * quantile_cont(rat, 0.975), 6) AS longtermrci FROM lngd GROUP BY 1, 2""")
def v06(spark, d):
    out = v.seed_sensitivity(v.standardise(combined(spark, d)), N, [1, 2, 3, 4, 5], Y.latest_year)
    return rnd(out, ["longtermlci", "longtermmean", "longtermrci"])


@query("v07_latest_values", base(*INTERVAL, S.spmap()) + """
  SELECT common_name, round(lci_std, 6) AS longtermlci, round(mean_std, 6) AS longtermmean, round(rci_std, 6) AS longtermrci
  FROM spmap LEFT JOIN (SELECT * FROM lint WHERE year = 2000) USING (common_name)""")
def v07(spark, d):
    out = v.latest_values(A.species_map(spark, d).select("common_name"), interval(spark, d), Y.latest_year)
    return rnd(out, ["longtermlci", "longtermmean", "longtermrci"])


BAND = """band AS (SELECT * REPLACE (CASE WHEN year = first_year THEN mean_std ELSE lci_std END AS lci_std,
    CASE WHEN year = first_year THEN mean_std ELSE rci_std END AS rci_std) FROM lint)"""


@query("v08_zero_baseline_band", base(*INTERVAL, BAND) + f"SELECT common_name, year, {sql_rnd(CI)} FROM band")
def v08(spark, d):
    return rnd(v.zero_baseline_band(interval(spark, d)).select("common_name", "year", *CI), CI)


SAMPLES = """samples AS MATERIALIZED (SELECT a.common_name, a.year, a.draw AS sim, a.val, b.val AS val_sample FROM recd a
    JOIN recd b ON b.common_name = a.common_name AND b.year = a.year AND b.draw = a.pick)"""
RECDRAWS = [RECENT, keyed("rec"), drawn_sql(SEED, "rec", pick=True), SAMPLES]


def samples(spark, d):
    std = v.standardise(combined(spark, d), Y.recent_start, "mean_std_recent")
    return v.value_arrays(std, N, 1, SEED)


@query("v09_resample_values", base(*RECDRAWS) + "SELECT common_name, year, sim, round(val, 9) AS val, round(val_sample, 9) AS val_sample FROM samples")
def v09(spark, d):
    std = v.standardise(combined(spark, d), Y.recent_start, "mean_std_recent")
    return rnd(v.resample_values(std, N, 1, SEED), ["val", "val_sample"], 9)


def slopes_sql(name, src, by):
    """Straight-line fit per (by, sim) written out from sums of squares."""
    b = ", ".join(["common_name", *by])
    on = " AND ".join(f"g.{c} = r.{c}" for c in ["common_name", *by, "sim"])
    return f"""{name}o AS (SELECT {b}, sim, count(*) AS n, avg(year) AS xb, avg(val_sample) AS yb, min(year) AS x1, list_sort(list(year))[2] AS x2 FROM {src} GROUP BY {b}, sim),
{name}g AS (SELECT g.{', g.'.join(['common_name', *by, 'sim', 'n', 'xb', 'yb', 'x1', 'x2'])}, sum((r.year - xb) * (r.year - xb)) AS sxx,
    sum((r.year - xb) * (r.val_sample - yb)) AS sxy, sum((r.val_sample - yb) * (r.val_sample - yb)) AS syy
  FROM {name}o g JOIN {src} r ON {on} GROUP BY ALL),
{name}f AS (SELECT *, yb + sxy / nullif(sxx, 0) * (x1 - xb) AS f1, yb + sxy / nullif(sxx, 0) * (x2 - xb) AS f2,
    sqrt(greatest(syy - sxy * sxy / nullif(sxx, 0), 0) / nullif(n - 2, 0) * (1.0 / n + (x1 - xb) * (x1 - xb) / nullif(sxx, 0))) AS e1,
    sqrt(greatest(syy - sxy * sxy / nullif(sxx, 0), 0) / nullif(n - 2, 0) * (1.0 / n + (x2 - xb) * (x2 - xb) / nullif(sxx, 0))) AS e2 FROM {name}g),
{name}s AS (SELECT {b}, 100 * (f2 - f1) / abs(f1) AS sl,
    (f2 - f1) / abs(f1) * sqrt((e1 * e1 + e2 * e2) / ((f2 - f1) * (f2 - f1)) + (e1 / abs(f1)) * (e1 / abs(f1))) AS slse FROM {name}f),
{name} AS (SELECT {b}, m - 1.96 * s AS currentslopelci, m AS currentslopemean, m + 1.96 * s AS currentsloperci FROM (
    SELECT {b}, avg(sl) AS m, stddev_samp(sl) + sqrt(sum(slse * slse) / count(*)) AS s FROM {name}s GROUP BY {b}))"""


SL = ["currentslopelci", "currentslopemean", "currentsloperci"]


@query("v10_slope_interval", base(*RECDRAWS, slopes_sql("slopes", "samples", [])) + f"SELECT common_name, {sql_rnd(SL)} FROM slopes")
def v10(spark, d):
    return rnd(v.slope_interval(samples(spark, d)), SL)


DROPS = "drops AS (SELECT s.*, d.dropped FROM samples s JOIN (SELECT unnest([1997, 1998, 1999, 2000]) AS dropped) d ON s.year <> d.dropped)"
WIDE = ", ".join(
    f"round(max(CASE WHEN dropped = {y} THEN {c} END), 6) AS {c}{i}" for i, y in enumerate([1997, 1998, 1999, 2000], 1) for c in SL)


@query("v11_slope_sensitivity", base(*RECDRAWS, DROPS, slopes_sql("slopes", "drops", ["dropped"])) + f"SELECT common_name, {WIDE} FROM slopes GROUP BY 1")
def v11(spark, d):
    wide = v.sensitivity_wide(v.slope_sensitivity(samples(spark, d), Y.recent_years), Y.recent_years)
    return rnd(wide, [c for c in wide.columns if c != "common_name"])


PROJ = """po AS (SELECT common_name, sim, count(*) AS n, avg(year) AS xb, avg(ln(val_sample)) AS yb, CASE WHEN count(*) > 1 THEN regr_slope(ln(val_sample), year) END AS b,
    regr_sxx(ln(val_sample), year) AS sxx, regr_syy(ln(val_sample), year) AS syy, regr_sxy(ln(val_sample), year) AS sxy, arg_min(val, year) AS v1
  FROM samples GROUP BY 1, 2),
proj AS (SELECT common_name, year, avg(100 * exp(m - 1.96 * e) / v1) AS lci_ext_std, avg(100 * exp(m) / v1) AS mean_ext_std,
    avg(100 * exp(m + 1.96 * e) / v1) AS rci_ext_std
  FROM (SELECT common_name, CAST(y AS INT) AS year, v1, yb + b * (y - xb) AS m,
      sqrt(greatest(syy - b * sxy, 0) / nullif(n - 2, 0) * (1.0 / n + (y - xb) * (y - xb) / nullif(sxx, 0))) AS e
    FROM po, (SELECT unnest(range(2001, 2008)) AS y)) GROUP BY 1, 2)"""
EXT = ["lci_ext_std", "mean_ext_std", "rci_ext_std"]


@query("v12_projection", base(*RECDRAWS, PROJ) + f"SELECT common_name, year, {sql_rnd(EXT, 4)} FROM proj")
def v12(spark, d):
    return rnd(v.project(samples(spark, d), Y.projection_years, Y.recent_start), EXT, 4)


RINT = """rint AS (SELECT r.*, CASE WHEN year = first_year THEN mean_std_recent ELSE lo END AS lci_std_recent,
    CASE WHEN year = first_year THEN mean_std_recent ELSE hi END AS rci_std_recent FROM rec r LEFT JOIN (SELECT common_name, year,
    100 * quantile_cont(rat, 0.025) AS lo, 100 * quantile_cont(rat, 0.975) AS hi FROM recd GROUP BY 1, 2) USING (common_name, year))"""
ALL = C5 + CI + ["lci_std_recent", "mean_std_recent", "rci_std_recent"] + EXT + ["lci_comb_std", "mean_comb_std", "rci_comb_std"]


@query("v13_combine_series", base(*INTERVAL, BAND, *RECDRAWS, PROJ, RINT) + f"""
  SELECT common_name, timegroup, year, {sql_rnd(ALL, 4)} FROM (
    SELECT f.common_name, f.timegroup, f.year, c.mean_trans, c.se_trans, c.lci, c.mean, c.rci, b.lci_std, b.mean_std, b.rci_std,
      r.lci_std_recent, r.mean_std_recent, r.rci_std_recent, p.lci_ext_std, p.mean_ext_std, p.rci_ext_std,
      CASE WHEN coalesce(p.lci_ext_std, r.lci_std_recent) < 0 THEN 0 ELSE coalesce(p.lci_ext_std, r.lci_std_recent) END AS lci_comb_std,
      coalesce(p.mean_ext_std, r.mean_std_recent) AS mean_comb_std, coalesce(p.rci_ext_std, r.rci_std_recent) AS rci_comb_std
    FROM (SELECT common_name, timegroup, year FROM (SELECT DISTINCT common_name FROM comb), (SELECT timegroup, tg_year AS year FROM labels
      UNION ALL SELECT CAST(y AS VARCHAR), CAST(y AS INT) FROM (SELECT unnest(range(2001, 2008)) AS y))) f
    LEFT JOIN comb c ON c.common_name = f.common_name AND c.year = f.year
    LEFT JOIN band b ON b.common_name = f.common_name AND b.year = f.year
    LEFT JOIN rint r ON r.common_name = f.common_name AND r.year = f.year
    LEFT JOIN proj p ON p.common_name = f.common_name AND p.year = f.year)""")
def v13(spark, d):
    c = combined(spark, d)
    lng = v.zero_baseline_band(v.ratio_interval(v.standardise(c), N, SEED))
    std = v.standardise(c, Y.recent_start, "mean_std_recent")
    rec = v.zero_baseline_band(
        v.ratio_interval(std, N, SEED, "lci_std_recent", "rci_std_recent"), "lci_std_recent", "mean_std_recent", "rci_std_recent")
    proj = v.project(v.value_arrays(std, N, 1, SEED), Y.projection_years, Y.recent_start)
    return rnd(v.combine_series(v.framework(c, Y), c, lng, rec, proj).select("common_name", "timegroup", "year", *ALL), ALL, 4)


@query("v14_error_propagation", base(LONG) + """
  SELECT common_name, year, round(mean_trans / m1, 6) AS ratio,
    round(mean_trans / m1 * sqrt((se_trans / mean_trans) * (se_trans / mean_trans) + (s1 / m1) * (s1 / m1)), 6) AS ratio_se,
    round(sqrt(sum(se_trans * se_trans) OVER (PARTITION BY common_name)), 6) AS total_se FROM lng""")
def v14(spark, d):
    std = v.standardise(combined(spark, d))
    total = std.groupBy("common_name").agg(maths.root_sum_square(F.col("se_trans")).alias("total_se"))
    ratio_se = maths.quotient_error(F.col("mean_trans"), F.col("m1"), F.col("se_trans"), F.col("s1"))
    out = std.join(total, "common_name").select(
        "common_name", "year", (F.col("mean_trans") / F.col("m1")).alias("ratio"), ratio_se.alias("ratio_se"), "total_se")
    return rnd(out, ["ratio", "ratio_se", "total_se"])
