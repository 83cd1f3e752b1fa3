"""Trend model input, fits and estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrends.operators import fits, trends as t
from fieldtrends.plans import frequency as fq
from fieldtrends.session import staged
from fieldtrends.sources import adapters as A
from fieldtrends.suite import tables as S
from fieldtrends.suite.registry import query
from fieldtrends.suite.selection import FRAME, LABELS, NUMBERED, REPS

Y = A.YEARS
ERA = "CASE WHEN year = 2000 THEN 2 WHEN year >= 1997 THEN 1 ELSE 0 END"
WIN = "win AS (SELECT common_name, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS min_era FROM spmap)"
INWIN = f"inwin AS (SELECT a.*, {ERA} AS era, min_era FROM ana a JOIN win USING (common_name) WHERE {ERA} >= min_era)"
OWN = "own AS (SELECT DISTINCT common_name, gridg3, month, min_era FROM inwin)"
LISTS = f"lists AS (SELECT DISTINCT group_id, gridg3, gridg1, month, timegroup, no_sp, all_species_reported, {ERA} AS era FROM ana)"
RANGED = "ranged AS (SELECT common_name, l.* FROM own JOIN lists l USING (gridg3, month) WHERE era >= min_era)"
SEASON = "CASE WHEN month IN (12,1,2) THEN 'Win' WHEN month <= 5 THEN 'Sum' WHEN month <= 8 THEN 'Mon' ELSE 'Aut' END"
EXPANDED = f"""expanded AS (SELECT r.*, {SEASON} AS season, CASE WHEN p.common_name IS NULL THEN 0 ELSE 1 END AS seen
  FROM ranged r LEFT JOIN (SELECT DISTINCT group_id, common_name FROM ana WHERE obs_count <> '0') p
    ON p.group_id = r.group_id AND p.common_name = r.common_name WHERE all_species_reported = 1)"""
T = [S.spmap(), WIN, INWIN, OWN, LISTS, RANGED]


def setup(spark, d):
    return A.analysis_table(spark, d, reuse=True, columns=A.MODEL), fq.windows_for(spark, d)


@query("t01_model_window", S.upto("ana", "name", *T) + """
  SELECT common_name, min_era, count(*) AS records, min(year) AS first_year FROM inwin GROUP BY 1, 2""")
def t01(spark, d):
    ana, win = setup(spark, d)
    return t.window_rows(ana, win, Y).groupBy("common_name", "min_era").agg(
        F.count(F.lit(1)).alias("records"), F.min("year").alias("first_year"))


@query("t02_restrict_range", S.upto("ana", "name", *T) + """
  SELECT common_name, timegroup, count(*) AS lists, count(DISTINCT gridg1) AS cells, sum(no_sp)::BIGINT AS total_length
  FROM ranged GROUP BY 1, 2""")
def t02(spark, d):
    return t.restrict_range(*setup(spark, d), Y).groupBy("common_name", "timegroup").agg(
        F.count(F.lit(1)).alias("lists"), F.count_distinct("gridg1").alias("cells"), F.sum("no_sp").alias("total_length"))


LENGTHS = """lengths AS (SELECT common_name, CAST(round_even(avg(m), 0) AS BIGINT) AS typical_length FROM (
    SELECT common_name, gridg3, avg(m) AS m FROM (SELECT common_name, gridg3, gridg1, median(no_sp) AS m FROM ranged GROUP BY 1, 2, 3)
    GROUP BY 1, 2) GROUP BY 1)"""


@query("t03_typical_list_length", S.upto("ana", "name", *T, LENGTHS) + "SELECT * FROM lengths")
def t03(spark, d):
    return t.typical_list_length(*setup(spark, d), Y)


@query("t04_expand_absences", S.upto("ana", "name", *T, EXPANDED) + """
  SELECT common_name, timegroup, season, count(*) AS lists, sum(seen)::BIGINT AS detections FROM expanded GROUP BY 1, 2, 3""")
def t04(spark, d):
    return t.expand_absences(*setup(spark, d), Y).groupBy("common_name", "timegroup", "season").agg(
        F.count(F.lit(1)).alias("lists"), F.sum("seen").alias("detections"))


@query("t05_compress", S.upto("ana", "name", *T, EXPANDED) + """
  SELECT common_name, gridg3, gridg1, season, timegroup, no_sp, count(*) AS n, sum(seen)::BIGINT AS k FROM expanded GROUP BY ALL""")
def t05(spark, d):
    return t.compress(*setup(spark, d), Y)


@query("t06_fixed_model")
def t06(spark, d):
    model = fits.fit_glm(t.compress(*setup(spark, d), Y), Y.labels)
    return model.select("common_name", F.size("terms").alias("n_terms"), F.round("deviance", 6).alias("deviance"), "n", "status")


@query("t07_mixed_model")
def t07(spark, d):
    model = fits.fit_glmm(t.compress(*setup(spark, d), Y), Y.labels)
    return model.select("common_name", F.round("deviance", 4).alias("deviance"), F.round("sd_cell", 4).alias("sd_cell"),
                        F.round("sd_outer", 4).alias("sd_outer"), "n", "status")


SETTLED = "SELECT DISTINCT common_name, 0.0::DOUBLE AS gradient FROM expanded"


@query("t06_gradient", S.upto("ana", "name", *T, EXPANDED) + SETTLED)
def t06_gradient(spark, d):
    """Largest component of the gradient at the coefficients: zero, as every model runs until it has settled."""
    model = fits.fit_glm(t.compress(*setup(spark, d), Y), Y.labels)
    return model.select("common_name", F.round("gradient", 3).alias("gradient"))


@query("t07_gradient", S.upto("ana", "name", *T, EXPANDED) + SETTLED)
def t07_gradient(spark, d):
    model = fits.fit_glmm(t.compress(*setup(spark, d), Y), Y.labels)
    return model.select("common_name", F.round("gradient", 3).alias("gradient"))


@query("t08_predict")
def t08(spark, d):
    ana, win = setup(spark, d)
    rows = t.compress(ana, win, Y)
    grid = t.prediction_grid(rows, t.typical_list_length(ana, win, Y))
    pred = t.predict_fixed(grid, fits.fit_glm(rows, Y.labels))
    return t.average_seasons(pred, Y).select(
        "common_name", "timegroup", "year", F.round("freq", 6).alias("freq"), F.round("se", 6).alias("se"))


# a kind per species, from the same keys as the windows, so that all kinds occur
KIND = "kinds AS (SELECT common_name, CASE k % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'single' ELSE 'nested' END AS model FROM spmap)"


def kinds(spark, d):
    k = F.col("k") % 4
    return A.species_map(spark, d).select("common_name", F.when(k == 0, "fixed").when(k == 1, "single").otherwise("nested").alias("model"))


@query("t07_chosen_gradient", S.upto("ana", "name", *T, EXPANDED, KIND) +
       "SELECT DISTINCT common_name, model, 0.0::DOUBLE AS gradient FROM expanded JOIN kinds USING (common_name)")
def t07_chosen(spark, d):
    """Models of all kinds side by side: each has settled."""
    model = fits.fit_chosen(t.compress(*setup(spark, d), Y), kinds(spark, d), Y.labels)
    return model.select("common_name", "model", F.round("gradient", 3).alias("gradient"))


@query("t08_predict_chosen")
def t08_chosen(spark, d):
    """Prediction from a model per species, with the errors that its kind reports."""
    ana, win = setup(spark, d)
    rows = staged(t.compress(ana, win, Y))
    model = fits.fit_chosen(rows, kinds(spark, d), Y.labels)
    pred = t.predict_chosen(t.prediction_grid(rows, t.typical_list_length(ana, win, Y)), model, fits.REPORTED)
    return t.average_seasons(pred, Y).select(
        "common_name", "timegroup", "year", F.round("freq", 5).alias("freq"), F.round("se", 5).alias("se"))


@query("t08_prediction_grid", S.upto("ana", "name", *T, EXPANDED, LENGTHS) + """
  SELECT a.common_name, timegroup, season, typical_length FROM (SELECT DISTINCT common_name, timegroup FROM expanded) a
  JOIN (SELECT DISTINCT common_name, season FROM expanded) b USING (common_name) JOIN lengths USING (common_name)""")
def t08b(spark, d):
    ana, win = setup(spark, d)
    return t.prediction_grid(t.compress(ana, win, Y), t.typical_list_length(ana, win, Y))


PRED = """pred AS (SELECT common_name, timegroup, season, ln(-ln(1 - k / n)) AS fit, sqrt((k / n) / (n * (1 - k / n))) AS err
  FROM (SELECT common_name, timegroup, season, count(*)::DOUBLE AS n, sum(seen)::DOUBLE AS k FROM expanded GROUP BY 1, 2, 3) WHERE k > 0 AND k < n)"""


@query("t09_average_seasons", S.upto("ana", "name", *T, EXPANDED, PRED, LABELS) + """
  SELECT f.common_name, l.timegroup, tg_year AS year, round(freq, 8) AS freq, round(se, 8) AS se
  FROM (SELECT DISTINCT common_name FROM pred) f CROSS JOIN labels l
  LEFT JOIN (SELECT common_name, timegroup, avg(fit) AS freq, avg(err) AS se FROM pred GROUP BY 1, 2) p
    ON p.common_name = f.common_name AND p.timegroup = l.timegroup""")
def t09(spark, d):
    rows = t.compress(*setup(spark, d), Y).groupBy("common_name", "timegroup", "season").agg(
        F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k")).filter("k > 0 AND k < n")
    p = F.col("k") / F.col("n")
    pred = rows.select("common_name", "timegroup", "season", F.log(-F.log(1 - p)).alias("fit"),
                       F.sqrt(p / (F.col("n") * (1 - p))).alias("err"))
    out = t.average_seasons(pred, Y)
    return out.select("common_name", "timegroup", "year", F.round("freq", 8).alias("freq"), F.round("se", 8).alias("se"))


# replicated raw trends, all species over all years
SIMLISTS = "simlists AS (SELECT sim, l.* FROM lists l JOIN reps USING (group_id))"
SIMOBS = "simobs AS (SELECT sim, a.* FROM ana a JOIN reps USING (group_id))"
RAW = """raw AS (SELECT f.sim, f.common_name, b.timegroup, tg_year AS year, ln(-ln(1 - p)) AS freq, sqrt(p / (n * (1 - p))) / abs(ln(1 - p)) AS se
  FROM (SELECT DISTINCT common_name, sim FROM (SELECT DISTINCT common_name FROM simobs), (SELECT DISTINCT sim FROM reps)) f CROSS JOIN labels b
  LEFT JOIN (SELECT * REPLACE (CASE WHEN p > 0 AND p < 1 THEN p END AS p) FROM (
    SELECT l.sim, o.common_name, l.timegroup, count(*) AS n, count(s.group_id) / count(*) AS p
    FROM (SELECT DISTINCT sim, common_name, gridg3, month FROM simobs) o
    JOIN simlists l ON l.sim = o.sim AND l.gridg3 = o.gridg3 AND l.month = o.month
    LEFT JOIN (SELECT DISTINCT sim, common_name, group_id FROM simobs) s
      ON s.sim = l.sim AND s.common_name = o.common_name AND s.group_id = l.group_id
    WHERE all_species_reported = 1 GROUP BY 1, 2, 3)) r ON r.sim = f.sim AND r.common_name = f.common_name AND r.timegroup = b.timegroup)"""
RAWS = [FRAME, NUMBERED, REPS, LISTS, SIMLISTS, SIMOBS, LABELS, RAW]


@query("t05_raw_trends", S.upto("ana", "name", *RAWS) + """
  SELECT sim, common_name, timegroup, year, round(freq, 8) AS freq, round(se, 8) AS se FROM raw""")
def t05b(spark, d):
    return fq.raw_trends(spark, d).select("sim", "common_name", "timegroup", "year", F.round("freq", 8).alias("freq"), F.round("se", 8).alias("se"))


@query("t10_tidy_estimates", S.upto("ana", "name", *RAWS) + """
  SELECT sl, s.sim, s.common_name, l.timegroup, tg_year AS year, round(freq, 8) AS freq, round(se, 8) AS se
  FROM (SELECT DISTINCT sim, common_name FROM raw) s CROSS JOIN labels l
  JOIN (SELECT p_name AS common_name, min(p_partkey) AS sl FROM part GROUP BY 1) o ON o.common_name = s.common_name
  LEFT JOIN raw r ON r.sim = s.sim AND r.common_name = s.common_name AND r.timegroup = l.timegroup""")
def t10(spark, d):
    order = A.species_map(spark, d).select("common_name", F.col("k").alias("sl"))
    out = t.tidy_estimates(t.widen_estimates(fq.raw_trends(spark, d), Y), Y, order)
    return out.drop("tg_no").withColumns({c: F.round(c, 8) for c in ("freq", "se")}).select(
        "sl", "sim", "common_name", "timegroup", "year", "freq", "se")


@query("t11_fit_stats", S.upto("ana", "name", *T) + f"""
  SELECT own.common_name, count(*) AS data_rows FROM own JOIN (SELECT gridg3, month, {ERA} AS era FROM ana) a USING (gridg3, month)
  WHERE era >= min_era GROUP BY 1""")
def t11(spark, d):
    return t.fit_stats(*setup(spark, d), Y)
