"""Occupancy operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrends.functions import portable
from fieldtrends.operators import fits, occupancy as o, spatial
from fieldtrends.session import staged
from fieldtrends.sources import adapters as A
from fieldtrends.suite import tables as S
from fieldtrends.suite.registry import query
from fieldtrends.suite.trend import SEASON

CODES = """codes AS (SELECT common_name, unnest(CASE WHEN migratory_status IN ('Resident','Resident & Altitudinal Migrant') THEN ['R']
    WHEN migratory_status = 'Local Migrant' THEN ['MS','MW'] WHEN migratory_status = 'Summer Migrant & Passage Migrant' THEN ['MP','MS']
    WHEN migratory_status = 'Passage Migrant & Localized Winter Migrant' THEN ['MP','MW'] ELSE ['M'] END) AS status FROM spmap)"""
LAST = "last5 AS (SELECT * FROM ana WHERE year > 1995)"
MONTHS = """months AS (SELECT DISTINCT common_name, status, month FROM last5 JOIN codes USING (common_name)
  WHERE status = 'M' OR (status = 'MS' AND month BETWEEN 5 AND 8) OR (status = 'MW' AND month IN (11,12,1,2)) OR (status = 'MP' AND month IN (9,10,11,3,4,5))
  UNION ALL SELECT common_name, status, m FROM codes, (SELECT unnest(range(1, 13)) AS m) WHERE status = 'R')"""
VISITS = f"""visits AS (SELECT o.common_name, o.status, l.*, {SEASON.replace('month', 'l.month')} AS season, CASE WHEN h.group_id IS NULL THEN 0 ELSE 1 END AS seen,
    CAST(substr(l.group_id, 2) AS BIGINT) + CASE WHEN l.group_id LIKE 'G%' THEN 1000000000000000 ELSE 0 END AS no
  FROM (SELECT DISTINCT m.common_name, m.status, a.gridg3, a.month FROM last5 a JOIN months m ON m.common_name = a.common_name AND m.month = a.month) o
  JOIN (SELECT DISTINCT group_id, gridg3, gridg1, month, no_sp FROM last5 WHERE all_species_reported = 1) l ON l.gridg3 = o.gridg3 AND l.month = o.month
  LEFT JOIN (SELECT DISTINCT group_id, common_name FROM last5) h ON h.group_id = l.group_id AND h.common_name = o.common_name)"""
CAP = """cap AS (SELECT common_name, status, quantile_cont(n, 0.95) AS cap FROM (SELECT common_name, status, gridg1, count(*) AS n FROM visits GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
NUMBERED = f"""numbered AS (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY common_name, status, gridg1
    ORDER BY {portable.sql_hash31('no', '7')}, no) AS visit FROM visits v) JOIN cap USING (common_name, status) WHERE visit <= floor(cap) - 1)"""
PRES = "pres AS (SELECT common_name, status, gridg1, max(seen) AS presence FROM visits GROUP BY 1, 2, 3)"
EDGES = """cells AS (SELECT DISTINCT gridg1 FROM ana), edges AS (SELECT a.gridg1, b.gridg1 AS nb_cell FROM cells a JOIN cells b ON a.gridg1 <> b.gridg1
  AND abs(a.gridg1 // 100000 - b.gridg1 // 100000) <= 1 AND abs(a.gridg1 % 100000 - b.gridg1 % 100000) <= 1)"""
SHARE = """share AS (SELECT p.common_name, p.status, p.gridg1, p.presence, CASE WHEN n_nb > 0 THEN coalesce(n_occ, 0) / n_nb END AS prop_nb FROM pres p
  LEFT JOIN (SELECT gridg1, count(*) AS n_nb FROM edges GROUP BY 1) s ON s.gridg1 = p.gridg1
  LEFT JOIN (SELECT q.common_name, q.status, e.gridg1, count(*) AS n_occ FROM edges e JOIN pres q ON q.gridg1 = e.nb_cell WHERE q.presence = 1 GROUP BY 1, 2, 3) k
    ON k.common_name = p.common_name AND k.status = p.status AND k.gridg1 = p.gridg1)"""
# a simple stand-in for model output, so that O11-O13 can be checked without a fit
PRED = """pred AS (SELECT common_name, status, gridg1, 0.3 * (1 - exp(-no_sp / 7.0)) AS p, sqrt(no_sp) / 300 AS se FROM numbered),
det AS (SELECT common_name, status, gridg1, 1 - product(1 - p) AS det, product(1 - p) AS inv_det, product(1 - p) * sum(se / (1 - p)) AS det_se FROM pred GROUP BY 1, 2, 3),
samples AS (SELECT common_name, status, gridg1, count(*) AS samples FROM numbered GROUP BY 1, 2, 3),
occ AS (SELECT common_name, status, gridg1, prop_nb, 0.1 + 0.6 * coalesce(prop_nb, 0) AS occ, 0.02 + 0.05 * coalesce(prop_nb, 0) AS occ_se FROM share),
cellocc AS (SELECT o.*, det, inv_det, det_se, samples, CASE WHEN presence <> 1 THEN presence ELSE 1 END AS presence, occ * inv_det AS occupancy,
    occ * inv_det * (det_se / inv_det + occ_se / occ) AS se FROM occ o LEFT JOIN det USING (common_name, status, gridg1)
  LEFT JOIN samples USING (common_name, status, gridg1) LEFT JOIN pres USING (common_name, status, gridg1))"""
B = [S.spmap(), CODES, LAST, MONTHS]
V = B + [VISITS]


def base(*more):
    return S.upto("ana", "name", *more)


def records(spark, d):
    return A.analysis_table(spark, d, reuse=True, columns=A.MODEL), o.season_codes(A.species_map(spark, d))


def recent(spark, d):
    ana, codes = records(spark, d)
    return ana, o.recent_years(ana, A.YEARS.latest_year), codes


def all_counts(spark, d, records=None):
    """(records, recent records, codes, visits as counts); ``records`` of ``recent``, if the job has them."""
    ana, last, codes = records or recent(spark, d)
    return ana, last, codes, staged(o.visit_counts(last, codes))


def numbered_visits(spark, d, records=None):
    """(records, visits as counts, capped visits in their order)."""
    ana, last, codes, counts = all_counts(spark, d, records)
    return ana, counts, o.number_visits(last, codes, o.visit_cap(counts), 7)


def rnd(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


@query("o01_season_codes", S.with_(S.spmap(), CODES) + "SELECT * FROM codes")
def o01(spark, d):
    return o.season_codes(A.species_map(spark, d))


@query("o02_filter_migratory", base(*B) + """
  SELECT common_name, status, month, count(*) AS n FROM last5 JOIN months USING (common_name, month) GROUP BY 1, 2, 3""")
def o02(spark, d):
    _, last, codes = recent(spark, d)
    return o.filter_migratory(last, codes).groupBy("common_name", "status", "month").agg(F.count(F.lit(1)).alias("n"))


@query("o03_recent_years", base(LAST) + "SELECT group_id, common_name, year FROM last5")
def o03(spark, d):
    return o.recent_years(A.analysis_table(spark, d), A.YEARS.latest_year).select("group_id", "common_name", "year")


@query("o04_presence_cells", base(*B) + "SELECT DISTINCT common_name, status, gridg1, 1 AS presence FROM last5 JOIN months USING (common_name, month)")
def o04(spark, d):
    _, last, codes = recent(spark, d)
    return o.presence_cells(last, codes)


@query("o05_visit_counts", base(*V) + """
  SELECT common_name, status, gridg1, season, no_sp, count(*) AS trials, CAST(sum(seen) AS BIGINT) AS hits FROM visits GROUP BY 1, 2, 3, 4, 5""")
def o05_counts(spark, d):
    return all_counts(spark, d)[3]


@query("o05_visit_cap", base(*V, CAP) + "SELECT * FROM cap")
def o05(spark, d):
    return o.visit_cap(all_counts(spark, d)[3])


@query("o06_number_visits", base(*V, CAP, NUMBERED) + "SELECT common_name, status, gridg1, group_id, visit, seen FROM numbered")
def o06(spark, d):
    return numbered_visits(spark, d)[2].select("common_name", "status", "gridg1", "group_id", "visit", "seen")


@query("o06_drawn_counts", base(*V, CAP) + """
  SELECT common_name, status, gridg1, CAST(least(n, floor(cap) - 1) AS BIGINT) AS samples, CAST(0 AS BIGINT) AS beyond
  FROM (SELECT common_name, status, gridg1, count(*) AS n FROM visits GROUP BY 1, 2, 3) JOIN cap USING (common_name, status) WHERE floor(cap) > 1""")
def o06_drawn(spark, d):
    """Visits drawn per cell, and bins from which more were drawn than there are (none)."""
    counts = all_counts(spark, d)[3]
    bins = ["common_name", "status", "gridg1", "season", "no_sp"]
    drawn = o.draw_counts(counts, o.visit_cap(counts), 7).join(
        counts.select(*bins, F.col("trials").alias("all"), F.col("hits").alias("all_hits")), bins, "left")
    fits_in = (F.col("hits") <= F.col("all_hits")) & (F.col("trials") - F.col("hits") <= F.col("all") - F.col("all_hits"))
    return drawn.groupBy(*bins[:3]).agg(F.sum("trials").alias("samples"), F.count_if(~F.coalesce(fits_in, F.lit(False))).alias("beyond"))


@query("o07_cell_presence", base(*V, PRES) + "SELECT * FROM pres")
def o07(spark, d):
    return o.cell_presence(all_counts(spark, d)[3])


def shares(ana, counts):
    return o.neighbour_share(o.cell_presence(counts), spatial.queen_neighbours(ana))


@query("o08_neighbour_share", base(*V, PRES, EDGES, SHARE) + "SELECT common_name, status, gridg1, presence, round(prop_nb, 9) AS prop_nb FROM share")
def o08(spark, d):
    ana, _, _, counts = all_counts(spark, d)
    return rnd(shares(ana, counts), prop_nb=9)


@query("o09_detection_history", base(*V, CAP, NUMBERED) + """
  SELECT common_name, status, gridg1, string_agg(CAST(seen AS VARCHAR), '' ORDER BY visit) AS det, string_agg(season, ',' ORDER BY visit) AS seasons,
    string_agg(CAST(no_sp AS VARCHAR), ',' ORDER BY visit) AS lengths, count(*) AS samples FROM numbered GROUP BY 1, 2, 3""")
def o09(spark, d):
    h = o.detection_history(numbered_visits(spark, d)[2])
    return h.select("common_name", "status", "gridg1", F.array_join("det", "").alias("det"), F.array_join("seasons", ",").alias("seasons"),
                    F.array_join("lengths", ",").alias("lengths"), "samples")


def model_input(spark, d, records=None):
    """(counts, drawn counts, neighbour shares): the fit reads no row per visit."""
    ana, _, _, counts = all_counts(spark, d, records)
    return counts, staged(o.draw_counts(counts, o.visit_cap(counts), 7)), staged(shares(ana, counts))


@query("o10_occupancy_model")
def o10(spark, d):
    _, drawn, share = model_input(spark, d)
    model = fits.fit_occupancy(o.history_rows(drawn, share))
    return model.select("common_name", "status", F.round("log_likelihood", 4).alias("log_likelihood"),
                        F.round(F.col("theta")[1], 4).alias("neighbour_effect"), "status_fit")


@query("o10_gradient", base(*V, CAP, NUMBERED, PRES, EDGES, SHARE) + """
  SELECT DISTINCT common_name, status, 0.0::DOUBLE AS gradient FROM numbered JOIN share USING (common_name, status, gridg1) WHERE prop_nb IS NOT NULL""")
def o10_gradient(spark, d):
    """Largest component of the gradient at the coefficients: zero, as every model runs until it has settled."""
    _, drawn, share = model_input(spark, d)
    model = fits.fit_occupancy(o.history_rows(drawn, share))
    return model.select("common_name", "status", F.round("gradient", 3).alias("gradient"))


def fitted(spark, d, records=None):
    """(model, cells): O10 to O12 in a chain."""
    counts, drawn, share = model_input(spark, d, records)
    model = staged(fits.fit_occupancy(o.history_rows(drawn, share)))
    return model, o.fitted_cells(drawn, share, model, o.cell_presence(counts))


@query("o10_fitted_cells")
def o10_cells(spark, d):
    """O11 and O12 from the fit, with its status."""
    model, made = fitted(spark, d)
    out = made.join(model.select("common_name", "status", "status_fit"), ["common_name", "status"])
    return rnd(out, det=5, inv_det=5, det_se=5, occupancy=5, se=5).select(
        "common_name", "status", "gridg1", "samples", "presence", "det", "inv_det", "det_se", "occupancy", "se", "status_fit")


@query("o10_fitted_range_size")
def o10_range(spark, d):
    """O13 from the fit; not_ok counts the season codes of the species whose fit did not settle."""
    made_from = recent(spark, d)
    _, last, codes = made_from
    model, made = fitted(spark, d, made_from)
    out = o.range_size(made, o.presence_cells(last, codes), 625.0)
    state = model.groupBy("common_name").agg(F.count_if(F.col("status_fit") != "ok").alias("not_ok"))
    return rnd(out.join(state, "common_name", "left"), rangelci=4, rangemean=4, rangerci=4)


def stand_in(spark, d, records=None):
    """A formula in place of the fit, for the queries with SQL (O11 to O13); ``fitted`` is the chain itself."""
    ana, counts, numbered = numbered_visits(spark, d, records)
    numbered = staged(numbered)
    pred = numbered.select("common_name", "status", "gridg1", (0.3 * (1 - F.exp(-F.col("no_sp") / 7.0))).alias("p"),
                           (F.sqrt("no_sp") / 300).alias("se"))
    return ana, counts, numbered, o.cell_detection(pred)


@query("o11_cell_detection", base(*V, CAP, NUMBERED, PRES, EDGES, SHARE, PRED) + """
  SELECT common_name, status, gridg1, round(det, 7) AS det, round(inv_det, 7) AS inv_det, round(det_se, 7) AS det_se FROM det""")
def o11(spark, d):
    return rnd(stand_in(spark, d)[3], det=7, inv_det=7, det_se=7)


def cells(spark, d, records=None):
    ana, counts, numbered, det = stand_in(spark, d, records)
    share = shares(ana, counts)
    nb = F.coalesce("prop_nb", F.lit(0.0))
    occ = share.select("common_name", "status", "gridg1", "prop_nb", (0.1 + 0.6 * nb).alias("occ"), (0.02 + 0.05 * nb).alias("occ_se"))
    return o.cell_occupancy(occ, det, o.cell_presence(counts), o.detection_history(numbered))


@query("o12_cell_occupancy", base(*V, CAP, NUMBERED, PRES, EDGES, SHARE, PRED) + """
  SELECT common_name, status, gridg1, samples, presence, round(occupancy, 7) AS occupancy, round(se, 7) AS se FROM cellocc""")
def o12(spark, d):
    return rnd(cells(spark, d), occupancy=7, se=7).select("common_name", "status", "gridg1", "samples", "presence", "occupancy", "se")


@query("o13_range_size", base(*V, CAP, NUMBERED, PRES, EDGES, SHARE, PRED) + """
  , sure AS (SELECT DISTINCT common_name, status, gridg1, 1 AS sure FROM last5 JOIN months USING (common_name, month)),
  parts AS (SELECT common_name, status, CASE WHEN sure = 1 THEN 1.0::DOUBLE ELSE occupancy END AS v, CASE WHEN sure = 1 THEN 0.0::DOUBLE ELSE se END AS e
    FROM (SELECT * FROM cellocc WHERE presence = 0) FULL JOIN sure USING (common_name, status, gridg1)),
  sums AS (SELECT common_name, status, sum(v) AS m, sqrt(sum(e * e)) AS e FROM parts GROUP BY 1, 2),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY common_name ORDER BY m DESC, status DESC) AS rn FROM sums) WHERE rn = 1)
  SELECT common_name, round(greatest(m * 625 - 1.96 * e * 625, 0), 4) AS rangelci, round(m * 625, 4) AS rangemean, round(m * 625 + 1.96 * e * 625, 4) AS rangerci FROM best""")
def o13(spark, d):
    made_from = recent(spark, d)
    _, last, codes = made_from
    out = o.range_size(cells(spark, d, made_from), o.presence_cells(last, codes), 625.0)
    return rnd(out, rangelci=4, rangemean=4, rangerci=4)
