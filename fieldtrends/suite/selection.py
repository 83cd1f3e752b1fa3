"""Species qualification (Q01-Q16) and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrends.functions import portable, positions
from fieldtrends.operators import fits, qualify as q, resample, spatial
from fieldtrends.sources import adapters as A
from fieldtrends.suite import tables as S
from fieldtrends.suite.places import BY_MASK, FLAGS
from fieldtrends.suite.registry import query

Y = A.YEARS
NL, NR = len(Y.labels), len(Y.recent_years)
LABELS = "labels AS (SELECT * FROM (VALUES ('before 1996', 1, 1995), ('1996-1997', 2, 1997), ('1998', 3, 1998), ('1999', 4, 1999), ('2000', 5, 2000)) t(timegroup, tg_no, tg_year))"
QUAL = "qual AS (SELECT * FROM ana WHERE all_species_reported = 1 AND category IN ('species', 'issf'))"


def all_groups(flag, by, loc, cells, n, cell="gridg3", where="TRUE"):
    return f"""(SELECT common_name, 1 AS {flag} FROM (SELECT common_name, {by} FROM qual WHERE {where} GROUP BY 1, 2
      HAVING count(DISTINCT locality_id) > {loc} AND count(DISTINCT {cell}) > {cells}) GROUP BY 1 HAVING count(*) = {n})"""


HT = "ht AS " + all_groups("ht", "timegroup", 25, 12, NL)
RT = "rt AS " + all_groups("rt", "year", 28, 12, NR, where="year >= 1997")


def flags(spark, d):
    ana = A.analysis_table(spark, d, reuse=True)
    ht = q.qualify_all_groups(ana, "timegroup", NL, 25, 12, "ht", "gridg3")
    rt = q.qualify_all_groups(ana, "year", NR, 28, 12, "rt", "gridg3", Y.recent_start)
    return ana, q.with_flags(A.species_map(spark, d), ht, rt)


FLAGGED = "flagged AS (SELECT * FROM spmap LEFT JOIN ht USING (common_name) LEFT JOIN rt USING (common_name))"
SELECTED = """picked AS (SELECT common_name, ht, rt FROM flagged
  WHERE (essential = 1 OR endemic_region <> 'Non-endemic' OR ht = 1 OR rt = 1)
    AND (breeding_period <> 'Nocturnal' OR nonbreeding_period <> 'Nocturnal') AND discard IS NULL
    AND common_name IN (SELECT common_name FROM ana))"""
SEL = [QUAL, HT, RT, S.spmap(), FLAGGED, SELECTED]


@query("q01_time_bins", S.upto("ana", "name", LABELS) + """
  SELECT timegroup, lists, year FROM labels LEFT JOIN (SELECT timegroup, count(DISTINCT group_id) AS lists,
    CAST(round_even(median(year), 0) AS INT) AS year FROM ana WHERE all_species_reported = 1 GROUP BY 1) USING (timegroup)""")
def q01(spark, d):
    return q.time_bins(A.analysis_table(spark, d), Y)


@query("q01_time_bins_by_mask", S.upto("masked", "name", BY_MASK, LABELS) + """
  SELECT mask, timegroup, lists, year FROM (SELECT DISTINCT mask FROM bymask) CROSS JOIN labels
  LEFT JOIN (SELECT mask, timegroup, count(DISTINCT group_id) AS lists,
    CAST(round_even(median(year), 0) AS INT) AS year FROM bymask WHERE all_species_reported = 1 GROUP BY 1, 2) USING (mask, timegroup)""")
def q01b(spark, d):
    return q.time_bins(spatial.apply_mask(A.masked(spark, d), FLAGS), Y, ["mask"])


@query("q02_sampling_frame", S.upto("ana") + """
  SELECT DISTINCT locality_id, group_id, month, timegroup FROM ana WHERE all_species_reported = 1""")
def q02(spark, d):
    return q.sampling_frame(A.analysis_table(spark, d))


@query("q03_long_term_qualifiers", S.upto("ana", "name", QUAL, HT) + "SELECT * FROM ht")
def q03(spark, d):
    return q.qualify_all_groups(A.analysis_table(spark, d), "timegroup", NL, 25, 12, "ht", "gridg3")


@query("q04_recent_qualifiers", S.upto("ana", "name", QUAL, RT) + "SELECT * FROM rt")
def q04(spark, d):
    return q.qualify_all_groups(A.analysis_table(spark, d), "year", NR, 28, 12, "rt", "gridg3", Y.recent_start)


def cand(name, n, where="TRUE"):
    return f"""{name} AS (SELECT common_name FROM (SELECT common_name, timegroup FROM qual WHERE {where} GROUP BY 1, 2
      HAVING count(DISTINCT gridg3) <= 4) GROUP BY 1 HAVING count(*) = {n})"""


# the time groups of the recent years are the last bin and the three single years
CH, CR = cand("ch", NL), cand("cr", NR, "year >= 1997")


@query("q05_restricted_long_term", S.upto("ana", "fine", QUAL, CH) + "SELECT * FROM ch")
def q05(spark, d):
    return q.restricted_candidates(A.analysis_table(spark, d, "fine"), NL, 4, "gridg3")


@query("q06_restricted_recent", S.upto("ana", "fine", QUAL, CR) + "SELECT * FROM cr")
def q06(spark, d):
    return q.restricted_candidates(A.analysis_table(spark, d, "fine"), NR, 4, "gridg3", Y.recent_start)


def valid(name, flag, src, n, lists, where="TRUE"):
    return f"""{name} AS (SELECT common_name, 1 AS {flag} FROM (
      SELECT c.common_name, a.timegroup FROM (SELECT DISTINCT common_name, gridg1 FROM ana WHERE common_name IN (SELECT common_name FROM {src})) c
      JOIN ana a USING (gridg1) WHERE {where} GROUP BY 1, 2 HAVING count(DISTINCT group_id) > {lists}) GROUP BY 1 HAVING count(*) = {n})"""


VH, VR = valid("vh", "ht", "ch", NL, 60), valid("vr", "rt", "cr", NR, 60, "a.year >= 1997")


def restricted(spark, d):
    ana = A.analysis_table(spark, d, "fine", reuse=True)
    ch = q.restricted_candidates(ana, NL, 4, "gridg3")
    cr = q.restricted_candidates(ana, NR, 4, "gridg3", Y.recent_start)
    vh = q.restricted_valid(ch, ana, 60, NL, "ht")
    vr = q.restricted_valid(cr, ana, 60, NR, "rt", from_year=Y.recent_start)
    return ana, vh, vr


@query("q07_restricted_valid", S.upto("ana", "fine", QUAL, CH, CR, VH, VR) + """
  SELECT common_name, ht, rt FROM vh FULL JOIN vr USING (common_name)""")
def q07(spark, d):
    _, vh, vr = restricted(spark, d)
    return vh.join(vr, "common_name", "full")


@query("q08_species_list", S.upto("ana", "name", *SEL) + "SELECT * FROM picked")
def q08(spark, d):
    ana, fl = flags(spark, d)
    return q.species_list(fl, ana)


@query("q08_species_list_state", S.upto("ana", "name", *SEL) + """
  SELECT common_name, ht, rt FROM flagged WHERE (common_name IN (SELECT common_name FROM picked) OR ht = 1 OR rt = 1)
    AND (breeding_period <> 'Nocturnal' OR nonbreeding_period <> 'Nocturnal' OR common_name = 'red widget') AND discard IS NULL
    AND common_name IN (SELECT common_name FROM ana WHERE state = 'NATION_3')""")
def q08b(spark, d):
    ana, fl = flags(spark, d)
    nat = q.species_list(fl, ana)
    return q.species_list(fl, ana.filter("state = 'NATION_3'"), nat, ["red widget"])


@query("q09_null_out", S.upto("ana", "name", *SEL) + """
  SELECT common_name, CASE WHEN NOT misid AND woodland THEN p.ht END AS ht, CASE WHEN NOT misid AND woodland THEN p.rt END AS rt
  FROM picked p JOIN spmap USING (common_name)""")
def q09(spark, d):
    ana, fl = flags(spark, d)
    m = A.species_map(spark, d)
    listed = q.null_out(q.species_list(q.null_out_nocturnal(fl), ana), m.filter("misid"))
    return q.null_out(listed, m.filter("woodland"), keep=True)


@query("q10_qualification_counts", S.upto("ana", "name", *SEL) + """
  SELECT count(*) FILTER (WHERE ht = 1 OR rt = 1) AS by_data,
    count(*) FILTER (WHERE ht = 1 OR rt = 1 OR endemic_region <> 'Non-endemic') AS plus_endemic,
    count(*) FILTER (WHERE ht = 1 OR rt = 1 OR endemic_region <> 'Non-endemic' OR essential = 1) AS plus_essential
  FROM flagged WHERE breeding_period <> 'Nocturnal' OR nonbreeding_period <> 'Nocturnal'""")
def q10(spark, d):
    return q.qualification_counts(flags(spark, d)[1])


@query("q11_restricted_list", S.upto("ana", "fine", QUAL, CH, CR, VH, VR, S.spmap("fine")) + """
  SELECT common_name, CASE WHEN NOT misid THEN ht END AS ht, CASE WHEN NOT misid THEN rt END AS rt,
    CASE WHEN n > 7 THEN 1 ELSE 0 END AS mixed
  FROM (SELECT * FROM vh FULL JOIN vr USING (common_name)) JOIN spmap USING (common_name)
  JOIN (SELECT common_name, count(DISTINCT gridg1) AS n FROM ana WHERE all_species_reported = 1 GROUP BY 1) USING (common_name)""")
def q11(spark, d):
    ana, vh, vr = restricted(spark, d)
    m = A.species_map(spark, d, "fine")
    return q.restricted_list(m, vh, vr, ana, m.filter("misid"))


@query("t07_model_choice", S.upto("ana", "fine", QUAL, CH, CR, VH, VR, S.spmap("fine")) + """
  SELECT m.common_name, CASE WHEN r.n IS NULL THEN 'nested' WHEN r.n > 7 THEN 'single' ELSE 'fixed' END AS model
  FROM (SELECT DISTINCT common_name FROM spmap) m LEFT JOIN (SELECT common_name, n FROM (SELECT * FROM vh FULL JOIN vr USING (common_name))
    JOIN (SELECT common_name, count(DISTINCT gridg1) AS n FROM ana WHERE all_species_reported = 1 GROUP BY 1) USING (common_name)) r USING (common_name)""")
def model_choice(spark, d):
    """The model that the restricted list (Q11) chooses for every species."""
    return fits.model_choice(A.species_map(spark, d, "fine"), q11(spark, d))


@query("q12_species_sheet", S.upto("ana", "name", *SEL) + """
  SELECT f.common_name, f.scientific_name, CASE WHEN f.ht = 1 OR f.endemic_region <> 'Non-endemic' THEN 'X' ELSE '' END AS long_term_analysis,
    CASE WHEN f.rt = 1 THEN 'X' ELSE '' END AS current_analysis,
    CASE WHEN f.common_name IN (SELECT common_name FROM picked) THEN 'X' ELSE '' END AS selected FROM flagged f""")
def q12(spark, d):
    ana, fl = flags(spark, d)
    extra = A.species_map(spark, d).filter("endemic_region <> 'Non-endemic'").select(
        "common_name", F.lit(1).alias("ht"), F.lit(None).cast("int").alias("rt"))
    return q.species_sheet(fl, q.species_list(fl, ana), extra)


@query("q13_range_coverage", S.upto("ana", "name", "f AS (SELECT * FROM ana WHERE all_species_reported = 1)") + """
  SELECT t.common_name, total_range, round(a.n / total_range, 8) AS share_first, round(r.n / total_range, 8) AS share_recent,
    round(l.n / total_range, 8) AS share_latest
  FROM (SELECT common_name, count(DISTINCT gridg1) AS total_range FROM f GROUP BY 1) t
  LEFT JOIN (SELECT common_name, count(DISTINCT gridg1) AS n FROM f WHERE timegroup = 'before 1996' GROUP BY 1) a USING (common_name)
  LEFT JOIN (SELECT common_name, count(DISTINCT gridg1) AS n FROM f WHERE timegroup = '2000' GROUP BY 1) l USING (common_name)
  LEFT JOIN (SELECT common_name, avg(n) AS n FROM (SELECT common_name, timegroup, count(DISTINCT gridg1) AS n FROM f
    WHERE timegroup IN ('1997', '1998', '1999', '2000') GROUP BY 1, 2) GROUP BY 1) r USING (common_name)""")
def q13(spark, d):
    out = q.range_coverage(A.analysis_table(spark, d), Y)
    return out.select("common_name", "total_range", *[F.round(c, 8).alias(c) for c in ("share_first", "share_recent", "share_latest")])


@query("q14_cell_sampling", S.upto("ana", "name", "f AS (SELECT * FROM ana WHERE all_species_reported = 1)") + """
  SELECT common_name, round(avg(n), 8) AS mean5km, round(1.96 * stddev_samp(n) / sqrt(count(n)), 8) AS ci5km
  FROM (SELECT DISTINCT common_name, gridg1 FROM f) JOIN (SELECT gridg1, count(DISTINCT gridg0) AS n FROM f GROUP BY 1) USING (gridg1)
  GROUP BY common_name""")
def q14(spark, d):
    out = q.cell_sampling(A.analysis_table(spark, d))
    return out.select("common_name", F.round("mean5km", 8).alias("mean5km"), F.round("ci5km", 8).alias("ci5km"))


def name_versions(spark, d):
    """Two taxonomies of the fine names: every 7th is renamed, every 31st is merged into the plain name."""
    m = A.species_map(spark, d, "fine").select("common_name", "k")
    base = F.split("common_name", " ")
    new = F.when(F.col("k") % 31 == 0, F.concat_ws(" ", base[0], base[1])).when(
        F.col("k") % 7 == 0, F.concat(F.lit("new "), "common_name")).otherwise(F.col("common_name"))
    return m.select("k", F.col("common_name").alias("name_old"), new.alias("name_new"))


@query("q15_update_taxonomy", S.with_(S.spmap("fine")) + """
  SELECT name_new AS common_name, k, ht FROM (SELECT *, row_number() OVER (PARTITION BY name_new ORDER BY k) AS rn FROM (
    SELECT k, CASE WHEN k % 2 = 0 THEN 1 END AS ht, CASE WHEN k % 31 = 0 THEN split_part(common_name, ' ', 1) || ' ' || split_part(common_name, ' ', 2)
      WHEN k % 7 = 0 THEN 'new ' || common_name ELSE common_name END AS name_new FROM spmap)) WHERE rn = 1""")
def q15(spark, d):
    v = name_versions(spark, d)
    listed = v.select(F.concat(F.lit("old "), "name_old").alias("common_name"), "k", F.when(F.col("k") % 2 == 0, 1).alias("ht"))
    recode = v.select(F.concat(F.lit("old "), "name_old").alias("recorded"), F.col("name_old").alias("kept"))
    return q.update_taxonomy(listed, v, "name_old", "name_new", recode, ["k"])


@query("q16_runnable_masks", S.upto("masked", "name", BY_MASK) + """
  SELECT mask, coalesce(max(n) >= 30, FALSE) AS runnable FROM (
    SELECT mask, common_name, count(DISTINCT locality_id) AS n FROM bymask WHERE all_species_reported = 1 GROUP BY 1, 2) GROUP BY 1""")
def q16(spark, d):
    obs = q.complete_lists(spatial.apply_mask(A.masked(spark, d), FLAGS))
    n = obs.groupBy("mask", "common_name").agg(F.count_distinct("locality_id").alias("n"))
    listed = n.select("mask", F.when(F.col("n") >= 30, 1).alias("ht"), F.lit(None).cast("int").alias("rt"))
    return q.has_runnable(listed)


# ------------------------------------------------------------------ resampling
FRAME = """frame AS (SELECT DISTINCT locality_id, group_id, month, timegroup, locality_id || '|' || month || '|' || timegroup AS g,
    CAST(substr(group_id, 2) AS BIGINT) + CASE WHEN group_id LIKE 'G%' THEN 1000000000000000 ELSE 0 END AS no FROM ana WHERE all_species_reported = 1)"""
NUMBERED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY locality_id, month, timegroup ORDER BY no % 32, no) AS rn,
    count(*) OVER (PARTITION BY locality_id, month, timegroup) AS size,
    min(no) OVER (PARTITION BY locality_id, month, timegroup) AS gkey FROM frame)"""
NSIM = 1000
REPS = f"""reps AS (SELECT s.sim, n.locality_id, n.month, n.timegroup, n.group_id FROM numbered n
  JOIN (SELECT unnest(range(1, {NSIM + 1})) AS sim) s ON n.rn = 1 + CAST(floor({portable.sql_uniform('n.gkey * 4099 + s.sim', '42')} * n.size) AS BIGINT))"""


@query("r01_sample_one", S.upto("ana", "name", FRAME) + f"""
  SELECT locality_id, month, timegroup, group_id FROM (SELECT *, row_number() OVER (
    PARTITION BY locality_id, month, timegroup ORDER BY {portable.sql_hash31('no', '42')}, no) AS rn FROM frame) WHERE rn = 1""")
def r01(spark, d):
    return resample.sample_one(q.sampling_frame(A.analysis_table(spark, d)), seed=42)


@query("r02_replicates", S.upto("ana", "name", FRAME, NUMBERED, REPS) + """
  SELECT locality_id, month, timegroup, group_id, count(*)::INTEGER AS times, md5(string_agg(sim::VARCHAR, ',' ORDER BY sim)) AS sims FROM reps GROUP BY 1, 2, 3, 4""")
def r02(spark, d):
    """The replicates that drew each checklist: their number and a digest of the list."""
    sets = resample.replicate_sets(q.sampling_frame(A.analysis_table(spark, d)), NSIM, seed=42)
    drawn = resample.replicate_numbers(sets, NSIM)
    return drawn.select("locality_id", "month", "timegroup", "group_id", F.size("sims").alias("times"),
                        F.md5(F.array_join(F.transform("sims", lambda x: x.cast("string")), ",")).alias("sims"))


@query("r03_apply_replicates", S.upto("ana", "name", FRAME, NUMBERED, REPS) + """
  SELECT sim, common_name, a.timegroup, count(*) AS n FROM ana a JOIN reps USING (group_id) GROUP BY 1, 2, 3""")
def r03(spark, d):
    ana = A.analysis_table(spark, d, reuse=True)
    sets = resample.replicate_sets(q.sampling_frame(ana), NSIM, seed=42)
    counts = positions.summed(resample.apply_sets(ana, sets), ["common_name", "timegroup"], NSIM, name="n")
    return positions.by_replicate(counts, ["n"], NSIM)
