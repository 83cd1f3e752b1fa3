"""Classification (K01-K13) over the species sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrends.operators import classify as c
from fieldtrends.sources import adapters as A
from fieldtrends.suite import tables as S
from fieldtrends.suite.registry import query

M0, M = S.with_(S.MAIN0), S.with_(S.MAIN)
ST = ["long_term_status", "current_status", "range_status", "priority_status"]


@query("k01_long_term_status", M0 + f"SELECT species, {S.LT_CASE} AS long_term_status FROM main0")
def k01(spark, d):
    return c.long_term_status(A.main_table(spark, d)).select("species", "long_term_status")


@query("k02_current_status", M0 + f"SELECT species, {S.CT_CASE} AS current_status FROM main0")
def k02(spark, d):
    return c.current_status(A.main_table(spark, d)).select("species", "current_status")


@query("k03_range_status", M0 + f"SELECT species, {S.RG_CASE} AS range_status FROM main0")
def k03(spark, d):
    m = A.main_table(spark, d)
    return c.range_status(m, A.vagrant_species(m)).select("species", "range_status")


@query("k04_state_range_status", M + """
  SELECT species, CASE WHEN st IS NULL OR st = 'Historical' THEN st ELSE range_status END AS range_status FROM (
    SELECT species, range_status, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'Historical' ELSE 'Restricted' END AS st FROM main)""")
def k04(spark, d):
    nat = A.classified(spark, d)
    st = A.main_table(spark, d).select("species", F.when(F.col("k") % 5 == 0, None).when(F.col("k") % 5 == 1, "Historical")
                                       .otherwise("Restricted").alias("range_status"))
    return c.inherit_range_status(st, nat)


@query("k05_long_term_consensus", M0 + f"""
  , own AS (SELECT species, k, longtermlci, longtermmean, longtermrci, {S.LT_CASE} AS st FROM main0),
  seeds AS (SELECT species, {S.LT_CASE} AS st FROM (SELECT species, seed, longtermlci - seed * (k % 7) AS longtermlci, longtermmean, longtermrci + seed * (k % 5) AS longtermrci
    FROM main0, (SELECT unnest([1, 2, 3, 4, 5]) AS seed) WHERE longtermmean IS NOT NULL)),
  sets AS (SELECT species, list_sort(list_distinct(list(st))) AS s FROM (SELECT species, st FROM own WHERE st <> 'Insufficient Data' UNION ALL SELECT * FROM seeds) GROUP BY 1)
  SELECT species, CASE WHEN s IS NULL OR len(s) = 1 THEN st WHEN len(s) = 2 AND s = ['Increase', 'Rapid Increase'] THEN 'Increase'
    WHEN len(s) = 2 AND s = ['Decline', 'Rapid Decline'] THEN 'Decline' ELSE 'Trend Inconclusive' END AS long_term_status
  FROM own LEFT JOIN sets USING (species)""")
def k05(spark, d):
    main = A.main_table(spark, d)
    seeds = main.filter("longtermmean IS NOT NULL").withColumn("seed", F.explode(F.array(*[F.lit(i) for i in range(1, 6)]))).withColumns({
        "longtermlci": F.col("longtermlci") - F.col("seed") * (F.col("k") % 7),
        "longtermrci": F.col("longtermrci") + F.col("seed") * (F.col("k") % 5)})
    out = c.long_term_consensus(c.long_term_status(main), c.long_term_status(seeds))
    return out.select("species", "long_term_status")


def shifted(i):
    """Slope interval with year i left out: the whole interval moves with the species key."""
    return f"((k * {i}) % 9 - 4) / 4.0"


SENS = "sens AS (" + " UNION ALL ".join(
    f"SELECT species, {i} AS i, currentslopelci + {shifted(i)} AS currentslopelci, currentslopemean + {shifted(i)} AS currentslopemean, "
    f"currentsloperci + {shifted(i)} AS currentsloperci FROM main0" for i in range(1, 5)) + ")"


@query("k06_current_consensus", S.with_(S.MAIN0, SENS) + f"""
  , own AS (SELECT species, {S.CT_CASE} AS st FROM main0),
  alls AS (SELECT species, st, TRUE AS is_main FROM own UNION ALL SELECT species, {S.CT_CASE}, FALSE FROM sens),
  g AS (SELECT species, bool_or(st IN ('Decline', 'Rapid Decline')) AS dec, bool_or(st IN ('Increase', 'Rapid Increase')) AS inc, bool_or(st = 'Stable') AS stb,
    count(*) FILTER (WHERE st = 'Trend Inconclusive') AS n, bool_or(st = 'Decline') AS d1, bool_or(st = 'Increase') AS i1 FROM alls GROUP BY 1)
  SELECT species, CASE WHEN st IN ('Insufficient Data', 'Trend Inconclusive') THEN st WHEN (dec AND (stb OR inc)) OR (inc AND (stb OR dec)) OR n >= 4 THEN 'Trend Inconclusive'
    WHEN st = 'Rapid Decline' AND d1 THEN 'Decline' WHEN st = 'Rapid Increase' AND i1 THEN 'Increase' ELSE st END AS current_status
  FROM own JOIN g USING (species)""")
def k06(spark, d):
    main = A.main_table(spark, d)
    cols = {}
    for i in range(1, 5):
        shift = ((F.col("k") * i) % 9 - 4) / F.lit(4.0)
        cols.update({f"currentslope{x}{i}": F.col(f"currentslope{x}") + shift for x in ("lci", "mean", "rci")})
    dropped = c.sensitivity_statuses(main.withColumns(cols), 4)
    return c.current_consensus(c.current_status(main), dropped).select("species", "current_status")


@query("k07_null_unselected", M + "SELECT species, long_term_status, current_status, range_status FROM main2")
def k07(spark, d):
    m = A.main_table(spark, d)
    out = c.range_status(c.current_status(c.long_term_status(m)), A.vagrant_species(m))
    return c.null_unselected(out).select("species", "long_term_status", "current_status", "range_status")


@query("k08_priority_status", M + "SELECT species, priority_status FROM main")
def k08(spark, d):
    return A.classified(spark, d).select("species", "priority_status")


@query("k09_percent_change", M + """
  SELECT species, longtermlci - 100 AS longtermlci, longtermmean - 100 AS longtermmean, longtermrci - 100 AS longtermrci,
    CASE WHEN long_term_status = 'Insufficient Data' THEN '' ELSE long_term_analysis END AS long_term_analysis,
    CASE WHEN current_status = 'Insufficient Data' THEN '' ELSE current_analysis END AS current_analysis FROM main""")
def k09(spark, d):
    return c.to_percent_change(A.classified(spark, d)).select(
        "species", "longtermlci", "longtermmean", "longtermrci", "long_term_analysis", "current_analysis")


@query("k10_inherit_national", M + """
  SELECT species, 'none' AS mask, past_priority_status, range_status, priority_status FROM main
  UNION ALL SELECT species, 'woodland', NULL, NULL, priority_status FROM main WHERE k % 2 = 0""")
def k10(spark, d):
    nat = A.classified(spark, d)
    both = nat.withColumn("mask", F.lit("none")).unionByName(
        nat.filter("k % 2 = 0").withColumns({"mask": F.lit("woodland"), "priority_status": F.lit("Low")}))
    cols = ["past_priority_status", "range_status"]
    return c.inherit_national(both, nat, cols).select("species", "mask", *cols, "priority_status")


@query("k11_carry_major_statuses", M + """
  SELECT m.species, p.long_term_status AS major_long_term_status, p.current_status AS major_current_status, p.range_status AS major_range_status,
    p.priority_status AS major_priority_status FROM main m LEFT JOIN main p ON p.species = m.species AND m.k % 7 <> 3""")
def k11(spark, d):
    now = A.classified(spark, d)
    old = F.when(F.col("k") % 7 == 0, F.concat(F.lit("old "), "species")).otherwise(F.col("species"))
    tax = now.filter("k % 7 <> 3").select(old.alias("name_old"), F.col("species").alias("name_new"))
    past = now.withColumn("species", old).select("species", *ST)
    return c.carry_major_statuses(now.select("species"), past, tax, "name_old", "name_new").select(
        "species", *[f"major_{x}" for x in ST])


def band(col, value, low, high, width, k):
    return f"({value} - ({low}::DOUBLE)) / ({high}::DOUBLE - ({low}::DOUBLE)) * {width} + ({k})"


@query("k12_band_scale", M + f"""
  SELECT species, round(greatest(least(l, 5), -5), 6) AS longterm_scaled, round(greatest(least(c, 5), -5), 6) AS current_scaled FROM (SELECT species,
    CASE long_term_status WHEN 'Rapid Decline' THEN {band('', 'longtermrci', 0, 50, 2, -5)} WHEN 'Decline' THEN {band('', 'longtermrci', 50, 75, 2, -3)}
      WHEN 'Stable' THEN CASE WHEN longtermmean >= 100 THEN {band('', 'longtermmean', 100, 125, 1, 0)} ELSE {band('', 'longtermmean', 75, 100, 1, -1)} END
      WHEN 'Increase' THEN {band('', 'longtermlci', 125, 150, 2, 1)} WHEN 'Rapid Increase' THEN {band('', 'longtermlci', 150, 200, 2, 3)} END AS l,
    CASE current_status WHEN 'Rapid Decline' THEN {band('', 'currentsloperci', -4.7, -2.7, 2, -5)} WHEN 'Decline' THEN {band('', 'currentsloperci', -2.7, -1.1, 2, -3)}
      WHEN 'Stable' THEN CASE WHEN currentslopemean >= 0 THEN {band('', 'currentslopemean', 0, 0.9, 1, 0)} ELSE {band('', 'currentslopemean', -1.1, 0, 1, -1)} END
      WHEN 'Increase' THEN {band('', 'currentslopelci', 0.9, 1.6, 2, 1)} WHEN 'Rapid Increase' THEN {band('', 'currentslopelci', 1.6, 3.6, 2, 3)} END AS c FROM main)
  """.replace("greatest(least(l, 5), -5)", "CASE WHEN l IS NOT NULL THEN greatest(least(l, 5), -5) END").replace(
      "greatest(least(c, 5), -5)", "CASE WHEN c IS NOT NULL THEN greatest(least(c, 5), -5) END"))
def k12(spark, d):
    out = c.band_scale(A.classified(spark, d))
    return out.select("species", F.round("longterm_scaled", 6).alias("longterm_scaled"), F.round("current_scaled", 6).alias("current_scaled"))


@query("k13_inherit_range_size", M0 + "SELECT species, 'woodland' AS mask, rangelci, rangemean, rangerci FROM main0 WHERE k % 2 = 0")
def k13(spark, d):
    nat = A.main_table(spark, d)
    sub = nat.filter("k % 2 = 0").withColumns({"mask": F.lit("woodland"), "rangemean": F.lit(None).cast("double")})
    return c.inherit_range_size(sub, nat).select("species", "mask", "rangelci", "rangemean", "rangerci")
