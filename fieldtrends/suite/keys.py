"""Key species per state."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrends.operators import keyspecies as ks, spatial
from fieldtrends.session import staged
from fieldtrends.sources import adapters as A
from fieldtrends.suite import tables as S
from fieldtrends.suite.registry import query

UNC = "('Insufficient Data', 'Trend Inconclusive')"
SHARE = f"""cand AS (SELECT *, species AS common_name FROM main WHERE selected = 'X' AND range_status <> 'Historical' AND (
    (iucn IN ('Critically Endangered','Endangered','Vulnerable') AND priority_status = 'Moderate') OR priority_status = 'High')),
danger AS (SELECT common_name FROM cand WHERE iucn IN ('Critically Endangered','Endangered')),
cells AS (SELECT DISTINCT state, common_name, {S.cell('1')} AS cell FROM deduped WHERE year > 1995 AND common_name IN (SELECT common_name FROM cand)),
share AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY share DESC, current_sort, long_term_sort, rangemean, common_name) AS place FROM (
  SELECT state, c.common_name, count(DISTINCT cell) / max(total) AS share, current_status, CASE WHEN current_status IN {UNC} THEN 1 ELSE 0 END AS current_sort,
    long_term_status, CASE WHEN long_term_status IN {UNC} THEN 1 ELSE 0 END AS long_term_sort, range_status, rangemean
  FROM cells c JOIN (SELECT common_name, count(DISTINCT cell) AS total FROM cells GROUP BY 1) USING (common_name) JOIN cand USING (common_name)
  GROUP BY state, c.common_name, current_status, long_term_status, range_status, rangemean)),
risky AS (SELECT * FROM share WHERE common_name IN (SELECT common_name FROM danger))"""

KEY = """trends AS (SELECT * FROM share WHERE current_sort = 0 OR long_term_sort = 0),
lead0 AS (SELECT *, 0 AS src FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY place) AS r0 FROM trends) WHERE r0 = 1
  UNION ALL SELECT *, 0 AS r0, 1 AS src FROM share WHERE current_sort = 1 AND long_term_sort = 1),
rep1 AS (SELECT state, common_name, share, place FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY share DESC, src, place) AS rn FROM lead0)
  WHERE rn <= CASE WHEN state IN (SELECT state FROM risky) THEN 3 ELSE 4 END),
add1 AS (SELECT state, common_name, share, place FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY share DESC, place) AS rn FROM risky
  WHERE (state, common_name) NOT IN (SELECT state, common_name FROM rep1)) WHERE rn = 1),
rep2 AS (SELECT * FROM rep1 UNION ALL SELECT * FROM add1),
short1 AS (SELECT state, count(*) AS n FROM rep2 GROUP BY 1 HAVING count(*) < 4),
extra AS (SELECT state, common_name, share, place FROM (SELECT t.*, n, row_number() OVER (PARTITION BY state ORDER BY share DESC, place) AS rn FROM trends t JOIN short1 USING (state))
  WHERE rn BETWEEN 2 AND 5 - n),
rep3 AS (SELECT state, common_name, share, place FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY share DESC, src, place) AS rn FROM (
  SELECT *, 0 AS src FROM rep2 UNION ALL SELECT *, 1 AS src FROM extra)) WHERE rn <= 4),
outside AS (SELECT * FROM risky WHERE (state, common_name) NOT IN (SELECT state, common_name FROM rep3)),
rep4 AS (SELECT state, common_name, share, place FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY share DESC, place) AS rn FROM rep3)
  WHERE rn <= CASE WHEN state IN (SELECT state FROM outside) THEN 3 ELSE 4 END),
keysp AS (SELECT * FROM rep4 UNION ALL SELECT state, common_name, share, place FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY share DESC, place) AS rn FROM outside
  WHERE (state, common_name) NOT IN (SELECT state, common_name FROM rep4)) WHERE rn = 1)"""

ROUND = """rpt AS (SELECT common_name FROM keysp WHERE common_name NOT IN (SELECT common_name FROM danger) GROUP BY 1 HAVING count(*) > 1 AND min(share) < 0.35),
worst AS (SELECT common_name, state FROM (SELECT *, row_number() OVER (PARTITION BY common_name ORDER BY share, state) AS rn FROM keysp WHERE common_name IN (SELECT * FROM rpt)) WHERE rn = 1),
lft AS (SELECT * FROM keysp WHERE (state, common_name) NOT IN (SELECT state, common_name FROM worst)),
short2 AS (SELECT state, count(*) AS n FROM lft GROUP BY 1 HAVING count(*) < 4),
refill AS (SELECT state, common_name, share, place FROM (SELECT s.*, n, row_number() OVER (PARTITION BY state ORDER BY share DESC, place) AS rn FROM share s JOIN short2 USING (state)
  WHERE (state, common_name) NOT IN (SELECT state, common_name FROM lft)) WHERE rn BETWEEN 1 AND 4 - n),
round1 AS (SELECT state, common_name, share FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY share DESC, src, place) AS rn FROM (
  SELECT *, 0 AS src FROM lft UNION ALL SELECT *, 1 AS src FROM refill)) WHERE rn <= 4)"""


def setup(spark, d):
    obs = staged(spatial.with_grids(A.deduped(spark, d, "part"), {"gridg1": 1.0}))
    main = staged(A.classified(spark, d))
    return obs, main, staged(ks.range_share(obs, main, A.YEARS.latest_year)), ks.endangered(main)


def base(*more):
    return S.upto("deduped", "part", S.MAIN, SHARE, *more)


OUT = ["state", "common_name", "share"]


def out(df):
    return df.select("state", "common_name", F.round("share", 9).alias("share"))


@query("m11_range_share", base() + "SELECT state, common_name, round(share, 9) AS share, current_sort, long_term_sort, place FROM share")
def m11(spark, d):
    s = setup(spark, d)[2]
    return s.select("state", "common_name", F.round("share", 9).alias("share"), "current_sort", "long_term_sort", "place")


@query("m12_key_species", base(KEY) + "SELECT state, common_name, round(share, 9) AS share FROM keysp")
def m12(spark, d):
    _, _, share, risk = setup(spark, d)
    return out(ks.key_species(share, risk))


@query("m13_reduce_repeats_round", base(KEY, ROUND) + "SELECT state, common_name, round(share, 9) AS share FROM round1")
def m13(spark, d):
    _, _, share, risk = setup(spark, d)
    report = staged(ks.key_species(share, risk))
    return out(ks.one_round(report, share, ks.repeated(report, risk), 1))


@query("m13_reduce_repeats")
def m13b(spark, d):
    _, _, share, risk = setup(spark, d)
    first = staged(ks.key_species(share, risk))
    return out(ks.fill_and_swap(ks.reduce_repeats(first, share, risk), first, share))


@query("m14_overrides", base(KEY) + """
  SELECT DISTINCT state, common_name, round(share, 9) AS share FROM (
    SELECT state, common_name, share FROM keysp WHERE NOT (state = 'NATION_' || (CAST(substr(common_name, 3) AS BIGINT) % 25))
    UNION ALL SELECT a.state, a.common_name, s.share FROM (SELECT 'NATION_' || (k % 25) AS state, common_name FROM cand WHERE one_percent IS NOT NULL) a
      LEFT JOIN share s ON s.state = a.state AND s.common_name = a.common_name)""")
def m14(spark, d):
    _, main, share, risk = setup(spark, d)
    own = F.concat(F.lit("NATION_"), F.col("k") % 25).alias("state")
    drop = main.select(own, F.col("species").alias("common_name"))
    add = ks.candidates(main).filter("one_percent IS NOT NULL").select(own, F.col("species").alias("common_name"))
    return out(ks.apply_overrides(ks.key_species(share, risk), share, add, drop))


EXCEED = """exceed AS (SELECT DISTINCT state, d.common_name FROM deduped d JOIN cand USING (common_name) WHERE year > 1995 AND obs_count <> 'X'
  AND TRY_CAST(obs_count AS BIGINT) >= one_percent)"""


@query("m15_population_exceedance", base(EXCEED) + "SELECT * FROM exceed")
def m15(spark, d):
    obs, main, _, _ = setup(spark, d)
    return ks.population_exceedance(obs, main, A.YEARS.latest_year)


@query("m15_key_species_full", base(KEY, EXCEED) + """
  , bse AS (SELECT state, common_name FROM keysp UNION SELECT * FROM exceed),
  tk AS (SELECT state, count(*) AS n FROM bse GROUP BY 1),
  rest AS (SELECT s.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY s.state ORDER BY share DESC, place) AS rn FROM share s LEFT JOIN tk USING (state)
    WHERE (s.state, s.common_name) NOT IN (SELECT state, common_name FROM bse))
  SELECT state, common_name, round(share, 9) AS share FROM rest WHERE rn <= 20 - n AND share >= 0.035
  UNION ALL SELECT b.state, b.common_name, round(coalesce(share, 0), 9) FROM bse b LEFT JOIN share s ON s.state = b.state AND s.common_name = b.common_name""")
def m15b(spark, d):
    obs, main, share, risk = setup(spark, d)
    exceed = ks.population_exceedance(obs, main, A.YEARS.latest_year)
    return out(ks.key_species_full(share, exceed, ks.key_species(share, risk)))
