"""SQL side of the fixtures, written independently of the DataFrame code."""

from __future__ import annotations

from fieldtrends.config import IUCN_ORDER, PAST_TREND_STATUSES, PRIORITY_STATUSES, RANGE_STATUSES, TREND_STATUSES
from fieldtrends.sources.adapters import HABITATS, MIGRATORY, PAST_RANGES, POLYGONS, RANGE_MEANS

SPECIES = {"name": "p_name", "fine": "p_name || ' ' || p_brand", "part": "'SP' || p_partkey"}


def obs(species: str = "name") -> str:
    s = SPECIES[species]
    return f"""obs AS (
  SELECT 'S' || o_orderkey AS event_id, o_orderkey AS event_no,
    CASE WHEN o_orderkey % 10 = 0 THEN 'G' || o_orderkey END AS group_identifier,
    {s} AS common_name, 'Genus ' || {s} AS scientific_name,
    CASE p_type WHEN 'SMALL' THEN 'issf' WHEN 'PROMO' THEN 'slash' ELSE 'species' END AS category,
    CASE WHEN l_linenumber = 7 THEN 'X' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS obs_count,
    'L' || (o_custkey % 211) AS locality_id, n_name AS state,
    n_name || '-' || ((o_custkey % 211) % 3) AS district,
    68 + ((o_custkey % 211) * 7919 % 2900) / 100.0 AS lon,
    8 + ((o_custkey % 211) * 104729 % 2900) / 100.0 AS lat,
    'obsr' || o_custkey AS observer_id, CAST(o_orderdate AS DATE) AS obs_date,
    (240 + (o_orderkey * 53) % 1200) // 60 AS hr, (240 + (o_orderkey * 53) % 1200) % 60 AS mi,
    CASE o_orderpriority WHEN '5-LOW' THEN 'Incidental' WHEN '4-NOT SPECIFIED' THEN 'Historical'
      WHEN '3-MEDIUM' THEN 'Stationary' ELSE 'Traveling' END AS protocol,
    CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 37) % 90 END AS duration_min,
    CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL WHEN o_orderkey % 41 = 0 THEN o_totalprice / 4000
      ELSE o_totalprice / 40000 END AS distance_km,
    CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS all_species_reported,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS reviewed,
    CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS approved,
    CASE CAST(round(l_discount * 100) AS INT) WHEN 10 THEN 'X' WHEN 9 THEN 'P' WHEN 8 THEN 'N' END AS exotic_code,
    l_linenumber AS line_no, l_partkey AS part_no, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN nation ON n_nationkey = (o_custkey % 211) % 25)"""


LISTED = """dated AS (
  SELECT *, coalesce(group_identifier, event_id) AS group_id, month(obs_date) AS month, year(obs_date) AS cyear,
    CASE WHEN month(obs_date) > 5 THEN year(obs_date) ELSE year(obs_date) - 1 END AS year
  FROM obs WHERE (reviewed = 0 OR approved = 1) AND (exotic_code IS NULL OR exotic_code <> 'X')),
listed AS (
  SELECT dated.*, no_sp FROM dated JOIN
    (SELECT group_id, count(DISTINCT common_name) AS no_sp FROM dated GROUP BY group_id) USING (group_id))"""

DEDUPED = """deduped AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY group_id, common_name
    ORDER BY line_no, part_no, price) AS rn FROM listed) WHERE rn = 1 AND year <= 2000)"""

TIMEGROUP = """CASE WHEN year <= 1995 THEN 'before 1996' WHEN year <= 1997 THEN '1996-1997'
    ELSE CAST(year AS VARCHAR) END"""


def cell(size: str) -> str:
    return f"(CAST(floor(lon / {size}) AS BIGINT) * 100000 + CAST(floor(lat / {size}) AS BIGINT))"


GRIDDED = f"""gridded AS (
  SELECT *, {cell('0.25')} AS gridg0, {cell('1')} AS gridg1, {cell('2')} AS gridg2, {cell('4')} AS gridg3,
    {cell('8')} AS gridg4, {TIMEGROUP} AS timegroup
  FROM deduped WHERE distance_km IS NULL OR distance_km <= 50)"""

ANA = """heads AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY line_no, part_no, price) AS rn
    FROM gridded) WHERE rn = 1),
shorts AS (
  SELECT group_id FROM heads WHERE all_species_reported = 1 AND protocol <> 'Incidental'
    AND no_sp <= 3 AND duration_min IS NULL),
ana AS (
  SELECT g.* EXCLUDE (all_species_reported),
    CASE WHEN all_species_reported = 1 AND (
        distance_km > 10 OR g.group_id IN (SELECT group_id FROM shorts)
        OR (duration_min > 0 AND distance_km * 60 / duration_min > 20)
        OR duration_min < 3
        OR (duration_min > 0 AND no_sp * 60.0 / duration_min < 2 AND no_sp <= 3)
        OR protocol = 'Incidental'
        OR (hr <= 4 AND floor((hr * 60 + mi + duration_min) / 60.0) <= 4)
        OR (hr >= 20 AND floor((hr * 60 + mi + duration_min) / 60.0) <= 28)) THEN 0
      WHEN all_species_reported = 0 THEN 0 ELSE 1 END AS all_species_reported
  FROM gridded g)"""

EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{layer}', '{pid}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)"
    for layer, pid, ring in POLYGONS for a, b in zip(ring, ring[1:] + ring[:1])
) + ") t(layer, id, x1, y1, x2, y2))"

# points must be a relation (group_id, lon, lat)
HITS = """hits AS (
  SELECT group_id, layer, id FROM points, edges
  WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
  GROUP BY group_id, layer, id HAVING count(*) % 2 = 1)"""

MASKED = f"""points AS (SELECT group_id, lon, lat FROM (SELECT *, row_number() OVER (
    PARTITION BY group_id ORDER BY line_no, part_no, price) AS rk FROM ana) WHERE rk = 1),
{EDGES},
{HITS},
habitat AS (
  SELECT DISTINCT gridg1, CASE WHEN (gridg1 // 100000) % 2 = 0 THEN 1 ELSE 0 END AS mask_wdl,
    CASE WHEN (gridg1 % 100000) % 2 = 0 THEN 1 ELSE 0 END AS mask_crp,
    CASE WHEN ((gridg1 // 100000) + (gridg1 % 100000)) % 3 = 0 THEN 1 ELSE 0 END AS mask_one FROM ana),
masked AS (
  SELECT a.*, p.pa_name, mask_wdl, mask_crp, mask_one FROM ana a
  LEFT JOIN (SELECT group_id, min(id) AS pa_name FROM hits WHERE layer = 'pa' GROUP BY 1) p USING (group_id)
  LEFT JOIN habitat USING (gridg1)
  WHERE group_id IN (SELECT group_id FROM hits WHERE layer = 'land'))"""


def spmap(species: str = "name") -> str:
    s = SPECIES[species]
    names = "[" + ", ".join(f"'{m}'" for m in MIGRATORY) + "]"
    return f"""spmap AS (
  SELECT common_name, k, 'Genus ' || common_name AS scientific_name,
    {names}[CAST(k % 7 AS INT) + 1] AS migratory_status,
    CASE WHEN k % 9 = 0 THEN 'Nocturnal' ELSE 'Diurnal' END AS breeding_period,
    CASE WHEN k % 9 = 0 THEN 'Nocturnal' ELSE 'Diurnal' END AS nonbreeding_period,
    CASE WHEN k % 5 = 0 THEN 'Mountain' ELSE 'Non-endemic' END AS endemic_region,
    CASE WHEN k % 4 = 0 THEN 1 END AS essential, CASE WHEN k % 23 = 0 THEN 1 END AS discard,
    k % 17 = 0 AS misid, k % 2 = 0 AS woodland, k % 3 = 0 AS openland
  FROM (SELECT {s} AS common_name, min(p_partkey) AS k FROM part GROUP BY 1))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def upto(stage: str, species: str = "name", *more: str) -> str:
    """WITH clause from the raw tables up to a stage, plus further CTEs."""
    chain = [("obs", obs(species)), ("listed", LISTED), ("deduped", DEDUPED), ("gridded", GRIDDED), ("ana", ANA), ("masked", MASKED)]
    names = [n for n, _ in chain]
    return with_(*[text for _, text in chain[: names.index(stage) + 1]], *more)


def pick(values, index: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"[{items}][CAST({index} AS INT) + 1]"


MAIN0 = f"""main0 AS (
  SELECT 'SP' || k AS species, k, 'Genus ' || k AS scientific_name, 'Name ' || k AS checklist_name, p_brand AS order_name, p_type AS grp,
    CASE WHEN k % 13 = 0 THEN '' ELSE 'X' END AS selected,
    CASE WHEN est THEN 'X' ELSE '' END AS long_term_analysis, CASE WHEN est THEN 'X' ELSE '' END AS current_analysis,
    CASE WHEN est THEN lt - lh END AS longtermlci, CASE WHEN est THEN lt END AS longtermmean, CASE WHEN est THEN lt + lh END AS longtermrci,
    CASE WHEN est THEN ct - ch END AS currentslopelci, CASE WHEN est THEN ct END AS currentslopemean, CASE WHEN est THEN ct + ch END AS currentsloperci,
    rg * 0.9::DOUBLE AS rangelci, rg AS rangemean, rg * 1.1::DOUBLE AS rangerci,
    CASE WHEN k % 12 = 0 THEN 1 END AS restricted_islands,
    CASE WHEN k % 97 = 0 THEN 'Extinct' ELSE {pick(IUCN_ORDER, 'k % 6')} END AS iucn,
    CASE WHEN k % 5 = 0 THEN 'Mountain' ELSE 'Non-endemic' END AS endemic_region,
    {pick(HABITATS, 'k % 6')} AS habitat, {pick(MIGRATORY, 'k % 7')} AS migratory_status,
    CASE WHEN k % 9 = 0 THEN k % 40 + 10 END AS one_percent,
    CASE WHEN s % 10 <> 0 THEN {pick(PAST_TREND_STATUSES, 's % 7')} END AS past_long_term_status,
    CASE WHEN s % 10 <> 0 THEN {pick(PAST_TREND_STATUSES, '(s * 3 + 1) % 7')} END AS past_current_status,
    {pick(PAST_RANGES, 's % 6')} AS past_range_status,
    CASE s % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Low' END AS past_priority_status,
    {pick(TREND_STATUSES, '(k * 5 + s) % 7')} AS major_long_term_status, {pick(TREND_STATUSES, '(k * 3 + s) % 7')} AS major_current_status,
    {pick(RANGE_STATUSES, '(k + s) % 6')} AS major_range_status,
    CASE WHEN k % 10 <> 0 THEN {pick(PRIORITY_STATUSES, '(k + s) % 3')} END AS major_priority_status,
    k * 7 % 100 / 100.0 AS share_recent, k * 11 % 250 / 10.0 AS mean5km, k % 30 / 10.0 AS ci5km, 5 + k % 12 AS gen
  FROM (SELECT *, p_partkey AS k, p_size AS s, p_partkey % 11 <> 0 AS est, (20 + p_partkey * 37 % 200)::DOUBLE AS lt, (p_partkey * 13 % 40)::DOUBLE AS lh,
      (p_partkey * 29 % 120) / 10.0::DOUBLE - 6 AS ct, (p_partkey * 7 % 50) / 10.0::DOUBLE AS ch,
      {pick(RANGE_MEANS, 'p_partkey % 7')}::DOUBLE AS rg FROM part))"""

LT_CASE = """CASE WHEN longtermmean IS NULL THEN 'Insufficient Data'
    WHEN (longtermrci - longtermmean) / longtermmean > 0.5 THEN 'Trend Inconclusive' WHEN longtermrci <= 50 THEN 'Rapid Decline'
    WHEN longtermrci <= 75 THEN 'Decline' WHEN longtermlci >= 150 THEN 'Rapid Increase' WHEN longtermlci >= 125 THEN 'Increase'
    WHEN longtermlci > 100 OR longtermrci < 100 THEN 'Trend Inconclusive' WHEN longtermlci <= 50 OR longtermrci >= 150 THEN 'Trend Inconclusive'
    ELSE 'Stable' END"""
CT_CASE = """CASE WHEN currentslopemean IS NULL THEN 'Insufficient Data' WHEN currentsloperci - currentslopelci > 6 THEN 'Trend Inconclusive'
    WHEN currentsloperci <= -2.7::DOUBLE THEN 'Rapid Decline' WHEN currentsloperci <= -1.1::DOUBLE THEN 'Decline' WHEN currentslopelci >= 1.6::DOUBLE THEN 'Rapid Increase'
    WHEN currentslopelci >= 0.9::DOUBLE THEN 'Increase' WHEN currentsloperci < 0 OR currentslopelci > 0 THEN 'Trend Inconclusive' ELSE 'Stable' END"""
RG_CASE = """CASE WHEN rangemean IS NULL THEN NULL WHEN rangemean = 0 AND k % 14 <> 0 THEN 'Historical' WHEN rangerci < 625 THEN 'Very Restricted'
    WHEN restricted_islands IS NULL AND rangerci < 7500 THEN 'Very Restricted' WHEN rangerci < 42500 THEN 'Restricted'
    WHEN rangelci > 1000000 THEN 'Very Large' WHEN rangelci > 250000 THEN 'Large' ELSE 'Moderate' END"""


def points(col: str) -> str:
    return (f"CASE {col} WHEN 'Rapid Decline' THEN 4 WHEN 'Decline' THEN 3 WHEN 'Insufficient Data' THEN 1 WHEN 'Trend Inconclusive' THEN 1 "
            f"WHEN 'Stable' THEN 0 ELSE -1 END")


MAIN = MAIN0 + f""",
main1 AS (SELECT *, {LT_CASE} AS long_term_status, {CT_CASE} AS current_status, {RG_CASE} AS range_status FROM main0),
main2 AS (SELECT * REPLACE (CASE WHEN selected = 'X' THEN long_term_status END AS long_term_status,
    CASE WHEN selected = 'X' THEN current_status END AS current_status, CASE WHEN selected = 'X' THEN range_status END AS range_status) FROM main1),
main3 AS (SELECT *, CASE WHEN long_term_status IS NULL OR current_status IS NULL OR range_status IS NULL THEN NULL
    WHEN range_status = 'Historical' THEN 'Low' WHEN current_status = 'Insufficient Data' AND long_term_status <> 'Insufficient Data' THEN NULL
    WHEN score >= 5 THEN 'High' WHEN score >= 3 THEN 'Moderate' ELSE 'Low' END AS rule FROM (
    SELECT *, {points('long_term_status')} + {points('current_status')} + CASE range_status WHEN 'Very Restricted' THEN 3 WHEN 'Restricted' THEN 2
      WHEN 'Moderate' THEN 1 WHEN 'Very Large' THEN -1 ELSE 0 END AS score FROM main2)),
main AS (SELECT * EXCLUDE (score, rule), CASE WHEN iucn IN ('Extinct in the Wild', 'Extinct') THEN 'Low'
    WHEN unc AND iucn IN ('Endangered', 'Critically Endangered') THEN 'High' WHEN dec AND iucn IN ('Endangered', 'Critically Endangered') THEN 'High'
    WHEN unc AND range_status IN ('Historical', 'Very Restricted', 'Restricted') AND iucn = 'Vulnerable' THEN 'High'
    WHEN unc AND iucn IN ('Near Threatened', 'Vulnerable') AND rule = 'Low' THEN 'Moderate'
    WHEN long_term_status = 'Insufficient Data' AND current_status = 'Insufficient Data' AND endemic_region <> 'Non-endemic' AND rule = 'Low' THEN 'Moderate'
    ELSE rule END AS priority_status FROM (SELECT *,
    long_term_status IN ('Insufficient Data', 'Trend Inconclusive') AND current_status IN ('Insufficient Data', 'Trend Inconclusive') AS unc,
    long_term_status IN ('Decline', 'Rapid Decline') AND current_status IN ('Decline', 'Rapid Decline') AS dec FROM main3))"""
