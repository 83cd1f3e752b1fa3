import datetime as dt

from pyspark.sql import functions as F

from fieldtrends.config import LUMPED_TAXA, YearInfo, country_bins
from fieldtrends.operators import clean, mistakes

YEARS = YearInfo(2020, country_bins(), tuple(range(2013, 2021)))


def test_date_parts(spark):
    df = spark.createDataFrame([(dt.date(2020, 3, 1),), (dt.date(2020, 6, 30),), (dt.date(2019, 12, 31),)], "obs_date date")
    rows = [tuple(r)[1:] for r in clean.with_date_parts(df).collect()]
    assert rows == [(3, 60, 2020, 2019), (6, 181, 2020, 2020), (12, 365, 2019, 2019)]


def test_year_info_labels():
    assert YEARS.labels == ["before 2000", "2000-2006", "2007-2010", "2011-2012", "2013"] + [str(y) for y in range(2014, 2021)]
    assert YEARS.recent_years == [2015, 2016, 2017, 2018, 2019, 2020] and YEARS.projection_years == list(range(2021, 2028))


def checklist(group, asr=1, protocol="Traveling", km=1.0, minutes=60, n=10, start="07:00:00", line=1):
    return (group, asr, protocol, km, minutes, n, start, line)


def test_completeness_rules(spark):
    rows = [
        checklist("ok"), checklist("far", km=11.0), checklist("fast", km=9.0, minutes=20), checklist("short", minutes=2),
        checklist("zero", minutes=0, n=5), checklist("slow", minutes=200, n=3), checklist("incidental", protocol="Incidental"),
        checklist("nodur", minutes=None, n=3), checklist("nodur4", minutes=None, n=4), checklist("night", start="02:00:00", minutes=60),
        checklist("late", start="21:00:00", minutes=120), checklist("dawn", start="04:30:00", minutes=60), checklist("partial", asr=0),
        checklist("unknown", asr=None), checklist("notime", start=None),
    ]
    cols = "group_id string, all_species_reported int, protocol string, distance_km double, duration_min int, no_sp int, start_time string, line_no int"
    out = clean.check_completeness(spark.createDataFrame(rows, cols), ["line_no"])
    kept = {r.group_id for r in out.filter("all_species_reported = 1").collect()}
    # a missing flag is treated as complete by the source's last branch
    assert kept == {"ok", "nodur4", "dawn", "unknown", "notime"}


def test_dedupe_and_lumping(spark):
    df = spark.createDataFrame(
        [("G1", "Iduna sp.", "slash", 2001, 2), ("G1", "Sykes's Warbler", "species", 2001, 1), ("G2", "Robin", "species", 2030, 1)],
        "group_id string, common_name string, category string, year int, line_no int")
    lumps = spark.createDataFrame(LUMPED_TAXA, "recorded string, kept string, promote boolean")
    out = clean.lump_taxa(df, lumps)
    assert {(r.common_name, r.category) for r in out.collect()} == {("Booted Warbler", "species"), ("Robin", "species")}
    assert [(r.group_id, r.line_no) for r in clean.dedupe_observations(out, 2020, ["line_no"]).collect()] == [("G1", 1)]


def test_vagrants_split_keeps_every_row(spark):
    obs = spark.createDataFrame(
        [("m", 1, 5, y) for y in (2016, 2017)] + [("m", 2, 5, y) for y in range(2010, 2020)] + [("r", 1, 5, 2019), ("m", None, 5, 2019)],
        "common_name string, gridg4 int, month int, year int")
    smap = spark.createDataFrame([("m", "Winter Migrant"), ("r", "Resident")], "common_name string, migratory_status string")
    kept, vagrants = clean.split_vagrants(obs, smap, 3, 2015)
    assert kept.count() + vagrants.count() == obs.count()
    assert sorted((r.gridg4 or 0, r.year) for r in vagrants.collect()) == [(0, 2019), (1, 2016), (1, 2017)]


def test_mistake_rules_with_missing_fields(spark):
    obs = spark.createDataFrame(
        [("S1", "a", "o1", "st", None, 1, 2000, 1.0, 1.0, None), ("S2", "b", "o2", "st", "d1", 5, 2000, 20.0, 1.0, "plain"),
         ("S3", "b", "o2", None, "d2", 5, 2000, 10.0, 1.0, None), ("S4", "c", "bad", "st", "d2", 5, 2000, 10.0, 1.0, None)],
        "event_id string, common_name string, observer_id string, state string, district string, month int, year int, lat double, lon double, region string")
    names = [f.name for f in mistakes.RULE_SCHEMA]

    def rule(**kw):
        return tuple(kw.get(n) for n in names)

    rules = spark.createDataFrame([rule(family="observer", observer_id="bad"), rule(family="place", common_name="b", region="plain"),
                                   rule(family="admin", common_name="a", district="dx")], mistakes.RULE_SCHEMA)
    assert sorted(r.event_id for r in mistakes.remove_mistakes(obs, rules).collect()) == ["S1", "S3"]
    assert sorted(r.event_id for r in mistakes.remove_mistakes(obs, rules, banned=["a"]).collect()) == ["S3"]


def test_mistake_rules_equal_loops(spark):
    """Random rules of all families, some of which look beyond the keys of their family, against loops over rules and rows."""
    import random

    rng, cols = random.Random(4), ["event_id", "common_name", "observer_id", "state", "district", "month", "year", "lat", "lon", "region"]
    some = lambda *v: rng.choice([None, *v])
    rows = [(some("S1", "S2", "S3", "S4"), some("a", "b", "c"), some("o1", "o2", "o3"), some("s", "t"), some("d", "e"), rng.randint(1, 12),
             rng.randint(2000, 2003), some(1.0, 2.0, 3.0), some(1.0, 2.0), some("r")) for _ in range(400)]
    obs = spark.createDataFrame(rows, "event_id string, common_name string, observer_id string, state string, district string, month int, "
                                      "year int, lat double, lon double, region string")
    names = [f.name for f in mistakes.RULE_SCHEMA]
    fields = {"event_id": ["S1", "S2"], "common_name": ["a", "b"], "observer_id": ["o1", "o2"], "state": ["s"], "district": ["d"], "region": ["r"],
              "months": [[1, 2, 3, 4]], "not_months": [[5, 6, 7]], "year_after": [2001], "lat_above": [1.5], "lat_below": [2.5], "lon_above": [1.5], "lon_below": [1.5]}

    def meets(row, rule, driver):
        r = dict(zip(cols, row))
        if rule[driver] is None or r[driver] != rule[driver]:
            return False
        tests = [(c, lambda v, x: v == x) for c in mistakes.EQUAL] + [
            ("months", lambda v, x: v in x), ("not_months", lambda v, x: v not in x), ("year_after", lambda v, x: v > x)] + [
            (f"{c}_above", lambda v, x: v > x) for c in ("lat", "lon")] + [(f"{c}_below", lambda v, x: v < x) for c in ("lat", "lon")]
        return all(rule[f] is None or (r[mistakes.READS[f]] is not None and ok(r[mistakes.READS[f]], rule[f])) for f, ok in tests)

    spread = 0
    for _ in range(4):
        rules = []
        for family, (driver, keys) in mistakes.FAMILIES.items():
            for k in range(2):
                own = [f for f, c in mistakes.READS.items() if c in keys]
                used = {driver, *rng.sample(own, min(2, len(own)))} | ({rng.choice(list(fields))} if k and rng.random() < 0.5 else set())
                rules.append({n: family if n == "family" else rng.choice(fields[n]) if n in used else None for n in names})
                spread += any(mistakes.READS[f] not in keys for f in used)
        gone = set()
        for rule in rules:
            driver, keys = mistakes.FAMILIES[rule["family"]]
            at = [cols.index(c) for c in keys]
            gone |= {(rule["family"], *(row[i] for i in at)) for row in rows if meets(row, rule, driver)}
        kept = [row for row in rows if row[1] != "c" and not any(
            (f, *(row[cols.index(c)] for c in keys)) in gone for f, (_, keys) in mistakes.FAMILIES.items())]
        table = spark.createDataFrame([tuple(r[n] for n in names) for r in rules], mistakes.RULE_SCHEMA)
        got = mistakes.remove_mistakes(obs, table, banned=["c"]).collect()
        assert sorted(map(tuple, got), key=str) == sorted(kept, key=str) and 0 < len(kept) < len(rows)
    assert spread


def test_mistakes_read_the_records_once(spark):
    from fieldtrends.suite import cleaning

    plan = cleaning.c06(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 8


def test_seasons_cover_all_months(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    assert clean.with_season(df).filter("season IS NULL").count() == 0


def test_checklist_ids_do_not_meet(spark):
    from fieldtrends.operators import clean, resample

    ids = spark.createDataFrame([("G5",), ("S1000000005",), ("S5",), ("URN:1",), ("URN:2",)], "group_id string")
    assert ids.select(clean.numeric_group_id(ids.group_id).alias("n")).distinct().count() == 5
    frame = ids.selectExpr("group_id", "'L' AS locality_id", "1 AS month", "'x' AS timegroup")
    got = resample.replicates(frame, 50, 1)
    assert got.count() == 50 and {r["group_id"] for r in got.select("group_id").distinct().collect()} >= {"URN:1", "URN:2"}


def test_ids_that_share_a_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(clean, "numeric_group_id", lambda col: F.coalesce(F.substring(col, 2, 30).try_cast("bigint"), F.lit(21).cast("bigint")))
    rows = [("URN:1",), ("URN:2",), ("S21",), ("G7",)]
    obs = spark.createDataFrame(rows, "group_id string").selectExpr("*", "'a' AS common_name", "'t' AS timegroup", "'obsr12' AS observer_id", "'X' AS obs_count")
    got = {(r.group_no, r.group_text) for r in clean.encode(obs).collect()}
    assert got == {(21, "URN:1"), (21, "URN:2"), (21, None), (7, None)}
