"""Plans that must not grow faster than the input, and steps whose memory must not follow it."""

import pyarrow as pa
from pyspark.sql import functions as F

from fieldtrends.functions import positions
from fieldtrends.operators import clean, fits, occupancy as o, reports as r, trends as t
from fieldtrends.plans import frequency
from fieldtrends.sources import adapters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


RECORDS = ("group_id string, common_name string, all_species_reported int, protocol string, duration_min int, distance_km double, "
           "start_time string, year int, line_no int")


def test_clean_chain_shuffles_once(spark):
    rows = [("S1", "a", 1, "Traveling", None, 1.0, "07:00:00", 2000, 1), ("S1", "a", 1, "Traveling", None, 1.0, "07:00:00", 2000, 2),
            ("S1", None, 1, "Traveling", None, 1.0, "07:00:00", 2000, 3), (None, "a", 1, "Traveling", 60, 1.0, "07:00:00", 2000, 1),
            (None, "b", 1, "Traveling", 60, 1.0, "07:00:00", 2000, 2), ("S2", None, 0, "Traveling", 60, 1.0, "07:00:00", 2000, 1)]
    listed = clean.with_list_length(spark.createDataFrame(rows, RECORDS))
    assert sorted((x.group_id or "", x.no_sp) for x in listed.collect()) == [("", 2), ("", 2), ("S1", 1), ("S1", 1), ("S1", 1), ("S2", 0)]
    out = clean.check_completeness(clean.dedupe_observations(listed, 2000, ["line_no"]), ["line_no"])
    assert exchanges(out) == 1
    got = {(x.group_id, x.common_name): x.all_species_reported for x in out.collect()}
    assert got == {("S1", "a"): 0, ("S1", None): 0, (None, "a"): 1, (None, "b"): 1, ("S2", None): 0}


def test_records_meet_their_checklists_last(spark, tmp_path):
    tables = {
        "orders": "SELECT 7L o_orderkey, 5L o_custkey, '3-MEDIUM' o_orderpriority, 9D o_totalprice, DATE'1999-07-01' o_orderdate, 'F' o_orderstatus",
        "lineitem": "SELECT 7L l_orderkey, 3L l_partkey, 1 l_linenumber, 2D l_quantity, 0.01D l_discount, 'N' l_returnflag, 'F' l_linestatus, 5D l_extendedprice",
        "part": "SELECT 3L p_partkey, 'red widget' p_name, 'B' p_brand, 'SMALL' p_type", "nation": "SELECT 5 n_nationkey, 'N' n_name",
    }
    for name, rows in tables.items():
        spark.sql(rows).write.parquet(f"{tmp_path}/{name}.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        obs = adapters.observations(spark, str(tmp_path))
        joins = [line for line in plan(obs).splitlines() if "SortMergeJoin" in line]
        # the outer join comes first: rows leave it by checklist, so the shuffle by checklist packs well
        assert [k for line in joins for k in ("l_orderkey", "l_partkey") if k in line] == ["l_orderkey", "l_partkey"]
        assert [(x.event_id, x.common_name, x.part_no) for x in obs.collect()] == [("S7", "red widget", 3)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_species_are_stored_before_they_meet_the_records(spark, monkeypatch):
    obs = spark.createDataFrame([("S1", "a", "L1", "1", 1, 1, 1, 1998, "1998", 1, 1)], ", ".join(
        f"{c} {k}" for c, k in zip(adapters.MODEL, "string string string string int long int int string long long".split())))
    species = spark.createDataFrame([("a", 0), ("b", 0)], "common_name string, min_era int")
    monkeypatch.setattr(frequency.A, "analysis_table", lambda *_, **__: obs)
    monkeypatch.setattr(frequency, "everything", lambda *_: species)
    given, real = [], t.compress_replicates
    monkeypatch.setattr(frequency.trends, "compress_replicates", lambda ana, sets, w, *a, **k: (given.append(w), real(ana, sets, w, *a, **k))[1])
    got = frequency.raw_trends(spark, "", sims=3).collect()
    assert {x.common_name for x in got} == {"a"} and {x.sim for x in got} == {1, 2, 3}
    assert "Scan parquet" in plan(given[0]) and sorted(map(tuple, given[0].collect())) == [("a", 0), ("b", 0)]


def test_runs_are_merged_not_broadcast(spark):
    cols = "mean lci_std mean_std rci_std lci_std_recent mean_std_recent rci_std_recent".split()
    run = lambda s: spark.range(3).select(
        F.concat(F.lit("a"), "id").alias("common_name"), F.lit(1995).alias("year"), *[(100 + F.col("id") + s).cast("double").alias(c) for c in cols])
    for df in (r.compare_runs(run(0), run(1), 1995), r.yearly_differences(run(0), run(1))):
        assert "Broadcast" not in plan(df) and "SortMergeJoin" in plan(df)
    assert r.compare_runs(run(0), run(1), 1995).count() == 3


VISITS = "group_id string, common_name string, gridg3 long, gridg1 long, month int, no_sp long, all_species_reported int, obs_count string"


def test_numbering_has_no_row_per_species(spark):
    rows = [(f"S{i}", sp, 1, 1 + i % 2, 1 + i % 3, 2, 1, "1") for i in range(40) for sp in (("a", "b") if i % 4 else ("a",))]
    obs = spark.createDataFrame(rows, VISITS)
    codes = spark.createDataFrame([("a", "R"), ("b", "MW"), ("b", "M")], "common_name string, status string")
    caps = codes.withColumn("cap", F.when(F.col("status") == "R", 9.0).otherwise(6.5))
    out = o.number_visits(obs, codes, caps, 7)
    for line in plan(out).splitlines():
        assert not ("Window" in line and "common_name" in line)
    got = out.collect()
    lists = {x[0]: (x[3], x[4]) for x in rows}
    months = {("a", "R"): range(1, 13), ("b", "MW"): (1, 2), ("b", "M"): (1, 2, 3)}
    h = {x.group_id: x.h for x in spark.createDataFrame([(g,) for g in lists], "group_id string").select(
        "group_id", o.portable.hash31(clean.numeric_group_id(F.col("group_id")), 7).alias("h")).collect()}
    present = {(x[0], x[1]) for x in rows}
    want = set()
    for (sp, status), ms in months.items():
        keep = 8 if status == "R" else 5
        for cell in (1, 2):
            order = sorted((g for g, (c, m) in lists.items() if c == cell and m in ms), key=lambda g: (h[g], int(g[1:])))
            want |= {(sp, status, cell, g, i, int((g, sp) in present)) for i, g in enumerate(order[:keep], 1)}
    assert {(x.common_name, x.status, x.gridg1, x.group_id, x.visit, x.seen) for x in got} == want and len(got) == len(want)


def test_sums_are_read_in_slices(monkeypatch):
    n, most = 64, []
    bits = positions.bits_of
    read = lambda column, m: (most.append(len(column)), bits(column, m))[1]
    batches = [pa.RecordBatch.from_pydict({"sims": [b"\xff" * 8] * 50})]
    monkeypatch.setattr(positions, "SLICE", 7)
    assert [b.num_rows for b in positions.slices(batches)] == [7] * 7 + [1]
    for b in positions.slices(batches):
        read(b.column("sims"), n)
    assert max(most) == 7


def test_kinds_read_the_rows_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fits, "staged", lambda df, real=fits.staged: (seen.append(set(df.columns)), real(df))[1])
    rows = spark.createDataFrame([("a", 1, 1, "Win", "1998", 3, 10, 4), ("a", 1, 1, "Win", "1999", 3, 10, 6)],
                                 "common_name string, gridg3 long, gridg1 long, season string, timegroup string, no_sp long, n long, k long")
    choice = spark.createDataFrame([("a", "fixed")], "common_name string, model string")
    fits.fit_chosen(rows, choice, ["1998", "1999"])
    assert {"model", "season", "n", "k"} <= seen[0]
