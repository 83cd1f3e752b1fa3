import numpy as np
from pyspark.sql import functions as F

from fieldtrends.functions import maths, nulls, portable, ranking
from fieldtrends.operators import resample


def test_hash_is_uniform_and_uncorrelated(spark):
    df = spark.range(1, 20001).select(
        portable.uniform(F.col("id"), 1).alias("u"), portable.uniform(F.col("id"), 2).alias("v"),
        portable.normal(F.col("id"), 3).alias("z")).toPandas()
    assert 0 < df.u.min() and df.u.max() < 1
    counts, _ = np.histogram(df.u, bins=20, range=(0, 1))
    assert ((counts - 1000) ** 2 / 1000).sum() < 45
    assert abs(np.corrcoef(df.u, df.v)[0, 1]) < 0.03
    assert abs(np.corrcoef(df.u[:-1], df.u[1:])[0, 1]) < 0.03
    assert abs(df.z.mean()) < 0.03 and abs(df.z.std() - 1) < 0.03


def test_null_rules(spark):
    df = spark.createDataFrame([("X", 1.0), (None, 2.0), ("P", None)], "c string, v double")
    assert {r.c for r in df.filter(nulls.not_in(F.col("c"), ["X"])).collect()} == {None, "P"}
    row = df.agg(nulls.n_distinct_with_null(F.col("c")).alias("n"), nulls.strict_avg(F.col("v")).alias("m")).first()
    assert row.n == 3 and row.m is None
    other = spark.createDataFrame([(None, 7)], "c string, w int")
    assert nulls.null_safe_join(df, other, ["c"], "inner").first().w == 7
    assert nulls.null_safe_join(df, other, ["c"], "left_anti").count() == 2


def test_half_even_rounding(spark):
    r = spark.range(1).select(F.bround(F.lit(2.5), 0), F.bround(F.lit(3.5), 0), F.bround(F.lit(0.125), 2)).first()
    assert list(r) == [2.0, 4.0, 0.12]


def test_cloglog_round_trip_and_errors(spark):
    r = spark.range(1).select(
        maths.inv_cloglog(maths.cloglog(F.lit(0.3))).alias("p"),
        maths.quotient_error(F.lit(2.0), F.lit(4.0), F.lit(0.2), F.lit(0.4)).alias("e")).first()
    assert abs(r.p - 0.3) < 1e-12 and abs(r.e - 0.5 * np.hypot(0.1, 0.1)) < 1e-12


def test_numbering_of_a_hot_group_is_exact(spark):
    df = spark.range(1, 3001).withColumn("g", F.when(F.col("id") <= 2000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 10)))
    out = ranking.number_rows(df, ["g"], F.col("id"), ["id"], size="size").toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part.rn) == list(range(1, len(part) + 1)) and (part["size"] == len(part)).all()


def test_replicates_draw_one_member_per_group(spark):
    rows = [(f"L{i % 3}", f"S{i}", 1 + i % 2, "2000") for i in range(1, 400)]
    frame = spark.createDataFrame(rows, "locality_id string, group_id string, month int, timegroup string")
    reps = resample.replicates(frame, 50, seed=3)
    a = reps.toPandas()
    assert len(a) == 6 * 50 and (a.groupby(["sim", "locality_id", "month"]).size() == 1).all()
    member = {(r[1], r[0], r[2]) for r in rows}
    assert all((g, l, m) in member for g, l, m in zip(a.group_id, a.locality_id, a.month))
    assert a.group_id.nunique() > 150
    b = resample.replicates(frame.repartition(7), 50, seed=3).toPandas()
    key = ["sim", "locality_id", "month", "group_id"]
    assert a.sort_values(key)[key].reset_index(drop=True).equals(b.sort_values(key)[key].reset_index(drop=True))


def test_positions(spark, monkeypatch):
    import numpy as np

    from fieldtrends.functions import positions

    monkeypatch.setattr(positions, "HELD", 3)
    rng, n = np.random.default_rng(4), 21
    rows = [(None if i % 9 == 0 else f"k{i % 9}", i % 2, np.packbits(rng.integers(0, 2, n).astype(np.uint8)).tobytes(), rng.integers(0, 5, n).astype(np.int64).tobytes())
            for i in range(300)]
    df = spark.createDataFrame(rows, "k string, j int, sims binary, w binary").repartition(5)
    want, heavy, either = {}, {}, {}
    for k, j, s, w in rows:
        bits = np.unpackbits(np.frombuffer(s, np.uint8))[:n].astype(np.int64)
        want[k, j] = want.get((k, j), 0) + bits
        heavy[k, j] = heavy.get((k, j), 0) + bits * np.frombuffer(w, np.int64)
        either[k, j] = either.get((k, j), 0) | bits
    got = {(r.k, r.j): np.frombuffer(r.counts, np.int64) for r in positions.summed(df, ["k", "j"], n).collect()}
    assert got.keys() == want.keys() and all((got[x] == want[x]).all() for x in want)
    got = {(r.k, r.j): np.frombuffer(r.counts, np.int64) for r in positions.summed(df, ["k", "j"], n, weights="w").collect()}
    assert all((got[x] == heavy[x]).all() for x in heavy)
    got = {(r.k, r.j): np.unpackbits(np.frombuffer(r.sims, np.uint8))[:n] for r in positions.united(df, ["k", "j"]).collect()}
    assert all((got[x] == either[x]).all() for x in either)
    long = positions.by_replicate(positions.summed(df, ["k", "j"], n, name="a"), ["a"], n).collect()
    assert {(r.k, r.j, r.sim): r.a for r in long} == {(*x, i + 1): c for x, v in want.items() for i, c in enumerate(v.tolist()) if c}
    assert positions.summed(df.limit(0), ["k"], n).count() == 0


def test_seeded_numbers_agree_in_all_forms(spark):
    import numpy as np

    from fieldtrends.functions import portable

    keys = [1, 7, 10 ** 15 + 3, 2 ** 40]
    df = spark.createDataFrame([(keys,)], "k array<bigint>").select("k", portable.uniform_all(F.col("k"), 42).alias("u"), portable.normal_all(F.col("k"), 42).alias("z"))
    row = df.first()
    one = [(r.u, r.z) for r in spark.createDataFrame([(k,) for k in keys], "k bigint").select(
        portable.uniform(F.col("k"), 42).alias("u"), portable.normal(F.col("k"), 42).alias("z")).collect()]
    assert row.u == [u for u, _ in one] and np.allclose(row.z, [z for _, z in one])
    assert portable.uniform_of(np.array(keys), 42).tolist() == row.u
