import numpy as np
from pyspark.sql import functions as F

from fieldtrends.config import YearInfo
from fieldtrends.operators import resolve as v

YEARS = YearInfo(2004, (("old", 1999, 1995),), tuple(range(2000, 2005)), recent_from=2000)
# published values of one species: link mean and error, back-transformed limits, percentage of the first point
POINTS = [
    (1992, -2.40201279606556, 0.0886491336131462, 0.0732723742527432, 0.0865581305751081, 0.102117117212543, 100.0),
    (2003, -2.57877977103252, 0.0899242238806829, 0.061626322018607, 0.0730600756962781, 0.0865155095741463, 84.4057920507912),
    (2009, -2.38533595032256, 0.0853675410187315, 0.074919511356115, 0.0879477942990725, 0.103112506411517, 101.605468734977),
]


def test_back_transform_and_baseline_reproduce_published_values(spark):
    rows = [("s", str(y), y, float(m + d * se / np.sqrt(2)), 0.0) for y, m, se, *_ in POINTS for d in (-1, 1)]
    out = v.combine_sims(spark.createDataFrame(rows, "common_name string, timegroup string, year int, freq double, se double"))
    got = {r.year: r for r in v.standardise(out).collect()}
    for y, m, se, lci, mean, rci, std in POINTS:
        r = got[y]
        assert np.allclose([r.mean_trans, r.se_trans, r.lci, r.mean, r.rci, r.mean_std], [m, se, lci, mean, rci, std], rtol=1e-9)


def test_a_missing_simulation_makes_the_point_missing(spark):
    df = spark.createDataFrame([("s", "a", 1, 0.1, 0.1), ("s", "a", 1, None, 0.1)], "common_name string, timegroup string, year int, freq double, se double")
    assert v.combine_sims(df).first().mean_trans is None


def test_slope_matches_a_plain_fit(spark):
    rng = np.random.default_rng(1)
    years = np.arange(2000, 2005)
    y = 0.2 + 0.01 * (years - 2000) + rng.normal(0, 0.004, (6, 5))
    rows = [("s", int(t), y[:, k].tolist(), y[:, k].tolist()) for k, t in enumerate(years)]
    df = spark.createDataFrame(rows, "common_name string, year int, val array<double>, val_sample array<double>")
    got = v.slope_interval(df).first()
    sl, se = [], []
    for sim in range(6):
        x = np.stack([np.ones(5), years - 2000], 1)
        b, res, *_ = np.linalg.lstsq(x, y[sim], rcond=None)
        cov = res[0] / 3 * np.linalg.inv(x.T @ x)
        f = x[:2] @ b
        e = np.sqrt(np.einsum("ij,jk,ik->i", x[:2], cov, x[:2]))
        num, den = f[1] - f[0], abs(f[0])
        sl.append(100 * num / den)
        se.append(num / den * np.hypot(np.hypot(*e) / num, e[0] / den))
    width = np.std(sl, ddof=1) + np.sqrt(np.mean(np.square(se)))
    assert np.allclose([got.currentslopelci, got.currentslopemean, got.currentsloperci],
                       [np.mean(sl) - 1.96 * width, np.mean(sl), np.mean(sl) + 1.96 * width])
    # the projection: a straight line through the logarithms, relative to the simulation's own first value
    ahead = v.project(df, [2006, 2007], 2001).orderBy("year").collect()
    lines = [np.polyfit(years, np.log(y[sim]), 1) for sim in range(6)]
    want = [np.mean([100 * np.exp(np.polyval(line, t)) / y[sim, 1] for sim, line in enumerate(lines)]) for t in (2006, 2007)]
    assert np.allclose([r.mean_ext_std for r in ahead], want)
    assert "Exchange" not in v.ratio_interval(v.with_draw_key(df).select("common_name", "year", *[F.lit(0.1).alias(c) for c in ("mean_trans", "se_trans", "m1", "s1")]), 9, 1)._jdf.queryExecution().executedPlan().toString()
    wide = v.sensitivity_wide(v.slope_sensitivity(df, YEARS.recent_years), YEARS.recent_years)
    assert len(wide.columns) == 1 + 3 * 5 and wide.count() == 1


def test_interval_brackets_the_ratio_and_is_seeded(spark):
    rows = [("s", str(y), y, -2.0 + 0.05 * (y - 2000), 0.05, 0.0, 0.1, 0.2) for y in range(2000, 2005)]
    df = spark.createDataFrame(rows, "common_name string, timegroup string, year int, mean_trans double, se_trans double, lci double, mean double, rci double")
    df = df.withColumn("mean", F.expr("1 - exp(-exp(mean_trans))"))
    std = v.standardise(df)
    a = v.ratio_interval(std, 400, 10).orderBy("year").collect()
    b = v.ratio_interval(std.repartition(3), 400, 10).orderBy("year").collect()
    assert [r.lci_std for r in a] == [r.lci_std for r in b]
    assert all(r.lci_std < r.mean_std < r.rci_std for r in a)
    first = v.zero_baseline_band(v.ratio_interval(std, 400, 10)).filter("year = 2000").first()
    assert first.lci_std == first.mean_std == first.rci_std


def test_missing_simulations_make_a_point_null(spark):
    """A species unseen in one simulation, and one unseen in the latest year."""
    from fieldtrends.operators import resolve, trends

    labels = spark.createDataFrame([("1999", 1999), ("2000", 2000)], "timegroup string, year int")
    rows = [("a", s, g, int(g), 0.1 * s, 0.1) for s in (1, 2) for g in ("1999", "2000")]
    rows += [("b", 1, g, int(g), 0.2, 0.1) for g in ("1999", "2000")] + [("c", s, "1999", 1999, 0.3, 0.1) for s in (1, 2)]
    raw = spark.createDataFrame(rows, "common_name string, sim bigint, timegroup string, year int, freq double, se double")
    full = trends.complete_sims(raw, 2, labels)
    assert full.count() == 3 * 2 * 2
    got = {(r["common_name"], r["year"]): r["mean_trans"] for r in resolve.combine_sims(full).collect()}
    assert got["a", 2000] is not None and got["c", 1999] is not None
    assert got["b", 1999] is None and got["b", 2000] is None and got["c", 2000] is None
