import numpy as np
from pyspark.sql import functions as F

from fieldtrends.config import YearInfo
from fieldtrends.session import staged
from fieldtrends.operators import fits, trends
from fieldtrends.plans import frequency as fq
from fieldtrends.sources import adapters as A

D = "/root/testdata/sf0.001"
GROUPS = ["a", "b", "c"]
SEASONS = ["Aut", "Mon", "Sum", "Win"]


def simulate(rng, sd_outer=0.0, sd_cell=0.0, outers=30, cells=6):
    level = dict(zip(SEASONS, (-1.6, -1.2, -1.4, -1.0)))
    slope, time = 0.35, dict(zip(GROUPS, (0.0, 0.4, -0.5)))
    rows = []
    for o in range(outers):
        vo = rng.normal(0, sd_outer)
        for c in range(cells):
            u = vo + rng.normal(0, sd_cell)
            for s in SEASONS:
                for g in GROUPS:
                    for length in (3, 8, 20):
                        p = 1 - np.exp(-np.exp(level[s] + slope * np.log(length) + time[g] + u))
                        n = 8
                        rows.append(("sp", o, o * 100 + c, s, g, length, n, int(rng.binomial(n, p))))
    return rows


SCHEMA = "common_name string, gridg3 long, gridg1 long, season string, timegroup string, no_sp long, n long, k long"


def coef(model):
    r = model.first()
    return dict(zip(r["terms"], r["coef"])), r


def test_fixed_model_recovers_and_agrees_with_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    df = spark.createDataFrame(simulate(np.random.default_rng(1)), SCHEMA)
    b, row = coef(fits.fit_glm(df, GROUPS))
    assert row["status"] == "ok"
    assert abs(b["time:b"] - 0.4) < 0.1 and abs(b["time:c"] + 0.5) < 0.1 and abs(b["season:Win"] + 1.0) < 0.2
    x = df.groupBy("season", "timegroup", "no_sp").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    log = F.log("no_sp")
    cols = {f"s{s}": (F.col("season") == s).cast("double") for s in SEASONS}
    cols |= {f"l{s}": F.when(F.col("season") == s, log).otherwise(0.0) for s in SEASONS}
    cols |= {f"t{g}": (F.col("timegroup") == g).cast("double") for g in GROUPS[1:]}
    x = x.withColumns(cols).withColumns({"y": F.col("k") / F.col("n"), "w": F.col("n").cast("double")})
    x = VectorAssembler(inputCols=list(cols), outputCol="features").transform(x)
    ml = GeneralizedLinearRegression(family="binomial", link="cloglog", labelCol="y", weightCol="w", fitIntercept=False, tol=1e-10).fit(x)
    ours = [b[f"season:{s}"] for s in SEASONS] + [b[f"length:{s}"] for s in SEASONS] + [b[f"time:{g}"] for g in GROUPS[1:]]
    assert np.allclose(ours, ml.coefficients.toArray(), atol=1e-4)


def test_mixed_model_recovers_variances(spark):
    df = spark.createDataFrame(simulate(np.random.default_rng(2), 0.6, 0.4), SCHEMA)
    b, row = coef(fits.fit_glmm(df, GROUPS))
    assert row["status"] == "ok"
    assert abs(row["sd_outer"] - 0.6) < 0.25 and abs(row["sd_cell"] - 0.4) < 0.2
    assert abs(b["time:b"] - 0.4) < 0.12 and abs(b["time:c"] + 0.5) < 0.12 and b["time:a"] == 0.0


def test_occupancy_recovers(spark):
    rng = np.random.default_rng(3)
    rows = []
    for cell in range(600):
        nb = rng.uniform()
        there = rng.uniform() < 1 / (1 + np.exp(-(-1.0 + 2.5 * nb)))
        for v in range(8):
            length = int(rng.integers(2, 30))
            p = 1 / (1 + np.exp(-(-1.5 + 0.5 * np.log(length))))
            rows.append(("sp", "MW", cell, float(nb), "Win", length, int(there and rng.uniform() < p)))
    h = spark.createDataFrame(rows, "common_name string, status string, gridg1 long, prop_nb double, season string, no_sp int, seen int")
    r = fits.fit_occupancy(h).first()
    assert r.status_fit == "ok"
    assert abs(r.theta[0] + 1.0) < 0.5 and abs(r.theta[1] - 2.5) < 0.9
    assert abs(r.theta[2] + 1.5) < 0.4 and abs(r.theta[6] - 0.5) < 0.15


def test_fit_to_range_size(spark):
    """The chain O10 to O13 against loops: the likelihood multiplied out, its curvature by differences, sums per cell."""
    from fieldtrends.operators import occupancy as o

    rng, rows = np.random.default_rng(8), []
    for status, cells in (("MW", 120), ("R", 160)):
        for cell in range(cells):
            nb, there = float(rng.uniform()), rng.uniform() < 0.6
            for visit in range(1, 6):
                length, season = int(rng.integers(2, 30)), SEASONS[int(rng.integers(4))]
                rows.append(("sp", status, cell, nb, season, length, int(there and rng.uniform() < 0.1 + 0.01 * length), visit))
    v = spark.createDataFrame(rows, "common_name string, status string, gridg1 long, nb double, season string, no_sp int, seen int, visit int")
    share = v.select("common_name", "status", "gridg1", F.col("nb").alias("prop_nb")).distinct()
    seen = v.groupBy("common_name", "status", "gridg1").agg(F.max("seen").alias("presence"))
    model = staged(fits.fit_occupancy(o.history_rows(v, share)))
    sure = v.filter("seen = 1 AND status = 'MW'").select("common_name", "status", "gridg1")
    made = {(r.status, r.gridg1): r for r in o.fitted_cells(v, share, model, seen).collect()}
    size = o.range_size(o.fitted_cells(v, share, model, seen), sure, 625.0).first()

    def sig(x):
        return 1 / (1 + np.exp(-x))

    sums = {}
    for m in model.collect():
        assert m.status_fit == "ok"
        by_cell = {}
        for _, s, c, nb, season, length, hit, _ in rows:
            if s == m.status:
                by_cell.setdefault(c, (nb, []))[1].append((SEASONS.index(season) if s == "R" else 0, np.log(length), hit))

        def likelihood(t):
            total = 0.0
            for nb, visits in by_cell.values():
                psi, q = sig(t[0] + t[1] * nb), 1.0
                for k, x, hit in visits:
                    p = sig(t[2 + k] + t[6 + k] * x)
                    q *= p if hit else 1 - p
                total += np.log(psi * q + (1 - psi) * (not any(h for _, _, h in visits)))
            return total

        theta = np.array(m.theta)
        on = list(range(10)) if m.status == "R" else [0, 1, 2, 6]
        e = 1e-3 * np.eye(10)
        grad = [(likelihood(theta + e[i]) - likelihood(theta - e[i])) / 2e-3 for i in on]
        assert np.abs(grad).max() < 1e-2 and abs(likelihood(theta) - m.log_likelihood) < 1e-2
        hess = [[(likelihood(theta + e[i] + e[k]) - likelihood(theta + e[i] - e[k]) - likelihood(theta - e[i] + e[k]) + likelihood(theta - e[i] - e[k])) / 4e-6
                 for k in on] for i in on]
        cov = np.zeros((10, 10))
        cov[np.ix_(on, on)] = np.linalg.inv(-np.array(hess))
        for c, (nb, visits) in by_cell.items():
            inv, ratio = 1.0, 0.0
            for k, x, _ in visits:
                p, a = sig(theta[2 + k] + theta[6 + k] * x), np.zeros(10)
                a[2 + k], a[6 + k] = 1, x
                inv, ratio = inv * (1 - p), ratio + p * np.sqrt(a @ cov @ a)
            a = np.array([1, nb] + [0] * 8)
            occ = sig(theta[0] + theta[1] * nb)
            value, err = occ * inv, occ * inv * (ratio + (1 - occ) * np.sqrt(a @ cov @ a))
            got, hit = made[m.status, c], any(h for _, _, h in visits)
            assert np.allclose([got.inv_det, got.occupancy, got.se], [inv, value, err], rtol=2e-2, atol=1e-6)
            assert (got.presence, got.samples) == (int(hit), 5)
            if hit and m.status == "MW":
                value, err = 1.0, 0.0
            if not hit or m.status == "MW":
                mean, square = sums.get(m.status, (0.0, 0.0))
                sums[m.status] = (mean + value, square + err * err)
    mean, square = max(sums.values())
    half = 1.96 * np.sqrt(square)
    assert np.allclose([size.rangelci, size.rangemean, size.rangerci], [625 * max(mean - half, 0), 625 * mean, 625 * (mean + half)], rtol=1e-2)


def test_compressed_rows_equal_grouped_expansion(spark):
    ana = A.analysis_table(spark, D, reuse=True)
    win = fq.windows_for(spark, D)
    keys = ["common_name", "gridg3", "gridg1", "season", "timegroup", "no_sp"]
    a = trends.compress(ana, win, A.YEARS)
    b = trends.expand_absences(ana, win, A.YEARS).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("seen").alias("k"))
    assert a.count() == b.count() and a.select(*keys, "n", "k").subtract(b.select(*keys, "n", "k")).isEmpty()


def test_prediction_matches_coefficients(spark):
    df = spark.createDataFrame(simulate(np.random.default_rng(1)), SCHEMA)
    model = fits.fit_glm(df, GROUPS)
    b, row = coef(model)
    grid = trends.prediction_grid(df, spark.createDataFrame([("sp", 8)], "common_name string, typical_length long"))
    pred = {(r.season, r.timegroup): (r.fit, r.err) for r in trends.predict_fixed(grid, model).collect()}
    assert len(pred) == 12
    want = b["season:Sum"] + b["length:Sum"] * np.log(8) + b["time:c"]
    assert abs(pred[("Sum", "c")][0] - want) < 1e-9
    x = np.array([1.0 if t in ("season:Sum", "time:c") else np.log(8) if t == "length:Sum" else 0.0 for t in row["terms"]])
    cov = np.array(row["cov"]).reshape(len(x), len(x))
    assert abs(pred[("Sum", "c")][1] - np.sqrt(x @ cov @ x)) < 1e-9
    years = YearInfo(3, (("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("d", 4, 4)), ())
    avg = {r.timegroup: r.freq for r in trends.average_seasons(trends.predict_fixed(grid, model), years).collect()}
    assert avg["d"] is None and avg["a"] is not None


def test_separated_and_flat_models_settle(spark):
    """A season in which nothing is ever seen, a length that never varies, and a species seen on every visit: all gradients are zero."""
    rows = []
    for cell in range(60):
        for v in range(6):
            season = SEASONS[v % 4]
            rows.append(("never in one season", "R", cell, cell / 60, season, 3 + v, int(season != "Win" and (cell + v) % 3 == 0)))
            rows.append(("always", "MW", cell, cell / 60, "Win", 3 + v, 1))
            rows.append(("one length", "MW", cell, cell / 60, "Win", 5, int((cell * 7 + v) % 4 == 0)))
    h = spark.createDataFrame(rows, "common_name string, status string, gridg1 long, prop_nb double, season string, no_sp int, seen int")
    got = {r.common_name: r for r in fits.fit_occupancy(h).collect()}
    assert all(r.gradient < 1e-3 and r.status_fit in ("ok", "boundary") for r in got.values()) and len(got) == 3
    assert got["never in one season"].status_fit == got["always"].status_fit == "boundary"
    binomial = [("sp", 1, c, s, g, n, 10, 0 if s == "Win" else (c + n) % 5) for c in range(4) for s in SEASONS for g in GROUPS for n in (2, 9)]
    df = spark.createDataFrame(binomial, SCHEMA)
    fixed = fits.fit_glm(df, GROUPS).first()
    assert fixed.status == "boundary" and fixed.gradient < 1e-3
    mixed = fits.fit_glmm(df, GROUPS).first()
    assert mixed.status in ("ok", "boundary") and mixed.gradient < 1e-3
    assert fits.fit_occupancy(spark.createDataFrame([], h.schema)).count() == 0


def test_a_worse_step_is_halved():
    state = {"base": [0.0], "trial": [4.0], "step": [4.0], "merit": -1.0, "halved": 0, "gradient": None, "cov": None, "extra": None, "state": "open"}
    import numpy as np

    back = fits.advance(state, np.array([-9.0, 1.0, 1.0, 0.0]), 1)
    assert back["trial"] == [2.0] and back["halved"] == 1 and back["base"] == [0.0]
    on = fits.advance(back, np.array([-0.5, 1e-6, 1.0, 7.0]), 1)
    assert on["base"] == [2.0] and on["state"] == "ok" and on["extra"] == 7.0


def test_replicates_at_once_equal_each_by_itself(spark):
    from fieldtrends.operators import qualify, resample

    d = "/root/testdata/sf0.001"
    ana = staged(A.analysis_table(spark, d))
    frame = qualify.sampling_frame(ana)
    win = fq.windows_for(spark, d)
    for attrs in (["timegroup"], list(trends.DESIGN)):
        rows = trends.compress(resample.apply_replicates(ana, resample.replicates(frame, 9, 3)), win, A.YEARS, ["sim"], attrs)
        sets = trends.compress_replicates(ana, resample.replicate_sets(frame, 9, 3), win, A.YEARS, 9, attrs=attrs)
        columns = ["sim", "common_name", *attrs, "n", "k"]
        a, b = (sorted(map(tuple, x.select(columns).collect()), key=str) for x in (rows, sets))
        assert a == b and a


def test_each_species_gets_its_model(spark):
    """Fits and reported errors of chosen models equal those of each kind fitted by itself."""
    rng = np.random.default_rng(11)
    rows = [(name, *r[1:]) for name in ("wide", "narrow", "tiny") for r in simulate(rng, 0.5, 0.3)]
    df = staged(spark.createDataFrame(rows, SCHEMA))
    restricted = spark.createDataFrame([("narrow", 1), ("tiny", 0)], "common_name string, mixed int")
    choice = fits.model_choice(df, restricted)
    assert {r.common_name: r.model for r in choice.collect()} == {"wide": "nested", "narrow": "single", "tiny": "fixed"}
    model = staged(fits.fit_chosen(df, choice, GROUPS))
    alone = {"wide": fits.fit_glmm(df, GROUPS), "narrow": fits.fit_glmm(df, GROUPS, nested=False), "tiny": fits.fit_glm(df, GROUPS)}
    got = {r.common_name: r for r in model.collect()}
    assert got.keys() == alone.keys() and got["wide"].sd_outer is not None and got["narrow"].sd_outer is None and got["tiny"].sd_cell is None
    for name, fit in alone.items():
        one = fit.filter(F.col("common_name") == name).first()
        assert one.terms == got[name].terms and np.allclose(one.coef, got[name].coef, atol=1e-6) and got[name].gradient < 1e-3
    lengths = spark.createDataFrame([(n, 8) for n in alone], "common_name string, typical_length long")
    grid = trends.prediction_grid(df, lengths)
    plain = {tuple(r)[:3]: r for r in trends.predict_fixed(grid, model).collect()}
    for r in trends.predict_chosen(grid, model, fits.REPORTED).collect():
        want = plain[tuple(r)[:3]]
        err = want.err if r.common_name == "tiny" else 0.6433454 * np.sqrt(want.err**2 + 1)
        assert abs(r.fit - want.fit) < 1e-12 and abs(r.err - err) < 1e-9
    nobody = spark.createDataFrame([], restricted.schema)
    assert {r.model for r in fits.model_choice(df, nobody).collect()} == {"nested"}
