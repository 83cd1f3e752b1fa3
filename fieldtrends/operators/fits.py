"""Model fits as Spark jobs: fixed and mixed cloglog models, occupancy models.

The table of compressed rows is the model input. The fixed model needs only (season, time group,
length) rows, at most a few thousand per species, and is solved per group. The other two are Newton
iterations over blocks: every pass maps blocks to gradient and curvature, sums them per model and
updates the coefficients, so no task ever holds all rows of a species.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldtrends.config import SEASON_NAMES
from fieldtrends.session import staged

SP = "common_name"
ETA = (-30.0, 3.4)


def cloglog_parts(eta, n, k):
    """Mean, working weight, score and log-likelihood of binomial rows on the cloglog scale."""
    eta = np.clip(eta, *ETA)
    ex = np.exp(eta)
    mu = np.clip(-np.expm1(-ex), 1e-12, 1 - 1e-12)
    d = ex * np.exp(-ex)
    v = mu * (1 - mu)
    return n * d * d / v, (k - n * mu) * d / v, k * np.log(mu) + (n - k) * np.log1p(-mu)


def terms_of(seasons: Sequence[str], groups: Sequence[str]) -> list[str]:
    """One level and one length slope per season, contrasts of the time groups to the first."""
    return [f"season:{s}" for s in seasons] + [f"length:{s}" for s in seasons] + [f"time:{g}" for g in list(groups)[1:]]


MODEL_FIELDS = "terms array<string>, coef array<double>, cov array<double>, deviance double, n bigint, gradient double, status string"


# ------------------------------------------------------------------ T06
def _solve_fixed(pdf: pd.DataFrame, order: Sequence[str]):
    seasons = [s for s in SEASON_NAMES if (pdf.season == s).any()]
    present = set(pdf.timegroup)
    groups = [g for g in order if g in present]
    terms = terms_of(seasons, groups)
    x = np.zeros((len(pdf), len(terms)))
    log_len = np.log(pdf.no_sp.to_numpy(float))
    for i, s in enumerate(seasons):
        hit = (pdf.season == s).to_numpy()
        x[hit, i] = 1.0
        x[hit, len(seasons) + i] = log_len[hit]
    for i, g in enumerate(groups[1:]):
        x[(pdf.timegroup == g).to_numpy(), 2 * len(seasons) + i] = 1.0
    n, k = pdf.n.to_numpy(float), pdf.k.to_numpy(float)
    beta = np.zeros(len(terms))
    p0 = min(max(k.sum() / n.sum(), 1e-6), 1 - 1e-6)
    beta[: len(seasons)] = np.log(-np.log1p(-p0))
    state = {"base": beta, "trial": beta, "step": 0 * beta, "merit": None, "halved": 0, "gradient": None, "cov": None, "extra": None, "state": "open"}
    for _ in range(200):
        w, score, ll = cloglog_parts(x @ np.asarray(state["trial"]), n, k)
        curve = x.T @ (w[:, None] * x)
        state = advance(state, np.concatenate([[ll.sum()], x.T @ score, curve.ravel(), [-2 * ll.sum()]]), len(terms))
        if state["state"] != "open":
            break
    status = "not converged" if state["state"] == "open" else state["state"]
    return terms, state["base"], state["cov"], state["extra"], int(n.sum()), state["gradient"], status


def fit_glm(binomial: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """T06. presence ~ season + season:log(length) + time group, binomial with cloglog link.

    Rows are first summed over cells: a model sees at most seasons x time groups x lengths rows. ``gradient`` is the largest component
    of the gradient at the coefficients; the status is ok, boundary (see ``fit_occupancy``), failed or not converged.
    """
    keys = [*by, SP]
    small = binomial.groupBy(*keys, "season", "timegroup", "no_sp").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    schema = T.StructType([small.schema[c] for c in keys] + T.StructType.fromDDL(MODEL_FIELDS).fields)
    order = list(labels)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {c: pdf[c].iloc[0] for c in keys}
        t, b, c, dev, n, gradient, status = _solve_fixed(pdf, order)
        return pd.DataFrame([{**head, "terms": t, "coef": list(b), "cov": c, "deviance": dev, "n": n, "gradient": gradient, "status": status}])

    return small.groupBy(*keys).applyInPandas(fit, schema)


# ------------------------------------------------------------------ shared Newton loop
def sum_stats(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Element-wise sum of the ``stats`` arrays per model (a short array per partial sum)."""
    return parts.groupBy(*keys).agg(F.collect_list("stats").alias("__s")).withColumn(
        "stats", F.aggregate(
            F.slice("__s", 2, F.greatest(F.size("__s") - 1, F.lit(0))), F.element_at("__s", 1),
            lambda a, b: F.zip_with(a, b, lambda x, y: x + y))).drop("__s")


WIDE = 8.0  # longest step of a coefficient
SETTLED = 1e-4  # largest component of the gradient of a settled model
FLAT = 1e-6  # curvature, against the strongest, below which the likelihood has its best value at the edge
WEAK = 1e-3  # the same without comparison: towards an edge, curvature falls with the gradient
STATE = "base array<double>, trial array<double>, step array<double>, merit double, halved int, gradient double, cov array<double>, extra double, state string"


def newton_step(grad: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Step, covariance and whether some curvature has gone, over the terms that have data. Steps go uphill also where the
    curvature is negative, and directions without curvature and gradient are left alone."""
    p = len(grad)
    on = np.abs(curve).sum(1) > 1e-12
    step, cov = np.zeros(p), np.zeros((p, p))
    if not on.any():
        return step, cov, False
    w, v = np.linalg.eigh(curve[np.ix_(on, on)])
    c, top = v.T @ grad[on], max(np.abs(w).max(), 1e-12)
    move = v @ np.where(np.abs(c) < 1e-9, 0.0, c / np.maximum(np.abs(w), 1e-9 * top))
    step[on] = move * min(1.0, WIDE / max(np.abs(move).max(), 1e-300))
    cov[np.ix_(on, on)] = (v / np.maximum(w, FLAT * top)) @ v.T
    return step, cov, bool(w.min() < max(FLAT * top, WEAK))


def advance(r: dict, stats: np.ndarray, p: int) -> dict:
    """State of a model after its trial was evaluated: stats are merit, gradient, curvature, and one more figure to keep.

    A trial that is no better than the base is given up for half the step; else it is the new base.
    """
    merit, grad, curve = stats[0], stats[1:1 + p], stats[1 + p:1 + p + p * p].reshape(p, p)
    if not np.isfinite(stats).all() and (r["merit"] is None or r["halved"] >= 30):
        return {**r, "state": "failed"}
    worse = not np.isfinite(merit) or (r["merit"] is not None and merit < r["merit"] - 1e-9 * (1 + abs(r["merit"])))
    if worse and r["halved"] < 30:
        step = np.asarray(r["step"]) / 2
        return {**r, "step": step.tolist(), "trial": (np.asarray(r["base"]) + step).tolist(), "halved": r["halved"] + 1}
    base = np.asarray(r["trial"], float)
    step, cov, edge = newton_step(grad, curve)
    size = float(np.abs(grad).max())
    state = "open" if size >= SETTLED else "boundary" if edge else "ok"
    return {**r, "base": base.tolist(), "step": step.tolist(), "trial": (base + step).tolist(), "merit": float(merit), "halved": 0,
            "gradient": size, "cov": cov.ravel().tolist(), "extra": float(stats[1 + p + p * p]), "state": state}


def settle(blocks: DataFrame, start: DataFrame, keys: Sequence[str], p: int, contribute, passes: int = 200) -> DataFrame:
    """Guarded Newton over many models at once: keys, the columns of ``start`` and STATE, with state ok, boundary, failed or open.

    start: keys, ``theta`` (p coefficients) and what ``contribute`` needs; it maps blocks joined with them to partial ``stats``. Models that
    have settled leave the loop, which ends when none is open; ``passes`` bounds it for a model that never settles.
    """
    keys = list(keys)
    extra = [c for c in start.columns if c not in (*keys, "theta")]
    part_schema = T.StructType([blocks.schema[c] for c in keys] + T.StructType.fromDDL("stats array<double>").fields)
    none = F.lit(None)
    params = staged(start.select(
        *keys, *extra, F.col("theta").alias("base"), F.col("theta").alias("trial"), F.transform("theta", lambda x: x * 0).alias("step"), none.cast("double").alias("merit"),
        F.lit(0).alias("halved"), none.cast("double").alias("gradient"), none.cast("array<double>").alias("cov"), none.cast("double").alias("extra"), F.lit("open").alias("state")))
    schema, columns = params.schema, params.columns

    def update(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                row = {c: getattr(r, c) for c in columns}
                row["merit"] = None if row["merit"] is None or np.isnan(row["merit"]) else row["merit"]
                out.append(row if r.stats is None else advance(row, np.asarray(r.stats, float), p))
            yield pd.DataFrame(out, columns=columns)

    for _ in range(passes):
        asked = params.filter("state = 'open'").select(*keys, *extra, F.col("trial").alias("theta"))
        summed = sum_stats(blocks.join(asked, keys).mapInPandas(contribute, part_schema), keys)
        params = staged(params.join(summed, keys, "left").mapInPandas(update, schema))
        if params.filter("state = 'open'").isEmpty():
            break
    return params


def _ragged(col) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(a) for a in col])
    return lens, np.concatenate([np.asarray(a) for a in col]) if len(col) else np.zeros(0)


# ------------------------------------------------------------------ T07
def mixed_blocks(binomial: DataFrame, labels: Sequence[str], by: Sequence[str] = (), nested: bool = True) -> DataFrame:
    """One row per (model, outer cell): integer-coded rows of that cell as arrays.

    A 100 km cell holds at most 16 cells of 25 km, so a block is bounded by the covariate design.
    """
    keys = [*by, SP]
    code_s = F.array_position(F.array(*[F.lit(s) for s in SEASON_NAMES]), F.col("season")).cast("int") - 1
    code_t = F.array_position(F.array(*[F.lit(g) for g in labels]), F.col("timegroup")).cast("int") - 1
    outer = F.col("gridg3") if nested else F.col("gridg1")
    row = F.struct(F.col("gridg1").alias("c"), code_s.alias("s"), code_t.alias("t"),
                   F.log("no_sp").alias("l"), F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("k"))
    blocks = binomial.groupBy(*keys, outer.alias("block")).agg(F.collect_list(row).alias("r"))
    return blocks.select(*keys, "block", *[F.col(f"r.{f}").alias(f) for f in ("c", "s", "t", "l", "n", "k")])


def _mixed_pass(g: pd.DataFrame, n_t: int, nested: bool):
    """Sums over the blocks of one model and candidate: gradient, curvature, Laplace deviance."""
    beta = np.asarray(g.beta.iloc[0], float)
    var1, var3 = float(g.var1.iloc[0]), float(g.var3.iloc[0])
    p = 8 + n_t
    lens, s = _ragged(g.s)
    t, l, n, k, c = (_ragged(g[x])[1] for x in ("t", "l", "n", "k", "c"))
    s, t = s.astype(int), t.astype(int)
    b = np.repeat(np.arange(len(g)), lens)
    _, cell = np.unique(np.stack([b, c.astype(np.int64)]), axis=1, return_inverse=True)
    cell = cell.ravel()
    nc, nb = cell.max() + 1, len(g)
    block_of = np.zeros(nc, int)
    block_of[cell] = b
    fixed = beta[s] + beta[4 + s] * l + beta[8 + t]
    u, v = np.zeros(nc), np.zeros(nb)
    for _ in range(25):
        w, sc, _ = cloglog_parts(fixed + u[cell] + v[b], n, k)
        wc, gc = np.bincount(cell, w, nc), np.bincount(cell, sc, nc) - u / var1
        dc = wc + 1 / var1
        if nested:
            gb = np.bincount(b, sc, nb) - v / var3
            sb = np.bincount(block_of, wc - wc * wc / dc, nb) + 1 / var3
            dv = (gb - np.bincount(block_of, wc * gc / dc, nb)) / sb
        else:
            dv = np.zeros(nb)
        du = (gc - wc * dv[block_of]) / dc
        dv, du = np.clip(dv, -2, 2), np.clip(du, -2, 2)
        u, v = u + du, v + dv
        if max(np.abs(du).max(), np.abs(dv).max()) < 1e-8:
            break
    w, sc, ll = cloglog_parts(fixed + u[cell] + v[b], n, k)
    cols, vals = np.stack([s, 4 + s, 8 + t]), np.stack([np.ones(len(l)), l, np.ones(len(l))])
    grad, hess = np.zeros(p), np.zeros((p, p))
    ac = np.zeros((nc, p))
    for i in range(3):
        grad += np.bincount(cols[i], sc * vals[i], p)
        ac += np.bincount(cell * p + cols[i], w * vals[i], nc * p).reshape(nc, p)
        for j in range(3):
            hess += np.bincount(cols[i] * p + cols[j], w * vals[i] * vals[j], p * p).reshape(p, p)
    wc = np.bincount(cell, w, nc)
    dc = wc + 1 / var1
    hess -= ac.T @ (ac / dc[:, None])
    dev = -2 * ll.sum() + (u * u).sum() / var1 + np.log(dc * var1).sum()
    if nested:
        sb = np.bincount(block_of, wc - wc * wc / dc, nb) + 1 / var3
        ab = np.zeros((nb, p))
        np.add.at(ab, block_of, ac * (1 / var1 / dc)[:, None])
        hess -= ab.T @ (ab / sb[:, None])
        dev += (v * v).sum() / var3 + np.log(sb * var3).sum()
    # the penalised likelihood at the cells' own optimum: ``grad`` is its gradient
    merit = ll.sum() - (u * u).sum() / var1 / 2 - ((v * v).sum() / var3 / 2 if nested else 0.0)
    return np.concatenate([[dev], grad, hess.ravel(), [merit]])


def _used(hess: np.ndarray) -> np.ndarray:
    """Terms with data; the first time group present is the baseline and stays at zero."""
    on = np.diag(hess) > 1e-8
    times = np.flatnonzero(on[8:])
    if len(times):
        on[8 + times[0]] = False
    return on


def parabola_step(params: DataFrame, keys: Sequence[str], step: float, nested: bool) -> DataFrame:
    """Next centre: per variance the vertex of the parabola through its three deviances, at most 1.5
    steps away; without curvature one step to the lower side."""
    at = lambda c, i: F.max(F.when(F.col("cand") == i, F.col(c)))
    aggs = [at("dev", i).alias(f"d{i}") for i in range(5)] + [at("log1", 0).alias("c1"), at("log3", 0).alias("c3")]
    g = params.groupBy(*keys).agg(*aggs, F.min_by("beta", "cand").alias("beta"))

    def offset(up: str, down: str) -> Column:
        bend = F.col(up) + F.col(down) - 2 * F.col("d0")
        vertex = F.try_divide((F.col(down) - F.col(up)) * step / 2, bend)
        side = F.when(F.least(up, down) >= F.col("d0"), 0.0).when(F.col(up) < F.col(down), step).otherwise(-step)
        return F.when(bend > 1e-9, F.greatest(F.least(vertex, F.lit(1.5 * step)), F.lit(-1.5 * step))).otherwise(side)

    log3 = F.greatest(F.col("c3") + offset("d3", "d4"), F.lit(-4.0)) if nested else F.col("c3")
    return g.select(*keys, F.lit(0).alias("cand"), F.greatest(F.col("c1") + offset("d1", "d2"), F.lit(-4.0)).alias("log1"),
                    log3.alias("log3"), "beta")


def fit_glmm(
    binomial: DataFrame, labels: Sequence[str], by: Sequence[str] = (), nested: bool = True,
    rounds: int = 4, warmup: int = 6, passes: int = 2, step: float = 0.8,
) -> DataFrame:
    """T07. The fixed model plus nested random intercepts per cell, Laplace deviance.

    Coefficients are profiled for a pattern of variances around the present pair; parabolas through
    the deviances give the centre of the next, finer pattern. At the last centre the coefficients run until the gradient is zero
    (see ``settle``). Coefficient and variance rows (a few numbers per model) are stored each pass; blocks are computed once.
    """
    keys = [*by, SP]
    n_t = len(labels)
    p = 8 + n_t
    blocks = staged(mixed_blocks(binomial, labels, by, nested))
    key_fields = [blocks.schema[c] for c in keys]
    cand_fields = key_fields + T.StructType.fromDDL("cand int, log1 double, log3 double").fields
    part_schema = T.StructType(cand_fields + T.StructType.fromDDL("stats array<double>").fields)
    upd_schema = T.StructType(
        cand_fields + T.StructType.fromDDL("beta array<double>, cov array<double>, dev double, move double").fields)
    names = [f.name for f in cand_fields]

    def contribute(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            pdf = pdf.assign(var1=np.exp(2 * pdf.log1), var3=np.exp(2 * pdf.log3))
            out = []
            for key, g in pdf.groupby(names, sort=False):
                out.append({**dict(zip(names, key)), "stats": _mixed_pass(g, n_t, nested).tolist()})
            yield pd.DataFrame(out)

    def update(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                st, beta = np.asarray(r.stats, float), np.asarray(r.beta, float)
                grad, hess = st[1: 1 + p], st[1 + p:-1].reshape(p, p)
                on = _used(hess)
                h = hess[np.ix_(on, on)] + 1e-8 * np.eye(on.sum())
                move, cov = np.zeros(p), np.zeros((p, p))
                try:
                    move[on] = np.clip(np.linalg.solve(h, grad[on]), -2, 2)
                    cov[np.ix_(on, on)] = np.linalg.inv(h)
                except np.linalg.LinAlgError:
                    pass
                out.append({**{c: getattr(r, c) for c in names}, "beta": (beta + move).tolist(),
                            "cov": cov.ravel().tolist(), "dev": float(st[0]), "move": float(np.abs(move).max())})
            yield pd.DataFrame(out, columns=[f.name for f in upd_schema])

    def one_pass(params: DataFrame) -> DataFrame:
        joined = blocks.join(params.select(*names, "beta"), keys)
        parts = joined.mapInPandas(contribute, part_schema)
        summed = sum_stats(parts, names).join(params.select(*names, "beta"), names)
        return staged(summed.mapInPandas(update, upd_schema))

    rate = binomial.groupBy(*keys).agg((F.sum("k") / F.sum("n")).alias("p0"))
    level = F.log(-F.log(F.lit(1.0) - F.least(F.greatest(F.col("p0"), F.lit(1e-6)), F.lit(1 - 1e-6))))
    start = F.array(*[level if i < 4 else F.lit(0.0) for i in range(p)])
    params = rate.select(*keys, F.lit(0).alias("cand"), F.lit(-0.7).alias("log1"), F.lit(-0.7).alias("log3"), start.alias("beta"))
    for _ in range(warmup):
        params = one_pass(params)
    best = params
    for _ in range(rounds):
        moves = [(0, 0), (1, 0), (-1, 0)] + ([(0, 1), (0, -1)] if nested else [])
        pattern = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a * step).alias("a"), F.lit(b * step).alias("b"))
                            for i, (a, b) in enumerate(moves)])
        params = best.withColumn("m", F.explode(pattern)).select(
            *keys, F.col("m.i").alias("cand"),
            F.greatest(F.col("log1") + F.col("m.a"), F.lit(-4.0)).alias("log1"),
            F.greatest(F.col("log3") + F.col("m.b"), F.lit(-4.0)).alias("log3"), "beta")
        for _ in range(passes):
            params = one_pass(params)
        best = parabola_step(params, keys, step, nested)
        step = step / 2

    def settling(frames):
        """Merit, gradient and curvature of the terms in use; the first time group with data is the baseline and does not move."""
        for pdf in frames:
            out = []
            pdf = pdf.assign(var1=np.exp(2 * pdf.log1), var3=np.exp(2 * pdf.log3), beta=pdf.theta)
            for key, g in pdf.groupby(keys, sort=False):
                st = _mixed_pass(g, n_t, nested)
                off = np.array(g.base_term.iloc[0]) - 1
                grad, hess = st[1: 1 + p].copy(), st[1 + p:-1].reshape(p, p).copy()
                if off >= 0:
                    grad[off], hess[off], hess[:, off] = 0.0, 0.0, 0.0
                out.append({**dict(zip(keys, key)), "stats": np.concatenate([[st[-1]], grad, hess.ravel(), [st[0]]]).tolist()})
            yield pd.DataFrame(out, columns=[*keys, "stats"])

    codes = F.array(*[F.lit(g) for g in labels])
    first = binomial.groupBy(*keys).agg((F.min(F.array_position(codes, F.col("timegroup"))) + 8).cast("int").alias("base_term"))
    final = settle(blocks, best.select(*keys, "log1", "log3", F.col("beta").alias("theta")).join(first, keys), keys, p, settling)
    terms = terms_of(SEASON_NAMES, ["-"]) + [f"time:{g}" for g in labels]
    total = binomial.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n"))
    return final.join(total, keys).select(
        *keys, F.array(*[F.lit(t) for t in terms]).alias("terms"), F.col("base").alias("coef"), "cov",
        F.col("extra").alias("deviance"), "n", F.exp("log1").alias("sd_cell"),
        (F.exp("log3") if nested else F.lit(None).cast("double")).alias("sd_outer"), "gradient",
        F.when(F.col("state") == "open", "not converged").otherwise(F.col("state")).alias("status"),
    )


#: Model of a species: random intercepts of two cell sizes, of the small cells only, or none.
KINDS = ("nested", "single", "fixed")
#: What turns the standard error of a kind into the reported error, and the residual variance it adds: mixed models report
#: the half-width of a 48 % normal interval on the link scale.
REPORTED = {"nested": (0.6433454, 1.0), "single": (0.6433454, 1.0), "fixed": (1.0, 0.0)}


def model_choice(species: DataFrame, restricted: DataFrame) -> DataFrame:
    """Model of every species: nested, or for range-restricted ones (``restricted`` with ``mixed``) single or fixed."""
    flag = restricted.select(SP, F.coalesce("mixed", F.lit(0)).alias("__mixed"))
    kind = F.when(F.col("__mixed").isNull(), "nested").when(F.col("__mixed") == 0, "fixed").otherwise("single")
    return species.select(SP).distinct().join(flag, SP, "left").select(SP, kind.alias("model"))


def fit_chosen(binomial: DataFrame, choice: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """T06, T07 with a model per species: ``choice`` (species, model), species without an entry are nested.

    One job per kind over all its species, from rows that are made once; the kind is kept as ``model``. A kind without rows adds none.
    """
    rows = staged(binomial.join(choice.select(SP, "model"), SP, "left").withColumn("model", F.coalesce("model", F.lit(KINDS[0]))))
    made = {
        "nested": lambda part: fit_glmm(part, labels, by, nested=True),
        "single": lambda part: fit_glmm(part, labels, by, nested=False),
        "fixed": lambda part: fit_glm(part, labels, by),
    }
    out = None
    for kind in KINDS:
        part = made[kind](rows.filter(F.col("model") == kind).drop("model")).withColumn("model", F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ O10
def occupancy_blocks(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with their visits (rows, or counts with ``trials`` and ``hits``) summed per (season, list length): the likelihood needs no more."""
    code = F.array_position(F.array(*[F.lit(s) for s in SEASON_NAMES]), F.col("season")).cast("int") - 1
    counted = "trials" in history.columns
    n, k = (F.sum("trials"), F.sum("hits")) if counted else (F.count(F.lit(1)), F.sum("seen"))
    rows = history.groupBy(*keys, "gridg1", "prop_nb", "season", "no_sp").agg(n.alias("n"), k.alias("k"))
    row = F.struct(code.alias("s"), F.log("no_sp").alias("l"),
                   F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("k"))
    cells = rows.groupBy(*keys, "gridg1", "prop_nb").agg(F.collect_list(row).alias("r"))
    return cells.select(*keys, "gridg1", "prop_nb", *[F.col(f"r.{f}").alias(f) for f in ("s", "l", "n", "k")])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _occupancy_pass(g: pd.DataFrame, seasonal: bool) -> np.ndarray:
    """Log-likelihood, gradient and Hessian over the cells of one model; 2 + 8 parameters."""
    theta = np.asarray(g.theta.iloc[0], float)
    lens, s = _ragged(g.s)
    l, n, k = (_ragged(g[x])[1] for x in ("l", "n", "k"))
    s = s.astype(int) if seasonal else np.zeros(len(l), int)
    cell, nc = np.repeat(np.arange(len(g)), lens), len(g)
    z = np.stack([np.ones(nc), g.prop_nb.to_numpy(float)], 1)
    x = np.zeros((len(l), 8))
    x[np.arange(len(l)), s] = 1.0
    x[np.arange(len(l)), 4 + s] = l
    psi, pr = _sigmoid(z @ theta[:2]), np.clip(_sigmoid(x @ theta[2:]), 1e-12, 1 - 1e-12)
    hit = np.bincount(cell, k, nc) > 0
    q = np.exp(np.bincount(cell, n * np.log1p(-pr), nc))
    d = psi * q + 1 - psi
    r = np.where(hit, 1.0, psi * q / d)
    ll = np.where(hit, np.log(np.maximum(psi, 1e-300)), np.log(np.maximum(d, 1e-300))).sum()
    ll += np.where(hit[cell], k * np.log(pr) + (n - k) * np.log1p(-pr), 0).sum()
    g_psi = z.T @ (r - psi)
    score = np.where(hit[cell], k - n * pr, -r[cell] * n * pr)
    g_p = x.T @ score
    h = np.zeros((10, 10))
    rr = r * (1 - r)
    h[:2, :2] = z.T @ ((rr - psi * (1 - psi))[:, None] * z)
    sc = np.zeros((nc, 8))
    np.add.at(sc, cell, (n * pr)[:, None] * x)
    h[2:, 2:] = sc.T @ (rr[:, None] * sc) - x.T @ ((r[cell] * n * pr * (1 - pr))[:, None] * x)
    h[:2, 2:] = -(z.T @ (rr[:, None] * sc))
    h[2:, :2] = h[:2, 2:].T
    return np.concatenate([[ll], g_psi, g_p, h.ravel()])


def fit_occupancy(history: DataFrame, keys: Sequence[str] = (SP, "status")) -> DataFrame:
    """O10. Single-season occupancy: detection ~ log(length) [* season], occupancy ~ neighbour share.

    Season enters only for residents (code R). Every model runs until its gradient is zero (``gradient`` is its largest component).
    status_fit: ok; boundary, where the likelihood is best at the edge (some probability goes to 0 or 1), so estimates are limits and their
    errors wide; failed, without a likelihood; not converged, after more passes than any model should need.
    """
    keys = list(keys)
    blocks = staged(occupancy_blocks(history, keys))

    def contribute(frames):
        for pdf in frames:
            out = []
            for key, g in pdf.groupby(keys, sort=False):
                head = dict(zip(keys, key))
                st = _occupancy_pass(g, head.get("status") == "R")
                out.append({**head, "stats": [st[0], *st[1:11], *-st[11:], 0.0]})
            yield pd.DataFrame(out, columns=[*keys, "stats"])

    start = blocks.select(*keys).distinct().withColumn("theta", F.array(*[F.lit(0.0)] * 10))
    done = settle(blocks, start, keys, 10, contribute)
    return done.select(
        *keys, F.col("base").alias("theta"), "cov", F.col("merit").alias("log_likelihood"), "gradient",
        F.when(F.col("state") == "open", "not converged").otherwise(F.col("state")).alias("status_fit"),
    )
