"""Link functions and error propagation as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used and inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def present(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def mean_of(values: Column) -> Column:
    """Mean of the values of an array that are not NULL; NULL if there are none."""
    return let(present(values), lambda v: F.try_divide(total(v), F.size(v)))


def spread_of(values: Column) -> Column:
    """Sample standard deviation of the values of an array that are not NULL; NULL below two."""
    return let(present(values), lambda v: let(F.try_divide(total(v), F.size(v)), lambda m: F.sqrt(
        F.when(F.size(v) > 1, total(F.transform(v, lambda x: (x - m) * (x - m))) / (F.size(v) - 1)))))


def quantiles_of(values: Column, shares: Sequence[float]) -> Column:
    """Interpolated quantiles of an array, as an array."""

    def at(s: Column, share: float) -> Column:
        place = (F.size(s) - 1) * F.lit(float(share))
        low = F.floor(place).cast("int")
        a = F.get(s, low)
        return a + (F.coalesce(F.get(s, low + 1), a) - a) * (place - low)

    return let(F.array_sort(present(values)), lambda s: F.array(*[at(s, x) for x in shares]))


def line_of(points: Column) -> Column:
    """Straight-line fit through an array of (x, y): n, xb, yb, sxx, b (slope), s2 (residual variance). Points without y are left out."""
    def sums(p: Column) -> Column:
        n = F.size(p)
        x, y = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
        centre = F.struct(F.try_divide(total(x), n).alias("xb"), F.try_divide(total(y), n).alias("yb"))
        return let(centre, lambda m: F.struct(
            n.alias("n"), m["xb"].alias("xb"), m["yb"].alias("yb"),
            total(F.transform(p, lambda q: (q["x"] - m["xb"]) * (q["x"] - m["xb"]))).alias("sxx"),
            total(F.transform(p, lambda q: (q["x"] - m["xb"]) * (q["y"] - m["yb"]))).alias("sxy"),
            total(F.transform(p, lambda q: (q["y"] - m["yb"]) * (q["y"] - m["yb"]))).alias("syy")))

    def line(s: Column) -> Column:
        b = F.try_divide(s["sxy"], s["sxx"])
        return F.struct(s["n"].alias("n"), s["xb"].alias("xb"), s["yb"].alias("yb"), s["sxx"].alias("sxx"), b.alias("b"),
                        F.try_divide(F.greatest(s["syy"] - b * s["sxy"], F.lit(0.0)), s["n"] - 2).alias("s2"))

    return let(let(F.filter(points, lambda q: q["y"].isNotNull()), sums), line)


def line_at(line: Column, x: Column) -> Column:
    return line["yb"] + line["b"] * (x - line["xb"])


def line_error(line: Column, x: Column) -> Column:
    dx = x - line["xb"]
    return F.sqrt(line["s2"] * (1 / line["n"] + F.try_divide(dx * dx, line["sxx"])))


def inv_cloglog(x: Column) -> Column:
    return F.lit(1.0) - F.exp(-F.exp(x))


def cloglog(p: Column) -> Column:
    return F.log(-F.log(F.lit(1.0) - p))


def quotient_error(x1: Column, x2: Column, se1: Column, se2: Column) -> Column:
    """Standard error of x1 / x2 for independent errors (signed, as the quotient is)."""
    a, b = F.try_divide(se1, x1), F.try_divide(se2, x2)
    return F.try_divide(x1, x2) * F.sqrt(a * a + b * b)


def root_sum_square(err: Column) -> Column:
    """Aggregate: error of a sum of independent terms."""
    return F.sqrt(F.sum(err * err))


def floor_cell(coord: Column, size: float) -> Column:
    return F.floor(coord / F.lit(float(size))).cast("bigint")
