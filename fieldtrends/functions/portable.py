"""Seeded pseudo-random numbers from integer arithmetic only.

``rand(seed)`` depends on partitioning, so a lost task or another cluster size gives other numbers.
These functions depend only on a row key and a seed: reproducible on any cluster, safe under task
retry, and computable by any SQL engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

PRIME = 2147483647
MULTIPLIER = 48271
SEED_STEP = 69621


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(int(x)).cast("bigint")


def hash31(key: Column, seed) -> Column:
    """Quadratic mixing modulo 2^31 - 1; every intermediate value fits a BIGINT."""
    p = F.lit(PRIME).cast("bigint")
    a = (key.cast("bigint") % p) * F.lit(MULTIPLIER).cast("bigint") % p
    b = (a * a + _col(seed) * F.lit(SEED_STEP).cast("bigint") + F.lit(12345).cast("bigint")) % p
    c = (b * b + a) % p
    return (c * c + b) % p


def uniform(key: Column, seed) -> Column:
    return (hash31(key, seed).cast("double") + F.lit(0.5)) / F.lit(float(PRIME))


def normal(key: Column, seed, shift: int = 7919) -> Column:
    """Standard normal by Box-Muller from two streams of the same key."""
    u1 = uniform(key, seed)
    u2 = uniform(key, _col(seed) + F.lit(shift).cast("bigint"))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def hash31_all(keys: Column, seed) -> Column:
    """``hash31`` of every key of an array. Each step is a pass over the array, so no intermediate value is computed twice."""
    p, start = F.lit(PRIME).cast("bigint"), _col(seed) * F.lit(SEED_STEP).cast("bigint") + F.lit(12345).cast("bigint")
    a = F.transform(keys, lambda k: (k % p) * F.lit(MULTIPLIER).cast("bigint") % p)
    ab = F.transform(a, lambda a: F.struct(a.alias("a"), ((a * a + start) % p).alias("b")))
    bc = F.transform(ab, lambda x: F.struct(x["b"].alias("b"), ((x["b"] * x["b"] + x["a"]) % p).alias("c")))
    return F.transform(bc, lambda x: (x["c"] * x["c"] + x["b"]) % p)


def uniform_all(keys: Column, seed) -> Column:
    return F.transform(hash31_all(keys, seed), lambda h: (h.cast("double") + F.lit(0.5)) / F.lit(float(PRIME)))


def normal_all(keys: Column, seed, shift: int = 7919) -> Column:
    return F.zip_with(uniform_all(keys, seed), uniform_all(keys, _col(seed) + F.lit(shift).cast("bigint")),
                      lambda u, v: F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v))


def uniform_of(key, seed):
    """``uniform`` for arrays of 64-bit integers inside a task."""
    import numpy as np

    a = np.fmod(key, PRIME) * MULTIPLIER % PRIME
    b = (a * a + seed * SEED_STEP + 12345) % PRIME
    c = (b * b + a) % PRIME
    return ((c * c + b) % PRIME + 0.5) / PRIME


def sql_hash31(key: str, seed: str) -> str:
    a = f"((({key}) % {PRIME}) * {MULTIPLIER} % {PRIME})"
    b = f"(({a} * {a} + CAST({seed} AS BIGINT) * {SEED_STEP} + 12345) % {PRIME})"
    c = f"(({b} * {b} + {a}) % {PRIME})"
    return f"(({c} * {c} + {b}) % {PRIME})"


def sql_uniforms(key: str, seeds: dict[str, str], source: str) -> str:
    """A query that adds, per name, the uniform number of a seed to the rows of ``source``; every step is computed once."""
    a = f"SELECT *, ({key}) % {PRIME} * {MULTIPLIER} % {PRIME} AS h_a FROM {source}"
    b = ", ".join(f"(h_a * h_a + CAST({s} AS BIGINT) * {SEED_STEP} + 12345) % {PRIME} AS h_b_{n}" for n, s in seeds.items())
    c = ", ".join(f"(h_b_{n} * h_b_{n} + h_a) % {PRIME} AS h_c_{n}" for n in seeds)
    u = ", ".join(f"(CAST((h_c_{n} * h_c_{n} + h_b_{n}) % {PRIME} AS DOUBLE) + 0.5) / CAST({PRIME} AS DOUBLE) AS {n}" for n in seeds)
    gone = ", ".join(["h_a", *[f"h_{k}_{n}" for n in seeds for k in "bc"]])
    return f"SELECT * EXCLUDE ({gone}), {u} FROM (SELECT *, {c} FROM (SELECT *, {b} FROM ({a})))"


def sql_uniform(key: str, seed: str) -> str:
    return f"((CAST({sql_hash31(key, seed)} AS DOUBLE) + 0.5) / CAST({PRIME} AS DOUBLE))"
