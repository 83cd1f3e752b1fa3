"""Region labels and rule-driven removal of probable mistakes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldtrends.functions.nulls import not_in, null_safe_join


@dataclass(frozen=True)
class RegionRule:
    """A region made of districts, optionally cut by a state and by half-planes."""

    region: str
    districts: tuple[str, ...]
    state: str | None = None
    lat_below: float | None = None
    lat_above: float | None = None
    lon_below: float | None = None
    lon_above: float | None = None

    def condition(self) -> Column:
        c = F.col("district").isin(list(self.districts))
        if self.state is not None:
            c = c & (F.col("state") == self.state)
        for col, low, high in (("lat", self.lat_above, self.lat_below), ("lon", self.lon_above, self.lon_below)):
            if low is not None:
                c = c & (F.col(col) > low)
            if high is not None:
                c = c & (F.col(col) < high)
        return c


def with_region(obs: DataFrame, rules: Sequence[RegionRule], name: str = "region") -> DataFrame:
    """C05. First matching region rule, NULL when none matches."""
    label = F.lit(None).cast("string")
    for rule in reversed(rules):
        label = F.when(rule.condition(), F.lit(rule.region)).otherwise(label)
    return obs.withColumn(name, label)


# Rule families: the column that drives the equi-join, and the keys whose rows are removed.
FAMILIES = {
    "list": ("event_id", ["event_id"]),
    "species_list": ("common_name", ["common_name", "event_id"]),
    "observer": ("observer_id", ["observer_id", "common_name"]),
    "admin": ("common_name", ["common_name", "state", "district"]),
    "admin_date": ("common_name", ["common_name", "state", "district", "month", "year"]),
    "place": ("common_name", ["common_name", "state", "district", "lon", "lat", "region"]),
}

RULE_SCHEMA = T.StructType([
    T.StructField("family", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("common_name", T.StringType()),
    T.StructField("observer_id", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("months", T.ArrayType(T.IntegerType())),
    T.StructField("not_months", T.ArrayType(T.IntegerType())),
    T.StructField("year_after", T.IntegerType()),
    T.StructField("lat_above", T.DoubleType()),
    T.StructField("lat_below", T.DoubleType()),
    T.StructField("lon_above", T.DoubleType()),
    T.StructField("lon_below", T.DoubleType()),
])


EQUAL = ("event_id", "common_name", "observer_id", "state", "district", "region")
READS = {  # the column of the records that a rule field looks at
    **{c: c for c in EQUAL}, "months": "month", "not_months": "month", "year_after": "year",
    "lat_above": "lat", "lat_below": "lat", "lon_above": "lon", "lon_below": "lon",
}


def _prefixed(rules: DataFrame) -> DataFrame:
    return rules.select(*[F.col(f.name).alias(f"__{f.name}") for f in RULE_SCHEMA])


def _matches(driver: str) -> Column:
    """A record meets a rule: equal in the driving column, and in every other field that the rule states."""
    cond = F.col(driver) == F.col(f"__{driver}")
    for c in EQUAL:
        if c != driver:
            cond = cond & (F.col(f"__{c}").isNull() | (F.col(c) == F.col(f"__{c}")))
    cond = cond & (F.col("__months").isNull() | F.array_contains("__months", F.col("month")))
    cond = cond & (F.col("__not_months").isNull() | ~F.array_contains("__not_months", F.col("month")))
    cond = cond & (F.col("__year_after").isNull() | (F.col("year") > F.col("__year_after")))
    for c in ("lat", "lon"):
        cond = cond & (F.col(f"__{c}_above").isNull() | (F.col(c) > F.col(f"__{c}_above")))
        cond = cond & (F.col(f"__{c}_below").isNull() | (F.col(c) < F.col(f"__{c}_below")))
    return cond


def spreading(families: Sequence[str]) -> Column:
    """Rules that look at a column outside the keys of their family: they remove rows that do not match themselves."""
    out = F.lit(False)
    for family in families:
        stated = F.lit(False)
        for field, column in READS.items():
            if column not in FAMILIES[family][1]:
                stated = stated | F.col(field).isNotNull()
        out = out | ((F.col("family") == family) & stated)
    return out


def mistake_keys(obs: DataFrame, rules: DataFrame, family: str) -> DataFrame:
    """Distinct keys of the rows that match any rule of a family.

    One equi-join on the driving column of the family; every other rule column is "any" when NULL.
    """
    driver, keys = FAMILIES[family]
    return obs.join(_prefixed(rules.filter(F.col("family") == family)), _matches(driver), "left_semi").select(*keys).distinct()


def remove_mistakes(
    obs: DataFrame, rules: DataFrame, families: Sequence[str] = tuple(FAMILIES), banned: Sequence[str] = (),
) -> DataFrame:
    """C06. Drop every row that shares the keys of a matched row, in any family, and banned species.

    A rule that looks at keys of its family only matches all rows of a key or none, so the matched rows are the
    answer: one anti-join per driving column, all in one pass over the records. Other rules (``spreading``) need the
    keys of their matches first, which reads the records once more for each family that has some; those families are
    found in the rule table before the plan is made.
    """
    rules = rules.filter(F.col("family").isin(list(families)))
    out = obs
    for driver in dict.fromkeys(FAMILIES[f][0] for f in families):
        led = [f for f in families if FAMILIES[f][0] == driver]
        direct = rules.filter(F.col("family").isin(led) & ~spreading(led))
        out = out.join(_prefixed(direct), _matches(driver), "left_anti")
    wide = rules.filter(spreading(families))
    for family in sorted(r.family for r in wide.select("family").distinct().collect()):
        out = null_safe_join(out, mistake_keys(obs, wide, family), FAMILIES[family][1], "left_anti")
    return out.filter(not_in(F.col("common_name"), banned)) if banned else out
