"""Registry of analysis masks and of case studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

# Non-state masks with type, place in the order and label.
BASE_MASKS = [
    ("none", "country", 1, "Full country"),
    ("woodland", "habitat", 2, "Woodland"),
    ("cropland", "habitat", 3, "Cropland"),
    ("ONEland", "habitat", 4, "Open natural ecosystems"),
    ("PA", "conservation_area", 5, "Protected areas"),
]


def masks(states: DataFrame, state: str = "state") -> DataFrame:
    """S08. Country, habitat and conservation-area masks, then one mask per state in name order.

    The registry has one row per state, so the unpartitioned rank stays small by nature.
    """
    spark = states.sparkSession
    base = spark.createDataFrame(BASE_MASKS, "mask string, mask_type string, ord int, label string")
    st = states.select(F.col(state).alias("mask")).filter("mask IS NOT NULL").distinct()
    st = st.select(
        "mask", F.lit("state").alias("mask_type"),
        (F.dense_rank().over(W.orderBy("mask")) + len(BASE_MASKS)).cast("int").alias("ord"),
        F.col("mask").alias("label"),
    )
    return base.unionByName(st).withColumn(
        "code", F.concat_ws("_", F.lpad(F.col("ord").cast("string"), 2, "0"), F.lower("mask"))
    )


def mask(registry: DataFrame, name: str) -> dict:
    """S08. One mask as a dict; unknown names are an error."""
    rows = registry.filter(F.col("mask") == name).collect()
    if len(rows) != 1:
        raise ValueError(f"unknown mask {name!r}")
    return rows[0].asDict()


def case_studies(cases: DataFrame, name: str = "case", order: str = "case_no") -> DataFrame:
    """S11. Case-study registry with zero-padded, sortable keys and data/figure paths."""
    key = F.concat_ws("_", F.lpad(F.col(order).cast("string"), 2, "0"), F.col(name))
    return cases.withColumns({
        "case_key": key,
        "path_data": F.concat(F.lit("data/"), key, F.lit(".csv")),
        "path_out": F.when(F.col("has_figure"), F.concat(F.lit("graphs/"), key, F.lit(".png"))),
    })
