"""A sample of the registered queries against DuckDB on the smallest tables, and the contract itself."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from fieldtrends.suite import load  # noqa: E402
from compare import check, connect  # noqa: E402

D = "/root/testdata/sf0.001"
SAMPLE = ["s05_rewrite_one_mask", "c06_remove_mistakes", "c14_completeness", "g01_tag_points", "q07_restricted_valid", "r02_replicates",
          "t05_compress", "o06_number_visits", "o06_drawn_counts", "v05_ratio_interval", "k08_priority_status", "m12_key_species", "m28_release_delta"]


def test_contract():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    # only model fits and the iterative species reduction have no SQL
    own = set(load()[0])
    assert {n[:3] for n in own - set(s)} <= {"t06", "t07", "t08", "o10", "m13"}


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    status, _, _, detail = check(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], D)
    assert status in ("ok", "close", "EMPTY"), detail


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["common_name", "longtermlci", "longtermmean", "longtermrci", "long_term_status"]
    recorded = spark.read.parquet(f"{D}/part.parquet").join(spark.read.parquet(f"{D}/lineitem.parquet").select("l_partkey").distinct(), F.col("p_partkey") == F.col("l_partkey"))
    assert out.count() == recorded.select("p_name").distinct().count()  # every recorded species
