import itertools

from pyspark.sql import functions as F

from fieldtrends.config import RANGE_STATUSES, TREND_STATUSES
from fieldtrends.operators import classify as c, keyspecies as ks, releases as rel, reports as r


def test_every_status_combination_has_one_rule(spark):
    rules = c.score_rules(spark)
    pairs = list(itertools.product(TREND_STATUSES, TREND_STATUSES, RANGE_STATUSES))
    assert rules.count() == len(pairs) == 294
    main = spark.createDataFrame([(i, *p, "Least Concern", "Non-endemic") for i, p in enumerate(pairs)],
                                 "species int, long_term_status string, current_status string, range_status string, iucn string, endemic_region string")
    assert c.priority_status(main, rules).count() == 294


def test_long_term_status_is_total(spark):
    vals = [0.0, 30.0, 50.0, 60.0, 75.0, 99.0, 100.0, 101.0, 125.0, 150.0, 180.0]
    rows = [(l, m, h) for l in vals for m in vals for h in vals if l <= m <= h] + [(None, None, None)]
    out = c.long_term_status(spark.createDataFrame(rows, "longtermlci double, longtermmean double, longtermrci double")).toPandas()
    assert out.long_term_status.isin(TREND_STATUSES).all()
    stable = out[out.long_term_status == "Stable"]
    assert ((stable.longtermlci <= 100) & (stable.longtermrci >= 100) & (stable.longtermlci > 50) & (stable.longtermrci < 150)).all()


def test_consensus_takes_the_conservative_side(spark):
    main = spark.createDataFrame([("a", "Rapid Decline"), ("b", "Stable"), ("c", "Insufficient Data"), ("d", "Increase")], "species string, long_term_status string")
    seeds = spark.createDataFrame([("a", "Decline"), ("b", "Decline"), ("d", "Increase")], "species string, long_term_status string")
    out = {x.species: x.long_term_status for x in c.long_term_consensus(main, seeds).collect()}
    assert out == {"a": "Decline", "b": "Trend Inconclusive", "c": "Insufficient Data", "d": "Increase"}


def test_current_consensus_rules(spark):
    main = spark.createDataFrame([(s, v) for s, v in (("mix", "Decline"), ("soft", "Rapid Increase"), ("unsure", "Stable"), ("keep", "Stable"))],
                                 "species string, current_status string")
    drops = [("mix", "Stable"), ("soft", "Increase"), ("keep", "Trend Inconclusive")] + [("unsure", "Trend Inconclusive")] * 4
    out = {x.species: x.current_status for x in c.current_consensus(main, spark.createDataFrame(drops, "species string, current_status string")).collect()}
    assert out == {"mix": "Trend Inconclusive", "soft": "Increase", "unsure": "Trend Inconclusive", "keep": "Stable"}


def test_reduce_repeats_spreads_species(spark):
    rows = []
    for s in range(4):
        for i in range(8):
            share = 0.2 - 0.01 * s if i == 0 else 0.15 - 0.01 * i
            name = "common" if i == 0 else f"s{s}-{i}"
            rows.append((f"st{s}", name, share, "Decline", 0, "Decline", 0, "Moderate", 1.0 * i, i + 1))
    share = spark.createDataFrame(rows, "state string, common_name string, share double, current_status string, current_sort int, "
                                  "long_term_status string, long_term_sort int, range_status string, rangemean double, place long")
    none = spark.createDataFrame([], "common_name string")
    first = ks.key_species(share, none)
    assert first.groupBy("state").count().filter("count <> 4").isEmpty()
    before = first.filter("common_name = 'common'").count()
    after = ks.reduce_repeats(first, share, none)
    assert after.filter("common_name = 'common'").count() < before
    assert after.groupBy("state", "common_name").count().filter("count > 1").isEmpty()


def test_percent_tables_and_changes(spark):
    main = spark.createDataFrame([("a", "High"), ("b", "High"), ("c", None)], "species string, priority_status string")
    assert [(x.status, x.n) for x in r.priority_table(main).orderBy("pos").collect()] == [("High", 2), ("Moderate", 0), ("Low", 0)]
    old = spark.createDataFrame([("a", "x", None), ("b", "y", "1")], "species string, p string, q string")
    new = spark.createDataFrame([("a", "x", "2"), ("b", "z", "1"), ("n", "z", "1")], "species string, p string, q string")
    got = {(x.species, x.attribute, x.old_value, x.new_value) for x in rel.attribute_changes(old, new, "species", ["p", "q"]).collect()}
    assert got == {("a", "q", None, "2"), ("b", "p", "y", "z")}


def test_duplicates_keep_null_columns(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "x string, y int")
    copies, repl = rel.full_duplicates(df, df.filter(F.col("x") == "a").limit(1), ["x", "y"])
    assert copies.count() == 2 and repl.count() == 1
