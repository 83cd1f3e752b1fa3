import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fieldtrends.plans.assessment import Assessment, Inputs, content
from fieldtrends.plans.frequency import everything
from fieldtrends.sources import adapters as A
from fieldtrends.suite.places import FLAGS

D = "/root/testdata/sf0.001"


def test_stages_run_over_masks_and_restart(spark, tmp_path):
    rec = A.observations(spark, D)
    gridded = A.gridded(spark, D)
    inputs = Inputs(rec, A.polygons(spark), A.habitat_flags(gridded), A.species_map(spark, D), A.YEARS, A.ORDER, A.GRID_SIZES,
                    mask_flags=FLAGS, sims=2, interval_draws=50, vagrant_years=0)
    run = Assessment(inputs, str(tmp_path), "frequency")
    win = everything(spark, D)
    out = run.long_term(win)
    masks = {r["mask"] for r in out.select("mask").distinct().collect()}
    assert "none" in masks and len(masks) >= 3
    assert out.count() == len(masks) * win.count()  # every listed species has a row in every mask
    assert {r["n"] for r in out.groupBy("common_name").count().withColumnRenamed("count", "n").collect()} == {len(masks)}
    unseen = out.filter("longtermmean IS NULL")
    assert not unseen.isEmpty() and unseen.filter("long_term_status <> 'Insufficient Data'").isEmpty()
    stored = next(tmp_path.glob("binomial-*")) / "_SUCCESS"
    stamp = os.path.getmtime(stored)
    assert Assessment(inputs, str(tmp_path), "frequency").long_term(win).count() == out.count()
    assert os.path.getmtime(stored) == stamp
    ids = run.replicates().groupBy("locality_id", "month", "timegroup", "sim").agg(F.countDistinct("group_id").alias("ids"))
    assert not ids.filter("ids > 1").isEmpty()  # masks draw for themselves
    more = Assessment(replace(inputs, sims=3), str(tmp_path), "frequency").replicates()
    assert more.agg(F.max("sim")).first()[0] == 3  # changed parameters are not served from the old stage
    assert run.time_bins().groupBy("mask").count().filter(f"count <> {len(A.YEARS.labels)}").isEmpty()
    # other windows, by their rows, are not served from the old stage; equal ones are, whatever their plan
    again = win.repartition(3).union(win.limit(0))
    assert run.binomial(again).inputFiles() == run.binomial(win).inputFiles()
    fewer = win.filter(F.col("common_name") != win.agg(F.min("common_name")).first()[0])
    assert run.binomial(fewer).inputFiles() != run.binomial(win).inputFiles()
    assert run.vagrants().columns == run.located().columns and run.fit_stats(win).count() > 0


def test_content_tells_rows(spark):
    a = spark.createDataFrame([("a", 1), ("b", None), ("b", None)], "common_name string, min_era int")
    assert content(a) == content(a.repartition(5)) == content(a.select("min_era", "common_name"))
    assert content(a) != content(a.distinct()) != content(a.fillna(0)) and content(None) is None
    assert content(spark.createDataFrame([], a.schema)) != content(a)


def test_model_of_each_species(spark, tmp_path):
    """Raw trends with a model per species, and the log of its fits. Three species leave some masks without rows, which the check refuses."""
    few = everything(spark, D).orderBy("common_name").limit(3)
    names = [r.common_name for r in few.collect()]
    restricted = spark.createDataFrame([(names[0], 1), (names[1], 0)], "common_name string, mixed int")
    inputs = Inputs(A.observations(spark, D), A.polygons(spark), A.habitat_flags(A.gridded(spark, D)), A.species_map(spark, D), A.YEARS, A.ORDER,
                    A.GRID_SIZES, sims=1, interval_draws=20, restricted=restricted)
    run = Assessment(inputs, str(tmp_path), "chosen")
    win = spark.createDataFrame(few.collect(), few.schema)
    kinds = dict(zip(names, ("single", "fixed", "nested")))
    log = run.fits(win).collect()
    assert log and all(r.model == kinds[r.common_name] for r in log)
    raw = run.raw_trends(win)
    with pytest.raises(ValueError, match="incomplete"):
        run.check(win)
    ok = {r.common_name for r in log if r.status == "ok"}
    assert {r.common_name for r in raw.collect()} == set(names)
    assert {r.common_name for r in raw.filter("freq IS NOT NULL").collect()} == ok
