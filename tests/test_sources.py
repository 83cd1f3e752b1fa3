import json

import pytest

from fieldtrends.session import cut_lineage, staged
from fieldtrends.sources import masks, observations as o, sinks
from pyspark.sql import types as T


def test_export_is_read_by_name_with_blanks_as_null(spark, tmp_path):
    names = [s.replace(" ", ".") for s, _, _ in o.EXPORT_COLUMNS]
    values = {s: " " for s in names} | {"COMMON.NAME": 'Jerdon\'s "Bush" Lark', "LATITUDE": "10.5", "OBSERVATION.DATE": "2020-02-01", "REVIEWED": "0"}
    order = list(reversed(names)) + ["LAST.EDITED"]
    f = tmp_path / "e.txt"
    f.write_text("\t".join(order) + "\n" + "\t".join(values.get(n, "z") for n in order) + "\n")
    r = o.read_observations(spark, str(f)).first()
    assert r.common_name == 'Jerdon\'s "Bush" Lark' and r.lat == 10.5 and str(r.obs_date) == "2020-02-01"
    assert r.duration_min is None and r.group_identifier is None and r.reviewed == 0
    g = tmp_path / "f.txt"  # the same columns in another order
    g.write_text("\t".join(names) + "\n" + "\t".join(values.get(n, "z") for n in names) + "\n")
    both = o.read_observations(spark, [str(f), str(g)]).collect()
    assert len(both) == 2 and both[0] == both[1]
    f.write_text("A\tB\n1\t2\n")
    with pytest.raises(ValueError):
        o.read_observations(spark, str(f))


def test_geojson_attributes(spark, tmp_path):
    f = tmp_path / "m.geojson"
    f.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"cell": i, "woodland": i % 2}, "geometry": {"type": "Point", "coordinates": [0, 0]}} for i in range(3)]}, indent=1))
    df = o.read_geojson_attrs(spark, str(f), T.StructType.fromDDL("cell int, woodland int"))
    assert sorted((r.cell, r.woodland) for r in df.collect()) == [(0, 0), (1, 1), (2, 0)]


def test_missing_files_are_skipped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,NA\n")
    df = o.read_existing(spark, {"A": str(tmp_path / "a.csv"), "B": str(tmp_path / "none.csv")}, T.StructType.fromDDL("x int, y string"))
    assert [tuple(r) for r in df.collect()] == [(1, None, "A")]


def test_gathering_refuses_incomplete_results(spark):
    want = spark.createDataFrame([("a", 1), ("a", 2)], "mask string, sim int")
    with pytest.raises(ValueError):
        sinks.require_complete(want, want.filter("sim = 1"))
    sinks.require_complete(want, want)


def test_mask_lookup(spark):
    reg = masks.masks(spark.createDataFrame([("Goa",), ("Assam",), (None,)], "state string"))
    assert masks.mask(reg, "Goa")["code"] == "07_goa" and reg.count() == 7
    with pytest.raises(ValueError):
        masks.mask(reg, "nowhere")


def test_staging_and_checkpoint_keep_rows_and_cut_plans(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS g")
    a, b = staged(df), cut_lineage(df)
    assert a.count() == b.count() == 100
    assert "Range" not in b._jdf.queryExecution().analyzed().toString()
