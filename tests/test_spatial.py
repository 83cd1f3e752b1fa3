import random

from pyspark.sql import functions as F

from fieldtrends.operators import spatial

RING = [(0.5, 0.5), (6.5, 1.2), (7.1, 6.3), (3.0, 3.2), (0.9, 7.0)]


def brute(x, y, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def test_tagging_matches_brute_force(spark):
    rnd = random.Random(1)
    pts = [(f"p{i}", rnd.uniform(0, 8), rnd.uniform(0, 8)) for i in range(500)]
    points = spark.createDataFrame(pts, "group_id string, lon double, lat double")
    layer = spatial.polygon_layer(spark, [("l", "a", RING), ("other", "b", [(0, 0), (8, 0), (8, 8), (0, 8)])])
    got = {r.group_id for r in spatial.tag_layer(points, layer, "l", "tag", bucket=0.7).collect()}
    assert got == {p for p, x, y in pts if brute(x, y, RING)}
    plan = spatial.tag_layer(points, layer, "l", "tag")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_masks_in_one_pass(spark):
    obs = spark.createDataFrame([("g1", 1, 0, "P", "A"), ("g2", None, 1, None, "B")], "g string, w int, c int, pa_name string, state string")
    out = spatial.apply_mask(obs, {"woodland": "w", "cropland": "c"}).groupBy("mask").agg(F.count("*").alias("n"))
    assert {r["mask"]: r["n"] for r in out.collect()} == {"none": 2, "woodland": 1, "cropland": 1, "PA": 1, "A": 1, "B": 1}


def test_neighbours_are_symmetric(spark):
    cells = spark.createDataFrame([(x * spatial.CELL_STRIDE + y,) for x in range(5) for y in range(4)], "gridg1 long")
    edges = {(r.gridg1, r.nb_cell) for r in spatial.queen_neighbours(cells).collect()}
    assert all((b, a) in edges for a, b in edges)
    inner = 2 * spatial.CELL_STRIDE + 1
    assert sum(a == inner for a, _ in edges) == 8 and sum(a == 0 for a, _ in edges) == 3


def test_parts_and_holes_match_brute_force(spark):
    """Two parts, one with a hole, edges along bucket borders, and points on a fine grid around them."""
    outer, hole, island, far = [(0, 0), (6, 0), (6, 6), (0, 6)], [(1.5, 1), (4.5, 1.2), (5, 5), (1, 4.4)], [(2, 2), (3.5, 2.1), (3, 3.9)], [(8.2, -3.3), (11.9, 0.4), (9, 4)]
    shapes = [("l", "multi", [outer, hole, island, far]), ("l", "thin", [(-2, 3.31), (12, 3.32), (12, 3.34)]), ("l", "none", [])]
    rnd = random.Random(5)
    pts = [(f"p{i}", rnd.uniform(-3, 13), rnd.uniform(-4, 7)) for i in range(1500)] + [(f"g{x}_{y}", x / 2 + 0.01, y / 2 + 0.01) for x in range(-4, 26) for y in range(-8, 14)]
    points = spark.createDataFrame(pts, "group_id string, lon double, lat double")
    layer = spatial.polygon_layer(spark, shapes[:2])

    def odd(x, y, rings):
        return sum(brute(x, y, r) for r in rings) % 2 == 1

    want = {(p, "multi") for p, x, y in pts if odd(x, y, shapes[0][2])} | {(p, "thin") for p, x, y in pts if brute(x, y, shapes[1][2])}
    for bucket in (0.5, 1.0, 2.7, 50.0):
        assert {tuple(r) for r in spatial.tag_layer(points, layer, "l", "tag", bucket=bucket).collect()} == want
    index = spatial.polygon_index(layer.filter("id = 'multi'"), 0.5)
    assert index.filter("whole").count() >= 15 and index.agg(F.max(F.size("edges"))).first()[0] < 14
    inside = spatial.points_in(points, layer, "l", "multi", "group_id")
    assert {r.group_id for r in inside.collect()} == {p for p, i in want if i == "multi"}


def test_geojson_geometry(spark, tmp_path):
    import json

    from fieldtrends.sources import observations

    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]
    features = [
        {"type": "Feature", "properties": {"name": "a", "x": 1}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}},
        {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[hole], [[[5, 5, 9], [6, 5, 9], [6, 6, 9], [5, 5, 9]]]]}},
        {"type": "Feature", "properties": {"name": "c"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {"name": "d"}, "geometry": None}]
    f = tmp_path / "l.geojson"
    f.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    layer = spatial.with_edges(observations.read_geojson_polygons(spark, str(f), "l", "name"))
    pts = spark.createDataFrame([("edge", 0.5, 0.5), ("hole", 2.0, 2.0), ("far", 5.7, 5.2), ("out", 9.0, 9.0)], "group_id string, lon double, lat double")
    assert {tuple(r) for r in spatial.tag_layer(pts, layer, "l", "tag").collect()} == {("edge", "a"), ("hole", "b"), ("far", "b")}
