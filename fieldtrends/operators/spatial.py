"""Grid cells, polygon tagging and cell-level reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtrends.functions.maths import floor_cell
from fieldtrends.functions.nulls import n_distinct_with_null, null_safe_join
from fieldtrends.functions.ranking import first_per, top_n

CELL_STRIDE = 100000


def cell_id(lon: Column, lat: Column, size: float) -> Column:
    """Cell of a regular grid as one BIGINT: column index * stride + row index."""
    return floor_cell(lon, size) * F.lit(CELL_STRIDE).cast("bigint") + floor_cell(lat, size)


def with_grids(df: DataFrame, sizes: dict[str, float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """G01. Grid cells by arithmetic: regular grids need no spatial join."""
    return df.withColumns({name: cell_id(F.col(lon), F.col(lat), s) for name, s in sizes.items()})


def polygon_layer(spark: SparkSession, polygons: Sequence[tuple[str, str, Sequence]]) -> DataFrame:
    """Polygons (layer, id, ring or list of rings) as edge arrays with bounding boxes. Parts and holes are further rings."""
    def rings(shape) -> list:
        shape = list(shape)
        one = bool(shape) and isinstance(shape[0][0], (int, float))
        return [[(float(x), float(y)) for x, y in ring] for ring in ([shape] if one else shape)]

    rows = [(layer, pid, rings(shape)) for layer, pid, shape in polygons]
    return with_edges(spark.createDataFrame(rows, "layer string, id string, rings array<array<struct<x: double, y: double>>>"))


def with_edges(polygons: DataFrame) -> DataFrame:
    """Rings (parts and holes alike) to edges (x1, y1, x2, y2); a ring may repeat its first point at its end."""
    def edges_of(ring: Column) -> Column:
        nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        return F.zip_with(ring, nxt, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))

    points = F.flatten("rings")
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return polygons.select(
        "layer", "id", F.flatten(F.transform("rings", edges_of)).alias("edges"),
        F.array_min(xs).alias("minx"), F.array_max(xs).alias("maxx"), F.array_min(ys).alias("miny"), F.array_max(ys).alias("maxy"),
    )


def polygon_index(polygons: DataFrame, bucket: float = 1.0) -> DataFrame:
    """layer, id, bx, by, whole, edges: the buckets of a grid that a polygon reaches.

    Edges are dealt to the latitude bands that they touch, so a bucket never holds a whole ring. A bucket without an edge is inside
    or outside as a whole, which its centre tells: it is marked or left out. The others hold the edges of their band that are not
    wholly west of them, the only ones that a ray to the east can cross.
    """
    edge = polygons.select("layer", "id", F.explode("edges").alias("e"))
    low, high = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    bands = edge.withColumn("by", F.explode(F.sequence(floor_cell(low, bucket), floor_cell(high, bucket))))
    band = bands.groupBy("layer", "id", "by").agg(
        F.collect_list("e").alias("edges"), F.min(F.least("e.x1", "e.x2")).alias("west"), F.max(F.greatest("e.x1", "e.x2")).alias("east"))
    cells = band.withColumn("bx", F.explode(F.sequence(floor_cell(F.col("west"), bucket), floor_cell(F.col("east"), bucket))))
    left, bottom = F.col("bx") * F.lit(bucket), F.col("by") * F.lit(bucket)
    # a little wider than the bucket, so that rounding never hides an edge
    slack = F.lit(bucket * 1e-6)
    near = F.exists("edges", lambda e: (
        (F.greatest(e["x1"], e["x2"]) >= left - slack) & (F.least(e["x1"], e["x2"]) <= left + bucket + slack)
        & (F.greatest(e["y1"], e["y2"]) >= bottom - slack) & (F.least(e["y1"], e["y2"]) <= bottom + bucket + slack)))
    cells = cells.withColumn("whole", ~near)
    cells = cells.filter(~F.col("whole") | inside(left + bucket / 2, bottom + bucket / 2, F.col("edges")))
    kept = F.filter("edges", lambda e: F.greatest(e["x1"], e["x2"]) >= left - slack)
    return cells.select("layer", "id", "bx", "by", "whole", F.when(~F.col("whole"), kept).alias("edges"))


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Ray casting: an odd number of edges crosses the ray to the east of the point."""
    crossed = F.filter(edges, lambda e: (
        ((e["y1"] > y) != (e["y2"] > y))
        & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    ))
    return F.size(crossed) % 2 == 1


def tag_layer(
    points: DataFrame, polygons: DataFrame, layer: str, out: str, key: str = "group_id", bucket: float = 1.0,
) -> DataFrame:
    """G01. Pairs (key, polygon id) of one layer; polygons may have parts and holes (even-odd rule).

    Polygons are cut onto a coarse grid (``polygon_index``), so the join is an equi-join on the bucket (hashable, skew
    handled by AQE) instead of a nested-loop range join. Points of a bucket wholly inside need no test; the others
    are tested against the edges of their bucket's band.
    """
    p = polygon_index(polygons.filter(F.col("layer") == layer), bucket)
    pts = points.select(
        key, "lon", "lat",
        floor_cell(F.col("lon"), bucket).alias("bx"), floor_cell(F.col("lat"), bucket).alias("by"),
    )
    hit = F.col("whole") | inside(F.col("lon"), F.col("lat"), F.col("edges"))
    return pts.join(p, ["bx", "by"]).filter(hit).select(key, F.col("id").alias(out)).distinct()


def checklist_points(obs: DataFrame, order: Sequence[str], key: str = "group_id") -> DataFrame:
    """One coordinate per checklist."""
    need = [key, "lon", "lat"]
    return first_per(obs.select(*need, *[o for o in order if o not in need]), [key], order).select(*need)


def tag_points(
    points: DataFrame, polygons: DataFrame, layers: dict[str, str], sizes: dict[str, float],
    key: str = "group_id", bucket: float = 1.0,
) -> DataFrame:
    """G01. Left spatial joins of points with polygon layers ({column: layer}) and grids."""
    out = with_grids(points, sizes)
    for col, layer in layers.items():
        out = out.join(tag_layer(points, polygons, layer, col, key, bucket), key, "left")
    return out


def first_match(tags: DataFrame, order: Sequence, key: str = "group_id") -> DataFrame:
    """G02. One tag row per checklist when polygons overlap."""
    return first_per(tags, [key], order)


def land_only_with_habitat(
    obs: DataFrame, tags: DataFrame, habitat: DataFrame, key: str = "group_id", cell: str = "gridg1",
) -> DataFrame:
    """G03. Attach tags, drop points outside the land buffer, attach habitat flags by cell."""
    joined = obs.join(tags.drop("lon", "lat"), key).filter(F.col("land").isNotNull()).drop("land")
    return joined.join(habitat, cell, "left")


def apply_mask(obs: DataFrame, flags: dict[str, str], state: str = "state", area: str = "pa_name") -> DataFrame:
    """G04. All masks in one pass: each row is emitted once per mask it belongs to.

    ``flags`` maps mask name to its 0/1 column. Compute per-mask results with ``mask`` as one more
    grouping key; 42 separate scans of the table become one.
    """
    parts = [F.lit("none")]
    parts += [F.when(F.col(c) == 1, F.lit(m)) for m, c in flags.items()]
    parts += [F.when(F.col(area).isNotNull(), F.lit("PA")), F.col(state)]
    return obs.withColumn("mask", F.explode(F.array_compact(F.array(*parts))))


def sampled_cells(obs: DataFrame, cells: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """G05. Sampled cells per resolution; a missing cell counts once."""
    return obs.groupBy(*by).agg(*[n_distinct_with_null(F.col(c)).alias(c) for c in cells])


def admin_mismatch(obs: DataFrame, declared: str, located: str, value, columns: Sequence[str]) -> DataFrame:
    """G06. Distinct rows of a district by declaration but not by location, and the reverse.

    ``value`` restricts the check to one district; None checks all districts at once.
    """
    a = obs if value is None else obs.filter((F.col(declared) == value) | (F.col(located) == value))
    by_name = F.col(declared).isNotNull() & ~F.col(declared).eqNullSafe(F.col(located))
    by_place = F.col(located).isNotNull() & ~F.col(declared).eqNullSafe(F.col(located))
    if value is not None:
        by_name, by_place = by_name & (F.col(declared) == value), by_place & (F.col(located) == value)
    first = a.filter(by_name).select(*columns, F.col(declared).alias("district"), F.lit("declared").alias("only_by"))
    second = a.filter(by_place).select(*columns, F.col(located).alias("district"), F.lit("located").alias("only_by"))
    return first.unionByName(second).distinct()


def points_in(points: DataFrame, polygons: DataFrame, layer: str, pid: str, key: str) -> DataFrame:
    """G07. Points inside one polygon."""
    one = polygons.filter(F.col("id") == pid)
    return points.join(tag_layer(points, one, layer, "__id", key).select(key), key, "left_semi")


def drop_false_presence(
    occ: DataFrame, truth: DataFrame, keys: Sequence[str] = ("common_name", "gridg1"), present: str = "occupancy",
) -> DataFrame:
    """G08. Drop cells marked present without any true record there.

    The reference finds the false keys, then removes every row with those keys; both steps kept.
    """
    keys = list(keys)
    false = occ.filter(F.col(present) == 1).join(truth.select(*keys), keys, "left_anti").select(*keys).distinct()
    return occ.join(false, keys, "left_anti")


def cell_coverage(cells: DataFrame, obs: DataFrame, cell: str = "gridg1", key: str = "group_id") -> DataFrame:
    """G09. Every cell with its number of checklists, zero included."""
    n = obs.groupBy(cell).agg(F.count_distinct(key).alias("lists"))
    return cells.select(cell).distinct().join(n, cell, "left").select(
        cell, F.coalesce("lists", F.lit(0)).cast("bigint").alias("lists"),
        F.coalesce(F.col("lists") > 0, F.lit(False)).alias("sampled"),
    )


def top_priority_cells(
    obs: DataFrame, main: DataFrame, n: int = 5, region: str = "state", cell: str = "gridg1",
    species: str = "common_name", status: str = "priority_status",
) -> DataFrame:
    """G10. Cells of each state with most high-priority species (ties by cell)."""
    high = main.filter(F.col(status) == "High").select(F.col("species").alias(species)).distinct()
    counts = (
        obs.select(region, cell, species).distinct().join(high, species, "left_semi")
        .groupBy(region, cell).agg(F.count(F.lit(1)).alias("no_sp"))
    )
    return top_n(counts, [region], [F.col("no_sp").desc(), F.col(cell)], n)


def queen_neighbours(cells: DataFrame, cell: str = "gridg1") -> DataFrame:
    """G11. Edges between cells that touch by side or corner: eight offsets, one equi-join."""
    own = cells.select(cell).distinct()
    steps = [dx * CELL_STRIDE + dy for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
    wanted = own.withColumn(
        "nb_cell", F.explode(F.array(*[F.col(cell) + F.lit(s).cast("bigint") for s in steps])))
    return wanted.join(own.select(F.col(cell).alias("nb_cell")), "nb_cell", "left_semi").select(cell, "nb_cell")


def range_layer(
    occ: DataFrame, cells: DataFrame, vagrants: DataFrame, cell: str = "gridg1", species: str = "common_name",
    only: str | None = None,
) -> DataFrame:
    """G12. Map layer: every cell, left-filled with species, occupancy and seasons present, and vagrant
    points as their own rows.

    Cells without any species appear once with NULLs, so the layer grows with the occupied cells and
    not with species x cells; ``only`` restricts it to one species' map before the join.
    """
    if only is not None:
        occ, vagrants = occ.filter(F.col(species) == only), vagrants.filter(F.col(species) == only)
    status = occ.groupBy(species, cell).agg(
        F.max("occupancy").alias("occupancy"),
        F.array_join(F.array_sort(F.collect_set("status")), ",").alias("seasons"),
    )
    layer = cells.select(cell).distinct().join(status, cell, "left").select(
        species, cell, "occupancy", "seasons", F.lit(False).alias("vagrant"))
    points = vagrants.select(species, cell).distinct().select(
        species, cell, F.lit(None).cast("double").alias("occupancy"),
        F.lit(None).cast("string").alias("seasons"), F.lit(True).alias("vagrant"))
    return layer.unionByName(points)


def attach_tags(obs: DataFrame, tags: DataFrame, key: str = "group_id") -> DataFrame:
    """Tags back on observation rows, NULL keys included."""
    return null_safe_join(obs, tags.drop("lon", "lat"), [key], "left")
