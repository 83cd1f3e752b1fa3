"""Readers of raw exports, dimensions and many-file result sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Export columns -> canonical names and types. The names of the public export format.
EXPORT_COLUMNS = [
    ("CATEGORY", "category", "string"),
    ("COMMON NAME", "common_name", "string"),
    ("SCIENTIFIC NAME", "scientific_name", "string"),
    ("OBSERVATION COUNT", "obs_count", "string"),
    ("LOCALITY ID", "locality_id", "string"),
    ("LOCALITY TYPE", "locality_type", "string"),
    ("REVIEWED", "reviewed", "int"),
    ("APPROVED", "approved", "int"),
    ("STATE", "state", "string"),
    ("COUNTY", "district", "string"),
    ("LATITUDE", "lat", "double"),
    ("LONGITUDE", "lon", "double"),
    ("OBSERVATION DATE", "obs_date", "date"),
    ("TIME OBSERVATIONS STARTED", "start_time", "string"),
    ("OBSERVER ID", "observer_id", "string"),
    ("PROTOCOL NAME", "protocol", "string"),
    ("DURATION MINUTES", "duration_min", "int"),
    ("EFFORT DISTANCE KM", "distance_km", "double"),
    ("NUMBER OBSERVERS", "number_observers", "int"),
    ("ALL SPECIES REPORTED", "all_species_reported", "int"),
    ("GROUP IDENTIFIER", "group_identifier", "string"),
    ("SAMPLING EVENT IDENTIFIER", "event_id", "string"),
    ("EXOTIC CODE", "exotic_code", "string"),
]
ALIASES = {"PROTOCOL TYPE": "PROTOCOL NAME"}


def _norm(name: str) -> str:
    n = name.replace(".", " ").replace("_", " ").strip().upper()
    return ALIASES.get(n, n)


def read_observations(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[tuple[str, str, str]] = EXPORT_COLUMNS,
) -> DataFrame:
    """S01. Tab-separated unquoted export; named columns only; blanks and spaces become NULL.

    Only headers are read to learn the column order; the data scan has a fixed schema. Files of a list may
    differ in their order of columns: those with the same header are read together.
    """
    reader = spark.read.option("sep", "\t").option("quote", "").option("header", True)
    groups: dict[tuple[str, ...], list[str]] = {}
    for p in [path] if isinstance(path, str) else list(path):
        groups.setdefault(tuple(reader.csv(p).columns), []).append(p)
    return union_sources(*[_read_same(reader, header, paths, columns) for header, paths in groups.items()])


def _read_same(reader, header: Sequence[str], paths: list[str], columns: Sequence[tuple[str, str, str]]) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i, _ in enumerate(header)])
    raw = reader.schema(schema).option("enforceSchema", True).csv(paths)
    where = {_norm(h): f"c{i}" for i, h in enumerate(header)}
    missing = [src for src, _, _ in columns if src not in where]
    if missing:
        raise ValueError(f"export lacks columns {missing}")
    return raw.select(*[
        F.nullif(F.trim(F.col(where[src])), F.lit("")).try_cast(typ).alias(dst) for src, dst, typ in columns
    ])


def union_sources(*parts: DataFrame) -> DataFrame:
    """S02. Append further files with the same columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_dim(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """S03. CSV dimension; ``NA`` and blanks are NULL. Give a schema to skip the inference pass."""
    r = spark.read.option("header", True).option("nullValue", "NA").option("multiLine", False)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    return df.select(*[
        F.nullif(F.trim(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes
    ])


def read_partitioned(spark: SparkSession, root: str, schema: T.StructType | None = None, **where) -> DataFrame:
    """S04. One dataset laid out as ``mask=/sim=``: partition values become columns, filters prune."""
    r = spark.read if schema is None else spark.read.schema(schema)
    df = r.option("basePath", root).parquet(root)
    for k, v in where.items():
        df = df.filter(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    return df


def read_existing(spark: SparkSession, paths: dict[str, str], schema: T.StructType, tag: str = "mask") -> DataFrame:
    """S04. Per-mask CSV files tagged with their mask; absent files are skipped."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = None
    for name, path in paths.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            continue
        df = spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df)
    if out is None:
        return spark.createDataFrame([], T.StructType(schema.fields + [T.StructField(tag, T.StringType())]))
    return out


def read_geojson_attrs(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """S07. Attribute table of a GeoJSON layer; the geometry is never parsed."""
    schema = T.StructType([
        T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", properties)])))
    ])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("f")).select("f.properties.*")


def read_geojson_polygons(spark: SparkSession, path: str, layer: str, id_property: str) -> DataFrame:
    """S07. Polygons of a GeoJSON layer as ``layer, id, rings``, for ``spatial.with_edges``; parts and holes are rings alike.

    Features without a polygon geometry, or without rings, have no area and are left out.
    """
    feature = T.StructType([
        T.StructField("properties", T.StructType([T.StructField(id_property, T.StringType())])),
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    ])
    raw = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).option("multiLine", True).json(path)
    rows = raw.select(F.explode("features").alias("f")).select(
        F.lit(layer).alias("layer"), F.col("f.properties").getField(id_property).alias("id"), "f.geometry.type", "f.geometry.coordinates")
    one = F.from_json("coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", many)
    points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return rows.select("layer", "id", points.alias("rings")).filter(F.size("rings") > 0)
