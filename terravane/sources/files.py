"""Readers and writers of the file forms that the pipeline exchanges. Parquet is the form between stages."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.functions import geometry
from terravane.operators import proximity, relational

LON_NAMES = ("lon", "longitude", "x")
LAT_NAMES = ("lat", "latitude", "y")
COMPACT_DATE = "yyyyMMdd"


def _geometry_type() -> str:
    return "struct<type:string,coordinates:array<double>>"


def read_geojson(spark: SparkSession, path: str, properties: str, dates: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Features of GeoJSON files (a file, a folder or a glob), one row each: the properties and ``x, y`` of a point.

    ``properties`` is the schema of the properties, as a DDL text. Files may be plain or encoded twice (a JSON text
    within a JSON text). ``dates`` are columns of yyyymmdd texts, single or in lists; ``columns`` picks properties.
    A file without features gives no rows; a feature without a geometry has null x, y.
    """
    schema = f"struct<features:array<struct<properties:struct<{properties}>,geometry:{_geometry_type()}>>>"
    raw = spark.read.text(path, wholetext=True)
    text = F.coalesce(F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "struct<v:string>")["v"], F.col("value"))
    f = raw.select(F.explode(F.from_json(text, schema)["features"]).alias("f"))
    names = [n for n in T._parse_datatype_string(f"struct<{properties}>").names if columns is None or n in columns]
    df = f.select(*[F.col(f"f.properties.{n}").alias(n) for n in names], F.get("f.geometry.coordinates", F.lit(0)).alias("x"), F.get("f.geometry.coordinates", F.lit(1)).alias("y"))
    for c in dates or []:
        if c in df.columns:
            several = dict(df.dtypes)[c].startswith("array")
            day = lambda v: F.to_date(v, COMPACT_DATE)
            df = df.withColumn(c, F.transform(c, day) if several else day(F.col(c)))
    return df


def write_geojson(df: DataFrame, path: str, dates: list[str] | None = None, lon: str = "x", lat: str = "y", encode_twice: bool = True, rows_per_file: int = 50_000) -> None:
    """A folder of GeoJSON files of some ``rows_per_file`` features each, which is what a task holds as one text; dates
    become yyyymmdd texts."""
    files = math.ceil(df.count() / rows_per_file)
    out = df if files <= df.rdd.getNumPartitions() else df.repartition(files)
    for c in dates or []:
        several = dict(df.dtypes)[c].startswith("array")
        out = out.withColumn(c, F.transform(c, lambda d: F.date_format(d, COMPACT_DATE)) if several else F.date_format(c, COMPACT_DATE))
    properties = F.to_json(F.struct(*[c for c in df.columns if c not in (lon, lat)]))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.concat(F.lit('{"type":"Point","coordinates":['), lon, F.lit(","), lat, F.lit("]}"))).otherwise(F.lit("null")), F.lit("}"))
    lines = out.select(feature.alias("value"))

    def collection(batches):
        rows = [v for b in batches for v in b["value"]]  # one output file's rows
        if rows:
            text = '{"type":"FeatureCollection","features":[' + ",".join(rows) + "]}"
            yield pd.DataFrame({"value": [json.dumps(text) if encode_twice else text]})

    lines.mapInPandas(collection, "value string").write.mode("overwrite").text(path)


def read_batches(spark: SparkSession, path: str, schema: str | None = None, skip: list[str] | None = None, key: str = "point_id") -> DataFrame:
    """Parquet files with ``batch``, the part of the file's name before the first underscore: named batches skipped, and
    one row of each key of a batch kept (repeated deliveries within a batch are copies)."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    df = df.withColumn("batch", F.element_at(F.split(name, "_"), 1))
    if skip:
        df = df.where(~F.col("batch").isin(*skip))
    return df.dropDuplicates(["batch", key])


def write_batches(df: DataFrame, path: str, batch: str = "batch") -> None:
    """One partition folder per batch; only the batches in df are replaced, so a run can be taken up again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)


def unprocessed(df: DataFrame, spark: SparkSession, path: str, key: str = "point_id") -> DataFrame:
    """Rows whose key is not in the output folder yet; all of them if there is none."""
    try:
        done = spark.read.parquet(path).select(key)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder, or nothing in it
            raise
        return df
    return df.join(done.distinct(), key, "left_anti")


def pick(columns: list[str], names: tuple[str, ...]) -> str:
    """The first column whose name, in lower case, is one of the names."""
    for c in columns:
        if c.lower() in names:
            return c
    raise ValueError(f"no column is named like one of {', '.join(names)}")


def read_samples(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV samples with ``x, y`` from whatever columns hold longitude and latitude."""
    df = spark.read.schema(schema).csv(path, header=True) if schema else spark.read.csv(path, header=True, inferSchema=True)
    lon, lat = pick(df.columns, LON_NAMES), pick(df.columns, LAT_NAMES)
    return df.withColumns({"x": F.col(lon).cast("double"), "y": F.col(lat).cast("double")})


def read_training(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV training samples with ``x, y`` from lon and lat, or from the text of a point where those are null."""
    df = spark.read.schema(schema).csv(path, header=True) if schema else spark.read.csv(path, header=True, inferSchema=True)
    g = F.col("geometry") if "geometry" in df.columns else F.lit(None).cast("string")

    def of(name: str, other: Column) -> Column:
        return F.coalesce(F.col(name).cast("double"), other) if name in df.columns else other

    return df.withColumns({"x": of("lon", proximity.geometry_lon(g)), "y": of("lat", proximity.geometry_lat(g))})


def to_degrees(df: DataFrame, crs: str = "crs", x: str = "x", y: str = "y") -> DataFrame:
    """df with x, y in longitude and latitude: from EPSG:4326 and CRS84 as they are, from EPSG:3857 (the spherical Mercator)
    and EPSG:6933 (the equal-area cylinder at 30 degrees) by their inverse. Another crs gives null."""
    code = F.upper(F.regexp_extract(crs, "([A-Za-z0-9]+)$", 1))
    a = geometry.SEMI_MAJOR
    mercator = F.degrees(F.col(x) / a), F.degrees(2 * F.atan(F.exp(F.col(y) / a)) - math.pi / 2)
    cylinder = geometry.behrmann_lon(F.col(x)), geometry.behrmann_lat(F.col(y))
    pick = lambda own, k: F.when(code.isin("4326", "CRS84"), own).when(code == "3857", mercator[k]).when(code == "6933", cylinder[k])
    return df.withColumns({x: pick(F.col(x), 0), y: pick(F.col(y), 1), crs: F.lit("EPSG:4326")})


def read_aoi(spark: SparkSession, path: str, crs: str = "EPSG:4326") -> DataFrame:
    """``poly_id, ring, i, x, y, crs`` of the polygons and multipolygons of a GeoJSON file in degrees; other geometries are
    left out.

    The file's own crs name counts if it has one; see ``to_degrees``. All polygons together are the area, so a point is in it
    where any of them holds it."""
    schema = "struct<crs:struct<properties:struct<name:string>>,features:array<struct<geometry:struct<type:string,coordinates:string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    g = raw.select(F.coalesce("j.crs.properties.name", F.lit(crs)).alias("crs"), F.posexplode("j.features.geometry").alias("feature", "g"))
    polygon = F.from_json("g.coordinates", "array<array<array<double>>>")
    many = F.from_json("g.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("g.type") == "Polygon", F.array(polygon)).when(F.col("g.type") == "MultiPolygon", many)
    p = g.where(F.col("g.type").isin("Polygon", "MultiPolygon")).select("crs", "feature", F.posexplode(parts).alias("part", "rings"))
    p = relational.numbered(p, ["feature", "part"], "_p").select("crs", (F.col("_p") + 1).cast("int").alias("poly_id"), F.posexplode("rings").alias("ring", "points"))
    v = p.select("crs", "poly_id", "ring", F.posexplode("points").alias("i", "c"))
    return to_degrees(v.select("poly_id", "ring", "i", F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y"), "crs"))


def write_plots(df: DataFrame, path: str, key: str = "point_id", extra: dict[str, str] | None = None) -> None:
    """CSV with PLOTID, LAT, LON (and the extra columns under their names), with a header."""
    df.select(F.col(key).alias("PLOTID"), F.col("y").alias("LAT"), F.col("x").alias("LON"), *[F.col(c).alias(n) for c, n in (extra or {}).items()]).write.mode("overwrite").csv(path, header=True)


def landsat_pixels(spark: SparkSession, path: str, sensors: list[str], start: str, end: str, max_cloud: float, bands: list[str]) -> DataFrame:
    """Pixel rows of a parquet table (sensor, date, cloud, cell_x, cell_y, bands): all filters and the projection reach
    the scan."""
    df = spark.read.parquet(path)
    df = df.where(F.col("sensor").isin(*sensors) & (F.col("cloud") <= max_cloud) & (F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))
    return df.select("sensor", "date", "cell_x", "cell_y", *bands)
