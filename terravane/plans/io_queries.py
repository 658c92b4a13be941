"""Sources, sinks and streams: what is written is read again, what is streamed ends like the table, and SQL says what either is."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import estimation, geometry
from terravane.operators import relational
from terravane.plans.core_queries import LAT, LON
from terravane.plans.reference_queries import _A1, _FIRST_F, _P, assembled, first_features, places, r, sr
from terravane.session import ensure_checkpoint_dir, table
from terravane.sources import files
from terravane.streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT series_id, point_id, images, CAST(len(dates) AS INT) AS n_dates, list_min(dates) AS first_date, CASE WHEN y IS NOT NULL THEN {sr('x')} END AS x, CASE WHEN x IS NOT NULL THEN {sr('y')} END AS y FROM series")
def geojson_roundtrip(spark, d):
    """Nested series as GeoJSON encoded twice, with dates as texts. A feature has both coordinates or no geometry."""
    path = scratch(spark, "geojson")
    files.write_geojson(table(spark, d, "series").select("series_id", "point_id", "dates", "images", "x", "y"), path, ["dates"])
    s = files.read_geojson(spark, path, "series_id bigint, point_id bigint, dates array<string>, images int", ["dates"])
    return s.select("series_id", "point_id", "images", F.size("dates").alias("n_dates"), F.array_min("dates").alias("first_date"), r("x").alias("x"), r("y").alias("y"))


@query(f"WITH {_P} SELECT point_id, x, y FROM p")
def plots_roundtrip(spark, d):
    """Plots as CSV, read by whatever names longitude and latitude have."""
    path = scratch(spark, "plots")
    files.write_plots(places(spark, d), path)
    return files.read_samples(spark, path, "PLOTID bigint, LAT double, LON double").select(F.col("PLOTID").alias("point_id"), r("x").alias("x"), r("y").alias("y"))


@query(f"SELECT sample_id, change_label, {sr(f'coalesce(lon, {LON})')} AS x, {sr(f'coalesce(lat, {LAT})')} AS y FROM training")
def training_roundtrip(spark, d):
    """Training samples as CSV with lon, lat or a point's text."""
    path = scratch(spark, "training")
    table(spark, d, "training").select("sample_id", "lon", "lat", "geometry", "change_label").write.csv(path, header=True)
    t = files.read_training(spark, path, "sample_id bigint, lon double, lat double, geometry string, change_label int")
    return t.select("sample_id", "change_label", r("x").alias("x"), r("y").alias("y"))


@query(f"WITH {_FIRST_F} SELECT point_id, chunk_id FROM ff WHERE point_id NOT IN (SELECT point_id FROM features WHERE chunk_id % 2 = 0 AND point_id IS NOT NULL)")
def resumed_batches(spark, d):
    """A run that was broken off: half of the batches are written, the rest is found by what is missing."""
    path = scratch(spark, "batches")
    files.write_batches(table(spark, d, "features").where("chunk_id % 2 = 0").select("point_id", F.col("chunk_id").alias("batch")), path)
    return files.unprocessed(first_features(spark, d), spark, path).select("point_id", "chunk_id")


@query("SELECT dense_rank() OVER (ORDER BY poly_id)::int AS poly_id, ring, i, round(x, 6) AS x, round(y, 6) AS y FROM aoi")
def aoi_roundtrip(spark, d):
    """The area as GeoJSON in Mercator metres, read back in degrees."""
    path, a = scratch(spark, "aoi"), geometry.SEMI_MAJOR
    v = table(spark, d, "aoi").select("poly_id", "ring", "i", (a * F.radians("x")).alias("mx"), (a * F.log(F.tan(math.pi / 4 + F.radians("y") / 2))).alias("my"))
    ring = v.groupBy("poly_id", "ring").agg(F.array_sort(F.collect_list(F.struct("i", F.array("mx", "my").alias("c")))).alias("v")).select("poly_id", "ring", F.col("v.c").alias("c"))
    poly = ring.groupBy("poly_id").agg(F.array_sort(F.collect_list(F.struct("ring", "c"))).alias("r")).select("poly_id", F.col("r.c").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("poly_id").alias("properties"), F.struct(F.lit("Polygon").alias("type"), "coordinates").alias("geometry"))
    whole = poly.agg(F.array_sort(F.collect_list(F.struct("poly_id", feature.alias("f")))).alias("f"))  # one file of a few polygons
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.lit("urn:ogc:def:crs:EPSG::3857").alias("name")).alias("properties"))
    whole.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), crs.alias("crs"), F.col("f.f").alias("features"))).alias("value")).write.text(path)
    return files.read_aoi(spark, path).select("poly_id", "ring", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""SELECT point_id, split_part(imageid, '_', 1) AS sensor, CAST(try_strptime(split_part(imageid, '_', 3), '%Y%m%d') AS DATE) AS date, ndfi FROM obs
WHERE split_part(imageid, '_', 1) IN ('LC08', 'LE07') AND point_id % 100 <= 75 AND CAST(try_strptime(split_part(imageid, '_', 3), '%Y%m%d') AS DATE) >= DATE '2018-01-01' AND CAST(try_strptime(split_part(imageid, '_', 3), '%Y%m%d') AS DATE) < DATE '2020-01-01'""")
def pixel_source(spark, d):
    """A pixel table filtered by sensor, cloud and date at the scan."""
    path, parts = scratch(spark, "pixels"), F.split("imageid", "_")
    o = table(spark, d, "obs")
    o.select(F.get(parts, F.lit(0)).alias("sensor"), F.try_to_date(F.get(parts, F.lit(2)), "yyyyMMdd").alias("date"), (F.col("point_id") % 100).cast("double").alias("cloud"), F.col("point_id").alias("cell_x"), F.lit(0).cast("long").alias("cell_y"), "ndfi").write.parquet(path)
    p = files.landsat_pixels(spark, path, ["LC08", "LE07"], "2018-01-01", "2020-01-01", 75, ["ndfi"])
    return p.select(F.col("cell_x").alias("point_id"), "sensor", "date", "ndfi")


def streamed(spark: SparkSession, stream: DataFrame, mode: str, schema: str) -> DataFrame:
    """Everything that a stream gives until its source is used up: the table of its last state, or of all its updates."""
    out = scratch(spark, "streamed")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number if mode == 'update' else 0}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", scratch(spark, "stream")).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(f"{schema}, batch int").parquet(out)


@query(f"""SELECT date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS window_start, event_type, count(*) AS n, {sr('sum(value)', 4)} AS value
FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE ts IS NOT NULL GROUP BY ALL""")
def stream_windows(spark, d):
    """Sliding windows over the events as a stream with a watermark, to the end of the stream."""
    path, e = scratch(spark, "events"), table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")  # a watermark needs an instant
    e.repartition(1).write.parquet(path)
    counts = monitor.windowed_counts(spark.readStream.schema(e.schema).parquet(path)).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "value")
    return streamed(spark, counts, "complete", "window_start timestamp_ntz, event_type string, n long, value double").select("window_start", "event_type", "n", r("value", 4).alias("value"))


@query(f"""WITH {_A1}, z AS (SELECT point_id, year(date) + round(dayofyear(date) / 365.0, 3) AS t, round((ndfi - avg(ndfi) OVER w) / nullif(stddev_pop(ndfi) OVER w, 0), 6) AS v FROM a WINDOW w AS (PARTITION BY point_id))
SELECT point_id, count(*) AS n, round(list_reduce(list_prepend(0::double, list(v ORDER BY t, v)), lambda s, v: 0.7::double * s + 0.3::double * v), 5) AS ewma FROM z WHERE v IS NOT NULL GROUP BY point_id""")
def stream_monitor(spark, d):
    """The EWMA chart of each series as keyed state over a stream that comes in two parts, early and late readings."""
    from pyspark.sql.window import Window

    path, w = scratch(spark, "readings"), Window.partitionBy("point_id")
    a = assembled(spark, d).select("point_id", estimation.fraction_year(F.col("date")).alias("t"), F.round((F.col("ndfi") - F.avg("ndfi").over(w)) / F.nullif(F.stddev_pop("ndfi").over(w), F.lit(0.0)), 6).alias("residual"))
    a = relational.cut_lineage(a.where("residual is not null"))
    for part in (F.col("t") < 2019, F.col("t") >= 2019):  # files are streamed in the order of their times
        a.where(part).repartition(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = streamed(spark, monitor.ewma_monitor(stream), "update", monitor.OUTPUT)
    last = out.groupBy("point_id").agg(F.max_by(F.struct("n", "ewma"), "n").alias("s"))
    return last.select("point_id", "s.n", F.round("s.ewma", 5).alias("ewma"))
