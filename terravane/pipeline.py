"""The stages of an area-estimation project as DataFrame-in, DataFrame-out classes.

Each stage builds one lazy plan; nothing is paged, chunked or retried by hand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.config import ProjectConfig
from terravane.functions import estimation, geometry
from terravane.operators import change, labels, ml, proximity, raster, relational, series, subsample


@dataclass
class SampleSize:
    """How many samples an area needs."""

    config: ProjectConfig

    def forest_areas(self, pixels: DataFrame, pixel_area_m2: float = 900.0) -> tuple[DataFrame, DataFrame]:
        """(areas, loss by year) in km2 from pixels with gfc_tc00 and gfc_lossyear (0: none); a null or NaN cover is no forest."""
        c = self.config
        p = pixels.withColumn("f", estimation.above("gfc_tc00", c.tree_cover).cast("int"))
        start, end = int(c.monitor_start[2:4]), int(c.monitor_end[2:4])
        lost = lambda a, b: F.sum(F.when(F.col("gfc_lossyear").between(a, b), F.col("f")).otherwise(0))
        km2 = lambda x: F.round(x * pixel_area_m2 / 1e6 + 1e-9, 2)
        areas = p.agg(km2(F.count("*")).alias("total_area"), km2(F.sum("f") - lost(1, start - 1)).alias("forest_area"), km2(lost(start, end)).alias("change_area"))
        loss = p.where("gfc_lossyear > 0 and f = 1").groupBy((2000 + F.col("gfc_lossyear")).alias("year")).agg(km2(F.count("*")).alias("deforest"))
        return areas, loss

    def sweep(self, areas: DataFrame) -> DataFrame:
        """Relative margins of error (%) of forest and change, and the grid spacing in km, for 10 000 to 490 000 samples."""
        n = areas.sparkSession.range(10_000, 500_000, 10_000).withColumnRenamed("id", "sample_size")
        j = n.crossJoin(F.broadcast(areas))  # one row
        margin = lambda a: estimation.relative_margin(F.try_divide(F.col(a), F.col("total_area")), F.col("sample_size"), self.config.confidence) * 100
        return j.select("sample_size", margin("forest_area").alias("moe_forest"), margin("change_area").alias("moe_change"), estimation.grid_spacing(F.col("total_area"), F.col("sample_size")).alias("spacing_km"))

    def minimum_sample_size(self, areas: DataFrame) -> DataFrame:
        """The first size of the sweep whose margin for change is below the target; no row if none is."""
        return self.sweep(areas).where(F.col("moe_change") < 100 * self.config.max_error).orderBy("sample_size").limit(1)

    def simulated_error(self, pixels: DataFrame, spacings: list[float], runs: int = 10) -> DataFrame:
        """Bias and uncertainty of the change share when one pixel (cell_x, cell_y, value 0/1) is drawn per grid cell.

        Every run draws by its own hash, in an aggregate of its own over the cells, so a pixel stands once per spacing and
        not once per run; actual is the share of all pixels."""
        p = pixels.withColumn("spacing", F.explode(F.array(*[F.lit(float(s)) for s in spacings])))
        draw = p.groupBy("spacing", F.floor(F.col("cell_x") / F.col("spacing")).alias("i"), F.floor(F.col("cell_y") / F.col("spacing")).alias("j"))
        drawn = draw.agg(*[F.max_by("value", F.xxhash64("cell_x", "cell_y", F.lit(k))).alias(f"v{k}") for k in range(runs)])
        by_run = drawn.groupBy("spacing").agg(F.count("*").alias("n"), *[F.avg(f"v{k}").alias(f"v{k}") for k in range(runs)])  # one row a spacing
        shares = by_run.select("spacing", "n", F.explode(F.array(*[F.col(f"v{k}") for k in range(runs)])).alias("x"))
        j = shares.join(F.broadcast(pixels.agg(F.avg("value").alias("actual"))))
        gap, z = F.abs(F.col("x") - F.col("actual")), estimation.z_value(self.config.confidence)
        return j.groupBy("spacing").agg(F.avg("n").alias("sample_size"), (F.avg(gap) * 100).alias("mean_bias"), (F.stddev_pop(gap) * 100).alias("sd_bias"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), (F.try_divide(z * F.stddev_pop("x"), F.avg("x")) * 100).alias("uncertainty"))


@dataclass
class SampleDesign:
    """Where the samples lie."""

    config: ProjectConfig

    def generate_samples(self, aoi: DataFrame) -> DataFrame:
        """``point_id, x, y, poly_id`` of the grid's points in the area; random points are drawn by hash within a cell."""
        bounds = tuple(aoi.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())
        spark, c = aoi.sparkSession, self.config
        if c.grid_shape == "hexagonal":
            metres = c.grid_spacing * geometry.SEMI_MAJOR * 3.141592653589793 / 180
            g = raster.hex_grid(spark, bounds, metres * metres / 1e6).drop("x", "y").withColumnsRenamed({"lon": "x", "lat": "y"})
        else:
            g = raster.square_grid(spark, bounds, c.grid_spacing)
            if c.grid_strategy == "random":
                u = lambda k: relational.arithmetic_hash(F.col("point_id"), c.seed + k) / 4294967296.0
                g = g.withColumns({"x": F.col("xmin") + u(0) * c.grid_spacing, "y": F.col("ymin") + u(101) * c.grid_spacing})
        return raster.inside(g, aoi).select("point_id", "x", "y", "poly_id")


@dataclass
class TimeSeriesExtraction:
    """Series at the samples."""

    config: ProjectConfig

    def extract(self, points: DataFrame, pixels: DataFrame, cell: float) -> DataFrame:
        """Long readings: each point with the pixels (cell_x, cell_y, imageid, bands, ingested_at) of its cell."""
        p = points.select("point_id", "x", "y", raster.cell(F.col("x"), cell).alias("cell_x"), raster.cell(F.col("y"), cell).alias("cell_y"))
        return p.join(pixels, ["cell_x", "cell_y"]).drop("cell_x", "cell_y")

    def get_time_series_data(self, readings: DataFrame) -> DataFrame:
        """Nested series from raw readings."""
        bands = list(self.config.bands)
        return series.nested(series.assemble(series.observations(readings, bands), bands), bands)

    def check_if_completed(self, points: DataFrame, done: DataFrame) -> dict[str, int]:
        """Points in all, and how many have no series yet."""
        left = relational.missing(points, done, "point_id").count()
        return {"points": points.select("point_id").distinct().count(), "missing": left}


@dataclass
class DatasetAugmentation:
    """Change features of the series."""

    config: ProjectConfig

    def prepare(self, readings: DataFrame) -> DataFrame:
        """Assembled readings without outliers, smoothed, and cut to calibration and monitoring, in this order."""
        c, bands = self.config, list(self.config.bands)
        a = series.drop_outliers(readings, bands, c.band, c.outlier_z)
        return series.open_interval(series.rolling_mean(a, bands, c.smooth_days), c.calibration_start, c.monitor_end)

    def augment(self, readings: DataFrame, products: DataFrame | None = None, enabled: tuple[str, ...] = ("cusum", "slope", "timescan", "bfast", "nrt", "ccdc")) -> DataFrame:
        """One row per point: all enabled features from one pass over its series, joined to its products if given."""
        c = self.config
        year = lambda t: float(t[:4])
        conf = change.ChangeConfig(band=c.band, bands=tuple(b for b in c.bands if b != c.band), start_monitor=year(c.monitor_start), end_monitor=year(c.monitor_end), enabled=enabled, seed=c.seed)
        nested = series.nested(self.prepare(readings), list(c.bands))
        out = change.features(nested, conf, "point_id", int(year(c.calibration_start)), int(year(c.monitor_end)))
        return joined_branches(out, products, "point_id") if products is not None else out


def joined_branches(left: DataFrame, right: DataFrame, key: str, payload: tuple[str, ...] = ("ts", "dates", "geometry", "images")) -> DataFrame:
    """Features of two branches of the stage side by side; the second one's copies of the series are left out."""
    return left.join(right.drop(*payload), key)


DataAugmentation = DatasetAugmentation


@dataclass
class KMeansSubSampling:
    """Training points spread over clusters of like features."""

    config: ProjectConfig

    def cluster(self, features: DataFrame, columns: list[str]) -> DataFrame:
        return ml.kmeans(features, ml.candidate_columns(features, columns), self.config.clusters, self.config.seed)

    def select_samples(self, clustered: DataFrame, key: str = "point_id", sampling_type: str = "random") -> DataFrame:
        """The points of each cluster by hash, or with 'space_filling_curve' evenly along a Hilbert curve over x and y."""
        if sampling_type == "space_filling_curve":
            b = clustered.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
            if b[0] is None:
                return clustered.where("false")
            curve = geometry.hilbert_key(geometry.scaled(F.col("x"), b[0], b[1]), geometry.scaled(F.col("y"), b[2], b[3]))
            return relational.systematic_by_group(clustered.withColumn("_h", curve), "cluster", ["_h", key], self.config.points_per_cluster).drop("_h")
        return relational.sample_per_group(clustered, "cluster", key, self.config.points_per_cluster, self.config.seed)


@dataclass
class ThresholdSubSampling:
    """Training points that stand out."""

    config: ProjectConfig

    def extract_training_samples(self, features: DataFrame, max_points: int | None = None) -> DataFrame:
        c = self.config
        out = subsample.over_thresholds(features, c.percentile, c.tree_cover, c.tree_height, int(c.monitor_start[:4]), int(c.monitor_end[:4]))
        if max_points is None:
            return out
        b = out.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if b[0] is None:
            return out
        key = geometry.hilbert_key(geometry.scaled(F.col("x"), b[0], b[1]), geometry.scaled(F.col("y"), b[2], b[3]))
        return relational.systematic(out.withColumn("_h", key), ["_h", "point_id"], max_points, 0).drop("_h")


@dataclass
class EnsembleClassification:
    """Probability of change for every point."""

    config: ProjectConfig

    def training_table(self, features: DataFrame, training: DataFrame, target: str, distance: float = 0.001) -> DataFrame:
        """features (point_id, x, y, ...) with the target of the training sample (sample_id, x, y, target) nearest to each
        point; points at which several samples are equally near come once per sample."""
        near = raster.nearest(features, training, distance, "sample_id")
        return near.join(training.select(F.col("sample_id").alias("near_sample_id"), target), "near_sample_id", "left").drop("near_sample_id")

    def binary_change_probability(self, table: DataFrame, predictors: list[str], target: str, trees: int = 1500, **options) -> tuple[DataFrame, object]:
        return ml.change_probability(table, predictors, target, trees=trees, seed=self.config.seed, **options)


@dataclass
class QAQC:
    """Flags and completeness of interpreted samples."""

    config: ProjectConfig

    def flags(self, samples: DataFrame, column: str, change_categories: list, forest_categories: list) -> DataFrame:
        """samples with change (CNC) and forest (FNF) flags by their category."""
        return samples.withColumns({"CNC": labels.membership(F.col(column), change_categories), "FNF": labels.membership(F.col(column), forest_categories)})


    def run(self, samples: DataFrame, column: str, change_categories: list, forest_categories: list, pixels: DataFrame, cell: float, key: str = "point_id") -> tuple[DataFrame, dict[str, int]]:
        """(flagged samples with their smoothed series, completeness): all samples in one extraction, so there is nothing to
        take up again; samples without a pixel keep a null series and are counted as missing."""
        flagged = self.flags(samples, column, change_categories, forest_categories)
        extraction = TimeSeriesExtraction(self.config)
        bands = list(self.config.bands)
        readings = extraction.extract(flagged.select(F.col(key).alias("point_id"), "x", "y").dropDuplicates(["point_id"]), pixels, cell)
        smooth = series.rolling_mean(series.assemble(series.observations(readings, bands), bands), bands, self.config.smooth_days)
        nested = series.nested(smooth, bands).withColumnRenamed("point_id", key)
        return flagged.join(nested, key, "left"), extraction.check_if_completed(flagged.select(F.col(key).alias("point_id")), nested.select(F.col(key).alias("point_id")))


def provinces(points: DataFrame, aoi: DataFrame) -> DataFrame:
    """Points with the polygon around each (null outside)."""
    places = proximity.point_locations(points)
    return places.join(proximity.containing_region(places, aoi), "point_id", "left")
