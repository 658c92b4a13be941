"""Kernels, relational operators, sources, settings and streaming on hand-made cases."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.config import ConfigError, ProjectConfig
from terravane.functions import estimation, geometry
from terravane.operators import change, labels, ml, raster, relational, series
from terravane.sources import files
from terravane.streaming import monitor
from terravane import pipeline

D = dt.date


def test_cusum_of_a_step(spark):
    y = np.r_[np.ones(20), np.zeros(20)]
    t = 2020 + np.arange(40) / 40
    date, confidence, magnitude = change.cusum(t, y, 500, np.random.default_rng(0))
    assert (date, magnitude) == (t[19], 10.0) and confidence > 0.5
    assert change.cusum(t[:0], y[:0], 10, np.random.default_rng(0)) == (-1.0, -1.0, -1.0)
    assert change.cusum(t, np.ones(40), 10, np.random.default_rng(0))[1:] == (0.0, 0.0)
    obs = spark.createDataFrame([(1, D(2020, 1, 1) + dt.timedelta(days=k), float(k < 20)) for k in range(40)], "point_id long, date date, v double")
    r = series.cusum(obs, "v").first()
    assert r.magnitude == 10.0 and r.date == D(2020, 1, 20)


def test_slopes_of_a_line():
    t = np.linspace(2015, 2020, 30)
    mean, sd, top, low = change.bootstrap_slope(t, 2 * t + 1, 200, 0.66, np.random.default_rng(0))
    assert all(abs(v - 2) < 1e-6 for v in (mean, top, low)) and sd < 1e-6
    assert change.bootstrap_slope(t[:0], t[:0], 5, 0.66, np.random.default_rng(0)) == (-1.0,) * 4


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=1, max_size=40))
def test_cusum_properties(values):
    t = np.arange(len(values)) / 23 + 2015
    _, confidence, magnitude = change.cusum(t, np.array(values), 30, np.random.default_rng(1))
    assert magnitude >= 0 and -np.inf < confidence <= 1


def planted(break_at=2021.0, drop=0.4, seed=0):
    t = np.arange(2015, 2023, 1 / 22)
    y = 0.7 + 0.05 * np.sin(2 * np.pi * t) + np.random.default_rng(seed).normal(0, 0.02, len(t))
    return t, np.where(t >= break_at, y - drop, y)


def test_planted_breaks_are_dated():
    c = change.ChangeConfig()
    critical = change.mosum_critical(c.h_share, c.level)
    t, y = planted()
    date, magnitude, _ = change.bfast_monitor(t, y, c, critical)
    assert 2021 <= date < 2021.4 and -0.5 < magnitude < -0.1
    charts = change.monitoring_charts(t, y, c, critical)
    assert all(charts[k] >= 2021 and charts[k] < 2021.6 and charts[k + 1] == 1 for k in (0, 3, 6))
    breaks = change.ccdc_segments(t, np.stack([y, y], 1))
    date, size = change.largest_break(breaks, 2020, 2023, 0)
    assert abs(date - 2021) < 0.1 and abs(size + 0.4) < 0.1
    assert change.bfast_monitor(t, planted(drop=0)[1], c, critical)[0] == -1.0
    assert change.bfast_monitor(t[t < 2020], y[t < 2020], c, critical) == (-2.0, 0.0, 0.0)
    assert change.monitoring_charts(t[:3], y[:3], c, critical) == [0.0] * 9
    years = np.arange(2010, 2023.0)
    magnitude, duration, first, _, last = change.landtrendr(years, np.where(years < 2016, 0.8, 0.3))
    assert abs(magnitude - 0.5) < 0.1 and first == 2016 and last == 2016 and duration == 1


def test_features_of_odd_series(spark):
    s = spark.createDataFrame([(1, None, None), (2, [], {"ndfi": []}), (3, [D(2020, 5, 1)], {"ndfi": [0.5]}), (4, [D(2020, 5, 1), None], {"ndfi": [None, float("nan")]})], "series_id long, dates array<date>, ts map<string,array<double>>")
    out = {r.series_id: r for r in change.features(s).collect()}
    assert len(out) == 4 and out[1].cusum_magnitude == -1 and out[3].images == 1 and out[4].images == 0 and out[2].bfast_change_date == -2


def test_features_do_not_depend_on_partitions(spark):
    t, y = planted()
    days = [D(2015, 1, 1) + dt.timedelta(days=round((v - 2015) * 365.25)) for v in t]
    s = spark.createDataFrame([(k, days, {"ndfi": (y + k / 100).tolist()}) for k in range(6)], "series_id long, dates array<date>, ts map<string,array<double>>")
    a, b = (sorted(map(tuple, change.features(s.repartition(n)).collect())) for n in (1, 5))
    assert a == b


def test_window_edge_open_interval_and_assembly(spark):
    day = lambda k: D(2020, 1, 1) + dt.timedelta(days=k)
    o = spark.createDataFrame([(1, day(0), 1.0), (1, day(59), 3.0), (1, day(60), 5.0)], "point_id long, date date, v double")
    assert [r.v for r in series.rolling_mean(o, ["v"]).orderBy("date").collect()] == [1.0, 2.0, 4.0]
    assert [r.date for r in series.open_interval(o, str(day(0)), str(day(60))).collect()] == [day(59)]
    raw = [(1, f"LC08_{p}_{d}", g, n, k) for k, (p, d, g, n) in enumerate([("001002", "20200101", 0.1, 0.5), ("001002", "20200102", 0.2, 0.5), ("001003", "20200103", 0.3, -9999.0), ("001003", "20200104", 0.4, 0.5), ("001003", "20200105", 0.5, 0.5), ("001003", "20200105", 0.6, 0.6), ("001003", "20200106", -9999.0, 0.6)])]
    df = spark.createDataFrame([(i, im, g, g, g, g, g, n, 0.0, 0.0, k) for i, im, g, n, k in raw], "point_id long, imageid string, green double, red double, nir double, swir1 double, swir2 double, ndfi double, x double, y double, ingested_at long")
    a = series.assemble(series.observations(df)).orderBy("date").collect()
    assert [(r.path_row, r.date.day, r.green, r.ndfi) for r in a] == [("001003", 3, 0.3, None), ("001003", 4, 0.4, 0.5), ("001003", 5, 0.5, 0.5)]
    assert series.drop_outliers(o, ["v"], "v").count() == 3


@settings(max_examples=12, deadline=None)
@given(st.integers(1, 60), st.integers(1, 70), st.integers(0, 5))
def test_systematic_sample_is_the_loop(spark, n, target, start):
    df = spark.range(n)
    got = sorted(r.id for r in relational.systematic(df, ["id"], target, start).collect())
    want, f = [], target / n
    for i in range(start, n):
        j = i - start + 1
        if target >= n or math.ceil(j * f) != math.ceil((j - 1) * f):
            want.append(i)
    assert got == want


def test_numbers_are_dense(spark):
    df = spark.createDataFrame([(v,) for v in [None, 5, 3, 3, 9, 1] * 50], "v int").withColumn("id", F.monotonically_increasing_id())
    got = relational.numbered(df, ["v", "id"]).orderBy("n").collect()
    assert [r.n for r in got] == list(range(300)) and [r.v for r in got[:50]] == [None] * 50
    assert relational.numbered(df.limit(0), ["v", "id"]).count() == 0


def test_a_hot_group_is_sampled_like_any(spark):
    data = [(k, 0 if k % 3 else k % 50) for k in range(3000)]
    df = spark.createDataFrame(data, "id long, g int")
    h = lambda k: (k % 2**30 + 5) * 2654435761 % 2**32
    want = {k for g in {g for _, g in data} for k in sorted((k for k, x in data if x == g), key=lambda k: (h(k), k))[:7]}
    assert {r.id for r in relational.sample_per_group(df, "g", "id", 7, 5).collect()} == want


def test_first_of_a_hot_key(spark):
    df = spark.createDataFrame([(1 if k % 3 else k, 5000 - k, None if k % 2 else k) for k in range(3000)], "key long, t long, v long")
    got = {r["key"]: (r.t, r.v) for r in relational.keep_first(df, ["key"], ["t"]).collect()}
    assert got[1] == (2001, None) and got[2997] == (2003, None) and len(got) == 1001
    assert relational.keep_first(df.limit(0), ["key"], ["t"]).count() == 0


def test_trailing_means_by_day(spark):
    df = spark.createDataFrame([(1, D(2024, 1, d), float(v)) for d, v in ((1, 1), (1, 3), (7, 5), (8, 7))] + [(2, D(2024, 1, 1), None)], "u long, date date, v double")
    got = sorted((r.u, r.date.day, r["mean"]) for r in series.rolling_mean_by_day(df, "v", 7, "u").collect())
    assert got == [(1, 1, 2.0), (1, 7, 3.0), (1, 8, 6.0), (2, 1, None)]


def test_votes(spark):
    df = spark.createDataFrame([(9.0, 9.0, 50.0, 16, 0), (1.0, 1.0, 1.0, 15, 0), (9.0, 1.0, None, 0, 1)], "lang_tree_height double, potapov_tree_height double, gfc_tc00 double, gfc_lossyear int, gfc_gain int")
    df = df.withColumns({"tmf_defyear": F.lit(None).cast("int"), "tmf_degyear": F.lit(0)})
    assert [(r.fnf, r.cnc) for r in labels.product_labels(df, 2015, 2022).collect()] == [(1, 1), (0, 0), (None, 1)]


def test_nearest_keeps_ties_and_misses(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, None, 1.0)], "id long, x double, y double")
    right = spark.createDataFrame([(10, 0.0005, 0.0), (11, -0.0005, 0.0), (12, 0.0009, 0.0)], "sid long, x double, y double")
    got = sorted((r.id, r.near_sid) for r in raster.nearest(left, right, 0.001, "sid").collect() if r.near_sid)
    assert got == [(1, 10), (1, 11)] and raster.nearest(left, right, 0.001, "sid").count() == 4


def test_components_across_tiles(spark):
    cells = [(k, 0) for k in range(250, 270)] + [(k, 600 - k) for k in range(-300, -250)] + [(1000, 1000)]
    got = {(r.cell_x, r.cell_y): r.size for r in raster.components(spark.createDataFrame(cells, "cell_x long, cell_y long")).collect()}
    assert got[255, 0] == 20 and got[-260, 860] == 50 and got[1000, 1000] == 1


def test_clipping_and_random_points(spark):
    ring = lambda r, pts: [(1, r, i, x, y) for i, (x, y) in enumerate(pts)]
    v = ring(0, [(0.2, 0.3), (7.9, 0.1), (9.0, 6.0), (3.0, 8.5), (0.2, 0.3)]) + ring(1, [(4.0, 3.0), (5.0, 3.0), (5.0, 4.5), (4.0, 3.0)])
    aoi = spark.createDataFrame(v, "poly_id int, ring int, i int, x double, y double")
    x, y = np.array([p[3] for p in v[:4]]), np.array([p[4] for p in v[:4]])
    whole = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2 - 0.75
    for bucket in (0.7, 3.0):
        areas = raster.clipped_area(raster.square_grid(spark, (0.0, 0.0, 10.0, 10.0), 0.9), aoi, bucket)
        assert abs(areas.agg(F.sum("area")).first()[0] - whole) < 1e-9
    p = raster.random_points(aoi, 30)
    assert p.count() == 30 and raster.inside(p.select(F.col("k").cast("long").alias("point_id"), "x", "y"), aoi).count() == 30


def test_projection_and_curve(spark):
    df = spark.createDataFrame([(12.5, -60.0), (170.0, 0.1), (-90.0, 89.0)], "lon double, lat double")
    x, y = geometry.behrmann_x(F.col("lon")), geometry.behrmann_y(F.col("lat"))
    back = df.select("lon", "lat", geometry.behrmann_lon(x).alias("a"), geometry.behrmann_lat(y).alias("b")).collect()
    assert all(abs(r.lon - r.a) < 1e-9 and abs(r.lat - r.b) < 1e-7 for r in back)
    g = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    walk = [(r.x, r.y) for r in g.withColumn("d", geometry.hilbert_key(F.col("x"), F.col("y"), 4)).orderBy("d").collect()]
    assert len({*walk}) == 256 and all(abs(a - c) + abs(b - e) == 1 for (a, b), (c, e) in zip(walk, walk[1:]))


def test_estimation(spark):
    r = spark.range(1).select(estimation.sample_size(F.lit(0.02), 0.1).alias("n"), estimation.relative_margin(F.lit(0.5), F.lit(10_000)).alias("m"), estimation.sample_size(F.lit(0.0), 0.1).alias("z"), estimation.fraction_year(F.lit("2020-12-31").cast("date")).alias("t")).first()
    assert r.n == math.ceil(1.959963984540054**2 * 0.02 * 0.98 / 0.002**2) and abs(r.m - 0.0195996) < 1e-6 and r.z is None and abs(r.t - 2021.003) < 1e-9


def test_models(spark):
    rng = np.random.default_rng(0)
    data = [(int(k), float(a), float(b), None if k % 3 == 0 else int(a > 0)) for k, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))]
    df = spark.createDataFrame(data, "id long, a double, b double, label int")
    out, model = ml.change_probability(df, ["a", "b", "not_there"], "label", trees=20, outlier_share=0.1)
    assert out.count() == 300
    right = out.where("id % 3 = 0").select(F.avg(((F.col("chg_probability") > 0.5) == (F.col("a") > 0)).cast("int"))).first()[0]
    assert right > 0.9
    importance = ml.permutation_importance(model, df, ["a", "b"], "label", 2).collect()
    assert importance[0].feature == "a" and importance[0].importance > 0.2
    with pytest.raises(ValueError):
        ml.require_two_classes(df.where("a > 0"), "label")
    perceptron, _ = ml.change_probability(df, ["a", "b"], "label", neural=True)
    assert perceptron.where("chg_probability between 0 and 1").count() == 300
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (3.0,), (None,)], "v double")
    assert [r.v for r in ml.imputed(odd, ["v"]).collect()] == [1.0, 2.0, 2.0, 3.0, 2.0]


def test_geojson_both_ways(spark, tmp_path):
    df = spark.createDataFrame([(1, [D(2020, 1, 2), D(2021, 3, 4)], 170.5, 0.25), (2, [], None, None)], "point_id long, dates array<date>, x double, y double")
    for twice in (True, False):
        files.write_geojson(df.coalesce(1), str(tmp_path / "g"), ["dates"], encode_twice=twice)
        back = files.read_geojson(spark, str(tmp_path / "g"), "point_id long, dates array<string>", ["dates"])
        assert sorted((r.point_id, tuple(r.dates), r.x, r.y) for r in back.collect()) == [(1, (D(2020, 1, 2), D(2021, 3, 4)), 170.5, 0.25), (2, (), None, None)]


def test_other_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("PLOTID,Latitude,LONGITUDE\n1,0.5,170\n")
    assert [(r.x, r.y) for r in files.read_samples(spark, str(tmp_path / "s.csv")).collect()] == [(170.0, 0.5)]
    (tmp_path / "t.csv").write_text('lon,lat,geometry,label\n,,"POINT (171 0.2)",1\n170,0.1,,0\n')
    assert sorted((r.x, r.y) for r in files.read_training(spark, str(tmp_path / "t.csv")).collect()) == [(170.0, 0.1), (171.0, 0.2)]
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[6,5],[6,6],[5,5]]]]}}]}')
    a = files.read_aoi(spark, str(tmp_path / "a.geojson"))
    assert a.count() == 8 and a.select("poly_id").distinct().count() == 2
    df = spark.createDataFrame([("b1", 1, 5), ("b2", 2, 6)], "batch string, point_id long, v int")
    files.write_batches(df, str(tmp_path / "out"))
    files.write_batches(df.where("batch = 'b2'").withColumn("v", F.lit(9)), str(tmp_path / "out"))
    assert sorted((r.batch, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("b1", 5), ("b2", 9)]
    assert files.unprocessed(spark.range(3).withColumnRenamed("id", "point_id"), spark, str(tmp_path / "out")).count() == 1


def test_settings(tmp_path):
    c = ProjectConfig("demo")
    c.save(tmp_path / "c.json")
    assert ProjectConfig.load(tmp_path / "c.json") == c
    with pytest.raises(ConfigError):
        ProjectConfig("demo", scale=30).save(tmp_path / "c.json")
    for bad in (dict(name="a b"), dict(name="x", percentile=1.5), dict(name="x", monitor_start="2010-01-01"), dict(name="x", grid_shape="round"), dict(name="x", monitor_end="soon")):
        with pytest.raises(ConfigError):
            ProjectConfig(**bad)


def test_stages(spark):
    c = ProjectConfig("demo", grid_spacing=1.0)
    square = [(1, 0, i, x, y, "EPSG:4326") for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.5, 4.0), (0.0, 4.0), (0.0, 0.0)])]
    aoi = spark.createDataFrame(square, "poly_id int, ring int, i int, x double, y double, crs string")
    assert pipeline.SampleDesign(c).generate_samples(aoi).count() == 16
    areas = spark.createDataFrame([(250_000.0, 100_000.0, 9_000.0)], "total_area double, forest_area double, change_area double")
    assert pipeline.SampleSize(c).sweep(areas).count() == 49 and pipeline.SampleSize(c).minimum_sample_size(areas).count() == 1
    pixels = spark.range(10_000).select(F.floor(F.col("id") / 100).alias("cell_x"), (F.col("id") % 100).alias("cell_y"), (F.col("id") % 10 == 0).cast("double").alias("value"))
    assert [r.sample_size for r in pipeline.SampleSize(c).simulated_error(pixels, [10.0, 20.0], 3).orderBy("spacing").collect()] == [100.0, 25.0]


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = [(k % 3, 2020 + i / 50, float(rng.normal(0, 1) + 6 * (i > 30 and k % 3 == 0))) for i in range(60) for k in range(3)]
    schema = "point_id long, t double, residual double"
    for n in range(3):
        spark.createDataFrame([r for r in data if n == int((r[1] - 2020) * 50 + 0.5) // 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = monitor.ewma_monitor(stream).writeStream.format("memory").queryName("charts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.point_id: (r.n, round(r.ewma, 9), r.change_date) for r in spark.table("charts").collect()}
    want = {r.point_id: (r.n, round(r.ewma, 9), r.change_date) for r in monitor.ewma_batch(spark.createDataFrame(data, schema)).collect()}
    assert got == want and want[0][2] > 2020.5
