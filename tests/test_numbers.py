"""NaN, hot groups and ties straight into the operators; percentiles and largest rows against plain ones."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane import pipeline
from terravane.config import ProjectConfig
from terravane.operators import change, labels, raster, relational, series, subsample

NAN = float("nan")


def test_nan_is_no_forest(spark):
    columns = {"lang_tree_height": NAN, "potapov_tree_height": NAN, "gfc_tc00": NAN, "dw_tree_prob__min": NAN}
    df = spark.createDataFrame([(1, *columns.values(), 0, 0, 0, 0)], "id long, " + ", ".join(f"{c} double" for c in columns) + ", gfc_lossyear int, gfc_gain int, tmf_defyear int, tmf_degyear int")
    assert labels.product_labels(df, 2015, 2022).first()["fnf"] == 0


def test_nan_pixels_have_no_forest_area(spark):
    df = spark.createDataFrame([(k, NAN if k % 2 else 50.0, 21 if k < 10 else 0) for k in range(2000)], "id long, gfc_tc00 double, gfc_lossyear int")
    areas, loss = pipeline.SampleSize(ProjectConfig("x")).forest_areas(df)
    a = areas.first()
    assert (a.total_area, a.forest_area, a.change_area) == (1.8, 0.9, 0.0) and [(r.year, r.deforest) for r in loss.collect()] == [(2021, 0.0)]


def test_nan_never_passes_a_threshold(spark):
    names = [*subsample.ABSOLUTE, "bs_slope_mean", "gfc_tc00", "potapov_tree_height"]
    rows = [(k, *[float(k)] * 5, 50.0, 20.0, 0, 0, 0) for k in range(100)] + [(200, *[NAN] * 5, NAN, NAN, 0, 0, 0), (201, *[99.0] * 5, NAN, NAN, 0, 0, 0), (202, *[None] * 7, None, None, None)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names) + ", gfc_lossyear int, tmf_defyear int, tmf_degyear int")
    assert sorted(r.id for r in subsample.over_thresholds(df).collect()) == [96, 97, 98, 99]  # the largest of 101 values, which row 201 is one of


def test_defaults_and_merges_take_nan_for_absent(spark):
    df = spark.createDataFrame([(1, NAN), (2, None), (3, 0.5)], "id long, v double")
    assert sorted((r.id, r.v) for r in series.with_default(df, ["v"]).collect()) == [(1, -9999.0), (2, -9999.0), (3, 0.5)]
    both = relational.merged(df, df.withColumnRenamed("v", "w").withColumn("extra", F.lit(1)), "id")
    assert {(r.id, r.v, r.w) for r in both.collect()} == {(1, None, None), (2, None, None), (3, 0.5, 0.5)}


def test_percentiles_and_largest_rows(spark):
    rng = np.random.default_rng(3)
    g = rng.choice(["hot", "b", "c"], 30_000, p=[0.9, 0.0999, 0.0001])
    v = np.where(rng.random(30_000) < 0.3, 0.0, rng.lognormal(0, 2, 30_000))
    v[:50] = NAN
    df = relational.cut_lineage(spark.createDataFrame(pd.DataFrame({"id": range(30_000), "g": g, "v": v})))
    clean = F.when(~F.isnan("v"), F.col("v"))
    for p in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert abs(relational.exact_percentiles(df, {"v": clean}, p, few=500)["v"] - np.quantile(v[50:], p)) < 1e-9
    got = {r.g: (r.low, r.high) for r in relational.percentiles_by_group(df, "g", clean, {"low": 0.25, "high": 0.95}, 100).collect()}
    for name in ("hot", "b", "c"):
        own = v[(g == name) & ~np.isnan(v)]
        assert np.allclose(got[name], np.quantile(own, [0.25, 0.95]))
    numbers = df.withColumn("v", clean)
    order = np.lexsort((np.arange(30_000), -np.nan_to_num(v, nan=-1)))
    for k in (1, 700, 25_000, 29_990):  # the third ends inside the tie at 0, the last among the nulls
        assert sorted(r.id for r in relational.top_rows(numbers, "v", k, [F.col("id")]).collect()) == sorted(order[:k])
    assert relational.exact_percentiles(df.limit(0), {"v": clean}, 0.5) == {"v": None}


def test_samples_along_an_order_within_groups(spark):
    df = spark.createDataFrame([(k, "hot" if k % 10 else "small") for k in range(1000)], "id long, g string")
    out = relational.systematic_by_group(df, "g", ["id"], 100).toPandas()
    assert out["g"].value_counts().to_dict() == {"hot": 100, "small": 100}
    hot = np.sort(out[out["g"] == "hot"]["id"])
    assert np.diff(hot).max() <= 12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=30))
def test_links(pairs):
    i, j = (np.array([p[k] for p in pairs], int) for k in (0, 1))
    root = raster.linked(16, i, j)
    want = list(range(16))
    for _ in range(16):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert root.tolist() == want


def test_segments_by_running_sums_are_those_of_single_fits():
    rng = np.random.default_rng(1)
    for seed in range(8):
        t = np.sort(rng.uniform(2015, 2022, 90))
        y = np.stack([0.5 + 0.1 * np.sin(2 * np.pi * t) + rng.normal(0, 0.01, 90), 0.3 + rng.normal(0, 0.01, 90)], 1)
        y[t > 2019 + seed / 10] -= 0.3
        start, want = 0, []
        while start + 18 <= 90:
            for end in range(start + 12, 90 - 6 + 1):
                x = change.design(t[start:end], 1)
                beta, *_ = np.linalg.lstsq(x, y[start:end], rcond=None)
                rmse = np.maximum(np.sqrt(((y[start:end] - x @ beta) ** 2).sum(0) / (end - start - 4)), 1e-4)
                r = y[end : end + 6] - change.design(t[end : end + 6], 1) @ beta
                if (((r / rmse) ** 2).sum(1) > change.CHI2_99[2]).all():
                    want.append((t[end], np.median(r, axis=0)))
                    start = end
                    break
            else:
                break
        got = change.ccdc_segments(t, y)
        assert [a for a, _ in got] == [a for a, _ in want] and all(np.allclose(m, n, atol=1e-5) for (_, m), (_, n) in zip(got, want))


def test_stable_history_starts_after_an_old_break():
    rng = np.random.default_rng(2)
    t = np.linspace(2015, 2020, 100)
    x = change.design(t, 1, trend=False)
    assert change.stable_history(x, rng.normal(0, 0.02, 100)) == 0
    first = change.stable_history(x, np.where(t < 2017, 0.2, 0.8) + rng.normal(0, 0.02, 100))
    assert 30 <= first <= 50


def test_charts_have_no_trend():
    """A steady rise is no part of the history's model, so its continuation is a change."""
    t = np.linspace(2015, 2023, 180)
    y = 0.2 + 0.05 * (t - 2015) + 0.005 * np.sin(37 * t)
    out = change.monitoring_charts(t, y, change.ChangeConfig(), 1.0)
    assert out[1] == 1.0 and out[2] > 0


def test_confidence_may_be_negative():
    values = np.array([0.0, 1.0] * 20)
    assert change.cusum(np.arange(40) / 10 + 2015, values, 200, np.random.default_rng(1))[1] <= 0


def test_the_latest_value_that_is_no_mask(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 1.0), (1, 2, NAN, 2.0), (1, 3, None, NAN), (2, 1, None, None)], "k long, o int, a double, b double")
    assert sorted((r.k, r.a, r.b) for r in raster.latest_valid(df, ["k"], ["o"], ["a", "b"]).collect() if r.k == 1) == [(1, 5.0, 2.0)]


def test_qaqc_runs_to_the_end(spark):
    c = ProjectConfig("qa", bands=("ndfi",))
    samples = spark.createDataFrame([(1, 0.5, 0.5, "loss"), (2, 5.5, 0.5, "forest"), (3, 99.0, 0.5, None)], "point_id long, x double, y double, kind string")
    pixels = spark.createDataFrame([(k, 0, f"LC08_001001_2020{m:02d}15", 0.1 * m, None) for k in (0, 5) for m in range(1, 7)], "cell_x long, cell_y long, imageid string, ndfi double, ingested_at timestamp")
    out, done = pipeline.QAQC(c).run(samples, "kind", ["loss"], ["forest", "loss"], pixels, 1.0)
    rows = {r.point_id: r for r in out.collect()}
    assert [(rows[k].CNC, rows[k].FNF, rows[k].images) for k in (1, 2, 3)] == [(1, 1, 6), (0, 1, 6), (0, 0, None)] and done == {"points": 3, "missing": 1}


@pytest.mark.parametrize("trees", [30, 600])
def test_forest_parts_are_one_forest(spark, trees):
    from terravane.operators import ml

    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(label=(x[:, 0] > 0).astype(int), id=range(300)))
    out, model = ml.change_probability(df, list("abc"), "label", trees=trees)
    p = out.orderBy("id").toPandas()
    assert len(model.models) == -(-trees // ml.TREES_AT_ONCE) and sum(model.trees) == trees
    assert ((p["chg_probability"] > 0.5) == (p["label"] == 1)).mean() > 0.95 and p["chg_probability"].between(0, 1).all()
