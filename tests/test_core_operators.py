"""The general operators against brute force and on edge cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.operators import fill, measured, proximity, regular_grid, spikes

D = dt.date


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- regular grid ---------------------------------------------------------------------------------------------------

SERIES = "series_id long, dates array<date>, ts map<string,array<double>>, source string, m int, own int"


def series(spark, data):
    return spark.createDataFrame([(i, d, t, "x", 1, 2) for i, d, t in data], SERIES)


def test_gaps_and_fills(spark):
    nan = float("nan")
    s = series(spark, [
        (1, [D(2015, 12, 5), D(2016, 3, 1), D(2016, 2, 1), D(2016, 1, 9), None], {"ndfi": [0.2, 0.8, -9999.0, nan, 0.5]}),
        (2, [D(2018, 1, 1), D(2018, 1, 20)], {"ndfi": [0.1, 0.3]}),
        (3, None, {"ndfi": [0.1]}), (4, [D(2018, 1, 1)], None), (5, [D(1900, 1, 1), D(2019, 5, 1)], {"ndfi": [0.1, 0.2]}), (6, [], {"ndfi": []}),
    ])
    r = regular_grid.nested_readings(s, "ndfi")
    assert rows(regular_grid.monthly_grid(r).where("status = 'filled'").select("source", "month")) == [(1, "2016-01"), (1, "2016-02")]
    grid = {(x.source, x.month): (round(x.value, 6), x.n_readings, x.status) for x in regular_grid.monthly_grid(r).collect()}
    assert grid[1, "2016-01"] == (0.4, 0, "filled") and grid[1, "2016-02"] == (0.6, 0, "filled")
    assert grid[2, "2018-01"] == (0.2, 2, "observed") and grid[5, "2019-05"] == (0.2, 1, "observed") and len(grid) == 6


def test_grid_of_a_long_gap_crosses_empty_shards(spark):
    r = spark.createDataFrame([(1, D(2015, 1, 1), 0.0), (1, D(2021, 1, 1), 72.0), (None, D(2015, 1, 1), 1.0), (1, D(2015, 1, 1), 0.0)], "source long, date date, value double")
    g = regular_grid.monthly_grid(r).where("source = 1").orderBy("month").collect()
    assert len(g) == 73 and [round(x.value, 6) for x in g] == [float(k) for k in range(73)]
    assert regular_grid.monthly_grid(r).where("source is null").count() == 1
    assert regular_grid.monthly_grid(r.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [1, 5, 12, 40])
def test_shards_do_not_matter(spark, shard):
    rng = np.random.default_rng(3)
    data = [(int(i), D(2015, 1, 1) + dt.timedelta(days=int(rng.integers(0, 2500))), float(rng.integers(0, 50))) for i in range(4) for _ in range(9)]
    r = spark.createDataFrame(data, "source long, date date, value double")
    assert rows(regular_grid.monthly_grid(r, shard)) == rows(regular_grid.monthly_grid(r, 7))


# --- spikes ---------------------------------------------------------------------------------------------------------


def wave(n, seed=0, sd=0.01):
    t = np.arange(n) * 25.0
    return t, 0.4 + 0.05 * np.sin(2 * np.pi * t / 365.25) + np.random.default_rng(seed).normal(0, sd, n)


def verdict(t, y, lo=0.0, hi=1.0):
    return spikes.judge(t[None], y[None], np.array([lo]), np.array([hi]))[0]


@pytest.mark.parametrize("seed", range(5))
def test_planted_spikes_are_found_and_shifts_kept(seed):
    t, y = wave(80, seed)
    y[40:] += 0.25
    y[[10, 60, 79]] += (0.3, -0.25, 0.3)
    y[[25, 26, 27]] -= 0.3
    y[5], y[6] = 1.7, -0.2
    assert set(np.nonzero(verdict(t, y))[0]) == {5, 6, 10, 25, 26, 27, 60, 79}


@pytest.mark.parametrize("tail", [2, 3, 4])
def test_a_change_up_to_the_end_lasts(tail):
    t, y = wave(60, 4)
    y[-tail:] -= 0.3
    assert not verdict(t, y).any()
    y = wave(60, 4)[1]
    y[:tail] -= 0.3
    assert not verdict(t, y).any()


def test_stuck_runs_skip_absent_values():
    t, y = wave(60)
    y[20:28] = 0.31
    y[23] = np.nan
    assert set(np.nonzero(verdict(t, y))[0]) == {20, 21, 22, 24, 25, 26, 27}
    assert not verdict(*wave(60)).any()


def test_order_of_storage_does_not_matter():
    t, y = wave(70, 2)
    y[30] += 0.4
    p = np.random.default_rng(0).permutation(70)
    assert set(p[np.nonzero(verdict(t[p], y[p]))[0]]) == {30}


def test_short_and_odd_rows(spark):
    bad = float("inf")
    s = series(spark, [
        (1, [D(2018, 1, 1)], {"ndfi": [1.5], "green": [0.5]}), (2, None, None), (3, [], {}), (4, [D(2018, 1, 1), None], {"ndfi": [None, -2.0], "green": [-9999.0, bad]}),
        (5, [D(2018, 1, 1)], {"ndfi": [0.1, 9.0]}), (None, [D(2018, 1, 1)], {"ndfi": [9.0]}), (1, [D(2018, 1, 1)], {"ndfi": [1.5], "green": [0.5]}),
    ])
    found = spikes.implausible_readings(s)
    assert rows(found) == [(1, "ndfi", 0, "impossible"), (1, "ndfi", 0, "impossible"), (4, "green", 1, "impossible"), (4, "ndfi", 1, "impossible")]  # infinity is none of the absent values
    assert spikes.implausible_readings(s.limit(0)).count() == 0


# --- filling --------------------------------------------------------------------------------------------------------


def test_dependencies_groups_and_marks(spark):
    data = [(k, k // 2, "a" if k < 40 else "b", float(k // 2), "z", 1) for k in range(80)]
    data += [(100, 3, "a", None, "z", 1), (101, 999, "b", None, "z", 1), (102, None, None, None, "z", 1), (102, None, None, None, "z", 1)]
    df = spark.createDataFrame(data, "row_id long, point_id long, chunk string, v double, v_from string, _n int")
    deps = fill.mine_dependencies(fill.dictionaries(df, ["v"], [("point_id",), ("chunk",)]), ["v"], [("point_id",), ("chunk",)])
    assert [d.determinant for d in deps] == [("point_id",)]
    out = {}
    for x in fill.fill_from_similar(df, ["v"], [("point_id",), ("chunk",)], [("chunk",)]).collect():
        out.setdefault(x.row_id, []).append((x.v, x.v_filled, x.v_from))
    assert out[100] == [(3.0, True, "same:point_id")] and out[101] == [(29.5, True, "group:chunk")]
    assert out[102] == [(19.5, True, "all")] * 2 and out[5] == [(2.0, False, "measured")] and sum(map(len, out.values())) == 84


def test_a_determinant_that_breaks_the_dependency_fills_nothing(spark):
    data = [(k, k // 2, float(k // 2)) for k in range(200)] + [(300, 500, 1.0), (301, 500, 9.0), (302, 500, None), (303, 7, None)]
    df = spark.createDataFrame(data, "row_id long, k long, v double")
    out = {x.row_id: (x.v, x.v_from) for x in fill.fill_from_similar(df, ["v"], [("k",)], []).collect()}
    assert out[303] == (7.0, "same:k") and out[302][1] == "all" and len(out) == 204


def test_hidden_cells_are_refilled(spark):
    """Measured values are hidden; a second delivery gives them back exactly, a group's median within the group's spread."""
    rng = np.random.default_rng(2)
    group = rng.integers(0, 8, 3000)
    value = group * 10 + rng.normal(0, 1, 3000)
    rows_ = [(k, k, int(group[k]), float(value[k])) for k in range(3000)] + [(10_000 + k, k, int(group[k]), float(value[k])) for k in range(0, 3000, 3)]
    hidden = {k: value[k] for k in range(0, 3000, 7)}
    df = spark.createDataFrame([(i, p, g, None if i in hidden else v) for i, p, g, v in rows_], "row_id long, point_id long, chunk int, v double")
    out = {x.row_id: x for x in fill.fill_from_similar(df, ["v"], [("point_id",), ("chunk",)], [("chunk",)]).collect()}
    gap = {k: abs(out[k].v - v) for k, v in hidden.items()}
    assert all(gap[k] == 0 for k in hidden if out[k].v_from == "same:point_id") and all(out[k].v_from == "same:point_id" for k in hidden if k % 3 == 0)
    assert np.mean([gap[k] for k in hidden if out[k].v_from == "group:chunk"]) < 1.0


def test_filling_without_any_value(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "row_id long, v double")
    assert [(x.v, x.v_filled, x.v_from) for x in fill.fill_from_similar(df, ["v"], [("row_id",)], []).collect()] == [(None, False, None)] * 2
    assert fill.fill_from_similar(df.limit(0), ["v"], [("row_id",)], []).count() == 0


def test_what_is_no_measurement(spark):
    nan = float("nan")
    data = [(k, 1, 10, 20, float(k % 7)) for k in range(30)] + [(50, 1, 10, 20, v) for v in (255.0, -9999.0, -1.0, nan, None)] + [(60, 1, 0, 0, 0.0), (61, 1, None, 10, 0.0)]
    data += [(100 + k, 2, 10, 20, 37.0) for k in range(25)] + [(200 + k, 3, 10, 20, 0.0) for k in range(25)]
    df = spark.createDataFrame(data, "row_id long, chunk_id long, esa_lc20 int, esa_lc21 int, gfc_tc00 double")
    df = df.withColumns({"potapov_tree_height": F.lit(3.0) + F.col("row_id") % 2, "dw_tree_prob_mean": F.lit(5.0) + F.col("row_id") % 2})
    found = measured.measured_products(df).where("gfc_tc00 is null").collect()
    assert sorted(r.row_id for r in found) == [50] * 5 + [60] + list(range(100, 125))


# --- proximity ------------------------------------------------------------------------------------------------------


def test_spellings(spark):
    texts = ["POINT (177.5 0.05)", "SRID=4326;POINT(-172.5 0.2)", "POINT Z (175.1 0.05 505.4)", "point( 171.09  0.127 )", "POINT (1.632e+02 8.5e-02)", "MULTIPOINT ((-171.6 0.09))", "POINT EMPTY", "", None, "x" * 100_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [(r.a, r.b) for r in df.select("k", proximity.geometry_lon(F.col("t")).alias("a"), proximity.geometry_lat(F.col("t")).alias("b")).orderBy("k").collect()]
    assert got[:6] == [(177.5, 0.05), (-172.5, 0.2), (175.1, 0.05), (171.09, 0.127), (163.2, 0.085), (-171.6, 0.09)] and set(got[6:]) == {(None, None)}


def brute(lon, lat, ids, metres):
    lon, lat = np.radians(lon), np.radians(lat)
    u = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)
    out = set()
    for i in range(len(u)):
        d = 2 * proximity.EARTH_RADIUS_M * np.arcsin(np.sqrt(((u - u[i]) ** 2).sum(1)) / 2)
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in np.nonzero(d <= metres)[0] if i != j}
    return out


@pytest.mark.parametrize("cell_rows, block", [(40, 1000), (1_000_000, 7)])
def test_pairs_against_brute_force(spark, cell_rows, block):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 6, 900)
    lon = np.where(centre == 0, 179.999 + rng.normal(0, 0.004, 900), 160 + centre + rng.normal(0, 0.01, 900)) % 360
    lat = rng.normal(0, 0.01, 900)
    lon[:40], lat[:40] = lon[0], lat[0]  # one spot
    ids = rng.permutation(900)
    df = spark.createDataFrame(pd.DataFrame({"point_id": ids, "lon": lon, "lat": lat, "cell": 1}))
    got = [tuple(r) for r in proximity.pairs_within(df, 250.0, cell_rows=cell_rows, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(lon, lat, ids, 250.0)


def test_places_of_repeated_and_odd_points(spark):
    nan = float("nan")
    data = [(1, None, 170.0, 0.1), (1, "POINT (171 0.2)", nan, nan), (2, None, -170.0, 0.1), (3, None, nan, nan), (None, "POINT (1 1)", 1.0, 1.0), (4, "broken", 5.0, 6.0)]
    p = spark.createDataFrame(data, "point_id long, geometry string, x double, y double")
    assert rows(proximity.point_locations(p)) == [(1, 171.0, 0.2), (2, 190.0, 0.1), (4, 5.0, 6.0)]
    assert proximity.pairs_within(proximity.point_locations(p.limit(0)), 250.0).count() == 0


@pytest.mark.parametrize("edges", [0, 1000])
def test_regions_with_holes_both_ways(spark, edges):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    v = [(7, 0, i, 175 + x, y, "EPSG:4326") for i, (x, y) in enumerate(square)] + [(7, 1, i, 175 + x, y, "EPSG:4326") for i, (x, y) in enumerate(hole)]
    aoi = spark.createDataFrame(v, "poly_id int, ring int, i int, x double, y double, crs string")
    p = spark.createDataFrame([(1, 176.0, 1.0), (2, 180.0, 5.0), (3, 183.0, 9.0), (4, 190.0, 5.0), (5, -177.0, 5.0)], "point_id long, lon double, lat double")
    assert rows(proximity.containing_region(p, aoi, broadcast_edges=edges)) == [(1, 7), (3, 7), (5, 7)]
    assert proximity.containing_region(p, aoi.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(-1, 1), st.floats(-1, 1)), min_size=1, max_size=120), st.floats(0.001, 1.5))
def test_local_pairs_property(points, chord):
    p = np.array(points)
    got = [tuple(sorted(x)) for a, b in proximity.local_pairs(p, chord, 8) for x in zip(a.tolist(), b.tolist())]
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    want = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if d[i, j] ** 2 <= chord * chord}
    assert len(got) == len(set(got))
    assert all(abs(d[i, j] - chord) < 1e-9 for i, j in set(got) ^ want)


def test_great_circle_limit(spark):
    step = math.degrees(250 / proximity.EARTH_RADIUS_M)
    p = spark.createDataFrame([(1, 170.0, 0.0), (2, 170.0, step * 0.99999), (3, 170.0, step * 2.0001)], "point_id long, lon double, lat double")
    assert rows(proximity.pairs_within(p, 250.0)) == [(1, 2)]
