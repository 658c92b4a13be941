"""Small inputs on which queries that do less than their whole job give other rows."""

import os

import pytest

from terravane.operators import fill, ml
from terravane.plans import core_queries
from terravane.plans import reference_queries as q


def folder(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


POINTS = "point_id long, geometry string, x double, y double"
TRAINING = "sample_id long, lon double, lat double, geometry string, change_label int"


def labelled_folder(spark, path, points, training, steep=()):
    """Tables for the training queries; predictors that a table has are all 1, but the slope of the points ``steep``."""
    both = [c for c in q.PREDICTORS if c not in ("gfc_tc00", "elevation", "slope")]
    features = [(p[0], p[0], 1, "a", p[0], *[1] * (len(both))) for p in points]
    products = [(p[0], p[0], 1, "a", p[0], 1, 1, 1000 if p[0] in steep else 1) for p in points]
    return folder(
        spark,
        path,
        points=(points, POINTS),
        training=(training, TRAINING),
        features=([(*f[:5], *map(float, f[5:])) for f in features], "row_id long, point_id long, chunk_id long, pathrow string, processed_at long, " + ", ".join(f"{c} double" for c in both)),
        products=([(*f[:5], *map(float, f[5:])) for f in products], "row_id long, point_id long, chunk_id long, pathrow string, sampled_at long, gfc_tc00 double, elevation double, slope double"),
    )


def labels(spark, d):
    return sorted((r.point_id, r.label) for r in q._labelled(spark, d).where("label is not null").collect())


def test_points_with_only_a_geometry_are_ordered_and_simulated(spark, tmp_path):
    points = [(1, None, 170.0, 0.0), (2, "POINT (-171.5 0.5)", None, None), (3, "SRID=4326;POINT(171.5 0.7)", float("nan"), 0.7)]
    products = [(k, k % 2) for k in (1, 2, 3)]
    d = folder(spark, tmp_path, points=(points, POINTS), products=(products, "point_id long, gfc_lossyear int"))
    assert sorted((r.point_id, r.x) for r in q.hilbert_order(spark, d).collect()) == [(1, 170.0), (2, 188.5), (3, 171.5)]
    assert {r.sample_size for r in q.simulated_error(spark, d).collect()} == {3.0}


def test_samples_with_only_a_geometry_label_points_with_only_a_geometry(spark, tmp_path):
    points = [(1, "POINT (-171.5 0.5)", None, None), (2, None, 172.0, 0.5)]
    training = [(10, None, None, "POINT(188.5001 0.5)", 1), (11, 172.0001, 0.5, None, 0)]
    assert labels(spark, labelled_folder(spark, tmp_path, points, training)) == [(1, 1), (2, 0)]


def test_every_point_near_a_sample_takes_the_label_of_its_nearest(spark, tmp_path):
    points = [(1, None, 170.0, 0.5), (2, None, 170.0004, 0.5), (3, None, 170.0012, 0.5), (4, None, 171.0, 0.5)]
    training = [(10, 170.0, 0.5, None, 1), (11, 170.0005, 0.5, None, 0), (12, 171.0002, 0.5, None, 1), (13, 170.9998, 0.5, None, 0)]
    assert labels(spark, labelled_folder(spark, tmp_path, points, training)) == [(1, 1), (2, 0), (3, 0), (4, 0), (4, 1)]


def test_isolation_sees_all_predictors(spark, tmp_path):
    points = [(k, None, 170.0 + k, 0.5) for k in range(20)]
    d = labelled_folder(spark, tmp_path, points, [(10, 170.0, 0.5, None, 1)], steep=(7,))
    assert {r.point_id for r in q.isolation_reject(spark, d).collect()} == set(range(20)) - {7}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_importance_is_of_the_reference_size(spark, monkeypatch):
    real, forests, shuffles = ml.change_probability, [], []
    monkeypatch.setattr(ml, "change_probability", lambda df, columns, target, **o: forests.append((columns, o["trees"], o["outlier_share"])) or real(df, columns, target, **o))
    shuffled = ml.permutation_importance
    monkeypatch.setattr(ml, "permutation_importance", lambda m, df, columns, target, repeats: shuffles.append(repeats) or shuffled(m, df, columns, target, repeats))
    assert {r.feature for r in q.permutation_importance(spark, "/root/testdata/sf0.01").collect()} == set(q.PREDICTORS)
    assert forests == [(q.PREDICTORS, 1500, 0.1)] and shuffles == [25]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_found_cells_go_through_mining(spark, monkeypatch):
    real, tried = fill.mine_dependencies, []
    monkeypatch.setattr(fill, "mine_dependencies", lambda known, fields, candidates, *a: tried.append(set(candidates)) or real(known, fields, candidates, *a))
    d = "/root/testdata/sf0.001"
    found = {(r.row_id, r.field_name) for r in core_queries.p1_found(spark, d).collect()}
    assert found and len(tried) == 2 and {("esa_lc21",), ("pathrow", "tmf_main")} <= tried[0] and {("chunk_id",), ("pathrow",)} <= tried[1]
