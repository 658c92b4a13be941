"""Rank walk, clusters and varied subset against brute force and on edge cases."""

import itertools

import numpy as np
import pandas as pd
import pytest

from terravane.llm import pivot_clusters, rank_walk, varied_subset
from terravane.operators import proximity


def dense_walk(v, damping, levels):
    """The same chain by its full transition matrix, for values that are their own levels."""
    n = len(v)
    m = (~np.isnan(v)).sum(1)
    p = np.zeros((n, n))
    for i in range(n):
        for s in range(v.shape[1]):
            if not np.isnan(v[i, s]):
                up = v[:, s] >= v[i, s]
                p[i, up] += 1 / m[i] / up.sum()
    pi = np.full(n, 1 / n)
    for _ in range(500):
        arrive = pi @ p
        pi = damping * arrive
        pi += (1 - pi.sum()) / n
    return np.where(m > 0, arrive * n / np.maximum(m, 1), 0)


def test_walk_against_the_matrix(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 4, (60, 3)).astype(float)
    v[rng.random(v.shape) < 0.2] = np.nan
    v[0] = np.nan
    df = spark.createDataFrame([(k, *(None if x != x else float(x) for x in r), 1.0) for k, r in enumerate(v)], "id long, a double, b double, c double, strength double")
    out = rank_walk.strengths(df, ["a", "b", "c"], levels=60, damping=0.5).orderBy("id").toPandas()
    assert np.allclose(out["strength"], dense_walk(v, 0.5, 60), atol=1e-5)
    assert out["n_scores"].tolist() == (~np.isnan(v)).sum(1).tolist()


def test_all_round_items_stand_before_extreme_ones(spark):
    rng = np.random.default_rng(1)
    v = rng.lognormal(0, 1, (2000, 4)) * [1, 100, 0.01, 5]
    v[:40] = np.quantile(v, 0.985, axis=0)
    v[100:104, 0] = 1e9
    df = spark.createDataFrame(pd.DataFrame(v, columns=list("abcd")).assign(id=range(2000)))
    top = rank_walk.strongest(rank_walk.strengths(df, list("abcd")), 0.02, "id")
    assert {r.id for r in top.collect()} == set(range(40))


def test_walk_edges(spark):
    schema = "id long, a double, b double, _h int"
    empty = spark.createDataFrame([], schema)
    assert rank_walk.strongest(rank_walk.strengths(empty, ["a", "b"]), 0.02, "id").count() == 0
    nan = float("nan")
    odd = rank_walk.strengths(spark.createDataFrame([(1, None, nan, 1), (1, None, nan, 1), (2, 5.0, None, 1)], schema), ["a", "b"])
    assert [r.n_scores for r in odd.orderBy("id").collect()] == [0, 0, 1] and rank_walk.strongest(odd, 0.02, "id").first().id == 2


def blobs(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [9, 0, 90], [0, 4, 50], [9, 4, 10]], float)
    which = rng.choice(4, n, p=[0.5, 0.25, 0.15, 0.1])
    return which, centres[which] + rng.normal(0, 1, (n, 3)) * [0.5, 0.2, 5]


def test_natural_groups(spark):
    which, x = blobs(800)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(800), cluster="x"))
    points = pivot_clusters.standardised(df, "id", ["a", "b", "c"])
    out = pivot_clusters.numbered(pivot_clusters.clusters(points, 3), "z0").toPandas().sort_values("item")
    order = np.argsort(-np.bincount(which))
    assert (out["cluster_no"].to_numpy() - 1 == np.argsort(order)[which]).all()
    t = pivot_clusters.typical(pivot_clusters.numbered(pivot_clusters.clusters(points, 3), "z0"), 3).toPandas()
    assert len(t) == 12 and t.groupby("cluster_no")["size"].first().tolist() == sorted(np.bincount(which), reverse=True)
    best = out.sort_values(["d2", "item"]).groupby("cluster_no").head(3)
    assert set(best["item"]) == set(t["item"])


def test_a_small_group_stays_and_strays_are_no_group(spark):
    """A dense group of one in 2,500 keeps its number; far single records go to a group and are marked by distance."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.05, (15_000, 2)), rng.normal(6, 0.05, (10_000, 2)), rng.normal([3, -3], 0.05, (10, 2)), [[-4, 4], [9, -2], [-3, -4]]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(len(x))))
    out = pivot_clusters.numbered(pivot_clusters.clusters(pivot_clusters.standardised(df, "id", ["a", "b"]), 2, radius=0.4), "z0").toPandas()
    sizes = out[out["d2"] <= 0.16]["cluster_no"].value_counts().to_dict()
    assert sizes == {1: 15_000, 2: 10_000, 3: 10}
    assert set(out[out["d2"] > 0.16]["item"]) == {25_010, 25_011, 25_012}


def test_equal_strengths_are_ordered_by_finer_ranks(spark):
    df = spark.createDataFrame(pd.DataFrame({"id": range(10_000), "a": np.arange(10_000.0), "b": np.arange(10_000.0) * 7}))
    out = rank_walk.strengths(df, ["a", "b"])
    top = out.orderBy("fine_level", ascending=False).limit(500).toPandas()["id"]
    assert out.select("strength").distinct().count() == 50 and top.min() >= 9_400
    assert len({r.id for r in rank_walk.strongest(out, 0.01, "id").collect()} - set(range(9_890, 10_000))) == 0


@pytest.mark.parametrize("block", [3, 512])
def test_pivots_are_the_sequential_ones(spark, block):
    _, x = blobs(300, 3)
    points = pivot_clusters.standardised(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(300))), "id", ["a", "b", "c"])
    p = points.orderBy("h", "item").toPandas()[["z0", "z1", "z2"]].to_numpy()
    want: list = []
    for q in p:
        if all(((q - w) ** 2).sum() > 1 for w in want):
            want.append(q)
    assert np.allclose(pivot_clusters.hash_pivots(points, 3, 1.0, block), np.array(want))


def test_cluster_edges(spark):
    schema = "id long, a double, b double"
    nan = float("nan")
    odd = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, None, 1.0), (3, nan, 1.0), (None, 1.0, 1.0), (4, 1.0, 1.0)], schema)
    for df, n in ((odd, 3), (odd.limit(0), 0)):
        out = pivot_clusters.numbered(pivot_clusters.clusters(pivot_clusters.standardised(df, "id", ["a", "b"]), 2), "z0")
        assert [r.cluster_no for r in out.collect()] == [1] * n
        assert pivot_clusters.typical(out).count() == n


def test_greedy_takes_the_largest_gain():
    rng = np.random.default_rng(0)
    p = rng.normal(0, 1, (9, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    chosen, gains = varied_subset.greedy(p, np.arange(9), 0.4, 4)
    k = np.exp(-((p[:, None] - p[None]) ** 2).sum(2) / (4 * 0.16))
    for n in range(1, 5):
        got = np.linalg.det(k[np.ix_(chosen[:n], chosen[:n])])
        best = max(np.linalg.det(k[np.ix_([*chosen[: n - 1], j], [*chosen[: n - 1], j])]) for j in range(9) if j not in chosen[: n - 1])
        assert got > best * (1 - 2 * varied_subset.GAIN_STEP / gains[n - 1]) and abs(got - np.prod(gains[:n])) < 1e-9
    whole = max(np.linalg.det(k[np.ix_(c, c)]) for c in itertools.combinations(range(9), 4))
    assert np.prod(gains) > 0.5 * whole


def test_subset_covers_and_does_not_crowd(spark):
    rng = np.random.default_rng(0)
    crowd = np.c_[170 + rng.normal(0, 0.001, 3000), rng.normal(0, 0.001, 3000)]
    spread = np.c_[rng.uniform(160, 200, 1000), rng.uniform(-1, 1, 1000)]
    xy = np.concatenate([crowd, spread])
    df = spark.createDataFrame(pd.DataFrame({"point_id": range(4000), "lon": xy[:, 0], "lat": xy[:, 1], "gain": "x", "cell": 1}))
    got = varied_subset.varied_subset(df, cell_rows=700, final_rows=60).toPandas()
    assert len(got) == 40 and got["point_id"].is_unique
    assert (got["point_id"] < 3000).sum() <= 3
    assert np.histogram(got["lon"], np.linspace(160, 200, 9))[0].min() >= 2


def test_small_cells_reach_the_global_determinant(spark):
    """Core-sets and a final pass in many small cells with halos, against one greedy sequence over all places."""
    rng = np.random.default_rng(5)
    xy = np.concatenate([np.c_[rng.normal(175, 0.2, 2500), rng.normal(0, 0.2, 2500)], np.c_[rng.uniform(170, 180, 1500), rng.uniform(-5, 5, 1500)]])
    df = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(4000), "lon": xy[:, 0], "lat": xy[:, 1]}))
    v = proximity.unit_vectors(df).orderBy("point_id").toPandas()[["ux", "uy", "uz"]].to_numpy()
    got = varied_subset.varied_subset(df, share=0.05, cell_rows=400, final_rows=150).toPandas()
    scale = varied_subset.inhabited_scale(proximity.unit_vectors(df), 200) / 2
    whole, _ = varied_subset.greedy(v, np.arange(4000), scale, 200, 0.0)
    mine, best = (varied_subset.log_determinant(v[np.array(i)], scale) for i in (got["point_id"], whole))
    assert len(got) == 200 and mine > best - 0.03 * 200  # within 3 % of the global choice per place


def test_subset_edges(spark):
    schema = "point_id long, lon double, lat double"
    assert varied_subset.varied_subset(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(k, 170.0, 0.0) for k in range(50)], schema)
    got = varied_subset.varied_subset(same).collect()
    assert len({r.point_id for r in got}) == 20 and sum(r.gain > 0.5 for r in got) == 1
    assert varied_subset.varied_subset(same.limit(3)).count() == 3
