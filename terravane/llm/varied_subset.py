"""Choosing a varied subset of locations by determinantal greedy selection.

The kernel of two places is exp(-(distance / 2 scale)^2). Greedy selection adds the place whose variance, given the
places chosen before it, is largest: it multiplies the kernel's determinant by just that gain. The Cholesky factor is
extended by one row per choice, so a choice costs one matrix-vector product. Space is cut into cells by k-d splits;
each cell gives its greedy sequence down to a least gain, its core-set, whose length depends on the extent that it
inhabits and not on how many places crowd there.

The final pass maximises the determinant over the composed core-sets to the required size. The kernel vanishes over a few
scales, so the greedy sequence of all core-sets is that of its parts merged by falling gain, if each part sees its
surroundings: it runs in cells some hundred times wider than the first ones with a halo of HALO scales, whose choices
count for the gains inside and are then left to their own cell. Gains are compared in steps of GAIN_STEP, equal ones go by a
hash of the id; so two cells that see the same surroundings choose the same places in them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.operators.proximity import EARTH_RADIUS_M, fit_splits, route, unit_vectors
from terravane.operators.relational import numbered, top_rows
from terravane.session import cut_lineage
from terravane.session import share as shared_value

CELL_ROWS = 5_000
FINAL_ROWS = 3_000
SAMPLE_ROWS = 40_000
LEAST_GAIN = 0.02
GAIN_STEP = 1e-3
#: In scales: beyond it the kernel is below 2e-7.
HALO = 8.0
AT = ["ux", "uy", "uz"]


def hashed(ids: np.ndarray) -> np.ndarray:
    """A fixed order of ids that has nothing to do with where they lie."""
    x = ids.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def greedy(xyz: np.ndarray, ids: np.ndarray, scale: float, most: int | None = None, least_gain: float = LEAST_GAIN) -> tuple[np.ndarray, np.ndarray]:
    """Indices in order of choice and their gains. Gains in one step of GAIN_STEP are equal, and the least hash of the id is
    chosen; places already covered gain nothing."""
    order = np.lexsort((ids, hashed(ids)))
    p = xyz[order]
    n = len(p)
    gain = np.ones(n)
    rows = np.empty((0, n))
    chosen, gains = [], []
    most = n if most is None else min(most, n)
    while len(chosen) < most:
        j = int(np.ceil(gain / GAIN_STEP).argmax())
        g = gain[j]
        if g < least_gain:
            break
        k = np.exp(-((p - p[j]) ** 2).sum(1) / (4 * scale * scale))
        if len(chosen) == len(rows):
            rows = np.concatenate([rows, np.empty((max(64, len(rows)), n))])
        c = rows[: len(chosen)]
        e = (k - c.T @ c[:, j]) / math.sqrt(g)
        rows[len(chosen)] = e
        gain = gain - e * e
        gain[j] = -1.0
        chosen.append(j), gains.append(g)
    return order[np.array(chosen, int)], np.array(gains)


def log_determinant(xyz: np.ndarray, scale: float) -> float:
    """Of the kernel of some places, a little noise added: larger for a more varied choice."""
    k = np.exp(-((xyz[:, None] - xyz[None]) ** 2).sum(2) / (4 * scale * scale))
    return float(np.linalg.slogdet(k + 1e-6 * np.eye(len(k)))[1])


def inhabited_scale(vectors: DataFrame, wanted: int) -> float:
    """The coarsest grid step at which at least ``wanted`` cells are inhabited, in units of the sphere's radius.

    Steps fall by a factor of two in a first pass and by its root in a second; a step's count is an approximate distinct
    count, and a pass gives one row."""

    def first_of(steps: list[float]) -> float | None:
        cell = lambda s: F.xxhash64(*[F.floor(F.col(c) / s) for c in AT])
        row = vectors.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(cell(s), 12)).alias(f"n{i}") for i, s in enumerate(steps)]).first()
        return next((s for i, s in enumerate(steps) if row[f"n{i}"] >= wanted), None)

    s = first_of([2.0**-k for k in range(0, 26)]) or 2.0**-25
    return first_of([s * math.sqrt(2)]) or s


def chosen_spots(spots: DataFrame, count: int, wanted: int, scale: float, sample: np.ndarray, cell_rows: int, final_rows: int) -> DataFrame:
    """``point_id, gain`` of the final sequences, at least as many as have a gain."""

    def pick(b: pd.DataFrame) -> pd.DataFrame:
        i, gains = greedy(b[AT].to_numpy(float), b["point_id"].to_numpy(), scale, None if "home" in b else wanted)
        b = b.iloc[i].assign(gain=gains)
        return (b[b["home"]] if "home" in b else b)[["point_id", *AT, "gain"]]

    def cells(points: DataFrame, number: int, halo: float) -> DataFrame:
        shared = shared_value(points.sparkSession, fit_splits(sample, number))  # at most twice as many entries as cells

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                row, cell, home = route(b[AT].to_numpy(float), shared(), halo)
                out = b.iloc[row].reset_index(drop=True)
                out["cell"], out["home"] = cell, home
                yield out if halo else out[home].drop(columns="home")

        # a cell is work beyond its bytes: a stated number of partitions isn't coalesced by size
        tasks = max(points.sparkSession.sparkContext.defaultParallelism, number)
        return points.select("point_id", *AT).mapInPandas(spread, f"point_id long, ux double, uy double, uz double, cell long{', home boolean' if halo else ''}").repartition(tasks, "cell")

    schema = "point_id long, ux double, uy double, uz double, gain double"
    core = cut_lineage(cells(spots, math.ceil(count / cell_rows), 0.0).groupBy("cell").applyInPandas(pick, schema))
    final = cells(core, math.ceil(core.count() / final_rows), HALO * scale).groupBy("cell").applyInPandas(pick, schema)
    return cut_lineage(final.select("point_id", "gain"))


def varied_subset(places: DataFrame, share: float = 0.01, least: int = 20, cell_rows: int = CELL_ROWS, final_rows: int = FINAL_ROWS) -> DataFrame:
    """``point_id, lon, lat, gain``: a share of the places (rounded down, at least ``least``, at most all).

    ``places`` has one row per point. Places at one spot count once. The kernel's scale is half the step of the coarsest
    grid of which as many cells are inhabited as places are wanted; should fewer spots have a gain there, it is narrowed
    until enough have. Only where there are fewer spots than places wanted do further places at the spots, by hash and with
    gain 0, make up the number. No task puts the chosen places in order."""
    vectors = cut_lineage(unit_vectors(places, "lon", "lat"))
    n = vectors.count()
    k = min(n, max(least, int(share * n + 1e-9)))
    if n == 0:
        return places.select("point_id", "lon", "lat", F.lit(0.0).alias("gain"))
    # of copies the smallest id stands for all, before anything is shuffled by cell
    spots = cut_lineage(vectors.groupBy(*AT).agg(F.min("point_id").alias("point_id")))
    count = spots.count()
    wanted = min(k, count)
    scale = inhabited_scale(spots, wanted) / 2
    sample = spots.orderBy(F.xxhash64("point_id"), "point_id").limit(SAMPLE_ROWS).select(*AT).toPandas().to_numpy(float)
    while True:
        ranked = chosen_spots(spots, count, wanted, scale, sample, cell_rows, final_rows)
        if ranked.count() >= wanted or scale < 1e-12:
            break
        scale /= math.sqrt(2)
    by_hash = [F.xxhash64("point_id"), F.col("point_id")]
    ranked = cut_lineage(top_rows(ranked, "gain", wanted, by_hash))
    if wanted < k:
        rest = numbered(vectors.select("point_id").join(ranked, "point_id", "left_anti"), by_hash, "_k").where(F.col("_k") < k - wanted)
        ranked = ranked.unionByName(rest.select("point_id", F.lit(0.0).alias("gain")))
    return vectors.select("point_id", "lon", "lat").join(ranked, "point_id")


def covering_distance_m(scale: float) -> float:
    """The grid step that belongs to a scale, in metres on the ground."""
    return 2 * scale * EARTH_RADIUS_M
