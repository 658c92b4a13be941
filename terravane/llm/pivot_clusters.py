"""Grouping records into clusters of similar records by parallel pivot correlation clustering.

Two records are similar if their standardised fields lie within ``radius``. Records are ordered by a hash of their id.
In a round the first records of that order that are still free come to the driver (BLOCK of them, a fixed number);
those that have no earlier similar one among them are the local minima, the round's pivots, and every free record that
is similar to one of them is absorbed. This is the pivot clustering of the hash order, exactly. Pivots are pairwise
dissimilar, so their number is bounded by how many balls of the radius the fields' range holds, not by the records.

Then members go to the closest pivot, each cluster's medoid becomes its pivot, pivots that have become similar merge,
and this repeats until no medoid changes. What a pivot then stands for is told by where its members lie, whatever their
number: a group has a core, stray records have none. A pivot is stray if fewer than CORE members lie within half the
radius or if these are so few against those of the outer half as evenly spread records would be; its members go to the
closest group and are marked by their distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.session import cut_lineage

RADIUS = 1.0
BLOCK = 512
#: Records spread evenly in four dimensions are 1 in the inner half of the radius to 15 in the outer; from 1 to CONTRAST on
#: they are a group, and from CORE in the inner half on.
CORE, CONTRAST = 5, 4
#: The means of all members move the pivots less from round to round; more rounds than this are an error.
ROUNDS = 200
#: Pivots are sent to all tasks; more than this many mean that the radius is too small for the fields' range, an error.
MOST_PIVOTS = 50_000


def standardised(records: DataFrame, item: str, fields: list[str]) -> DataFrame:
    """``item, z0, z1, ...``: fields less their mean in units of their deviation, for records that have them all.

    Records with a null, NaN or infinite field, or without an id, take no part. A constant field counts 0."""
    ok = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(f) != float("inf")) for f in fields])
    r = records.where(F.col(item).isNotNull() & ok).select(F.col(item).alias("item"), *[F.col(f).cast("double").alias(f"z{i}") for i, f in enumerate(fields)])
    stats = r.agg(*[F.avg(f"z{i}").alias(f"m{i}") for i in range(len(fields))], *[F.stddev_pop(f"z{i}").alias(f"d{i}") for i in range(len(fields))]).first()
    z = [F.when(F.lit(bool(stats[f"d{i}"])), (F.col(f"z{i}") - F.lit(stats[f"m{i}"])) / F.lit(stats[f"d{i}"] or 1.0)).otherwise(F.lit(0.0)).alias(f"z{i}") for i in range(len(fields))]
    return r.select("item", F.xxhash64("item").alias("h"), *z)


def _nearest(z: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest pivot of each row."""
    best, at = np.full(len(z), np.inf), np.zeros(len(z), int)
    for k, p in enumerate(pivots):
        d = ((z - p) ** 2).sum(1)
        closer = d < best
        best[closer], at[closer] = d[closer], k
    return at, best


def hash_pivots(points: DataFrame, width: int, radius: float, block: int = BLOCK) -> np.ndarray:
    """The pivots, in order of their hashes."""
    z_ = [f"z{i}" for i in range(width)]
    pivots = np.empty((0, width))
    free = points
    while True:
        head = free.orderBy("h", "item").limit(block).select(*z_).toPandas().to_numpy(float)
        if not len(head):
            return pivots
        new: list[np.ndarray] = []
        for p in head:
            if all(((p - q) ** 2).sum() > radius**2 for q in new):
                new.append(p)
        added = np.array(new)
        pivots = np.concatenate([pivots, added])
        if len(pivots) > MOST_PIVOTS:
            raise ValueError(f"more than {MOST_PIVOTS} pivots: the radius is too small for the fields' range")

        def still_free(batches: Iterator[pd.DataFrame], added: np.ndarray = added) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[_nearest(b[z_].to_numpy(float), added)[1] > radius**2]

        free = cut_lineage(free.mapInPandas(still_free, free.schema))


def assigned(points: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """points with ``cluster`` (index of the closest pivot) and ``d2``."""
    z_ = [f"z{i}" for i in range(width)]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, d2 = _nearest(b[z_].to_numpy(float), pivots)
            yield b[["item", *z_]].assign(cluster=at.astype(np.int32), d2=d2)

    kinds = dict(points.dtypes)
    return points.mapInPandas(assign, f"item {kinds['item']}, {', '.join(f'{z} double' for z in z_)}, cluster int, d2 double")


def merged(stats: pd.DataFrame, z_: list[str], radius: float) -> np.ndarray:
    """The means of the clusters, largest first, without those similar to a larger one's."""
    kept: list[np.ndarray] = []
    for mean in stats.sort_values(["n", "cluster"], ascending=[False, True])[z_].to_numpy(float):
        if all(((mean - q) ** 2).sum() > radius**2 for q in kept):
            kept.append(mean)
    return np.array(kept)


def clusters(points: DataFrame, width: int, radius: float = RADIUS, core: int = CORE, contrast: float = CONTRAST) -> DataFrame:
    """``item, z0.., cluster, d2``: each point of ``standardised`` with its cluster and squared distance to the medoid.

    Every point gets a cluster; where d2 is beyond the squared radius the point is stray. Without any group the largest
    pivot is the one. Points that come twice count twice. No points give no rows."""
    z_ = [f"z{i}" for i in range(width)]
    points = cut_lineage(points)
    pivots = hash_pivots(points, width, radius)
    if not len(pivots):
        return assigned(points, pivots, width)
    for _ in range(ROUNDS):
        a = assigned(points, pivots, width)
        stats = a.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(z).alias(z) for z in z_]).toPandas()
        # the member closest to the mean has the least sum of squared distances to all members: the medoid
        near = assigned(points, merged(stats, z_, radius), width)
        inner, outer = F.count_if(F.col("d2") <= radius**2 / 4), F.count_if(F.col("d2").between(radius**2 / 4, radius**2))
        medoids = near.groupBy("cluster").agg(F.min_by(F.struct(*z_), F.struct("d2", "item")).alias("z"), F.count("*").alias("n"), inner.alias("inner"), outer.alias("outer")).orderBy("cluster").collect()
        new = np.array([[r["z"][z] for z in z_] for r in medoids])
        if new.shape == pivots.shape and np.allclose(new, pivots):
            group = np.array([r["inner"] >= core and r["inner"] * contrast >= r["outer"] for r in medoids])
            if not group.any():
                group[int(np.argmax([r["n"] for r in medoids]))] = True
            if group.all():
                return assigned(points, new, width)
            new = new[group]
        pivots = new
    raise RuntimeError("the medoids did not settle")


def numbered(members: DataFrame, tie: str) -> DataFrame:
    """members with ``cluster_no``: 1 for the largest cluster; of equally large ones the higher mean of ``tie`` first.

    The clusters' sizes, one row each, are few (see above) and are sorted on the driver."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(tie).alias("t")).toPandas()
    order = sizes.sort_values(["n", "t", "cluster"], ascending=[False, False, True])["cluster"].tolist()
    if not order:
        return members.withColumn("cluster_no", F.lit(None).cast("int"))
    return members.withColumn("cluster_no", F.element_at(F.create_map(*[x for k, c in enumerate(order) for x in (F.lit(int(c)), F.lit(k + 1))]), F.col("cluster")))


def typical(members: DataFrame, count: int = 5) -> DataFrame:
    """``cluster_no, size, item, place``: the ``count`` members of each cluster closest to its medoid.

    Each task first keeps its own closest ones, so that no task ever holds a cluster."""
    kind = dict(members.dtypes)["item"]

    def closest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, sizes = None, {}
        for b in batches:
            for c, n in b["cluster_no"].value_counts().items():
                sizes[c] = sizes.get(c, 0) + int(n)
            both = b if best is None else pd.concat([best, b])
            best = both.sort_values(["cluster_no", "d2", "item"]).groupby("cluster_no").head(count)
        if best is not None:
            first = ~best["cluster_no"].duplicated()
            yield best.assign(n=np.where(first, best["cluster_no"].map(sizes), 0))

    few = members.select("cluster_no", "item", "d2").mapInPandas(closest, f"cluster_no int, item {kind}, d2 double, n long")
    from pyspark.sql.window import Window

    w = Window.partitionBy("cluster_no")
    few = few.select("*", F.sum("n").over(w).alias("size"), F.row_number().over(w.orderBy("d2", "item")).alias("place"))
    return few.where(F.col("place") <= count).select("cluster_no", "size", "item", "place")
