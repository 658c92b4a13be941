"""Points near other points, and the region around each point.

Pairs: locations become unit vectors; a k-d tree of splits, fitted on a bounded sample of the locations, cuts space
into cells; a location near a split is copied to both sides (the halo), so each cell answers its own queries with a
local k-d tree and chord lengths. Regions: a plane sweep over the polygons' edges along the longitude.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.session import cut_lineage, share

EARTH_RADIUS_M = 6_371_008.8
#: Spots in one cell, about; spots fetched to place the splits, at most.
CELL_ROWS = 10_000
SAMPLE_ROWS = 40_000
LEAF_ROWS = 48
CELLS_A_TASK = 8
#: Polygon edges that are sent to all tasks, at most; beyond that edges are joined on slabs of longitude.
BROADCAST_EDGES = 500_000
#: Beyond that, edges in a slab and points in one of its groups, about.
SLAB_EDGES, SLAB_POINTS = 20_000, 500_000
#: Points of a crowded spot that one task puts together with others.
SPOT_BLOCK = 1_000

_NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
_POINT = r"(?i)point[^-+0-9.]*" + _NUMBER + r"\s+" + _NUMBER


def geometry_lon(text: Column) -> Column:
    """Longitude in the text of a point (POINT, POINT Z, MULTIPOINT of one, with or without SRID); null if there is none."""
    return F.nullif(F.regexp_extract(text, _POINT, 1), F.lit("")).try_cast("double")


def geometry_lat(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, _POINT, 2), F.lit("")).try_cast("double")


def real(c: Column) -> Column:
    """c, with NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def point_locations(points: DataFrame) -> DataFrame:
    """``point_id, lon, lat``, one row for each point that has a place.

    A point lies at its geometry; if all its geometries are null or can't be read, at x, y. Longitudes are brought to
    [0, 360). Of several spellings the smallest (lon, lat) counts. Points without an id or without a place are left out.
    """
    g = F.struct(F.pmod(geometry_lon(F.col("geometry")), F.lit(360.0)).alias("lon"), geometry_lat(F.col("geometry")).alias("lat"))
    xy = F.struct(F.pmod(real(F.col("x")), F.lit(360.0)).alias("lon"), real(F.col("y")).alias("lat"))
    whole = lambda s: F.when(s["lon"].isNotNull() & s["lat"].isNotNull(), s)
    p = points.where(F.col("point_id").isNotNull()).groupBy("point_id").agg(F.min(whole(g)).alias("g"), F.min(whole(xy)).alias("xy"))
    p = p.select("point_id", F.coalesce("g", "xy").alias("at")).where("at is not null")
    return p.select("point_id", F.col("at.lon").alias("lon"), F.col("at.lat").alias("lat"))


def unit_vectors(places: DataFrame, *keep: str) -> DataFrame:
    """``point_id``, the columns to keep, and ``ux, uy, uz``."""
    lon, lat = F.radians("lon"), F.radians("lat")
    return places.select("point_id", *keep, (F.cos(lat) * F.cos(lon)).alias("ux"), (F.cos(lat) * F.sin(lon)).alias("uy"), F.sin(lat).alias("uz"))


def fit_splits(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """The k-d tree as an implicit heap of (axis, value); axis -1 is a leaf. Depth: enough for ``cells`` leaves."""
    depth = max(0, math.ceil(math.log2(max(1, cells))))
    nodes: list[tuple[int, float]] = [(-1, 0.0)] * (2 ** (depth + 1))

    def grow(k: int, rows: np.ndarray, left: int) -> None:
        if left == 0 or len(rows) < 2:
            return
        spread = rows.max(0) - rows.min(0)
        axis = int(spread.argmax())
        if spread[axis] <= 0:
            return
        cut = float(np.median(rows[:, axis]))
        below = rows[:, axis] <= cut
        if below.all():
            cut = float(rows[rows[:, axis] < cut, axis].max())
            below = rows[:, axis] <= cut
        nodes[k] = (axis, cut)
        grow(2 * k, rows[below], left - 1)
        grow(2 * k + 1, rows[~below], left - 1)

    grow(1, sample, depth)
    return nodes


def route(xyz: np.ndarray, nodes: list[tuple[int, float]], halo: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) for each row's own cell and for every other cell that it may be within ``halo`` of."""
    rows, cells, homes = [], [], []
    stack = [(1, np.arange(len(xyz)), np.ones(len(xyz), bool))]
    while stack:
        k, idx, home = stack.pop()
        if not len(idx):
            continue
        axis, cut = nodes[k]
        if axis < 0:
            rows.append(idx), cells.append(np.full(len(idx), k)), homes.append(home)
            continue
        v = xyz[idx, axis]
        for child, own, near in ((2 * k, v <= cut, v <= cut + halo), (2 * k + 1, v > cut, v > cut - halo)):
            stack.append((child, idx[near], (home & own)[near]))
    if not rows:
        return np.empty(0, int), np.empty(0, int), np.empty(0, bool)
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


def local_pairs(xyz: np.ndarray, chord: float, leaf_rows: int = LEAF_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i != j, of rows within ``chord``, each once, by a k-d tree over the rows."""
    n = len(xyz)
    order = np.arange(n)
    leaves, stack = [], [(0, n)]
    while stack:
        a, b = stack.pop()
        if b - a <= leaf_rows:
            leaves.append((a, b))
            continue
        part = xyz[order[a:b]]
        axis = int((part.max(0) - part.min(0)).argmax())
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
        stack += [(a, a + mid), (a + mid, b)]
    lo = np.array([xyz[order[a:b]].min(0) for a, b in leaves])
    hi = np.array([xyz[order[a:b]].max(0) for a, b in leaves])
    for k, (a, b) in enumerate(leaves):
        gap = np.maximum(0, np.maximum(lo[k:] - hi[k], lo[k] - hi[k:]))
        near = np.nonzero((gap * gap).sum(1) <= chord * chord * 1.000001)[0] + k
        mine = order[a:b]
        others = np.concatenate([order[leaves[j][0] : leaves[j][1]] for j in near])
        d2 = ((xyz[mine][:, None, :] - xyz[others][None, :, :]) ** 2).sum(2)
        i, j = np.nonzero(d2 <= chord * chord)
        own = j >= len(mine)  # within the leaf itself each pair would come twice
        keep = own | (i < j)
        yield mine[i[keep]], others[j[keep]]


def pairs_within(places: DataFrame, metres: float, radius_m: float = EARTH_RADIUS_M, cell_rows: int = CELL_ROWS, block: int = SPOT_BLOCK) -> DataFrame:
    """``point_id_a, point_id_b``: pairs of different points at most ``metres`` apart on the sphere, smaller id first.

    ``places`` has one row per point (``point_id, lon, lat``) and is read once. Points at one place are one spot here;
    pairs of spots come once, from the cell in which the spot of smaller id is at home. The pairs of points that stand for
    a pair of spots, or for one spot, are put together from blocks of at most about ``block`` points, so that no task
    meets all points of a crowded spot. The splits rest on at most SAMPLE_ROWS spots of least hash; the cells themselves
    hold every spot.
    """
    spark = places.sparkSession
    at = ["ux", "uy", "uz"]
    vectors = cut_lineage(unit_vectors(places))
    spots = cut_lineage(vectors.groupBy(*at).agg(F.min("point_id").alias("spot"), F.count("*").alias("m")))
    chord = 2 * math.sin(min(math.pi, metres / radius_m) / 2) * (1 + 1e-12)
    size = spots.agg(F.count("*"), F.max("m")).first()
    cells = math.ceil(size[0] / cell_rows)
    nodes = [(-1, 0.0), (-1, 0.0)]
    if cells > 1:
        picked = spots.orderBy(F.xxhash64("spot"), "spot").limit(SAMPLE_ROWS).select(*at).toPandas()
        nodes = fit_splits(picked.to_numpy(float), cells)
    shared = share(spark, nodes)  # at most twice as many entries as cells

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, cell, home = route(b[at].to_numpy(float), shared(), chord * 1.000001)
            out = b.iloc[row].reset_index(drop=True)
            out["cell"], out["home"] = cell, home
            yield out

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(batches))
        ids, home, m = b["spot"].to_numpy(), b["home"].to_numpy(), b["m"].to_numpy()
        for i, j in local_pairs(b[at].to_numpy(float), chord):
            turn = ids[i] > ids[j]
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            keep = home[i]
            i, j = i[keep], j[keep]
            yield pd.DataFrame({"a": ids[i], "b": ids[j], "ma": m[i], "mb": m[j]})

    met = spots.mapInPandas(spread, "ux double, uy double, uz double, spot long, m long, cell long, home boolean")
    # cells are work beyond their bytes: a stated number of partitions isn't coalesced by size
    met = met.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(cells / CELLS_A_TASK)), "cell")
    pairs = met.groupBy("cell").applyInPandas(meet, "a long, b long, ma long, mb long")
    single = lambda p: p.select(F.col("a").alias("point_id_a"), F.col("b").alias("point_id_b"))
    if (size[1] or 0) <= 1:
        return single(pairs)
    pairs = cut_lineage(pairs)
    crowded = spots.where("m > 1")
    # members of crowded spots by block; a spot alone is a block of its own
    members = vectors.join(crowded, at).select("spot", F.pmod(F.xxhash64("point_id"), F.ceil(F.col("m") / block)).alias("k"), "point_id")
    members = members.unionByName(spots.where("m = 1").select("spot", F.lit(0).cast("long").alias("k"), F.col("spot").alias("point_id")))
    blocks = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(m) / block) - 1))
    several = pairs.where("ma > 1 or mb > 1").unionByName(crowded.select(F.col("spot").alias("a"), F.col("spot").alias("b"), F.col("m").alias("ma"), F.col("m").alias("mb")))
    several = several.withColumn("ka", blocks("ma")).withColumn("kb", blocks("mb")).where("a <> b or ka <= kb")
    first, second = (members.select(F.col("spot").alias(x), F.col("k").alias(f"k{x}"), F.col("point_id").alias(f"p{x}")) for x in "ab")
    grown = several.join(first, ["a", "ka"]).join(second, ["b", "kb"]).where("pa <> pb and (a <> b or ka < kb or pa < pb)")
    grown = grown.select(F.least("pa", "pb").alias("point_id_a"), F.greatest("pa", "pb").alias("point_id_b"))
    return single(pairs.where("ma = 1 and mb = 1")).unionByName(grown)


def polygon_edges(aoi: DataFrame) -> DataFrame:
    """``poly_id, x1, y1, x2, y2``: the edges of all rings (shell and holes alike), without the vertical ones."""
    v = aoi.select("poly_id", "ring", "i", "x", "y")
    nxt = v.select("poly_id", "ring", (F.col("i") - 1).alias("i"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    e = v.join(nxt, ["poly_id", "ring", "i"]).select("poly_id", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    return e.where("x1 <> x2")


@dataclass
class Columns:
    """The edges of polygons by columns of x: what a sweep along x has open in each column."""

    west: float
    width: float
    first: np.ndarray  # first entry of each column in ``edge``, and the end
    edge: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    slope: np.ndarray
    poly: np.ndarray  # number of the edge's polygon in ``ids``
    ids: np.ndarray


def edge_columns(edges: pd.DataFrame) -> Columns:
    """About as many columns as a quarter of the edges, so that few edges are open in one."""
    x1, y1, x2, y2 = (edges[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2"))
    lo, hi = np.minimum(x1, x2), np.maximum(x1, x2)
    ids, poly = np.unique(edges["poly_id"].to_numpy(), return_inverse=True)
    west, count = (lo.min(), max(1, len(edges) // 4)) if len(edges) else (0.0, 1)
    width = max((hi.max() - west) / count if len(edges) else 1.0, 1e-12)
    a, b = ((np.clip((v - west) // width, 0, count - 1)).astype(int) for v in (lo, hi))
    span = b - a + 1
    edge = np.repeat(np.arange(len(edges)), span)
    column = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(a, span)
    order = np.argsort(column, kind="stable")
    return Columns(west, width, np.searchsorted(column[order], np.arange(count + 1)), edge[order], lo, hi, x1, y1, (y2 - y1) / (x2 - x1), poly, ids)


def sweep(x: np.ndarray, y: np.ndarray, c: Columns, most: int = 2_000_000) -> np.ndarray:
    """For each point the smallest polygon that contains it, -1 for none: the points of a column meet the edges that are
    open there, each half-open in x, and a point is inside where it lies below an odd number of a polygon's edges. About
    ``most`` pairs are held at once."""
    found = np.full(len(x), -1, np.int64)
    column = np.floor((x - c.west) / c.width)
    ok = np.nonzero((column >= 0) & (column < len(c.first)))[0]
    if not len(ok) or not len(c.edge):
        return found
    column = np.minimum(column[ok].astype(int), len(c.first) - 2)
    count = c.first[column + 1] - c.first[column]
    part = np.cumsum(count) // most
    for k in np.unique(part):
        at, n, col = ok[part == k], count[part == k], column[part == k]
        row = np.repeat(np.arange(len(at)), n)
        e = c.edge[np.repeat(c.first[col], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        px, py = x[at][row], y[at][row]
        under = (px >= c.lo[e]) & (px < c.hi[e]) & (py < c.y1[e] + c.slope[e] * (px - c.x1[e]))
        key, times = np.unique(row[under] * len(c.ids) + c.poly[e[under]], return_counts=True)
        key = key[times % 2 == 1][::-1]  # the smallest polygon is written last
        found[at[key // len(c.ids)]] = c.ids[key % len(c.ids)]
    return found


def containing_region(places: DataFrame, aoi: DataFrame, broadcast_edges: int = BROADCAST_EDGES, slab_edges: int = SLAB_EDGES, slab_points: int = SLAB_POINTS) -> DataFrame:
    """``point_id, poly_id`` for each point that a polygon contains; a point in a hole or a gap has no row.

    Polygons are closed rings by (poly_id, ring, i); longitudes on either side are taken modulo 360 from the polygons'
    own western end. Of polygons that overlap the smallest id counts. Up to ``broadcast_edges`` edges are sent to every
    task, which sweeps its batch. More are cut into slabs of longitude of some ``slab_edges`` edges; the points of a slab are
    salted into groups of some ``slab_points``, each of which gets the slab's edges and is swept in the same way.
    """
    west, east = aoi.agg(F.min("x"), F.max("x")).first()
    if west is None:
        return places.select("point_id", F.lit(None).cast("int").alias("poly_id")).where("false")
    p = places.select("point_id", (F.pmod(F.col("lon") - west, F.lit(360.0)) + west).alias("px"), F.col("lat").alias("py"))
    edges = polygon_edges(aoi)
    few = edges.limit(broadcast_edges + 1).toPandas()
    if len(few) <= broadcast_edges:
        shared = share(places.sparkSession, edge_columns(few))

        def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = sweep(b["px"].to_numpy(), b["py"].to_numpy(), shared())
                yield pd.DataFrame({"point_id": b["point_id"], "poly_id": found})[found >= 0]

        return p.mapInPandas(locate, "point_id long, poly_id int")
    edges, p = cut_lineage(edges), cut_lineage(p.where(F.col("px") <= east))
    slab = (east - west) / max(1, edges.count() // slab_edges) + 1e-9
    of = lambda c: F.floor((F.col(c) - west) / slab)
    p = p.withColumn("slab", of("px"))
    salts = F.broadcast(p.groupBy("slab").agg(F.ceil(F.count("*") / slab_points).alias("salts")))  # one row a slab
    p = p.join(salts, "slab").withColumn("salt", F.pmod(F.xxhash64("point_id"), F.col("salts"))).drop("salts")
    e = edges.withColumns({"lo": F.least("x1", "x2"), "hi": F.greatest("x1", "x2")}).withColumn("slab", F.explode(F.sequence(of("lo"), of("hi"))))
    e = e.join(salts, "slab").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")

    def meet(b: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = sweep(b["px"].to_numpy(float), b["py"].to_numpy(float), edge_columns(own))
        return pd.DataFrame({"point_id": b["point_id"], "poly_id": found})[found >= 0]

    return p.groupBy("slab", "salt").cogroup(e.groupBy("slab", "salt")).applyInPandas(meet, "point_id long, poly_id int")
