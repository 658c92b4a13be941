"""Rasters in long form (cell_x, cell_y, value): sampling, buffers, counts, blocks, components; grids over an area."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions import geometry
from terravane.functions.estimation import nan_to_null
from terravane.operators import proximity, relational
from terravane.session import cut_lineage


def cell(c: Column, scale: float) -> Column:
    return F.floor(c / F.lit(scale)).cast("long")


def at_points(points: DataFrame, raster: DataFrame, scale: float) -> DataFrame:
    """points with the values of the cell that each lies in; null where there is no cell."""
    return points.withColumns({"cell_x": cell(F.col("x"), scale), "cell_y": cell(F.col("y"), scale)}).join(raster, ["cell_x", "cell_y"], "left")


def buffer_mean(points: DataFrame, raster: DataFrame, scale: float, radius: float, key: str = "point_id", value: str = "value") -> DataFrame:
    """Mean of the cells that the box of half width ``radius`` around each point touches; an equi-join on cells."""
    span = lambda c: F.sequence(cell(F.col(c) - radius, scale), cell(F.col(c) + radius, scale))
    p = points.select(key, F.explode(span("x")).alias("cell_x"), "y").select(key, "cell_x", F.explode(span("y")).alias("cell_y"))
    return p.join(raster, ["cell_x", "cell_y"]).groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("cells"))


def cell_counts(points: DataFrame, size: float, below: int) -> DataFrame:
    """Points per cell of a size, for cells with more than none and fewer than ``below``."""
    return points.groupBy(cell(F.col("x"), size).alias("cell_x"), cell(F.col("y"), size).alias("cell_y")).agg(F.count("*").alias("n")).where((F.col("n") > 0) & (F.col("n") < below))


def block_majority(raster: DataFrame, factor: int, value: str = "value", share: float = 0.5) -> DataFrame:
    """Blocks of factor x factor cells whose mean is above a share: 1, else 0."""
    b = raster.groupBy(F.floor(F.col("cell_x") / factor).alias("cell_x"), F.floor(F.col("cell_y") / factor).alias("cell_y")).agg(F.avg(value).alias("mean"))
    return b.select("cell_x", "cell_y", (F.col("mean") > share).cast("int").alias("value"))


def mmu_pixels(hectares: float, pixel: float = 30.0) -> int:
    """Pixels of a minimum mapping unit."""
    scale = math.floor(math.sqrt(hectares * 10_000))
    return math.floor(scale**2 / pixel**2)


def linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n things the smallest one that links (i, j) lead to: roots are hung under smaller ones and paths halved
    until both ends of every link have one root."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def components(raster: DataFrame) -> DataFrame:
    """``cell_x, cell_y, component, size``: 8-connected components of the cells given (each cell once).

    Tiles of TILE x TILE cells are labelled locally; labels that meet across tile borders are then joined by repeated
    smallest-label exchange with pointer jumping, over the labels only, until no label changes. Each round is checkpointed.
    """
    tile = 256
    r = raster.select("cell_x", "cell_y").distinct().withColumns({"tx": F.floor(F.col("cell_x") / tile), "ty": F.floor(F.col("cell_y") / tile)})

    def local(b: pd.DataFrame) -> pd.DataFrame:
        x, y = b["cell_x"].to_numpy(), b["cell_y"].to_numpy()
        key = (x - x.min()) * (2 * tile) + (y - y.min())  # a neighbour beyond the tile has a key of its own
        order = np.argsort(key)
        ends = []
        for dx, dy in ((1, -1), (1, 0), (1, 1), (0, 1)):
            wanted = key + dx * 2 * tile + dy
            at = np.minimum(np.searchsorted(key[order], wanted), len(key) - 1)
            hit = key[order[at]] == wanted
            hit &= (y + dy - y.min() >= 0)
            ends.append((np.nonzero(hit)[0], order[at[hit]]))
        roots = linked(len(key), np.concatenate([i for i, _ in ends]), np.concatenate([j for _, j in ends]))
        name = x[roots] * 2**31 + y[roots]  # cells lie within 31 bits
        return pd.DataFrame({"cell_x": x, "cell_y": y, "label": name})

    cells = cut_lineage(r.groupBy("tx", "ty").applyInPandas(local, "cell_x long, cell_y long, label long"))
    edge = cells.where(f"pmod(cell_x, {tile}) in (0, {tile - 1}) or pmod(cell_y, {tile}) in (0, {tile - 1})")
    near = edge.withColumn("d", F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((1, -1), (1, 0), (1, 1), (0, 1))])))
    near = near.select((F.col("cell_x") + F.col("d.x")).alias("cell_x"), (F.col("cell_y") + F.col("d.y")).alias("cell_y"), F.col("label").alias("a"))
    links = near.join(edge, ["cell_x", "cell_y"]).where("a <> label").select("a", F.col("label").alias("b"))
    links = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = cut_lineage(links.select(F.col("a").alias("label"), F.col("a").alias("root")).distinct())
    changed = 1
    while changed:  # labels only fall, so this ends
        low = links.join(names, F.col("b") == F.col("label")).groupBy("a").agg(F.min("root").alias("low"))
        new = names.join(low, F.col("label") == F.col("a"), "left").select("label", F.least("root", F.coalesce("low", "root")).alias("root"), F.col("root").alias("was"))
        up = new.select(F.col("label").alias("l"), F.col("root").alias("r2"))
        new = cut_lineage(new.join(up, F.col("root") == F.col("l"), "left").select("label", F.least("root", F.coalesce("r2", "root")).alias("root"), "was"))
        changed = new.where("root <> was").limit(1).count()
        names = new.select("label", "root")
    out = relational.looked_up(cells, names, ("label",), names.count(), {"root": F.col("root")}).select("cell_x", "cell_y", F.coalesce("root", "label").alias("component"))
    sizes = cut_lineage(out.groupBy("component").agg(F.count("*").alias("n")))
    # a giant component is one key: up to some 200,000 components its size is sent to the tasks instead of its cells to one
    return relational.looked_up(out, sizes, ("component",), sizes.count(), {"size": F.col("n")}).select("cell_x", "cell_y", "component", "size")


def square_grid(spark, bounds: tuple[float, float, float, float], spacing: float) -> DataFrame:
    """``point_id, xmin, ymin, xmax, ymax, x, y``: the cells of a square grid from the lower left corner, columns first;
    both ends of the bounds get a cell. x, y is the centre."""
    x0, y0, x1, y1 = bounds
    nx, ny = int((x1 - x0) // spacing) + 1, int((y1 - y0) // spacing) + 1
    i, j = F.floor(F.col("id") / ny), F.col("id") % ny
    g = spark.range(nx * ny).select(F.col("id").alias("point_id"), (x0 + i * spacing).alias("xmin"), (y0 + j * spacing).alias("ymin"))
    return g.select("*", (F.col("xmin") + spacing).alias("xmax"), (F.col("ymin") + spacing).alias("ymax"), (F.col("xmin") + spacing / 2).alias("x"), (F.col("ymin") + spacing / 2).alias("y"))


def inside(points: DataFrame, aoi: DataFrame) -> DataFrame:
    """points (point_id, x, y) that lie in a polygon, with its poly_id."""
    at = proximity.containing_region(points.select("point_id", F.col("x").alias("lon"), F.col("y").alias("lat")), aoi)
    return points.join(at, "point_id")


def hex_grid(spark, bounds: tuple[float, float, float, float], area_km2: float) -> DataFrame:
    """``point_id, q, r, x, y, lon, lat``: centres of an equal-area hexagonal lattice in the Behrmann plane over bounds
    in degrees, numbered along a Hilbert curve. Planar hexagons, not a polyhedral global grid."""
    side = geometry.hex_side(area_km2 * 1e6)
    lon0, lat0, lon1, lat1 = bounds
    corners = spark.createDataFrame([(lon0, lat0), (lon1, lat1)], "lon double, lat double").select(geometry.behrmann_x(F.col("lon")).alias("x"), geometry.behrmann_y(F.col("lat")).alias("y")).collect()
    (x0, y0), (x1, y1) = corners
    width, height = math.sqrt(3) * side, 1.5 * side
    r0, r1 = math.floor(y0 / height), math.ceil(y1 / height)
    rows = spark.range(r0, r1 + 1).select(F.col("id").alias("r"))
    q = F.explode(F.sequence(F.floor(F.lit(x0) / width - F.col("r") / 2).cast("long"), F.ceil(F.lit(x1) / width - F.col("r") / 2).cast("long")))
    g = rows.select("r", q.alias("q")).select("q", "r", (width * (F.col("q") + F.col("r") / 2)).alias("x"), (height * F.col("r")).alias("y"))
    g = g.where((F.col("x").between(x0, x1)) & (F.col("y").between(y0, y1)))
    key = geometry.hilbert_key(geometry.scaled(F.col("x"), x0, x1), geometry.scaled(F.col("y"), y0, y1))
    g = relational.numbered(g.withColumn("_h", key), ["_h", "q", "r"], "point_id")
    return g.select("point_id", "q", "r", "x", "y", geometry.behrmann_lon(F.col("x")).alias("lon"), geometry.behrmann_lat(F.col("y")).alias("lat"))


def rings(aoi: DataFrame) -> DataFrame:
    """``poly_id, ring, xs, ys, xmin, ymin, xmax, ymax``: one row per ring, vertices in order."""
    g = aoi.groupBy("poly_id", "ring").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("v"), *[f(c).alias(f"{c}{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])
    return g.select("poly_id", "ring", F.col("v.x").alias("xs"), F.col("v.y").alias("ys"), "xmin", "ymin", "xmax", "ymax")


def clip_to_box(xs: np.ndarray, ys: np.ndarray, box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """A ring cut to a box, side by side of the box; empty if nothing is left."""
    p = np.stack([xs, ys], 1)
    for axis, edge, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        if not len(p):
            break
        q = np.roll(p, -1, axis=0)
        a, b = sign * (p[:, axis] - edge), sign * (q[:, axis] - edge)
        stay, cross = np.nonzero(a >= 0)[0], np.nonzero((a >= 0) != (b >= 0))[0]
        cut = p[cross] + (q[cross] - p[cross]) * (a[cross] / (a[cross] - b[cross]))[:, None]
        p = np.concatenate([p[stay], cut])[np.argsort(np.concatenate([2 * stay, 2 * cross + 1]), kind="stable")]
    return p[:, 0], p[:, 1]


def clipped_area(cells: DataFrame, aoi: DataFrame, bucket: float = 1.0) -> DataFrame:
    """``point_id, poly_id, area``: each cell's area within each polygon, holes taken off, in squared units of x and y.

    Cells meet rings by shared buckets of their boxes, an equi-join; the cutting runs in Arrow batches."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / bucket).cast("long"), F.floor(F.col(b) / bucket).cast("long"))
    c = cells.select("point_id", *[F.col(k).alias(f"c_{k}") for k in ("xmin", "ymin", "xmax", "ymax")])
    cb = c.withColumn("bx", F.explode(span("c_xmin", "c_xmax"))).withColumn("by", F.explode(span("c_ymin", "c_ymax")))
    rb = rings(aoi).withColumn("bx", F.explode(span("xmin", "xmax"))).withColumn("by", F.explode(span("ymin", "ymax")))
    near = cb.join(rb, ["bx", "by"]).where("c_xmin < xmax and c_xmax > xmin and c_ymin < ymax and c_ymax > ymin")
    # a pair shares several buckets; the one that holds the larger of both lower corners stands for it
    near = near.where((F.col("bx") == F.floor(F.greatest("c_xmin", "xmin") / bucket)) & (F.col("by") == F.floor(F.greatest("c_ymin", "ymin") / bucket)))

    def area(xs: pd.Series, ys: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for x, y, *box in zip(xs, ys, a, b, c, d):
            u, v = clip_to_box(np.asarray(x, float)[:-1], np.asarray(y, float)[:-1], tuple(box))
            out.append(abs((u * np.roll(v, -1) - np.roll(u, -1) * v).sum()) / 2 if len(u) > 2 else 0.0)
        return pd.Series(out, dtype=float)

    sign = F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    part = near.withColumn("area", sign * F.pandas_udf(area, "double")("xs", "ys", "c_xmin", "c_ymin", "c_xmax", "c_ymax"))
    return part.groupBy("point_id", "poly_id").agg(F.sum("area").alias("area")).where("area > 0")


def random_points(aoi: DataFrame, per_polygon: int, seed: int = 42) -> DataFrame:
    """``poly_id, k, x, y``: the same number of random points in each polygon, by rejection within its bounds.

    Draws are hashes of (polygon, number), so they do not depend on partitions. Polygons that fill little of their bounds
    get more draws until they have enough; one that has none in a million draws for each point is an error."""
    shells = aoi.where("ring = 0").groupBy("poly_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    found, first, tries, left = None, 0, 8 * per_polygon, cut_lineage(shells)
    w = Window.partitionBy("poly_id").orderBy("try")  # the points found in one polygon
    while not left.isEmpty():
        if first > 1_000_000 * per_polygon:
            raise ValueError(f"no room for {per_polygon} points in the polygons {[r[0] for r in left.select('poly_id').limit(5).collect()]}")
        draw = left.withColumn("try", F.explode(F.sequence(F.lit(first), F.lit(first + tries - 1))))
        u = lambda n: F.pmod(F.xxhash64("poly_id", "try", F.lit(seed + n)), F.lit(2**40)) / float(2**40)
        draw = draw.select("poly_id", "try", (F.col("x0") + u(0) * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + u(1) * (F.col("y1") - F.col("y0"))).alias("y"))
        ids = cut_lineage(draw.withColumn("point_id", F.monotonically_increasing_id()))
        hit = proximity.containing_region(ids.select("point_id", F.col("x").alias("lon"), F.col("y").alias("lat")), aoi).withColumnRenamed("poly_id", "_p")
        good = ids.join(hit, "point_id").where("_p = poly_id").select("poly_id", "try", "x", "y")
        good = good if found is None else found.unionByName(good)
        found = cut_lineage(good.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_polygon).drop("k"))
        full = found.groupBy("poly_id").count().where(F.col("count") >= per_polygon)
        left = cut_lineage(shells.join(full, "poly_id", "left_anti"))
        first, tries = first + tries, 2 * tries
    if found is None:
        return aoi.select("poly_id", F.lit(0).alias("k"), "x", "y").where("false")
    return found.withColumn("k", F.row_number().over(w)).select("poly_id", "k", "x", "y")


def zonal_stats(df: DataFrame, zone: list[str], bands: list[str]) -> DataFrame:
    """Mean, minimum, maximum and deviation of each band in each zone, in one pass; null and NaN are passed over."""
    stats = (("mean", F.avg), ("min", F.min), ("max", F.max), ("sd", F.stddev_pop))
    return df.groupBy(*zone).agg(*[f(nan_to_null(b)).alias(f"{b}_{n}") for b in bands for n, f in stats])


def year_bands(df: DataFrame, prefix: str, years: list[int], name: str, keep: list[str]) -> DataFrame:
    """The columns ``<prefix><year>`` of the years given that df has, as ``<name>_<year>``, with the columns to keep."""
    return df.select(*keep, *[F.col(f"{prefix}{y}").alias(f"{name}_{y}") for y in years if f"{prefix}{y}" in df.columns])


def latest_valid(df: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Per key and value column the last value in an order that is not masked (null or NaN): a mosaic of pixels."""
    last = lambda c: F.max_by(F.col(c), F.when(nan_to_null(c).isNotNull(), F.struct(*order)))
    return df.groupBy(*key).agg(*[last(c).alias(c) for c in values])


def sample_products(points: DataFrame, pixels: DataFrame, products: dict[str, float], key: str = "point_id") -> DataFrame:
    """points with a column for each product of a catalogue (name: cell size), sampled at the cell that the point lies in.

    ``pixels`` is the long form (product, cell_x, cell_y, value). A point's cells in all products are one equi-join on
    (product, cell), and one aggregate per point puts the values side by side; points outside all cells keep nulls."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("product"), cell(F.col("x"), s).alias("cell_x"), cell(F.col("y"), s).alias("cell_y")) for n, s in products.items()]))
    at = points.select(key, "x", "y").withColumn("_c", cells).select(key, "_c.*").join(pixels.where(F.col("product").isin(*products)), ["product", "cell_x", "cell_y"])
    wide = at.groupBy(key).agg(*[F.max(F.when(F.col("product") == n, F.col("value"))).alias(n) for n in products])
    return points.join(wide, key, "left")


def tiles(spark, bounds: tuple[float, float, float, float], size: float) -> DataFrame:
    """Tiles over bounds; the last one of a row or column starts no later than 0.9 sizes before the end."""
    x0, y0, x1, y1 = bounds
    starts = lambda a, b: max(1, math.floor((b - 0.9 * size - a) / size + 1e-9) + 1)
    nx, ny = starts(x0, x1), starts(y0, y1)
    g = spark.range(nx * ny).select(F.floor(F.col("id") / ny).alias("i"), (F.col("id") % ny).alias("j"))
    return g.select("i", "j", (x0 + F.col("i") * size).alias("xmin"), (y0 + F.col("j") * size).alias("ymin"), (x0 + (F.col("i") + 1) * size).alias("xmax"), (y0 + (F.col("j") + 1) * size).alias("ymax"))


def tiles_over(aoi: DataFrame, size: float, buffer: float = 1.0) -> DataFrame:
    """``tiles`` over the bounds of the polygons, widened on all sides, of which only those stay that share area with one."""
    x0, y0, x1, y1 = aoi.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    t = tiles(aoi.sparkSession, (x0 - buffer, y0 - buffer, x1 + buffer, y1 + buffer), size).withColumn("point_id", F.xxhash64("i", "j"))
    return t.join(clipped_area(t, aoi, max(1.0, size)).select("point_id").distinct(), "point_id", "left_semi").drop("point_id")


def nearest(left: DataFrame, right: DataFrame, distance: float, right_id: str) -> DataFrame:
    """left (x, y) with the nearest rows of right (x, y) within a planar distance: ties give several rows, none a null.

    An equi-join on the 3 x 3 cells of side ``distance`` around each left row; only the id, the distance and the place
    go through the ranking, so wide rows are joined back once."""
    l = left.withColumn("_l", F.monotonically_increasing_id())
    l = cut_lineage(l)
    d = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    probe = l.select("_l", F.col("x").alias("lx"), F.col("y").alias("ly")).where("lx is not null and ly is not null")
    probe = probe.withColumn("dx", d).withColumn("dy", d).withColumns({"cx": cell(F.col("lx"), distance) + F.col("dx"), "cy": cell(F.col("ly"), distance) + F.col("dy")})
    r = right.select(F.col(right_id).alias("_r"), F.col("x").alias("rx"), F.col("y").alias("ry")).withColumns({"cx": cell(F.col("rx"), distance), "cy": cell(F.col("ry"), distance)})
    near = probe.join(r, ["cx", "cy"]).withColumn("distance", F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))).where(F.col("distance") <= distance)
    w = Window.partitionBy("_l")
    best = near.withColumn("_d", F.min(F.round("distance", 12)).over(w)).where(F.round("distance", 12) == F.col("_d"))
    return l.join(best.select("_l", F.col("_r").alias(f"near_{right_id}"), F.round("distance", 9).alias("distance")), "_l", "left").drop("_l")


def hull(points: DataFrame, key: str) -> DataFrame:
    """Convex hull per key as ``ring``: each task first reduces its points to their own hulls, then those are joined."""

    def chain(p: np.ndarray) -> list[tuple[float, float]]:
        pts = sorted(set(map(tuple, p.tolist())))
        if len(pts) < 3:
            return pts

        def half(seq) -> list:
            out: list = []
            for q in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out[:-1]

        return half(pts) + half(reversed(pts))

    def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, g in b.groupby(key):
                h = chain(g[["x", "y"]].to_numpy())
                yield pd.DataFrame({key: k, "x": [a for a, _ in h], "y": [c for _, c in h]})

    def join(b: pd.DataFrame) -> pd.DataFrame:
        h = chain(b[["x", "y"]].to_numpy())
        return pd.DataFrame({key: [b[key].iloc[0]], "ring": [[{"x": a, "y": c} for a, c in h]]})

    kind = dict(points.dtypes)[key]
    few = points.select(key, "x", "y").dropna().mapInPandas(reduce_, f"{key} {kind}, x double, y double")
    return few.groupBy(key).applyInPandas(join, f"{key} {kind}, ring array<struct<x:double,y:double>>")
