"""Projections, curve keys and lattices as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84 semi-major axis and squared eccentricity; standard parallel of the Behrmann projection.
SEMI_MAJOR = 6_378_137.0
ECCENTRICITY_2 = 0.006_694_379_990_14
STANDARD_PARALLEL = math.radians(30)
_E = math.sqrt(ECCENTRICITY_2)
_K0 = math.cos(STANDARD_PARALLEL) / math.sqrt(1 - ECCENTRICITY_2 * math.sin(STANDARD_PARALLEL) ** 2)


def _q(s: Column) -> Column:
    """The authalic function of the sine of the latitude."""
    return (1 - ECCENTRICITY_2) * (s / (1 - ECCENTRICITY_2 * s * s) - F.ln((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def behrmann_x(lon: Column) -> Column:
    return SEMI_MAJOR * _K0 * F.radians(lon)


def behrmann_y(lat: Column) -> Column:
    return SEMI_MAJOR * _q(F.sin(F.radians(lat))) / (2 * _K0)


def behrmann_lon(x: Column) -> Column:
    return F.degrees(x / (SEMI_MAJOR * _K0))


def behrmann_lat(y: Column) -> Column:
    """Latitude from the authalic latitude's series (error below 1e-9 degrees)."""
    e2 = ECCENTRICITY_2
    pole = (1 - e2) * (1 / (1 - e2) - math.log((1 - _E) / (1 + _E)) / (2 * _E))
    b = F.asin(2 * y * _K0 / (SEMI_MAJOR * pole))
    terms = (
        (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 2),
        (23 * e2**2 / 360 + 251 * e2**3 / 3780, 4),
        (761 * e2**3 / 45360, 6),
    )
    return F.degrees(reduce(lambda a, t: a + t[0] * F.sin(t[1] * b), terms, b))


def scaled(c: Column, low: float, high: float, bits: int = 16) -> Column:
    """c from [low, high] to whole numbers of ``bits`` bits."""
    top = 2**bits - 1
    span = (high - low) or 1.0
    return F.least(F.lit(top), F.greatest(F.lit(0), F.floor((c - low) / span * top))).cast("long")


def hilbert_key(x: Column, y: Column, bits: int = 16) -> Column:
    """Distance along the Hilbert curve of the cell (x, y), whole numbers below 2**bits.

    The classic walk from the coarsest square down, kept in one struct (x, y, d) that a fold carries along, so that the
    expression stays small however many bits there are."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(a: Column, s: Column) -> Column:
        rx = F.when(a["x"].bitwiseAND(s) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        ry = F.when(a["y"].bitwiseAND(s) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        d = a["d"] + s * s * (F.lit(3).cast("long") * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        fx = F.when(flip, s - 1 - a["x"].bitwiseAND(s - 1)).otherwise(a["x"].bitwiseAND(s - 1))
        fy = F.when(flip, s - 1 - a["y"].bitwiseAND(s - 1)).otherwise(a["y"].bitwiseAND(s - 1))
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    squares = F.array(*[F.lit(2**k).cast("long") for k in range(bits - 1, -1, -1)])
    return F.aggregate(squares, start, step, lambda a: a["d"])


def hex_side(area: float) -> float:
    """Side of a regular hexagon of an area."""
    return math.sqrt(2 * area / (3 * math.sqrt(3)))


def hex_cell_area_km2(resolution: int) -> float:
    """Mean cell area of an aperture-3 hexagonal grid of the globe (10 * 3^r + 2 cells)."""
    return 510_065_621.724 / (10 * 3**resolution + 2)
