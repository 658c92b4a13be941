"""Choosing training points by thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.estimation import above, nan_to_null
from terravane.operators.relational import exact_percentiles

ABSOLUTE = ["bfast_magnitude", "ccdc_magnitude", "cusum_magnitude", "ewma_jrc_magnitude"]


def over_thresholds(df: DataFrame, percentile: float = 0.95, tree_cover: float = 10, tree_height: float = 5, start: int = 2015, end: int = 2022) -> DataFrame:
    """Rows that stand out in any of six ways; a null or NaN never does, nor does it enter a percentile.

    A magnitude beyond its percentile (strictly, by size) under forest (cover or height above a limit); a mean slope
    beyond its percentile with tall trees; a loss, degradation or deforestation year within the period. The percentiles
    are exact and linear; five numbers reach the driver.
    """
    size = {c: F.abs(nan_to_null(c)) for c in ABSOLUTE}
    cut = exact_percentiles(df, {**size, "bs_slope_mean": nan_to_null("bs_slope_mean")}, percentile)
    forest = above("gfc_tc00", tree_cover) | above("potapov_tree_height", tree_height)
    no = lambda c: F.coalesce(c, F.lit(False))
    beyond = lambda c, k: no(c > F.lit(cut[k]).cast("double"))
    tests = [beyond(size[c], c) & forest for c in ABSOLUTE]
    tests.append(beyond(nan_to_null("bs_slope_mean"), "bs_slope_mean") & above("potapov_tree_height", tree_height))
    tests.append(no(F.col("gfc_lossyear").between(start - 2000, end - 2000)) | no(F.col("tmf_defyear").between(start, end)) | no(F.col("tmf_degyear").between(start, end)))
    return df.where(reduce(lambda a, b: a | b, tests))
