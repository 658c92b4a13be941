"""Which contents of the feature and product tables are measurements.

Fixed values of the data model: -9999 a masked pixel; bfast_change_date -2 no result for want of images;
ndfi_mean and bs_slope_* -1 together with mon_images 0 nothing to measure; land-cover codes run from 10 to 100, so
code 0 is a row that was never sampled; each field has its physical range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators.relational import looked_up
from terravane.session import cut_lineage

#: field: lowest and highest value that can be measured
PRODUCT_RANGES = {"gfc_tc00": (0.0, 100.0), "potapov_tree_height": (0.0, 60.0), "dw_tree_prob_mean": (0.0, 100.0)}
#: A batch of neighbours counts as stuck if at least this many of its rows hold something and all of it is one value.
STUCK_ROWS = 20


def in_range(c: Column, low: float, high: float) -> Column:
    """c where it lies in the range, else null (NaN counts as above every number)."""
    return F.when((c >= low) & (c <= high), c)


def finite(c: Column, masked: float = -9999.0) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")) & (c != masked), c)


def blank_row() -> Column:
    """A product row filled with zeros: a land-cover code of 0 does not exist."""
    return F.coalesce(F.col("esa_lc20") == 0, F.lit(False)) | F.coalesce(F.col("esa_lc21") == 0, F.lit(False))


def without_stuck_batches(df: DataFrame, fields: list[str], batch: str = "chunk_id", least: int = STUCK_ROWS) -> DataFrame:
    """df with the fields null in each batch whose values (nulls aside) are all one value other than 0.

    Neighbours share a batch, not a measurement: one value in a whole batch is a default that a run wrote. 0 stays, as
    bare ground is 0 over wide areas. A null batch is none. Costs one aggregate over (batch), of which only the stuck ones
    are written, and a look-up in these; df is not shuffled for it unless there are very many.
    """
    stats = df.where(F.col(batch).isNotNull()).groupBy(F.col(batch).alias("_b"))
    stats = stats.agg(*[F.when((F.count(f) >= least) & (F.min(f) == F.max(f)) & (F.max(f) != 0), F.max(f)).alias(f"_stuck_{f}") for f in fields])
    stats = stats.where(F.coalesce(*[F.col(f"_stuck_{f}") for f in fields]).isNotNull())
    stats = cut_lineage(stats)
    stuck = stats.count()
    if not stuck:
        return df
    j = looked_up(df, stats, ("_b",), stuck, {f"_stuck_{f}": F.col(f"_stuck_{f}") for f in fields}, own=(batch,))
    cleaned = {f: F.when(~F.coalesce(F.col(f) == F.col(f"_stuck_{f}"), F.lit(False)), F.col(f)) for f in fields}
    return j.select(*[cleaned[c].alias(c) if c in cleaned else F.col(f"`{c}`") for c in df.columns])


def measured_products(products: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """products with the three filled fields null wherever no measurement stands; other columns as they are."""
    p = products.withColumns({f: F.when(~blank_row(), in_range(F.col(f), *r)) for f, r in PRODUCT_RANGES.items()})
    p = p.select(*keep) if keep else p
    return without_stuck_batches(p, [f for f in PRODUCT_RANGES if f in p.columns])


def measured_bfast() -> Column:
    """bfast_magnitude where measured. 0 stays where there was no break; with change date -2 there was no result."""
    return F.when(F.coalesce(F.col("bfast_change_date") != -2, F.lit(True)), in_range(F.col("bfast_magnitude"), -1.0, 1.0))


def measured_monitor(field: str) -> Column:
    """ndfi_mean or a slope where measured: -1 with no image in the monitoring period is none."""
    c = F.col(field)
    return F.when(~F.coalesce((c == -1) & (F.col("mon_images") == 0), F.lit(False)), finite(c))


def measured_features(features: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of features (with chunk_id), measurements only in the magnitudes, means and slopes."""
    f = features.withColumn("bfast_magnitude", measured_bfast())
    for c in ("ndfi_mean", "bs_slope_mean"):
        f = f.withColumn(c, measured_monitor(c))
    for c in ("ccdc_magnitude", "cusum_magnitude", "ewma_jrc_magnitude"):
        f = f.withColumn(c, finite(F.col(c)))
    f = f.select(*dict.fromkeys([*keep, "chunk_id"]))
    return without_stuck_batches(f, [c for c in ("bfast_magnitude",) if c in keep])
