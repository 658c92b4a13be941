"""Reference labels from global products, and change flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.estimation import above

# What makes each product say forest. Above a number, or one of these classes.
FOREST_ABOVE = {"lang_tree_height": 5, "potapov_tree_height": 5, "gfc_tc00": 10, "dw_tree_prob__min": 50}
FOREST_CLASSES = {"tmf_main": (10,), "esa_lc20": (10, 95), "esa_lc21": (10, 95), **{f"esri_lc{y}": (2, 3) for y in range(17, 22)}}


def forest_votes(columns: list[str]) -> list[Column]:
    """What each product that is there says about forest; a null or NaN value says no."""
    votes = [above(c, v) for c, v in FOREST_ABOVE.items() if c in columns] + [F.col(c).isin(*v) for c, v in FOREST_CLASSES.items() if c in columns]
    return [F.coalesce(v, F.lit(False)) for v in votes]


def product_labels(df: DataFrame, start: int, end: int) -> DataFrame:
    """df with ``fnf`` (1 if every product says forest, 0 if none, else null) and ``cnc`` (1 if any shows a change).

    Loss, deforestation and degradation years lie strictly between start and end; gain counts if it is set."""
    votes = F.array(*forest_votes(df.columns))
    fnf = F.when(F.forall(votes, lambda v: v), 1).when(~F.exists(votes, lambda v: v), 0)
    year = lambda c, lo, hi: F.coalesce((F.col(c) > lo) & (F.col(c) < hi), F.lit(False)).cast("int")
    cnc = F.greatest(year("gfc_lossyear", start % 100, end % 100), F.coalesce(F.col("gfc_gain") != 0, F.lit(False)).cast("int"), year("tmf_defyear", start, end), year("tmf_degyear", start, end))
    return df.withColumns({"fnf": fnf, "cnc": cnc})


def membership(c: Column, categories: list) -> Column:
    """1 if the value is one of the categories, else 0 (null as well)."""
    return F.when(c.isin(*categories), 1).otherwise(0)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, weight``: n_all / (classes * n) per class."""
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("_a"), F.count("*").alias("_k"))
    return g.join(F.broadcast(total)).select(label, "n", (F.col("_a") / (F.col("_k") * F.col("n"))).alias("weight"))
