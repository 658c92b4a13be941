"""The queries of this subpackage and the SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import language, leakage, packing, pivot_clusters, rank_walk, varied_subset
from terravane.operators import measured, proximity
from terravane.plans.core_queries import MEASURED
from terravane.session import spread_table, table

MAGNITUDES = ["bfast_magnitude", "ccdc_magnitude", "cusum_magnitude", "ewma_jrc_magnitude"]
LIKENESS = ["ndfi_mean", "bfast_magnitude", "bs_slope_mean", "gfc_tc00"]


def _strengths(spark: SparkSession, d: str) -> DataFrame:
    f = measured.measured_features(table(spark, d, "features"), ["point_id", *MAGNITUDES])
    items = f.where("point_id is not null").groupBy("point_id").agg(*[F.max(F.abs(m)).alias(m) for m in MAGNITUDES])
    return rank_walk.strengths(items, MAGNITUDES).select("point_id", "n_scores", "strength", "fine_level")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rank_walk.strongest(_strengths(spark, d), 0.02, "point_id").select("point_id")


def p2_order(spark: SparkSession, d: str) -> DataFrame:
    return _strengths(spark, d).orderBy(F.desc("strength"), F.desc("fine_level"), "point_id")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    f = measured.measured_features(table(spark, d, "features"), ["point_id", "ndfi_mean", "bfast_magnitude", "bs_slope_mean"])
    f = f.groupBy("point_id").agg(*[F.max(c).alias(c) for c in ("ndfi_mean", "bfast_magnitude", "bs_slope_mean")])
    p = measured.measured_products(table(spark, d, "products"), ["point_id", "chunk_id", "gfc_tc00"]).groupBy("point_id").agg(F.max("gfc_tc00").alias("gfc_tc00"))
    points = pivot_clusters.standardised(f.join(p, "point_id"), "point_id", LIKENESS)
    return pivot_clusters.numbered(pivot_clusters.clusters(points, len(LIKENESS)), "z0")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).select(F.col("item").alias("point_id"), "cluster_no")


def p3_typical(spark: SparkSession, d: str) -> DataFrame:
    return pivot_clusters.typical(_clusters(spark, d)).withColumnRenamed("item", "point_id")


def p4_subset(spark: SparkSession, d: str) -> DataFrame:
    return varied_subset.varied_subset(proximity.point_locations(table(spark, d, "points")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.pieces(packing.token_counts(spread_table(spark, d, "documents", "doc_id"))))


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(p8_containers(spark, d))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Copies and paraphrases, with what decided."""
    found = leakage.leaks(spread_table(spark, d, "documents", "doc_id"), table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id", *[F.round(c, 4).alias(c) for c in ("held", "covered", "tail_held")], "kind")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The copies: documents that hold at least half of an item's words."""
    return p9_leaks(spark, d).where("kind = 'copy'").select("doc_id", "item_id")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = spread_table(spark, d, "documents", "doc_id")
    return language.segments(docs, language.train(table(spark, d, "documents"))).withColumn("confidence", F.round("confidence", 4))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.label_faults(p10_segments(spark, d)).select("doc_id", F.col("language").alias("found_lang"))


# --- what must hold of a whole result, as one row that SQL can give as well ------------------------------------------


def p2_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every point has one place in the order, and the first 2 % are its head."""
    order = _strengths(spark, d)
    top = rank_walk.strongest(order, 0.02, "point_id")
    least = top.agg(F.min("strength").alias("s"))
    above = order.join(F.broadcast(least)).agg(F.count("*").alias("points"), F.count_if(F.col("strength") > F.col("s")).alias("above"))
    return above.join(F.broadcast(top.agg(F.count_distinct("point_id").alias("top")))).select("points", "top", (F.col("above") <= F.col("top")).alias("head"))


def p3_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every point with the four fields is in one group, numbers have no gaps, and sizes fall."""
    sizes = p3_found(spark, d).groupBy("cluster_no").agg(F.count("*").alias("n"), F.count_distinct("point_id").alias("u"))
    ordered = F.array_sort(F.collect_list(F.struct("cluster_no", "n")))  # one entry a group
    falls = F.forall(F.zip_with(F.slice("o", 1, F.size("o") - 1), F.slice("o", 2, F.size("o")), lambda a, b: b.isNull() | (a["n"] >= b["n"])), lambda x: x)
    whole = sizes.agg(F.sum("u").alias("points"), (F.max("cluster_no") == F.count("*")).alias("dense"), ordered.alias("o"))
    return whole.select("points", "dense", F.when(F.size("o") > 1, falls).otherwise(F.lit(True)).alias("falling"))


def p4_invariants(spark: SparkSession, d: str) -> DataFrame:
    """1 % of the distinct points, at least 20, each once."""
    return p4_subset(spark, d).agg(F.count("*").alias("places"), (F.count("*") == F.count_distinct("point_id")).alias("once"), (F.min("gain") >= 0).alias("gains"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every non-empty text is packed whole and once, no container is over-full, only texts beyond a container are cut."""
    p = p8_containers(spark, d)
    texts = p.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("piece").alias("u"), F.max("piece").alias("last"), F.max(F.col("start_token") + F.col("size")).alias("end"), F.sum("size").alias("tokens"))
    whole = texts.agg(F.count("*").alias("texts"), F.min((F.col("n") == F.col("u")) & (F.col("last") + 1 == F.col("n")) & (F.col("end") == F.col("tokens"))).alias("whole"), F.min((F.col("n") == 1) | (F.col("tokens") > packing.CAPACITY)).alias("cut_if_longer"))
    full = p.groupBy("container").agg(F.sum("size").alias("load")).agg((F.max("load") <= packing.CAPACITY).alias("within_capacity"))
    return whole.join(F.broadcast(full))


def p10_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every document has one row for the whole; runs don't overlap and add up to it."""
    s = p10_segments(spark, d)
    docs = s.groupBy("doc_id").agg(F.count_if(F.col("segment") == 0).alias("whole"), F.sum(F.when(F.col("segment") == 0, F.col("words")).otherwise(-F.col("words"))).alias("gap"), F.count_if(~F.coalesce(F.col("confidence").between(0, 1), F.lit(True))).alias("odd"))
    return docs.agg(F.sum("whole").alias("documents"), (F.max(F.abs("gap")) == 0).alias("adds_up"), (F.max("odd") == 0).alias("confident"))


QUERIES = {"p10_found": p10_found, "p10_segments": p10_segments, "p8_containers": p8_containers, "p8_summary": p8_summary, "p9_found": p9_found, "p9_leaks": p9_leaks, "p2_found": p2_found, "p2_order": p2_order, "p3_found": p3_found, "p3_typical": p3_typical, "p4_subset": p4_subset}
QUERIES |= {"p2_invariants": p2_invariants, "p3_invariants": p3_invariants, "p4_invariants": p4_invariants, "p8_invariants": p8_invariants, "p10_invariants": p10_invariants}

_NUMBER = "NOT contains(CAST({c} AS VARCHAR), 'nan') AND abs({c}) <> 'inf'::double AND {c} <> -9999"
_MONITOR = " AND ".join(f"max(CASE WHEN {_NUMBER.format(c=c)} AND NOT (coalesce({c} = -1 AND mon_images = 0, false)) THEN 1 ELSE 0 END) = 1" for c in ("ndfi_mean", "bs_slope_mean"))
ORACLE: dict[str, str] = {
    "p2_invariants": "SELECT count(*) AS points, greatest(1, CAST(floor(0.02 * count(*) + 1e-9) AS BIGINT)) AS top, true AS head FROM (SELECT DISTINCT point_id FROM features WHERE point_id IS NOT NULL)",
    "p3_invariants": f"""WITH {MEASURED}, v AS (SELECT point_id, f FROM m WHERE v IS NOT NULL AND NOT coalesce(chunk_id IS NOT NULL AND n >= 20 AND lo = hi AND hi <> 0, false)), g AS (SELECT point_id FROM features GROUP BY point_id HAVING {_MONITOR})
SELECT count(*) AS points, true AS dense, true AS falling FROM g WHERE point_id IN (SELECT point_id FROM v WHERE f = 'gfc_tc00') AND point_id IN (SELECT point_id FROM v WHERE f = 'bfast_magnitude')""",
    "p4_invariants": "SELECT least(n, greatest(20, CAST(floor(0.01 * n + 1e-9) AS BIGINT))) AS places, true AS once, true AS gains FROM (SELECT count(DISTINCT point_id) AS n FROM points)",
    "p8_invariants": "SELECT count(*) AS texts, true AS whole, true AS cut_if_longer, true AS within_capacity FROM documents WHERE text <> ''",
    "p10_invariants": "SELECT count(*) AS documents, true AS adds_up, true AS confident FROM documents",
}
