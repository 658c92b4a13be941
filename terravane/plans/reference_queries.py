"""One query for each operator of the area-estimation and change-analysis pipeline, with the SQL that must agree."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane import pipeline
from terravane.config import ProjectConfig
from terravane.functions import estimation, geometry
from terravane.operators import change, labels, ml, proximity, raster, relational, series, subsample
from terravane.plans.core_queries import LAT, LON, PLACES
from terravane.session import cut_lineage, spread_table, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
EPS = 1e-10


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r(c: Column | str, places: int = 6) -> Column:
    """Rounded a hair upwards, so that two engines agree on ties."""
    return F.round((F.col(c) if isinstance(c, str) else c) + EPS, places)


def sr(c: str, places: int = 6) -> str:
    return f"round({c} + {EPS!r}, {places})"


def obs(spark: SparkSession, d: str) -> DataFrame:
    return series.observations(table(spark, d, "obs"))


def assembled(spark: SparkSession, d: str) -> DataFrame:
    return series.assemble(obs(spark, d))


_B = series.BANDS
_REAL = "CASE WHEN NOT contains(CAST({c} AS VARCHAR), 'nan') AND abs({c}) <> 'inf'::double THEN {c} END"
_CLEAN = ", ".join(f"CASE WHEN NOT contains(CAST({b} AS VARCHAR), 'nan') AND {b} <> -9999 THEN {b} END AS {b}" for b in _B)
_OBS = f"""o AS (
  SELECT point_id, imageid, CAST(try_strptime(split_part(imageid, '_', 3), '%Y%m%d') AS DATE) AS date, split_part(imageid, '_', 2) AS path_row, {_CLEAN}, x, y, ingested_at
  FROM obs WHERE green IS NULL OR green <> -9999
)"""
_A1 = f"""{_OBS}, daily AS (
  SELECT * FROM o WHERE point_id IS NOT NULL AND date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY point_id, path_row, date ORDER BY ingested_at NULLS FIRST, imageid NULLS FIRST, {', '.join(f'{b} NULLS FIRST' for b in _B)}) = 1
), best AS (
  SELECT point_id, path_row FROM (SELECT point_id, path_row, count(*) AS n FROM daily GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY n DESC, path_row) = 1
), a AS (SELECT d.* FROM daily d JOIN best b ON d.point_id = b.point_id AND d.path_row = b.path_row)"""


# --- series ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_OBS} SELECT path_row, count(*) AS n, count(ndfi) AS n_ndfi, min(date) AS first_date, max(date) AS last_date FROM o GROUP BY path_row")
def obs_masked(spark, d):
    return obs(spark, d).groupBy("path_row").agg(F.count("*").alias("n"), F.count("ndfi").alias("n_ndfi"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("SELECT point_id, imageid, " + ", ".join(f"CASE WHEN {b} IS NULL OR contains(CAST({b} AS VARCHAR), 'nan') THEN -9999 ELSE {b} END AS {b}" for b in ("green", "ndfi")) + " FROM obs")
def obs_default_values(spark, d):
    return series.with_default(table(spark, d, "obs").select("point_id", "imageid", "green", "ndfi"), ["green", "ndfi"])


@query(f"WITH {_A1} SELECT point_id, path_row, count(*) AS images, min(date) AS first_date, max(date) AS last_date, {sr('sum(ndfi)', 4)} AS ndfi_sum FROM a GROUP BY point_id, path_row")
def series_assemble(spark, d):
    g = assembled(spark, d).groupBy("point_id", "path_row")
    return g.agg(F.count("*").alias("images"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), r(F.sum("ndfi"), 4).alias("ndfi_sum"))


@query(f"WITH {_A1} SELECT point_id, date, {sr('avg(ndfi) OVER (PARTITION BY point_id ORDER BY date RANGE BETWEEN INTERVAL 59 DAYS PRECEDING AND CURRENT ROW)')} AS ndfi FROM a")
def series_rolling_mean(spark, d):
    return series.rolling_mean(assembled(spark, d), ["ndfi"]).select("point_id", "date", r("ndfi").alias("ndfi"))


@query(f"""WITH {_A1}, s AS (SELECT *, avg(ndfi) OVER w AS m, stddev_pop(ndfi) OVER w AS sd FROM a WINDOW w AS (PARTITION BY point_id))
SELECT point_id, date, ndfi FROM s WHERE (sd = 0 OR abs(ndfi - m) <= 3 * sd) AND {' AND '.join(f'{b} IS NOT NULL' for b in _B)}""")
def series_outlier_drop(spark, d):
    return series.drop_outliers(assembled(spark, d), _B, "ndfi").select("point_id", "date", "ndfi")


@query("""SELECT series_id, len(list_filter(dates, lambda x: x > DATE '2018-01-01' AND x < DATE '2020-01-01')) AS images FROM series""")
def series_subset(spark, d):
    s = series.open_interval_nested(table(spark, d, "series"), "2018-01-01", "2020-01-01", ["ndfi"])
    return s.select("series_id", F.coalesce("images", F.lit(0)).cast("long").alias("images"))


@query(f"WITH {_A1} SELECT p.point_id, " + ", ".join(sr(f"coalesce({f}({b}), -1)", 5) + f" AS {b}_{n}" for b in ("ndfi", "nir") for n, f in (("mean", "avg"), ("sd", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM (SELECT DISTINCT point_id FROM points) p LEFT JOIN (SELECT * FROM a WHERE date > DATE '2020-01-01' AND date < DATE '2023-01-01') a ON a.point_id = p.point_id GROUP BY p.point_id")
def series_timescan(spark, d):
    t = series.timescan(series.open_interval(assembled(spark, d), "2020-01-01", "2023-01-01"), table(spark, d, "points"), ["ndfi", "nir"])
    return t.select("point_id", *[r(c, 5).alias(c) for c in t.columns if c != "point_id"])


@query(f"""WITH {_A1}, z AS (SELECT point_id, CASE WHEN NOT abs(ndfi - avg(ndfi) OVER w) > 2 * stddev_pop(ndfi) OVER w THEN ndfi END AS v FROM a WINDOW w AS (PARTITION BY point_id))
SELECT p.point_id, {', '.join(sr(f'coalesce({f}(v), -1)', 5) + f' AS ndfi_{n}' for n, f in (('mean', 'avg'), ('sd', 'stddev_pop'), ('min', 'min'), ('max', 'max')))} FROM (SELECT DISTINCT point_id FROM points) p LEFT JOIN z USING (point_id) GROUP BY p.point_id""")
def timescan_masked(spark, d):
    t = series.timescan(assembled(spark, d), table(spark, d, "points"), ["ndfi"], z=2.0)
    return t.select("point_id", *[r(c, 5).alias(c) for c in t.columns if c != "point_id"])


@query(f"WITH {_A1} SELECT point_id, CAST(year(date) AS INT) AS year, {sr('avg(ndfi)', 5)} AS mean, {sr('stddev_pop(ndfi)', 5)} AS sd FROM a WHERE year(date) >= 2018 GROUP BY point_id, year(date)")
def series_annual_mean(spark, d):
    return series.yearly(assembled(spark, d), "ndfi", 2018).select("point_id", "year", r("mean", 5).alias("mean"), r("sd", 5).alias("sd"))


@query(f"WITH {_A1} SELECT point_id, " + ", ".join(sr(f"{f}({b}) FILTER (WHERE year(date) = {y})", 5) + f" AS {b}_{y}_{n}" for y in range(2019, 2022) for b in ("red", "nir") for n, f in (("mean", "avg"), ("sd", "stddev_pop"))) + " FROM a GROUP BY point_id")
def series_year_pivot(spark, d):
    w = series.yearly_wide(assembled(spark, d), ["red", "nir"], 2019, 2022)
    return w.select("point_id", *[r(c, 5).alias(c) for c in w.columns if c != "point_id"])


@query(f"""WITH {_A1}, s AS (SELECT point_id, date, coalesce(ndfi - avg(ndfi) OVER (PARTITION BY point_id), 0) AS r FROM a),
c AS (SELECT point_id, date, round(sum(r) OVER (PARTITION BY point_id ORDER BY date ROWS UNBOUNDED PRECEDING), 10) AS s FROM s)
SELECT point_id, arg_max(date, (s, -epoch(date))) AS date, {sr('max(s) - min(s)', 5)} AS magnitude FROM c GROUP BY point_id""")
def series_cusum(spark, d):
    return series.cusum(assembled(spark, d), "ndfi").select("point_id", "date", r("magnitude", 5).alias("magnitude"))


@query(f"WITH {_A1} SELECT point_id, {sr('regr_slope(ndfi, year(date) + round(dayofyear(date) / 365.0, 3))', 5)} AS slope, {sr('max(year(date) + round(dayofyear(date) / 365.0, 3))', 3)} AS last_year FROM a GROUP BY point_id")
def series_slope(spark, d):
    a = assembled(spark, d).withColumn("t", estimation.fraction_year(F.col("date")))
    return a.groupBy("point_id").agg(r(F.regr_slope("ndfi", "t"), 5).alias("slope"), r(F.max("t"), 3).alias("last_year"))


@query(f"WITH {_A1} SELECT point_id, count(*) AS images, count(ndfi) AS n_ndfi, {sr('list(green ORDER BY date)[1]')} AS first_green FROM a GROUP BY point_id")
def series_nested(spark, d):
    n = series.nested(assembled(spark, d))
    return n.select("point_id", F.col("images").cast("long").alias("images"), F.size(F.filter(F.col("ts")["ndfi"], lambda x: x.isNotNull())).cast("long").alias("n_ndfi"), r(F.get(F.col("ts")["green"], F.lit(0))).alias("first_green"))


@query("""WITH z AS (SELECT series_id, unnest(dates) AS d, unnest(ts['red']) AS v FROM series)
SELECT series_id, count(*) AS n, count(v) AS n_values, count(*) FILTER (WHERE d IS NULL) AS n_undated FROM z GROUP BY series_id""")
def zip_values(spark, d):
    z = table(spark, d, "series").select("series_id", F.explode(F.arrays_zip(F.col("dates").alias("d"), F.col("ts")["red"].alias("v"))).alias("z"))
    return z.groupBy("series_id").agg(F.count("*").alias("n"), F.count("z.v").alias("n_values"), F.count_if(F.col("z.d").isNull()).alias("n_undated"))


# --- joins, sets, ranks ---------------------------------------------------------------------------------------------

_FIRST_F = "ff AS (SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY processed_at, row_id) = 1)"
_FIRST_P = "pp AS (SELECT * FROM products QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY sampled_at, row_id) = 1)"


def first_features(spark, d):
    return relational.keep_first(table(spark, d, "features"), ["point_id"], ["processed_at", "row_id"])


def first_products(spark, d):
    return relational.keep_first(table(spark, d, "products"), ["point_id"], ["sampled_at", "row_id"])


@query(f"WITH {_FIRST_F} SELECT point_id, row_id, chunk_id, images FROM ff")
def dedup_keep_first(spark, d):
    return first_features(spark, d).select("point_id", "row_id", "chunk_id", "images")


@query(f"WITH {_FIRST_F}, {_FIRST_P} SELECT point_id, ff.row_id AS feature_row, pp.row_id AS product_row, ff.images, {_REAL.format(c='gfc_tc00')} AS gfc_tc00, esa_lc20, {_REAL.format(c='cusum_magnitude')} AS cusum_magnitude FROM ff JOIN pp USING (point_id)")
def feature_merge(spark, d):
    f = first_features(spark, d).withColumnRenamed("row_id", "feature_row")
    p = first_products(spark, d).withColumnRenamed("row_id", "product_row")
    return relational.merged(f, p, "point_id").select("point_id", "feature_row", "product_row", "images", "gfc_tc00", "esa_lc20", "cusum_magnitude")


@query(f"WITH {_FIRST_F}, s AS (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY extracted_at, series_id) = 1) SELECT point_id, row_id, ff.images, series_id FROM ff JOIN s USING (point_id)")
def branch_merge(spark, d):
    s = relational.keep_first(table(spark, d, "series").select("point_id", "series_id", "images", "dates", "extracted_at"), ["point_id"], ["extracted_at", "series_id"])
    return pipeline.joined_branches(first_features(spark, d), s, "point_id").select("point_id", "row_id", "images", "series_id")


@query("SELECT series_id, array_to_string(list_sort(list_filter(map_keys(ts), lambda b: b NOT IN ('ndfi', 'nir'))), ',') AS others FROM series")
def band_difference(spark, d):
    return table(spark, d, "series").select("series_id", F.array_join(F.array_sort(F.array_except(F.map_keys("ts"), F.array(F.lit("ndfi"), F.lit("nir")))), ",").alias("others"))


@query("SELECT dw_class_mode AS cluster, count(*) AS n FROM products WHERE dw_class_mode IS NOT NULL GROUP BY 1")
def cluster_sizes(spark, d):
    return table(spark, d, "products").where("dw_class_mode is not null").groupBy(F.col("dw_class_mode").alias("cluster")).agg(F.count("*").alias("n"))


@query("SELECT count(change_label) AS labelled, count(*) - count(change_label) AS unlabelled FROM training")
def labelled_split(spark, d):
    with_label, without = ml.split_labelled(table(spark, d, "training"), "change_label")
    return with_label.agg(F.count("*").alias("labelled")).join(F.broadcast(without.agg(F.count("*").alias("unlabelled"))))


@query("SELECT row_id, point_id FROM features WHERE point_id IN (SELECT point_id FROM series WHERE point_id IS NOT NULL)")
def semi_restrict(spark, d):
    return table(spark, d, "features").join(table(spark, d, "series"), "point_id", "left_semi").select("row_id", "point_id")


@query("SELECT DISTINCT point_id FROM points p WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.point_id = p.point_id)")
def anti_missing(spark, d):
    return relational.missing(table(spark, d, "points"), table(spark, d, "obs"), "point_id")


@query("SELECT count(DISTINCT p.point_id) AS universe, count(DISTINCT o.point_id) AS done, count(DISTINCT p.point_id) - count(DISTINCT o.point_id) AS missing FROM points p LEFT JOIN (SELECT DISTINCT point_id FROM obs) o ON o.point_id = p.point_id")
def completeness(spark, d):
    done = table(spark, d, "obs").select("point_id", F.lit(1).alias("done")).distinct()
    u = table(spark, d, "points").select("point_id").distinct().join(done, "point_id", "left")
    return u.agg(F.count("*").alias("universe"), F.count("done").alias("done"), (F.count("*") - F.count("done")).alias("missing"))


@query("SELECT s AS spacing, k AS scale FROM (SELECT unnest([1000, 2000, 5000]) AS s), (SELECT unnest([30, 70, 100]) AS k)")
def cross_params(spark, d):
    s = spark.createDataFrame([(1000,), (2000,), (5000,)], "spacing int")
    return s.crossJoin(spark.createDataFrame([(30,), (70,), (100,)], "scale int"))


@query("""SELECT point_id, min(source_order) AS first_source FROM (
  SELECT point_id, 1 AS source_order FROM features UNION ALL SELECT point_id, 2 FROM products UNION ALL SELECT point_id, 3 FROM points) GROUP BY point_id""")
def union_dedup(spark, d):
    parts = [table(spark, d, t).select("point_id", F.lit(k + 1).alias("first_source")) for k, t in enumerate(("features", "products", "points"))]
    return relational.union_first(parts, ["point_id"], ["first_source"])


@query("SELECT point_id FROM points EXCEPT SELECT point_id FROM products")
def set_difference(spark, d):
    return table(spark, d, "points").select("point_id").distinct().join(table(spark, d, "products"), "point_id", "left_anti")


@query("SELECT point_id, (row_number() OVER (ORDER BY point_id) - 1) // 100 AS page FROM (SELECT DISTINCT point_id FROM points)")
def page_batches(spark, d):
    return relational.pages(table(spark, d, "points").select("point_id").distinct(), ["point_id"], 100).select("point_id", F.col("page").cast("long").alias("page"))


@query("""WITH n AS (SELECT point_id, row_number() OVER (ORDER BY h NULLS FIRST, point_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT point_id, min(hilbertdistance) AS h FROM points GROUP BY point_id))
SELECT point_id FROM n WHERE k >= 1 AND ceil((k - 1 + 1) * (100.0::double / n)) <> ceil((k - 1) * (100.0::double / n))""")
def systematic_subsample(spark, d):
    p = table(spark, d, "points").groupBy("point_id").agg(F.min("hilbertdistance").alias("h"))
    return relational.systematic(p, ["h", "point_id"], 100, 1).select("point_id")


@query("""SELECT point_id, dw_class_mode FROM (SELECT DISTINCT point_id, dw_class_mode FROM products WHERE dw_class_mode IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY dw_class_mode ORDER BY ((point_id % 1073741824 + 7) * 2654435761) % 4294967296, point_id) <= 20""")
def cluster_subsample(spark, d):
    p = table(spark, d, "products").select("point_id", "dw_class_mode").where("dw_class_mode is not null").distinct()
    return relational.sample_per_group(p, "dw_class_mode", "point_id", 20, 7)


_SEGMENTS = f"""{_A1}, y AS (SELECT point_id, CAST(year(date) AS INT) AS e, avg(ndfi) AS m FROM a WHERE ndfi IS NOT NULL GROUP BY ALL),
s AS (SELECT point_id, lag(e) OVER w AS b, e, m - lag(m) OVER w AS c FROM y WINDOW w AS (PARTITION BY point_id ORDER BY e) QUALIFY b IS NOT NULL)"""


def _strongest_sql(size: str, inside: str) -> str:
    best = lambda c: f"coalesce(arg_max({c}, (round({size}, 9), -e)) FILTER (WHERE {inside}), 0)"
    return f"WITH {_SEGMENTS} SELECT point_id, {best('b')} AS first_year, {best('e')} AS last_year, {sr(best('c'), 5)} AS magnitude FROM s GROUP BY point_id"


def _strongest(spark, d, loss: bool) -> DataFrame:
    s = series.strongest_segment(series.year_segments(assembled(spark, d), "ndfi"), 2019, 2021, loss)
    return s.select("point_id", F.col("start").alias("first_year"), F.col("end").alias("last_year"), r("magnitude", 5).alias("magnitude"))


@query(_strongest_sql("abs(c)", "e BETWEEN 2019 AND 2021"))
def max_abs_segment(spark, d):
    return _strongest(spark, d, False)


@query(_strongest_sql("-c", "e BETWEEN 2019 AND 2021 AND c < 0"))
def largest_loss_segment(spark, d):
    return _strongest(spark, d, True)


@query("SELECT point_id, " + ", ".join(f"arg_max({c}, (sampled_at, row_id)) FILTER (WHERE NOT contains(CAST({c} AS VARCHAR), 'nan')) AS {c}" for c in ("gfc_tc00", "elevation")) + " FROM products GROUP BY point_id")
def latest_mosaic(spark, d):
    return raster.latest_valid(table(spark, d, "products"), ["point_id"], ["sampled_at", "row_id"], ["gfc_tc00", "elevation"])


@query("""SELECT chunk_id, dw_class_mode, n FROM (SELECT chunk_id, dw_class_mode, count(*) AS n FROM products WHERE dw_class_mode IS NOT NULL GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, dw_class_mode) = 1""")
def dominant_class(spark, d):
    g = table(spark, d, "products").where("dw_class_mode is not null").groupBy("chunk_id", "dw_class_mode").agg(F.count("*").alias("n"))
    return g.groupBy("chunk_id").agg(F.max_by("dw_class_mode", F.struct("n", -F.col("dw_class_mode"))).alias("dw_class_mode"), F.max("n").alias("n"))


_ZONAL = [f"{b}_{n}" for b in ("ndfi", "nir") for n in ("mean", "min", "max", "sd")]


@query(f"WITH {_OBS} SELECT path_row, " + ", ".join(sr(f"{f}({b})", 4) + f" AS {b}_{n}" for b in ("ndfi", "nir") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("sd", "stddev_pop"))) + " FROM o GROUP BY path_row")
def combined_reducers(spark, d):
    return raster.zonal_stats(obs(spark, d), ["path_row"], ["ndfi", "nir"]).select("path_row", *[r(c, 4).alias(c) for c in _ZONAL])


@query(f"SELECT DISTINCT user_id, CAST(ts AS DATE) AS date, {sr('avg(value) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)', 4)} AS mean FROM events")
def events_trailing7d(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("date"), "value")
    return series.rolling_mean_by_day(e, "value", 7, "user_id").select("user_id", "date", r("mean", 4).alias("mean"))


@query(f"SELECT pathrow, {sr('quantile_cont(abs(ccdc_magnitude), 0.95)')} AS p95, {sr('quantile_cont(abs(ccdc_magnitude), 0.5)')} AS p50 FROM features WHERE NOT contains(CAST(ccdc_magnitude AS VARCHAR), 'nan') GROUP BY pathrow")
def percentile_by_group(spark, d):
    g = relational.percentiles_by_group(table(spark, d, "features"), "pathrow", F.abs(estimation.nan_to_null("ccdc_magnitude")), {"p95": 0.95, "p50": 0.5})
    return g.select("pathrow", r("p95").alias("p95"), r("p50").alias("p50"))


_MAG = subsample.ABSOLUTE
_NUM = "CASE WHEN NOT contains(CAST({c} AS VARCHAR), 'nan') AND {c} > -9000 THEN {c} END AS {c}"


@query(f"""WITH {_FIRST_F}, {_FIRST_P}, j AS (
  SELECT point_id, {', '.join(_NUM.format(c=c) for c in [*_MAG, 'bs_slope_mean', 'gfc_tc00', 'potapov_tree_height'])}, gfc_lossyear, tmf_defyear, tmf_degyear FROM ff JOIN pp USING (point_id)
), q AS (SELECT {', '.join(f'quantile_cont(abs({c}), 0.95) AS q_{c}' for c in _MAG)}, quantile_cont(bs_slope_mean, 0.95) AS q_slope FROM j)
SELECT point_id FROM j, q WHERE
  coalesce(({' OR '.join(f'coalesce(abs({c}) > q_{c}, false)' for c in _MAG)}) AND (coalesce(gfc_tc00 > 10, false) OR coalesce(potapov_tree_height > 5, false)), false)
  OR coalesce(bs_slope_mean > q_slope AND potapov_tree_height > 5, false)
  OR coalesce(gfc_lossyear BETWEEN 15 AND 22, false) OR coalesce(tmf_defyear BETWEEN 2015 AND 2022, false) OR coalesce(tmf_degyear BETWEEN 2015 AND 2022, false)""")
def threshold_filter(spark, d):
    j = first_features(spark, d).drop("row_id", "chunk_id", "pathrow").join(first_products(spark, d), "point_id")
    j = j.withColumns({c: F.when(F.col(c) > -9000, F.col(c)) for c in [*_MAG, "bs_slope_mean", "gfc_tc00", "potapov_tree_height"]})  # the mask
    return subsample.over_thresholds(j).select("point_id")


# --- labels, strata, estimation -------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT row_id, [coalesce(lang_tree_height > 5, false), coalesce(NOT contains(CAST(potapov_tree_height AS VARCHAR), 'nan') AND potapov_tree_height > 5, false), coalesce(NOT contains(CAST(gfc_tc00 AS VARCHAR), 'nan') AND gfc_tc00 > 10, false), coalesce(tmf_main = 10, false), coalesce(dw_tree_prob__min > 50, false), coalesce(esa_lc20 IN (10, 95), false), coalesce(esa_lc21 IN (10, 95), false)] AS votes,
  greatest(coalesce(gfc_lossyear > 15 AND gfc_lossyear < 22, false)::int, coalesce(gfc_gain <> 0, false)::int, coalesce(tmf_defyear > 2015 AND tmf_defyear < 2022, false)::int, coalesce(tmf_degyear > 2015 AND tmf_degyear < 2022, false)::int) AS cnc FROM products)
SELECT row_id, CASE WHEN list_bool_and(votes) THEN 1 WHEN NOT list_bool_or(votes) THEN 0 END AS fnf, cnc FROM v""")
def fnf_cnc_labels(spark, d):
    return labels.product_labels(table(spark, d, "products"), 2015, 2022).select("row_id", "fnf", "cnc")


@query("SELECT row_id, CASE WHEN esa_lc20 IN (10, 20) THEN 1 ELSE 0 END AS fnf, CASE WHEN tmf_main IN (41, 42, 43) THEN 1 ELSE 0 END AS cnc FROM products")
def change_flags(spark, d):
    return table(spark, d, "products").select("row_id", labels.membership(F.col("esa_lc20"), [10, 20]).alias("fnf"), labels.membership(F.col("tmf_main"), [41, 42, 43]).alias("cnc"))


@query(f"WITH g AS (SELECT change_label, count(*) AS n FROM training WHERE change_label IS NOT NULL GROUP BY 1) SELECT change_label, n, {sr('sum(n) OVER () / (count(*) OVER () * n)::double')} AS weight FROM g")
def class_weights(spark, d):
    return labels.class_weights(table(spark, d, "training"), "change_label").select("change_label", "n", r("weight").alias("weight"))


@query(f"""WITH g AS (SELECT esa_lc20 AS s, count(*) AS Nh, avg(elevation) AS mean, stddev_pop(elevation) AS SD FROM products WHERE esa_lc20 IS NOT NULL GROUP BY 1)
SELECT row_number() OVER (ORDER BY mean, s) AS stratum, Nh, {sr('mean', 4)} AS mean, {sr('SD', 4)} AS SD,
  CAST(floor(1000 * (Nh * SD) / sum(Nh * SD) OVER ()) AS BIGINT) AS neyman, CAST(floor(1000 * Nh / (sum(Nh) OVER ())::double) AS BIGINT) AS proportional FROM g""")
def strata_allocation(spark, d):
    a = relational.stratum_allocation(table(spark, d, "products").where("esa_lc20 is not null"), "esa_lc20", "elevation", 1000)
    return a.select(F.col("stratum").cast("long").alias("stratum"), "Nh", r("mean", 4).alias("mean"), r("SD", 4).alias("SD"), "neyman", "proportional")


@query("""WITH g AS (SELECT esa_lc20, max(slope) AS bound FROM products WHERE esa_lc20 IS NOT NULL GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY bound, esa_lc20) AS k, bound, count(*) OVER () AS n FROM g)
SELECT k, bound FROM n WHERE k < n""")
def stratum_bounds(spark, d):
    return relational.stratum_bounds(table(spark, d, "products").where("esa_lc20 is not null"), "esa_lc20", "slope").select(F.col("k").cast("long").alias("k"), "bound")


@query(f"SELECT row_id, {sr('cusum_confidence * 0.8 / (cusum_confidence * 0.8 + (1 - cusum_confidence) * (1 - 0.8::double))')} AS posterior, {sr('pow(cusum_confidence * ((images % 100) / 100.0::double), 0.5)')} AS combined FROM features")
def bayes_combine(spark, d):
    p = F.col("cusum_confidence")
    return table(spark, d, "features").select("row_id", r(estimation.bayes_update(p, F.lit(0.8))).alias("posterior"), r(estimation.combined_probability(p, (F.col("images") % 100) / 100.0)).alias("combined"))


_Z = estimation.z_value(0.95)
_SHARES = "s AS (SELECT avg(CASE WHEN gfc_tc00 BETWEEN 10 AND 100 AND NOT contains(CAST(gfc_tc00 AS VARCHAR), 'nan') THEN 1.0 ELSE 0.0 END) AS forest, avg(CASE WHEN gfc_lossyear > 0 THEN 1.0 ELSE 0.0 END) AS change FROM products)"


def _shares(spark, d):
    p = table(spark, d, "products")
    return p.agg(F.avg(F.when(estimation.nan_to_null("gfc_tc00").between(10, 100), 1.0).otherwise(0.0)).alias("forest"), F.avg(F.when(F.col("gfc_lossyear") > 0, 1.0).otherwise(0.0)).alias("change"))


_AREA_STAGE = pipeline.SampleSize(ProjectConfig("areas", calibration_start="2010-01-01", monitor_start="2015-01-01", monitor_end="2022-12-31"))
_KM2 = "round({x} * 900.0::double / 1e6 + 1e-9, 2)"
_FOREST = "SELECT gfc_lossyear, CASE WHEN gfc_tc00 > 10 AND NOT contains(CAST(gfc_tc00 AS VARCHAR), 'nan') THEN 1 ELSE 0 END AS f FROM products"
_AREAS = f"""areas AS (SELECT {_KM2.format(x='count(*)')} AS total_area, {_KM2.format(x='(sum(f) - sum(CASE WHEN gfc_lossyear BETWEEN 1 AND 14 THEN f ELSE 0 END))')} AS forest_area,
  {_KM2.format(x='sum(CASE WHEN gfc_lossyear BETWEEN 15 AND 22 THEN f ELSE 0 END)')} AS change_area FROM ({_FOREST}))"""
_MARGIN = "{z!r} * sqrt({p} * (1 - {p}) / n) / nullif({p}, 0) * 100"
_SWEEP = f"{_AREAS}, w AS (SELECT n, {_MARGIN.format(z=_Z, p='(forest_area / total_area)')} AS moe_forest, {_MARGIN.format(z=_Z, p='(change_area / total_area)')} AS moe_change, sqrt(total_area / n) AS spacing FROM range(10000, 500000, 10000) t(n), areas)"


def _areas(spark, d):
    return _AREA_STAGE.forest_areas(table(spark, d, "products"))


@query(f"WITH {_AREAS} SELECT * FROM areas")
def forest_areas(spark, d):
    return _areas(spark, d)[0]


@query(f"SELECT 2000 + gfc_lossyear AS year, {_KM2.format(x='count(*)')} AS deforest FROM ({_FOREST}) WHERE gfc_lossyear > 0 AND f = 1 GROUP BY 1")
def loss_area_by_year(spark, d):
    return _areas(spark, d)[1]


@query(f"WITH {_SWEEP} SELECT n, {sr('moe_forest')} AS moe_forest, {sr('moe_change')} AS moe_change, {sr('spacing')} AS spacing FROM w")
def cochran_sweep(spark, d):
    return _AREA_STAGE.sweep(_areas(spark, d)[0]).select(F.col("sample_size").alias("n"), r("moe_forest").alias("moe_forest"), r("moe_change").alias("moe_change"), r("spacing_km").alias("spacing"))


@query(f"WITH {_SWEEP} SELECT n, CAST(floor(spacing * 1000) AS BIGINT) AS spacing_m FROM w WHERE moe_change < 5 ORDER BY n LIMIT 1")
def minimum_sample(spark, d):
    return _AREA_STAGE.minimum_sample_size(_areas(spark, d)[0]).select(F.col("sample_size").alias("n"), F.floor(F.col("spacing_km") * 1000).alias("spacing_m"))


@query(f"WITH {_SHARES} SELECT e, CAST(ceil(pow({_Z!r}, 2) * change * (1 - change) / pow(e * change, 2)) AS BIGINT) AS n FROM s, (SELECT unnest([0.05::double, 0.1::double, 0.2::double]) AS e)")
def cochran_size(spark, d):
    e = spark.createDataFrame([(0.05,), (0.1,), (0.2,)], "e double").crossJoin(_shares(spark, d))
    return e.select("e", estimation.sample_size(F.col("change"), F.col("e")).alias("n"))


@query(f"""WITH c AS (SELECT chunk_id, avg(CASE WHEN gfc_lossyear > 0 THEN 1.0 ELSE 0.0 END) AS x FROM products GROUP BY 1), a AS (SELECT avg(CASE WHEN gfc_lossyear > 0 THEN 1.0 ELSE 0.0 END) AS actual FROM products)
SELECT {sr('avg(abs(x - actual)) * 100')} AS mean_bias, {sr('stddev_pop(abs(x - actual)) * 100')} AS sd_bias, {sr('avg(x)')} AS mean, {sr('stddev_pop(x)')} AS sd, {sr(f'{_Z!r} * stddev_pop(x) / avg(x) * 100', 4)} AS uncertainty FROM c, a""")
def sampling_error_stats(spark, d):
    p = table(spark, d, "products").withColumn("x", F.when(F.col("gfc_lossyear") > 0, 1.0).otherwise(0.0))
    c = p.groupBy("chunk_id").agg(F.avg("x").alias("x")).join(F.broadcast(p.agg(F.avg("x").alias("actual"))))
    gap = F.abs(F.col("x") - F.col("actual"))
    return c.agg(r(F.avg(gap) * 100).alias("mean_bias"), r(F.stddev_pop(gap) * 100).alias("sd_bias"), r(F.avg("x")).alias("mean"), r(F.stddev_pop("x")).alias("sd"), r(_Z * F.stddev_pop("x") / F.avg("x") * 100, 4).alias("uncertainty"))


# --- space ----------------------------------------------------------------------------------------------------------


def places(spark, d):
    p = proximity.point_locations(table(spark, d, "points"))
    return p.select("point_id", r("lon").alias("x"), r("lat").alias("y"))


_P = f"{PLACES}, p AS (SELECT point_id, round(lon + 1e-10, 6) AS x, round(lat + 1e-10, 6) AS y FROM places WHERE lon IS NOT NULL AND lat IS NOT NULL)"
_T = f"""t AS (
  SELECT sample_id, change_label, round(lon - 360 * floor(lon / 360) + 1e-10, 6) AS x, round(lat + 1e-10, 6) AS y
  FROM (SELECT sample_id, change_label, coalesce({_REAL.format(c='lon')}, {LON}) AS lon, coalesce({_REAL.format(c='lat')}, {LAT}) AS lat FROM training) WHERE lon IS NOT NULL AND lat IS NOT NULL
)"""


def training_places(spark, d):
    """Training samples that have a place, at lon, lat or else at their geometry; longitudes in [0, 360)."""
    lon, lat = (F.coalesce(proximity.real(F.col(c)), g(F.col("geometry"))) for c, g in (("lon", proximity.geometry_lon), ("lat", proximity.geometry_lat)))
    t = table(spark, d, "training").select("sample_id", r(F.pmod(lon, F.lit(360.0))).alias("x"), r(lat).alias("y"), "change_label")
    return t.where("x is not null and y is not null")


@query(f"WITH {_P} SELECT CAST(floor(x / 0.25) AS BIGINT) AS cell_x, CAST(floor(y / 0.25) AS BIGINT) AS cell_y, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) < 100")
def chunk_counts(spark, d):
    return raster.cell_counts(places(spark, d), 0.25, 100)


_RASTER = "px AS (SELECT CAST(floor(x / 0.05) AS BIGINT) AS cell_x, CAST(floor(y / 0.05) AS BIGINT) AS cell_y, avg(elevation) AS value FROM p JOIN products USING (point_id) WHERE elevation IS NOT NULL GROUP BY 1, 2)"


def elevation_raster(spark, d):
    p = places(spark, d).join(table(spark, d, "products").select("point_id", "elevation"), "point_id").where("elevation is not null")
    return p.groupBy(raster.cell(F.col("x"), 0.05).alias("cell_x"), raster.cell(F.col("y"), 0.05).alias("cell_y")).agg(F.avg("elevation").alias("value"))


@query(f"WITH {_P}, {_RASTER}, {_T} SELECT sample_id, {sr('value', 4)} AS value FROM (SELECT sample_id, CAST(floor(x / 0.05) AS BIGINT) AS cell_x, CAST(floor(y / 0.05) AS BIGINT) AS cell_y FROM t) t LEFT JOIN px USING (cell_x, cell_y)")
def raster_sample(spark, d):
    return raster.at_points(training_places(spark, d), elevation_raster(spark, d), 0.05).select("sample_id", r("value", 4).alias("value"))


@query(f"""WITH {_P}, {_RASTER}, {_T}
SELECT sample_id, {sr('avg(value)', 4)} AS mean, count(value) AS cells FROM t JOIN px ON cell_x BETWEEN floor((x - 0.06) / 0.05) AND floor((x + 0.06) / 0.05) AND cell_y BETWEEN floor((y - 0.06) / 0.05) AND floor((y + 0.06) / 0.05) GROUP BY sample_id""")
def buffer_mean(spark, d):
    return raster.buffer_mean(training_places(spark, d), elevation_raster(spark, d), 0.05, 0.06, "sample_id").select("sample_id", r("mean", 4).alias("mean"), "cells")


@query(f"WITH {_P}, {_RASTER} SELECT CAST(floor(cell_x / 4.0::double) AS BIGINT) AS cell_x, CAST(floor(cell_y / 4.0::double) AS BIGINT) AS cell_y, CASE WHEN avg(CASE WHEN value > 400 THEN 1.0 ELSE 0.0 END) > 0.5 THEN 1 ELSE 0 END AS value FROM px GROUP BY 1, 2")
def block_mean(spark, d):
    flags = elevation_raster(spark, d).withColumn("value", F.when(F.col("value") > 400, 1.0).otherwise(0.0))
    return raster.block_majority(flags, 4)


@query(f"""WITH RECURSIVE {_P}, c AS (SELECT DISTINCT CAST(floor(x / 0.02) AS BIGINT) AS cx, CAST(floor(y / 0.02) AS BIGINT) AS cy FROM p), walk AS (
  SELECT cx, cy, cx AS rx, cy AS ry FROM c UNION SELECT c.cx, c.cy, w.rx, w.ry FROM walk w JOIN c ON abs(c.cx - w.cx) <= 1 AND abs(c.cy - w.cy) <= 1
), root AS (SELECT cx, cy, min((rx, ry)) AS root FROM walk GROUP BY cx, cy)
SELECT cx AS cell_x, cy AS cell_y, count(*) OVER (PARTITION BY root) AS size FROM root""")
def component_sizes(spark, d):
    p = places(spark, d).select(raster.cell(F.col("x"), 0.02).alias("cell_x"), raster.cell(F.col("y"), 0.02).alias("cell_y"))
    return raster.components(p).select("cell_x", "cell_y", "size")


@query(f"""WITH {_P} SELECT CAST(floor(x / 0.25) AS BIGINT) AS cell_x, CAST(floor(y / 0.25) AS BIGINT) AS cell_y, arg_max(point_id, ((point_id % 1073741824 + 3) * 2654435761) % 4294967296) AS point_id FROM p GROUP BY 1, 2""")
def random_point_per_cell(spark, d):
    p = places(spark, d)
    return p.groupBy(raster.cell(F.col("x"), 0.25).alias("cell_x"), raster.cell(F.col("y"), 0.25).alias("cell_y")).agg(F.max_by("point_id", relational.arithmetic_hash(F.col("point_id"), 3)).alias("point_id"))


@query(f"""WITH {_P}, {_T}, n AS (
  SELECT sample_id, point_id, sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2) AS distance FROM t JOIN p ON abs(t.x - p.x) <= 0.001 AND abs(t.y - p.y) <= 0.001)
, b AS (SELECT * FROM n WHERE distance <= 0.001 QUALIFY round(distance, 12) = min(round(distance, 12)) OVER (PARTITION BY point_id))
SELECT p.point_id, b.sample_id AS near_sample_id FROM p LEFT JOIN b USING (point_id)""")
def nearest_training(spark, d):
    return raster.nearest(places(spark, d), training_places(spark, d), 0.001, "sample_id").select("point_id", "near_sample_id")


@query("SELECT sample_id, round(coalesce(lon, try_cast(regexp_extract(geometry, '\\(\\s*([-0-9.]+)', 1) AS double)), 6) AS lon, round(coalesce(lat, try_cast(regexp_extract(geometry, '\\(\\s*[-0-9.]+\\s+([-0-9.]+)', 1) AS double)), 6) AS lat FROM training")
def training_positions(spark, d):
    t = table(spark, d, "training")
    return t.select("sample_id", F.round(F.coalesce("lon", proximity.geometry_lon(F.col("geometry"))), 6).alias("lon"), F.round(F.coalesce("lat", proximity.geometry_lat(F.col("geometry"))), 6).alias("lat"))


_K0, _E2, _E1 = geometry._K0, geometry.ECCENTRICITY_2, geometry._E
_BX = f"{geometry.SEMI_MAJOR}::double * {_K0!r}::double * radians(x)"
_BY = f"{geometry.SEMI_MAJOR}::double * ({1 - _E2!r}::double * (sin(radians(y)) / (1 - {_E2!r}::double * sin(radians(y)) ** 2) - ln((1 - {_E1!r}::double * sin(radians(y))) / (1 + {_E1!r}::double * sin(radians(y)))) / (2 * {_E1!r}::double))) / (2 * {_K0!r}::double)"


@query(f"WITH {_P} SELECT point_id, round({_BX}, 2) AS bx, round({_BY}, 2) AS by, round(x, 6) AS lon, round(y, 6) AS lat FROM p")
def behrmann_xy(spark, d):
    p = places(spark, d).select("*", geometry.behrmann_x(F.col("x")).alias("bx"), geometry.behrmann_y(F.col("y")).alias("by"))
    return p.select("point_id", F.round("bx", 2).alias("bx"), F.round("by", 2).alias("by"), F.round(geometry.behrmann_lon(F.col("bx")), 6).alias("lon"), F.round(geometry.behrmann_lat(F.col("by")), 6).alias("lat"))


_BOUNDS = "b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM aoi)"


def aoi_bounds(spark, d) -> tuple[float, float, float, float]:
    return tuple(table(spark, d, "aoi").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())


@query(f"WITH {_BOUNDS} SELECT x0, y0, x1, y1, count(*) AS vertices FROM aoi, b GROUP BY ALL")
def bounding_box(spark, d):
    return table(spark, d, "aoi").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("vertices"))


@query(f"""WITH {_BOUNDS}, n AS (SELECT *, CAST(floor((x1 - x0) / 0.5) AS BIGINT) + 1 AS nx, CAST(floor((y1 - y0) / 0.5) AS BIGINT) + 1 AS ny FROM b), g AS (
  SELECT k AS point_id, x0 + (k // ny) * 0.5 + 0.25 AS x, y0 + (k % ny) * 0.5 + 0.25 AS y FROM (SELECT *, unnest(range(0, nx * ny)) AS k FROM n)
), e AS (SELECT a.poly_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM aoi a JOIN aoi b ON a.poly_id = b.poly_id AND a.ring = b.ring AND b.i = a.i + 1), c AS (
  SELECT point_id, x, y, poly_id FROM g JOIN e ON x >= least(x1, x2) AND x < greatest(x1, x2) AND y < y1 + (y2 - y1) / (x2 - x1) * (x - x1) GROUP BY ALL HAVING count(*) % 2 = 1
) SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, min(poly_id) AS poly_id FROM c GROUP BY ALL""")
def square_grid(spark, d):
    g = raster.square_grid(spark, aoi_bounds(spark, d), 0.5)
    return raster.inside(g, table(spark, d, "aoi")).select("point_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "poly_id")


_U = "(((point_id % 1073741824 + {k}) * 2654435761) % 4294967296) / 4294967296.0::double"


@query(f"""WITH {_BOUNDS}, n AS (SELECT *, CAST(floor((x1 - x0) / 0.5) AS BIGINT) + 1 AS nx, CAST(floor((y1 - y0) / 0.5) AS BIGINT) + 1 AS ny FROM b), g AS (
  SELECT point_id, x0 + (point_id // ny) * 0.5 + {_U.format(k=42)} * 0.5 AS x, y0 + (point_id % ny) * 0.5 + {_U.format(k=143)} * 0.5 AS y FROM (SELECT *, unnest(range(0, nx * ny)) AS point_id FROM n)
), e AS (SELECT a.poly_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM aoi a JOIN aoi b ON a.poly_id = b.poly_id AND a.ring = b.ring AND b.i = a.i + 1), c AS (
  SELECT point_id, x, y, poly_id FROM g JOIN e ON x >= least(x1, x2) AND x < greatest(x1, x2) AND y < y1 + (y2 - y1) / (x2 - x1) * (x - x1) GROUP BY ALL HAVING count(*) % 2 = 1
) SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, min(poly_id) AS poly_id FROM c GROUP BY ALL""")
def random_grid(spark, d):
    """One random point in each cell of the square grid, by the cell's hash."""
    g = pipeline.SampleDesign(ProjectConfig("grid", grid_spacing=0.5, grid_strategy="random")).generate_samples(table(spark, d, "aoi"))
    return g.select("point_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "poly_id")


@query(f"""WITH {_BOUNDS}, n AS (SELECT *, greatest(1, CAST(floor((x1 - 0.9 * 2.5 - x0) / 2.5 + 1e-9) AS BIGINT) + 1) AS nx, greatest(1, CAST(floor((y1 - 0.9 * 2.5 - y0) / 2.5 + 1e-9) AS BIGINT) + 1) AS ny FROM b)
SELECT k // ny AS i, k % ny AS j, round(x0 + (k // ny) * 2.5, 6) AS xmin, round(y0 + (k % ny) * 2.5, 6) AS ymin, round(x0 + (k // ny + 1) * 2.5, 6) AS xmax, round(y0 + (k % ny + 1) * 2.5, 6) AS ymax FROM (SELECT *, unnest(range(0, nx * ny)) AS k FROM n)""")
def tile_grid(spark, d):
    t = raster.tiles(spark, aoi_bounds(spark, d), 2.5)
    return t.select("i", "j", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query()
def clip_cells(spark, d):
    return raster.clipped_area(raster.square_grid(spark, aoi_bounds(spark, d), 0.5), table(spark, d, "aoi"), 0.5)


@query()
def random_points(spark, d):
    return raster.random_points(table(spark, d, "aoi"), 20)


@query()
def simulated_error(spark, d):
    p = places(spark, d).join(table(spark, d, "products").groupBy("point_id").agg(F.max((F.col("gfc_lossyear") > 0).cast("double")).alias("value")), "point_id").where("value is not null")
    pixels = p.groupBy(raster.cell(F.col("x"), 0.02).alias("cell_x"), raster.cell(F.col("y"), 0.02).alias("cell_y")).agg(F.max("value").alias("value"))
    return pipeline.SampleSize(ProjectConfig("simulation")).simulated_error(pixels, [2.0, 4.0, 8.0], 10)


_POLE = (1 - _E2) * (1 / (1 - _E2) - math.log((1 - _E1) / (1 + _E1)) / (2 * _E1))
_SIDE = geometry.hex_side(geometry.hex_cell_area_km2(9) * 1e6)
_HW, _HH = math.sqrt(3) * _SIDE, 1.5 * _SIDE


@query(f"""WITH {_BOUNDS}, k AS (SELECT {_BX.replace('radians(x)', 'radians(x0)')} AS bx0, {_BY.replace('radians(y)', 'radians(y0)')} AS by0, {_BX.replace('radians(x)', 'radians(x1)')} AS bx1, {_BY.replace('radians(y)', 'radians(y1)')} AS by1 FROM b),
h AS (SELECT *, unnest(range(CAST(floor(bx0 / {_HW!r} - r / 2.0::double) AS BIGINT), CAST(ceil(bx1 / {_HW!r} - r / 2.0::double) AS BIGINT) + 1)) AS q FROM (SELECT *, unnest(range(CAST(floor(by0 / {_HH!r}) AS BIGINT), CAST(ceil(by1 / {_HH!r}) AS BIGINT) + 1)) AS r FROM k)),
c AS (SELECT q, r, {_HW!r} * (q + r / 2.0::double) AS hx, {_HH!r} * r AS hy FROM h WHERE {_HW!r} * (q + r / 2.0::double) BETWEEN bx0 AND bx1 AND {_HH!r} * r BETWEEN by0 AND by1),
u AS (SELECT q, r, degrees(hx / ({geometry.SEMI_MAJOR}::double * {_K0!r}::double)) AS x, asin(2 * hy * {_K0!r}::double / ({geometry.SEMI_MAJOR}::double * {_POLE!r}::double)) AS w FROM c),
p AS (SELECT q, r, x, degrees(w + {_E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040!r}::double * sin(2 * w) + {23 * _E2**2 / 360 + 251 * _E2**3 / 3780!r}::double * sin(4 * w) + {761 * _E2**3 / 45360!r}::double * sin(6 * w)) AS y FROM u),
e AS (SELECT a.poly_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM aoi a JOIN aoi b ON a.poly_id = b.poly_id AND a.ring = b.ring AND b.i = a.i + 1),
i AS (SELECT q, r, p.x, p.y, poly_id FROM p JOIN e ON p.x >= least(x1, x2) AND p.x < greatest(x1, x2) AND p.y < y1 + (y2 - y1) / (x2 - x1) * (p.x - x1) GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT q, r, round(x, 6) AS x, round(y, 6) AS y, min(poly_id) AS poly_id FROM i GROUP BY ALL""")
def hex_grid(spark, d):
    g = raster.hex_grid(spark, aoi_bounds(spark, d), geometry.hex_cell_area_km2(9))
    g = raster.inside(g.drop("x", "y").withColumnsRenamed({"lon": "x", "lat": "y"}), table(spark, d, "aoi"))
    return g.select("q", "r", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "poly_id")


_HILBERT = f"""{_P}, e AS (SELECT min(x) AS x0, max(x) - min(x) AS dx, min(y) AS y0, max(y) - min(y) AS dy FROM p),
h(point_id, x, y, hx, hy, k, s) AS (
  SELECT point_id, x, y, CAST(least(65535, greatest(0, floor((x - x0) / dx * 65535))) AS BIGINT), CAST(least(65535, greatest(0, floor((y - y0) / dy * 65535))) AS BIGINT), 0::bigint, 32768::bigint FROM p, e
  UNION ALL
  SELECT point_id, x, y, CASE WHEN hy & s = 0 THEN fy ELSE fx END, CASE WHEN hy & s = 0 THEN fx ELSE fy END, k + s * s * xor(CASE WHEN hx & s > 0 THEN 3 ELSE 0 END, CASE WHEN hy & s > 0 THEN 1 ELSE 0 END), s // 2 FROM (
    SELECT *, CASE WHEN hy & s = 0 AND hx & s > 0 THEN s - 1 - (hx & (s - 1)) ELSE hx & (s - 1) END AS fx, CASE WHEN hy & s = 0 AND hx & s > 0 THEN s - 1 - (hy & (s - 1)) ELSE hy & (s - 1) END AS fy FROM h WHERE s > 0)
), hilbert AS (SELECT point_id, x, y, k AS hilbert FROM h WHERE s = 0)"""


def with_hilbert(p: DataFrame) -> DataFrame:
    b = p.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return p.withColumn("hilbert", geometry.hilbert_key(geometry.scaled(F.col("x"), b[0], b[1]), geometry.scaled(F.col("y"), b[2], b[3])))


@query(f"WITH RECURSIVE {_HILBERT} SELECT point_id, x, y, hilbert, row_number() OVER (ORDER BY hilbert, point_id) - 1 AS position FROM hilbert")
def hilbert_order(spark, d):
    return relational.numbered(with_hilbert(places(spark, d)), ["hilbert", "point_id"], "position")


@query(f"""WITH RECURSIVE {_HILBERT}, c AS (SELECT DISTINCT point_id, dw_class_mode AS cluster FROM products WHERE dw_class_mode IS NOT NULL), n AS (
  SELECT cluster, point_id, row_number() OVER (PARTITION BY cluster ORDER BY hilbert, point_id) - 1 AS j, count(*) OVER (PARTITION BY cluster) AS n FROM c JOIN hilbert USING (point_id)
) SELECT cluster, point_id FROM n WHERE n <= 20 OR ceil((j + 1) * (20.0::double / n)) <> ceil(j * (20.0::double / n))""")
def curve_subsample(spark, d):
    c = table(spark, d, "products").where("dw_class_mode is not null").select("point_id", F.col("dw_class_mode").alias("cluster")).distinct()
    stage = pipeline.KMeansSubSampling(ProjectConfig("clusters", points_per_cluster=20))
    p = places(spark, d)
    bounds = p.agg(F.min("x").alias("x"), F.min("y").alias("y")).unionByName(p.agg(F.max("x").alias("x"), F.max("y").alias("y")))
    # the curve runs over all places, so its corners go with the points
    corners = bounds.select(F.lit(None).cast("long").alias("point_id"), F.lit(-1).alias("cluster"), "x", "y")
    found = stage.select_samples(c.join(p, "point_id").unionByName(corners), sampling_type="space_filling_curve")
    return found.where("cluster >= 0").select("cluster", "point_id")


_PRODUCTS = {"elevation": 0.05, "slope": 0.1}


@query(f"WITH {_P}, " + ", ".join(f"px_{n} AS (SELECT CAST(floor(x / {s}) AS BIGINT) AS cx, CAST(floor(y / {s}) AS BIGINT) AS cy, avg({n}) AS {n} FROM p JOIN products USING (point_id) WHERE {n} IS NOT NULL GROUP BY 1, 2)" for n, s in _PRODUCTS.items()) + ", " + _T + " SELECT sample_id, " + ", ".join(sr(n, 4) + f" AS {n}" for n in _PRODUCTS) + " FROM t " + " ".join(f"LEFT JOIN px_{n} ON px_{n}.cx = CAST(floor(t.x / {s}) AS BIGINT) AND px_{n}.cy = CAST(floor(t.y / {s}) AS BIGINT)" for n, s in _PRODUCTS.items()))
def product_samples(spark, d):
    """Every product of a catalogue at every sample, from the products' long form."""
    p = places(spark, d).join(table(spark, d, "products").select("point_id", *_PRODUCTS), "point_id")
    long = [p.where(F.col(n).isNotNull()).groupBy(raster.cell(F.col("x"), s).alias("cell_x"), raster.cell(F.col("y"), s).alias("cell_y")).agg(F.avg(n).alias("value")).withColumn("product", F.lit(n)) for n, s in _PRODUCTS.items()]
    t = raster.sample_products(training_places(spark, d), long[0].unionByName(long[1]), _PRODUCTS, "sample_id")
    return t.select("sample_id", *[r(n, 4).alias(n) for n in _PRODUCTS])


@query()
def area_tiles(spark, d):
    return raster.tiles_over(table(spark, d, "aoi"), 2.5)


@query()
def convex_hulls(spark, d):
    return raster.hull(table(spark, d, "aoi").where("ring = 0"), "poly_id")


# --- columns, json, missing values ----------------------------------------------------------------------------------

_YEARS = [2018, 2019, 2020]


@query(f"WITH {_A1} SELECT point_id, " + ", ".join(sr(f"avg(ndfi) FILTER (WHERE year(date) = {y})", 5) + f" AS tmf_{y}" for y in (2019, 2020)) + " FROM a GROUP BY point_id")
def year_bands(spark, d):
    w = series.yearly_wide(assembled(spark, d), ["ndfi"], 2019, 2022)
    bands = raster.year_bands(w.withColumnsRenamed({f"ndfi_{y}_mean": f"Dec{y}" for y in range(2019, 2022)}), "Dec", _YEARS, "tmf", ["point_id"])
    return bands.select("point_id", *[r(c, 5).alias(c) for c in bands.columns if c != "point_id"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_FILLED = ["cusum_magnitude", "ewma_jrc_magnitude", "ccdc_magnitude"]


@query("WITH c AS (SELECT row_id, " + ", ".join(f"CASE WHEN NOT contains(CAST({c} AS VARCHAR), 'nan') AND abs({c}) <> 'inf'::double THEN {c} END AS {c}" for c in _FILLED) + "), m AS (SELECT row_id, ".replace("), m", " FROM features), m") + ", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in _FILLED) + " FROM c) SELECT row_id, " + ", ".join(sr(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", 4) + f" AS {c}" for c in _FILLED) + " FROM m")
def impute_standardize(spark, d):
    f = ml.standardised(ml.imputed(table(spark, d, "features").select("row_id", *_FILLED), _FILLED), _FILLED)
    return f.select("row_id", *[r(c, 4).alias(c) for c in _FILLED])


@query("SELECT sample_id, CASE WHEN (sample_id % 1073741824 * 2654435761) % 4294967296 < 3006477107 THEN 'train' ELSE 'test' END AS part FROM training WHERE change_label IS NOT NULL")
def train_test_split(spark, d):
    return ml.hash_split(table(spark, d, "training").where("change_label is not null"), "sample_id").select("sample_id", "part")


@query("SELECT least(20, greatest(0, CAST(floor((ndfi_mean + 1) / 2 * 20) AS BIGINT) + 1)) AS bin, count(*) AS n FROM features GROUP BY 1")
def histogram_bins(spark, d):
    b = F.least(F.lit(20), F.greatest(F.lit(0), F.floor((F.col("ndfi_mean") + 1) / 2 * 20) + 1))
    return table(spark, d, "features").groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT point_id, chunk_id AS batch, row_number() OVER (PARTITION BY chunk_id ORDER BY row_id) AS k FROM features WHERE chunk_id NOT IN (1, 2) QUALIFY row_number() OVER (PARTITION BY chunk_id, point_id ORDER BY row_id) = 1")
def batch_scan(spark, d):
    from pyspark.sql.window import Window

    f = table(spark, d, "features").where(~F.col("chunk_id").isin(1, 2)).withColumn("k", F.row_number().over(Window.partitionBy("chunk_id").orderBy("row_id")))
    return relational.keep_first(f, ["chunk_id", "point_id"], ["row_id"]).select("point_id", F.col("chunk_id").alias("batch"), F.col("k").cast("long").alias("k"))


_STATS = [(b, n) for b in ["green", "red", "nir", "swir1", "swir2", "ndfi"] for n in ("mean", "sd", "min", "max")]
_STAT_SQL = {"mean": "avg", "sd": "stddev_pop", "min": "min", "max": "max"}


@query(f"""WITH {_A1}, z AS (SELECT *, avg(ndfi) OVER w AS m, stddev_pop(ndfi) OVER w AS sd FROM a WINDOW w AS (PARTITION BY point_id)),
o2 AS (SELECT * FROM z WHERE (sd = 0 OR abs(ndfi - m) <= 3 * sd) AND {' AND '.join(f'{b} IS NOT NULL' for b in _B)}),
s AS (SELECT point_id, date, {', '.join(f'avg({b}) OVER w AS {b}' for b in _B)} FROM o2 WINDOW w AS (PARTITION BY point_id ORDER BY date RANGE BETWEEN INTERVAL 59 DAYS PRECEDING AND CURRENT ROW)),
i AS (SELECT *, year(date) + round(dayofyear(date) / 365.0, 3) BETWEEN 2020 AND 2023 AS mon FROM s WHERE date > DATE '2015-01-01' AND date < DATE '2023-01-01')
SELECT point_id, count(*)::int AS images, (count(*) FILTER (WHERE mon))::int AS mon_images, {', '.join(sr(f'coalesce({_STAT_SQL[n]}({b}) FILTER (WHERE mon), -1)', 5) + f' AS {b}_{n}' for b, n in _STATS)} FROM i GROUP BY point_id""")
def augment_statistics(spark, d):
    """The stage with its one deterministic kernel: outliers out, smoothing, the interval, statistics of every band."""
    c = ProjectConfig("augment", monitor_start="2020-01-01", monitor_end="2023-01-01")
    out = pipeline.DatasetAugmentation(c).augment(assembled(spark, d), enabled=("timescan",))
    return out.select("point_id", "images", "mon_images", *[r(f"{b}_{n}", 5).alias(f"{b}_{n}") for b, n in _STATS])


@query()
def augment_features(spark, d):
    """The whole stage: outliers out, smoothing, the interval, all kernels, products joined."""
    c = ProjectConfig("augment", monitor_start="2020-01-01", monitor_end="2023-01-01")
    return pipeline.DatasetAugmentation(c).augment(assembled(spark, d), first_products(spark, d).withColumn("images", F.lit(0)))


# --- kernels and models (no SQL: random or iterative) ---------------------------------------------------------------

_KERNELS = change.ChangeConfig()


def _kernel(name: str):
    def f(spark, d):
        return change.features(spread_table(spark, d, "series", "series_id"), change.ChangeConfig(enabled=(name,)))

    return f


for _name, _q in (("cusum", "cusum_confidence"), ("slope", "bootstrap_slope"), ("bfast", "bfast_monitor"), ("nrt", "nrt_charts"), ("ccdc", "ccdc"), ("landtrendr", "landtrendr")):
    QUERIES[_q] = _kernel(_name)



@query(f"""WITH z AS (SELECT series_id, unnest(dates) AS d, unnest(ts['ndfi']) AS v FROM series), u AS (
  SELECT series_id, v, year(d) + round(dayofyear(d) / 365.0, 3) BETWEEN 2020 AND 2023 AS monitored FROM z WHERE year(d) BETWEEN 2015 AND 2022 AND v IS NOT NULL AND NOT contains(CAST(v AS VARCHAR), 'nan') AND v <> -9999
), g AS (
  SELECT series_id, count(*) AS images, count(*) FILTER (WHERE monitored) AS mon_images, avg(v) FILTER (WHERE monitored) AS m, stddev_pop(v) FILTER (WHERE monitored) AS s, min(v) FILTER (WHERE monitored) AS lo, max(v) FILTER (WHERE monitored) AS hi FROM u GROUP BY series_id
) SELECT s.series_id, coalesce(g.images, 0)::int AS images, coalesce(g.mon_images, 0)::int AS mon_images, {sr('coalesce(m, -1)', 5)} AS ts_mean, {sr('coalesce(s, -1)', 5)} AS ts_sd, coalesce(lo, -1) AS ts_min, coalesce(hi, -1) AS ts_max FROM series s LEFT JOIN g USING (series_id)""".replace("coalesce(s, -1)", "coalesce(g.s, -1)"))
def kernel_timescan(spark, d):
    k = change.features(spread_table(spark, d, "series", "series_id"), change.ChangeConfig(enabled=("timescan",)))
    return k.select("series_id", "images", "mon_images", r("ndfi_mean", 5).alias("ts_mean"), r("ndfi_sd", 5).alias("ts_sd"), F.col("ndfi_min").alias("ts_min"), F.col("ndfi_max").alias("ts_max"))


PREDICTORS = ["images", "ndfi_mean", "ndfi_sd", "ndfi_min", "ndfi_max", "bfast_magnitude", "cusum_confidence", "cusum_magnitude", "bs_slope_mean", "ccdc_magnitude", "gfc_tc00", "elevation", "slope"]
#: Counts of the reference: trees of the forest, shuffles of a predictor, share of isolated training rows.
TREES, REPEATS, OUTLIER_SHARE = 1500, 25, 0.1


def _predictors(spark, d):
    f = first_features(spark, d).drop("row_id", "chunk_id", "pathrow").join(first_products(spark, d).drop("row_id", "chunk_id", "pathrow"), "point_id")
    return f.select("point_id", *[F.when(F.abs(c) <= 9000, F.col(c)).alias(c) if c in ("bfast_magnitude", "gfc_tc00") else F.col(c) for c in PREDICTORS])


def _labelled(spark, d):
    """Points with their predictors and as label that of the nearest sample within 0.001 degrees; a point at which several
    samples are equally near comes once per sample."""
    at = proximity.point_locations(table(spark, d, "points")).withColumnsRenamed({"lon": "x", "lat": "y"})
    stage = pipeline.EnsembleClassification(ProjectConfig("classification"))
    t = stage.training_table(_predictors(spark, d).join(at, "point_id", "left"), training_places(spark, d), "change_label")
    return cut_lineage(t.select("point_id", F.col("change_label").alias("label"), *PREDICTORS))


@query()
def rf_probability(spark, d):
    p = ml.change_probability(_labelled(spark, d), PREDICTORS, "label", trees=TREES, outlier_share=OUTLIER_SHARE)[0].dropDuplicates(["point_id"])
    return p.select("point_id", F.round("chg_probability", 6).alias("chg_probability"))


@query()
def forest_search(spark, d):
    """Five random draws of the forest's parameters in five folds, then the best one's probabilities."""
    p = ml.change_probability(_labelled(spark, d), PREDICTORS, "label", search=5)[0].dropDuplicates(["point_id"])
    return p.select("point_id", F.round("chg_probability", 6).alias("chg_probability"))


@query()
def perceptron_probability(spark, d):
    p = ml.change_probability(_labelled(spark, d), PREDICTORS, "label", neural=True)[0].dropDuplicates(["point_id"])
    return p.select("point_id", F.round("chg_probability", 6).alias("chg_probability"))


@query()
def kmeans_clusters(spark, d):
    return ml.kmeans(first_features(spark, d).select("point_id", "ndfi_mean", "cusum_magnitude", "bs_slope_mean"), ["ndfi_mean", "cusum_magnitude", "bs_slope_mean"], 5).select("point_id", "cluster")


@query()
def kmeans_embeddings(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return KMeans(k=10, seed=42).fit(v).transform(v).select("vec_id", F.col("prediction").alias("cluster"))


@query()
def kmeans_stratifier(spark, d):
    return ml.kmeans_strata(first_features(spark, d).select("cusum_confidence"), "cusum_confidence", 4, 1000)


@query()
def isolation_reject(spark, d):
    return ml.without_outliers(_predictors(spark, d), PREDICTORS, OUTLIER_SHARE).select("point_id")


@query()
def permutation_importance(spark, d):
    df = _labelled(spark, d)
    _, model = ml.change_probability(df, PREDICTORS, "label", trees=TREES, outlier_share=OUTLIER_SHARE)
    rows = ml.training_rows(df, PREDICTORS, "label", OUTLIER_SHARE)
    return ml.permutation_importance(model, rows.select("point_id", "label", *PREDICTORS), PREDICTORS, "label", REPEATS)
