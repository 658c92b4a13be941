"""The queries of the general problems (filling, spikes, proximity, regular grids) and the SQL to hold them against."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators import fill, measured, proximity, regular_grid, spikes
from terravane.session import spread_table, table

PAIR_METRES = 250.0
PRODUCT_FIELDS = ["gfc_tc00", "potapov_tree_height", "dw_tree_prob_mean"]
PRODUCT_COLUMNS = ["row_id", "point_id", "chunk_id", "pathrow", "esa_lc21", "tmf_main", *PRODUCT_FIELDS]


def _sets(*columns: str) -> list[tuple[str, ...]]:
    """All sets of one to three of the columns, as candidates of a dependency."""
    return [c for n in (1, 2, 3) for c in combinations(columns, n)]


#: The candidates of a dependency and the groups of the fallback, narrowest first, by table.
FILLING = {
    "products": ([("point_id",), *_sets("chunk_id", "pathrow", "esa_lc21", "tmf_main")], [("chunk_id", "esa_lc21"), ("pathrow", "esa_lc21"), ("esa_lc21",), ("chunk_id",)]),
    "features": ([("point_id",), *_sets("chunk_id", "pathrow")], [("chunk_id",), ("pathrow",)]),
}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells of p1_filled whose value is not measured, be they filled or not."""
    return p1_filled(spark, d).where(~F.col("value_from").eqNullSafe("measured")).select("row_id", "field_name")


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    """Each row of products and features with its field filled: one row per row and field."""
    products = measured.measured_products(table(spark, d, "products"), PRODUCT_COLUMNS)
    products = fill.fill_from_similar(products, PRODUCT_FIELDS, *FILLING["products"])
    features = measured.measured_features(table(spark, d, "features"), ["row_id", "point_id", "pathrow", "bfast_magnitude"])
    features = fill.fill_from_similar(features, ["bfast_magnitude"], *FILLING["features"])
    long = lambda df, name, fields: df.select("row_id", "point_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"), F.col(f"{f}_filled").alias("filled"), F.col(f"{f}_from").alias("value_from")) for f in fields]))).withColumn("table_name", F.lit(name))
    return long(products, "products", PRODUCT_FIELDS).unionByName(long(features, "features", ["bfast_magnitude"]))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_readings(spread_table(spark, d, "series", "series_id")).select("series_id", "band", "idx")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.pairs_within(proximity.point_locations(table(spark, d, "points")), PAIR_METRES)


def p6_region(spark: SparkSession, d: str) -> DataFrame:
    return proximity.containing_region(proximity.point_locations(table(spark, d, "points")), table(spark, d, "aoi"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The months of p7_grid that hold no reading and are filled."""
    return p7_grid(spark, d).where("status = 'filled'").select("series_id", F.col("month").alias("gap_month"))


def p7_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = regular_grid.monthly_grid(regular_grid.nested_readings(table(spark, d, "series"), "ndfi"))
    return grid.select(F.col("source").alias("series_id"), "month", F.round(F.col("value") + 1e-9, 6).alias("value"), F.col("n_readings").cast("long").alias("n_readings"), "status")


QUERIES = {"p1_found": p1_found, "p1_filled": p1_filled, "p5_found": p5_found, "p6_found": p6_found, "p6_region": p6_region, "p7_found": p7_found, "p7_grid": p7_grid}

NUMBER = "([-+]?[0-9]*[.]?[0-9]+(?:[eE][-+]?[0-9]+)?)"
LON = f"try_cast(nullif(regexp_extract(geometry, '(?i)point[^-+0-9.]*{NUMBER}\\s+{NUMBER}', 1), '') AS double)"
LAT = f"try_cast(nullif(regexp_extract(geometry, '(?i)point[^-+0-9.]*{NUMBER}\\s+{NUMBER}', 2), '') AS double)"
PLACES = f"""
places AS (
  SELECT point_id, min(coalesce(glon, CASE WHEN NOT contains(CAST(x AS VARCHAR), 'nan') THEN x - 360 * floor(x / 360) END)) AS lon, min(coalesce(glat, CASE WHEN NOT contains(CAST(y AS VARCHAR), 'nan') THEN y END)) AS lat
  FROM (SELECT point_id, x, y, {LON} - 360 * floor({LON} / 360) AS glon, {LAT} AS glat, max({LON}) OVER (PARTITION BY point_id) AS any_g FROM points)
  WHERE any_g IS NULL OR glon IS NOT NULL
  GROUP BY point_id
)"""
MEASURED = """
mp AS (
  SELECT row_id, point_id, chunk_id, pathrow, esa_lc21, tmf_main, f, CASE WHEN coalesce(esa_lc20, 1) <> 0 AND coalesce(esa_lc21, 1) <> 0 AND NOT contains(CAST(v AS VARCHAR), 'nan') AND v >= 0 AND v <= top THEN v END AS v
  FROM (SELECT row_id, point_id, chunk_id, pathrow, esa_lc20, esa_lc21, tmf_main, unnest(['gfc_tc00', 'potapov_tree_height', 'dw_tree_prob_mean']) AS f, unnest([gfc_tc00, potapov_tree_height, dw_tree_prob_mean]) AS v, unnest([100, 60, 100]) AS top FROM products)
), mf AS (
  SELECT row_id, point_id, chunk_id, pathrow, NULL::int AS esa_lc21, NULL::int AS tmf_main, 'bfast_magnitude' AS f, CASE WHEN coalesce(bfast_change_date, 0) <> -2 AND NOT contains(CAST(bfast_magnitude AS VARCHAR), 'nan') AND bfast_magnitude BETWEEN -1 AND 1 THEN bfast_magnitude END AS v FROM features
), m AS (
  SELECT *, count(v) OVER w AS n, min(v) OVER w AS lo, max(v) OVER w AS hi
  FROM (SELECT 'products' AS t, * FROM mp UNION ALL SELECT 'features', * FROM mf) WINDOW w AS (PARTITION BY t, f, chunk_id)
)"""
_NDFI = """
r AS (
  SELECT series_id, year(d) * 12 + month(d) - 1 AS m, v
  FROM (SELECT series_id, unnest(dates) AS d, unnest(ts['ndfi']) AS v FROM series)
  WHERE year(d) BETWEEN 2015 AND 2022 AND v IS NOT NULL AND NOT contains(CAST(v AS VARCHAR), 'nan') AND v <> -9999
), o AS (
  SELECT series_id, m, avg(v) AS v, count(*) AS n, lead(m) OVER (PARTITION BY series_id ORDER BY m) AS m2, lead(avg(v)) OVER (PARTITION BY series_id ORDER BY m) AS v2
  FROM r GROUP BY series_id, m
), g AS (
  SELECT series_id, unnest(generate_series(m::bigint, coalesce(m2 - 1, m)::bigint)) AS k, m, v, n, m2, v2 FROM o
)"""



def _filled_sql() -> str:
    """Mining, dictionaries and medians in SQL, over keys written as texts."""
    key = lambda s: "concat_ws('|', " + ", ".join(s) + ")" if s else "''"
    there = lambda s: " AND ".join(f"{c} IS NOT NULL" for c in s) or "true"
    dicts, groups, probes = [], [], []
    for t, (candidates, fallback) in FILLING.items():
        for i, s in enumerate(candidates):
            order = sorted(candidates).index(s)
            dicts.append(f"SELECT t, f, {i} AS c, {len(s)} AS width, {order} AS o, {key(s)} AS k, count(v) AS n, min(v) AS lo, max(v) AS hi FROM b WHERE t = '{t}' AND {there(s)} GROUP BY ALL")
            probes.append(f"SELECT row_id, t, f, 'same:{'+'.join(s)}' AS origin, {i} AS c, {key(s)} AS k FROM b WHERE v IS NULL AND t = '{t}' AND {there(s)}")
        for i, s in enumerate([*fallback, ()]):
            name = f"group:{'+'.join(s)}" if s else "all"
            groups.append(f"SELECT t, f, {100 + i} AS c, {key(s)} AS k, round(quantile_cont(round(v / 0.001) * 0.001, 0.5), 6) AS x FROM b WHERE t = '{t}' AND {there(s)} GROUP BY ALL HAVING count(v) >= {fill.GROUP_ROWS if s else 1}")
            probes.append(f"SELECT row_id, t, f, '{name}' AS origin, {100 + i} AS c, {key(s)} AS k FROM b WHERE v IS NULL AND t = '{t}' AND {there(s)}")
    union = " UNION ALL ".join
    return f"""WITH {MEASURED}, b AS (
  SELECT t, row_id, point_id, chunk_id, pathrow, esa_lc21, tmf_main, f, CASE WHEN chunk_id IS NOT NULL AND n >= 20 AND lo = hi AND hi <> 0 THEN NULL ELSE v END AS v FROM m
), d AS ({union(dicts)}), dep AS (
  SELECT t, f, c, row_number() OVER (PARTITION BY t, f ORDER BY ok / total DESC, total DESC, width, o) AS place FROM (
    SELECT t, f, c, width, o, sum(n) FILTER (WHERE n > 1) AS total, coalesce(sum(n) FILTER (WHERE n > 1 AND hi - lo <= 0), 0) AS ok FROM d GROUP BY ALL
  ) WHERE total >= {fill.SUPPORT} AND ok >= {fill.CONFIDENCE} * total
), known AS (
  SELECT d.t, d.f, d.c, d.k, lo AS x, place FROM d JOIN dep USING (t, f, c) WHERE n > 0 AND hi - lo <= 0
  UNION ALL SELECT t, f, c, k, x, 1000 + c FROM ({union(groups)})
), filled AS (
  SELECT p.t, p.row_id, p.f, arg_min(x, place) AS x, arg_min(origin, place) AS origin FROM ({union(probes)}) p JOIN known USING (t, f, c, k) WHERE x IS NOT NULL GROUP BY ALL
) SELECT b.row_id, b.point_id, b.f AS field_name, coalesce(b.v, x) AS value, b.v IS NULL AND x IS NOT NULL AS filled, CASE WHEN b.v IS NOT NULL THEN 'measured' ELSE origin END AS value_from, b.t AS table_name
FROM b LEFT JOIN filled USING (t, row_id, f)"""


ORACLE = {
    "p1_filled": _filled_sql(),
    "p1_found": f"WITH {MEASURED} SELECT row_id, f AS field_name FROM m WHERE v IS NULL OR (chunk_id IS NOT NULL AND n >= 20 AND lo = hi AND hi <> 0)",
    "p6_found": f"""WITH {PLACES}, u AS (
  SELECT point_id, cos(radians(lat)) * cos(radians(lon)) AS ux, cos(radians(lat)) * sin(radians(lon)) AS uy, sin(radians(lat)) AS uz FROM places WHERE lon IS NOT NULL AND lat IS NOT NULL
) SELECT a.point_id AS point_id_a, b.point_id AS point_id_b FROM u a JOIN u b ON a.point_id < b.point_id
  AND abs(a.ux - b.ux) < 0.0001 AND abs(a.uy - b.uy) < 0.0001
WHERE 2 * 6371008.8 * asin(sqrt((a.ux - b.ux) ** 2 + (a.uy - b.uy) ** 2 + (a.uz - b.uz) ** 2) / 2) <= 250""",
    "p6_region": f"""WITH {PLACES}, e AS (
  SELECT a.poly_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM aoi a JOIN aoi b ON a.poly_id = b.poly_id AND a.ring = b.ring AND b.i = a.i + 1
), w AS (SELECT min(x) AS west FROM aoi), p AS (
  SELECT point_id, lon - west - 360 * floor((lon - west) / 360) + west AS px, lat AS py FROM places, w
), c AS (
  SELECT point_id, poly_id FROM p JOIN e ON px >= least(x1, x2) AND px < greatest(x1, x2) AND py < y1 + (y2 - y1) / (x2 - x1) * (px - x1)
  GROUP BY point_id, poly_id HAVING count(*) % 2 = 1
) SELECT point_id, min(poly_id) AS poly_id FROM c GROUP BY point_id""",
    "p7_found": f"WITH {_NDFI} SELECT series_id, printf('%04d-%02d', k // 12, k % 12 + 1) AS gap_month FROM g WHERE k <> m",
    "p7_grid": f"""WITH {_NDFI} SELECT series_id, printf('%04d-%02d', k // 12, k % 12 + 1) AS month,
  round(CASE WHEN k = m THEN v ELSE v + (v2 - v) * (k - m) / (m2 - m) END + 1e-9, 6) AS value,
  CASE WHEN k = m THEN n ELSE 0 END AS n_readings, CASE WHEN k = m THEN 'observed' ELSE 'filled' END AS status FROM g""",
}
