"""Irregular readings onto a regular monthly grid.

Every source's time line is cut into shards of ``shard_months`` months. One shuffle brings the readings,
already summed on the map side, to (source, shard); a shard then knows its first and last reading, and a prefix
scan over the shards' summaries hands each one the last reading before it. After that the shards are filled
independently of each other. The scan sees one row per source and year, however many readings there are; the readings
of a source, however many, are summed on the map side and by shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_MONTHS = 12


def usable(value: Column, masked: float = -9999.0) -> Column:
    """True for a value that is neither null, NaN nor the mask."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (value != masked), F.lit(False))


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def month_text(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))


def nested_readings(series: DataFrame, band: str, source: str = "series_id", first_year: int = 2015, last_year: int = 2022) -> DataFrame:
    """(source, date, value) of the usable readings of one band of nested series.

    Entry k of ``ts[band]`` belongs to entry k of ``dates``; a null array, a null date and a date outside the
    years given no readings. A band that the map lacks gives none either.
    """
    pair = F.explode(F.arrays_zip(F.col("dates").alias("d"), F.col("ts")[band].alias("v")))
    r = series.select(F.col(source).alias("source"), pair.alias("p")).select("source", F.col("p.d").alias("date"), F.col("p.v").alias("value"))
    return r.where(usable(F.col("value")) & F.year("date").between(first_year, last_year))


def shard_summaries(readings: DataFrame, shard_months: int = SHARD_MONTHS) -> DataFrame:
    """One row per source and shard: its months' sums and counts, its first and last month, and the last month of
    the shard before it (null for a source's first)."""
    m = month_index(F.col("date"))
    r = readings.select("source", m.alias("m"), "value").withColumn("shard", F.floor(F.col("m") / shard_months).cast("int"))
    k = F.col("m") % shard_months
    sums = [F.sum(F.when(k == i, F.col("value"))).alias(f"s{i}") for i in range(shard_months)]
    counts = [F.count(F.when(k == i, F.lit(1))).alias(f"c{i}") for i in range(shard_months)]
    g = r.groupBy("source", "shard").agg(*sums, *counts)
    months = F.array(*[F.when(F.col(f"c{i}") > 0, F.struct((F.col("shard") * shard_months + i).alias("m"), (F.col(f"s{i}") / F.col(f"c{i}")).alias("v"), F.col(f"c{i}").alias("n"))) for i in range(shard_months)])
    g = g.select("source", "shard", F.array_compact(months).alias("own"))
    w = Window.partitionBy("source").orderBy("shard")
    return g.withColumn("before", F.lag(F.element_at("own", -1)).over(w))


def monthly_grid(readings: DataFrame, shard_months: int = SHARD_MONTHS) -> DataFrame:
    """``source, month, value, n_readings, status`` for each calendar month from a source's first to its last reading.

    ``readings`` has ``source, date, value`` with usable values only. A month with readings holds their mean and is
    'observed'; one without is 'filled' by a line between the nearest months on either side, with n_readings 0.
    Repeated rows count as often as they stand; a null source is a source of its own; an empty table gives an empty
    grid. Values are rounded to 12 places, so that the order in which sums run does not show.
    """
    s = shard_summaries(readings, shard_months)
    first = F.coalesce(F.col("before.m") + 1, F.element_at("own", 1)["m"])
    known = F.concat(F.array_compact(F.array("before")), F.col("own"))
    grid = s.select("source", known.alias("known"), F.explode(F.sequence(first, F.element_at("own", -1)["m"])).alias("m"))
    left = F.element_at(F.filter("known", lambda x: x["m"] <= F.col("m")), -1)
    right = F.element_at(F.filter("known", lambda x: x["m"] >= F.col("m")), 1)
    grid = grid.select("source", "m", left.alias("l"), right.alias("r"))
    line = F.col("l.v") + (F.col("r.v") - F.col("l.v")) * (F.col("m") - F.col("l.m")) / (F.col("r.m") - F.col("l.m"))
    seen = F.col("l.m") == F.col("m")
    return grid.select(
        "source",
        month_text(F.col("m")).alias("month"),
        F.round(F.when(seen, F.col("l.v")).otherwise(line), 12).alias("value"),
        F.when(seen, F.col("l.n")).otherwise(F.lit(0)).alias("n_readings"),
        F.when(seen, F.lit("observed")).otherwise(F.lit("filled")).alias("status"),
    )
