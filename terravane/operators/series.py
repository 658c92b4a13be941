"""Series algebra over long observations (point, date, bands) and nested series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BANDS = ["green", "red", "nir", "swir1", "swir2", "ndfi"]
MASKED = -9999.0


def clean(c: Column) -> Column:
    """c, with NaN and the mask as null."""
    return F.when(~F.isnan(c) & (c != MASKED), c)


def observations(raw: DataFrame, bands: list[str] = BANDS) -> DataFrame:
    """Raw readings with ``date`` and ``path_row`` from the image id (sensor_pathrow_yyyymmdd) and clean bands.

    A row whose first band is masked is dropped, and only the first band decides; other bands' masks become null."""
    parts = F.split("imageid", "_")
    r = raw.where(F.col(bands[0]).isNull() | (F.col(bands[0]) != MASKED))
    date = F.to_date(F.try_element_at(parts, F.lit(-1)), "yyyyMMdd")
    return r.select("point_id", "imageid", date.alias("date"), F.try_element_at(parts, F.lit(-2)).alias("path_row"), *[clean(F.col(b)).alias(b) for b in bands], "x", "y", "ingested_at")


def with_default(df: DataFrame, columns: list[str], default: float = MASKED) -> DataFrame:
    """df with the default in place of each null and NaN of the columns."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(default)) for c in columns})


def assemble(obs: DataFrame, bands: list[str] = BANDS) -> DataFrame:
    """One reading per point and date, of the point's path/row with most images.

    Most images: counted after repeated dates of a path/row count once; ties go to the smaller path/row. Of several
    readings of one date the first by (ingested_at, imageid, bands) stays. Repeats are reduced per (point, path/row,
    date) on the map side; both windows then share one exchange on the point, with one row a day and path/row.
    """
    first = F.min(F.struct("ingested_at", "imageid", *bands)).alias("r")
    daily = obs.where("point_id is not null and date is not null").groupBy("point_id", "path_row", "date").agg(first).repartition("point_id")
    n = F.count("*").over(Window.partitionBy("point_id", "path_row"))
    best = F.min(F.struct(-F.col("_n"), F.col("path_row"))).over(Window.partitionBy("point_id"))
    kept = daily.withColumn("_n", n).withColumn("_b", best).where(F.col("path_row").eqNullSafe(F.col("_b.path_row")))
    return kept.select("point_id", "path_row", "date", *[F.col(f"r.{b}").alias(b) for b in bands])


def nested(obs: DataFrame, bands: list[str] = BANDS) -> DataFrame:
    """``point_id, dates, ts, images``: the nested form of assembled readings, in order of dates."""
    g = obs.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("date", *bands))).alias("o"))
    ts = F.map_from_arrays(F.array(*map(F.lit, bands)), F.array(*[F.col(f"o.{b}") for b in bands]))
    return g.select("point_id", F.col("o.date").alias("dates"), ts.alias("ts"), F.size("o").alias("images"))


def open_interval(obs: DataFrame, start: str, end: str) -> DataFrame:
    """Readings strictly between two dates."""
    return obs.where((F.col("date") > F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))


def open_interval_nested(series: DataFrame, start: str, end: str, bands: list[str]) -> DataFrame:
    """Nested series cut to the open interval and the named bands, with ``images`` counted anew."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    kept = F.filter(F.arrays_zip(F.col("dates").alias("d"), *[F.col("ts")[x].alias(x) for x in bands]), lambda r: (r["d"] > a) & (r["d"] < b))
    s = series.withColumn("_k", kept)
    ts = F.map_from_arrays(F.array(*map(F.lit, bands)), F.array(*[F.col(f"_k.{x}") for x in bands]))
    return s.withColumns({"dates": F.col("_k.d"), "ts": ts, "images": F.size("_k")}).drop("_k")


def rolling_mean(obs: DataFrame, bands: list[str], days: int = 60, key: str = "point_id") -> DataFrame:
    """Each band as its mean over the ``days`` days up to and including the reading's own."""
    w = Window.partitionBy(key).orderBy(F.unix_date("date")).rangeBetween(-(days - 1), 0)
    return obs.withColumns({b: F.avg(b).over(w) for b in bands})


def rolling_mean_by_day(events: DataFrame, value: str, days: int, key: str) -> DataFrame:
    """``key, date, mean``: mean over all values of the ``days`` days up to and including each date that has any.

    Values are first added up by day, on the map side, so that the window sees one row a day, however many values a
    key has."""
    day = events.groupBy(key, "date").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = Window.partitionBy(key).orderBy(F.unix_date("date")).rangeBetween(-(days - 1), 0)
    return day.select(key, "date", F.try_divide(F.sum("_s").over(w), F.sum("_n").over(w)).alias("mean"))


def drop_outliers(obs: DataFrame, bands: list[str], by: str, z: float = 3.0, key: str = "point_id") -> DataFrame:
    """Readings within z deviations of their series' mean in one band, and with no band missing. A constant series stays."""
    w = Window.partitionBy(key)
    mean, sd = F.avg(by).over(w), F.stddev_pop(by).over(w)
    return obs.withColumns({"_m": mean, "_s": sd}).where((F.col("_s") == 0) | (F.abs(F.col(by) - F.col("_m")) <= z * F.col("_s"))).drop("_m", "_s").dropna(subset=bands)


def timescan(obs: DataFrame, universe: DataFrame, bands: list[str], key: str = "point_id", z: float | None = None) -> DataFrame:
    """``<band>_mean/_sd/_min/_max`` for each key of the universe; -1 throughout for a series without a reading. With ``z``
    a band's readings beyond so many deviations of its mean are passed over."""
    if z is not None:
        w = Window.partitionBy(key)
        far = lambda b: F.abs(F.col(b) - F.avg(b).over(w)) > z * F.stddev_pop(b).over(w)
        obs = obs.select(key, *[F.when(~far(b), F.col(b)).alias(b) for b in bands])
    stats = [f(b).alias(f"{b}_{n}") for b in bands for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("min", F.min), ("max", F.max))]
    g = obs.groupBy(key).agg(*stats)
    return universe.select(key).distinct().join(g, key, "left").select(key, *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in g.columns if c != key])


def yearly(obs: DataFrame, band: str, first_year: int, key: str = "point_id") -> DataFrame:
    """Mean and deviation of a band by series and year, from a year on."""
    y = F.year("date")
    return obs.where(y >= first_year).groupBy(key, y.alias("year")).agg(F.avg(band).alias("mean"), F.stddev_pop(band).alias("sd"))


def yearly_wide(obs: DataFrame, bands: list[str], start: int, end: int, key: str = "point_id") -> DataFrame:
    """``<band>_<year>_mean`` and ``_sd`` for the years from start up to but without end: one conditional aggregate."""
    when = lambda b, y: F.when(F.year("date") == y, F.col(b))
    return obs.groupBy(key).agg(*[f(when(b, y)).alias(f"{b}_{y}_{n}") for y in range(start, end) for b in bands for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def year_segments(obs: DataFrame, band: str, key: str = "point_id") -> DataFrame:
    """``<key>, start, end, change``: from each year with readings to the next one that has any, the change of the mean."""
    y = obs.where(F.col(band).isNotNull()).groupBy(key, F.year("date").alias("end")).agg(F.avg(band).alias("_m"))
    w = Window.partitionBy(key).orderBy("end")  # one row a year
    return y.select(key, F.lag("end").over(w).alias("start"), "end", (F.col("_m") - F.lag("_m").over(w)).alias("change")).where("start is not null")


def strongest_segment(segments: DataFrame, start: int, end: int, loss: bool = False, key: str = "point_id") -> DataFrame:
    """``<key>, start, end, magnitude``: of a series' segments (start, end, change) that end within [start, end] the one of
    largest change by size, or with ``loss`` of largest loss; the first of equals. A series without one has 0 throughout."""
    inside = F.col("end").between(start, end) & ((F.col("change") < 0) if loss else F.lit(True))
    size = F.round(-F.col("change") if loss else F.abs("change"), 9)
    best = F.max_by(F.struct("start", "end", "change"), F.when(inside, F.struct(size, -F.col("end"))))
    g = segments.groupBy(key).agg(best.alias("b"), F.count_if(inside).alias("n"))
    of = lambda c, zero: F.when(F.col("n") > 0, F.col(f"b.{c}")).otherwise(F.lit(zero))
    return g.select(key, of("start", 0).alias("start"), of("end", 0).alias("end"), of("change", 0.0).alias("magnitude"))


def cusum(obs: DataFrame, band: str, key: str = "point_id") -> DataFrame:
    """``<key>, date, magnitude``: range of the cumulative sum of residuals, and the date at which it is largest (the
    first of several). Null readings count as residual 0; a series without readings has no row."""
    all_, run = Window.partitionBy(key), Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = obs.withColumn("_r", F.coalesce(F.col(band) - F.avg(band).over(all_), F.lit(0.0))).withColumn("_s", F.round(F.sum("_r").over(run), 10))
    return r.groupBy(key).agg(F.min_by("date", F.struct(-F.col("_s"), F.col("date"))).alias("date"), (F.max("_s") - F.min("_s")).alias("magnitude"))


def unpivot_bands(obs: DataFrame, bands: list[str]) -> DataFrame:
    return obs.unpivot(["point_id", "date"], bands, "band", "value")
