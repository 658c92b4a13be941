"""Sequential monitoring of a stream of readings: the EWMA chart of each series, kept as state.

An extension of the batch charts: readings arrive in batches, the state of a series is its last process value, the
number of readings and the first date beyond the limit. Any fold of the stream into batches that keeps each series'
order gives what the batch fold gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "point_id long, n long, ewma double, change_date double"
STATE = "n long, ewma double, change_date double"


def fold(rows: pd.DataFrame, n: int, ewma: float, change: float, lam: float, limit: float) -> tuple[int, float, float]:
    """State after rows (t, residual in units of the noise), in order of t. A null residual changes nothing."""
    for t, v in rows.sort_values("t")[["t", "residual"]].dropna().itertuples(index=False):
        n += 1
        ewma = (1 - lam) * ewma + lam * v
        edge = limit * (lam / (2 - lam) * (1 - (1 - lam) ** (2 * n))) ** 0.5
        if change == 0 and abs(ewma) > edge:
            change = t
    return n, ewma, change


def ewma_monitor(stream: DataFrame, lam: float = 0.3, limit: float = 3.0) -> DataFrame:
    """``point_id, n, ewma, change_date`` after each batch, for the series in it; change_date 0 while there is none.

    ``stream`` has point_id, t (fraction year) and residual. Write it with output mode update."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ewma, change = state.get if state.exists else (0, 0.0, 0.0)
        n, ewma, change = fold(pd.concat(list(batches)), n, ewma, change, lam, limit)
        state.update((n, ewma, change))
        yield pd.DataFrame({"point_id": [key[0]], "n": [n], "ewma": [ewma], "change_date": [change]})

    return stream.groupBy("point_id").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def ewma_batch(readings: DataFrame, lam: float = 0.3, limit: float = 3.0) -> DataFrame:
    """The same over a whole table."""

    def whole(b: pd.DataFrame) -> pd.DataFrame:
        n, ewma, change = fold(b, 0, 0.0, 0.0, lam, limit)
        return pd.DataFrame({"point_id": [b["point_id"].iloc[0]], "n": [n], "ewma": [ewma], "change_date": [change]})

    return readings.groupBy("point_id").applyInPandas(whole, OUTPUT)


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Events by type in sliding windows, with a watermark for late ones."""
    from pyspark.sql import functions as F

    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
