"""Implausible readings in nested series, judged by each series' own behaviour.

Per series and band, over the readings in order of their dates: a seasonal wave is fitted to the first differences by
reweighted least squares, so that shifts and spikes, single large differences, don't bend it. What is left follows a
robust first-order autoregression around a local level. Two effects are tested at each reading:

* level shift: the levels of the readings before and after it, in units of the long-run deviation of the difference of two
  such levels. Where it is significant, the level changes there and the reading is measured from the nearer of the two;
  elsewhere from both together.
* additive outlier: the reading's distance from that level less what the autoregression expects of it from the reading
  before and the one after, (phi / (1 + phi^2)) times the sum of their residuals, in units of its own deviation,
  sigma / sqrt(1 + phi^2). Its distance from the nearer level must be as large in units of sigma, and what lies between the
  readings on both sides is no outlier: on a steep stretch of a season that is no sine the wave is off, not the reading.

An additive outlier beyond ``critical`` that is the largest around is set aside, and the wave, the autoregression and both
tests are made again until none is found. A shift lasts and is kept. Stuck runs and values outside the physical range are
found separately. Rows are handled a few hundred at a time in numpy; no shuffle is needed, since a series is one row.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS = ("green", "red", "nir", "swir1", "swir2", "ndfi")
#: Physical range by band; the mask.
RANGES = {b: (0.0, 1.0) for b in BANDS} | {"ndfi": (-1.0, 1.0)}
MASKED = -9999.0
CRITICAL = 6.0
#: Deviations from which the levels on both sides of a reading count as two.
SHIFT = 1.0
STUCK_RUN = 5
SIDE = 5
LEAST = 10


def _side_medians(y: np.ndarray, n: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the ``side`` readings before and after each entry of left-justified rows; NaN where none is."""
    rows, width = y.shape
    pad = np.full((rows, side), np.nan)
    p = np.concatenate([pad, y, pad], axis=1)
    stack = lambda offsets: np.sort(np.stack([p[:, side + o : side + o + width] for o in offsets]), axis=0)

    def median(s: np.ndarray) -> np.ndarray:
        k = side - np.isnan(s).sum(0)
        lo, hi = np.maximum(k - 1, 0) // 2, np.minimum(k // 2, side - 1)
        return (np.take_along_axis(s, lo[None], 0)[0] + np.take_along_axis(s, hi[None], 0)[0]) / 2

    return median(stack(range(-side, 0))), median(stack(range(1, side + 1)))


def deseasonalise(t: np.ndarray, y: np.ndarray, rounds: int = 5) -> np.ndarray:
    """y without the yearly wave that fits its first differences robustly. t in days; NaN beyond a row's readings."""
    w = 2 * np.pi / 365.25
    s, c = np.sin(w * t), np.cos(w * t)
    ds, dc, dy = np.diff(s), np.diff(c), np.diff(y)
    ok = ~np.isnan(dy)
    ds, dc, dy = (np.where(ok, v, 0) for v in (ds, dc, dy))
    a = b = np.zeros((len(y), 1))
    for _ in range(rounds):
        r = dy - a * ds - b * dc
        scale = 1.4826 * np.nanmedian(np.where(ok, np.abs(r), np.nan), axis=1, keepdims=True) + 1e-6
        g = np.clip(1 - (r / (4.685 * scale)) ** 2, 0, None) ** 2 * ok
        ss, sc, cc = (g * ds * ds).sum(1), (g * ds * dc).sum(1), (g * dc * dc).sum(1)
        sy, cy = (g * ds * dy).sum(1), (g * dc * dy).sum(1)
        det = ss * cc - sc * sc
        good = det > 1e-9
        det = np.where(good, det, 1)
        a = np.where(good, (sy * cc - cy * sc) / det, 0)[:, None]
        b = np.where(good, (cy * ss - sy * sc) / det, 0)[:, None]
    return y - a * s - b * c


def outliers(t: np.ndarray, y: np.ndarray, critical: float = CRITICAL, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """True for the additive outliers of left-justified rows (NaN to the right of a row's readings), and the deviation of
    each row's innovations (NaN for rows of fewer than LEAST readings, which are not judged).

    A round sets aside a reading in every row that goes on, so the rounds end."""
    found, sigma = np.zeros(y.shape, bool), np.full(len(y), np.nan)
    todo = np.nonzero((~np.isnan(y)).sum(1) >= LEAST)[0]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        while len(todo):
            yy = np.where(found[todo], np.nan, y[todo])
            order = np.argsort(np.isnan(yy), axis=1, kind="stable")
            tt, yy = np.take_along_axis(t[todo], order, 1), np.take_along_axis(yy, order, 1)
            n = (~np.isnan(yy)).sum(1)
            z = deseasonalise(tt, yy)
            score, sigma[todo] = additive_outliers(z, yy, n, side)
            hit = (score > critical) & (score == _neighbourhood_max(score, side))
            rows, cols = np.nonzero(hit)
            found[todo[rows], order[rows, cols]] = True
            todo = todo[hit.any(1) & (n - hit.sum(1) >= LEAST)]
    return found, sigma


def additive_outliers(z: np.ndarray, y: np.ndarray, n: np.ndarray, side: int, shift: float = SHIFT) -> tuple[np.ndarray, np.ndarray]:
    """The statistic of an additive outlier at each of the first n entries of rows, and the rows' sigma. y are the readings, z
    the same without the season."""
    rows, width = z.shape
    before, after = _side_medians(z, n, side)
    # the first and the last reading have one side only; there the neighbour tells whether the change lasts
    before[:, :1] = np.where(np.isnan(before[:, :1]), z[:, 1:2], before[:, :1])
    last = (np.arange(rows), np.maximum(n - 1, 0))
    after[last] = z[last[0], np.maximum(n - 2, 0)]
    place = np.arange(width)[None, :]
    nb, na = np.clip(place, 1, side), np.clip(n[:, None] - 1 - place, 1, side)
    middle = (before + after) / 2
    rough = 1.4826 * np.nanmedian(np.abs(z - middle), axis=1, keepdims=True)
    nearer = np.where(np.abs(z - before) < np.abs(z - after), before, after)
    e = z - np.where(np.abs(before - after) > 3 * rough, nearer, middle)
    phi = _autoregression(e)[:, None]
    sigma = 1.4826 * np.nanmedian(np.abs(e[:, 1:] - phi * e[:, :-1]), axis=1)
    scale = np.fmax(np.fmax(sigma[:, None], _local_scale(e)), 1e-4)
    # medians vary 1.2533 times as much as means
    step = np.abs(after - before) / (1.2533 * scale / (1 - phi) * np.sqrt(1 / nb + 1 / na))
    apart = z - np.clip(z, np.fmin(before, after), np.fmax(before, after))
    residual = np.where(step > shift, apart, z - (nb * before + na * after) / (nb + na))
    near = np.clip(np.nan_to_num(e), -2 * scale, 2 * scale)
    sides = np.zeros_like(near)
    sides[:, 1:] += near[:, :-1]
    sides[:, :-1] += near[:, 1:]
    effect = residual - phi / (1 + phi * phi) * sides
    score = np.fmin(np.abs(effect) * np.sqrt(1 + phi * phi), np.abs(apart)) / scale
    beside = np.full((4, rows, width), np.nan)
    for k, o in enumerate((-2, -1, 1, 2)):
        beside[k, :, max(0, -o) : width - max(0, o)] = y[:, max(0, o) : width + min(0, o)]
    between = (y > np.nanmin(beside, axis=0)) & (y < np.nanmax(beside, axis=0))
    return np.where(np.isnan(score) | between, 0, score), np.fmax(sigma, 1e-4)


def _neighbourhood_max(score: np.ndarray, side: int) -> np.ndarray:
    """The largest score within ``side`` entries: of neighbours only the strongest outlier is taken in one round."""
    p = np.pad(score, ((0, 0), (side, side)))
    return np.max(np.stack([p[:, o : o + score.shape[1]] for o in range(2 * side + 1)]), axis=0)


def _autoregression(e: np.ndarray) -> np.ndarray:
    """First-order coefficient per row from residuals clipped at 2 scales, held within [0, 0.9]."""
    s = 1.4826 * np.nanmedian(np.abs(e), axis=1, keepdims=True) + 1e-9
    c = np.clip(e, -2 * s, 2 * s)
    top = np.nansum(c[:, 1:] * c[:, :-1], axis=1)
    return np.clip(top / (np.nansum(c * c, axis=1) + 1e-12), 0, 0.9)


def _local_scale(e: np.ndarray, half: int = 10) -> np.ndarray:
    """Median absolute residual of the 2 * half + 1 readings around each one, as a scale; blocks of ``half`` share it."""
    rows, width = e.shape
    blocks = -(-width // half)
    p = np.full((rows, (blocks + 2) * half), np.nan)
    p[:, half : half + width] = np.abs(e)
    per = np.stack([np.nanmedian(p[:, k * half : (k + 3) * half], axis=1) for k in range(blocks)], axis=1)
    return 1.4826 * np.repeat(per, half, axis=1)[:, :width] * 0.9


def stuck_runs(v: np.ndarray, least: int = STUCK_RUN) -> np.ndarray:
    """True for the members of runs of at least ``least`` equal readings in left-justified rows; NaN ends a row."""
    rows, width = v.shape
    same = np.zeros((rows, width + 1), bool)
    same[:, 1:width] = v[:, 1:] == v[:, :-1]
    out = np.zeros((rows, width), bool)
    r, c = np.nonzero(same[:, :width] | same[:, 1:])
    if not len(r):
        return out
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1) | ~same[r[1:], c[1:]]
    run = new.cumsum() - 1
    out[r, c] = np.bincount(run)[run] >= least
    return out


def judge(dates: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray, critical: float = CRITICAL, stuck: int = STUCK_RUN) -> np.ndarray:
    """0 nothing, 1 impossible, 2 stuck, 3 spike, for each entry of ``values`` (rows x positions, NaN = absent).

    ``dates`` are days, NaN where none is known. A reading without a date takes the place it has in the stored order
    if the row's other dates are in order there; else no place is known, and it is a spike if it lies outside the range of
    the row's dated and plausible readings by ``critical`` deviations.
    """
    verdict = np.zeros(values.shape, np.int8)
    there = ~np.isnan(values)
    impossible = there & ((values < low[:, None]) | (values > high[:, None]))
    verdict[impossible] = 1
    filled = pd.DataFrame(dates.T).ffill().bfill().to_numpy().T
    ordered = ~(np.diff(filled, axis=1) < 0).any(1)
    usable = there & ~impossible
    dated = usable & (~np.isnan(dates) | ordered[:, None])

    def packed(mask: np.ndarray, by_date: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.where(mask, filled if by_date else np.arange(values.shape[1])[None, :], np.inf)
        order = np.argsort(key, axis=1, kind="stable")
        m = np.take_along_axis(mask, order, 1)
        width = max(1, int(m.sum(1).max(initial=0)))
        order, m = order[:, :width], m[:, :width]
        v = np.where(m, np.take_along_axis(values, order, 1), np.nan)
        t = np.where(m, np.take_along_axis(filled, order, 1), np.nan)
        return order, t, v

    for by_date in (True, False):
        order, _, v = packed(dated if by_date else usable, by_date)
        r, c = np.nonzero(stuck_runs(v, stuck))
        verdict[r, order[r, c]] = 2
    order, t, v = packed(dated & (verdict == 0), True)
    found, sigma = outliers(t, v, critical)
    r, c = np.nonzero(found)
    verdict[r, order[r, c]] = 3
    loose = usable & ~dated & (verdict == 0)
    rows = np.nonzero(loose.any(1) & ~np.isnan(sigma))[0]
    if len(rows):
        kept = np.where(dated[rows] & (verdict[rows] == 0), values[rows], np.nan)
        beyond = values[rows] - np.clip(values[rows], np.nanmin(kept, axis=1)[:, None], np.nanmax(kept, axis=1)[:, None])
        r, c = np.nonzero(loose[rows] & (np.abs(np.nan_to_num(beyond)) > critical * sigma[rows, None]))
        verdict[rows[r], c] = 3
    return verdict


KINDS = np.array(["", "impossible", "stuck", "spike"], dtype=object)


def implausible_readings(series: DataFrame, bands: tuple[str, ...] = BANDS, critical: float = CRITICAL, stuck: int = STUCK_RUN, first_year: int = 2015, last_year: int = 2022) -> DataFrame:
    """``series_id, band, idx, kind``: one row for each implausible reading of nested series.

    kind is 'impossible', 'stuck' or 'spike'; idx is the position in the stored array. Null, NaN and -9999 are absent
    and never cases; an infinite reading is impossible. Dates that are null or outside the years count as unknown. Null arrays, bands that the map lacks
    and empty rows give nothing; arrays longer than ``dates`` are read as far as the dates go. A row that comes twice
    is judged twice. Fewer than LEAST readings are judged for range and runs only. A single last reading that stands out is
    a spike; a change that two or more readings hold up to the end counts as lasting.
    """
    arrays = [F.col("ts")[b].alias(f"b{i}") for i, b in enumerate(bands)]
    days = F.transform("dates", lambda d: F.when(F.year(d).between(first_year, last_year), F.datediff(d, F.lit("2015-01-01"))))
    rows = series.select("series_id", days.alias("days"), *arrays).where("series_id is not null and size(days) > 0")
    lows, highs = np.array([RANGES[b][0] for b in bands]), np.array([RANGES[b][1] for b in bands])

    def matrix(lists: list, width: int) -> np.ndarray:
        out = np.full((len(lists), width), np.nan)
        for i, x in enumerate(lists):
            if x is not None and len(x):
                x = np.asarray(x, dtype=float)[:width]
                out[i, : len(x)] = x
        return out

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 500):
                b = whole.iloc[start : start + 500]
                lengths = b["days"].map(len).to_numpy()
                width = int(lengths.max())
                days_ = matrix(list(b["days"]), width)
                v = np.concatenate([matrix(list(b[f"b{i}"]), width) for i in range(len(bands))])
                v[v == MASKED] = np.nan
                v[np.arange(width)[None, :] >= np.tile(lengths, len(bands))[:, None]] = np.nan
                verdict = judge(np.tile(days_, (len(bands), 1)), v, np.repeat(lows, len(b)), np.repeat(highs, len(b)), critical, stuck)
                r, c = np.nonzero(verdict)
                yield pd.DataFrame({"series_id": b["series_id"].to_numpy()[r % len(b)], "band": np.array(bands, dtype=object)[r // len(b)], "idx": c.astype(np.int32), "kind": KINDS[verdict[r, c]]})

    return rows.mapInPandas(find, "series_id long, band string, idx int, kind string")
