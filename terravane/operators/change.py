"""Change-detection kernels over nested series.

A series is one row, so the kernels run in one map over the rows, all enabled ones at once, without a shuffle. Random
draws are seeded by the series' id, so a result does not depend on partitions or retries. The methods follow the
published papers: Verbesselt, Zeileis and Herold 2012 (structural break monitoring), Brooks et al. 2014 (EWMA charts),
Chu, Stinchcombe and White 1996 (CUSUM monitoring), Zhu and Woodcock 2014 (continuous change detection), Kennedy,
Yang and Cohen 2010 (trajectory segmentation).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: 0.99 quantile of the chi-squared distribution by degrees of freedom.
CHI2_99 = {1: 6.635, 2: 9.210, 3: 11.345, 4: 13.277, 5: 15.086, 6: 16.812}


@dataclass(frozen=True)
class ChangeConfig:
    band: str = "ndfi"
    bands: tuple[str, ...] = ("green", "red", "nir", "swir1", "swir2")
    start_monitor: float = 2020.0
    end_monitor: float = 2023.0
    bootstraps: int = 1000
    slope_share: float = 0.66
    harmonics: int = 1
    h_share: float = 0.25
    level: float = 0.05
    ewma_lambda: float = 0.3
    ewma_limit: float = 3.0
    shewhart: float = 5.0
    run_length: int = 6
    max_segments: int = 6
    enabled: tuple[str, ...] = field(default=("cusum", "slope", "timescan", "bfast", "nrt", "ccdc", "landtrendr"))
    seed: int = 42


def fraction_years(days: np.ndarray) -> np.ndarray:
    """Fraction year of days since 1970: year + round(day of year / 365, 3)."""
    d = days.astype("datetime64[D]")
    y = d.astype("datetime64[Y]")
    return y.astype(int) + 1970 + np.round(((d - y).astype(int) + 1) / 365, 3)


def cusum(t: np.ndarray, y: np.ndarray, bootstraps: int, rng: np.random.Generator) -> tuple[float, float, float]:
    """Date, confidence and magnitude; (-1, -1, -1) for an empty series. Magnitude is the range of the cumulative sum of
    residuals; confidence the share of permutations with a smaller one, times the drop of their mean from it, which
    is negative where the permutations' mean is larger."""
    if not len(y):
        return -1.0, -1.0, -1.0
    r = y - y.mean()
    s = r.cumsum()
    size = s.max() - s.min()
    date = t[int(np.argmax(np.round(s, 10)))]
    if size <= 1e-12:
        return date, 0.0, 0.0
    p = rng.permuted(np.broadcast_to(r, (bootstraps, len(r))), axis=1).cumsum(1)
    sizes = p.max(1) - p.min(1)
    return date, float((size > sizes).mean() * (1 - sizes.mean() / size)), float(size)


def bootstrap_slope(t: np.ndarray, y: np.ndarray, bootstraps: int, share: float, rng: np.random.Generator) -> tuple[float, float, float, float]:
    """Mean, deviation, largest and smallest least-squares slope of random parts of the series; -1 throughout if empty.
    With fewer than two different times the minimum-norm solution counts."""
    if not len(y):
        return -1.0, -1.0, -1.0, -1.0
    k = int(share * len(y))
    if k == 0:
        return 0.0, 0.0, 0.0, 0.0
    pick = np.argsort(rng.random((bootstraps, len(y))), axis=1)[:, :k]
    x, v = t[pick], y[pick]
    xm, vm = x.mean(1, keepdims=True), v.mean(1, keepdims=True)
    sxx = ((x - xm) ** 2).sum(1)
    sxy = ((x - xm) * (v - vm)).sum(1)
    flat = sxx < 1e-12
    slope = np.where(flat, (x[:, 0] * vm[:, 0]) / (x[:, 0] ** 2 + 1), sxy / np.where(flat, 1, sxx))
    return float(slope.mean()), float(slope.std()), float(slope.max()), float(slope.min())


def design(t: np.ndarray, harmonics: int, trend: bool = True) -> np.ndarray:
    columns = [np.ones_like(t)] + ([t - 2000] if trend else [])
    for j in range(1, harmonics + 1):
        columns += [np.sin(2 * np.pi * j * t), np.cos(2 * np.pi * j * t)]
    return np.stack(columns, 1)


@functools.lru_cache(maxsize=16)
def mosum_critical(h: float, level: float, period: float = 10.0, seed: int = 1, paths: int = 2000, steps: int = 200) -> float:
    """Critical value of the moving-sum monitoring process, by simulation of its limit with a fixed seed."""
    rng = np.random.default_rng(seed)
    n = int(period * steps)
    w = np.concatenate([np.zeros((paths, 1)), rng.standard_normal((paths, n)).cumsum(1) / math.sqrt(steps)], 1)
    t = np.arange(n + 1) / steps
    bridge = w - t * w[:, [steps]]
    width = int(h * steps)
    moved = bridge[:, width:] - bridge[:, :-width]
    tt = t[width:]
    late = tt > 1
    edge = np.sqrt(np.where(tt[late] > math.e, np.log(np.maximum(tt[late], 1e-9)), 1.0))
    return float(np.quantile((np.abs(moved[:, late]) / edge).max(1), 1 - level))


def bfast_monitor(t: np.ndarray, y: np.ndarray, c: ChangeConfig, critical: float) -> tuple[float, float, float]:
    """Date, magnitude, mean of the process. -1: no break; -2: too little history or nothing to monitor."""
    past, now = t < c.start_monitor, (t >= c.start_monitor) & (t <= c.end_monitor)
    n, p = int(past.sum()), 2 + 2 * c.harmonics
    h = int(c.h_share * n)
    if n <= p + 1 or h < 1 or not now.any():
        return -2.0, 0.0, 0.0
    beta, *_ = np.linalg.lstsq(design(t[past], c.harmonics), y[past], rcond=None)
    order = np.concatenate([np.nonzero(past)[0], np.nonzero(now)[0]])
    r = y[order] - design(t[order], c.harmonics) @ beta
    sigma = math.sqrt((r[:n] ** 2).sum() / (n - p))
    if sigma <= 1e-12:
        return -1.0, 0.0, 0.0
    s = np.concatenate([[0], r.cumsum()])
    mo = (s[n + 1 :] - s[n + 1 - h : len(s) - h]) / (sigma * math.sqrt(n))
    x = np.arange(n + 1, len(r) + 1) / n
    edge = critical * np.sqrt(np.where(x > math.e, np.log(x), 1.0))
    hit = np.nonzero(np.abs(mo) > edge)[0]
    if not len(hit):
        return -1.0, 0.0, 0.0
    return float(t[order[n + hit[0]]]), float(np.median(r[n:])), float(mo.mean())


#: Fixed value: 5 % critical value of the recursive CUSUM test (Brown, Durbin and Evans 1975).
RECURSIVE_CUSUM_5 = 0.9479


def stable_history(x: np.ndarray, y: np.ndarray, critical: float = RECURSIVE_CUSUM_5) -> int:
    """Where the stable history starts, by the reverse-ordered CUSUM test (Pesaran and Timmermann 2002): recursive residuals
    are added up from the last reading backwards; readings before the first crossing of critical * (1 + 2 t) are left out."""
    n, p = x.shape
    if n <= p + 1:
        return 0
    xr, yr = x[::-1], y[::-1]
    inverse = np.linalg.pinv(xr[:p].T @ xr[:p])
    beta = inverse @ xr[:p].T @ yr[:p]
    w = np.empty(n - p)
    for k in range(p, n):
        v = xr[k]
        gain = inverse @ v
        f = 1 + v @ gain
        e = yr[k] - v @ beta
        w[k - p] = e / math.sqrt(f)
        beta = beta + gain * (e / f)
        inverse = inverse - np.outer(gain, gain) / f
    sd = w.std(ddof=1) if len(w) > 1 else 0.0
    if sd <= 1e-12:
        return 0
    t = np.arange(1, n - p + 1) / (n - p)
    out = np.nonzero(np.abs(w.cumsum() / (sd * math.sqrt(n - p))) > critical * (1 + 2 * t))[0]
    return n - p - int(out[0]) if len(out) else 0


def screened_fit(x: np.ndarray, y: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, float, np.ndarray] | None:
    """Least squares without readings beyond ``limit`` deviations of the fit, which is repeated until none is left (a round
    drops one at least, so it ends): (kept, coefficients, deviation, residuals), None if too few readings stay."""
    keep = np.arange(len(y))
    while True:
        if len(keep) <= x.shape[1] + 1:
            return None
        beta, *_ = np.linalg.lstsq(x[keep], y[keep], rcond=None)
        r = y[keep] - x[keep] @ beta
        sigma = math.sqrt((r**2).sum() / (len(keep) - x.shape[1]))
        good = np.abs(r) <= limit * sigma + 1e-12
        if good.all():
            return keep, beta, sigma, r
        keep = keep[good]


def monitoring_charts(t: np.ndarray, y: np.ndarray, c: ChangeConfig, critical: float) -> list[float]:
    """EWMA, MOSUM and CUSUM charts: date, change (0/1) and last process value of each; zeros if nothing can be said.

    The history's model is harmonic without a trend; the CUSUM chart takes the stable end of the history only."""
    past, now = t < c.start_monitor, (t >= c.start_monitor) & (t <= c.end_monitor)
    x, xn = design(t[past], c.harmonics, trend=False), design(t[now], c.harmonics, trend=False)
    fit = screened_fit(x, y[past], c.shewhart)
    if fit is None or fit[2] <= 1e-12 or not now.any():
        return [0.0] * 9
    keep, beta, sigma, r = fit
    n, m, dates, k = len(keep), y[now] - xn @ beta, t[now], np.arange(1, int(now.sum()) + 1)
    lam = c.ewma_lambda
    ewma = np.empty(len(m))
    state = 0.0
    for i, v in enumerate(m):
        state = ewma[i] = (1 - lam) * state + lam * v
    limit = c.ewma_limit * sigma * np.sqrt(lam / (2 - lam) * (1 - (1 - lam) ** (2 * k)))
    s = np.concatenate([[0], np.concatenate([r, m]).cumsum()])
    h = max(1, int(c.h_share * n))
    mosum = (s[n + 1 :] - s[n + 1 - h : len(s) - h]) / (sigma * math.sqrt(n))
    late = (n + k) / n
    mosum_limit = critical * np.sqrt(np.where(late > math.e, np.log(late), 1.0))
    first = stable_history(x[keep], y[past][keep])
    recent = screened_fit(x[keep[first:]], y[past][keep[first:]], c.shewhart) or fit
    if recent[2] <= 1e-12:
        recent = fit
    size = len(recent[0])
    late = (size + k) / size
    total = (y[now] - xn @ recent[1]).cumsum() / (recent[2] * math.sqrt(size))
    cusum_limit = np.sqrt(late * (late - 1) * (7.78 + np.log(late / (late - 1))))
    out: list[float] = []
    for process, edge in ((ewma, limit), (mosum, mosum_limit), (total, cusum_limit)):
        hit = np.nonzero(np.abs(process) > edge)[0]
        out += [float(dates[hit[0]]) if len(hit) else 0.0, float(len(hit) > 0), float(process[-1])]
    return out


def ccdc_segments(t: np.ndarray, ys: np.ndarray, run: int = 6, least: int = 12) -> list[tuple[float, np.ndarray]]:
    """Breaks as (date, magnitude by band): a break is where ``run`` readings in a row depart from the harmonic model of
    the segment so far; the model is fitted anew after it. The models of all ends of a segment come from running sums of
    the normal equations, solved in one batch."""
    out, start, n = [], 0, len(t)
    if n < least + run:
        return out
    bands = ys.shape[1]
    cut = CHI2_99.get(bands, bands + 2.33 * math.sqrt(2 * bands))
    x = design(t, 1)
    x[:, 1] -= x[:, 1].mean()
    p = x.shape[1]
    sums = lambda v: np.concatenate([np.zeros((1, *v.shape[1:])), v.cumsum(0)])
    xx, xy, yy = sums(x[:, :, None] * x[:, None, :]), sums(x[:, :, None] * ys[:, None, :]), sums(ys * ys)
    ahead = np.arange(run)
    while start + least + run <= n:
        ends = np.arange(start + least, n - run + 1)
        gram, mixed = xx[ends] - xx[start], xy[ends] - xy[start]
        gram = gram + 1e-9 * np.eye(p)
        beta = np.linalg.solve(gram, mixed)
        rest = np.maximum(yy[ends] - yy[start] - (beta * mixed).sum(1), 0)
        rmse = np.maximum(np.sqrt(rest / np.maximum(1, ends - start - p)[:, None]), 1e-4)
        r = ys[ends[:, None] + ahead] - x[ends[:, None] + ahead] @ beta
        broken = np.nonzero((((r / rmse[:, None, :]) ** 2).sum(2) > cut).all(1))[0]
        if not len(broken):
            break
        k = int(broken[0])
        out.append((float(t[ends[k]]), np.median(r[k], axis=0)))
        start = int(ends[k])
    return out


def largest_break(breaks: list[tuple[float, np.ndarray]], start: float, end: float, band: int) -> tuple[float, float]:
    """The break within [start, end] with the largest magnitude in one band; (0, 0) if none."""
    inside = [(d, float(m[band])) for d, m in breaks if start <= d <= end]
    return max(inside, key=lambda b: abs(b[1])) if inside else (0.0, 0.0)


def landtrendr(years: np.ndarray, v: np.ndarray, most: int = 6, share: float = 0.75) -> tuple[float, float, float, float, float]:
    """Magnitude, duration, first year, rate and last year of the segment with the largest loss; zeros if none.

    Spikes are damped; vertices are added where the trajectory departs most from its segments; then the weakest are
    taken away one by one, and of all models the simplest whose F is close to the best is kept."""
    n = len(v)
    if n < 4:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    v = v.astype(float).copy()
    for k in range(1, n - 1):
        around = (v[k - 1] + v[k + 1]) / 2
        if abs(v[k] - around) > 4 * abs(v[k + 1] - v[k - 1]) + 1e-9 and abs(v[k] - around) > 0.05:
            v[k] = around
    vertices = [0, n - 1]
    while len(vertices) < min(n, most + 2):
        fit = np.interp(years, years[vertices], v[vertices])
        gap = np.abs(v - fit)
        gap[vertices] = 0
        if gap.max() <= 1e-9:
            break
        vertices = sorted([*vertices, int(gap.argmax())])
    models = []
    while True:
        knots = years[vertices]
        x = np.stack([np.interp(years, knots, row) for row in np.eye(len(knots))], 1)
        at, *_ = np.linalg.lstsq(x, v, rcond=None)
        rest = ((v - x @ at) ** 2).sum()
        whole = ((v - v.mean()) ** 2).sum()
        free, used = n - len(knots), len(knots) - 1
        f = ((whole - rest) / used) / (rest / free + 1e-12) if free > 0 else 0.0
        models.append((f, list(vertices), at))
        if len(vertices) == 2:
            break
        cost = [abs(at[k] - np.interp(knots[k], [knots[k - 1], knots[k + 1]], [at[k - 1], at[k + 1]])) for k in range(1, len(knots) - 1)]
        vertices = vertices[: int(np.argmin(cost)) + 1] + vertices[int(np.argmin(cost)) + 2 :]
    top = max(m[0] for m in models)
    _, chosen, at = [m for m in models if m[0] >= share * top][-1]
    steps = [(at[k + 1] - at[k], years[chosen[k + 1]] - years[chosen[k]], years[chosen[k]] + 1, years[chosen[k + 1]]) for k in range(len(chosen) - 1)]
    change, duration, first, last = min(steps, key=lambda s: s[0])
    if change >= 0:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    return float(-change), float(duration), float(first), float(-change / duration), float(last)


OUTPUT = {
    "cusum": ["cusum_change_date", "cusum_confidence", "cusum_magnitude"],
    "slope": ["bs_slope_mean", "bs_slope_sd", "bs_slope_max", "bs_slope_min"],
    "timescan": [],  # four columns for each band
    "bfast": ["bfast_change_date", "bfast_magnitude", "bfast_means"],
    "nrt": [f"{k}_jrc_{v}" for k in ("ewma", "mosum", "cusum") for v in ("date", "change", "magnitude")],
    "ccdc": ["ccdc_change_date", "ccdc_magnitude"],
    "landtrendr": ["lt_magnitude", "lt_duration", "lt_start", "lt_rate", "lt_end"],
}


STATISTICS = ("mean", "sd", "min", "max")


def output_columns(c: ChangeConfig) -> list[str]:
    """The columns of the enabled kernels, in order."""
    return [n for k in c.enabled for n in ([f"{b}_{s}" for b in statistic_bands(c) for s in STATISTICS] if k == "timescan" else OUTPUT[k])]


def statistic_bands(c: ChangeConfig) -> list[str]:
    return list(dict.fromkeys([*c.bands, c.band]))


def series_features(days: np.ndarray, ts: dict[str, np.ndarray], id_: int, c: ChangeConfig, critical: float) -> dict[str, float]:
    """All enabled features of one series (readings of any order; NaN is absent)."""
    order = np.argsort(days, kind="stable")
    order = order[~np.isnan(days[order])]
    days_ = days[order]
    y = ts[c.band][order]
    ok = ~np.isnan(y)
    t, v = fraction_years(days_[ok].astype(int)), y[ok]
    rng = np.random.default_rng([c.seed, abs(int(id_))])
    monitored = (t >= c.start_monitor) & (t <= c.end_monitor)
    tm, vm = t[monitored], v[monitored]
    out: dict[str, float] = {"images": len(t), "mon_images": len(tm)}
    for name in c.enabled:
        if name == "cusum":
            values = cusum(tm, vm, c.bootstraps, rng)
        elif name == "slope":
            values = bootstrap_slope(tm, vm, c.bootstraps, c.slope_share, rng)
        elif name == "timescan":
            years = fraction_years(days_.astype(int))
            inside = (years >= c.start_monitor) & (years <= c.end_monitor)
            for b in statistic_bands(c):
                x = ts[b][order][inside]
                x = x[~np.isnan(x)]
                out.update(zip([f"{b}_{k}" for k in STATISTICS], map(float, (x.mean(), x.std(), x.min(), x.max()) if len(x) else (-1.0,) * 4)))
            continue
        elif name == "bfast":
            values = bfast_monitor(t, v, c, critical)
        elif name == "nrt":
            values = monitoring_charts(t, v, c, critical)
        elif name == "ccdc":
            used = [b for b in c.bands if b in ts] or [c.band]
            if c.band not in used:
                used.append(c.band)
            m = np.stack([ts[b][order] for b in used], 1)
            whole = ~np.isnan(m).any(1)
            tt = fraction_years(days_[whole].astype(int))
            values = largest_break(ccdc_segments(tt, m[whole], c.run_length), c.start_monitor, c.end_monitor, used.index(c.band))
        else:
            years = np.unique(np.floor(t))
            values = landtrendr(years, np.array([v[np.floor(t) == k].mean() for k in years]), c.max_segments)
        out.update(zip(OUTPUT[name], map(float, values)))
    return out


def features(series: DataFrame, config: ChangeConfig = ChangeConfig(), id_: str = "series_id", first_year: int = 2015, last_year: int = 2022) -> DataFrame:
    """``id, images, mon_images`` and the enabled features of nested series, one row for each row of ``series``.

    Absent values (null, NaN, -9999) and dates outside the years are passed over. An empty series gives -1 for the
    cumulative sum, slope and every band's statistics, -2 for the break monitor and 0 for the charts, segments and trajectory."""
    bands = list(dict.fromkeys([config.band, *(config.bands if {"ccdc", "timescan"} & set(config.enabled) else ())]))
    names = output_columns(config)
    days = F.transform("dates", lambda d: F.when(F.year(d).between(first_year, last_year), F.unix_date(d.cast("date"))))
    rows = series.select(F.col(id_), days.alias("days"), *[F.col("ts")[b].alias(b) for b in bands])
    critical = mosum_critical(config.h_share, config.level)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                d = np.asarray(r[1] if r[1] is not None else [], float)
                ts = {}
                for k, band in enumerate(bands):
                    x = np.full(len(d), np.nan)
                    a = np.asarray(r[2 + k] if r[2 + k] is not None else [], float)[: len(d)]
                    x[: len(a)] = a
                    x[x == -9999] = np.nan
                    ts[band] = x
                out.append({id_: r[0]} | series_features(d, ts, r[0], config, critical))
            yield pd.DataFrame(out, columns=[id_, "images", "mon_images", *names])

    return rows.mapInPandas(run, f"{id_} {dict(series.dtypes)[id_]}, images int, mon_images int, " + ", ".join(f"{n} double" for n in names))
