"""Estimation scalars as column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_value(confidence: float) -> float:
    """Two-sided quantile of the standard normal distribution."""
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def sample_size(p: Column, relative_error: Column | float, confidence: float = 0.95) -> Column:
    """Observations for which a share p is known to a relative error (Cochran). Null where p is 0."""
    return F.ceil(F.try_divide(z_value(confidence) ** 2 * p * (1 - p), F.pow(relative_error * p, 2)))


def relative_margin(p: Column, n: Column, confidence: float = 0.95) -> Column:
    """Relative margin of error of a share p from n observations."""
    return F.try_divide(z_value(confidence) * F.sqrt(F.try_divide(p * (1 - p), n)), p)


def grid_spacing(area: Column, n: Column) -> Column:
    return F.sqrt(F.try_divide(area, n))


def bayes_update(prior: Column, likelihood: Column) -> Column:
    """Posterior of an event given the evidence's likelihood with it; without it the likelihood is taken as its complement.
    Null where both products are 0."""
    top = prior * likelihood
    return F.try_divide(top, top + (1 - prior) * (1 - likelihood))


def combined_probability(*ps: Column) -> Column:
    """Geometric mean; 0 if any is 0, null if any is null."""
    product = ps[0]
    for p in ps[1:]:
        product = product * p
    return F.pow(product, 1.0 / len(ps))


def fraction_year(date: Column) -> Column:
    """Year and the share of 365 days that has gone by, to 3 places; the 366th day counts beyond the year."""
    return F.year(date) + F.round(F.dayofyear(date) / F.lit(365.0), 3)


def number_or_null(c: Column) -> Column:
    """c, with NaN and both infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def nan_to_null(c: Column | str) -> Column:
    """c, with NaN as null: Spark orders NaN above every number, while a comparison with an absent value must be false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def above(c: Column | str, limit: Column | float) -> Column:
    """Whether c is a number beyond a limit; false for null and NaN on either side."""
    limit = nan_to_null(limit) if isinstance(limit, Column) else limit
    return F.coalesce(nan_to_null(c) > limit, F.lit(False))
