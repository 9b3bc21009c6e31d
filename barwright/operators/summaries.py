"""Aggregates, volume profile, and the least-squares family."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError, period
from ..model import need

FUNCTIONS = {"sum": F.sum, "mean": F.mean, "min": F.min, "max": F.max, "count": F.count}


def volume_sum(df: DataFrame, volume: str = "volume", keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(volume).alias("volume_sum"))


def volume_weighted_price(df: DataFrame, price: str = "price", volume: str = "volume", keys: tuple[str, ...] = ()) -> DataFrame:
    """Null where there is no volume."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(price) * F.col(volume)), F.sum(F.col(volume).cast("double"))).alias("vwp"))


def group_aggregation(df: DataFrame, group: str, x: str, how: str) -> DataFrame:
    """The result keeps the name of the column; count is of values that are present."""
    need(df, group, x)
    if how not in FUNCTIONS:
        raise ConfigurationError(f"how must be one of {', '.join(FUNCTIONS)}, got {how!r}")
    return df.groupBy(group).agg(FUNCTIONS[how](x).alias(x))


def volume_profile(df: DataFrame, bins: int = 50, price: str = "price", volume: str = "volume", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, bin, level (the bin's centre), volume, poc (centre of the first bin of most volume).

    Equal bins between the least and the greatest price, the last one closed on the right; empty bins are
    there with volume 0; one price only gives one level.
    """
    period(bins=bins)
    need(df, *keys, price, volume)
    known = df.where(F.col(price).isNotNull() & ~F.isnan(price)).select(*keys, F.col(price).cast("double").alias("_p"), F.col(volume).cast("double").alias("_v"))
    bounds = known.groupBy(*keys).agg(F.min("_p").alias("_low"), F.max("_p").alias("_high"))
    joined = known.join(bounds, list(keys)) if keys else known.crossJoin(F.broadcast(bounds))
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.when(F.col("_high") > F.col("_low"), F.least(F.floor(F.try_divide(F.col("_p") - F.col("_low"), width)), F.lit(bins - 1))).otherwise(0).cast("int")
    filled = joined.groupBy(*keys, place.alias("bin")).agg(F.sum("_v").alias("volume"))
    top = F.when(F.col("_high") > F.col("_low"), bins - 1).otherwise(0)
    levels = bounds.select("*", F.explode(F.sequence(F.lit(0), top)).alias("bin")).withColumn("level", F.col("_low") + width * F.when(F.col("_high") > F.col("_low"), F.col("bin") + 0.5).otherwise(0.0))
    whole = levels.join(filled, [*keys, "bin"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    poc = whole.groupBy(*keys).agg(F.max_by("level", F.struct("volume", -F.col("bin"))).alias("poc"))
    out = whole.join(poc, list(keys)) if keys else whole.crossJoin(F.broadcast(poc))
    return out.select(*keys, "bin", "level", "volume", "poc")


def _pair(x: str, y: str) -> tuple[Column, Column]:
    """Both columns where both are present."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))


def least_squares_fit(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    a, b = _pair(x, y)
    return df.groupBy(*keys).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))


def trend_line(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = (), out: str = "trend") -> DataFrame:
    fit = least_squares_fit(df, x, y, keys)
    joined = df.join(fit, list(keys)) if keys else df.crossJoin(F.broadcast(fit))
    return joined.withColumn(out, F.col("slope") * F.col(x) + F.col("intercept")).select(*df.columns, out)


def correlation(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    a, b = _pair(x, y)
    return df.groupBy(*keys).agg(F.corr(a, b).alias("correlation"))


def polynomial_fit(df: DataFrame, x: str, y: str, degree: int = 2, out: str = "fitted") -> tuple[list[float], DataFrame]:
    """Coefficients from the highest power down, and ``df`` with the fitted values.

    One aggregation brings power sums of the centred and scaled x to the driver: 3 * degree + 3 numbers.
    """
    period(degree=degree)
    a, b = _pair(x, y)
    mean, spread = df.agg(F.avg(a), F.stddev_pop(a)).first()
    mean, spread = mean or 0.0, spread or 1.0
    z = (a - mean) / spread
    sums = df.agg(*[F.sum(F.pow(z, F.lit(k))).alias(f"m{k}") for k in range(2 * degree + 1)], *[F.sum(F.pow(z, F.lit(k)) * b).alias(f"r{k}") for k in range(degree + 1)]).first()
    if sums["m0"] is None or sums["m0"] <= degree:
        raise ConfigurationError(f"degree {degree} needs more than {degree} points")
    left = np.array([[sums[f"m{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    solved = np.linalg.solve(left, np.array([sums[f"r{i}"] for i in range(degree + 1)]))
    scaled = np.polynomial.Polynomial(solved)(np.polynomial.Polynomial([-mean / spread, 1 / spread]))
    coefficients = [float(c) for c in np.append(scaled.coef, np.zeros(degree + 1 - len(scaled.coef)))][::-1]
    shifted, fitted = (F.col(x) - mean) / spread, F.lit(0.0)
    for c in solved[::-1]:
        fitted = fitted * shifted + float(c)
    return coefficients, df.withColumn(out, fitted)
