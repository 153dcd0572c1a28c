"""Experiment statistics as column expressions over aggregated counts."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bucket(user: Column, test: str) -> Column:
    """0 .. 9999 from a digest, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat(user.cast("string"), F.lit(f":{test}"))), 1, 7), 16, 10).cast("bigint") % 10_000


def chi_squared(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of the 2 x 2 table [[a, b], [c, d]]; 0 when an expected count is below 5. Products of counts leave 64 bits from some hundred thousand rows on: they are doubles, and
    the difference of two a decimal."""
    x, y, u, v = ((p.cast("double") + q.cast("double")) for p, q in ((a, b), (c, d), (a, c), (b, d)))
    whole = lambda n: n.cast("decimal(19,0)")
    least = F.try_divide(F.least(x * u, x * v, y * u, y * v), x + y)
    stat = (x + y) * F.pow((whole(a) * whole(d) - whole(b) * whole(c)).cast("double"), 2) / (x * y * u * v)
    return F.when(least >= 5, stat).otherwise(0.0)


# Critical values of chi squared with one degree of freedom.
CRITICAL_05, CRITICAL_001, CRITICAL_0001 = 3.841, 10.828, 15.137


def interpolated_p(stat: Column) -> Column:
    """Of chi squared with one degree of freedom, by straight lines between its usual critical values."""
    far = 0.001 - (stat - CRITICAL_001) / (CRITICAL_0001 - CRITICAL_001) * 0.0009
    mid = 0.05 - (stat - CRITICAL_05) / (CRITICAL_001 - CRITICAL_05) * 0.049
    near = 0.05 + (1 - stat / CRITICAL_05) * 0.95
    return F.when(stat <= 0, 1.0).when(stat >= CRITICAL_0001, 0.0001).when(stat >= CRITICAL_001, far).when(stat >= CRITICAL_05, mid).otherwise(near)


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def effect_size(p1: Column, p2: Column) -> tuple[Column, Column, Column, Column]:
    """(Cohen's h without sign, relative risk, odds ratio, number needed) of a second rate beside a first."""
    h = F.abs(2 * F.asin(F.sqrt(p2)) - 2 * F.asin(F.sqrt(p1)))
    odds = F.try_divide(p2 / F.nullif(1 - p2, F.lit(0.0)), p1 / F.nullif(1 - p1, F.lit(0.0)))
    return h, F.coalesce(F.try_divide(p2, p1), F.lit(0.0)), F.coalesce(odds, F.lit(0.0)), F.coalesce(F.try_divide(F.lit(1.0), F.abs(p2 - p1)), F.lit(float("inf")))


def posterior(arms: DataFrame, draws: int = 10_000, seed: int = 12_345) -> DataFrame:
    """(better, mean_lift) from draws of Beta(x + 1/2, n - x + 1/2) of each arm; `arms` has (n1, x1, n2, x2)."""

    def draw(batches):
        for b in batches:
            out = []
            for n1, x1, n2, x2 in b[["n1", "x1", "n2", "x2"]].itertuples(index=False, name=None):
                r = np.random.default_rng(seed)
                one, two = r.beta(x1 + 0.5, n1 - x1 + 0.5, draws), r.beta(x2 + 0.5, n2 - x2 + 0.5, draws)
                out.append((float((two > one).mean()), float((two - one).mean())))
            yield pd.DataFrame(out, columns=["better", "mean_lift"])

    return arms.select("n1", "x1", "n2", "x2").mapInPandas(draw, "better double, mean_lift double")


def spending(spark: SparkSession, looks: int, alpha: float = 0.05) -> DataFrame:
    """(look, spent, threshold): the error spent up to each of the planned looks, and what the look itself may use."""
    normal = NormalDist()
    z = normal.inv_cdf(1 - alpha / 2)
    spent = [2 * (1 - normal.cdf(z / math.sqrt(k / looks))) for k in range(1, looks + 1)]
    return spark.createDataFrame([(k + 1, round(x, 8), round(x / (k + 1), 8)) for k, x in enumerate(spent)], "look int, spent double, threshold double")


def power(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """The chance of seeing the difference of two rates, by the normal distribution of Cohen's h."""
    z = (2 * (F.asin(F.sqrt(p2)) - F.asin(F.sqrt(p1)))) * F.sqrt(1 / (1 / n1 + 1 / n2))
    # The error function by a published rational approximation (Abramowitz and Stegun 7.1.26).
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return 0.5 * (1 + F.signum(z) * erf)
