"""Ordered operators: fusion of ranked lists, competition, sessions by gaps, spikes, trends, last n."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark's group limit prunes before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def reciprocal_ranks(lists: list[tuple[DataFrame, float]], key: list[str], k: int = 60) -> DataFrame:
    """(key, score): the sum of w / (k + rank) over ranked lists (key, rank from 1), weights normalised."""
    total = sum(w for _, w in lists)
    parts = [df.select(*key, (F.lit(w / total) / (k + F.col("rank"))).alias("part")) for df, w in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.sum("part").alias("score"))


def compete(rows: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """Rows near the top score lose by their distance to it; one that falls to a tenth or less is suppressed."""
    top = F.max(score).over(W.partitionBy(*group))
    ratio = F.when(top > 0, F.col(score) / top).otherwise(0.0)
    loss = F.when((ratio > 0.9) & (ratio < 1.0), 0.15 * (1 - ratio) * 10).otherwise(0.0)
    return rows.withColumn("competed", F.col(score) - loss).withColumn("suppressed", F.col("competed") <= 0.1)


def sessions(rows: DataFrame, group: list[str], ts: str, tie: str, gap_seconds: int = 1_800) -> DataFrame:
    """Rows with a session number: a new session begins after a gap longer than `gap_seconds`."""
    w = W.partitionBy(*group).orderBy(ts, tie)
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / F.lit(1e6)
    begins = F.when(seconds.isNull() | (seconds > gap_seconds), 1).otherwise(0)
    return rows.withColumn("_b", begins).withColumn("session", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_b")


def spikes(rows: DataFrame, group: list[str], order: list[str], value: str, by: float = 0.3, above: float = 0.7) -> DataFrame:
    """Rows whose value is far from the running mean of its group up to it, or high in itself."""
    mean = F.avg(value).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("running_mean", mean).withColumn("spike", (F.abs(F.col(value) - mean) > by) | (F.col(value) > above))


def slopes(rows: DataFrame, group: list[str], order: list[Column], value: str, last: int = 20, least: int = 3, flat: float = 0.1) -> DataFrame:
    """Least-squares slope of the last values of each group on their position, and its direction."""
    newest = rows.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*[c.desc() for c in order]))).where(F.col("_r") <= last)
    slope = F.regr_slope(F.col(value), -F.col("_r").cast("double"))
    out = newest.groupBy(*group).agg(F.count("*").alias("n"), slope.alias("slope")).where(F.col("n") >= least)
    return out.withColumn("trend", F.when(F.col("slope") > flat, "rising").when(F.col("slope") < -flat, "falling").otherwise("flat"))


def z_scores(rows: DataFrame, group: list[str], value: str, beyond: float = 3.0) -> DataFrame:
    """Deviation of each row from its group's population mean; the baseline is aggregated first and joined back."""
    base = rows.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    z = F.when(F.col("std") > 0, (F.col(value) - F.col("mean")) / F.col("std")).otherwise(0.0)
    return rows.join(base, group).withColumn("z", z).withColumn("anomaly", F.abs("z") > beyond)
