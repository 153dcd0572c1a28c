"""Vector algebra as expressions: projections, residuals, samples, hashed vectors, and an adapter that learns from pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.functions.vectors import cosine, dot


def usable(v: Column, dimensions: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimensions) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def projected(v: Column, matrix: list[list[float]]) -> Column:
    """The product of a matrix (a parameter) and a vector."""
    return F.array(*(dot(v, F.array(*(F.lit(float(x)) for x in row))) for row in matrix))


def without(v: Column, q: Column) -> Column:
    """What is left of a vector without its part in the direction of another."""
    share = F.try_divide(dot(v, q), dot(q, q))
    return F.zip_with(v, q, lambda x, y: x - share * y)


def attribution(query: Column, memory: Column, response: Column) -> Column:
    return F.greatest(cosine(without(memory, query), without(response, query)), F.lit(0.0))


def sampled(v: Column, count: int, dimensions: int) -> Column:
    step = dimensions // count
    return F.array(*(F.get(v, F.lit(i * step)) for i in range(count)))


def hashed(rows: DataFrame, key: str, words: str, dimensions: int) -> DataFrame:
    """(key, dimension, value) of the non-zero entries of each row's word counts, hashed and normalised."""
    at = F.conv(F.substring(F.md5("w"), 1, 7), 16, 10).cast("bigint") % dimensions
    counts = rows.select(key, F.explode(words).alias("w")).select(key, at.cast("int").alias("dimension")).groupBy(key, "dimension").agg(F.count("*").cast("double").alias("x"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return counts.join(norms, key).select(key, "dimension", F.round(F.col("x") / F.col("n"), 6).alias("value"))


def adapter(rows: DataFrame, key: str, label: str, vector: str, rounds: int = 3, rate: float = 0.05) -> DataFrame:
    """(round, within, between): mean cosine of neighbours of one label and of different ones after each round of a linear adapter W.

    A round adds to W the mean of rate * x p' over pairs that belong together less half of that over pairs that don't; each task sums outer products of its own
    rows, so one matrix for each task is all that is combined. Pairs are neighbours in the order of ids, within and across labels.
    """
    spark = rows.sparkSession
    from pyspark.sql import Window as W

    same, any_ = W.partitionBy(label).orderBy(key), W.partitionBy(F.pmod(F.xxhash64(key), F.lit(64))).orderBy(key)
    pairs = rows.select(F.col(vector).alias("x"), F.lead(vector).over(same).alias("p"), F.lead(vector).over(any_).alias("q"), (F.lead(label).over(any_) != F.col(label)).alias("apart"))
    pairs = pairs.where("p is not null and q is not null and apart").select("x", "p", "q")
    size = len(rows.select(vector).first()[0])
    w = np.eye(size)
    out = []

    for k in range(rounds + 1):
        now = w

        def gather(batches):
            total, hits, n = np.zeros((size, size)), np.zeros(2), 0
            for b in batches:
                if b.empty:
                    continue
                x, p, q = (np.stack(b[c].to_numpy()) for c in "xpq")
                total += x.T @ p - 0.5 * (x.T @ q)
                y, yp, yq = (unit(v @ now.T) for v in (x, p, q))  # noqa: B023
                hits += [(y * yp).sum(), (y * yq).sum()]
                n += len(x)
            yield pd.DataFrame({"total": [total.ravel().tolist()], "within": [hits[0]], "between": [hits[1]], "n": [n]})

        parts = pairs.mapInPandas(gather, "total array<double>, within double, between double, n long")
        # One row for each task: a matrix of fixed size, whatever the number of pairs.
        got = parts.toPandas()
        n = max(1, int(got.n.sum()))
        out.append((k, round(float(got.within.sum() / n), 6), round(float(got.between.sum() / n), 6)))
        w = w + rate * size * np.sum([np.array(t) for t in got.total], axis=0).reshape(size, size) / n
    return spark.createDataFrame(out, "round int, within double, between double")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
