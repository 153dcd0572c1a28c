"""Record linkage by Fellegi and Sunter: comparison levels within blocks, weights by expectation maximisation, clusters by components.

Pairs are only formed inside a block. Expectation maximisation runs on the table of comparison patterns and their counts, a few dozen rows
whatever the number of pairs, so the driver's loop never touches pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.functions.strings import jaro_winkler
from tessaline.operators import graph


def name_level(a: Column, b: Column) -> Column:
    """3, 2, 1, 0 by Jaro-Winkler similarity: 0.92 and more, 0.75, 0.5, less."""
    near = jaro_winkler(F.lower(a), F.lower(b))
    return F.when(near >= 0.92, 3).when(near >= 0.75, 2).when(near >= 0.5, 1).otherwise(0)


def folded_label(label: Column) -> Column:
    """The label by which blocks are made: places of all kinds are one."""
    return F.when(label.isin("GPE", "FACILITY"), "LOCATION").otherwise(label)


def equal_level(a: Column, b: Column) -> Column:
    return F.when(a == b, 1).otherwise(0)


def pairs(records: DataFrame, key: str, block: str, compare: dict[str, tuple[str, object]]) -> DataFrame:
    """(a, b, level columns) for a < b of the same block."""
    columns = sorted({c for c, _ in compare.values()})
    left = records.select(F.col(key).alias("a"), F.col(block).alias("_block"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    right = records.select(F.col(key).alias("b"), F.col(block).alias("_block"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = left.join(right, "_block").where(F.col("a") < F.col("b"))
    return joined.select("a", "b", *[level(F.col(f"_l_{c}"), F.col(f"_r_{c}")).alias(name) for name, (c, level) in compare.items()])


def fit(patterns: list[tuple[tuple[int, ...], int]], share: float = 0.1, rounds: int = 25) -> tuple[float, list[dict[int, float]], list[dict[int, float]]]:
    """(share of matches, m, u) from counted patterns; u is taken from all pairs, m from expectation maximisation."""
    total = sum(n for _, n in patterns)
    width = len(patterns[0][0])
    levels = [sorted({p[i] for p, _ in patterns}) for i in range(width)]
    u = [{v: (sum(n for p, n in patterns if p[i] == v) + 1e-6) / (total + 1e-6 * len(levels[i])) for v in levels[i]} for i in range(width)]
    m = [{v: (k + 1) ** 2 / sum((j + 1) ** 2 for j in range(len(levels[i]))) for k, v in enumerate(levels[i])} for i in range(width)]
    for _ in range(rounds):
        weight = []
        for p, n in patterns:
            one = share * math.prod(m[i][p[i]] for i in range(width))
            two = (1 - share) * math.prod(u[i][p[i]] for i in range(width))
            weight.append((p, n, one / (one + two)))
        matched = sum(n * g for _, n, g in weight)
        share = min(max(matched / total, 1e-6), 0.99)
        for i in range(width):
            for v in levels[i]:
                m[i][v] = (sum(n * g for p, n, g in weight if p[i] == v) + 1e-6) / (matched + 1e-6 * len(levels[i]))
    return share, m, u


def scored(compared: DataFrame, names: list[str]) -> DataFrame:
    """The pairs with their match probability."""
    counts = compared.groupBy(*names).agg(F.count("*").alias("n")).collect()
    if not counts:
        return compared.withColumn("probability", F.lit(0.0))
    share, m, u = fit([(tuple(r[n] for n in names), r.n) for r in counts])
    weight = F.lit(math.log2(share / (1 - share)))
    for i, name in enumerate(names):
        part = F.lit(0.0)
        for v in m[i]:
            part = F.when(F.col(name) == v, math.log2(m[i][v] / u[i][v])).otherwise(part)
        weight = weight + part
    return compared.withColumn("probability", F.round(1 / (1 + F.pow(F.lit(2.0), -weight)), 6))


def clusters(matches: DataFrame) -> DataFrame:
    return graph.components(matches.select(F.col("a").alias("src"), F.col("b").alias("dst")))
