"""Names and what they stand for: links that are only made where they are clear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decide(known: DataFrame, ratio: float) -> DataFrame:
    """(surface, uuid) of `known` (surface, uuid, popularity): the only candidate, or the first if it is `ratio` times as popular as the second, else null.

    Only maxima of each surface are kept, no list of candidates.
    """
    first = known.groupBy("surface").agg(F.count("*").alias("n"), F.max("popularity").alias("top"))
    top = known.join(first, "surface")
    best = top.where("popularity = top").groupBy("surface", "top", "n").agg(F.min("uuid").alias("uuid"), F.count("*").alias("firsts"))
    second = top.where("popularity < top").groupBy("surface").agg(F.max("popularity").alias("second"))
    joined = best.join(second, "surface", "left")
    runner = F.when(F.col("firsts") > 1, F.col("top")).otherwise(F.col("second"))
    return joined.select("surface", F.when((F.col("n") == 1) | (F.col("top") >= ratio * runner), F.col("uuid")).alias("uuid"))


# Coarse kinds of labels.
COARSE = {"PERSON": "agent", "ORGANIZATION": "agent", "LOCATION": "place", "TECHNOLOGY": "thing"}


def coarse(label: Column) -> Column:
    out = F.lit("other")
    for fine, kind in COARSE.items():
        out = F.when(label == fine, kind).otherwise(out)
    return out
