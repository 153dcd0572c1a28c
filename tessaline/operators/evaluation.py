"""Retrieval metrics per query from ranked results and graded judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(results: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision, recall, mrr, p_at_1, map, ndcg) from results (query_id, item, rank) and gold (query_id, item, grade)."""
    top = results.where(F.col("rank") <= k)
    judged = top.join(gold, ["query_id", "item"])
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id").orderBy("rank")
    hit = judged.withColumn("hits", F.row_number().over(w))
    per = hit.groupBy("query_id").agg(
        F.count("*").alias("h"), F.min("rank").alias("first"), F.sum(F.col("hits") / F.col("rank")).alias("ap"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    ideal_rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("grade").desc(), "item"))
    ideal = gold.withColumn("r", ideal_rank).groupBy("query_id").agg(
        F.count("*").alias("g"), F.sum(F.when(F.col("r") <= k, F.col("grade") / F.log2(F.col("r") + 1.0))).alias("idcg")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(per, "query_id", "left").select(
        "query_id", zero(F.col("h") / k).alias("precision"), zero(F.col("h") / F.col("g")).alias("recall"), zero(1 / F.col("first")).alias("mrr"),
        zero(F.when(F.col("first") == 1, 1.0).otherwise(0.0)).alias("p_at_1"), zero(F.col("ap") / F.col("g")).alias("map"), zero(F.col("dcg") / F.col("idcg")).alias("ndcg"),
    )
