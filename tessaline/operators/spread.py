"""Activation that spreads over a weighted graph, and beams of paths: bounded loops of equi-joins, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.operators.graph import both_ways
from tessaline.operators.ranking import top_per_group
from tessaline.runtime import cut

#: Edges of a node that are followed, the strongest first.
FANOUT = 100


def trust(tier: Column) -> Column:
    """What the memory tier of an edge is worth on the graph leg: a third for working edges, all for the others."""
    return F.when(tier == "L1", 0.3).otherwise(1.0)


def rank_weight(strength: Column, tier: Column, relation_fits: Column, label_fits: Column) -> Column:
    return strength * trust(tier) * F.when(relation_fits, 1.0).otherwise(0.4) * F.when(label_fits, 1.0).otherwise(0.5)


def trusted(edges: DataFrame) -> DataFrame:
    """(src, dst, w, deg) in both directions: strength by the trust of the tier, at most `FANOUT` edges a node; deg is the degree of src."""
    w = F.col("strength") * F.when(F.col("tier") == "L3", 1.0).when(F.col("tier") == "L2", 0.6).otherwise(0.3)
    both = both_ways(edges.select("src", "dst", w.alias("w")))
    degree = both.groupBy("src").agg(F.count("*").alias("deg"))
    kept = top_per_group(both, ["src"], [F.round("w", 9).desc(), F.col("dst")], FANOUT).drop("rank")
    return cut(kept.join(degree, "src"))


def activation(edges: DataFrame, seeds: DataFrame, hops: int = 3, decay: float = 0.7, most: float = 2.0, least: float = 0.01) -> DataFrame:
    """(node, activation) after `hops` rounds from `seeds`: each node sends decay * w / sqrt(1 + degree) of its own along its edges and keeps its
    own; if the largest exceeds `most` all are scaled down to it, and what is below `least` is dropped."""
    state = cut(seeds.groupBy("node").agg(F.max("activation").alias("activation")))
    for _ in range(hops):
        sent = state.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("activation") * decay * F.col("w") / F.sqrt(1 + F.col("deg"))).alias("activation"))
        summed = cut(state.unionByName(sent).groupBy("node").agg(F.sum("activation").alias("activation")))
        top = summed.agg(F.max("activation")).first()[0]
        scale = min(1.0, most / top) if top else 1.0
        state = cut(summed.select("node", (F.col("activation") * scale).alias("activation")).where(F.col("activation") >= least))
    return state


def both_ends(edges: DataFrame, one: DataFrame, two: DataFrame, hops: int = 2, boost: float = 1.5) -> DataFrame:
    """Two spreads added up; what both reach is boosted."""
    a = activation(edges, one, hops).withColumnRenamed("activation", "a")
    b = activation(edges, two, hops).withColumnRenamed("activation", "b")
    met = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), boost).otherwise(1.0)
    return a.join(b, "node", "full_outer").select("node", ((F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) * met).alias("activation"))


def beam(edges: DataFrame, seeds: DataFrame, hops: int = 2, width: int = 32) -> DataFrame:
    """(node, score) of the best path to each node: of every seed the `width` best paths go on after each hop, none meets a node twice; seeds are left out."""
    kept = cut(top_per_group(edges, ["src"], [F.round("w", 9).desc(), F.col("dst")], FANOUT).select("src", "dst", "w"))
    front = seeds.select(F.col("node").alias("root"), "node", F.array("node").alias("path"), F.lit(1.0).alias("score"))
    found = None
    for _ in range(hops):
        step = front.join(kept, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = step.select("root", F.col("node").alias("via"), F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), (F.col("score") * F.col("w")).alias("score"))
        front = cut(top_per_group(step, ["root"], [F.round("score", 9).desc(), F.col("node"), F.col("via")], width).select("root", "node", "path", "score"))
        found = front if found is None else found.unionByName(front)
    best = found.groupBy("node").agg(F.max("score").alias("score"))
    return best.join(seeds.select("node"), "node", "left_anti")
