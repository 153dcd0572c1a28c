"""Graphs as edge tables: breadth-first reach, personalised page rank, components, ancestors, association weights.

Iterations are a bounded loop of equi-joins in the driver; each round's result is written to the shared folder, so the plan
stays short and survives the loss of an executor. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.runtime import cut


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back)


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of every node within `depth` steps of a seed, each once at its least depth."""
    seen = cut(seeds.select("node", F.lit(0).alias("depth")).distinct())
    front = seen
    for d in range(1, depth + 1):
        found = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def reach_from(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): `reach` for each root by itself; a node counts once for a root, at its least depth."""
    seen = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    front = seen
    for d in range(1, depth + 1):
        found = front.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        front = cut(found.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def page_rank(edges: DataFrame, seeds: DataFrame, restart: float = 0.5, rounds: int = 10, tolerance: float | None = None) -> DataFrame:
    """(node, score) of personalised page rank over weighted edges (src, dst, weight); dangling mass is dropped.

    `seeds` are (node, mass); masses are normalised. With a `tolerance` the rounds end when the scores change by less in all (L1).
    """
    total = F.sum("weight").over(W.partitionBy("src"))
    steps = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).withColumn("share", F.col("weight") / total).select("src", "dst", "share"))
    mass = seeds.agg(F.sum("mass").alias("m"))
    start = cut(seeds.crossJoin(F.broadcast(mass)).select("node", (F.col("mass") / F.col("m")).alias("base")))
    rank = start.select("node", F.col("base").alias("score"))
    for k in range(rounds):
        before = rank
        flow = rank.join(steps, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
        rank = (
            flow.join(start, F.col("dst") == F.col("node"), "full_outer")
            .select(
                F.coalesce("dst", "node").alias("node"),
                (restart * F.coalesce("base", F.lit(0.0)) + (1 - restart) * F.coalesce("flow", F.lit(0.0))).alias("score"),
            )
        )
        if tolerance is not None:
            # Who has a score keeps one, so the last round's nodes are all among this one's.
            rank = cut(rank.join(before.select("node", F.col("score").alias("was")), "node", "left"))
            change = rank.agg(F.sum(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))))).first()[0]
            rank = rank.select("node", "score")
            if change is None or change < tolerance:
                break
        elif k % 4 == 3:
            rank = cut(rank)
    return rank


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component, by alternating large-star and small-star rounds."""
    pairs = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    while True:
        near = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = cut(small)
        same = small.join(pairs, ["u", "v"], "left_anti").isEmpty() and pairs.join(small, ["u", "v"], "left_anti").isEmpty()
        pairs = small
        if same:
            break
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.join(pairs.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def ancestors(rows: DataFrame, key: str, parent: str, most: int = 100) -> DataFrame:
    """(node, ancestor, steps) up the parents, at most `most` steps; a cycle ends when it would repeat."""
    up = cut(rows.select(F.col(key).alias("k"), F.col(parent).alias("p")).where("p is not null and k is not null").distinct())
    found = cut(up.select(F.col("k").alias("node"), F.col("p").alias("ancestor"), F.lit(1).alias("steps")))
    front = found
    for s in range(2, most + 1):
        step = front.join(up, F.col("ancestor") == F.col("k")).select("node", F.col("p").alias("ancestor"), F.lit(s).alias("steps"))
        front = cut(step.join(found, ["node", "ancestor"], "left_anti").where("node <> ancestor"))
        if front.isEmpty():
            break
        found = cut(found.unionByName(front))
    return found


def association(pairs: DataFrame, singles: DataFrame, total: int) -> DataFrame:
    """Pointwise mutual information of (a, b, k) given (item, n) over `total` records, normalised and kept in [0.1, 1]."""
    named = pairs.join(singles.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(singles.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    pmi = F.log2(F.col("k") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b"))) / F.log2(F.lit(float(total)))
    return named.withColumn("weight", F.least(F.greatest(pmi, F.lit(0.1)), F.lit(1.0)))
