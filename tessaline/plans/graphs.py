"""Queries over graphs: entities and edges, traversals, spreads, ranks, topology, lineage, dependencies.

The entity graph has the names of memories as nodes; two names of one memory make an edge (G03). Lineage edges lead from a parent memory to its child.
Tasks are orders; an order waits for the order before it of the same customer.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions import scoring
from tessaline.operators import graph, ranking, spread, topology
from tessaline.plans.registry import Registry
from tessaline.runtime import cut, table

REGISTRY = Registry()
AS_OF = datetime(2025, 6, 1)
_NOW = "TIMESTAMPTZ '2025-06-01 00:00:00+00'"

_MENTIONS = "e AS (SELECT DISTINCT memory_id, created_at, lower(trim(unnest(list_transform(entities, lambda x: x.text)))) AS n FROM mif_memories), k AS (SELECT * FROM e WHERE n <> '')"
#: Edges with their number of episodes, strength after as many steps, tier and last time.
_EDGES = f"""WITH {_MENTIONS},
g AS (SELECT a.n AS src, b.n AS dst, count(*) AS times, max(a.created_at) AS last, min(a.created_at) AS first FROM k a JOIN k b ON a.memory_id = b.memory_id AND a.n < b.n GROUP BY ALL),
x AS (SELECT *, 1 - 0.5 * pow(0.9, times) AS strength, CASE WHEN times >= 5 THEN 'L3' WHEN times >= 2 THEN 'L2' ELSE 'L1' END AS tier FROM g)"""


def mentions(spark: SparkSession, base: str) -> DataFrame:
    """(memory_id, created_at, n): the distinct names of each memory."""
    rows = table(spark, base, "mif_memories").select("memory_id", "created_at", F.explode("entities.text").alias("t"))
    return rows.select("memory_id", "created_at", F.lower(F.trim("t")).alias("n")).where("n <> ''").distinct()


def entity_edges(spark: SparkSession, base: str) -> DataFrame:
    """(src, dst, times, last, first, strength, tier), src < dst: pairs inside a memory, whose list of names is short."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform("entities.text", lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))))
    docs = table(spark, base, "mif_memories").select("created_at", names.alias("n")).where(F.size("n") > 1)
    first = docs.select("created_at", "n", F.posexplode("n").alias("at", "src"))
    pairs = first.select("created_at", "src", F.explode(F.slice("n", F.col("at") + 2, F.size("n"))).alias("dst"))
    g = pairs.groupBy("src", "dst").agg(F.count("*").alias("times"), F.max("created_at").alias("last"), F.min("created_at").alias("first"))
    tier = F.when(F.col("times") >= 5, "L3").when(F.col("times") >= 2, "L2").otherwise("L1")
    return g.select("*", (1 - 0.5 * F.pow(F.lit(0.9), F.col("times").cast("double"))).alias("strength"), tier.alias("tier"))


@REGISTRY.query("g01_entities_upserted", f"WITH {_MENTIONS} SELECT n AS name, count(*) AS mention_count, round(least(1.0, 0.3 + 0.1 * count(*))::DOUBLE, 6) AS salience FROM k GROUP BY 1")
def g01_entities_upserted(spark: SparkSession, base: str) -> DataFrame:
    n = F.count("*")
    return mentions(spark, base).groupBy(F.col("n").alias("name")).agg(n.alias("mention_count"), F.round(F.least(F.lit(1.0), 0.3 + 0.1 * n), 6).alias("salience"))


@REGISTRY.query("g03_edges", _EDGES + " SELECT src, dst, times, round(strength, 6) AS strength, tier FROM x")
def g03_edges(spark: SparkSession, base: str) -> DataFrame:
    return entity_edges(spark, base).select("src", "dst", "times", F.round("strength", 6).alias("strength"), "tier")


@REGISTRY.query("g04_incident_edges", _EDGES + ", h AS (SELECT n FROM k GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 5) SELECT h.n AS node, x.src, x.dst FROM h JOIN x ON x.src = h.n OR x.dst = h.n")
def g04_incident_edges(spark: SparkSession, base: str) -> DataFrame:
    """The edges of the five most mentioned nodes, in either direction: two equi-joins, not one join on either."""
    edges = entity_edges(spark, base).select("src", "dst")
    hubs = F.broadcast(mentions(spark, base).groupBy("n").count().orderBy(F.col("count").desc(), "n").limit(5).select(F.col("n").alias("node")))
    return edges.join(hubs, F.col("src") == F.col("node")).unionByName(edges.join(hubs, F.col("dst") == F.col("node"))).select("node", "src", "dst")


@REGISTRY.query("g07_traversed_edges", _EDGES + ", h AS (SELECT n FROM k GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 5) SELECT src, dst, times + CASE WHEN src IN (FROM h) OR dst IN (FROM h) THEN 1 ELSE 0 END AS activation_count FROM x")
def g07_traversed_edges(spark: SparkSession, base: str) -> DataFrame:
    """The explicit job that counts a traversal from the five hubs: reads don't change edges."""
    hubs = F.broadcast(cut(mentions(spark, base).groupBy("n").count().orderBy(F.col("count").desc(), "n").limit(5).select("n")))
    marked = entity_edges(spark, base).join(hubs.select(F.col("n").alias("a")), F.col("src") == F.col("a"), "left").join(hubs.select(F.col("n").alias("b")), F.col("dst") == F.col("b"), "left")
    return marked.select("src", "dst", (F.col("times") + F.when(F.col("a").isNotNull() | F.col("b").isNotNull(), 1).otherwise(0)).alias("activation_count"))


_AGE = f"(epoch_us({_NOW}) - epoch_us(last)) / 86400e6"
_CURVE = "CASE WHEN {d} <= 0 THEN 1.0 WHEN {d} < 3 THEN exp(-0.693 * {d}) ELSE exp(-0.693 * 3.0) * pow({d} / 3.0, -0.5) END"


@REGISTRY.query("g08_effective_strength", _EDGES + f" SELECT src, dst, round(strength * {_CURVE.format(d='(' + _AGE + ')')}, 8) AS strength FROM x WHERE last IS NOT NULL")
def g08_effective_strength(spark: SparkSession, base: str) -> DataFrame:
    """What a traversal sees: the strength after its age, without changing the edge."""
    days = scoring.age_days(F.col("last"), F.lit(AS_OF))
    return entity_edges(spark, base).where("last is not null").select("src", "dst", F.round(F.col("strength") * scoring.forgetting_curve(days), 8).alias("strength"))


@REGISTRY.query("g09_valid_edges", _EDGES + f" SELECT src, dst FROM x WHERE NOT (times = 1 AND coalesce(last < {_NOW} - INTERVAL 300 DAY, FALSE))")
def g09_valid_edges(spark: SparkSession, base: str) -> DataFrame:
    """An edge met once and not for 300 days is invalidated; scans leave it out."""
    gone = (F.col("times") == 1) & F.coalesce(F.col("last") < F.lit(AS_OF) - F.expr("INTERVAL 300 DAYS"), F.lit(False))
    return entity_edges(spark, base).where(~gone).select("src", "dst")


@REGISTRY.query("g10_episodes_of_entities", f"WITH {_MENTIONS} SELECT k.n AS name, count(DISTINCT r.episode_id) AS episodes FROM k JOIN remember_requests r USING (memory_id) WHERE r.episode_id IS NOT NULL GROUP BY 1")
def g10_episodes_of_entities(spark: SparkSession, base: str) -> DataFrame:
    episodes = table(spark, base, "remember_requests").where("episode_id is not null").select("memory_id", "episode_id").distinct()
    pairs = mentions(spark, base).select("memory_id", F.col("n").alias("name")).join(episodes, "memory_id").select("name", "episode_id").distinct()
    return pairs.groupBy("name").agg(F.count("*").alias("episodes"))


@REGISTRY.query("g11_traverse", _EDGES + """
, b AS (SELECT src, dst FROM x WHERE times >= 2 UNION ALL SELECT dst, src FROM x WHERE times >= 2), s AS (SELECT n FROM k GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 1),
h1 AS (SELECT DISTINCT dst AS n FROM b JOIN s ON b.src = s.n), h2 AS (SELECT DISTINCT dst AS n FROM b JOIN h1 ON b.src = h1.n)
SELECT n AS node, min(d) AS depth FROM (SELECT n, 0 AS d FROM s UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2) GROUP BY 1""")
def g11_traverse(spark: SparkSession, base: str) -> DataFrame:
    edges = cut(graph.both_ways(entity_edges(spark, base).where("times >= 2").select("src", "dst")))
    seed = mentions(spark, base).groupBy("n").count().orderBy(F.col("count").desc(), "n").limit(1).select(F.col("n").alias("node"))
    return graph.reach(edges, seed, 2)


@REGISTRY.query("g13_coactivated", f"""
WITH r AS (SELECT DISTINCT episode_id, memory_id FROM remember_requests WHERE episode_id IS NOT NULL), s AS (SELECT episode_id FROM r GROUP BY 1 HAVING count(*) <= 50), q AS (SELECT r.* FROM r JOIN s USING (episode_id))
SELECT a.memory_id AS a, b.memory_id AS b, round(1 - 0.5 * pow(0.9, count(*)), 6) AS strength FROM q a JOIN q b ON a.episode_id = b.episode_id AND a.memory_id < b.memory_id WHERE a.episode_id LIKE '%18' GROUP BY ALL""")
def g13_coactivated(spark: SparkSession, base: str) -> DataFrame:
    """Memories recalled together (the lists of up to 50 that a recall returns; here episodes whose name ends in 18) strengthen their edge."""
    r = table(spark, base, "remember_requests").where("episode_id like '%18'").select("episode_id", "memory_id").distinct()
    lists = r.groupBy("episode_id").agg(F.count("*").alias("n")).where("n <= 50").select("episode_id")
    ids = r.join(lists, "episode_id").groupBy("episode_id").agg(F.array_sort(F.collect_list("memory_id")).alias("ids"))
    first = ids.select("ids", F.posexplode("ids").alias("at", "a"))
    pairs = first.select("a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.round(1 - 0.5 * F.pow(F.lit(0.9), F.count("*").cast("double")), 6).alias("strength"))


_SPREAD = _EDGES + """
, d AS (SELECT n, count(*) AS deg FROM (SELECT src AS n FROM x UNION ALL SELECT dst FROM x) GROUP BY 1),
b AS (SELECT src, dst, w FROM (SELECT src, dst, strength * CASE tier WHEN 'L3' THEN 1.0 WHEN 'L2' THEN 0.6 ELSE 0.3 END AS w FROM x UNION ALL SELECT dst, src, strength * CASE tier WHEN 'L3' THEN 1.0 WHEN 'L2' THEN 0.6 ELSE 0.3 END FROM x) QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) <= 100),
s0 AS (SELECT n, 1.0::DOUBLE AS a FROM (SELECT n FROM k GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 3)),"""


def _hop(k: int) -> str:
    before = f"s{k - 1}"
    return f"""
f{k} AS (SELECT b.dst AS n, sum(s.a * 0.7 * b.w / sqrt(1 + d.deg)) AS a FROM {before} s JOIN b ON b.src = s.n JOIN d ON d.n = s.n GROUP BY 1),
u{k} AS (SELECT n, sum(a) AS a FROM (SELECT n, a FROM {before} UNION ALL SELECT n, a FROM f{k}) GROUP BY 1),
s{k} AS (SELECT n, a * least(1.0, 2.0 / (SELECT max(a) FROM u{k})) AS a FROM u{k} WHERE a * least(1.0, 2.0 / (SELECT max(a) FROM u{k})) >= 0.01)"""


@REGISTRY.query("g14_spread_three_hops", _SPREAD + ",".join(_hop(k) for k in (1, 2, 3)) + " SELECT n AS node, round(a, 6) AS activation FROM s3")
def g14_spread_three_hops(spark: SparkSession, base: str) -> DataFrame:
    """Activation over three hops from the three most mentioned nodes: decay, strength, tier trust, damping by degree, rescaling and a threshold."""
    edges = entity_edges(spark, base)
    seeds = mentions(spark, base).groupBy("n").count().orderBy(F.col("count").desc(), "n").limit(3).select(F.col("n").alias("node"), F.lit(1.0).alias("activation"))
    found = spread.activation(spread.trusted(edges), seeds, hops=3)
    return found.select("node", F.round("activation", 6).alias("activation"))


@REGISTRY.query("g15_spread_from_both_ends")
def g15_spread_from_both_ends(spark: SparkSession, base: str) -> DataFrame:
    """Two halves of the seeds spread by themselves; what both reach counts half as much again. Checked against brute force in the tests."""
    edges = spread.trusted(entity_edges(spark, base))
    ranked = mentions(spark, base).groupBy("n").count().orderBy(F.col("count").desc(), "n").limit(4)
    ranked = cut(ranked.withColumn("r", F.row_number().over(W.orderBy(F.col("count").desc(), "n"))))
    half = lambda odd: ranked.where(f"r % 2 = {odd}").select(F.col("n").alias("node"), F.lit(1.0).alias("activation"))
    return spread.both_ends(edges, half(1), half(0), hops=2).select("node", F.round("activation", 6).alias("activation"))


@REGISTRY.query("g17_rank_weights", _EDGES + " SELECT src, dst, round(strength * CASE tier WHEN 'L1' THEN 0.3 ELSE 1.0 END * CASE WHEN length(src) < 8 THEN 0.4 ELSE 1.0 END * CASE WHEN length(dst) < 8 THEN 0.5 ELSE 1.0 END, 6) AS weight FROM x")
def g17_rank_weights(spark: SparkSession, base: str) -> DataFrame:
    """An edge's weight in the rank: strength, trust of its tier, penalties where it doesn't match what is asked (here short names)."""
    w = spread.rank_weight(F.col("strength"), F.col("tier"), F.length("src") >= 8, F.length("dst") >= 8)
    return entity_edges(spark, base).select("src", "dst", F.round(w, 6).alias("weight"))


@REGISTRY.query("g18_reachable_along", _EDGES + """
, b AS (SELECT src, dst FROM x WHERE tier <> 'L1' UNION ALL SELECT dst, src FROM x WHERE tier <> 'L1'), s AS (SELECT n FROM k GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 2),
h1 AS (SELECT DISTINCT dst AS n FROM b JOIN s ON b.src = s.n), h2 AS (SELECT DISTINCT dst AS n FROM b JOIN h1 ON b.src = h1.n), h3 AS (SELECT DISTINCT dst AS n FROM b JOIN h2 ON b.src = h2.n)
SELECT n AS node, min(d) AS depth, 0.5 / min(d) AS injected FROM (SELECT n, 1 AS d FROM h1 UNION ALL SELECT n, 2 FROM h2 UNION ALL SELECT n, 3 FROM h3) WHERE n NOT IN (FROM s) GROUP BY 1""")
def g18_reachable_along(spark: SparkSession, base: str) -> DataFrame:
    """What edges of a kind reach in three steps gets a score by its distance."""
    edges = cut(graph.both_ways(entity_edges(spark, base).where("tier <> 'L1'").select("src", "dst")))
    seeds = mentions(spark, base).groupBy("n").count().orderBy(F.col("count").desc(), "n").limit(2).select(F.col("n").alias("node"))
    return graph.reach(edges, seeds, 3).where("depth > 0").select("node", "depth", (0.5 / F.col("depth")).alias("injected"))


@REGISTRY.query("g19_beam", _EDGES + """
, b AS (SELECT src, dst, strength AS w FROM x UNION ALL SELECT dst, src, strength FROM x), s AS (SELECT n FROM k GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 3),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) <= 100),
h1 AS (SELECT s.n AS root, s.n AS via, t.dst AS n, t.w AS score FROM s JOIN t ON t.src = s.n QUALIFY row_number() OVER (PARTITION BY s.n ORDER BY round(t.w, 9) DESC, t.dst) <= 32),
h2 AS (SELECT h1.root, h1.n AS via, t.dst AS n, h1.score * t.w AS score FROM h1 JOIN t ON t.src = h1.n WHERE t.dst <> h1.root AND t.dst <> h1.n QUALIFY row_number() OVER (PARTITION BY h1.root ORDER BY round(h1.score * t.w, 9) DESC, t.dst, h1.n) <= 32)
SELECT n AS node, round(max(score), 6) AS score FROM (SELECT n, score FROM h1 UNION ALL SELECT n, score FROM h2) WHERE n NOT IN (FROM s) GROUP BY 1""")
def g19_beam(spark: SparkSession, base: str) -> DataFrame:
    """Two hops, the 32 best paths of each seed after every hop, at most 100 edges a node, no node twice in a path."""
    edges = graph.both_ways(entity_edges(spark, base).select("src", "dst", F.col("strength").alias("w")))
    seeds = cut(mentions(spark, base).groupBy("n").count().orderBy(F.col("count").desc(), "n").limit(3).select(F.col("n").alias("node")))
    return spread.beam(edges, seeds, hops=2, width=32).select("node", F.round("score", 6).alias("score"))


@REGISTRY.query("g21_decay_by_importance", "SELECT uuid, round(0.15 - 0.1 * salience, 6) AS rate FROM graph_entities")
def g21_decay_by_importance(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "graph_entities").select("uuid", F.round(scoring.spread_decay(F.col("salience")), 6).alias("rate"))


@REGISTRY.query("g23_tier_trust", _EDGES + " SELECT tier, CASE tier WHEN 'L1' THEN 0.3 ELSE 1.0 END::DOUBLE AS trust, count(*) AS n FROM x GROUP BY ALL")
def g23_tier_trust(spark: SparkSession, base: str) -> DataFrame:
    return entity_edges(spark, base).groupBy("tier", spread.trust(F.col("tier")).alias("trust")).agg(F.count("*").alias("n"))


@REGISTRY.query("g24_articulation")
def g24_articulation(spark: SparkSession, base: str) -> DataFrame:
    """Nodes whose loss parts a component and how many pieces it leaves; lineage trees and chains of tasks have many."""
    return topology.articulation(_lineage(spark, base))


@REGISTRY.query("g24_bridges")
def g24_bridges(spark: SparkSession, base: str) -> DataFrame:
    return topology.bridges(_lineage(spark, base))


@REGISTRY.query("g25_protected")
def g25_protected(spark: SparkSession, base: str) -> DataFrame:
    """How much a node deserves to stay: the share of its component that would be cut off."""
    return topology.protection(_lineage(spark, base))


@REGISTRY.query("g26_smoothed", "WITH o AS (SELECT uuid, salience AS p FROM graph_entities WHERE mention_count % 3 <> 0), n AS (SELECT uuid, salience * 0.8 AS p FROM graph_entities WHERE mention_count % 2 = 0) SELECT uuid, round(greatest(coalesce(n.p, 0), coalesce(o.p, 0) * 0.9), 6) AS protection FROM o FULL JOIN n USING (uuid) WHERE greatest(coalesce(n.p, 0), coalesce(o.p, 0) * 0.9) > 0.001")
def g26_smoothed(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "graph_entities")
    old = e.where("mention_count % 3 <> 0").select("uuid", F.col("salience").alias("old"))
    new = e.where("mention_count % 2 = 0").select("uuid", (F.col("salience") * 0.8).alias("new"))
    kept = F.greatest(F.coalesce("new", F.lit(0.0)), F.coalesce("old", F.lit(0.0)) * 0.9)
    return old.join(new, "uuid", "full_outer").where(kept > 0.001).select("uuid", F.round(kept, 6).alias("protection"))


@REGISTRY.query("g27_keep_score", "SELECT uuid, round(least(mention_count / 100.0, 1.0) + 0.5 * salience, 6) AS keep FROM graph_entities")
def g27_keep_score(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "graph_entities").select("uuid", F.round(F.least(F.col("mention_count") / 100.0, F.lit(1.0)) + 0.5 * F.col("salience"), 6).alias("keep"))


_CURVATURE = _EDGES + ", d AS (SELECT n, count(*) AS deg FROM (SELECT src AS n FROM x UNION ALL SELECT dst FROM x) GROUP BY 1)"


@REGISTRY.query("g28_curvature", _CURVATURE + " SELECT src, dst, 4 - a.deg - b.deg AS curvature FROM x JOIN d a ON a.n = src JOIN d b ON b.n = dst")
def g28_curvature(spark: SparkSession, base: str) -> DataFrame:
    edges = entity_edges(spark, base).select("src", "dst")
    return topology.curvature(edges)


@REGISTRY.query("g30_gated_edges", _CURVATURE + f", n AS (SELECT n, count(*) AS df FROM k GROUP BY 1), t AS (SELECT count(DISTINCT memory_id) AS total FROM k) SELECT src, dst FROM x JOIN n a ON a.n = src JOIN n b ON b.n = dst JOIN d p ON p.n = src JOIN d q ON q.n = dst, t WHERE NOT (1 - ln(1 + a.df) / ln(1 + total) < 0.2 AND 1 - ln(1 + b.df) / ln(1 + total) < 0.2) AND greatest(p.deg, q.deg) <= 200")
def g30_gated_edges(spark: SparkSession, base: str) -> DataFrame:
    """An edge between two names that say little is skipped, and so is one at a hub of more than 200 edges."""
    m = mentions(spark, base)
    total = m.agg(F.countDistinct("memory_id").alias("total"))
    df = m.groupBy("n").agg(F.count("*").alias("df"))
    edges = entity_edges(spark, base).select("src", "dst")
    return topology.gated(edges, df, total)


# Lineage: from a parent memory to its child.


def _lineage(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "remember_requests").where("parent_id is not null and memory_id is not null")
    return r.select(F.col("parent_id").alias("src"), F.col("memory_id").alias("dst")).where("src <> dst").distinct()


_L = "WITH RECURSIVE l AS (SELECT DISTINCT parent_id AS src, memory_id AS dst FROM remember_requests WHERE parent_id IS NOT NULL AND parent_id <> memory_id)"


@REGISTRY.query("g33_trace_forward", _L + ", s AS (SELECT DISTINCT src AS n FROM l WHERE src LIKE '%7'), t AS (SELECT n AS root, n, 0 AS d FROM s UNION SELECT t.root, l.dst, d + 1 FROM t JOIN l ON l.src = t.n WHERE d < 4) SELECT root, n AS node, min(d) AS depth FROM t GROUP BY ALL")
def g33_trace_forward(spark: SparkSession, base: str) -> DataFrame:
    """From each start (ids that end in 7 here are the ones asked about) what follows from it, to four steps."""
    edges = cut(_lineage(spark, base))
    return graph.reach_from(edges, edges.where("src like '%7'").select(F.col("src").alias("root")).distinct(), 4)


@REGISTRY.query("g34_root_cause", _L + ", t AS (SELECT dst AS leaf, src AS n, 1 AS d FROM l UNION ALL SELECT leaf, l.src, d + 1 FROM t JOIN l ON l.dst = t.n WHERE d < 100) SELECT leaf, n AS root_cause, d AS depth FROM t QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY d DESC, n) = 1")
def g34_root_cause(spark: SparkSession, base: str) -> DataFrame:
    """The last node of the way back from each memory."""
    up = graph.ancestors(table(spark, base, "remember_requests").where("parent_id <> memory_id").select("memory_id", "parent_id").distinct(), "memory_id", "parent_id")
    return up.groupBy(F.col("node").alias("leaf")).agg(F.max_by("ancestor", F.struct("steps", "ancestor")).alias("root_cause"), F.max("steps").alias("depth"))


@REGISTRY.query("g35_causal_origins", _L + ", k AS (SELECT DISTINCT ON (memory_id) memory_id, memory_type FROM remember_requests), t AS (SELECT dst AS leaf, src AS n, 1 AS d FROM l UNION ALL SELECT leaf, l.src, d + 1 FROM t JOIN l ON l.dst = t.n WHERE d < 100) SELECT leaf, n AS origin, d AS depth FROM t JOIN k ON k.memory_id = t.n JOIN k q ON q.memory_id = t.leaf WHERE k.memory_type IN ('Error', 'Decision', 'Discovery') AND q.memory_type = 'Task'")
def g35_causal_origins(spark: SparkSession, base: str) -> DataFrame:
    """Errors, decisions and discoveries that a task goes back to."""
    rows = table(spark, base, "remember_requests").select("memory_id", "parent_id", "memory_type").distinct()
    up = graph.ancestors(rows.where("parent_id <> memory_id"), "memory_id", "parent_id")
    origins = rows.where("memory_type in ('Error', 'Decision', 'Discovery')").select(F.col("memory_id").alias("ancestor"))
    tasks = rows.where("memory_type = 'Task'").select(F.col("memory_id").alias("node"))
    return up.join(origins, "ancestor", "left_semi").join(tasks, "node", "left_semi").select(F.col("node").alias("leaf"), F.col("ancestor").alias("origin"), F.col("steps").alias("depth"))


@REGISTRY.query("g37_subtree", _L + ", p AS (SELECT src FROM l GROUP BY 1 HAVING count(*) >= 2), t AS (SELECT src AS root, src AS n, 0 AS d FROM p UNION SELECT root, l.dst, d + 1 FROM t JOIN l ON l.src = t.n WHERE d < 3) SELECT root, n AS node, min(d) AS depth FROM t GROUP BY ALL")
def g37_subtree(spark: SparkSession, base: str) -> DataFrame:
    """The subtrees, to three steps, of the memories with two children or more."""
    edges = cut(_lineage(spark, base))
    roots = edges.groupBy(F.col("src").alias("root")).agg(F.count("*").alias("n")).where("n >= 2").select("root")
    return graph.reach_from(edges, roots, 3)


@REGISTRY.query("g38_context_of_node", _L + ", t AS (SELECT dst AS node, src AS n, -1 AS d FROM l UNION ALL SELECT node, l.src, d - 1 FROM t JOIN l ON l.dst = t.n WHERE d > -100) SELECT node, n AS other, d AS step FROM t WHERE node LIKE '%3' UNION ALL SELECT src, dst, 1 FROM l WHERE src LIKE '%3' UNION SELECT src, src, 0 FROM l WHERE src LIKE '%3' UNION SELECT dst, dst, 0 FROM l WHERE dst LIKE '%3'")
def g38_context_of_node(spark: SparkSession, base: str) -> DataFrame:
    """Ancestors, the node itself and its children, for the ids that end in 3."""
    edges = cut(_lineage(spark, base))
    up = graph.ancestors(edges, "dst", "src").where("node like '%3'").select("node", F.col("ancestor").alias("other"), (-F.col("steps")).alias("step"))
    asked = edges.where("src like '%3'")
    down = asked.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("step"))
    me = asked.select(F.col("src").alias("node")).union(edges.where("dst like '%3'").select("dst")).distinct().select("node", F.col("node").alias("other"), F.lit(0).alias("step"))
    return up.unionByName(down).unionByName(me)


@REGISTRY.query("g42_layout", "SELECT uuid, round((1 - salience) * 100 * cos(radians((mention_count * 137) % 360)), 4) AS x, round((1 - salience) * 100 * sin(radians((mention_count * 137) % 360)), 4) AS y, round(1 + 4 * salience, 4) AS size, CASE labels[1] WHEN 'PERSON' THEN 'blue' WHEN 'ORGANIZATION' THEN 'orange' WHEN 'LOCATION' THEN 'green' ELSE 'grey' END AS colour FROM graph_entities")
def g42_layout(spark: SparkSession, base: str) -> DataFrame:
    """Salient nodes near the centre and large, the label as colour."""
    s, turn = F.col("salience"), F.radians((F.col("mention_count") * 137) % 360)
    label = F.get("labels", F.lit(0))
    colour = F.when(label == "PERSON", "blue").when(label == "ORGANIZATION", "orange").when(label == "LOCATION", "green").otherwise("grey")
    far = (1 - s) * 100
    return table(spark, base, "graph_entities").select("uuid", F.round(far * F.cos(turn), 4).alias("x"), F.round(far * F.sin(turn), 4).alias("y"), F.round(1 + 4 * s, 4).alias("size"), colour.alias("colour"))


@REGISTRY.query("g43_graph_rows", _EDGES + " SELECT 'node' AS row_kind, n AS a, NULL AS b, count(*)::DOUBLE AS weight FROM k WHERE n IN (SELECT src FROM x WHERE times >= 2 UNION SELECT dst FROM x WHERE times >= 2) GROUP BY 2 UNION ALL SELECT 'edge', src, dst, round(strength, 6) FROM x WHERE times >= 2")
def g43_graph_rows(spark: SparkSession, base: str) -> DataFrame:
    edges = entity_edges(spark, base).where("times >= 2")
    ends = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct()
    nodes = mentions(spark, base).join(ends, "n", "left_semi").groupBy("n").agg(F.count("*").cast("double").alias("weight"))
    none = F.lit(None).cast("string")
    return nodes.select(F.lit("node").alias("row_kind"), F.col("n").alias("a"), none.alias("b"), "weight").unionByName(
        edges.select(F.lit("edge").alias("row_kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.round("strength", 6).alias("weight"))
    )


@REGISTRY.query("g44_canonical_edges", _EDGES + r", c AS (SELECT n, trim(regexp_replace(n, '[^a-z0-9]+', ' ', 'g'), ' ') AS f FROM (SELECT DISTINCT n FROM k)), m AS (SELECT n, min(n) OVER (PARTITION BY f) AS to_n FROM c WHERE f <> '') SELECT least(a.to_n, b.to_n) AS src, greatest(a.to_n, b.to_n) AS dst, sum(times) AS times FROM x JOIN m a ON a.n = src JOIN m b ON b.n = dst WHERE a.to_n <> b.to_n GROUP BY 1, 2")
def g44_canonical_edges(spark: SparkSession, base: str) -> DataFrame:
    """Names that differ in punctuation and spaces are one node; its edges are pointed to it and added up."""
    folded = F.trim(F.regexp_replace("n", "[^a-z0-9]+", " "))
    names = mentions(spark, base).select("n").distinct().select("n", folded.alias("f")).where("f <> ''")
    to = names.join(names.groupBy("f").agg(F.min("n").alias("to_n")), "f").select("n", "to_n")
    e = entity_edges(spark, base).select("src", "dst", "times")
    moved = e.join(to.select(F.col("n").alias("src"), F.col("to_n").alias("s")), "src").join(to.select(F.col("n").alias("dst"), F.col("to_n").alias("d")), "dst").where("s <> d")
    return moved.groupBy(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).agg(F.sum("times").alias("times"))


@REGISTRY.query("a11_graph_stats", _EDGES + " SELECT (SELECT count(DISTINCT n) FROM k) AS entities, (SELECT count(*) FROM x) AS relationships, (SELECT count(DISTINCT episode_id) FROM remember_requests) AS episodes")
def a11_graph_stats(spark: SparkSession, base: str) -> DataFrame:
    counts = [
        mentions(spark, base).select("n").distinct().agg(F.count("*").alias("entities")), entity_edges(spark, base).agg(F.count("*").alias("relationships")),
        table(spark, base, "remember_requests").agg(F.countDistinct("episode_id").alias("episodes")),
    ]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@REGISTRY.query("a12_tier_census", _EDGES + " SELECT tier, times >= 5 AS potentiated, count(*) AS n FROM x GROUP BY ALL")
def a12_tier_census(spark: SparkSession, base: str) -> DataFrame:
    return entity_edges(spark, base).groupBy("tier", (F.col("times") >= 5).alias("potentiated")).agg(F.count("*").alias("n"))


@REGISTRY.query("a13_relation_kinds", "SELECT coalesce(p.memory_type, 'unknown') || '>' || coalesce(c.memory_type, 'unknown') AS relation, count(*) AS n FROM (SELECT DISTINCT memory_id, parent_id, memory_type FROM remember_requests) c JOIN (SELECT DISTINCT memory_id, memory_type FROM remember_requests) p ON c.parent_id = p.memory_id GROUP BY 1")
def a13_relation_kinds(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "remember_requests").select("memory_id", "parent_id", "memory_type").distinct()
    p = r.select(F.col("memory_id").alias("parent_id"), F.col("memory_type").alias("k")).distinct()
    name = lambda c: F.coalesce(c, F.lit("unknown"))
    return r.join(p, "parent_id").groupBy(F.concat(name("k"), F.lit(">"), name("memory_type")).alias("relation")).agg(F.count("*").alias("n"))


@REGISTRY.query("l06_potentiated", "WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events), c AS (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS burst FROM e) SELECT user_id, event_type, max(burst) AS burst FROM c GROUP BY ALL HAVING max(burst) >= 5")
def l06_potentiated(spark: SparkSession, base: str) -> DataFrame:
    """Pairs with five activations or more within some 24 hours."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id", "event_type").orderBy("t").rangeBetween(-86_400_000_000, 0)
    rows = table(spark, base, "events").select("user_id", "event_type", t.alias("t")).withColumn("burst", F.count("*").over(w))
    return rows.groupBy("user_id", "event_type").agg(F.max("burst").alias("burst")).where("burst >= 5")


@REGISTRY.query("l07_consolidated", _EDGES + " SELECT src, dst, times >= 2 AND (epoch_us(last) - epoch_us(first) >= 86400000000 OR times >= 3) AS consolidated FROM x WHERE last IS NOT NULL")
def l07_consolidated(spark: SparkSession, base: str) -> DataFrame:
    """An edge needs a day, or three episodes: a burst in one instant doesn't consolidate it."""
    apart = F.unix_micros("last") - F.unix_micros("first")
    return entity_edges(spark, base).where("last is not null").select("src", "dst", ((F.col("times") >= 2) & ((apart >= 86_400_000_000) | (F.col("times") >= 3))).alias("consolidated"))


@REGISTRY.query("a03_lineage_stats", "WITH l AS (SELECT DISTINCT memory_id, parent_id, memory_type, episode_id FROM remember_requests WHERE parent_id IS NOT NULL) SELECT memory_type AS relation, count(*) AS edges, count(DISTINCT episode_id) AS branches FROM l GROUP BY 1")
def a03_lineage_stats(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "remember_requests").where("parent_id is not null").select("memory_id", "parent_id", "memory_type", "episode_id").distinct()
    return rows.groupBy(F.col("memory_type").alias("relation")).agg(F.count("*").alias("edges"), F.countDistinct("episode_id").alias("branches"))


@REGISTRY.query("z40_entity_index", f"WITH {_MENTIONS} SELECT n AS name, count(*) AS memories, min(memory_id) AS first_memory FROM k GROUP BY 1")
def z40_entity_index(spark: SparkSession, base: str) -> DataFrame:
    return mentions(spark, base).groupBy(F.col("n").alias("name")).agg(F.count("*").alias("memories"), F.min("memory_id").alias("first_memory"))


@REGISTRY.query("w12_top_per_entity", f"WITH {_MENTIONS} SELECT n AS name, memory_id FROM k WHERE created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY n ORDER BY created_at DESC, memory_id) <= 3")
def w12_top_per_entity(spark: SparkSession, base: str) -> DataFrame:
    return ranking.top_per_group(mentions(spark, base).where("created_at is not null"), ["n"], [F.col("created_at").desc(), F.col("memory_id")], 3).select(F.col("n").alias("name"), "memory_id")
