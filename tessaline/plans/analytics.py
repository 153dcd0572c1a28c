"""Queries over events, vectors, graphs, requests and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions import scoring, stats, text, vectors
from tessaline.operators import evaluation, graph, overlap, ranking, retrieval
from tessaline.plans.memories import memories
from tessaline.plans.registry import Registry
from tessaline.runtime import table

REGISTRY = Registry()


@REGISTRY.query("a23_zscores", """
WITH b AS (SELECT user_id, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN std > 0 THEN (value - mean) / std ELSE 0 END, 6) AS z FROM events JOIN b USING (user_id) WHERE abs(CASE WHEN std > 0 THEN (value - mean) / std ELSE 0 END) > 2""")
def a23_zscores(spark: SparkSession, base: str) -> DataFrame:
    return ranking.z_scores(table(spark, base, "events"), ["user_id"], "value", 2.0).where("anomaly").select("event_id", F.round("z", 6).alias("z"))


@REGISTRY.query("w07_spikes", """
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM events
QUALIFY abs(value - avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) > 100""")
def w07_spikes(spark: SparkSession, base: str) -> DataFrame:
    rows = ranking.spikes(table(spark, base, "events"), ["user_id"], ["ts", "event_id"], "value", 100.0, 1e12)
    return rows.where("spike").select("event_id", F.round("running_mean", 6).alias("running_mean"))


@REGISTRY.query("w09_trends", """
WITH l AS (SELECT user_id, value, -row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS x FROM events)
SELECT user_id, count(*) AS n, round(regr_slope(value, x), 6) AS slope FROM l WHERE x >= -20 GROUP BY 1 HAVING count(*) >= 3""")
def w09_trends(spark: SparkSession, base: str) -> DataFrame:
    rows = ranking.slopes(table(spark, base, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value")
    return rows.select("user_id", "n", F.round("slope", 6).alias("slope"))


@REGISTRY.query("w05_event_sessions", """
WITH b AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800 * 1000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, session::BIGINT AS session, count(*) AS n FROM (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM b) GROUP BY ALL""")
def w05_event_sessions(spark: SparkSession, base: str) -> DataFrame:
    return ranking.sessions(table(spark, base, "events"), ["user_id"], "ts", "event_id").groupBy("user_id", "session").agg(F.count("*").alias("n"))


@REGISTRY.query("x20_json", "SELECT event_type, count(*) AS n, sum(CAST(props::JSON ->> 'k' AS BIGINT)) AS k FROM events GROUP BY 1")
def x20_json(spark: SparkSession, base: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, base, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@REGISTRY.query("x08_day_parts", "SELECT CASE WHEN hour(ts) BETWEEN 5 AND 7 THEN 'dawn' WHEN hour(ts) BETWEEN 8 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS part, count(*) AS n FROM events GROUP BY 1")
def x08_day_parts(spark: SparkSession, base: str) -> DataFrame:
    h = F.hour("ts")
    part = F.when(h.between(5, 7), "dawn").when(h.between(8, 11), "morning").when(h.between(12, 16), "afternoon").when(h.between(17, 20), "evening").otherwise("night")
    return table(spark, base, "events").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@REGISTRY.query("v01_cosine", "SELECT a.vec_id, b.vec_id AS query_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id")
def v01_cosine(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return e.join(q, F.col("vec_id") != F.col("query_id")).select("vec_id", "query_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@REGISTRY.query("k01_cosine_top", """
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id) <= 10""")
def k01_cosine_top(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.cosine_top(e, q, "vec_id", "embedding", 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@REGISTRY.query("v04_norms", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS squared, abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1e-3 AS unit FROM embeddings")
def v04_norms(spark: SparkSession, base: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, base, "embeddings").select("vec_id", F.round(vectors.squared_norm(e), 6).alias("squared"), vectors.is_unit(e).alias("unit"))


@REGISTRY.query("v17_nearest_centroid", """
WITH c AS (SELECT label, list(avg ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS avg FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY 1)
SELECT vec_id, c.label AS centroid FROM embeddings e, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], c.c), 9), c.label) = 1""")
def v17_nearest_centroid(spark: SparkSession, base: str) -> DataFrame:
    """Labels are a handful, and so are their centroids."""
    e = table(spark, base, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c")).withColumnRenamed("label", "centroid")
    scored = e.crossJoin(F.broadcast(centroids)).select("vec_id", "centroid", F.round(F.sqrt(vectors.squared_distance(F.col("embedding"), F.col("c"))), 9).alias("d"))
    return scored.groupBy("vec_id").agg(F.min_by("centroid", F.struct("d", "centroid")).alias("centroid"))


_BM25 = r"""
WITH d AS (SELECT id, list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda w: w <> '') AS t FROM smoke_corpus),
q AS (SELECT request_id AS query_id, unnest(list_distinct(list_filter(string_split_regex(lower(query_text), '[^a-z0-9]+'), lambda w: w <> ''))) AS term FROM recall_requests WHERE request_id % 50 = 0),
size AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d),
p AS (SELECT id, len(t) AS length, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM p JOIN df USING (term) JOIN q USING (term), size GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)"""


def _asked(spark: SparkSession, base: str) -> DataFrame:
    """The set of searches: every fiftieth request, against all records."""
    return table(spark, base, "recall_requests").where("request_id % 50 = 0").select(F.col("request_id").alias("query_id"), F.col("query_text"))


@REGISTRY.query("r06_bm25", _BM25 + " SELECT query_id, id, rank FROM lexical WHERE rank <= 5")
def r06_bm25(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.bm25(table(spark, base, "smoke_corpus"), _asked(spark, base), "id", "content", 5).select("query_id", "id", "rank")


@REGISTRY.query("w01_reciprocal_ranks", """
WITH a AS (SELECT memory_type AS g, id, row_number() OVER (PARTITION BY memory_type ORDER BY created_at DESC NULLS LAST, id) AS rank FROM smoke_corpus),
b AS (SELECT memory_type AS g, id, row_number() OVER (PARTITION BY memory_type ORDER BY length(content) DESC NULLS LAST, id) AS rank FROM smoke_corpus)
SELECT g, id, round(sum(part), 9) AS score FROM (SELECT g, id, 0.75 / (60 + rank) AS part FROM a UNION ALL SELECT g, id, 0.25 / (60 + rank) FROM b) GROUP BY ALL""")
def w01_reciprocal_ranks(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "smoke_corpus").select(F.col("memory_type").alias("g"), "id", "created_at", F.length("content").alias("size"))
    ranked = lambda c: rows.select("g", "id", F.row_number().over(W.partitionBy("g").orderBy(c, "id")).alias("rank"))
    lists = [(ranked(F.col("created_at").desc_nulls_last()), 3.0), (ranked(F.col("size").desc_nulls_last()), 1.0)]
    return ranking.reciprocal_ranks(lists, ["g", "id"]).withColumn("score", F.round("score", 9))


@REGISTRY.query("w04_competition", """
WITH s AS (SELECT user_id, event_id, value / max(value) OVER (PARTITION BY user_id) AS ratio, value FROM events WHERE value > 0)
SELECT event_id, round(value - CASE WHEN ratio > 0.9 AND ratio < 1 THEN 0.15 * (1 - ratio) * 10 ELSE 0 END, 6) AS competed FROM s""")
def w04_competition(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "events").where("value > 0").withColumnRenamed("value", "score")
    return ranking.compete(rows, ["user_id"]).select("event_id", F.round("competed", 6).alias("competed"))


@REGISTRY.query("g29_pmi", """
WITH b AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS item FROM lineitem), s AS (SELECT item, count(*) AS n FROM b GROUP BY 1), t AS (SELECT count(DISTINCT o) AS total FROM b)
SELECT x.item AS a, y.item AS b, count(*) AS k, round(least(greatest(log2(count(*) * total::DOUBLE / (any_value(p.n) * any_value(q.n))) / log2(total::DOUBLE), 0.1), 1.0), 6) AS weight
FROM b x JOIN b y ON x.o = y.o AND x.item < y.item JOIN s p ON p.item = x.item JOIN s q ON q.item = y.item, t GROUP BY x.item, y.item, total HAVING count(*) >= 5""")
def g29_pmi(spark: SparkSession, base: str) -> DataFrame:
    baskets = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("item")).distinct()
    total = baskets.agg(F.countDistinct("o")).first()[0]
    per = baskets.groupBy("o").agg(F.array_sort(F.collect_list("item")).alias("s"))
    pairs = per.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    counted = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("k")).where("k >= 5")
    singles = baskets.groupBy("item").agg(F.count("*").alias("n"))
    return graph.association(counted, singles, total).select("a", "b", "k", F.round("weight", 6).alias("weight"))


def parent_edges(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "remember_requests").where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("memory_id").alias("dst")).distinct()


@REGISTRY.query("g05_reach", """
WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS src, memory_id AS dst FROM remember_requests WHERE parent_id IS NOT NULL),
seed AS (SELECT DISTINCT src FROM e WHERE src NOT IN (SELECT dst FROM e)), r(node, depth) AS (SELECT src, 0 FROM seed UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def g05_reach(spark: SparkSession, base: str) -> DataFrame:
    edges = parent_edges(spark, base)
    roots = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return graph.reach(edges, roots, 3)


@REGISTRY.query("g36_ancestors", """
WITH RECURSIVE e AS (SELECT DISTINCT memory_id AS k, parent_id AS p FROM remember_requests WHERE parent_id IS NOT NULL),
r(node, ancestor, steps) AS (SELECT k, p, 1 FROM e UNION SELECT r.node, e.p, steps + 1 FROM r JOIN e ON e.k = r.ancestor WHERE steps < 100)
SELECT node, ancestor, min(steps) AS steps FROM r WHERE node <> ancestor GROUP BY ALL""")
def g36_ancestors(spark: SparkSession, base: str) -> DataFrame:
    return graph.ancestors(table(spark, base, "remember_requests"), "memory_id", "parent_id")


@REGISTRY.query("g31_components", """
WITH RECURSIVE e AS (SELECT DISTINCT memory_id AS a, parent_id AS b FROM remember_requests WHERE parent_id IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, other) AS (SELECT a, b FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other)
SELECT node, least(node, min(other)) AS component FROM r GROUP BY node""")
def g31_components(spark: SparkSession, base: str) -> DataFrame:
    return graph.components(parent_edges(spark, base))


_EDGES = "SELECT o_custkey AS src, l_suppkey AS dst, count(*)::DOUBLE AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"


@REGISTRY.query("g16_page_rank", f"""
WITH f AS ({_EDGES}), e AS (SELECT 'c' || src AS src, 's' || dst AS dst, weight FROM f UNION ALL SELECT 's' || dst, 'c' || src, weight FROM f),
t AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e), s AS (SELECT 'c1' AS node, 1.0::DOUBLE AS base UNION ALL SELECT 's1', 1.0),
b AS (SELECT node, base / 2 AS base FROM s),
r1 AS (SELECT coalesce(d, node) AS node, 0.5 * coalesce(base, 0) + 0.5 * coalesce(flow, 0) AS score FROM (SELECT dst AS d, sum(base * share) AS flow FROM b JOIN t ON t.src = node GROUP BY 1) FULL JOIN b ON d = node),
r2 AS (SELECT coalesce(d, node) AS node, 0.5 * coalesce(base, 0) + 0.5 * coalesce(flow, 0) AS score FROM (SELECT dst AS d, sum(score * share) AS flow FROM r1 JOIN t ON t.src = node GROUP BY 1) FULL JOIN b ON d = node),
r3 AS (SELECT coalesce(d, node) AS node, 0.5 * coalesce(base, 0) + 0.5 * coalesce(flow, 0) AS score FROM (SELECT dst AS d, sum(score * share) AS flow FROM r2 JOIN t ON t.src = node GROUP BY 1) FULL JOIN b ON d = node)
SELECT node, round(score, 9) AS score FROM r3""")
def g16_page_rank(spark: SparkSession, base: str) -> DataFrame:
    """Three rounds, as its SQL twin unrolls them; g16_converged_rank has the converged scores."""
    edges, seeds = _sales_graph(spark, base)
    return graph.page_rank(edges, seeds, rounds=3).select("node", F.round("score", 9).alias("score"))


@REGISTRY.query("g16_converged_rank")
def g16_converged_rank(spark: SparkSession, base: str) -> DataFrame:
    edges, seeds = _sales_graph(spark, base)
    return graph.page_rank(edges, seeds, rounds=30, tolerance=1e-6).select("node", F.round("score", 9).alias("score"))


def _sales_graph(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    sold = table(spark, base, "orders").select("o_orderkey", "o_custkey").join(table(spark, base, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    counts = sold.groupBy("o_custkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight"))
    edges = counts.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), "weight")
    seeds = spark.createDataFrame([("c1", 1.0), ("s1", 1.0)], "node string, mass double")
    return graph.both_ways(edges), seeds


@REGISTRY.query("g12_entities", "SELECT entity_name, salience, mention_count, row_number() OVER (ORDER BY salience DESC, mention_count DESC, entity_name) AS rank FROM graph_entities QUALIFY rank <= 100")
def g12_entities(spark: SparkSession, base: str) -> DataFrame:
    top = table(spark, base, "graph_entities").orderBy(F.col("salience").desc(), F.col("mention_count").desc(), "entity_name").limit(100)
    return top.select("entity_name", "salience", "mention_count", F.row_number().over(W.orderBy(F.col("salience").desc(), F.col("mention_count").desc(), "entity_name")).alias("rank"))


@REGISTRY.query("g02_entity_lookup", "SELECT request_id, uuid FROM find_entity_requests JOIN graph_entities ON lower(trim(find_entity_requests.entity_name)) = lower(graph_entities.entity_name)")
def g02_entity_lookup(spark: SparkSession, base: str) -> DataFrame:
    nodes = table(spark, base, "graph_entities").select("uuid", F.lower("entity_name").alias("n"))
    return table(spark, base, "find_entity_requests").select("request_id", F.lower(F.trim("entity_name")).alias("n")).join(nodes, "n").select("request_id", "uuid")


@REGISTRY.query("j06_jaccard_in_episode", """
WITH m AS (SELECT DISTINCT memory_id, episode_id, list_sort(list_distinct(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda w: length(w) >= 2))) AS t FROM remember_requests WHERE episode_id IS NOT NULL AND content IS NOT NULL)
SELECT a.memory_id AS a, b.memory_id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE, 6) AS jaccard FROM m a JOIN m b ON a.episode_id = b.episode_id AND a.memory_id < b.memory_id
WHERE len(list_distinct(list_concat(a.t, b.t))) > 0 AND len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE >= 0.3""")
def j06_jaccard_in_episode(spark: SparkSession, base: str) -> DataFrame:
    """Token sets within an episode; records of one episode meet whole."""
    requests = table(spark, base, "remember_requests").where("episode_id is not null and content is not null")
    rows = requests.select("memory_id", "episode_id", text.tokens(F.col("content")).alias("t")).distinct()
    return overlap.jaccard_in_groups(rows, "memory_id", "episode_id", "t", 0.3, requests.select("episode_id")).select("a", "b", F.round("score", 6).alias("jaccard"))


_AB = """
WITH u AS (SELECT DISTINCT user_id FROM events), g AS (SELECT user_id, ('0x' || substr(md5(user_id::VARCHAR || ':ranker'), 1, 7))::BIGINT % 10000 < 5000 AS treated FROM u),
c AS (SELECT treated, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS hits FROM events JOIN g USING (user_id) GROUP BY 1),
p AS (SELECT max(n) FILTER (WHERE treated) AS n1, max(hits) FILTER (WHERE treated) AS h1, max(n) FILTER (WHERE NOT treated) AS n2, max(hits) FILTER (WHERE NOT treated) AS h2 FROM c)"""


@REGISTRY.query("b02_experiment", _AB + """ SELECT n1, h1, n2, h2, round(CASE WHEN least((n1) * (h1 + h2), n1 * (n1 - h1 + n2 - h2), n2 * (h1 + h2), n2 * (n1 - h1 + n2 - h2)) / (n1 + n2)::DOUBLE >= 5
  THEN (n1 + n2) * pow(h1 * (n2 - h2) - (n1 - h1) * h2, 2) / (n1::DOUBLE * n2 * (h1 + h2) * (n1 - h1 + n2 - h2)) ELSE 0 END, 6) AS chi_squared,
  round(2 * asin(sqrt(h1 / n1::DOUBLE)) - 2 * asin(sqrt(h2 / n2::DOUBLE)), 6) AS cohens_h FROM p""")
def b02_experiment(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events").select("event_type", (stats.bucket(F.col("user_id"), "ranker") < 5_000).alias("treated"))
    hit = F.col("event_type") == "purchase"
    count = lambda c: F.count(F.when(c, 1))
    t = F.col("treated")
    p = e.agg(count(t).alias("n1"), count(t & hit).alias("h1"), count(~t).alias("n2"), count(~t & hit).alias("h2"))
    # An arm without rows has no counts.
    some = lambda c, n: F.when(F.col(n) > 0, F.col(c)).alias(c)
    p = p.select(some("n1", "n1"), some("h1", "n1"), some("n2", "n2"), some("h2", "n2"))
    n1, h1, n2, h2 = (F.col(c) for c in ("n1", "h1", "n2", "h2"))
    return p.select(
        "n1", "h1", "n2", "h2", F.round(stats.chi_squared(h1, n1 - h1, h2, n2 - h2), 6).alias("chi_squared"), F.round(stats.cohens_h(h1 / n1, h2 / n2), 6).alias("cohens_h")
    )


@REGISTRY.query("b01_assignment", "SELECT user_id, ('0x' || substr(md5(user_id::VARCHAR || ':ranker'), 1, 7))::BIGINT % 10000 AS bucket FROM (SELECT DISTINCT user_id FROM events)")
def b01_assignment(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select("user_id").distinct().withColumn("bucket", stats.bucket(F.col("user_id"), "ranker"))


@REGISTRY.query("j16_cooccurrence", """
WITH e AS (SELECT DISTINCT memory_id, lower(trim(unnest(list_transform(entities, lambda x: x.text)))) AS item FROM mif_memories)
SELECT a.item AS item_a, b.item AS item_b, count(*) AS n FROM e a JOIN e b ON a.memory_id = b.memory_id AND a.item < b.item GROUP BY ALL HAVING count(*) >= 3""")
def j16_cooccurrence(spark: SparkSession, base: str) -> DataFrame:
    """Pairs inside one record: a record's entities are an array of a few items, so its pairs are built in place."""
    items = F.array_sort(F.array_distinct(F.filter(F.transform("entities", lambda e: F.lower(F.trim(e["text"]))), lambda t: t.isNotNull())))
    sets = table(spark, base, "mif_memories").select(items.alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("item_a"), y.alias("item_b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.item_a", "p.item_b").agg(F.count("*").alias("n")).where("n >= 3")


@REGISTRY.query("setops_users", "SELECT 'both' AS part, count(*) AS n FROM (SELECT user_id FROM remember_requests INTERSECT SELECT user_id FROM recall_requests) UNION ALL SELECT 'only_stored', count(*) FROM (SELECT user_id FROM remember_requests EXCEPT SELECT user_id FROM recall_requests)")
def setops_users(spark: SparkSession, base: str) -> DataFrame:
    a, b = (table(spark, base, t).select("user_id") for t in ("remember_requests", "recall_requests"))
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "only_stored"))


@REGISTRY.query("rollup_revenue", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_revenue(spark: SparkSession, base: str) -> DataFrame:
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return table(spark, base, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), revenue.alias("revenue"))


@REGISTRY.query("r15_density_weights", """
WITH e AS (SELECT memory_id, coalesce(len(entities), 0) AS k FROM mif_memories), d AS (SELECT memory_id, k / 2.0 AS d FROM e)
SELECT memory_id, round(CASE WHEN d <= 0.5 THEN 0.5 WHEN d >= 2.0 THEN 0.1 ELSE 0.5 - 0.4 * (d - 0.5) / 1.5 END, 6)::DOUBLE AS graph, CASE WHEN d > 2.0 THEN 2 WHEN d < 0.5 THEN 4 ELSE 3 END AS hops FROM d""")
def r15_density_weights(spark: SparkSession, base: str) -> DataFrame:
    d = F.coalesce(F.when(F.col("entities").isNotNull(), F.size("entities")), F.lit(0)) / 2.0
    return table(spark, base, "mif_memories").select("memory_id", F.round(scoring.leg_weights(d)[1], 6).alias("graph"), scoring.hops(d).alias("hops"))


@REGISTRY.query("t12_late_rows", "SELECT (epoch_us(received_at) - epoch_us(created_at)) / 1e6 > 86400 AS late, count(*) AS n FROM remember_requests WHERE created_at IS NOT NULL GROUP BY 1")
def t12_late_rows(spark: SparkSession, base: str) -> DataFrame:
    late = (F.unix_micros("received_at") - F.unix_micros("created_at")) / 1e6 > 86_400
    return table(spark, base, "remember_requests").where("created_at is not null").groupBy(late.alias("late")).agg(F.count("*").alias("n"))


@REGISTRY.query("w02_mode_ranks", """
WITH m AS (SELECT DISTINCT ON (memory_id) * FROM remember_requests WHERE created_at IS NOT NULL),
r AS (SELECT memory_id, importance, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, memory_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC NULLS LAST, memory_id) AS b FROM m)
SELECT memory_id, round(0.7::DOUBLE * (0.5::DOUBLE / a + 0.2::DOUBLE / b) + 0.3::DOUBLE * importance::DOUBLE, 6) AS score FROM r""")
def w02_mode_ranks(spark: SparkSession, base: str) -> DataFrame:
    """Each user's memories by recency and by importance, fused by rank."""
    rows = memories(spark, base).where("created_at is not null").select("user_id", "memory_id", "created_at", "importance")
    rank = lambda c: F.row_number().over(W.partitionBy("user_id").orderBy(c.desc_nulls_last(), "memory_id"))
    fused = 0.5 / rank(F.col("created_at")) + 0.2 / rank(F.col("importance"))
    return rows.select("memory_id", F.round(0.7 * fused + 0.3 * F.col("importance").cast("double"), 6).alias("score"))
