"""Vector queries: algebra, partitions, product codes, neighbour graphs, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.functions import algebra, vectors
from tessaline.operators import index, retrieval
from tessaline.plans.registry import Registry
from tessaline.runtime import cut, table

REGISTRY = Registry()

_E = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) "
_COS = "list_cosine_similarity"


def stored(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def asked(spark: SparkSession, base: str) -> DataFrame:
    """Every vector whose id is divisible by 50 asks all others."""
    return stored(spark, base).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query_vector"))


@REGISTRY.query("v02_dot", _E + "SELECT a.vec_id, round(list_inner_product(a.v, b.v), 6) AS dot FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def v02_dot(spark: SparkSession, base: str) -> DataFrame:
    """Each vector with the one stored after it."""
    e = stored(spark, base)
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.round(vectors.dot(F.col("v"), F.col("w")), 6).alias("dot"))


@REGISTRY.query("v05_cosine_next", _E + f"SELECT a.vec_id, round({_COS}(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def v05_cosine_next(spark: SparkSession, base: str) -> DataFrame:
    e = stored(spark, base)
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@REGISTRY.query("v11_without_deleted", _E + f", p AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS}(q.v, e.v) AS s FROM e q, e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id AND e.vec_id % 9 <> 0) SELECT query_id, vec_id FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) <= 5")
def v11_without_deleted(spark: SparkSession, base: str) -> DataFrame:
    """Deleted ids (every ninth) are left out before the search."""
    return retrieval.cosine_top(stored(spark, base).where("vec_id % 9 <> 0"), asked(spark, base), "vec_id", "v", 5).select("query_id", "vec_id")


@REGISTRY.query("v13_after_insert", _E + f", n AS (SELECT vec_id + 1000000 AS vec_id, v FROM e WHERE vec_id % 25 = 1 UNION ALL SELECT vec_id, v FROM e), p AS (SELECT q.vec_id AS query_id, n.vec_id, {_COS}(q.v, n.v) AS s FROM e q, n WHERE q.vec_id % 50 = 0 AND n.vec_id <> q.vec_id) SELECT query_id, vec_id FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) <= 5")
def v13_after_insert(spark: SparkSession, base: str) -> DataFrame:
    """New vectors are appended and found at once."""
    e = stored(spark, base)
    new = e.where("vec_id % 25 = 1").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return retrieval.cosine_top(e.unionByName(new), asked(spark, base), "vec_id", "v", 5).select("query_id", "vec_id")


@REGISTRY.query("v15_medoids", """
WITH x AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, 65)) AS d FROM embeddings), c AS (SELECT label, d, avg(x) AS m FROM x GROUP BY ALL),
s AS (SELECT x.label, x.vec_id, sum(pow(x.x - c.m, 2)) AS dist FROM x JOIN c ON c.label = x.label AND c.d = x.d GROUP BY ALL)
SELECT label, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(dist, 9), vec_id) = 1""")
def v15_medoids(spark: SparkSession, base: str) -> DataFrame:
    """The member of each label that is nearest to its mean."""
    return index.medoids(stored(spark, base), "vec_id", "label", "v")


def remembered(spark: SparkSession, base: str) -> DataFrame:
    """(memory_id, v): the usable vectors of memories."""
    rows = table(spark, base, "mif_memories").select("memory_id", F.col("embedding.vector").cast("array<double>").alias("v"))
    return rows.where(algebra.usable(F.col("v"), 64))


def sought(spark: SparkSession, base: str) -> DataFrame:
    """One in fifty of the memories, by a hash of their id, asks all others."""
    return remembered(spark, base).where(F.pmod(F.xxhash64("memory_id"), F.lit(50)) == 0).select(F.col("memory_id").alias("query_id"), F.col("v").alias("query_vector"))


@REGISTRY.query("v16_partitions")
def v16_partitions(spark: SparkSession, base: str) -> DataFrame:
    """The square root of n partitions by k-means, fitted to a bounded sample; every vector is in one."""
    placed, _ = index.partitioned(remembered(spark, base), "memory_id", "v")
    return placed.groupBy("cell").agg(F.count("*").alias("n"))


@REGISTRY.query("v18_probed_search")
def v18_probed_search(spark: SparkSession, base: str) -> DataFrame:
    """The five best of the ten nearest partitions; the tests hold its recall above 0.9."""
    return index.probed(remembered(spark, base), sought(spark, base), "memory_id", "v", 5, probes=10)


@REGISTRY.query("v14_recall_estimate")
def v14_recall_estimate(spark: SparkSession, base: str) -> DataFrame:
    """How much of the exact five best the probed search finds."""
    exact = retrieval.cosine_top(remembered(spark, base), sought(spark, base), "memory_id", "v", 5).select("query_id", "memory_id")
    found = index.probed(remembered(spark, base), sought(spark, base), "memory_id", "v", 5, probes=10).select("query_id", "memory_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "memory_id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"), F.count("*").alias("wanted"))


@REGISTRY.query("v20_product_codes")
def v20_product_codes(spark: SparkSession, base: str) -> DataFrame:
    """Each vector as eight bytes, one for each eighth of it."""
    books = index.product_books(stored(spark, base), "vec_id", "v")
    return index.encoded(stored(spark, base), books, "v").select("vec_id", "codes")


@REGISTRY.query("v23_table_distances")
def v23_table_distances(spark: SparkSession, base: str) -> DataFrame:
    """The five nearest by distances looked up in a table of each query; the tests compare with distances to the decoded vectors."""
    books = index.product_books(stored(spark, base), "vec_id", "v")
    codes = index.encoded(stored(spark, base), books, "v")
    return index.by_table(codes, asked(spark, base), books, "vec_id", 5)


@REGISTRY.query("v21_decoding_error")
def v21_decoding_error(spark: SparkSession, base: str) -> DataFrame:
    books = index.product_books(stored(spark, base), "vec_id", "v")
    back = index.decoded(index.encoded(stored(spark, base), books, "v"), books)
    return back.agg(F.round(F.avg(vectors.squared_distance(F.col("v"), F.col("decoded"))), 4).alias("mean_error"), F.count("*").alias("n"))


@REGISTRY.query("v08_neighbour_graph")
def v08_neighbour_graph(spark: SparkSession, base: str) -> DataFrame:
    """A pruned neighbour graph: of the candidates of each vector those that no kept one is closer to (by a factor of 1.2)."""
    return index.neighbour_graph(stored(spark, base), "vec_id", "v", degree=16, candidates=40).groupBy("src").agg(F.count("*").alias("degree"))


@REGISTRY.query("v09_greedy_search")
def v09_greedy_search(spark: SparkSession, base: str) -> DataFrame:
    """A best-first walk over the neighbour graph for every fiftieth vector; the tests hold its recall above 0.9."""
    e = cut(stored(spark, base))
    return index.greedy(e, index.neighbour_graph(e, "vec_id", "v", degree=16, candidates=40), asked(spark, base), "vec_id", "v", 5)


@REGISTRY.query("v24_backend", "SELECT count(*) AS n, CASE WHEN count(*) < 10000 THEN 'exact' WHEN count(*) < 1000000 THEN 'partitions' ELSE 'codes' END AS backend FROM embeddings")
def v24_backend(spark: SparkSession, base: str) -> DataFrame:
    n = F.count("*")
    return table(spark, base, "embeddings").agg(n.alias("n"), F.when(n < 10_000, "exact").when(n < 1_000_000, "partitions").otherwise("codes").alias("backend"))


@REGISTRY.query("v25_compaction", "SELECT label, count(*) FILTER (WHERE vec_id % 3 = 0) / count(*)::DOUBLE >= 0.3 AS compact FROM embeddings GROUP BY 1")
def v25_compaction(spark: SparkSession, base: str) -> DataFrame:
    """Partitions of which three tenths are deleted (here every third id) are to be rewritten."""
    return table(spark, base, "embeddings").groupBy("label").agg((F.count(F.when(F.col("vec_id") % 3 == 0, 1)) / F.count("*") >= 0.3).alias("compact"))


@REGISTRY.query("v27_hashed_embedding", """
WITH w AS (SELECT id, unnest(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS w FROM smoke_corpus WHERE content IS NOT NULL),
c AS (SELECT id, ('0x' || substr(md5(w), 1, 7))::BIGINT % 32 AS d, count(*)::DOUBLE AS x FROM w GROUP BY ALL), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM c GROUP BY 1)
SELECT c.id, d::INT AS dimension, round(x / n, 6) AS value FROM c JOIN n USING (id)""")
def v27_hashed_embedding(spark: SparkSession, base: str) -> DataFrame:
    """Words hashed into 32 dimensions and normalised: an embedding without a model, as its non-zero entries."""
    words = F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda x: F.length(x) >= 2)
    return algebra.hashed(table(spark, base, "smoke_corpus").where("content is not null").select("id", words.alias("words")), "id", "words", 32)


@REGISTRY.query("v28_best_chunk", _E + f", p AS (SELECT q.vec_id AS query_id, e.vec_id // 4 AS memory, {_COS}(q.v, e.v) AS s FROM e q, e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id), b AS (SELECT query_id, memory, max(round(s, 9)) AS s FROM p GROUP BY ALL) SELECT query_id, memory, round(s, 6) AS similarity FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, memory) <= 5")
def v28_best_chunk(spark: SparkSession, base: str) -> DataFrame:
    """Four vectors are chunks of one memory: the best of them stands for it. Twenty chunks hold the five best memories for certain."""
    found = retrieval.cosine_top(stored(spark, base), asked(spark, base), "vec_id", "v", 20)
    best = found.groupBy("query_id", F.floor(F.col("vec_id") / 4).alias("memory")).agg(F.max(F.round("similarity", 9)).alias("s"))
    from tessaline.operators.ranking import top_per_group

    return top_per_group(best, ["query_id"], [F.col("s").desc(), F.col("memory")], 5).select("query_id", "memory", F.round("s", 6).alias("similarity"))


@REGISTRY.query("v29_projected", _E + ", p AS (SELECT vec_id, list_transform(range(1, 9), lambda i: list_sum(list_transform(range(1, 65), lambda j: v[j] * (((i - 1) * 7 + (j - 1) * 3) % 11 - 5) / 10.0))) AS y FROM e) SELECT vec_id, round(y[1] / sqrt(list_inner_product(y, y)), 6) AS first, round(y[8] / sqrt(list_inner_product(y, y)), 6) AS last FROM p")
def v29_projected(spark: SparkSession, base: str) -> DataFrame:
    """A linear adapter (a matrix that is a parameter), then unit length."""
    matrix = [[((i * 7 + j * 3) % 11 - 5) / 10.0 for j in range(64)] for i in range(8)]
    y = vectors.normalised(algebra.projected(F.col("v"), matrix))
    return stored(spark, base).select("vec_id", y.alias("y")).select("vec_id", F.round(F.get("y", F.lit(0)), 6).alias("first"), F.round(F.get("y", F.lit(7)), 6).alias("last"))


@REGISTRY.query("v30_learnt_adapter")
def v30_learnt_adapter(spark: SparkSession, base: str) -> DataFrame:
    """Pulls what belongs together (one label) and pushes what doesn't: mean updates per round, so that partial sums are all that is shuffled."""
    return algebra.adapter(stored(spark, base), "vec_id", "label", "v")


@REGISTRY.query("v31_attribution", _E + f""", t AS (SELECT a.vec_id, q.v AS q, a.v AS m, b.v AS r FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e q ON q.vec_id = a.vec_id + 2),
x AS (SELECT vec_id, list_transform(range(1, 65), lambda i: m[i] - list_inner_product(m, q) / list_inner_product(q, q) * q[i]) AS a, list_transform(range(1, 65), lambda i: r[i] - list_inner_product(r, q) / list_inner_product(q, q) * q[i]) AS b FROM t)
SELECT vec_id, round(greatest({_COS}(a, b), 0), 6) AS attribution FROM x""")
def v31_attribution(spark: SparkSession, base: str) -> DataFrame:
    """What a memory and a response have in common beyond the question: the cosine of what is left of both without its direction."""
    e = stored(spark, base)
    near = lambda k, name: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("v").alias(name))
    rows = e.join(near(1, "r"), "vec_id").join(near(2, "q"), "vec_id")
    return rows.select("vec_id", F.round(algebra.attribution(F.col("q"), F.col("v"), F.col("r")), 6).alias("attribution"))


@REGISTRY.query("v32_fingerprints", _E + f", s AS (SELECT vec_id, list_transform(range(1, 17), lambda i: v[(i - 1) * 4 + 1]) AS f, label FROM e) SELECT a.vec_id, round(0.6 * CASE WHEN a.label = b.label THEN 1 ELSE 0 END + 0.4 * {_COS}(a.f, b.f), 6) AS similarity FROM s a JOIN s b ON b.vec_id = a.vec_id + 1")
def v32_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    """Sixteen samples of each vector, and the overlap of what it is about (here its label)."""
    e = stored(spark, base).select("vec_id", "label", algebra.sampled(F.col("v"), 16, 64).alias("f"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("l2"), F.col("f").alias("g"))
    return e.join(other, "vec_id").select("vec_id", F.round(0.6 * (F.col("label") == F.col("l2")).cast("int") + 0.4 * vectors.cosine(F.col("f"), F.col("g")), 6).alias("similarity"))


@REGISTRY.query("v33_rebuilt_index", "SELECT count(*) AS stored, count(*) FILTER (WHERE embedding.vector IS NULL OR len(embedding.vector) <> 64) AS unusable FROM mif_memories")
def v33_rebuilt_index(spark: SparkSession, base: str) -> DataFrame:
    v = F.col("embedding.vector")
    return table(spark, base, "mif_memories").agg(F.count("*").alias("stored"), F.count(F.when(v.isNull() | (F.size(v) != 64), 1)).alias("unusable"))


@REGISTRY.query("j02_rows_of_vectors", f"""
WITH g AS (SELECT memory_id, list_transform(embedding.vector, lambda x: x::DOUBLE) AS v FROM mif_memories WHERE len(embedding.vector) = 64 AND len(list_filter(embedding.vector, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding.vector, lambda x: x <> 0)) > 0),
q AS (SELECT * FROM g ORDER BY memory_id LIMIT 20), p AS (SELECT q.memory_id AS query_id, g.memory_id, {_COS}(q.v, g.v) AS s FROM q, g WHERE q.memory_id <> g.memory_id), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, memory_id) <= 10)
SELECT query_id, t.memory_id, r.memory_type FROM t JOIN (SELECT DISTINCT memory_id, memory_type FROM remember_requests WHERE memory_type IS NOT NULL) r ON r.memory_id = t.memory_id""")
def j02_rows_of_vectors(spark: SparkSession, base: str) -> DataFrame:
    """The rows of the ten nearest vectors of the twenty first memories (a list to be asked is a parameter), filtered after the search."""
    good = algebra.usable(F.col("v"), 64)
    g = table(spark, base, "mif_memories").select("memory_id", F.col("embedding.vector").cast("array<double>").alias("v")).where(good)
    q = g.orderBy("memory_id").limit(20).select(F.col("memory_id").alias("query_id"), F.col("v").alias("query_vector"))
    top = retrieval.cosine_top(g, q, "memory_id", "v", 10).select("query_id", "memory_id")
    rows = table(spark, base, "remember_requests").where("memory_type is not null").select("memory_id", "memory_type").distinct()
    return top.join(rows, "memory_id").select("query_id", "memory_id", "memory_type")


@REGISTRY.query("j14_all_but_one", _E + f"SELECT e.vec_id, round({_COS}(e.v, q.v), 6) AS similarity FROM e, (SELECT v FROM e WHERE vec_id = 3) q WHERE e.vec_id <> 3 ORDER BY round({_COS}(e.v, q.v), 9) DESC, e.vec_id LIMIT 10")
def j14_all_but_one(spark: SparkSession, base: str) -> DataFrame:
    e = stored(spark, base)
    q = e.where("vec_id = 3").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query_vector"))
    return retrieval.cosine_top(e, q, "vec_id", "v", 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@REGISTRY.query("j05_similar_pairs", _E + f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS}(a.v, b.v) >= 0.33")
def j05_similar_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of one label whose cosine reaches the threshold: blocks of the label's vectors are multiplied with each other, only pairs above it leave a task."""
    return index.pairs_within(stored(spark, base), "vec_id", "label", "v", 0.33).select("a", "b", F.round("similarity", 6).alias("similarity"))


@REGISTRY.query("g31_clusters", """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.33),
l AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT x AS root, x AS n FROM l UNION SELECT root, y FROM r JOIN l ON l.x = r.n), c AS (SELECT n, min(root) AS c FROM r GROUP BY 1)
SELECT c AS component, count(DISTINCT n) AS members, round((SELECT avg(s) FROM p JOIN c k ON k.n = p.a WHERE k.c = c.c), 6) AS mean_similarity FROM c GROUP BY 1 HAVING count(DISTINCT n) >= 3""")
def g31_clusters(spark: SparkSession, base: str) -> DataFrame:
    """Components of similar pairs with three members or more, and their mean similarity."""
    from tessaline.operators import graph

    pairs = cut(index.pairs_within(stored(spark, base), "vec_id", "label", "v", 0.33))
    parts = graph.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    sizes = parts.groupBy("component").agg(F.count("*").alias("members")).where("members >= 3")
    means = pairs.join(parts.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.round(F.avg("similarity"), 6).alias("mean_similarity"))
    return sizes.join(means, "component").select("component", "members", "mean_similarity")
