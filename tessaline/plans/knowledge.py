"""Queries over facts, linkage, and the layered recall."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions import scoring
from tessaline.operators import facts, linkage, ranking, retrieval
from tessaline.plans.memories import memories
from tessaline.plans.registry import Registry
from tessaline.runtime import table

REGISTRY = Registry()

_FACTS = r"""
WITH m AS (SELECT DISTINCT memory_id, content, created_at FROM remember_requests),
s AS (SELECT memory_id, created_at, unnest(string_split_regex(regexp_replace(content, '([.!?])\s+', '\1' || chr(10), 'g'), '\n|\s\|\s')) AS s FROM m),
c AS (SELECT memory_id, created_at, trim(regexp_replace(lower(s), '\s+', ' ', 'g'), ' ') AS fact FROM s),
k AS (SELECT * FROM c WHERE len(string_split(fact, ' ')) >= 4 AND length(fact) <= 400),
f AS (SELECT fact, count(DISTINCT memory_id) AS support FROM k GROUP BY 1 HAVING count(DISTINCT memory_id) >= 2)"""


@REGISTRY.query("c04_distilled_facts", _FACTS + " SELECT fact, support, round(1 - pow(0.9, support), 6) AS confidence FROM f")
def c04_distilled_facts(spark: SparkSession, base: str) -> DataFrame:
    return facts.distilled(facts.candidates(memories(spark, base))).select("fact", "support", F.round("confidence", 6).alias("confidence"))


@REGISTRY.query("d19_merge_facts", r"""
SELECT trim(regexp_replace(lower(content), '\s+', ' ', 'g'), ' ') AS fact, min(id) AS survivor, count(*) AS support FROM smoke_corpus WHERE content IS NOT NULL GROUP BY 1""")
def d19_merge_facts(spark: SparkSession, base: str) -> DataFrame:
    from tessaline.functions.text import collapsed

    rows = table(spark, base, "smoke_corpus").where("content is not null")
    return rows.groupBy(collapsed(F.col("content")).alias("fact")).agg(F.min("id").alias("survivor"), F.count("*").alias("support"))


@REGISTRY.query("s27_decaying_facts", _FACTS + """, l AS (SELECT fact, max(created_at) AS last FROM k GROUP BY 1)
SELECT fact FROM f JOIN l USING (fact) WHERE (epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - epoch_us(last)) / 86400e6 > 200""")
def s27_decaying_facts(spark: SparkSession, base: str) -> DataFrame:
    found = facts.distilled(facts.candidates(memories(spark, base)))
    return found.where(scoring.age_days(F.col("last_seen"), F.lit(datetime(2026, 1, 1))) > 200).select("fact")


def _customers(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "graph_entities").select("uuid", "entity_name", F.get("labels", F.lit(0)).alias("label"), F.substring("kb_id", 1, 4).alias("kb"), F.lower(F.left("entity_name", F.lit(4))).alias("head"))


@REGISTRY.query("e02_match_probability")
def e02_match_probability(spark: SparkSession, base: str) -> DataFrame:
    compare = {"name": ("entity_name", linkage.name_level), "label": ("label", linkage.equal_level)}
    return linkage.scored(linkage.pairs(_customers(spark, base), "uuid", "head", compare), list(compare)).select("a", "b", "name", "label", "probability")


@REGISTRY.query("e05_blocked_pairs")
def e05_blocked_pairs(spark: SparkSession, base: str) -> DataFrame:
    compare = {"name": ("entity_name", linkage.name_level)}
    return linkage.pairs(_customers(spark, base), "uuid", "head", compare)


@REGISTRY.query("w03_lateral_inhibition", """
WITH q AS (SELECT q.vec_id AS query_id, e.vec_id, e.embedding::DOUBLE[] AS v, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM q QUALIFY rank <= 50),
p AS (SELECT b.query_id, b.vec_id, sum(a.score * 0.15 * list_cosine_similarity(a.v, b.v)) AS loss FROM t a JOIN t b ON a.query_id = b.query_id AND a.rank < b.rank AND list_cosine_similarity(a.v, b.v) > 0.8 GROUP BY ALL)
SELECT query_id, vec_id, round(score - least(coalesce(loss, 0), 0.5 * score), 6) AS score FROM t LEFT JOIN p USING (query_id, vec_id)""")
def w03_lateral_inhibition(spark: SparkSession, base: str) -> DataFrame:
    """Each of a search's fifty best loses to those above it that are much like it."""
    from tessaline.functions.vectors import cosine

    e = table(spark, base, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    top = retrieval.cosine_top(e, q, "vec_id", "embedding", 50).join(e.select("vec_id", "embedding"), "vec_id")
    above = top.select("query_id", F.col("rank").alias("r"), F.col("similarity").alias("s"), F.col("embedding").alias("x"))
    like = top.join(above, "query_id").where(F.col("r") < F.col("rank")).withColumn("c", cosine(F.col("embedding"), F.col("x"))).where("c > 0.8")
    loss = like.groupBy("query_id", "vec_id").agg(F.sum(F.col("s") * 0.15 * F.col("c")).alias("loss"))
    kept = F.col("similarity") - F.least(F.coalesce("loss", F.lit(0.0)), 0.5 * F.col("similarity"))
    return top.join(loss, ["query_id", "vec_id"], "left").select("query_id", "vec_id", F.round(kept, 6).alias("score"))


@REGISTRY.query("g14_spreading_activation", """
WITH e AS (SELECT DISTINCT memory_id, lower(trim(unnest(list_transform(entities, lambda x: x.text)))) AS item FROM mif_memories), d AS (SELECT item, count(*) AS deg FROM e WHERE item <> '' GROUP BY 1),
s AS (SELECT item FROM d ORDER BY deg DESC, item LIMIT 3), one AS (SELECT e.memory_id, sum(0.7 / sqrt(1 + deg)) AS act FROM s JOIN d USING (item) JOIN e USING (item) GROUP BY 1)
SELECT memory_id, round(act, 6) AS activation FROM one""")
def g14_spreading_activation(spark: SparkSession, base: str) -> DataFrame:
    """From the three most mentioned entities to memories, damped by degree."""
    e = table(spark, base, "mif_memories").select("memory_id", F.explode("entities.text").alias("t")).select("memory_id", F.lower(F.trim("t")).alias("item")).where("item <> ''").distinct()
    seeds = e.groupBy("item").agg(F.count("*").alias("deg")).orderBy(F.col("deg").desc(), "item").limit(3)
    return e.join(F.broadcast(seeds), "item").groupBy("memory_id").agg(F.round(F.sum(0.7 / F.sqrt(1 + F.col("deg"))), 6).alias("activation"))


@REGISTRY.query("x02_relative_dates", """
SELECT request_id, kind, CASE kind WHEN 'yesterday' THEN (requested_at AT TIME ZONE 'UTC')::DATE - 1 WHEN 'week' THEN (requested_at AT TIME ZONE 'UTC')::DATE - 7 WHEN 'month' THEN (date_trunc('month', requested_at AT TIME ZONE 'UTC') - INTERVAL 1 MONTH)::DATE END AS since
FROM recall_requests, (VALUES ('yesterday'), ('week'), ('month')) k(kind) WHERE requested_at IS NOT NULL""")
def x02_relative_dates(spark: SparkSession, base: str) -> DataFrame:
    kinds = F.explode(F.array(F.lit("yesterday"), F.lit("week"), F.lit("month")))
    day = F.to_date("requested_at")
    since = F.when(F.col("kind") == "yesterday", F.date_sub(day, 1)).when(F.col("kind") == "week", F.date_sub(day, 7)).otherwise(F.add_months(F.trunc(day, "month"), -1))
    return table(spark, base, "recall_requests").where("requested_at is not null").select("request_id", "requested_at", kinds.alias("kind")).select("request_id", "kind", since.alias("since"))


@REGISTRY.query("w08_feedback_average", """
WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, value AS m FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, f.m + 0.3 * (r.value - f.m) FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT user_id, round(m, 6) AS momentum FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def w08_feedback_average(spark: SparkSession, base: str) -> DataFrame:
    """The exponential average in closed form: value k of n counts 0.3 * 0.7^(n - k), the first one 0.7^(n - 1). No sequential fold."""
    w = W.partitionBy("user_id")
    rows = table(spark, base, "events").withColumn("back", F.row_number().over(w.orderBy(F.col("ts").desc(), F.col("event_id").desc())) - 1).withColumn("n", F.count("*").over(w))
    share = F.when(F.col("back") == F.col("n") - 1, 1.0).otherwise(0.3) * F.pow(F.lit(0.7), F.col("back").cast("double"))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.col("value") * share), 6).alias("momentum"))
