"""Queries of the text and training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm import copies, names, neighbours, packing, pairs, pii, splitting, tokens
from tessaline.llm.spread import once, spread
from tessaline.plans.registry import Registry
from tessaline.runtime import cut, table

REGISTRY = Registry()


@REGISTRY.query("p4_found")
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    members = copies.runs(table(spark, base, "smoke_corpus"), "id", "content")
    return members.where(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("copy_id"))


@REGISTRY.query("p4_records")
def p4_records(spark: SparkSession, base: str) -> DataFrame:
    return copies.copies(table(spark, base, "smoke_corpus"), "id", "content")


#: A pair is reported from so many records, such a share of all records, and so many times its expected number.
P5_RECORDS, P5_SHARE, P5_LIFT = 5, 0.001, 3


def _p5(spark: SparkSession, base: str) -> DataFrame:
    tags = pairs.pair_counts(table(spark, base, "smoke_corpus"), F.col("tags"), P5_RECORDS, P5_SHARE)
    texts = F.transform("entities", lambda e: e["text"])
    entities = pairs.pair_counts(table(spark, base, "mif_memories"), texts, P5_RECORDS, P5_SHARE)
    both = tags.withColumn("field", F.lit("tags")).unionByName(entities.withColumn("field", F.lit("entities")))
    return pairs.above_chance(both, P5_LIFT)


_P5_SQL = r"""
WITH baskets AS (
  SELECT 'tags' AS field, row_number() OVER () AS r, tags AS items FROM smoke_corpus
  UNION ALL SELECT 'entities', row_number() OVER (), list_transform(entities, lambda e: e.text) FROM mif_memories
), total AS (SELECT field, count(*) AS n FROM baskets GROUP BY field
), single AS (
  SELECT DISTINCT field, r, lower(regexp_replace(x, '^[\s\x{00a0}\x{2000}-\x{200a}\x{3000}]+|[\s\x{00a0}\x{2000}-\x{200a}\x{3000}]+$', '', 'g')) AS item
  FROM (SELECT field, r, unnest(items) AS x FROM baskets)
), kept AS (SELECT * FROM single WHERE item <> ''
), marginal AS (SELECT field, item, count(*) AS c FROM kept GROUP BY ALL
), pair AS (
  SELECT x.field, x.item AS item_a, y.item AS item_b, count(*) AS k
  FROM kept x JOIN kept y ON x.field = y.field AND x.r = y.r AND x.item < y.item GROUP BY ALL
), judged AS (
  SELECT p.field, item_a, item_b, k, a.c AS a, b.c AS b, n FROM pair p JOIN total t ON t.field = p.field
  JOIN marginal a ON a.field = p.field AND a.item = item_a JOIN marginal b ON b.field = p.field AND b.item = item_b
  WHERE k >= 5 AND 1000 * k >= n AND k * n >= 3 * a.c * b.c
)"""


@REGISTRY.query("p5_found", _P5_SQL + " SELECT field, item_a, item_b FROM judged")
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return _p5(spark, base).select("field", "item_a", "item_b")


@REGISTRY.query("p5_lift", _P5_SQL + " SELECT field, item_a, item_b, k AS records, round(k::DOUBLE * n / (a * b), 6) AS lift FROM judged")
def p5_lift(spark: SparkSession, base: str) -> DataFrame:
    lift = F.round(F.col("k").cast("double") * F.col("n") / (F.col("a") * F.col("b")), 6)
    return _p5(spark, base).select("field", "item_a", "item_b", F.col("k").alias("records"), lift.alias("lift"))


@REGISTRY.query(
    "p6_found",
    """
WITH good AS (
  SELECT memory_id AS id, list_transform(embedding.vector, lambda x: x::DOUBLE) AS v FROM mif_memories
  WHERE len(embedding.vector) = 64 AND len(list_filter(embedding.vector, lambda x: isfinite(x))) = 64
    AND len(list_filter(embedding.vector, lambda x: x <> 0)) > 0
), ranked AS (
  SELECT a.id AS id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.id) AS r
  FROM good a JOIN good b ON a.id <> b.id
)
SELECT DISTINCT least(id, other) AS memory_a, greatest(id, other) AS memory_b FROM ranked WHERE r <= 5""",
)
def p6_found(spark: SparkSession, base: str) -> DataFrame:
    found = neighbours.nearest(table(spark, base, "mif_memories"), "memory_id", F.col("embedding.vector"))
    return found.select(F.least("id", "other").alias("memory_a"), F.greatest("id", "other").alias("memory_b")).distinct()


@REGISTRY.query("p8_ids")
def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return tokens.token_ids(table(spark, base, "documents"))


def budgets(spark: SparkSession, base: str, purpose: str) -> list[tuple]:
    """The sizes of a purpose: a table of a handful of rows that doesn't grow, checked here."""
    rows = table(spark, base, "token_budgets").where(F.col("purpose") == purpose).orderBy("budget_name").limit(1_001).collect()
    if len(rows) > 1_000:
        raise ValueError("token_budgets has more rows than a parameter table may have")
    return [(r.budget_name, r.capacity_tokens, r.overlap_tokens or 0) for r in rows]


@REGISTRY.query("p9_containers")
def p9_containers(spark: SparkSession, base: str) -> DataFrame:
    sized = cut(tokens.with_token_counts(spread(table(spark, base, "documents").select("doc_id", "text"))).select("doc_id", "n_tokens"))
    return packing.pack(sized, "doc_id", "n_tokens", [b[:2] for b in budgets(spark, base, "container")])


@REGISTRY.query("p10_pieces")
def p10_pieces(spark: SparkSession, base: str) -> DataFrame:
    return splitting.split_texts(table(spark, base, "documents"), "doc_id", "text", budgets(spark, base, "piece"))


def mentions(spark: SparkSession, base: str) -> DataFrame:
    """(table_name, row_id, spelling) of every text of an entity and every requested name."""
    texts = table(spark, base, "mif_memories").select(F.lit("mif_memories").alias("table_name"), F.col("memory_id").alias("row_id"), F.explode("entities.text").alias("spelling"))
    asked = table(spark, base, "find_entity_requests").select(
        F.lit("find_entity_requests").alias("table_name"), F.col("request_id").cast("string").alias("row_id"), F.col("entity_name").alias("spelling")
    )
    return texts.unionByName(asked).where(F.col("spelling").isNotNull())


@REGISTRY.query("p2_found")
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    rows = mentions(spark, base)
    nodes = table(spark, base, "graph_entities").select("uuid", "entity_name", F.get("labels", F.lit(0)).alias("label"))
    links = names.link(rows, nodes.where(F.col("label").isin("PERSON", "ORGANIZATION") & F.col("entity_name").isNotNull()))
    return rows.distinct().join(links, "spelling").select("table_name", "row_id", "spelling", F.col("uuid").alias("entity_uuid"))


def known_names(spark: SparkSession, base: str):
    """The names that the entity table lists."""
    return pii.lexicon(spark, table(spark, base, "graph_entities").select("entity_name", F.get("labels", F.lit(0)).alias("label")))


_P1_TABLES = (("remember_requests", "memory_id"), ("smoke_corpus", "id"))


@REGISTRY.query("p1_found")
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    names_known, out = known_names(spark, base), None
    for name, key in _P1_TABLES:
        found = pii.found_items(table(spark, base, name), key, "content", names_known).withColumn("table_name", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out.select("table_name", "row_id", "kind", "start_pos").distinct()


@REGISTRY.query("p1_redacted")
def p1_redacted(spark: SparkSession, base: str) -> DataFrame:
    names_known, out = known_names(spark, base), None
    for name, key in _P1_TABLES:
        rows = pii.annotate(once(table(spark, base, name).select(key, "content"), key), key, "content", names_known)
        rows = rows.select(F.lit(name).alias("table_name"), "row_id", "redacted", F.size("items").alias("n_items"))
        out = rows if out is None else out.unionByName(rows)
    return out
