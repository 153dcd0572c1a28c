"""Jobs and reports: consolidation, promotion, reinforcement, imports and exports of graphs, reminders, streams' triggers, harness reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions import calendar, scoring, stats, text, vectors
from tessaline.operators import graph, ranking, retrieval, scans, topology
from tessaline.plans.graphs import _EDGES, _L, _lineage, entity_edges, mentions
from tessaline.plans.learning import _ARMS, _arms
from tessaline.plans.recall import _GOLD, _TOP, gold_counts, lexical, relevant
from tessaline.plans.registry import Registry
from tessaline.plans.tasks import _T, _TODAY, _today, tasks
from tessaline.runtime import cut, table

REGISTRY = Registry()
AS_OF = datetime(2025, 6, 1)
_NOW = "TIMESTAMPTZ '2025-06-01 00:00:00+00'"
_M = "WITH m AS (SELECT DISTINCT ON (memory_id) * FROM remember_requests) "


def _rows(spark: SparkSession, base: str, where=None) -> DataFrame:
    rows = table(spark, base, "remember_requests")
    return scans.latest(rows if where is None else rows.where(where))


@REGISTRY.query("a04_event_stats", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def a04_event_stats(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@REGISTRY.query("a14_consolidation_report", "SELECT CASE event_type WHEN 'error' THEN 'weakened' WHEN 'purchase' THEN 'strengthened' WHEN 'signup' THEN 'formed' ELSE 'recalled' END AS change, count(*) AS n, round(sum(value), 2) AS amount FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1")
def a14_consolidation_report(spark: SparkSession, base: str) -> DataFrame:
    kind = F.col("event_type")
    change = F.when(kind == "error", "weakened").when(kind == "purchase", "strengthened").when(kind == "signup", "formed").otherwise("recalled")
    rows = table(spark, base, "events").where("ts between timestamp_ntz '2024-01-05 00:00:00' and timestamp_ntz '2024-01-12 00:00:00'")
    return rows.groupBy(change.alias("change")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("amount"))


@REGISTRY.query("a24_ab_summary", _ARMS + "SELECT n1 + n2 AS impressions, x1 + x2 AS successes, round((x1 + x2) / (n1 + n2)::DOUBLE, 8) AS rate FROM s")
def a24_ab_summary(spark: SparkSession, base: str) -> DataFrame:
    n, x = F.col("n1") + F.col("n2"), F.col("x1") + F.col("x2")
    return _arms(spark, base).select(n.alias("impressions"), x.alias("successes"), F.round(x / n, 8).alias("rate"))


@REGISTRY.query("a26_users", "SELECT user_id FROM remember_requests UNION SELECT user_id FROM recall_requests UNION SELECT user_id FROM mif_memories")
def a26_users(spark: SparkSession, base: str) -> DataFrame:
    """The users of all tables, each once."""
    each = [table(spark, base, t).select("user_id").distinct() for t in ("remember_requests", "recall_requests", "mif_memories")]
    return each[0].union(each[1]).union(each[2]).distinct()


@REGISTRY.query("w06_last_clusters", "WITH o AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE WHEN lag(epoch_us(ts)) OVER w IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > 43200000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS c FROM o), g AS (SELECT user_id, c, count(*) AS members FROM s GROUP BY ALL) SELECT user_id, members FROM g WHERE members >= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC) = 1")
def w06_last_clusters(spark: SparkSession, base: str) -> DataFrame:
    """Each user's newest run of events with gaps of half a day at most and two members at least."""
    rows = table(spark, base, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"))
    runs = ranking.sessions(rows, ["user_id"], "at", "event_id", 43_200).groupBy("user_id", "session").agg(F.count("*").alias("members")).where("members >= 2")
    return runs.groupBy("user_id").agg(F.max_by("members", "session").alias("members"))


@REGISTRY.query("w16_next_occurrence", _T + "SELECT task, (due + INTERVAL 14 DAY)::DATE AS next_day FROM t WHERE status = 'done' AND priority = 3")
def w16_next_occurrence(spark: SparkSession, base: str) -> DataFrame:
    return tasks(spark, base).where("status = 'done' and priority = 3").select("task", calendar.next_daily(F.to_date("due"), 14).alias("next_day"))


@REGISTRY.query("k04_paged_recall", _TOP + " SELECT query_id, id, rank FROM top WHERE rank BETWEEN 6 AND 10")
def k04_paged_recall(spark: SparkSession, base: str) -> DataFrame:
    """The second page of five of each search."""
    return lexical(spark, base).where("rank between 6 and 10").select("query_id", "id", "rank")


@REGISTRY.query("j10_lineage_candidates", _M + f"SELECT user_id, memory_id FROM m WHERE created_at BETWEEN {_NOW} - INTERVAL 7 DAY AND {_NOW} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, memory_id) <= 20")
def j10_lineage_candidates(spark: SparkSession, base: str) -> DataFrame:
    """Each user's twenty newest memories of a week."""
    week = F.col("created_at").between(F.lit(AS_OF) - F.expr("INTERVAL 7 DAYS"), F.lit(AS_OF))
    rows = _rows(spark, base, week).select("user_id", "memory_id", "created_at")
    return ranking.top_per_group(rows, ["user_id"], [F.col("created_at").desc(), F.col("memory_id")], 20).select("user_id", "memory_id")


@REGISTRY.query("j20_companions", _EDGES + ", c AS (SELECT k.memory_id, x.src, x.dst FROM x JOIN k ON k.n = x.src JOIN k k2 ON k2.n = x.dst AND k2.memory_id = k.memory_id WHERE x.times BETWEEN 2 AND 50) SELECT DISTINCT a.memory_id AS memory, b.memory_id AS companion FROM c a JOIN c b ON a.src = b.src AND a.dst = b.dst AND a.memory_id <> b.memory_id")
def j20_companions(spark: SparkSession, base: str) -> DataFrame:
    """Memories that stand behind the same edge: of edges that up to fifty memories give, so that none makes more than 2,450 pairs."""
    edges = entity_edges(spark, base).where("times between 2 and 50").select("src", "dst")
    m = mentions(spark, base).select("memory_id", "n")
    cited = edges.join(m.withColumnRenamed("n", "src"), "src").join(m.withColumnRenamed("n", "dst"), ["dst", "memory_id"]).select("src", "dst", "memory_id")
    cited = cut(cited)
    other = cited.withColumnRenamed("memory_id", "companion")
    return cited.join(other, ["src", "dst"]).where("memory_id <> companion").select(F.col("memory_id").alias("memory"), "companion").distinct()


@REGISTRY.query("c16_promoted_to_session", _M + f"SELECT memory_id FROM m WHERE importance::DOUBLE >= 0.35 AND (epoch_us({_NOW}) - epoch_us(created_at)) / 1e6 >= 1800")
def c16_promoted_to_session(spark: SparkSession, base: str) -> DataFrame:
    due = (F.col("importance").cast("double") >= 0.35) & (scoring.age_days(F.col("created_at"), F.lit(AS_OF)) * 86_400 >= 1_800)
    return table(spark, base, "remember_requests").where(due).select("memory_id").distinct()


@REGISTRY.query("c17_promoted_to_long_term", _M + f"SELECT memory_id FROM m WHERE importance::DOUBLE >= 0.5 AND (epoch_us({_NOW}) - epoch_us(created_at)) / 1e6 >= 86400")
def c17_promoted_to_long_term(spark: SparkSession, base: str) -> DataFrame:
    due = (F.col("importance").cast("double") >= 0.5) & (scoring.age_days(F.col("created_at"), F.lit(AS_OF)) >= 1)
    return table(spark, base, "remember_requests").where(due).select("memory_id").distinct()


@REGISTRY.query("c14_maintenance", f"""
WITH m AS (SELECT *, (epoch_us({_NOW}) - epoch_us(created_at)) / 86400e6 AS d FROM mif_memories WHERE created_at IS NOT NULL), p AS (SELECT *, CASE WHEN access_count >= 6 THEN 'L3' WHEN access_count >= 2 THEN 'L2' ELSE 'L1' END AS tier FROM m),
f AS (SELECT *, decay_rate * CASE WHEN d / 30 <= 0 THEN 1.0 WHEN d / 30 < 3 THEN exp(-0.693 * (d / 30)) ELSE exp(-0.693 * 3.0) * pow((d / 30) / 3.0, -0.5) END AS s FROM p)
SELECT memory_id, tier, round(least(1.0, s + CASE WHEN access_count >= 5 THEN 0.1 ELSE 0 END), 6) AS strength, s < 0.01 AND access_count < 5 AS pruned FROM f""")
def c14_maintenance(spark: SparkSession, base: str) -> DataFrame:
    """The steps of a cycle in their order: promote, decay, potentiate, prune."""
    n = F.col("access_count")
    days = scoring.age_days(F.col("created_at"), F.lit(AS_OF))
    promoted = table(spark, base, "mif_memories").where("created_at is not null").withColumn("tier", F.when(n >= 6, "L3").when(n >= 2, "L2").otherwise("L1"))
    decayed = promoted.withColumn("s", F.col("decay_rate") * scoring.forgetting_curve(days / 30))
    return decayed.select("memory_id", "tier", F.round(F.least(F.lit(1.0), F.col("s") + F.when(n >= 5, 0.1).otherwise(0.0)), 6).alias("strength"), ((F.col("s") < 0.01) & (n < 5)).alias("pruned"))


@REGISTRY.query("c13_patterns", "SELECT 'tags' AS pattern, count(*) AS n FROM (SELECT 1 FROM (SELECT list_sort(list_distinct(list_filter(list_transform(tags, lambda t: lower(trim(t))), lambda t: t <> ''))) AS s FROM smoke_corpus) WHERE len(s) >= 2 GROUP BY s HAVING count(*) >= 3) UNION ALL SELECT 'spikes', count(*) FROM (SELECT DISTINCT memory_id FROM remember_requests WHERE importance::DOUBLE > 0.7 OR abs(emotional_valence::DOUBLE) > 0.7)")
def c13_patterns(spark: SparkSession, base: str) -> DataFrame:
    """Triggers of all kinds, counted: repeated item sets and salient memories."""
    items = F.array_sort(F.array_distinct(F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t != "")))
    sets = table(spark, base, "smoke_corpus").select(items.alias("s")).where("size(s) >= 2").groupBy("s").agg(F.count("*").alias("n")).where("n >= 3")
    salient = table(spark, base, "remember_requests").where((F.col("importance").cast("double") > 0.7) | (F.abs(F.col("emotional_valence").cast("double")) > 0.7)).select("memory_id").distinct()
    count = lambda rows, name: rows.agg(F.lit(name).alias("pattern"), F.count("*").alias("n"))
    return count(sets, "tags").unionByName(count(salient, "spikes"))


@REGISTRY.query("c11_summaries", r"SELECT id, trim(string_split(regexp_replace(content, '([.!?])[ \n\r\t]+', '\1' || chr(1), 'g'), chr(1))[1]) AS summary FROM smoke_corpus WHERE content IS NOT NULL AND length(content) > 150")
def c11_summaries(spark: SparkSession, base: str) -> DataFrame:
    """The first sentence of long records."""
    from tessaline.functions.segments import sentences

    return table(spark, base, "smoke_corpus").where("length(content) > 150").select("id", F.trim(F.get(sentences(F.col("content")), F.lit(0))).alias("summary"))


# Graph jobs.


@REGISTRY.query("g20_adaptive_hops", "SELECT uuid, CASE WHEN d > 2.0 THEN 2 WHEN d < 0.5 THEN 4 ELSE 3 END AS hops FROM (SELECT uuid, (mention_count % 30) / 10.0 AS d FROM graph_entities)")
def g20_adaptive_hops(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "graph_entities").select("uuid", scoring.hops((F.col("mention_count") % 30) / 10.0).alias("hops"))


@REGISTRY.query("g22_memories_by_activation", _EDGES + """
, s AS (SELECT n FROM k GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 3), b AS (SELECT src, dst, strength * CASE tier WHEN 'L1' THEN 0.3 ELSE 1.0 END AS w FROM x UNION ALL SELECT dst, src, strength * CASE tier WHEN 'L1' THEN 0.3 ELSE 1.0 END FROM x),
a AS (SELECT n, max(v) AS v FROM (SELECT n, 1.0::DOUBLE AS v FROM s UNION ALL SELECT b.dst, b.w * 0.5 FROM b JOIN s ON s.n = b.src) GROUP BY 1)
SELECT memory_id, round(sum(v), 6) AS score FROM a JOIN k USING (n) GROUP BY 1 QUALIFY row_number() OVER (ORDER BY round(sum(v), 9) DESC, memory_id) <= 50""")
def g22_memories_by_activation(spark: SparkSession, base: str) -> DataFrame:
    """Seeds, their neighbours by the weight of the edge, and the memories that have them: the fifty with most activation."""
    from tessaline.operators.spread import trust

    m = mentions(spark, base).select("memory_id", "n")
    seeds = cut(m.groupBy("n").count().orderBy(F.col("count").desc(), "n").limit(3).select("n"))
    edges = graph.both_ways(entity_edges(spark, base).select("src", "dst", (F.col("strength") * trust(F.col("tier"))).alias("w")))
    near = edges.join(F.broadcast(seeds), F.col("src") == F.col("n")).select(F.col("dst").alias("n"), (F.col("w") * 0.5).alias("v"))
    active = seeds.withColumn("v", F.lit(1.0)).unionByName(near).groupBy("n").agg(F.max("v").alias("v"))
    scored = m.join(active, "n").groupBy("memory_id").agg(F.sum("v").alias("s"))
    return scored.orderBy(F.round("s", 9).desc(), "memory_id").limit(50).select("memory_id", F.round("s", 6).alias("score"))


@REGISTRY.query("g45_rebuilt", _EDGES + " SELECT tier, count(*) AS edges, sum(times)::BIGINT AS episodes FROM x GROUP BY 1")
def g45_rebuilt(spark: SparkSession, base: str) -> DataFrame:
    """The edges recomputed from all memories, by tier."""
    return entity_edges(spark, base).groupBy("tier").agg(F.count("*").alias("edges"), F.sum("times").alias("episodes"))


@REGISTRY.query("l28_adjusted_threshold", _EDGES + ", d AS (SELECT n, count(*) AS c FROM (SELECT src AS n FROM x WHERE tier <> 'L1' UNION ALL SELECT dst FROM x WHERE tier <> 'L1') GROUP BY 1), en AS (SELECT DISTINCT n FROM k) SELECT en.n AS name, round(0.5 * CASE WHEN coalesce(c, 0) >= 5 THEN 0.85 WHEN coalesce(c, 0) >= 2 THEN 0.95 WHEN coalesce(c, 0) = 0 THEN 1.1 ELSE 1.0 END, 6)::DOUBLE AS threshold FROM en LEFT JOIN d USING (n)")
def l28_adjusted_threshold(spark: SparkSession, base: str) -> DataFrame:
    """What is well connected is promoted sooner, what isn't later."""
    strong = topology.degrees(entity_edges(spark, base).where("tier <> 'L1'").select("src", "dst"))
    names = mentions(spark, base).select("n").distinct().join(strong, "n", "left").withColumn("c", F.coalesce("deg", F.lit(0)))
    factor = F.when(F.col("c") >= 5, 0.85).when(F.col("c") >= 2, 0.95).when(F.col("c") == 0, 1.1).otherwise(1.0)
    return names.select(F.col("n").alias("name"), F.round(0.5 * factor, 6).alias("threshold"))


@REGISTRY.query("z14_parent_allowed", _L + ", t AS (SELECT dst AS root, dst AS n, 0 AS d FROM l WHERE dst LIKE '%5' UNION SELECT root, l.dst, d + 1 FROM t JOIN l ON l.src = t.n WHERE d < 100) SELECT l.dst AS memory_id, bool_or(t.n = l.src) AS refused FROM l JOIN t ON t.root = l.dst GROUP BY 1")
def z14_parent_allowed(spark: SparkSession, base: str) -> DataFrame:
    """Whether a memory's parent is among its own descendants (ids that end in 5 are asked about): such a parent is refused."""
    edges = cut(_lineage(spark, base))
    asked = edges.where("dst like '%5'")
    below = graph.reach_from(edges, asked.select(F.col("dst").alias("root")).distinct(), 100)
    return asked.join(below, F.col("dst") == F.col("root")).groupBy(F.col("dst").alias("memory_id")).agg(F.bool_or(F.col("node") == F.col("src")).alias("refused"))


@REGISTRY.query("z22_edges_by_prefix", "SELECT DISTINCT parent_id AS src, memory_id AS dst FROM remember_requests WHERE parent_id IS NOT NULL AND user_id LIKE 'user-%' ORDER BY 1, 2 LIMIT 100")
def z22_edges_by_prefix(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "remember_requests").where("parent_id is not null and user_id like 'user-%'").select(F.col("parent_id").alias("src"), F.col("memory_id").alias("dst")).distinct()
    return rows.orderBy("src", "dst").limit(100)


@REGISTRY.query("z24_confirmed_edges", "SELECT DISTINCT parent_id AS src, memory_id AS dst, round(least(1.0, 0.5 + CASE WHEN importance::DOUBLE >= 0.5 THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS confidence FROM remember_requests WHERE parent_id IS NOT NULL")
def z24_confirmed_edges(spark: SparkSession, base: str) -> DataFrame:
    """Inferred edges of half a confidence; those whose child matters are confirmed and gain."""
    gain = F.when(F.col("importance").cast("double") >= 0.5, 0.3).otherwise(0.0)
    return table(spark, base, "remember_requests").where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("memory_id").alias("dst"), F.round(F.least(F.lit(1.0), 0.5 + gain), 6).alias("confidence")).distinct()


@REGISTRY.query("z84_export_nodes", "SELECT uuid AS id, entity_name AS label, labels[1] AS kind, round(1 + 9 * salience, 4) AS size FROM graph_entities")
def z84_export_nodes(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "graph_entities").select(F.col("uuid").alias("id"), F.col("entity_name").alias("label"), F.get("labels", F.lit(0)).alias("kind"), F.round(1 + 9 * F.col("salience"), 4).alias("size"))


@REGISTRY.query("z85_export_edges", _EDGES + " SELECT src AS source, dst AS target, round(strength, 6) AS weight, tier AS kind FROM x WHERE times >= 2")
def z85_export_edges(spark: SparkSession, base: str) -> DataFrame:
    return entity_edges(spark, base).where("times >= 2").select(F.col("src").alias("source"), F.col("dst").alias("target"), F.round("strength", 6).alias("weight"), F.col("tier").alias("kind"))


@REGISTRY.query("z43_normalised_protection")
def z43_normalised_protection(spark: SparkSession, base: str) -> DataFrame:
    """Protection as a share of the largest one, with the size of each node's component."""
    p = cut(topology.protection(_lineage(spark, base)))
    most = p.agg(F.max("protection").alias("most"))
    return p.crossJoin(F.broadcast(most)).select("node", F.round(F.try_divide("protection", "most"), 6).alias("score"))


@REGISTRY.query("z95_damage_curve")
def z95_damage_curve(spark: SparkSession, base: str) -> DataFrame:
    """How many components are left when the tenth, the fifth and the half of the articulation points with most pieces are removed."""
    edges = cut(_lineage(spark, base))
    cuts = cut(topology.articulation(edges).withColumn("r", F.percent_rank().over(W.orderBy(F.col("pieces").desc(), "node"))))
    out = None
    for share in (0.0, 0.1, 0.2, 0.5):
        gone = cuts.where(F.col("r") < share).select("node")
        left = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        one = graph.components(left).agg(F.lit(share).alias("share"), F.countDistinct("component").alias("components"), F.count("*").alias("nodes"))
        out = one if out is None else out.unionByName(one)
    return out


# Tasks and reminders.


@REGISTRY.query("z80_due_reminders", _T + f"SELECT usr, count(*) AS due FROM t WHERE status = 'open' AND due <= {_TODAY} AND due > {_TODAY} - INTERVAL 30 DAY GROUP BY 1")
def z80_due_reminders(spark: SparkSession, base: str) -> DataFrame:
    return tasks(spark, base).where((F.col("status") == "open") & (F.col("due") <= _today()) & (F.col("due") > _today() - F.expr("INTERVAL 30 DAYS"))).groupBy("usr").agg(F.count("*").alias("due"))


@REGISTRY.query("t23_reminders_emitted", _T + f"SELECT task, due FROM t WHERE status <> 'done' AND due > {_TODAY} - INTERVAL 1 DAY AND due <= {_TODAY}")
def t23_reminders_emitted(spark: SparkSession, base: str) -> DataFrame:
    """What became due since the last poll, a day ago."""
    return tasks(spark, base).where((F.col("status") != "done") & (F.col("due") > _today() - F.expr("INTERVAL 1 DAY")) & (F.col("due") <= _today())).select("task", "due")


@REGISTRY.query("x26_due_by_end_of_day", _T + f"SELECT task FROM t WHERE status <> 'done' AND due >= date_trunc('day', {_TODAY}) AND due < date_trunc('day', {_TODAY}) + INTERVAL 1 DAY")
def x26_due_by_end_of_day(spark: SparkSession, base: str) -> DataFrame:
    start = F.date_trunc("day", _today())
    return tasks(spark, base).where((F.col("status") != "done") & (F.col("due") >= start) & (F.col("due") < start + F.expr("INTERVAL 1 DAY"))).select("task")


@REGISTRY.query("q05_similar_tasks", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS s FROM e q, e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id AND e.vec_id % 2 = 1) SELECT query_id, vec_id FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) <= 3")
def q05_similar_tasks(spark: SparkSession, base: str) -> DataFrame:
    """The three most similar rows of one kind (odd ids)."""
    e = table(spark, base, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query_vector"))
    return retrieval.cosine_top(e.where("vec_id % 2 = 1"), q, "vec_id", "v", 3).select("query_id", "vec_id")


@REGISTRY.query("q03_session_history", "SELECT session_id, 'recall' AS kind, requested_at AS at, request_id::VARCHAR AS id FROM recall_requests WHERE session_id IS NOT NULL AND requested_at IS NOT NULL UNION ALL SELECT episode_id, 'stored', created_at, memory_id FROM (SELECT DISTINCT memory_id, episode_id, created_at FROM remember_requests WHERE episode_id IS NOT NULL AND created_at IS NOT NULL)")
def q03_session_history(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "recall_requests").where("session_id is not null and requested_at is not null").select("session_id", F.lit("recall").alias("kind"), F.col("requested_at").alias("at"), F.col("request_id").cast("string").alias("id"))
    b = table(spark, base, "remember_requests").where("episode_id is not null and created_at is not null").select(F.col("episode_id").alias("session_id"), F.lit("stored").alias("kind"), F.col("created_at").alias("at"), F.col("memory_id").alias("id")).distinct()
    return a.unionByName(b)


# Streams' triggers, as rules over messages in order.

_MSG = "WITH m AS (SELECT DISTINCT ON (memory_id) * FROM remember_requests), o AS (SELECT user_id, memory_id, memory_type, received_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at NULLS FIRST, memory_id) AS k FROM m) "


def _ordered(spark: SparkSession, base: str) -> DataFrame:
    rows = _rows(spark, base).select("user_id", "memory_id", "memory_type", "created_at")
    return rows.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("created_at").asc_nulls_first(), "memory_id")))


@REGISTRY.query("t06_count_trigger", _MSG + "SELECT user_id, memory_id FROM o WHERE k % 50 = 0")
def t06_count_trigger(spark: SparkSession, base: str) -> DataFrame:
    """Every fiftieth message of a user drains the buffer."""
    return _ordered(spark, base).where("k % 50 = 0").select("user_id", "memory_id")


@REGISTRY.query("t07_urgent_trigger", _MSG + "SELECT user_id, memory_id FROM o WHERE memory_type IN ('Error', 'Decision', 'Discovery', 'Learning')")
def t07_urgent_trigger(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "remember_requests").where("memory_type in ('Error', 'Decision', 'Discovery', 'Learning')").select("user_id", "memory_id").distinct()


@REGISTRY.query("t11_injected", "WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS t, value FROM events WHERE value >= 70), l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM c) SELECT user_id, event_id FROM l WHERE before IS NULL OR t - before >= 180000000")
def t11_injected(spark: SparkSession, base: str) -> DataFrame:
    """What is relevant enough is injected unless something was within the three minutes before."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, base, "events").where("value >= 70").select("user_id", "event_id", t.alias("t"))
    rows = rows.withColumn("before", F.lag("t").over(W.partitionBy("user_id").orderBy("t", "event_id")))
    return rows.where("before is null or t - before >= 180000000").select("user_id", "event_id")


@REGISTRY.query("t16_monitored_contexts", "SELECT request_id FROM recall_requests WHERE length(query_text) >= 10 AND len(tags) > 0")
def t16_monitored_contexts(spark: SparkSession, base: str) -> DataFrame:
    """Contexts of less than ten characters are ignored, and so are those that nothing can be found for."""
    return table(spark, base, "recall_requests").where("length(query_text) >= 10 and size(tags) > 0").select("request_id")


@REGISTRY.query("t13_clamped", "SELECT event_id, least(greatest((value * 1000)::BIGINT, 100), 3600000) AS interval_ms, least((value * 200)::BIGINT, 10000) AS buffer FROM events")
def t13_clamped(spark: SparkSession, base: str) -> DataFrame:
    """Settings in sane limits."""
    ms, size = F.round(F.col("value") * 1000).cast("bigint"), F.round(F.col("value") * 200).cast("bigint")
    return table(spark, base, "events").select("event_id", F.least(F.greatest(ms, F.lit(100)), F.lit(3_600_000)).alias("interval_ms"), F.least(size, F.lit(10_000)).alias("buffer"))


@REGISTRY.query("t08_drained_records", _M + f"SELECT memory_id, coalesce(memory_type, 'Observation') AS kind FROM m WHERE content IS NOT NULL AND importance::DOUBLE >= 0.3")
def t08_drained_records(spark: SparkSession, base: str) -> DataFrame:
    """Drained messages that matter, as records with a kind."""
    rows = table(spark, base, "remember_requests").where(F.col("content").isNotNull() & (F.col("importance").cast("double") >= 0.3))
    return rows.select("memory_id", F.coalesce("memory_type", F.lit("Observation")).alias("kind")).distinct()


# Facts, feedback, variants.


@REGISTRY.query("b03_p_values", "SELECT x, CASE WHEN x <= 0 THEN 1.0 WHEN x >= 15.137 THEN 0.0001 WHEN x >= 10.828 THEN greatest(0.001 - (x - 10.828) / (15.137 - 10.828) * 0.0009, 0) WHEN x >= 3.841 THEN greatest(0.05 - (x - 3.841) / (10.828 - 3.841) * 0.049, 0) ELSE 0.05 + (1 - x / 3.841) * 0.95 END AS p FROM (SELECT unnest(range(0, 100)) / 5.0::DOUBLE AS x)")
def b03_p_values(spark: SparkSession, base: str) -> DataFrame:
    return spark.range(0, 100).select((F.col("id") / 5.0).alias("x")).select("x", stats.interpolated_p(F.col("x")).alias("p"))


@REGISTRY.query("z41_variant_weights", "SELECT user_id, CASE WHEN ('0x' || substr(md5(user_id::VARCHAR || ':ranker'), 1, 7))::BIGINT % 10000 < 5000 THEN 'treatment' ELSE 'control' END AS variant FROM (SELECT DISTINCT user_id FROM events)")
def z41_variant_weights(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select("user_id").distinct().select("user_id", F.when(stats.bucket(F.col("user_id"), "ranker") < 5_000, "treatment").otherwise("control").alias("variant"))


@REGISTRY.query("z42_clicks", "SELECT CASE WHEN ('0x' || substr(md5(user_id::VARCHAR || ':ranker'), 1, 7))::BIGINT % 10000 < 5000 THEN 'treatment' ELSE 'control' END AS variant, count(*) AS clicks, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'click' GROUP BY 1")
def z42_clicks(spark: SparkSession, base: str) -> DataFrame:
    variant = F.when(stats.bucket(F.col("user_id"), "ranker") < 5_000, "treatment").otherwise("control")
    return table(spark, base, "events").where("event_type = 'click'").groupBy(variant.alias("variant")).agg(F.count("*").alias("clicks"), F.countDistinct("user_id").alias("users"))


@REGISTRY.query("z37_deferred_credit", "WITH c AS (SELECT user_id, sum((value - 50) / 1000) AS credit FROM events GROUP BY 1) SELECT user_id, round(credit, 6) AS credit FROM c WHERE abs(credit) >= 0.02")
def z37_deferred_credit(spark: SparkSession, base: str) -> DataFrame:
    """Credits added up; sums below a fiftieth change nothing."""
    return table(spark, base, "events").groupBy("user_id").agg(F.sum((F.col("value") - 50) / 1000).alias("c")).where("abs(c) >= 0.02").select("user_id", F.round("c", 6).alias("credit"))


@REGISTRY.query("z32_significant", "SELECT event_type IN ('error', 'purchase', 'signup') AS significant, count(*) AS n FROM events GROUP BY 1")
def z32_significant(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").groupBy(F.col("event_type").isin("error", "purchase", "signup").alias("significant")).agg(F.count("*").alias("n"))


@REGISTRY.query("z30_fact_velocity", f"SELECT memory_class, round(sum(exp(-h / 168) * 24 / 168), 6) AS velocity FROM (SELECT memory_class, (epoch_us({_NOW}) - epoch_us(updated_at)) / 3600e6 AS h FROM mif_memories) WHERE h BETWEEN 0 AND 5000 GROUP BY 1")
def z30_fact_velocity(spark: SparkSession, base: str) -> DataFrame:
    h = scoring.age_hours(F.col("updated_at"), F.lit(AS_OF))
    rows = table(spark, base, "mif_memories").select("memory_class", h.alias("h")).where("h between 0 and 5000")
    return rows.groupBy("memory_class").agg(F.round(F.sum(scoring.velocity(F.col("h"), F.lit(1.0), 168.0)), 6).alias("velocity"))


@REGISTRY.query("z29_merged_contexts", "SELECT session_id, max(robot_id) AS robot_id, max(user_id) AS user_id, count(DISTINCT recall_mode) AS modes FROM recall_requests WHERE session_id IS NOT NULL GROUP BY 1")
def z29_merged_contexts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "recall_requests").where("session_id is not null").groupBy("session_id").agg(F.max("robot_id").alias("robot_id"), F.max("user_id").alias("user_id"), F.countDistinct("recall_mode").alias("modes"))


@REGISTRY.query("z26_fact_edges", "WITH n AS (SELECT memory_id, list_sort(list_distinct(list_filter(list_transform(entities, lambda e: lower(trim(e.text))), lambda t: t IS NOT NULL AND t <> ''))) AS n FROM mif_memories WHERE access_count >= 3) SELECT memory_id, n[1] AS src, n[2] AS dst FROM n WHERE len(n) >= 2")
def z26_fact_edges(spark: SparkSession, base: str) -> DataFrame:
    """Facts that are used give an edge between their first two names."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform("entities", lambda e: F.lower(F.trim(e["text"]))), lambda t: t.isNotNull() & (t != ""))))
    rows = table(spark, base, "mif_memories").where("access_count >= 3").select("memory_id", names.alias("n")).where("size(n) >= 2")
    return rows.select("memory_id", F.get("n", F.lit(0)).alias("src"), F.get("n", F.lit(1)).alias("dst"))


@REGISTRY.query("z97_new_spikes", "SELECT DISTINCT memory_id FROM remember_requests WHERE importance::DOUBLE > 0.7 AND memory_id NOT IN (SELECT memory_id FROM mif_memories)")
def z97_new_spikes(spark: SparkSession, base: str) -> DataFrame:
    """Salient memories that no trigger has used yet."""
    used = table(spark, base, "mif_memories").select("memory_id")
    return table(spark, base, "remember_requests").where(F.col("importance").cast("double") > 0.7).select("memory_id").distinct().join(used, "memory_id", "left_anti")


@REGISTRY.query("z10_tiers_and_counts", "SELECT CASE WHEN access_count >= 6 THEN 'long term' WHEN access_count >= 2 THEN 'session' ELSE 'working' END AS tier, count(*) AS n, round(avg(decay_rate), 6) AS mean_rate FROM mif_memories GROUP BY 1")
def z10_tiers_and_counts(spark: SparkSession, base: str) -> DataFrame:
    n = F.col("access_count")
    tier = F.when(n >= 6, "long term").when(n >= 2, "session").otherwise("working")
    return table(spark, base, "mif_memories").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("decay_rate"), 6).alias("mean_rate"))


@REGISTRY.query("z19_purged_user", "SELECT 'remember_requests' AS tbl, count(*) AS kept FROM remember_requests WHERE coalesce(user_id <> 'agent-primary', TRUE) UNION ALL SELECT 'recall_requests', count(*) FROM recall_requests WHERE coalesce(user_id <> 'agent-primary', TRUE) UNION ALL SELECT 'mif_memories', count(*) FROM mif_memories WHERE coalesce(user_id <> 'agent-primary', TRUE) UNION ALL SELECT 'find_entity_requests', count(*) FROM find_entity_requests WHERE coalesce(user_id <> 'agent-primary', TRUE) UNION ALL SELECT 'documents', count(*) FROM documents WHERE coalesce(user_id <> 'agent-primary', TRUE)")
def z19_purged_user(spark: SparkSession, base: str) -> DataFrame:
    """What every table keeps after one user is purged."""
    out = None
    for name in ("remember_requests", "recall_requests", "mif_memories", "find_entity_requests", "documents"):
        one = table(spark, base, name).where(~F.col("user_id").eqNullSafe("agent-primary")).agg(F.lit(name).alias("tbl"), F.count("*").alias("kept"))
        out = one if out is None else out.unionByName(one)
    return out


# Harness.


@REGISTRY.query("m01_hits_at", _TOP + _GOLD + ", h AS (SELECT gold.query_id, rank FROM gold JOIN top ON top.query_id = gold.query_id AND top.id = item), gq AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) SELECT query_id, coalesce(count(rank) FILTER (WHERE rank <= 5), 0) / 5.0::DOUBLE AS precision_5, round(coalesce(count(rank) FILTER (WHERE rank <= 10), 0) / any_value(n)::DOUBLE, 6) AS recall_10, coalesce(bool_or(rank = 1), FALSE) AS first_is_right, round(coalesce(1.0 / min(rank), 0)::DOUBLE, 6) AS reciprocal FROM gq LEFT JOIN h USING (query_id) GROUP BY 1")
def m01_hits_at(spark: SparkSession, base: str) -> DataFrame:
    """Precision at five, recall at ten, whether the first is right, and the reciprocal rank, by plain counts."""
    n = lambda c: F.count(F.when(c, 1))
    r = F.col("rank")
    hits = relevant(spark, base, lexical(spark, base).select("query_id", "id", "rank")).groupBy("query_id").agg(n(r <= 5).alias("five"), n(r <= 10).alias("ten"), F.min("rank").alias("first"))
    both = gold_counts(spark, base).join(hits, "query_id", "left").fillna(0, ["five", "ten"])
    return both.select(
        "query_id", (F.col("five") / 5.0).alias("precision_5"), F.round(F.col("ten") / F.col("n"), 6).alias("recall_10"), F.coalesce(F.col("first") == 1, F.lit(False)).alias("first_is_right"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal")
    )


@REGISTRY.query("z94_forgetting_report", "WITH m AS (SELECT DISTINCT memory_id, memory_type, importance::DOUBLE AS i FROM remember_requests WHERE importance IS NOT NULL) SELECT memory_type, round(avg(CASE WHEN i >= 0.5 THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS kept, round(avg(i), 6) AS mean_importance FROM m GROUP BY 1")
def z94_forgetting_report(spark: SparkSession, base: str) -> DataFrame:
    """The share of each kind that a threshold keeps."""
    i = F.col("importance").cast("double")
    rows = table(spark, base, "remember_requests").where("importance is not null").select("memory_id", "memory_type", i.alias("i")).distinct()
    return rows.groupBy("memory_type").agg(F.round(F.avg((F.col("i") >= 0.5).cast("double")), 6).alias("kept"), F.round(F.avg("i"), 6).alias("mean_importance"))


@REGISTRY.query("r22_learnt_weights", "SELECT user_id, round(greatest(0.05, 0.3 + 0.05 * (count(*) FILTER (WHERE event_type = 'purchase') - count(*) FILTER (WHERE event_type = 'error')) / 20.0) / (greatest(0.05, 0.3 + 0.05 * (count(*) FILTER (WHERE event_type = 'purchase') - count(*) FILTER (WHERE event_type = 'error')) / 20.0) + 0.7), 6)::DOUBLE AS weight FROM events GROUP BY 1")
def r22_learnt_weights(spark: SparkSession, base: str) -> DataFrame:
    """A leg's weight after a user's feedback: up and down by small steps, never below a twentieth, all weights one together."""
    good, bad = F.count(F.when(F.col("event_type") == "purchase", 1)), F.count(F.when(F.col("event_type") == "error", 1))
    moved = F.greatest(F.lit(0.05), 0.3 + 0.05 * (good - bad) / 20.0)
    return table(spark, base, "events").groupBy("user_id").agg(moved.alias("m")).select("user_id", F.round(F.col("m") / (F.col("m") + 0.7), 6).alias("weight"))


@REGISTRY.query("r20_surfaced", "SELECT uuid, round(0.5 / (1 + exp(-10 * (salience - 0.5))) + 0.3 / (1 + exp(-10 * (least(mention_count / 50.0, 1.0) - 0.5))) + 0.2 / (1 + exp(-10 * (CASE WHEN is_proper_noun THEN 1.0 ELSE 0.0 END - 0.5))), 6) AS score FROM graph_entities WHERE salience >= 0.3 OR mention_count >= 20")
def r20_surfaced(spark: SparkSession, base: str) -> DataFrame:
    """What either signal brings up, by three calibrated scores."""
    s = 0.5 * scoring.sigmoid(F.col("salience")) + 0.3 * scoring.sigmoid(F.least(F.col("mention_count") / 50.0, F.lit(1.0))) + 0.2 * scoring.sigmoid(F.col("is_proper_noun").cast("double"))
    return table(spark, base, "graph_entities").where("salience >= 0.3 or mention_count >= 20").select("uuid", F.round(s, 6).alias("score"))


@REGISTRY.query("r27_by_modality", "SELECT memory_id, CASE len(embedding.vector) WHEN 64 THEN 'text' WHEN 32 THEN 'sound' ELSE 'unknown' END AS modality FROM mif_memories WHERE embedding.vector IS NOT NULL")
def r27_by_modality(spark: SparkSession, base: str) -> DataFrame:
    """The modality that a vector's length tells; only vectors of the asked one are compared (`v11` and `k01` search)."""
    n = F.size("embedding.vector")
    return table(spark, base, "mif_memories").where("embedding.vector is not null").select("memory_id", F.when(n == 64, "text").when(n == 32, "sound").otherwise("unknown").alias("modality"))


@REGISTRY.query("r28_tracked", _TOP + " SELECT query_id, count(*) AS results, string_agg(id, ',' ORDER BY rank) AS ids FROM top WHERE rank <= 5 GROUP BY 1")
def r28_tracked(spark: SparkSession, base: str) -> DataFrame:
    """Each search with the ids it gave, kept for feedback: five at most."""
    rows = lexical(spark, base).where("rank <= 5")
    return rows.groupBy("query_id").agg(F.count("*").alias("results"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]), ",").alias("ids"))


@REGISTRY.query("r29_prefetch_rules", "SELECT request_id, CASE WHEN robot_id IS NOT NULL THEN 'project' WHEN len(tags) > 0 THEN 'entities' WHEN regexp_matches(query_text, '[a-z]+/[a-z]+[.][a-z]+') THEN 'file' ELSE 'time of day' END AS rule FROM recall_requests")
def r29_prefetch_rules(spark: SparkSession, base: str) -> DataFrame:
    """What a context gives to go by: the project, then entities, then a file, then the hour."""
    rule = F.when(F.col("robot_id").isNotNull(), "project").when(F.size("tags") > 0, "entities").when(F.col("query_text").rlike("[a-z]+/[a-z]+[.][a-z]+"), "file").otherwise("time of day")
    return table(spark, base, "recall_requests").select("request_id", rule.alias("rule"))


@REGISTRY.query("x18_united_lists", "SELECT DISTINCT memory_id, len(list_distinct(list_concat(['base', 'rust'], list_transform(list_filter(tags, lambda t: t IS NOT NULL), lambda t: lower(t))))) AS n FROM remember_requests WHERE tags IS NOT NULL")
def x18_united_lists(spark: SparkSession, base: str) -> DataFrame:
    """Two lists as one, each item once, the first list's order first."""
    lowered = F.transform(F.filter("tags", lambda t: t.isNotNull()), lambda t: F.lower(t))
    united = F.array_union(F.array(F.lit("base"), F.lit("rust")), lowered)
    return table(spark, base, "remember_requests").where("tags is not null").select("memory_id", F.size(united).cast("bigint").alias("n")).distinct()


@REGISTRY.query("x21_rendered", "SELECT id, '{\"id\":\"' || id || '\",\"memory_type\":\"' || memory_type || '\"}' AS doc FROM smoke_corpus WHERE memory_type IS NOT NULL")
def x21_rendered(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "smoke_corpus").where("memory_type is not null").select("id", F.to_json(F.struct("id", "memory_type")).alias("doc"))


@REGISTRY.query("l12_time_match", "SELECT event_id, round(CASE WHEN d = 0 THEN 0.5 WHEN d <= 7 THEN 0.3 * (1 - d / 7.0) WHEN d <= 30 THEN 0.1 * (1 - d / 30.0) ELSE 0 END::DOUBLE, 6) AS boost FROM (SELECT event_id, abs(date_diff('day', DATE '2024-01-10', ts::DATE)) AS d FROM events)")
def l12_time_match(spark: SparkSession, base: str) -> DataFrame:
    d = F.date_diff(F.to_date("ts"), F.lit("2024-01-10").cast("date"))
    return table(spark, base, "events").select("event_id", F.round(scoring.temporal_match(d), 6).alias("boost"))


@REGISTRY.query("l18_tool_signals", "WITH q AS (SELECT request_id, request_id % 3 <> 0 AS ok, list_distinct(list_filter(string_split_regex(lower(query_text), '[^a-z0-9]+'), lambda w: length(w) >= 2)) AS t FROM recall_requests WHERE query_text IS NOT NULL), j AS (SELECT request_id, ok, len(list_intersect(t, ['sensor', 'index', 'planner', 'queue'])) / len(list_distinct(list_concat(t, ['sensor', 'index', 'planner', 'queue'])))::DOUBLE AS j FROM q) SELECT request_id, round(CASE WHEN j < 0.08 THEN 0 WHEN ok THEN j ELSE -j END, 6) AS signal FROM j")
def l18_tool_signals(spark: SparkSession, base: str) -> DataFrame:
    """The overlap of a memory's words with a tool's, with the sign of the outcome; little overlap says nothing."""
    tool = F.array(*(F.lit(x) for x in ("sensor", "index", "planner", "queue")))
    rows = table(spark, base, "recall_requests").where("query_text is not null").select("request_id", text.jaccard(text.tokens(F.col("query_text")), tool).alias("j"))
    signed = F.when(F.col("request_id") % 3 != 0, F.col("j")).otherwise(-F.col("j"))
    return rows.select("request_id", F.round(F.when(F.col("j") < 0.08, 0.0).otherwise(signed), 6).alias("signal"))


@REGISTRY.query("v22_lookup_table", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0) SELECT vec_id, p AS part, round(list_sum(list_transform(range(1, 9), lambda i: pow(v[p * 8 + i] - 0.1, 2))), 6) AS distance FROM e, (SELECT unnest(range(0, 8)) AS p)")
def v22_lookup_table(spark: SparkSession, base: str) -> DataFrame:
    """The squared distances of each eighth of a query to a codeword (here 0.1 in every place)."""
    e = table(spark, base, "embeddings").where("vec_id % 50 = 0").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("part"))
    part = F.slice("v", F.col("part") * 8 + 1, F.lit(8))
    return e.select("vec_id", F.col("part").cast("bigint").alias("part"), F.round(vectors.squared_distance(part, F.array_repeat(F.lit(0.1), 8)), 6).alias("distance"))

