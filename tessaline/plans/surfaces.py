"""Further scans and reports: requests, entities, sensors, outcomes, tags and time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions import scoring
from tessaline.operators import ranking
from tessaline.plans.memories import memories
from tessaline.plans.registry import Registry
from tessaline.runtime import table

REGISTRY = Registry()
_M = "WITH m AS (SELECT DISTINCT ON (memory_id) * FROM remember_requests) "


@REGISTRY.query("s11_entity_index", "SELECT DISTINCT lower(trim(e)) AS item, memory_id FROM (SELECT memory_id, unnest(list_transform(entities, lambda x: x.text)) AS e FROM mif_memories) WHERE trim(e) <> ''")
def s11_entity_index(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "mif_memories").select("memory_id", F.explode("entities.text").alias("e"))
    return e.where(F.trim("e") != "").select(F.lower(F.trim("e")).alias("item"), "memory_id").distinct()


@REGISTRY.query("d02_tag_index", "SELECT lower(t) AS tag, count(DISTINCT memory_id) AS memories FROM (SELECT memory_id, unnest(tags) AS t FROM remember_requests) WHERE t IS NOT NULL GROUP BY 1")
def d02_tag_index(spark: SparkSession, base: str) -> DataFrame:
    t = table(spark, base, "remember_requests").select("memory_id", F.explode("tags").alias("t")).where("t is not null")
    return t.select(F.lower("t").alias("tag"), "memory_id").distinct().groupBy("tag").agg(F.count("*").alias("memories"))


@REGISTRY.query("a20_modes", "SELECT recall_mode, count(*) AS n, count(geo_lat) FILTER (WHERE NOT isnan(geo_lat)) AS spatial, count(tags) AS tagged, round(avg(max_results), 6) AS mean_results FROM recall_requests GROUP BY 1")
def a20_modes(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "recall_requests").groupBy("recall_mode").agg(
        F.count("*").alias("n"), F.count(F.when(~F.isnan("geo_lat"), F.col("geo_lat"))).alias("spatial"), F.count("tags").alias("tagged"), F.round(F.avg("max_results"), 6).alias("mean_results")
    )


@REGISTRY.query("q02_session_list", "SELECT session_id, user_id, count(*) AS requests, max(epoch_us(requested_at)) - min(epoch_us(requested_at)) AS micros FROM recall_requests WHERE session_id IS NOT NULL AND requested_at IS NOT NULL GROUP BY ALL")
def q02_session_list(spark: SparkSession, base: str) -> DataFrame:
    at = F.unix_micros("requested_at")
    rows = table(spark, base, "recall_requests").where("session_id is not null and requested_at is not null")
    return rows.groupBy("session_id", "user_id").agg(F.count("*").alias("requests"), (F.max(at) - F.min(at)).alias("micros"))


@REGISTRY.query("k08_best_rewards", _M + "SELECT memory_id, action_type, reward::DOUBLE AS reward FROM m WHERE action_type IS NOT NULL AND NOT isnan(reward) AND reward >= 0 QUALIFY row_number() OVER (PARTITION BY action_type ORDER BY reward DESC, memory_id) <= 5")
def k08_best_rewards(spark: SparkSession, base: str) -> DataFrame:
    rows = memories(spark, base, "action_type is not null and not isnan(reward) and reward >= 0").select("memory_id", "action_type", F.col("reward").cast("double").alias("reward"))
    return ranking.top_per_group(rows, ["action_type"], [F.col("reward").desc(), F.col("memory_id")], 5).drop("rank")


@REGISTRY.query("x19_sensor_means", _M + ", s AS (SELECT robot_id, unnest(map_entries(sensor_data)) AS e FROM m WHERE robot_id IS NOT NULL AND sensor_data IS NOT NULL) SELECT robot_id, e.key AS sensor, count(*) AS n, round(avg(e.value), 6) AS mean FROM s WHERE isfinite(e.value) GROUP BY ALL")
def x19_sensor_means(spark: SparkSession, base: str) -> DataFrame:
    rows = memories(spark, base, "robot_id is not null").select("robot_id", F.explode("sensor_data").alias("sensor", "value"))
    finite = rows.where(~F.isnan("value") & (F.abs("value") < float("inf")))
    return finite.groupBy("robot_id", "sensor").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@REGISTRY.query("x17_tag_overlap", """
WITH q AS (SELECT request_id, user_id, list_sort(list_distinct(list_transform(tags, lambda t: lower(t)))) AS t FROM recall_requests WHERE len(tags) > 0 AND request_id % 50 = 0),
m AS (SELECT DISTINCT memory_id, user_id, list_sort(list_distinct(list_transform(tags, lambda t: lower(t)))) AS t FROM remember_requests WHERE len(tags) > 0)
SELECT request_id, memory_id, round(len(list_intersect(q.t, m.t)) / len(list_distinct(list_concat(q.t, m.t)))::DOUBLE, 6) AS overlap FROM q, m WHERE len(list_intersect(q.t, m.t)) > 0
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(len(list_intersect(q.t, m.t)) / len(list_distinct(list_concat(q.t, m.t)))::DOUBLE, 6) DESC, memory_id) <= 20""")
def x17_tag_overlap(spark: SparkSession, base: str) -> DataFrame:
    """The twenty memories that share most tags with a search (every fiftieth request): joined on tags, so that others never meet."""
    lowered = F.array_sort(F.array_distinct(F.transform("tags", lambda t: F.lower(t))))
    q = table(spark, base, "recall_requests").where((F.size("tags") > 0) & (F.col("request_id") % 50 == 0)).select("request_id", lowered.alias("qt"))
    m = table(spark, base, "remember_requests").where(F.size("tags") > 0).select("memory_id", lowered.alias("mt")).distinct()
    shared = q.select("*", F.explode("qt").alias("t")).join(m.select("memory_id", "mt", F.explode("mt").alias("t")), "t")
    counted = shared.groupBy("request_id", "memory_id", F.size("qt").alias("a"), F.size("mt").alias("b")).agg(F.count("*").alias("k"))
    scored = counted.select("request_id", "memory_id", F.round(F.col("k") / (F.col("a") + F.col("b") - F.col("k")), 6).alias("overlap"))
    return ranking.top_per_group(scored, ["request_id"], [F.col("overlap").desc(), F.col("memory_id")], 20).drop("rank")


@REGISTRY.query("j15_index_integrity", """
SELECT coalesce(s.memory_id, i.memory_id) AS memory_id, CASE WHEN i.memory_id IS NULL THEN 'missing' ELSE 'orphaned' END AS fault
FROM (SELECT DISTINCT memory_id FROM remember_requests WHERE memory_type = 'Decision') s FULL JOIN (SELECT memory_id FROM mif_memories WHERE memory_class = 'Decision') i ON s.memory_id = i.memory_id WHERE s.memory_id IS NULL OR i.memory_id IS NULL""")
def j15_index_integrity(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "remember_requests").where("memory_type = 'Decision'").select("memory_id").distinct().withColumn("stored", F.lit(True))
    i = table(spark, base, "mif_memories").where("memory_class = 'Decision'").select("memory_id").withColumn("indexed", F.lit(True))
    return s.join(i, "memory_id", "full_outer").where("stored is null or indexed is null").select("memory_id", F.when(F.col("indexed").isNull(), "missing").otherwise("orphaned").alias("fault"))


@REGISTRY.query("w14_session_outcomes", """
WITH o AS (SELECT user_id, request_id, requested_at, lead(requested_at) OVER (PARTITION BY user_id ORDER BY requested_at, request_id) AS nxt FROM recall_requests WHERE requested_at IS NOT NULL)
SELECT request_id, CASE WHEN nxt IS NULL THEN 'completed' WHEN epoch_us(nxt) - epoch_us(requested_at) <= 3600000000 THEN 're-engaged' ELSE 'abandoned' END AS outcome FROM o""")
def w14_session_outcomes(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "recall_requests").where("requested_at is not null")
    nxt = F.unix_micros(F.lead("requested_at").over(W.partitionBy("user_id").orderBy("requested_at", "request_id"))) - F.unix_micros("requested_at")
    return rows.select("request_id", F.when(nxt.isNull(), "completed").when(nxt <= 3_600_000_000, "re-engaged").otherwise("abandoned").alias("outcome"))


@REGISTRY.query("r21_signal_fusion", """
SELECT memory_id, round(1 / (1 + exp(-10 * (CASE WHEN decay_rate > 0.65 THEN decay_rate * 1.5 WHEN decay_rate < 0.40 THEN decay_rate * 0.3 ELSE decay_rate END - 0.5))) + least(0.05 * log2(greatest(access_count, 1)), 0.3), 6) AS score FROM mif_memories""")
def r21_signal_fusion(spark: SparkSession, base: str) -> DataFrame:
    use = F.least(0.05 * F.log2(F.greatest("access_count", F.lit(1)).cast("double")), F.lit(0.3))
    return table(spark, base, "mif_memories").select("memory_id", F.round(scoring.sigmoid(scoring.amplified(F.col("decay_rate"))) + use, 6).alias("score"))


@REGISTRY.query("l13_interference", "SELECT event_id, round(least(greatest(1 + 0.5 * (value / 1000.0) * (2 * (event_id % 11) / 10.0 - 1), 0.5), 1.5), 6) AS factor FROM events")
def l13_interference(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select("event_id", F.round(scoring.interference(F.col("value") / 1000.0, (F.col("event_id") % 11) / 10.0), 6).alias("factor"))


@REGISTRY.query("b07_ratio_mismatch", """
WITH g AS (SELECT ('0x' || substr(md5(user_id::VARCHAR || ':ranker'), 1, 7))::BIGINT % 10000 < 5000 AS t FROM (SELECT DISTINCT user_id FROM events)), c AS (SELECT count(*) FILTER (WHERE t) AS a, count(*) FILTER (WHERE NOT t) AS b FROM g)
SELECT a, b, round(pow(a - (a + b) / 2.0, 2) / ((a + b) / 2.0) + pow(b - (a + b) / 2.0, 2) / ((a + b) / 2.0), 6) AS chi_squared FROM c""")
def b07_ratio_mismatch(spark: SparkSession, base: str) -> DataFrame:
    from tessaline.functions import stats

    users = table(spark, base, "events").select("user_id").distinct().select((stats.bucket(F.col("user_id"), "ranker") < 5_000).alias("t"))
    c = users.agg(F.count(F.when(F.col("t"), 1)).alias("a"), F.count(F.when(~F.col("t"), 1)).alias("b"))
    half = (F.col("a") + F.col("b")) / 2.0
    return c.select("a", "b", F.round(F.pow(F.col("a") - half, 2) / half + F.pow(F.col("b") - half, 2) / half, 6).alias("chi_squared"))


@REGISTRY.query("as_of_join", """
WITH m AS (SELECT DISTINCT memory_id, user_id, created_at FROM remember_requests WHERE created_at IS NOT NULL)
SELECT request_id, memory_id FROM recall_requests r JOIN m ON m.user_id = r.user_id AND m.created_at <= r.requested_at
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY m.created_at DESC, memory_id) = 1""")
def as_of_join(spark: SparkSession, base: str) -> DataFrame:
    """The newest memory of the user at the time of each request: both sides are merged by time and the last memory is carried
    forward, so no request meets more than one memory. A hot user is one window, sorted and streamed, never held in memory."""
    m = table(spark, base, "remember_requests").where("created_at is not null").select("memory_id", "user_id", "created_at").distinct()
    stored = m.groupBy("user_id", F.col("created_at").alias("at")).agg(F.min("memory_id").alias("memory_id")).select("user_id", "at", F.lit(0).alias("side"), "memory_id", F.lit(None).cast("bigint").alias("request_id"))
    asked = table(spark, base, "recall_requests").where("requested_at is not null").select("user_id", F.col("requested_at").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("memory_id"), "request_id")
    w = W.partitionBy("user_id").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    carried = stored.unionByName(asked).withColumn("last", F.last("memory_id", ignorenulls=True).over(w))
    return carried.where("side = 1 and last is not null").select("request_id", F.col("last").alias("memory_id"))
