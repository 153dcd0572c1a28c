"""The composed filter clause by clause, lookups, pages, and log reads."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions import places, scoring, statements, text
from tessaline.operators import ranking, scans
from tessaline.plans.registry import Registry
from tessaline.runtime import table

REGISTRY = Registry()
AS_OF = datetime(2025, 6, 1)
_NOW = "TIMESTAMPTZ '2025-06-01 00:00:00+00'"
_R = "SELECT DISTINCT memory_id FROM remember_requests WHERE "
_SHOWN = "coalesce(memory_type <> 'Intention', TRUE)"
_HAVERSINE = "2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(geo_location[1] - {0}) / 2), 2) + cos(radians({0})) * cos(radians(geo_location[1])) * pow(sin(radians(geo_location[2] - {1}) / 2), 2))))"


def _ids(name: str, where: str, f: scans.MemoryFilter) -> None:
    """A filter as a query of ids: the predicate is below the deduplication, at the scan."""

    def run(spark: SparkSession, base: str) -> DataFrame:
        return table(spark, base, "remember_requests").where(f.column()).select("memory_id").distinct()

    REGISTRY.query(name, _R + where)(run)


F_ = scans.MemoryFilter
_ids("f01_kinds_given", "memory_type IN ('Intention', 'Task')", F_(kinds=("Intention", "Task")))
_ids("f01_kinds_not_given", _SHOWN, F_())
_ids("f01_importance", f"{_SHOWN} AND importance::DOUBLE >= 0.6", F_(min_importance=0.6))
_ids("f01_since", f"{_SHOWN} AND created_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00'", F_(since=datetime(2025, 3, 1)))
_ids("f01_until", f"{_SHOWN} AND created_at <= TIMESTAMPTZ '2024-05-01 00:00:00+00'", F_(until=datetime(2024, 5, 1)))
_ids("f01_robot", f"{_SHOWN} AND robot_id = 'rb-000'", F_(robot_id="rb-000"))
_ids("f01_mission", f"{_SHOWN} AND mission_id = 'ms-0109'", F_(mission_id="ms-0109"))
_ids("f01_action", f"{_SHOWN} AND action_type = 'dock'", F_(action_type="dock"))
_ids("f01_outcome", f"{_SHOWN} AND outcome_type = 'partial'", F_(outcome_type="partial"))
_ids("f01_terrain", f"{_SHOWN} AND terrain_type = 'urban'", F_(terrain_type="urban"))
_ids("f01_reward", f"{_SHOWN} AND NOT isnan(reward) AND reward::DOUBLE BETWEEN 0.2 AND 0.9", F_(reward=(0.2, 0.9)))
_ids("f01_confidence", f"{_SHOWN} AND NOT isnan(credibility) AND credibility::DOUBLE BETWEEN 0.4 AND 0.8", F_(confidence=(0.4, 0.8), names={"confidence": "credibility"}))
_ids("f01_severity", f"{_SHOWN} AND source_type = 'hook'", F_(severity="hook", names={"severity": "source_type"}))
_ids("f01_pattern", f"{_SHOWN} AND episode_id = 'ep-00-000018'", F_(pattern_id="ep-00-000018", names={"pattern_id": "episode_id"}))
_ids("f01_tags", f"{_SHOWN} AND list_has_any(list_transform(tags, lambda t: lower(t)), ['storage'])", F_(tags=("STORAGE",)))
_ids("f01_anomalies", f"{_SHOWN} AND is_failure", F_(anomalies_only=True, names={"is_anomaly": "is_failure"}))
_ids(
    "f01_all_clauses",
    "memory_type IN ('Observation', 'Decision', 'Error', 'Task') AND importance::DOUBLE >= 0.1 AND created_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00' AND created_at <= TIMESTAMPTZ '2025-12-31 00:00:00+00' AND robot_id = 'rb-000' AND NOT isnan(reward) AND reward::DOUBLE BETWEEN -1 AND 1",
    F_(kinds=("Observation", "Decision", "Error", "Task"), min_importance=0.1, since=datetime(2024, 1, 1), until=datetime(2025, 12, 31), robot_id="rb-000", reward=(-1.0, 1.0)),
)
_ids("s16_mission_equal", "mission_id = 'ms-0088' AND " + _SHOWN, F_(mission_id="ms-0088"))
_ids("s18_action_equal", "action_type = 'grasp' AND " + _SHOWN, F_(action_type="grasp"))


def _memories(spark: SparkSession, base: str, where: Column | str | None = None) -> DataFrame:
    """One row of each memory; the predicate is applied before the deduplication, as redelivered rows differ in `received_at` alone."""
    rows = table(spark, base, "remember_requests")
    return scans.latest(rows if where is None else rows.where(where))


_M = "WITH m AS (SELECT DISTINCT ON (memory_id) * FROM remember_requests) "


@REGISTRY.query("f03_visible", f"SELECT memory_id FROM (SELECT DISTINCT memory_id, created_at, importance FROM remember_requests) WHERE NOT coalesce(created_at < {_NOW} - INTERVAL 400 DAY AND importance::DOUBLE < 0.3, FALSE)")
def f03_visible(spark: SparkSession, base: str) -> DataFrame:
    """What is marked as forgotten (old and of little importance) is hidden from every scan."""
    forgotten = (F.col("created_at") < F.lit(AS_OF) - F.expr("INTERVAL 400 DAYS")) & (F.col("importance").cast("double") < 0.3)
    return _memories(spark, base, ~F.coalesce(forgotten, F.lit(False))).select("memory_id")


@REGISTRY.query("f04_all_criteria", _R + "memory_type = 'Observation' AND list_has_any(list_transform(tags, lambda t: lower(t)), ['rust']) INTERSECT SELECT memory_id FROM remember_requests WHERE importance::DOUBLE >= 0.4")
def f04_all_criteria(spark: SparkSession, base: str) -> DataFrame:
    """The intersection of id sets is the conjunction of their predicates."""
    both = F_(kinds=("Observation",), tags=("rust",)).column() & (F.col("importance").cast("double") >= 0.4)
    return table(spark, base, "remember_requests").where(both).select("memory_id").distinct()


@REGISTRY.query("f05_advanced_search", """
SELECT DISTINCT r.memory_id FROM remember_requests r JOIN (SELECT DISTINCT memory_id FROM (SELECT memory_id, unnest(list_transform(entities, lambda e: e.text)) AS t FROM mif_memories) WHERE contains(lower(t), 'sensor')) e ON e.memory_id = r.memory_id
WHERE created_at BETWEEN TIMESTAMPTZ '2024-03-01 00:00:00+00' AND TIMESTAMPTZ '2025-10-01 00:00:00+00' AND importance::DOUBLE BETWEEN 0.2 AND 0.9""")
def f05_advanced_search(spark: SparkSession, base: str) -> DataFrame:
    named = table(spark, base, "mif_memories").where(F.exists("entities", lambda e: F.lower(e["text"]).contains("sensor"))).select("memory_id")
    rows = table(spark, base, "remember_requests").where(F.col("created_at").between(F.lit(datetime(2024, 3, 1)), F.lit(datetime(2025, 10, 1))) & F.col("importance").cast("double").between(0.2, 0.9))
    return rows.select("memory_id").distinct().join(named, "memory_id", "left_semi")


@REGISTRY.query("f06_robotics_search", f"SELECT DISTINCT memory_id, round({_HAVERSINE.format(50.1, -129.8)}, 3) AS metres FROM remember_requests WHERE {_SHOWN} AND {_HAVERSINE.format(50.1, -129.8)} <= 2000000 AND NOT isnan(reward) AND reward::DOUBLE >= -0.5")
def f06_robotics_search(spark: SparkSession, base: str) -> DataFrame:
    at = lambda i: F.get("geo_location", F.lit(i))
    rows = table(spark, base, "remember_requests").where(F_(reward=(-0.5, 1e300), near=(50.1, -129.8, 2_000_000.0)).column())
    return rows.select("memory_id", F.round(places.haversine(F.lit(50.1), F.lit(-129.8), at(0), at(1)), 3).alias("metres")).distinct()


@REGISTRY.query("f09_context_keywords", "SELECT DISTINCT r.request_id, p.name FROM recall_requests r, (SELECT DISTINCT action_type AS name FROM remember_requests WHERE action_type IS NOT NULL) p WHERE contains(lower(r.query_text), lower(p.name))")
def f09_context_keywords(spark: SparkSession, base: str) -> DataFrame:
    """Which of a list of keywords (here the few action types, counted first) a context contains."""
    words = [r[0] for r in table(spark, base, "remember_requests").where("action_type is not null").select("action_type").distinct().limit(1_001).collect()]
    if len(words) > 1_000:
        raise ValueError("a keyword list has at most 1,000 entries")
    met = F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower("query_text"), F.lower(w)))
    return table(spark, base, "recall_requests").select("request_id", F.explode(met).alias("name")).distinct()


@REGISTRY.query("f10_fact_shaped", f"SELECT id, {statements.FACT_SHAPED_SQL} AS usable FROM smoke_corpus WHERE content IS NOT NULL")
def f10_fact_shaped(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "smoke_corpus").where("content is not null").select("id", statements.fact_shaped(F.col("content")).alias("usable"))


@REGISTRY.query("f11_worth_knowing", f"SELECT id, {statements.WORTHY_SQL} AS worthy FROM smoke_corpus WHERE content IS NOT NULL")
def f11_worth_knowing(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "smoke_corpus").where("content is not null").select("id", statements.worthy(F.col("content")).alias("worthy"))


@REGISTRY.query("f12_no_entity", f"SELECT item, {statements.STRUCTURAL_SQL} AS structural FROM (SELECT DISTINCT trim(entity_name) AS item FROM find_entity_requests WHERE entity_name IS NOT NULL UNION SELECT DISTINCT unnest(string_split_regex(content, '[ \n\r\t]+')) FROM smoke_corpus WHERE content IS NOT NULL)")
def f12_no_entity(spark: SparkSession, base: str) -> DataFrame:
    names = table(spark, base, "find_entity_requests").where("entity_name is not null").select(F.trim("entity_name").alias("item"))
    parts = table(spark, base, "smoke_corpus").where("content is not null").select(F.explode(F.split("content", "[ \\n\\r\\t]+")).alias("item"))
    return names.union(parts).distinct().select("item", statements.structural(F.col("item")).alias("structural"))


@REGISTRY.query("f13_list", _M + ", k AS (SELECT memory_id FROM m WHERE memory_type = 'Observation' AND (contains(lower(content), 'index') OR len(list_filter(tags, lambda t: contains(lower(t), 'index'))) > 0)) SELECT memory_id, (SELECT count(*) FROM k) AS total, (SELECT count(*) FROM k) > 15 AS has_more FROM k ORDER BY memory_id LIMIT 10 OFFSET 5")
def f13_list(spark: SparkSession, base: str) -> DataFrame:
    hit = F.lower("content").contains("index") | F.coalesce(F.exists("tags", lambda t: F.lower(t).contains("index")), F.lit(False))
    return scans.page(table(spark, base, "remember_requests").where((F.col("memory_type") == "Observation") & hit).select("memory_id").distinct(), [F.col("memory_id")], 5, 10)


@REGISTRY.query("f14_expected_labels", """
SELECT r.request_id, e.uuid FROM recall_requests r JOIN (SELECT uuid, entity_name, labels[1] AS label FROM graph_entities) e
ON e.label = CASE WHEN regexp_matches(lower(r.query_text), '^(who|wer|qui|quién)\\b') THEN 'PERSON' WHEN regexp_matches(lower(r.query_text), '^(where|between|wo|où|dónde)\\b') THEN 'LOCATION' END WHERE r.request_id % 50 = 0""")
def f14_expected_labels(spark: SparkSession, base: str) -> DataFrame:
    """The nodes of the label that a question word asks for; requests divisible by 50 ask."""
    q = F.lower("query_text")
    label = F.when(q.rlike(r"^(who|wer|qui|quién)\b"), "PERSON").when(q.rlike(r"^(where|between|wo|où|dónde)\b"), "LOCATION")
    asked = table(spark, base, "recall_requests").where("request_id % 50 = 0").select("request_id", label.alias("label")).where("label is not null")
    return asked.join(table(spark, base, "graph_entities").select("uuid", F.get("labels", F.lit(0)).alias("label")), "label").select("request_id", "uuid")


@REGISTRY.query("s02_partition_scan", "SELECT count(*) AS rows_seen, sum(length(content)) AS characters FROM remember_requests")
def s02_partition_scan(spark: SparkSession, base: str) -> DataFrame:
    """A scan with a callback: a function sees each batch once, nothing is materialised; here it measures."""

    def see(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([pc.sum(pc.utf8_length(b.column("content"))).as_py() or 0], pa.int64())], ["rows", "characters"])

    seen = table(spark, base, "remember_requests").select("content").mapInArrow(see, "rows long, characters long")
    return seen.agg(F.sum("rows").alias("rows_seen"), F.sum("characters").alias("characters"))


@REGISTRY.query("s04_point_lookup", "SELECT DISTINCT memory_id, user_id, content FROM remember_requests WHERE memory_id IN (SELECT memory_id FROM mif_memories WHERE memory_class = 'Pattern')")
def s04_point_lookup(spark: SparkSession, base: str) -> DataFrame:
    """Lookups by primary key, many at once: a semi-join; for one key it is an equality at the scan."""
    keys = table(spark, base, "mif_memories").where("memory_class = 'Pattern'").select("memory_id")
    return table(spark, base, "remember_requests").select("memory_id", "user_id", "content").join(keys, "memory_id", "left_semi").distinct()


@REGISTRY.query("s17_cells", f"""
WITH m AS (SELECT DISTINCT memory_id, geo_location[1] AS lat, geo_location[2] AS lon FROM remember_requests WHERE isfinite(geo_location[1]) AND isfinite(geo_location[2]))
SELECT memory_id, round({_HAVERSINE.format(50.1, -129.8).replace('geo_location[1]', 'lat').replace('geo_location[2]', 'lon')}, 3) AS metres FROM m WHERE {_HAVERSINE.format(50.1, -129.8).replace('geo_location[1]', 'lat').replace('geo_location[2]', 'lon')} <= 20000""")
def s17_cells(spark: SparkSession, base: str) -> DataFrame:
    """Cells of a grid that the circle can touch are compared first (a box at the scan), then the distance."""
    lat, lon = F.get("geo_location", F.lit(0)), F.get("geo_location", F.lit(1))
    box = places.box(50.1, -129.8, 20_000.0, lat, lon)
    rows = table(spark, base, "remember_requests").where(box).select("memory_id", F.round(places.haversine(F.lit(50.1), F.lit(-129.8), lat, lon), 3).alias("metres")).distinct()
    return rows.where("metres <= 20000").orderBy("metres", "memory_id")


@REGISTRY.query("s22_old_and_whole", f"SELECT DISTINCT memory_id FROM remember_requests WHERE created_at < {_NOW} - INTERVAL 30 DAY AND NOT coalesce(importance::DOUBLE < 0.5, FALSE)")
def s22_old_and_whole(spark: SparkSession, base: str) -> DataFrame:
    """Rows older than a cutoff that no summary has replaced (those of little importance have one)."""
    old = (F.col("created_at") < F.lit(AS_OF) - F.expr("INTERVAL 30 DAYS")) & ~F.coalesce(F.col("importance").cast("double") < 0.5, F.lit(False))
    return table(spark, base, "remember_requests").where(old).select("memory_id").distinct()


# Logs: events are the learning and operation log.


@REGISTRY.query("s31_log_range", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events WHERE user_id = 8) WHERE seq BETWEEN 5 AND 14")
def s31_log_range(spark: SparkSession, base: str) -> DataFrame:
    log = table(spark, base, "events").where("user_id = 8")
    return log.orderBy("event_id").offset(4).limit(10).select("event_id", "user_id", "event_type")


@REGISTRY.query("s32_log_sessions", "SELECT DISTINCT session_id FROM recall_requests WHERE session_id IS NOT NULL ORDER BY 1 LIMIT 20 OFFSET 10")
def s32_log_sessions(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "recall_requests").where("session_id is not null").select("session_id").distinct().orderBy("session_id").offset(10).limit(20)


@REGISTRY.query("s33_events_since", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def s33_events_since(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").where("ts >= timestamp_ntz '2024-01-20 00:00:00'").select("event_id")


@REGISTRY.query("s34_events_between", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'")
def s34_events_between(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").where("ts between timestamp_ntz '2024-01-05 00:00:00' and timestamp_ntz '2024-01-09 12:00:00'").select("event_id")


@REGISTRY.query("s35_events_of_memory", "SELECT event_id, ts FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id LIMIT 20")
def s35_events_of_memory(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").where("user_id = 8").orderBy(F.col("ts").desc(), "event_id").limit(20).select("event_id", "ts")


@REGISTRY.query("s36_events_of_fact", "SELECT event_id FROM events WHERE json_extract(props, '$.k')::INT = 42 ORDER BY ts DESC, event_id LIMIT 20")
def s36_events_of_fact(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").where(F.get_json_object("props", "$.k").cast("int") == 42).orderBy(F.col("ts").desc(), "event_id").limit(20).select("event_id")


# Pages and bounded selections.


@REGISTRY.query("k03_page_of_limited", "SELECT id, (SELECT count(*) FROM smoke_corpus) > 50 AS has_more FROM smoke_corpus ORDER BY id LIMIT 20 OFFSET 30")
def k03_page_of_limited(spark: SparkSession, base: str) -> DataFrame:
    """One row more than the page is fetched: it says whether more follow, without a count of all."""
    rows = table(spark, base, "smoke_corpus").select("id").orderBy("id").offset(30).limit(21)
    numbered = rows.withColumn("r", F.row_number().over(W.orderBy("id"))).withColumn("n", F.count("*").over(W.partitionBy()))
    return numbered.where("r <= 20").select("id", (F.col("n") > 20).alias("has_more"))


@REGISTRY.query("k05_recent_first", f"SELECT memory_id, created_at FROM (SELECT DISTINCT memory_id, created_at FROM remember_requests WHERE created_at BETWEEN {_NOW} - INTERVAL 7 DAY AND {_NOW}) ORDER BY created_at DESC, memory_id LIMIT 50")
def k05_recent_first(spark: SparkSession, base: str) -> DataFrame:
    week = F.col("created_at").between(F.lit(AS_OF) - F.expr("INTERVAL 7 DAYS"), F.lit(AS_OF))
    return table(spark, base, "remember_requests").where(week).select("memory_id", "created_at").distinct().orderBy(F.col("created_at").desc(), "memory_id").limit(50)


@REGISTRY.query("k06_nearest_places", f"""
WITH m AS (SELECT DISTINCT memory_id, created_at, {_HAVERSINE.format(50.1, -129.8)} AS d FROM remember_requests WHERE isfinite(geo_location[1]) AND isfinite(geo_location[2]) AND abs(geo_location[1]) <= 90 AND abs(geo_location[2]) <= 180)
SELECT memory_id, round(d, 3) AS metres FROM m ORDER BY d, created_at DESC, memory_id LIMIT 15""")
def k06_nearest_places(spark: SparkSession, base: str) -> DataFrame:
    at = lambda i: F.get("geo_location", F.lit(i))
    ok = at(0).between(-90, 90) & at(1).between(-180, 180) & ~F.isnan(at(0)) & ~F.isnan(at(1))
    rows = table(spark, base, "remember_requests").where(ok).select("memory_id", "created_at", places.haversine(F.lit(50.1), F.lit(-129.8), at(0), at(1)).alias("d")).distinct()
    return rows.orderBy("d", F.col("created_at").desc(), "memory_id").limit(15).select("memory_id", F.round("d", 3).alias("metres"))


@REGISTRY.query("k11_injection", """
WITH r AS (SELECT e.vec_id, max(CASE WHEN q.vec_id % 50 = 0 THEN list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) END) AS s FROM embeddings e, embeddings q WHERE e.vec_id <> q.vec_id AND q.vec_id = 0 GROUP BY 1),
ok AS (SELECT * FROM r WHERE s >= 0.1 AND vec_id % 7 <> 0) SELECT vec_id, round(s, 6) AS relevance FROM ok ORDER BY round(s, 6) DESC, vec_id LIMIT 3""")
def k11_injection(spark: SparkSession, base: str) -> DataFrame:
    """At most three of the rows above the threshold that aren't cooling down (every seventh was shown of late)."""
    from tessaline.functions.vectors import cosine

    e = table(spark, base, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    scored = e.where("vec_id <> 0").crossJoin(F.broadcast(one)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("relevance"))
    cooling = e.where("vec_id % 7 = 0").select("vec_id")
    return scored.where("relevance >= 0.1").join(cooling, "vec_id", "left_anti").orderBy(F.col("relevance").desc(), "vec_id").limit(3)


@REGISTRY.query("k13_by_date", "SELECT memory_id FROM (SELECT DISTINCT memory_id, created_at FROM remember_requests WHERE created_at BETWEEN TIMESTAMPTZ '2024-06-01 00:00:00+00' AND TIMESTAMPTZ '2024-06-30 00:00:00+00') ORDER BY created_at, memory_id LIMIT 25")
def k13_by_date(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "remember_requests").where(F.col("created_at").between(F.lit(datetime(2024, 6, 1)), F.lit(datetime(2024, 6, 30)))).select("memory_id", "created_at").distinct()
    return rows.orderBy("created_at", "memory_id").limit(25).select("memory_id")


@REGISTRY.query("k14_least_recently_used", "SELECT user_id, memory_id FROM mif_memories WHERE updated_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at, access_count, memory_id) <= 3")
def k14_least_recently_used(spark: SparkSession, base: str) -> DataFrame:
    """What each user's bounded tier would drop next."""
    rows = table(spark, base, "mif_memories").where("updated_at is not null").select("user_id", "memory_id", "updated_at", "access_count")
    return ranking.top_per_group(rows, ["user_id"], [F.col("updated_at"), F.col("access_count"), F.col("memory_id")], 3).select("user_id", "memory_id")


@REGISTRY.query("k15_within_bytes", """
WITH m AS (SELECT DISTINCT memory_id, user_id, created_at, coalesce(octet_length(encode(content)), 0) AS b FROM remember_requests WHERE user_id <> 'agent-primary'),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, memory_id ROWS UNBOUNDED PRECEDING) AS used FROM m) SELECT user_id, memory_id, used FROM r WHERE used <= 2000""")
def k15_within_bytes(spark: SparkSession, base: str) -> DataFrame:
    """The newest rows of each user that fit into a byte budget; what is beyond it is evicted."""
    rows = table(spark, base, "remember_requests").where("user_id <> 'agent-primary'").select("memory_id", "user_id", "created_at", F.coalesce(F.octet_length("content"), F.lit(0)).alias("b")).distinct()
    w = W.partitionBy("user_id").orderBy(F.col("created_at").desc_nulls_last(), "memory_id").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("b").over(w)).where("used <= 2000").select("user_id", "memory_id", "used")


@REGISTRY.query("s08_two_days", "SELECT DISTINCT memory_id FROM remember_requests WHERE created_at >= TIMESTAMPTZ '2024-07-01 00:00:00+00' AND created_at < TIMESTAMPTZ '2024-07-03 00:00:00+00'")
def s08_two_days(spark: SparkSession, base: str) -> DataFrame:
    return scans.day_index(table(spark, base, "remember_requests"), date(2024, 7, 1), date(2024, 7, 2)).select("memory_id").distinct()


@REGISTRY.query("x08_time_of_day", "SELECT request_id, CASE WHEN h >= 5 AND h < 8 THEN 'early' WHEN h >= 8 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 17 THEN 'afternoon' WHEN h >= 17 AND h < 21 THEN 'evening' ELSE 'night' END AS part FROM (SELECT request_id, date_part('hour', requested_at AT TIME ZONE 'UTC') AS h FROM recall_requests WHERE requested_at IS NOT NULL)")
def x08_time_of_day(spark: SparkSession, base: str) -> DataFrame:
    h = F.hour("requested_at")
    part = F.when(h.between(5, 7), "early").when(h.between(8, 11), "morning").when(h.between(12, 16), "afternoon").when(h.between(17, 20), "evening").otherwise("night")
    return table(spark, base, "recall_requests").where("requested_at is not null").select("request_id", part.alias("part"))


@REGISTRY.query("a22_recency_boost", _M + f"""
, v AS (SELECT user_id, sum(exp(-h / 168) * CASE memory_type WHEN 'Decision' THEN 2.0 WHEN 'Discovery' THEN 1.5 WHEN 'Error' THEN 1.5 ELSE 1.0 END * 24 / 168) AS speed, bool_or(coalesce(importance::DOUBLE >= 0.9, FALSE)) AS strong FROM (
  SELECT user_id, memory_type, importance, (epoch_us({_NOW}) - epoch_us(created_at)) / 3600e6 AS h FROM m) WHERE h BETWEEN 0 AND 720 GROUP BY 1)
SELECT user_id, round(CASE WHEN speed > 0 THEN least(1 + 0.05 + least(0.05 * speed, 0.15) + CASE WHEN strong THEN 0.1 ELSE 0 END, 1.3) ELSE 1.0 END, 6) AS boost FROM v""")
def a22_recency_boost(spark: SparkSession, base: str) -> DataFrame:
    hours = scoring.age_hours(F.col("created_at"), F.lit(AS_OF))
    weight = F.when(F.col("memory_type") == "Decision", 2.0).when(F.col("memory_type").isin("Discovery", "Error"), 1.5).otherwise(1.0)
    rows = _memories(spark, base, hours.between(0, 720)).withColumn("h", hours)
    v = rows.groupBy("user_id").agg(F.sum(scoring.velocity(F.col("h"), weight, 168.0)).alias("speed"), F.bool_or(F.coalesce(F.col("importance").cast("double") >= 0.9, F.lit(False))).alias("strong"))
    return v.select("user_id", F.round(scoring.recency_boost(F.col("speed"), F.col("strong")), 6).alias("boost"))


@REGISTRY.query("n08_equal_but_for_case", "SELECT min(id) AS id, count(*) AS n FROM smoke_corpus WHERE content IS NOT NULL GROUP BY trim(regexp_replace(lower(content), '\\s+', ' ', 'g'), ' ') HAVING count(*) > 1")
def n08_equal_but_for_case(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "smoke_corpus").where("content is not null").groupBy(text.normalised_hash(F.col("content"))).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1").select("id", "n")
