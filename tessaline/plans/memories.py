"""Queries over stored memories: scans, filters, mutations, aggregates, scores."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions import places, scoring, text
from tessaline.operators import ranking, scans
from tessaline.plans.registry import Registry
from tessaline.runtime import table

REGISTRY = Registry()
AS_OF = datetime(2026, 1, 1)
_AS_OF = "TIMESTAMPTZ '2026-01-01 00:00:00+00'"
#: One row of each memory, as SQL.
_M = "WITH m AS (SELECT DISTINCT ON (memory_id) * FROM remember_requests) "
_DAYS = f"((epoch_us({_AS_OF}) - epoch_us(created_at)) / 86400e6)"


def memories(spark: SparkSession, base: str, where=None) -> DataFrame:
    """One row of each memory. A predicate is given as `where`, so that it comes before the deduplication and reaches the scan: redelivered rows
    differ in the time of receipt alone."""
    rows = table(spark, base, "remember_requests")
    return scans.latest(rows if where is None else rows.where(where))


def _scan(name: str, where_sql: str, f: scans.MemoryFilter | None = None, where=None) -> None:
    """A scan that returns ids; the deduplication sees ids only, as the predicate and columns are pushed below it."""

    def run(spark: SparkSession, base: str) -> DataFrame:
        rows = table(spark, base, "remember_requests")
        rows = rows.where(f.column()) if f is not None else where(rows)
        return rows.select("memory_id").distinct()

    REGISTRY.query(name, f"SELECT DISTINCT memory_id FROM remember_requests WHERE {where_sql}")(run)


_NOT_HIDDEN = "coalesce(memory_type <> 'Intention', TRUE)"
_scan("s01_full_scan", "TRUE", where=lambda r: r)
_scan("s06_external_id", "external_id = 'forge:2'", where=lambda r: r.where("external_id = 'forge:2'"))
_scan("s08_day_index", "(created_at AT TIME ZONE 'UTC')::DATE BETWEEN DATE '2024-03-01' AND DATE '2024-03-31'", where=lambda r: scans.day_index(r, date(2024, 3, 1), date(2024, 3, 31)))
_scan("s09_kind", "memory_type = 'Decision'", scans.MemoryFilter(kinds=("Decision",)))
_scan("s10_importance_buckets", "floor(importance::DOUBLE * 10) BETWEEN 3 AND 5", where=lambda r: scans.importance_buckets(r, 0.35, 0.55))
_scan("s12_any_tag", f"list_has_any(list_transform(tags, lambda t: lower(t)), ['rust', 'battery']) AND {_NOT_HIDDEN}", scans.MemoryFilter(tags=("Rust", "battery")))
_scan("s13_episode", f"episode_id = 'ep-00-000018' AND {_NOT_HIDDEN}", scans.MemoryFilter(episode_id="ep-00-000018"))
_scan("s15_robot", f"robot_id = 'rb-009' AND {_NOT_HIDDEN}", scans.MemoryFilter(robot_id="rb-009"))
_scan("s16_mission", "mission_id IS NOT NULL", where=lambda r: r.where("mission_id is not null"))
_scan("s18_action", "action_type IS NOT NULL AND reward::DOUBLE BETWEEN 0 AND 1", where=lambda r: r.where(F.col("action_type").isNotNull() & F.col("reward").cast("double").between(0, 1)))
_scan(
    "s19_reward_buckets", "NOT isnan(reward) AND trunc((least(greatest(reward::DOUBLE, -1), 1) + 1) * 10) BETWEEN trunc((0.25::DOUBLE + 1) * 10) AND trunc((0.75::DOUBLE + 1) * 10)",
    where=lambda r: scans.reward_buckets(r, 0.25, 0.75),
)
_scan("s21_roots", "parent_id IS NULL", where=lambda r: r.where("parent_id is null"))
_scan("f08_contains", "contains(lower(content), 'timeout')", where=lambda r: r.where(text.contains_ignoring_case(F.col("content"), "Timeout")))
_scan("f07_whole_word", "regexp_matches(lower(content), '(^|[^a-z0-9])index($|[^a-z0-9])')", where=lambda r: r.where(text.contains_word(F.col("content"), "index")))
_scan(
    "f01_composed_filter",
    "memory_type IN ('Observation', 'Decision', 'Error') AND importance::DOUBLE >= 0.3 AND created_at >= TIMESTAMPTZ '2024-02-01 00:00:00+00' AND created_at <= TIMESTAMPTZ '2025-06-30 00:00:00+00'",
    scans.MemoryFilter(kinds=("Observation", "Decision", "Error"), min_importance=0.3, since=datetime(2024, 2, 1), until=datetime(2025, 6, 30)),
)
_scan("f01_failures", f"{_NOT_HIDDEN} AND (coalesce(lower(outcome_type) IN ('failure', 'failed', 'error'), FALSE) OR coalesce(is_failure, FALSE))", scans.MemoryFilter(failures_only=True))
_scan(
    "f02_geo_radius",
    f"""{_NOT_HIDDEN} AND 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(geo_location[1] - 50.1) / 2), 2)
      + cos(radians(50.1)) * cos(radians(geo_location[1])) * pow(sin(radians(geo_location[2] + 129.8) / 2), 2)))) <= 20000""",
    scans.MemoryFilter(near=(50.1, -129.8, 20_000.0)),
)


@REGISTRY.query("s07_content_hash", "SELECT DISTINCT memory_id FROM remember_requests WHERE sha256(content) IN (SELECT sha256(content) FROM remember_requests WHERE memory_type = 'Pattern')")
def s07_content_hash(spark: SparkSession, base: str) -> DataFrame:
    known = table(spark, base, "remember_requests").where("memory_type = 'Pattern'").select(text.content_hash(F.col("content")).alias("h"))
    rows = table(spark, base, "remember_requests").select("memory_id", text.content_hash(F.col("content")).alias("h"))
    return rows.join(known, "h", "left_semi").select("memory_id").distinct()


@REGISTRY.query("s14_episode_sequence", _M + "SELECT memory_id, episode_id, sequence_number FROM m WHERE episode_id IS NOT NULL AND sequence_number BETWEEN 5 AND 20")
def s14_episode_sequence(spark: SparkSession, base: str) -> DataFrame:
    rows = memories(spark, base, "episode_id is not null and sequence_number between 5 and 20")
    return rows.orderBy("episode_id", "sequence_number", "memory_id").select("memory_id", "episode_id", "sequence_number")


@REGISTRY.query("s20_children", _M + "SELECT c.memory_id, c.parent_id, p.memory_type AS parent_type FROM m c JOIN m p ON c.parent_id = p.memory_id")
def s20_children(spark: SparkSession, base: str) -> DataFrame:
    rows = memories(spark, base)
    parents = rows.select(F.col("memory_id").alias("parent_id"), F.col("memory_type").alias("parent_type"))
    return rows.select("memory_id", "parent_id").join(parents, "parent_id").select("memory_id", "parent_id", "parent_type")


@REGISTRY.query("s05_prefix", "SELECT memory_id FROM (SELECT DISTINCT memory_id FROM remember_requests WHERE starts_with(memory_id, 'mem_4ede8cd8')) QUALIFY count(*) OVER () = 1")
def s05_prefix(spark: SparkSession, base: str) -> DataFrame:
    return scans.by_prefix(table(spark, base, "remember_requests").select("memory_id").distinct(), "memory_id", "mem_4ede8cd8")


@REGISTRY.query("k02_page", _M + "SELECT memory_id, (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m) > 60 AS has_more FROM m ORDER BY memory_id LIMIT 20 OFFSET 40")
def k02_page(spark: SparkSession, base: str) -> DataFrame:
    return scans.page(memories(spark, base).select("memory_id"), [F.col("memory_id")], 40, 20)


@REGISTRY.query("d03_idempotent_insert", """
SELECT sha256(content) AS content_hash, min(memory_id) AS memory_id, count(DISTINCT memory_id) AS merged,
  max(importance::DOUBLE) AS importance, len(list_distinct(flatten(list(coalesce(tags, []))))) AS n_tags
FROM remember_requests WHERE content IS NOT NULL GROUP BY 1""")
def d03_idempotent_insert(spark: SparkSession, base: str) -> DataFrame:
    """Rows of equal content become one: lists are united, the first id stays. Tags are united by a distinct explode of bounded arrays."""
    rows = table(spark, base, "remember_requests").where("content is not null").withColumn("content_hash", text.content_hash(F.col("content")))
    head = rows.groupBy("content_hash").agg(F.min("memory_id").alias("memory_id"), F.countDistinct("memory_id").alias("merged"), F.max(F.col("importance").cast("double")).alias("importance"))
    tags = rows.select("content_hash", F.explode("tags").alias("tag")).where("tag is not null").distinct().groupBy("content_hash").agg(F.count("*").alias("n"))
    return head.join(tags, "content_hash", "left").select("content_hash", "memory_id", "merged", "importance", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_tags"))


@REGISTRY.query("d05_upsert_external_id", _M + """
SELECT external_id, last(memory_id ORDER BY created_at, memory_id) AS memory_id, count(*) AS version FROM m
WHERE external_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1""")
def d05_upsert_external_id(spark: SparkSession, base: str) -> DataFrame:
    rows = memories(spark, base, "external_id is not null and created_at is not null")
    return rows.groupBy("external_id").agg(F.max_by("memory_id", F.struct("created_at", "memory_id")).alias("memory_id"), F.count("*").alias("version"))


def _kept(name: str, lost_sql: str, lost) -> None:
    def run(spark: SparkSession, base: str) -> DataFrame:
        rows = memories(spark, base)
        return rows.withColumn("forgotten", F.coalesce(lost(), F.lit(False))).groupBy("user_id", "forgotten").agg(F.count("*").alias("n"))

    REGISTRY.query(name, _M + f"SELECT user_id, coalesce({lost_sql}, FALSE) AS forgotten, count(*) AS n FROM m GROUP BY ALL")(run)


_kept("d08_forget_by_age", f"{_DAYS} > 365", lambda: scoring.age_days(F.col("created_at"), F.lit(AS_OF)) > 365)
_kept("d09_forget_by_importance", "importance::DOUBLE < 0.2", lambda: F.col("importance").cast("double") < 0.2)
_kept("d10_forget_by_pattern", "regexp_matches(content, 'checksum (mismatch|error)')", lambda: F.col("content").rlike("checksum (mismatch|error)"))
_kept("d11_forget_by_tags", "list_has_any(list_transform(tags, lambda t: lower(t)), ['decay'])", lambda: scans.any_tag(F.col("tags"), ("decay",)))
_kept("d13_forget_by_kind", "memory_type = 'Conversation'", lambda: F.col("memory_type") == "Conversation")


@REGISTRY.query("a01_storage_stats", _M + """
SELECT user_id, count(*) AS memories, sum(octet_length(encode(content))) AS bytes, round(sum(importance::DOUBLE), 6) AS importance,
  round(avg(importance::DOUBLE), 6) AS mean_importance, count(*) FILTER (WHERE is_failure) AS failures FROM m GROUP BY 1""")
def a01_storage_stats(spark: SparkSession, base: str) -> DataFrame:
    i = F.col("importance").cast("double")
    return memories(spark, base).groupBy("user_id").agg(
        F.count("*").alias("memories"), F.sum(F.octet_length("content")).alias("bytes"), F.round(F.sum(i), 6).alias("importance"), F.round(F.avg(i), 6).alias("mean_importance"),
        F.count(F.when(F.col("is_failure"), 1)).alias("failures"),
    )


@REGISTRY.query("a19_kinds_per_user", _M + "SELECT user_id, memory_type, count(*) AS n FROM m GROUP BY ALL")
def a19_kinds_per_user(spark: SparkSession, base: str) -> DataFrame:
    return memories(spark, base).groupBy("user_id", "memory_type").agg(F.count("*").alias("n"))


@REGISTRY.query("a18_tag_sets", """
WITH s AS (SELECT list_sort(list_distinct(list_filter(list_transform(tags, lambda t: lower(trim(t))), lambda t: t <> ''))) AS items FROM smoke_corpus)
SELECT array_to_string(items, '|') AS items, count(*) AS n FROM s WHERE len(items) >= 2 GROUP BY 1 HAVING count(*) >= 3""")
def a18_tag_sets(spark: SparkSession, base: str) -> DataFrame:
    lowered = F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t != "")
    sets = table(spark, base, "smoke_corpus").select(F.array_sort(F.array_distinct(lowered)).alias("s")).where(F.size("s") >= 2)
    return sets.groupBy(F.array_join("s", "|").alias("items")).agg(F.count("*").alias("n")).where("n >= 3")


@REGISTRY.query("a21_velocity", _M + """
SELECT user_id, round(sum(exp(-h / 24) * CASE memory_type WHEN 'Decision' THEN 2.0 WHEN 'Discovery' THEN 1.5 WHEN 'Error' THEN 1.5 ELSE 1.0 END), 6) AS velocity FROM (
  SELECT user_id, memory_type, (epoch_us(TIMESTAMPTZ '2025-06-01 00:00:00+00') - epoch_us(created_at)) / 86400e6 * 24 AS h FROM m) WHERE h BETWEEN 0 AND 720 GROUP BY 1""")
def a21_velocity(spark: SparkSession, base: str) -> DataFrame:
    hours = scoring.age_hours(F.col("created_at"), F.lit(datetime(2025, 6, 1)))
    weight = F.when(F.col("memory_type") == "Decision", 2.0).when(F.col("memory_type").isin("Discovery", "Error"), 1.5).otherwise(1.0)
    rows = memories(spark, base).withColumn("h", hours).where(F.col("h").between(0, 720))
    return rows.groupBy("user_id").agg(F.round(F.sum(scoring.velocity(F.col("h"), weight)), 6).alias("velocity"))


def _score(name: str, column, sql: str) -> None:
    def run(spark: SparkSession, base: str) -> DataFrame:
        rows = memories(spark, base).withColumn("days", scoring.age_days(F.col("created_at"), F.lit(AS_OF))).where("days is not null")
        return rows.select("memory_id", F.round(column(), 6).alias("score"))

    REGISTRY.query(name, _M + f", d AS (SELECT *, {_DAYS} AS days FROM m WHERE created_at IS NOT NULL) SELECT memory_id, round({sql}, 6) AS score FROM d")(run)


_imp, _c = lambda: F.col("importance").cast("double"), F.col
_score("l01_forgetting_curve", lambda: scoring.forgetting_curve(_c("days") / 30), "CASE WHEN days/30 <= 0 THEN 1.0 WHEN days/30 < 3 THEN exp(-0.693 * (days/30)) ELSE exp(-0.693 * 3.0) * pow((days/30) / 3.0, -0.5) END")
_score("l03_tier_decay", lambda: scoring.tier_decay(F.lit(0.8), _c("days") / 20 * 24, "L2"), "CASE WHEN days / 20 > 30 THEN 0.001 ELSE greatest(0.8 * exp(-0.031 * (days / 20)), 0.001) END")
_score("l09_salience", lambda: scoring.salience(_c("days"), _imp()), "0.6 * CASE WHEN days <= 7 THEN 1.0 WHEN days <= 30 THEN 0.7 WHEN days <= 90 THEN 0.4 ELSE 0.1 END::DOUBLE + 0.4::DOUBLE * importance::DOUBLE")
_score("l14_half_life", lambda: scoring.half_life_decay(_imp(), _c("days") / 100), "CASE WHEN days / 100 <= 0.1 THEN importance::DOUBLE ELSE importance::DOUBLE * pow(0.5, days / 100 / 14) END")
_score(
    "l11_unified_score",
    lambda: scoring.unified(F.lit(1.0), F.coalesce(_imp(), F.lit(0.5)), _c("days") * 24, F.lit(0.2), F.coalesce(F.when(~F.isnan("credibility"), _c("credibility").cast("double")), F.lit(0.5)), scoring.temporal_match(_c("days") - 400), F.lit(1.0)),
    """1.0 * (0.7 + 0.3 * coalesce(importance::DOUBLE, 0.5)) * least(2.5, 1 + 0.5 * exp(-0.01 * days * 24) + 0.15 * 0.2
      + 0.2 * greatest(coalesce(CASE WHEN NOT isnan(credibility) THEN credibility::DOUBLE END, 0.5) - 0.5, 0)
      + CASE WHEN abs(days - 400) = 0 THEN 0.5 WHEN abs(days - 400) <= 7 THEN 0.3 * (1 - abs(days - 400) / 7) WHEN abs(days - 400) <= 30 THEN 0.1 * (1 - abs(days - 400) / 30) ELSE 0.0 END)""",
)
_score("l21_fact_confidence", lambda: scoring.fact_confidence(_imp(), _c("days"), F.lit(2), F.col("is_failure")), "CASE WHEN days <= 90 THEN importance::DOUBLE ELSE importance::DOUBLE * pow(0.5, (days - 90) / (180 + 30 * CASE WHEN is_failure THEN 0 ELSE 2 END)) END")


@REGISTRY.query("l05_hebbian_steps", "SELECT memory_id, round(least(s2 + 0.1 * (1 - s2), 1.0), 6) AS strength FROM (SELECT memory_id, s1 + 0.1 * (1 - s1) AS s2 FROM (SELECT memory_id, decay_rate + 0.1 * (1 - decay_rate) AS s1 FROM mif_memories))")
def l05_hebbian_steps(spark: SparkSession, base: str) -> DataFrame:
    once = scoring.strengthen(F.col("decay_rate"))
    return table(spark, base, "mif_memories").select("memory_id", F.round(scoring.strengthen(scoring.strengthen(once)), 6).alias("strength"))


@REGISTRY.query("c16_promotion", _M + f", d AS (SELECT *, {_DAYS} AS days FROM m WHERE created_at IS NOT NULL) SELECT CASE WHEN importance::DOUBLE >= 0.5 AND days >= 1 THEN 'LongTerm' WHEN importance::DOUBLE >= 0.35 AND days >= 1800 / 86400.0 THEN 'Session' ELSE 'Working' END AS tier, count(*) AS n FROM d GROUP BY 1")
def c16_promotion(spark: SparkSession, base: str) -> DataFrame:
    days = scoring.age_days(F.col("created_at"), F.lit(AS_OF))
    tier = F.when((_imp() >= 0.5) & (days >= 1), "LongTerm").when((_imp() >= 0.35) & (days >= 1800 / 86400.0), "Session").otherwise("Working")
    return memories(spark, base, "created_at is not null").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@REGISTRY.query("c06_replay_candidates", _M + """, d AS (
  SELECT memory_id, importance::DOUBLE AS i, coalesce(CASE WHEN NOT isnan(emotional_valence) THEN abs(emotional_valence::DOUBLE) END, 0) AS a, coalesce(len(tags), 0) AS c,
    (epoch_us(TIMESTAMPTZ '2025-06-01 00:00:00+00') - epoch_us(created_at)) / 86400e6 AS days FROM m)
SELECT memory_id, round(i * (1 - days / 14) * (1 + a) * (1 + least(c / 10, 0.5)), 6) AS priority FROM d WHERE days BETWEEN 0 AND 14 AND i >= 0.3
ORDER BY round(i * (1 - days / 14) * (1 + a) * (1 + least(c / 10, 0.5)), 6) DESC, memory_id LIMIT 50""")
def c06_replay_candidates(spark: SparkSession, base: str) -> DataFrame:
    days = scoring.age_days(F.col("created_at"), F.lit(datetime(2025, 6, 1)))
    arousal = F.coalesce(F.when(~F.isnan("emotional_valence"), F.abs(F.col("emotional_valence").cast("double"))), F.lit(0.0))
    rows = memories(spark, base).withColumn("days", days).where(F.col("days").between(0, 14) & (_imp() >= 0.3))
    size = F.coalesce(F.when(F.col("tags").isNotNull(), F.size("tags")), F.lit(0))
    scored = rows.select("memory_id", F.round(scoring.replay_priority(F.col("days"), _imp(), arousal, size), 6).alias("priority"))
    return scored.orderBy(F.col("priority").desc(), "memory_id").limit(50)


@REGISTRY.query("x12_geohash", _M + """, p AS (
  SELECT memory_id, least(floor((geo_location[1] + 90.0) / 180.0 * 32768), 32767)::BIGINT AS la, least(floor((geo_location[2] + 180.0) / 360.0 * 32768), 32767)::BIGINT AS lo FROM m
  WHERE geo_location[1] BETWEEN -90 AND 90 AND geo_location[2] BETWEEN -180 AND 180
), b AS (SELECT memory_id, list_reduce(list_transform(range(30), lambda i: CASE WHEN i % 2 = 0 THEN (lo >> (14 - i // 2)) & 1 ELSE (la >> (14 - i // 2)) & 1 END), lambda s, x: s * 2 + x) AS v FROM p)
SELECT memory_id, array_to_string(list_transform(range(6), lambda k: '0123456789bcdefghjkmnpqrstuvwxyz'[((v >> (25 - 5 * k)) & 31)::INT + 1]), '') AS cell FROM b""")
def x12_geohash(spark: SparkSession, base: str) -> DataFrame:
    at = lambda i: F.get("geo_location", F.lit(i))
    rows = memories(spark, base).where(at(0).between(-90, 90) & at(1).between(-180, 180) & ~F.isnan(at(0)) & ~F.isnan(at(1)))
    return rows.select("memory_id", places.geohash(at(0), at(1), 6).alias("cell"))


@REGISTRY.query("n10_hashes", "SELECT id, sha256(content) AS exact, sha256(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'), ' ')) AS normalised, ceil(octet_length(encode(content)) / 4.0)::BIGINT AS tokens FROM smoke_corpus WHERE content IS NOT NULL")
def n10_hashes(spark: SparkSession, base: str) -> DataFrame:
    c = F.col("content")
    return table(spark, base, "smoke_corpus").where("content is not null").select("id", text.content_hash(c).alias("exact"), text.normalised_hash(c).alias("normalised"), text.token_estimate(c).alias("tokens"))


@REGISTRY.query("w05_user_sessions", _M + """, o AS (
  SELECT user_id, memory_id, created_at, CASE WHEN lag(created_at) OVER w IS NULL OR (epoch_us(created_at) - epoch_us(lag(created_at) OVER w)) / 1e6 > 86400 THEN 1 ELSE 0 END AS b
  FROM m WHERE created_at IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY created_at, memory_id)
), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY created_at, memory_id ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT user_id, session::BIGINT AS session, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 2""")
def w05_user_sessions(spark: SparkSession, base: str) -> DataFrame:
    rows = memories(spark, base, "created_at is not null").select("user_id", "memory_id", "created_at")
    return ranking.sessions(rows, ["user_id"], "created_at", "memory_id", 86_400).groupBy("user_id", "session").agg(F.count("*").alias("n")).where("n >= 2")


@REGISTRY.query("w10_last_per_user", _M + "SELECT user_id, memory_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, memory_id) AS rank FROM m WHERE created_at IS NOT NULL QUALIFY rank <= 5")
def w10_last_per_user(spark: SparkSession, base: str) -> DataFrame:
    rows = memories(spark, base, "created_at is not null").select("user_id", "memory_id", "created_at")
    return ranking.top_per_group(rows, ["user_id"], [F.col("created_at").desc(), F.col("memory_id")], 5).drop("created_at")


@REGISTRY.query("w15_sequence_numbers", _M + "SELECT memory_id, row_number() OVER (PARTITION BY user_id, mission_id ORDER BY created_at, memory_id) AS seq FROM m WHERE mission_id IS NOT NULL AND created_at IS NOT NULL")
def w15_sequence_numbers(spark: SparkSession, base: str) -> DataFrame:
    rows = memories(spark, base, "mission_id is not null and created_at is not null")
    return rows.select("memory_id", F.row_number().over(W.partitionBy("user_id", "mission_id").orderBy("created_at", "memory_id")).alias("seq"))


@REGISTRY.query("k07_mission_replay", _M + "SELECT mission_id, memory_id, row_number() OVER (PARTITION BY mission_id ORDER BY created_at, memory_id) AS place FROM m WHERE mission_id IS NOT NULL AND created_at IS NOT NULL")
def k07_mission_replay(spark: SparkSession, base: str) -> DataFrame:
    """The memories of each mission in their order, a row each."""
    rows = memories(spark, base, "mission_id is not null and created_at is not null").select("mission_id", "memory_id", "created_at")
    return rows.select("mission_id", "memory_id", F.row_number().over(W.partitionBy("mission_id").orderBy("created_at", "memory_id")).alias("place"))


@REGISTRY.query("k12_recall_by_tags", """
WITH q AS (SELECT request_id, user_id, unnest(tags) AS tag FROM recall_requests), t AS (SELECT DISTINCT memory_id, user_id, lower(unnest(tags)) AS tag FROM remember_requests)
SELECT * FROM (SELECT request_id, memory_id, count(DISTINCT lower(q.tag)) AS hits FROM q JOIN t ON t.user_id = q.user_id AND t.tag = lower(q.tag) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY hits DESC, memory_id) <= 10""")
def k12_recall_by_tags(spark: SparkSession, base: str) -> DataFrame:
    q = table(spark, base, "recall_requests").select("request_id", "user_id", F.explode("tags").alias("tag")).select("request_id", "user_id", F.lower("tag").alias("tag")).distinct()
    t = table(spark, base, "remember_requests").select("memory_id", "user_id", F.explode("tags").alias("tag")).select("memory_id", "user_id", F.lower("tag").alias("tag")).distinct()
    hits = q.join(t, ["user_id", "tag"]).groupBy("request_id", "memory_id").agg(F.count("*").alias("hits"))
    return ranking.top_per_group(hits, ["request_id"], [F.col("hits").desc(), F.col("memory_id")], 10).drop("rank")


@REGISTRY.query("j13_without_vector", "SELECT DISTINCT memory_id FROM remember_requests WHERE memory_id NOT IN (SELECT memory_id FROM mif_memories WHERE embedding.vector IS NOT NULL)")
def j13_without_vector(spark: SparkSession, base: str) -> DataFrame:
    have = table(spark, base, "mif_memories").where("embedding.vector is not null").select("memory_id")
    return table(spark, base, "remember_requests").select("memory_id").distinct().join(have, "memory_id", "left_anti")


@REGISTRY.query("j09_lineage", _M + """
SELECT a.memory_id AS from_id, b.memory_id AS to_id, CASE WHEN a.memory_type = 'Error' THEN 'resolved_by' WHEN a.memory_type = 'Decision' THEN 'led_to' ELSE 'preceded' END AS relation
FROM m a JOIN m b ON a.episode_id = b.episode_id AND a.created_at < b.created_at AND epoch_us(b.created_at) - epoch_us(a.created_at) <= 14 * 86400000000
WHERE a.episode_id IS NOT NULL AND list_has_any(list_transform(a.tags, lambda t: lower(t)), list_transform(b.tags, lambda t: lower(t)))""")
def j09_lineage(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of one episode within a fortnight that share a tag: an equi-join on (episode, tag), then the interval."""
    rows = memories(spark, base, "episode_id is not null and created_at is not null").select("memory_id", "memory_type", "episode_id", "created_at", F.explode("tags").alias("t"))
    rows = rows.withColumn("t", F.lower("t")).distinct()
    later = rows.select("episode_id", "t", F.col("memory_id").alias("to_id"), F.col("created_at").alias("then"))
    near = (F.col("created_at") < F.col("then")) & (F.unix_micros("then") - F.unix_micros("created_at") <= 14 * 86_400_000_000)
    relation = F.when(F.col("memory_type") == "Error", "resolved_by").when(F.col("memory_type") == "Decision", "led_to").otherwise("preceded")
    return rows.join(later, ["episode_id", "t"]).where(near).select(F.col("memory_id").alias("from_id"), "to_id", relation.alias("relation")).distinct()
