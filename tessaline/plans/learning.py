"""Scores that learn: importance, feedback, momentum, interference, replay, facts' decay, experiments, stream rules, fused relevance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions import rules, scoring, stats, text
from tessaline.operators import scans
from tessaline.plans.registry import Registry
from tessaline.runtime import table

REGISTRY = Registry()
AS_OF = datetime(2025, 6, 1)
_NOW = "TIMESTAMPTZ '2025-06-01 00:00:00+00'"
_M = "WITH m AS (SELECT DISTINCT ON (memory_id) * FROM remember_requests) "


def memories(spark: SparkSession, base: str, where: Column | str | None = None) -> DataFrame:
    rows = table(spark, base, "remember_requests")
    return scans.latest(rows if where is None else rows.where(where))


def _per_kind(values: dict[str, float], other: float, column: str = "memory_type") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END::DOUBLE"


def _kind_query(name: str, values: dict[str, float], other: float) -> None:
    REGISTRY.query(name, _M + f"SELECT memory_id, {_per_kind(values, other)} AS value FROM m")(
        lambda spark, base: table(spark, base, "remember_requests").select("memory_id", rules.by_kind(F.col("memory_type"), values, other).alias("value")).distinct()
    )


_kind_query("z44_edge_weights", rules.EDGE_WEIGHTS, 0.8)
_kind_query("z45_activation_weights", rules.ACTIVATION_WEIGHTS, 0.85)
_kind_query("z33_inertia", rules.INERTIA, 0.4)

_WORDS = "len(list_filter(string_split_regex(content, '[ \\t\\n\\r]+'), lambda w: w <> ''))"
_CONTAINS = lambda xs: " + ".join(f"CASE WHEN contains(lower(content), '{x}') THEN 1 ELSE 0 END" for x in xs)


@REGISTRY.query("l08_importance", _M + f"""
, x AS (SELECT *, {_WORDS} AS w FROM m WHERE content IS NOT NULL)
SELECT memory_id, round(least(1.0, greatest(0.0, {_per_kind(rules.IMPORTANCE_KINDS, 0.05)}
 + CASE WHEN w > 50 THEN 0.25 WHEN w > 20 THEN 0.15 WHEN w > 5 THEN 0.08 ELSE 0.02 END
 + CASE WHEN len(tags) > 10 THEN 0.2 WHEN len(tags) > 5 THEN 0.15 WHEN len(tags) > 2 THEN 0.1 WHEN len(tags) > 0 THEN 0.05 ELSE 0.0 END
 + least(0.1, 0.015 * ({_CONTAINS(rules.TECHNICAL)}) + CASE WHEN contains(content, '?') THEN 0.02 ELSE 0 END + CASE WHEN contains(content, '```') OR contains(content, 'fn ') OR contains(content, 'function ') OR contains(content, 'class ') THEN 0.03 ELSE 0 END)
 + CASE WHEN isnan(reward) OR reward IS NULL THEN 0 ELSE abs(reward::DOUBLE) * 0.15 END)), 6) AS importance FROM x""")
def l08_importance(spark: SparkSession, base: str) -> DataFrame:
    """Capped factors added up: kind, richness, entities (tags stand for them), quality of the text, reward."""
    rows = memories(spark, base, "content is not null")
    return rows.select("memory_id", F.round(rules.importance(F.col("memory_type"), F.col("content"), F.col("tags"), F.col("reward").cast("double")), 6).alias("importance"))


@REGISTRY.query("l10_salience_with_access", f"SELECT memory_id, round(0.6 * CASE WHEN d <= 7 THEN 1.0 WHEN d <= 30 THEN 0.7 WHEN d <= 90 THEN 0.4 ELSE 0.1 END::DOUBLE + 0.4 * decay_rate + least(0.05 * log2(greatest(access_count, 1)), 0.3), 6) AS salience FROM (SELECT *, (epoch_us({_NOW}) - epoch_us(created_at)) / 86400e6 AS d FROM mif_memories WHERE created_at IS NOT NULL)")
def l10_salience_with_access(spark: SparkSession, base: str) -> DataFrame:
    days = scoring.age_days(F.col("created_at"), F.lit(AS_OF))
    return table(spark, base, "mif_memories").where("created_at is not null").select("memory_id", F.round(scoring.salience(days, F.col("decay_rate"), F.col("access_count")), 6).alias("salience"))


@REGISTRY.query("l02_scaled_curve", "SELECT k AS days, s AS scale, round(CASE WHEN k / s <= 0 THEN 1.0 WHEN k / s < 3 THEN exp(-0.693 * (k / s)) ELSE exp(-0.693 * 3.0) * pow((k / s) / 3.0, -0.5) END, 8) AS factor FROM (SELECT unnest(range(0, 61)) AS k), (VALUES (1.0::DOUBLE), (7.0), (30.0)) v(s)")
def l02_scaled_curve(spark: SparkSession, base: str) -> DataFrame:
    """The forgetting curve over sixty days at three time scales."""
    grid = spark.range(0, 61).select(F.col("id").alias("days"), F.explode(F.array(F.lit(1.0), F.lit(7.0), F.lit(30.0))).alias("scale"))
    return grid.select("days", "scale", F.round(scoring.forgetting_curve(F.col("days") / F.col("scale")), 8).alias("factor"))


@REGISTRY.query("z93_decay_simulation", "SELECT memory_id, k AS day, round(coalesce(importance::DOUBLE, 0.5) * CASE WHEN k = 0 THEN 1.0 WHEN k < 3 THEN exp(-0.693 * k) ELSE exp(-0.693 * 3.0) * pow(k / 3.0, -0.5) END, 6) AS left_over FROM (SELECT DISTINCT memory_id, importance FROM remember_requests WHERE memory_type = 'Pattern'), (SELECT unnest([0, 1, 2, 7, 30]) AS k)")
def z93_decay_simulation(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "remember_requests").where("memory_type = 'Pattern'").select("memory_id", "importance").distinct()
    days = F.explode(F.array(*(F.lit(float(k)) for k in (0, 1, 2, 7, 30)))).alias("d")
    value = F.coalesce(F.col("importance").cast("double"), F.lit(0.5)) * scoring.forgetting_curve(F.col("d"))
    return rows.select("memory_id", "importance", days).select("memory_id", F.col("d").cast("int").alias("day"), F.round(value, 6).alias("left_over"))


@REGISTRY.query("l15_overlap_signals", "SELECT event_id, round(CASE WHEN r >= 0.4 THEN 0.8 * r WHEN r >= 0.1 THEN 0.3 * r ELSE -0.2 END, 6) AS signal FROM (SELECT event_id, value / 100.0 AS r FROM events)")
def l15_overlap_signals(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select("event_id", F.round(scoring.overlap_signal(F.col("value") / 100.0), 6).alias("signal"))


_SETS = """WITH q AS (SELECT request_id, session_id, requested_at, list_distinct(list_filter(string_split_regex(lower(query_text), '[^a-z0-9]+'), lambda w: length(w) >= 2)) AS t FROM recall_requests WHERE query_text IS NOT NULL AND session_id IS NOT NULL AND requested_at IS NOT NULL),
p AS (SELECT request_id, t, lag(t) OVER (PARTITION BY session_id ORDER BY requested_at, request_id) AS b FROM q), f AS (SELECT request_id, len(t) AS n, len(list_intersect(t, b)) AS k FROM p WHERE b IS NOT NULL AND len(t) > 0)"""


def _turns(spark: SparkSession, base: str) -> DataFrame:
    """Each turn of a session with the words of the turn before: (request_id, n, k)."""
    rows = table(spark, base, "recall_requests").where("query_text is not null and session_id is not null and requested_at is not null")
    rows = rows.select("request_id", "session_id", "requested_at", text.tokens(F.col("query_text")).alias("t"))
    before = F.lag("t").over(W.partitionBy("session_id").orderBy("requested_at", "request_id"))
    return rows.withColumn("b", before).where("b is not null and size(t) > 0").select("request_id", F.size("t").alias("n"), F.size(F.array_intersect("t", "b")).alias("k"))


@REGISTRY.query("l17_entity_flow", _SETS + " SELECT request_id, k AS derived, n - k AS novel, round(k / n::DOUBLE, 6) AS derived_ratio FROM f")
def l17_entity_flow(spark: SparkSession, base: str) -> DataFrame:
    return _turns(spark, base).select("request_id", F.col("k").alias("derived"), (F.col("n") - F.col("k")).alias("novel"), F.round(F.col("k") / F.col("n"), 6).alias("derived_ratio"))


@REGISTRY.query("l16_flow_signals", _SETS + " SELECT request_id, round(CASE WHEN k / n::DOUBLE >= 0.5 THEN 0.6 + (k / n::DOUBLE - 0.5) * 0.4 WHEN k / n::DOUBLE >= 0.2 THEN k / n::DOUBLE * 1.5 WHEN 1 - k / n::DOUBLE >= 0.8 THEN -0.1 ELSE 0.0 END, 6) AS signal, CASE WHEN n >= 3 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM f")
def l16_flow_signals(spark: SparkSession, base: str) -> DataFrame:
    r = F.col("k") / F.col("n")
    return _turns(spark, base).select("request_id", F.round(rules.flow_signal(r), 6).alias("signal"), F.when(F.col("n") >= 3, 0.8).otherwise(0.5).alias("confidence"))


@REGISTRY.query("z36_context_change", _SETS + " SELECT request_id, CASE WHEN k / n::DOUBLE > 0.8 THEN 'repetition' WHEN k / n::DOUBLE < 0.3 THEN 'topic change' ELSE 'same topic' END AS pattern FROM f")
def z36_context_change(spark: SparkSession, base: str) -> DataFrame:
    r = F.col("k") / F.col("n")
    return _turns(spark, base).select("request_id", F.when(r > 0.8, "repetition").when(r < 0.3, "topic change").otherwise("same topic").alias("pattern"))


@REGISTRY.query("l20_pattern_adjustment", _SETS + " SELECT request_id, CASE WHEN k / n::DOUBLE > 0.8 THEN -0.4 WHEN k / n::DOUBLE < 0.3 THEN 0.2 ELSE 0.0 END::DOUBLE AS adjustment FROM f")
def l20_pattern_adjustment(spark: SparkSession, base: str) -> DataFrame:
    r = F.col("k") / F.col("n")
    return _turns(spark, base).select("request_id", F.when(r > 0.8, -0.4).when(r < 0.3, 0.2).otherwise(0.0).alias("adjustment"))


@REGISTRY.query("t22_behaviour_change", """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, lag(event_type) OVER w AS before, lag(epoch_us(ts)) OVER w AS t0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id FROM e WHERE before <> event_type AND t - t0 >= 3600000000""")
def t22_behaviour_change(spark: SparkSession, base: str) -> DataFrame:
    """A switch of the kind of event, at most one an hour."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, base, "events").select("event_id", F.col("event_type"), F.lag("event_type").over(w).alias("before"), (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)).alias("gap"))
    return rows.where("before <> event_type and gap >= 3600000000").select("event_id")


@REGISTRY.query("w13_credit", "SELECT event_id, round(sum(value / 100.0 * pow(0.7, back)), 9) AS credit FROM (SELECT a.event_id, b.value, a.k - b.k AS back FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) a JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) b ON a.user_id = b.user_id AND b.k BETWEEN a.k - 4 AND a.k) GROUP BY 1")
def w13_credit(spark: SparkSession, base: str) -> DataFrame:
    """Discounted credit over the last five turns: lags of one window, no join."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, base, "events").select("event_id", *[F.lag("value", k).over(w).alias(f"v{k}") for k in range(5)])
    total = sum((F.coalesce(F.col(f"v{k}"), F.lit(0.0)) / 100.0 * 0.7**k for k in range(1, 5)), F.col("v0") / 100.0)
    return rows.select("event_id", F.round(total, 9).alias("credit"))


@REGISTRY.query("z34_age_factor", f"SELECT memory_id, CASE WHEN d < 1 THEN 0.8 WHEN d < 7 THEN 0.9 WHEN d < 30 THEN 1.0 ELSE 1.1 END::DOUBLE AS factor FROM (SELECT memory_id, (epoch_us({_NOW}) - epoch_us(updated_at)) / 86400e6 AS d FROM mif_memories WHERE updated_at IS NOT NULL)")
def z34_age_factor(spark: SparkSession, base: str) -> DataFrame:
    d = scoring.age_days(F.col("updated_at"), F.lit(AS_OF))
    return table(spark, base, "mif_memories").where("updated_at is not null").select("memory_id", rules.age_factor(d).alias("factor"))


@REGISTRY.query("z35_recency_weight", "SELECT event_id, CASE WHEN gap IS NULL OR gap < 3600 THEN 1.0 WHEN gap < 86400 THEN 0.9 WHEN gap < 604800 THEN 0.7 ELSE 0.5 END::DOUBLE AS weight FROM (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)")
def z35_recency_weight(spark: SparkSession, base: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (t - F.lag(t).over(W.partitionBy("user_id").orderBy("ts", "event_id"))) / 1e6
    return table(spark, base, "events").select("event_id", gap.alias("g")).select("event_id", rules.recency_weight(F.coalesce("g", F.lit(0.0))).alias("weight"))


@REGISTRY.query("z33_effective_inertia", f"""
SELECT memory_id, round(least(0.99, greatest(0.5, {_per_kind(rules.INERTIA, 0.4, 'memory_class')} * CASE WHEN d < 1 THEN 0.8 WHEN d < 7 THEN 0.9 WHEN d < 30 THEN 1.0 ELSE 1.1 END
 * CASE WHEN access_count <= 2 THEN 0.7 WHEN access_count <= 9 THEN 0.9 WHEN access_count <= 49 THEN 1.0 ELSE 1.1 END * (0.8 + decay_rate * 0.4))), 6) AS inertia FROM (SELECT *, (epoch_us({_NOW}) - epoch_us(created_at)) / 86400e6 AS d FROM mif_memories WHERE created_at IS NOT NULL)""")
def z33_effective_inertia(spark: SparkSession, base: str) -> DataFrame:
    d = scoring.age_days(F.col("created_at"), F.lit(AS_OF))
    value = rules.inertia(F.col("memory_class"), d, F.col("access_count"), F.col("decay_rate"))
    return table(spark, base, "mif_memories").where("created_at is not null").select("memory_id", F.round(value, 6).alias("inertia"))


@REGISTRY.query("w08_momentum")
def w08_momentum(spark: SparkSession, base: str) -> DataFrame:
    """Each user's feedback average and stability after all signals: every step's weight depends on the state, so it is a fold in the order of time,
    in pieces that carry the state. Checked against a plain loop in the tests."""
    from tessaline.operators.momentum import fold

    events = table(spark, base, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", (F.col("value") / 50 - 1).alias("signal"))
    return fold(events, "user_id", ["at", "event_id"], "signal")


@REGISTRY.query("l13_replayed_interference", "SELECT memory_id, round(least(1.5, greatest(0.5, 1 + 0.5 * least(access_count / 10.0, 1.0) * (2 * decay_rate - 1))), 6) AS adjustment FROM mif_memories")
def l13_replayed_interference(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "mif_memories").select("memory_id", F.round(scoring.interference(F.least(F.col("access_count") / 10.0, F.lit(1.0)), F.col("decay_rate")), 6).alias("adjustment"))


@REGISTRY.query("c06_replay_priority", _M + f"""
, d AS (SELECT *, (epoch_us({_NOW}) - epoch_us(created_at)) / 86400e6 AS age FROM m WHERE created_at IS NOT NULL)
SELECT memory_id, round(importance::DOUBLE * (1 - age / 14) * (1 + coalesce(abs(emotional_valence::DOUBLE), 0)) * (1 + least(coalesce(len(tags), 0) / 10.0, 0.5)), 6) AS priority FROM d
WHERE age BETWEEN 0 AND 14 AND importance::DOUBLE >= 0.3 AND NOT coalesce(isnan(emotional_valence), FALSE) ORDER BY 2 DESC, 1 LIMIT 50""")
def c06_replay_priority(spark: SparkSession, base: str) -> DataFrame:
    age = scoring.age_days(F.col("created_at"), F.lit(AS_OF))
    rows = memories(spark, base, age.between(0, 14) & (F.col("importance").cast("double") >= 0.3) & ~F.coalesce(F.isnan("emotional_valence"), F.lit(False)))
    arousal, links = F.coalesce(F.abs(F.col("emotional_valence").cast("double")), F.lit(0.0)), F.greatest(F.coalesce(F.size("tags"), F.lit(0)), F.lit(0))
    value = F.round(scoring.replay_priority(age, F.col("importance").cast("double"), arousal, links), 6)
    return rows.select("memory_id", value.alias("priority")).orderBy(F.col("priority").desc(), "memory_id").limit(50)


@REGISTRY.query("c07_replayed", """
WITH c AS (SELECT DISTINCT memory_id, parent_id FROM remember_requests WHERE importance::DOUBLE >= 0.8),
g AS (SELECT memory_id AS id, 0.05 AS gain FROM c UNION ALL SELECT DISTINCT parent_id, 0.025 FROM c WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT memory_id FROM c))
SELECT id AS memory_id, sum(gain)::DOUBLE AS gain FROM g GROUP BY 1""")
def c07_replayed(spark: SparkSession, base: str) -> DataFrame:
    """Replayed memories gain 0.05, what they are connected to half of it, once."""
    c = table(spark, base, "remember_requests").where(F.col("importance").cast("double") >= 0.8).select("memory_id", "parent_id").distinct()
    near = c.where("parent_id is not null").select(F.col("parent_id").alias("memory_id")).distinct().join(c.select("memory_id"), "memory_id", "left_anti")
    return c.select("memory_id").distinct().withColumn("gain", F.lit(0.05)).unionByName(near.withColumn("gain", F.lit(0.025)))


@REGISTRY.query("c08_interference", """
WITH p AS (SELECT a.vec_id AS new_id, b.vec_id AS old_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, (a.vec_id * 37 % 100) / 100.0::DOUBLE AS new_imp, (b.vec_id * 37 % 100) / 100.0::DOUBLE AS old_imp FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id WHERE a.vec_id % 50 = 0)
SELECT new_id, old_id, round(CASE WHEN old_imp < new_imp THEN 0.1 * (s - 0.2) / 0.8 ELSE 0 END, 6) AS retroactive, round(CASE WHEN old_imp > 0.8 THEN 0.05 * (s - 0.2) / 0.8 * (old_imp - 0.8) ELSE 0 END, 6) AS proactive FROM p WHERE s >= 0.2""")
def c08_interference(spark: SparkSession, base: str) -> DataFrame:
    """What a new row and the similar older ones take from each other (threshold 0.2 for these vectors); pairs are formed inside a label, for every fiftieth row."""
    from tessaline.functions.vectors import cosine

    e = table(spark, base, "embeddings").withColumn("imp", (F.col("vec_id") * 37 % 100) / 100.0)
    new = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("new_id"), "label", F.col("embedding").alias("x"), F.col("imp").alias("new_imp"))
    old = e.select(F.col("vec_id").alias("old_id"), "label", F.col("embedding").alias("y"), F.col("imp").alias("old_imp"))
    p = old.join(new, "label").where("old_id < new_id").withColumn("s", cosine(F.col("x"), F.col("y"))).where("s >= 0.2")
    retro, pro = rules.interference(F.col("s"), F.col("new_imp"), F.col("old_imp"), 0.2)
    return p.select("new_id", "old_id", F.round(retro, 6).alias("retroactive"), F.round(pro, 6).alias("proactive"))


@REGISTRY.query("c09_compression", _M + f"""
SELECT memory_id, CASE WHEN importance::DOUBLE > 0.8 THEN 'fast' WHEN coalesce(len(tags), 0) > 10 THEN 'none' WHEN (epoch_us({_NOW}) - epoch_us(created_at)) / 86400e6 > 30 AND importance::DOUBLE < 0.5 THEN 'summary' ELSE 'hybrid' END AS strategy FROM m""")
def c09_compression(spark: SparkSession, base: str) -> DataFrame:
    days, imp = scoring.age_days(F.col("created_at"), F.lit(AS_OF)), F.col("importance").cast("double")
    how = F.when(imp > 0.8, "fast").when(F.coalesce(F.size("tags"), F.lit(0)) > 10, "none").when((days > 30) & (imp < 0.5), "summary").otherwise("hybrid")
    return table(spark, base, "remember_requests").select("memory_id", how.alias("strategy")).distinct()


@REGISTRY.query("c18_edge_boosts", "SELECT m.memory_id, round(least(1.0, m.decay_rate + 0.02 * coalesce(n, 0)), 6) AS importance FROM mif_memories m LEFT JOIN (SELECT parent_id AS memory_id, count(DISTINCT memory_id) AS n FROM remember_requests WHERE parent_id IS NOT NULL GROUP BY 1) c USING (memory_id)")
def c18_edge_boosts(spark: SparkSession, base: str) -> DataFrame:
    n = table(spark, base, "remember_requests").where("parent_id is not null").select("parent_id", "memory_id").distinct().groupBy(F.col("parent_id").alias("memory_id")).agg(F.count("*").alias("n"))
    return table(spark, base, "mif_memories").join(n, "memory_id", "left").select("memory_id", F.round(F.least(F.lit(1.0), F.col("decay_rate") + 0.02 * F.coalesce("n", F.lit(0))), 6).alias("importance"))


@REGISTRY.query("c19_orphans", "SELECT memory_id, round(least(1.0, decay_rate + 0.05), 6) AS importance FROM mif_memories WHERE memory_id NOT IN (SELECT parent_id FROM remember_requests WHERE parent_id IS NOT NULL) AND memory_id NOT IN (SELECT memory_id FROM remember_requests WHERE parent_id IS NOT NULL)")
def c19_orphans(spark: SparkSession, base: str) -> DataFrame:
    """Memories that have lost all edges are compensated."""
    r = table(spark, base, "remember_requests").where("parent_id is not null")
    ends = r.select("memory_id").union(r.select("parent_id")).distinct()
    return table(spark, base, "mif_memories").join(ends, "memory_id", "left_anti").select("memory_id", F.round(F.least(F.lit(1.0), F.col("decay_rate") + 0.05), 6).alias("importance"))


@REGISTRY.query("l22_would_decay", f"SELECT memory_id, CASE WHEN d <= 90 THEN FALSE ELSE decay_rate * pow(0.5, (d - 90) / (180.0 + access_count * 30.0)) < 0.1 END AS decays FROM (SELECT *, floor((epoch_us({_NOW}) - epoch_us(updated_at)) / 86400e6) AS d FROM mif_memories WHERE updated_at IS NOT NULL)")
def l22_would_decay(spark: SparkSession, base: str) -> DataFrame:
    d = F.floor(scoring.age_days(F.col("updated_at"), F.lit(AS_OF)))
    return table(spark, base, "mif_memories").where("updated_at is not null").select("memory_id", rules.would_decay(F.col("decay_rate"), d, F.col("access_count")).alias("decays"))


@REGISTRY.query("l23_reinforced", "SELECT memory_id, access_count + 1 AS support, round(least(1.0, decay_rate + 0.1 * (1 - decay_rate)), 6) AS confidence FROM mif_memories")
def l23_reinforced(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "mif_memories").select("memory_id", (F.col("access_count") + 1).alias("support"), F.round(F.least(F.lit(1.0), scoring.reinforced(F.col("decay_rate"))), 6).alias("confidence"))


@REGISTRY.query("l26_tuned_threshold", "SELECT user_id, round(least(0.9, greatest(0.5, 0.7 + 0.02 * count(*) FILTER (WHERE event_type = 'error') - 0.01 * count(*) FILTER (WHERE event_type = 'click')))::DOUBLE, 6) AS threshold FROM events GROUP BY 1")
def l26_tuned_threshold(spark: SparkSession, base: str) -> DataFrame:
    """Down by 0.01 for each good signal, up by 0.02 for each bad one, between 0.5 and 0.9; bounds are applied to the sum."""
    bad, good = F.count(F.when(F.col("event_type") == "error", 1)), F.count(F.when(F.col("event_type") == "click", 1))
    return table(spark, base, "events").groupBy("user_id").agg(F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.5), 0.7 + 0.02 * bad - 0.01 * good)), 6).alias("threshold"))


@REGISTRY.query("l27_prediction_error", "SELECT event_id, round(least(2.0, greatest(0.5, 1 + abs(value - m) / 100)), 6) AS multiplier FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NOT NULL")
def l27_prediction_error(spark: SparkSession, base: str) -> DataFrame:
    expected = F.avg("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-10, -1))
    rows = table(spark, base, "events").withColumn("m", expected).where("m is not null")
    return rows.select("event_id", F.round(F.least(F.lit(2.0), F.greatest(F.lit(0.5), 1 + F.abs(F.col("value") - F.col("m")) / 100)), 6).alias("multiplier"))


# Streams' rules, as columns that a stream and a batch share.

_Q = lambda x: f"contains(lower(content), '{x}')"


@REGISTRY.query("t09_stream_importance", f"""
WITH c AS (SELECT id, content, CASE WHEN memory_type IN ('Conversation', 'Learning') THEN 'conversation' WHEN memory_type = 'Observation' THEN 'sensor' ELSE 'event' END AS mode, {_WORDS} AS w FROM smoke_corpus WHERE content IS NOT NULL)
SELECT id, round(CASE mode WHEN 'sensor' THEN 0.4 ELSE least(1.0, greatest(0.0, 0.5 + CASE WHEN w > 50 THEN 0.1 WHEN w < 10 THEN -0.1 ELSE 0 END + CASE mode WHEN 'conversation' THEN CASE WHEN contains(content, '?') THEN 0.15 ELSE 0 END
 + CASE WHEN contains(content, '```') OR contains(content, 'fn ') OR contains(content, 'def ') THEN 0.2 ELSE 0 END + CASE WHEN {_Q('error')} OR {_Q('failed')} THEN 0.2 ELSE 0 END ELSE CASE WHEN {_Q('error')} THEN 0.3 WHEN {_Q('warning')} THEN 0.15 ELSE 0 END END)) END::DOUBLE, 6) AS importance FROM c""")
def t09_stream_importance(spark: SparkSession, base: str) -> DataFrame:
    kind = F.col("memory_type")
    mode = F.when(kind.isin("Conversation", "Learning"), "conversation").when(kind == "Observation", "sensor").otherwise("event")
    return table(spark, base, "smoke_corpus").where("content is not null").select("id", F.round(rules.stream_importance(F.col("content"), mode), 6).alias("importance"))


@REGISTRY.query("t10_stream_kind", "SELECT id, coalesce(list_filter(list_transform(tags, lambda t: CASE WHEN contains(lower(t), 'error') THEN 'Error' WHEN contains(lower(t), 'decision') THEN 'Decision' WHEN contains(lower(t), 'learning') THEN 'Learning' WHEN contains(lower(t), 'discovery') THEN 'Discovery' END), lambda k: k IS NOT NULL)[1], 'Observation') AS kind FROM smoke_corpus")
def t10_stream_kind(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "smoke_corpus").select("id", F.coalesce(rules.kind_of_tags(F.col("tags")), F.lit("Observation")).alias("kind"))


@REGISTRY.query("t20_latest_presence", "SELECT robot_id, memory_id, action_type FROM (SELECT DISTINCT memory_id, robot_id, created_at, action_type FROM remember_requests WHERE robot_id IS NOT NULL AND created_at IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY robot_id ORDER BY created_at DESC, memory_id DESC) = 1")
def t20_latest_presence(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "remember_requests").where("robot_id is not null and created_at is not null")
    last = rows.groupBy("robot_id").agg(F.max_by(F.struct("memory_id", "action_type"), F.struct("created_at", "memory_id")).alias("x"))
    return last.select("robot_id", "x.memory_id", "x.action_type")


@REGISTRY.query("t19_missions", "SELECT mission_id, min(created_at) AS began, max(created_at) AS ended, count(DISTINCT memory_id) AS memories FROM remember_requests WHERE mission_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1")
def t19_missions(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "remember_requests").where("mission_id is not null and created_at is not null").select("mission_id", "memory_id", "created_at").distinct()
    return rows.groupBy("mission_id").agg(F.min("created_at").alias("began"), F.max("created_at").alias("ended"), F.count("*").alias("memories"))


# Fused relevance.

_SIG = "(1 / (1 + exp(-10 * (({0}) - 0.5))))"


@REGISTRY.query("r21_seven_signals", f"""
WITH x AS (SELECT uuid, salience AS s, least(mention_count / 50.0, 1.0) AS e, (mention_count % 10) / 10.0 AS t, CASE WHEN is_proper_noun THEN 0.9 ELSE 0.3 END AS i, (mention_count % 21 - 10) / 10.0 AS m, mention_count AS a, (mention_count % 7) / 7.0 AS g FROM graph_entities),
n AS (SELECT *, (m + 1) / 2 AS nm FROM x), q AS (SELECT *, CASE WHEN nm > 0.65 THEN least(nm * 1.5, 1.0) WHEN nm < 0.4 THEN nm * 0.3 ELSE nm END AS am, CASE WHEN a = 0 THEN 0 ELSE least(log2(a + 1) / 4, 1.0) END AS la FROM n)
SELECT uuid, round(0.3 * {_SIG.format('s')} + 0.2 * {_SIG.format('e')} + 0.1 * {_SIG.format('t')} + 0.1 * {_SIG.format('i')} + 0.15 * {_SIG.format('am')} + 0.05 * {_SIG.format('la')} + 0.1 * {_SIG.format('g')}, 6) AS relevance FROM q""")
def r21_seven_signals(spark: SparkSession, base: str) -> DataFrame:
    n = F.col("mention_count")
    signals = {
        "semantic": (F.col("salience"), 0.3), "entity": (F.least(n / 50.0, F.lit(1.0)), 0.2), "tag": ((n % 10) / 10.0, 0.1), "importance": (F.when(F.col("is_proper_noun"), 0.9).otherwise(0.3), 0.1),
        "momentum": (rules.amplified_momentum((n % 21 - 10) / 10.0), 0.15), "access": (rules.access_score(n), 0.05), "graph": ((n % 7) / 7.0, 0.1),
    }
    fused = sum((w * scoring.sigmoid(s) for s, w in signals.values()), F.lit(0.0))
    return table(spark, base, "graph_entities").select("uuid", F.round(fused, 6).alias("relevance"))


@REGISTRY.query("r24_keyword_fallback", """
WITH q AS (SELECT request_id, list_distinct(list_filter(string_split_regex(lower(query_text), '[^a-z0-9]+'), lambda w: length(w) >= 5)) AS a FROM recall_requests WHERE request_id % 50 = 0 AND query_text IS NOT NULL), c AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda w: length(w) >= 5)) AS b FROM smoke_corpus WHERE content IS NOT NULL)
SELECT request_id, id, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS score FROM q, c WHERE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) >= 0.5""")
def r24_keyword_fallback(spark: SparkSession, base: str) -> DataFrame:
    """Twice the common words over all words of a request (every fiftieth) and a record, where there are no vectors; prefix-filtered, so that
    frequent words never form pairs by themselves."""
    from tessaline.operators.overlap import dice_pairs

    q = table(spark, base, "recall_requests").where("request_id % 50 = 0 and query_text is not null").select("request_id", text.tokens(F.col("query_text"), 5).alias("a"))
    c = table(spark, base, "smoke_corpus").where("content is not null").select("id", text.tokens(F.col("content"), 5).alias("b"))
    return dice_pairs(q, c, "request_id", "id", 0.5).select("request_id", "id", F.round("score", 6).alias("score"))


@REGISTRY.query("r26_tag_scores", """
WITH q AS (SELECT request_id, lower(query_text) AS t, list_filter(string_split_regex(lower(query_text), '[ \\t\\n\\r]+'), lambda w: w <> '') AS w, tags FROM recall_requests WHERE query_text IS NOT NULL AND len(tags) > 0)
SELECT request_id, round(len(list_filter(tags, lambda g: contains(t, lower(g)) OR len(list_filter(w, lambda x: starts_with(x, lower(g)) OR starts_with(lower(g), x))) > 0)) / len(tags)::DOUBLE, 6) AS score FROM q""")
def r26_tag_scores(spark: SparkSession, base: str) -> DataFrame:
    t = F.lower("query_text")
    words = F.filter(F.split(t, r"[ \t\n\r]+"), lambda w: w != "")
    hit = F.filter("tags", lambda g: F.contains(t, F.lower(g)) | F.exists(words, lambda x: F.startswith(x, F.lower(g)) | F.startswith(F.lower(g), x)))
    return table(spark, base, "recall_requests").where("query_text is not null and size(tags) > 0").select("request_id", F.round(F.size(hit) / F.size("tags"), 6).alias("score"))


@REGISTRY.query("r25_window_boost", f"SELECT memory_id, round(CASE WHEN h >= 0 AND h <= 720 THEN 1 - h / 720 ELSE 0 END, 6) AS boost FROM (SELECT DISTINCT memory_id, (epoch_us({_NOW}) - epoch_us(created_at)) / 86400e6 * 24 AS h FROM remember_requests WHERE created_at IS NOT NULL)")
def r25_window_boost(spark: SparkSession, base: str) -> DataFrame:
    h = scoring.age_hours(F.col("created_at"), F.lit(AS_OF))
    return table(spark, base, "remember_requests").where("created_at is not null").select("memory_id", F.round(scoring.window_boost(h, 720.0), 6).alias("boost")).distinct()


@REGISTRY.query("r16_convex_fusion", "SELECT uuid, round(w * salience + g * least(mention_count / 50.0, 1.0) * CASE WHEN mention_count > 20 THEN 1.0 ELSE 0.3 END + 0.15 * CASE WHEN is_proper_noun THEN 1 ELSE 0 END, 6) AS score FROM (SELECT *, 0.85 - CASE WHEN d <= 0.5 THEN 0.5 WHEN d >= 2.0 THEN 0.1 ELSE 0.5 - 0.4 * (d - 0.5) / 1.5 END AS w, CASE WHEN d <= 0.5 THEN 0.5 WHEN d >= 2.0 THEN 0.1 ELSE 0.5 - 0.4 * (d - 0.5) / 1.5 END AS g FROM (SELECT *, (mention_count % 25) / 10.0::DOUBLE AS d FROM graph_entities))")
def r16_convex_fusion(spark: SparkSession, base: str) -> DataFrame:
    n = F.col("mention_count")
    semantic, graph_weight, linguistic = scoring.leg_weights((n % 25) / 10.0)
    score = semantic * F.col("salience") + graph_weight * F.least(n / 50.0, F.lit(1.0)) * F.when(n > 20, 1.0).otherwise(0.3) + linguistic * F.col("is_proper_noun").cast("int")
    return table(spark, base, "graph_entities").select("uuid", F.round(score, 6).alias("score"))


@REGISTRY.query("r30_prefetch", f"""
SELECT r.memory_id, round(0.4 * CASE WHEN r.mission_id = 'ms-0109' THEN 1 ELSE 0 END + 0.2 * len(list_intersect(list_transform(coalesce(tags, []), lambda t: lower(t)), ['rust', 'storage', 'ranking'])) / 3.0 + 0.2 * CASE WHEN source_type = 'file' THEN 1 ELSE 0 END + 0.2 * exp(-greatest((epoch_us({_NOW}) - epoch_us(created_at)) / 86400e6, 0) / 30), 6) AS score
FROM (SELECT DISTINCT ON (memory_id) * FROM remember_requests WHERE created_at IS NOT NULL) r""")
def r30_prefetch(spark: SparkSession, base: str) -> DataFrame:
    """How likely a memory is wanted next in a context: its project, its entities, its kind of source, its age."""
    wanted = F.array(*(F.lit(x) for x in ("rust", "storage", "ranking")))
    share = F.size(F.array_intersect(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t)), wanted)) / 3.0
    days = F.greatest(scoring.age_days(F.col("created_at"), F.lit(AS_OF)), F.lit(0.0))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = 0.4 * yes(F.col("mission_id") == "ms-0109") + 0.2 * share + 0.2 * yes(F.col("source_type") == "file") + 0.2 * F.exp(-days / 30)
    return memories(spark, base, "created_at is not null").select("memory_id", F.round(score, 6).alias("score"))


@REGISTRY.query("z28_context_similarity", "SELECT a.request_id AS a, b.request_id AS b, round((0.2 * len(list_intersect(a.t, b.t)) + 0.3 * CASE WHEN a.robot_id = b.robot_id THEN 1 ELSE 0 END) * exp(-0.1 * abs(epoch_us(a.requested_at) - epoch_us(b.requested_at)) / 3600e6 / 24), 6) AS similarity FROM (SELECT *, list_distinct(list_transform(tags, lambda t: lower(t))) AS t FROM recall_requests) a JOIN (SELECT *, list_distinct(list_transform(tags, lambda t: lower(t))) AS t FROM recall_requests) b ON a.session_id = b.session_id AND a.request_id < b.request_id WHERE len(a.t) > 0 AND len(b.t) > 0")
def z28_context_similarity(spark: SparkSession, base: str) -> DataFrame:
    """Contexts of one session: shared tags and robot, less with the hours between them."""
    lowered = F.array_distinct(F.transform("tags", lambda t: F.lower(t)))
    rows = table(spark, base, "recall_requests").where("size(tags) > 0 and session_id is not null").select("session_id", "request_id", "robot_id", F.unix_micros("requested_at").alias("at"), lowered.alias("t"))
    a, b = (rows.select("session_id", *(F.col(c).alias(f"{s}_{c}") for c in ("request_id", "robot_id", "at", "t"))) for s in "ab")
    both = a.join(b, "session_id").where("a_request_id < b_request_id")
    same = F.coalesce(F.col("a_robot_id") == F.col("b_robot_id"), F.lit(False)).cast("int")
    score = (0.2 * F.size(F.array_intersect("a_t", "b_t")) + 0.3 * same) * F.exp(-0.1 * F.abs(F.col("a_at") - F.col("b_at")) / 3600e6 / 24)
    return both.select(F.col("a_request_id").alias("a"), F.col("b_request_id").alias("b"), F.round(score, 6).alias("similarity"))


# Experiments: users are dealt to two arms, a purchase is a success.

_ARMS = """WITH g AS (SELECT CASE WHEN ('0x' || substr(md5(user_id::VARCHAR || ':ranker'), 1, 7))::BIGINT % 10000 < 5000 THEN 't' ELSE 'c' END AS arm, event_type FROM events),
s AS (SELECT count(*) FILTER (WHERE arm = 'c') AS n1, count(*) FILTER (WHERE arm = 'c' AND event_type = 'purchase') AS x1, count(*) FILTER (WHERE arm = 't') AS n2, count(*) FILTER (WHERE arm = 't' AND event_type = 'purchase') AS x2 FROM g), p AS (SELECT *, x1 / n1::DOUBLE AS p1, x2 / n2::DOUBLE AS p2 FROM s) """


def _arms(spark: SparkSession, base: str) -> DataFrame:
    """(n1, x1, n2, x2, p1, p2): trials and successes of both arms, one row."""
    arm = stats.bucket(F.col("user_id"), "ranker") < 5_000
    won = F.col("event_type") == "purchase"
    counts = table(spark, base, "events").agg(
        F.count(F.when(~arm, 1)).alias("n1"), F.count(F.when(~arm & won, 1)).alias("x1"), F.count(F.when(arm, 1)).alias("n2"), F.count(F.when(arm & won, 1)).alias("x2")
    )
    return counts.select("*", (F.col("x1") / F.col("n1")).alias("p1"), (F.col("x2") / F.col("n2")).alias("p2"))


@REGISTRY.query("b04_interval", _ARMS + "SELECT round(p2 - p1 - 1.96 * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2), 8) AS low, round(p2 - p1 + 1.96 * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2), 8) AS high FROM p")
def b04_interval(spark: SparkSession, base: str) -> DataFrame:
    margin = 1.96 * F.sqrt(F.col("p1") * (1 - F.col("p1")) / F.col("n1") + F.col("p2") * (1 - F.col("p2")) / F.col("n2"))
    return _arms(spark, base).select(F.round(F.col("p2") - F.col("p1") - margin, 8).alias("low"), F.round(F.col("p2") - F.col("p1") + margin, 8).alias("high"))


@REGISTRY.query("b06_effect_size", _ARMS + "SELECT round(abs(2 * asin(sqrt(p2)) - 2 * asin(sqrt(p1))), 8) AS cohens_h, round(p2 / p1, 8) AS relative_risk, round((p2 / (1 - p2)) / (p1 / (1 - p1)), 8) AS odds_ratio, round(1 / abs(p2 - p1), 4) AS number_needed FROM p")
def b06_effect_size(spark: SparkSession, base: str) -> DataFrame:
    h, risk, odds, needed = stats.effect_size(F.col("p1"), F.col("p2"))
    return _arms(spark, base).select(F.round(h, 8).alias("cohens_h"), F.round(risk, 8).alias("relative_risk"), F.round(odds, 8).alias("odds_ratio"), F.round(needed, 4).alias("number_needed"))


@REGISTRY.query("b05_bayesian")
def b05_bayesian(spark: SparkSession, base: str) -> DataFrame:
    """The chance that the treatment is better, from 10,000 draws of both posteriors (Beta with half a success and half a failure more); the tests compare with the exact integral."""
    return stats.posterior(_arms(spark, base))


@REGISTRY.query("b08_sequential")
def b08_sequential(spark: SparkSession, base: str) -> DataFrame:
    """What of the error budget of 0.05 each of five looks may spend (O'Brien and Fleming)."""
    return stats.spending(spark, 5)


@REGISTRY.query("b09_power")
def b09_power(spark: SparkSession, base: str) -> DataFrame:
    return _arms(spark, base).select(F.round(stats.power(F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2")), 6).alias("power"))


@REGISTRY.query("b10_sample_size", _ARMS + "SELECT CASE WHEN p1 = 0 OR p2 = 0 OR abs(p2 - p1) < 0.001 THEN 10000 ELSE ceil(2 * ((p1 + p2) / 2 * (1 - (p1 + p2) / 2)) * pow(1.96 + 0.8416, 2) / pow(p2 - p1, 2))::BIGINT END AS needed FROM p")
def b10_sample_size(spark: SparkSession, base: str) -> DataFrame:
    p1, p2 = F.col("p1"), F.col("p2")
    mean = (p1 + p2) / 2
    n = F.ceil(2 * (mean * (1 - mean)) * (1.96 + 0.8416) ** 2 / F.pow(p2 - p1, F.lit(2.0)))
    return _arms(spark, base).select(F.when((p1 == 0) | (p2 == 0) | (F.abs(p2 - p1) < 0.001), F.lit(10_000)).otherwise(n).cast("bigint").alias("needed"))


@REGISTRY.query("b12_counters", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(count(*) FILTER (WHERE event_type = 'click') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0)::DOUBLE, 6) AS rate FROM events GROUP BY 1")
def b12_counters(spark: SparkSession, base: str) -> DataFrame:
    seen, clicked = F.count(F.when(F.col("event_type") == "view", 1)), F.count(F.when(F.col("event_type") == "click", 1))
    return table(spark, base, "events").groupBy("user_id").agg(seen.alias("impressions"), clicked.alias("clicks"), F.round(F.try_divide(clicked, seen), 6).alias("rate"))


@REGISTRY.query("b11_analysis", _ARMS + "SELECT n1, x1, n2, x2, round(p1, 8) AS control_rate, round(p2, 8) AS treatment_rate, round(abs(2 * asin(sqrt(p2)) - 2 * asin(sqrt(p1))), 8) AS cohens_h, abs(2 * asin(sqrt(p2)) - 2 * asin(sqrt(p1))) < 0.2 AS negligible FROM p")
def b11_analysis(spark: SparkSession, base: str) -> DataFrame:
    h = stats.effect_size(F.col("p1"), F.col("p2"))[0]
    return _arms(spark, base).select("n1", "x1", "n2", "x2", F.round("p1", 8).alias("control_rate"), F.round("p2", 8).alias("treatment_rate"), F.round(h, 8).alias("cohens_h"), (h < 0.2).alias("negligible"))
