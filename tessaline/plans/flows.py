"""Queries over streams and exchange formats. Streams read the table's files to their end and give what a batch would."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.plans.memories import memories
from tessaline.plans.registry import Registry
from tessaline.runtime import shared_folder, table
from tessaline.sources import exchange
from tessaline.streaming import sessions

REGISTRY = Registry()


def incoming(spark: SparkSession, base: str) -> DataFrame:
    path = f"{base}/remember_requests.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + ("*" if path.endswith(".parquet") else ""))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@REGISTRY.query("t03_stream_dedup", "SELECT memory_type, count(DISTINCT memory_id) AS n FROM remember_requests GROUP BY 1")
def t03_stream_dedup(spark: SparkSession, base: str) -> DataFrame:
    seen = sessions.deduplicated(incoming(spark, base).select("memory_id", "memory_type", "received_at"), late="4 days")
    return sessions.run_to_end(seen, _folder(spark), "t03").groupBy("memory_type").agg(F.count("*").alias("n"))


@REGISTRY.query("t05_stream_windows", "SELECT epoch_us(date_trunc('day', received_at)) // 86400000000 AS day, memory_type, count(*) AS n FROM remember_requests GROUP BY ALL")
def t05_stream_windows(spark: SparkSession, base: str) -> DataFrame:
    counted = sessions.windows(incoming(spark, base).select("memory_type", "received_at"))
    rows = sessions.updated_to_end(counted, _folder(spark), "t05", ["start", "memory_type"])
    return rows.select(F.floor(F.unix_micros("start") / 86_400_000_000).alias("day"), "memory_type", "n")


@REGISTRY.query("t02_stream_buffer")
def t02_stream_buffer(spark: SparkSession, base: str) -> DataFrame:
    drained = sessions.buffered(incoming(spark, base).select("user_id", "memory_type", "content", "received_at"), sessions.Buffering(messages=20, seconds=3_600))
    return sessions.drained_to_end(drained, _folder(spark), "t02").groupBy("user_id", "reason").agg(F.count("*").alias("drains"), F.sum("messages").alias("messages"))


@REGISTRY.query("d15_hash_chain", """
WITH RECURSIVE r AS (SELECT session_id AS session, row_number() OVER (PARTITION BY session_id ORDER BY requested_at, request_id) AS seq, query_text AS payload FROM recall_requests WHERE session_id IS NOT NULL AND query_text IS NOT NULL AND requested_at IS NOT NULL),
c AS (SELECT session, seq, payload, sha256('|1|' || payload) AS hash FROM r WHERE seq = 1 UNION ALL SELECT r.session, r.seq, r.payload, sha256(c.hash || '|' || r.seq || '|' || r.payload) FROM c JOIN r ON r.session = c.session AND r.seq = c.seq + 1)
SELECT session, seq, hash FROM c""")
def d15_hash_chain(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "recall_requests").where("session_id is not null and query_text is not null and requested_at is not null").select("session_id", "requested_at", "request_id", "query_text")
    return exchange.chained(rows, "session_id", ["requested_at", "request_id"], "query_text").select("session", "seq", "hash")


@REGISTRY.query("d16_verify_chain", """
WITH RECURSIVE r AS (SELECT session_id AS session, row_number() OVER (PARTITION BY session_id ORDER BY requested_at, request_id) AS seq, query_text AS payload FROM recall_requests WHERE session_id IS NOT NULL AND query_text IS NOT NULL AND requested_at IS NOT NULL),
c AS (SELECT session, seq, payload, '' AS prev_hash, sha256('|1|' || payload) AS hash FROM r WHERE seq = 1 UNION ALL SELECT r.session, r.seq, r.payload, c.hash, sha256(c.hash || '|' || r.seq || '|' || r.payload) FROM c JOIN r ON r.session = c.session AND r.seq = c.seq + 1),
t AS (SELECT session, seq, CASE WHEN seq = 2 AND session LIKE '%1' THEN payload || '!' ELSE payload END AS payload, CASE WHEN seq = 3 AND session LIKE '%2' THEN 'x' ELSE prev_hash END AS prev_hash, hash FROM c WHERE NOT (seq = 2 AND session LIKE '%3')),
l AS (SELECT *, coalesce(lag(hash) OVER w, '') AS was, coalesce(lag(seq) OVER w, 0) AS before FROM t WINDOW w AS (PARTITION BY session ORDER BY seq))
SELECT session, seq, CASE WHEN seq <> before + 1 THEN 'gap' WHEN prev_hash <> was THEN 'link' ELSE 'hash' END AS fault FROM l WHERE seq <> before + 1 OR prev_hash <> was OR hash <> sha256(prev_hash || '|' || seq || '|' || payload)""")
def d16_verify_chain(spark: SparkSession, base: str) -> DataFrame:
    """A chain with planted faults: payloads changed after the fact, links broken, records removed."""
    rows = table(spark, base, "recall_requests").where("session_id is not null and query_text is not null and requested_at is not null").select("session_id", "requested_at", "request_id", "query_text")
    log = exchange.chained(rows, "session_id", ["requested_at", "request_id"], "query_text")
    ends = lambda x: F.col("session").endswith(x)
    seq = F.col("seq")
    broken = log.withColumn("payload", F.when((seq == 2) & ends("1"), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    broken = broken.withColumn("prev_hash", F.when((seq == 3) & ends("2"), "x").otherwise(F.col("prev_hash"))).where(~((seq == 2) & ends("3")))
    return exchange.chain_faults(broken)


@REGISTRY.query("s39_issue_records", "SELECT event_id, 'Issue #' || event_id || ': ' || event_type || ' of user ' || user_id || chr(10) || 'State: open' || chr(10) || 'Labels: ' || event_type || chr(10) || 'value ' || round(value * 100)::BIGINT AS record FROM events WHERE user_id = 8")
def s39_issue_records(spark: SparkSession, base: str) -> DataFrame:
    """Webhook payloads (made of events here) as readable records."""
    name = F.col("event_type")
    payload = F.to_json(F.struct(F.col("event_id").alias("number"), F.concat(name, F.lit(" of user "), F.col("user_id").cast("string")).alias("title"), F.lit("open").alias("state"), F.array(F.struct(name.alias("name"))).alias("labels"), F.concat(F.lit("value "), F.round(F.col("value") * 100).cast("bigint").cast("string")).alias("body")))
    return table(spark, base, "events").where("user_id = 8").select("event_id", exchange.issue_text(payload).alias("record"))


@REGISTRY.query("s40_pull_records", "SELECT event_id, 'Change #' || event_id || ': ' || event_type || chr(10) || 'State: ' || CASE WHEN event_id % 2 = 0 THEN 'merged' ELSE 'open' END || chr(10) || 'Branch: fix-' || user_id || ' into main' || chr(10) || 'b' AS record FROM events WHERE user_id = 8")
def s40_pull_records(spark: SparkSession, base: str) -> DataFrame:
    payload = F.to_json(F.struct(
        F.col("event_id").alias("number"), F.col("event_type").alias("title"), F.lit("open").alias("state"), (F.col("event_id") % 2 == 0).alias("merged"), F.struct(F.concat(F.lit("fix-"), F.col("user_id").cast("string")).alias("ref")).alias("head"),
        F.struct(F.lit("main").alias("ref")).alias("base"), F.lit("b").alias("body"),
    ))
    return table(spark, base, "events").where("user_id = 8").select("event_id", exchange.pull_text(payload).alias("record"))


@REGISTRY.query("s41_commit_records", "SELECT event_id, 'Commit ' || left(md5(event_id::VARCHAR), 7) || ' by ' || event_type || chr(10) || 'm' AS record FROM events WHERE user_id = 8")
def s41_commit_records(spark: SparkSession, base: str) -> DataFrame:
    author = F.struct(F.struct(F.col("event_type").alias("name")).alias("author"), F.lit("m").alias("message"))
    payload = F.to_json(F.struct(F.md5(F.col("event_id").cast("string")).alias("sha"), author.alias("commit")))
    return table(spark, base, "events").where("user_id = 8").select("event_id", exchange.commit_text(F.get_json_object(payload, "$")).alias("record"))


@REGISTRY.query("d22_import_skips_known", "SELECT min(id) AS id, sha256(content) AS content_hash FROM smoke_corpus WHERE content IS NOT NULL AND sha256(content) NOT IN (SELECT sha256(content) FROM remember_requests WHERE content IS NOT NULL) GROUP BY 2")
def d22_import_skips_known(spark: SparkSession, base: str) -> DataFrame:
    new = table(spark, base, "smoke_corpus").where("content is not null").select("id", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    first = new.groupBy("content_hash").agg(F.min("id").alias("id"))
    return exchange.fresh(first, table(spark, base, "remember_requests").where("content is not null")).select("id", "content_hash")


@REGISTRY.query("d21_export", "SELECT count(*) AS documents, count(DISTINCT content) AS contents FROM (SELECT DISTINCT memory_id, content FROM remember_requests)")
def d21_export(spark: SparkSession, base: str) -> DataFrame:
    """Written as JSON lines and read again."""
    out = _folder(spark)
    exchange.export(memories(spark, base)).write.text(out)
    back = exchange.read_exchange(spark, out)
    return back.agg(F.countDistinct("memory_id").alias("documents"), F.countDistinct("content").alias("contents"))
