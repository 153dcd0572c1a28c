"""Sources and sinks of records: exchange documents, webhook payloads, delimited news, hash-chained logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The exchange format of a memory, one JSON document a line.
EXCHANGE = "memory_id string, content string, memory_type string, tags array<string>, created_at timestamp, content_hash string"


def export(rows: DataFrame) -> DataFrame:
    """One JSON document per record in `value`, with the hash of its content; write it with `.write.text`."""
    doc = F.struct("memory_id", "content", "memory_type", "tags", "created_at", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    return rows.select(F.to_json(doc).alias("value"))


def read_exchange(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXCHANGE).json(path)


def fresh(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The incoming records whose content isn't stored yet, each content once."""
    known = stored.select(F.sha2(F.col("content").cast("binary"), 256).alias("content_hash")).distinct()
    return incoming.join(known, "content_hash", "left_anti").dropDuplicates(["content_hash"])


def issue_text(issue: Column) -> Column:
    """A readable record of an issue payload (title, number, state, labels, body), as a JSON string column."""
    field = lambda p: F.get_json_object(issue, f"$.{p}")
    labels = F.array_join(F.from_json(F.get_json_object(issue, "$.labels"), "array<struct<name:string>>")["name"], ", ")
    return F.concat_ws("\n", F.concat(F.lit("Issue #"), field("number"), F.lit(": "), field("title")), F.concat(F.lit("State: "), field("state")), F.when(labels != "", F.concat(F.lit("Labels: "), labels)), field("body"))


def pull_text(pull: Column) -> Column:
    """The same of a change request: title, number, branches, whether it is merged, body."""
    field = lambda p: F.get_json_object(pull, f"$.{p}")
    state = F.when(field("merged") == "true", "merged").otherwise(field("state"))
    return F.concat_ws("\n", F.concat(F.lit("Change #"), field("number"), F.lit(": "), field("title")), F.concat(F.lit("State: "), state), F.concat(F.lit("Branch: "), field("head.ref"), F.lit(" into "), field("base.ref")), field("body"))


def commit_text(commit: Column) -> Column:
    field = lambda p: F.get_json_object(commit, f"$.{p}")
    return F.concat_ws("\n", F.concat(F.lit("Commit "), F.substring(field("sha"), 1, 7), F.lit(" by "), field("commit.author.name")), field("commit.message"))


def signed(body: bytes, signature: str, secret: bytes) -> bool:
    """Whether a webhook's signature fits, compared in constant time."""
    import hmac

    return hmac.compare_digest("sha256=" + hmac.new(secret, body, hashlib.sha256).hexdigest(), signature)


def chained(rows: DataFrame, session: str, order: list[str], payload: str) -> DataFrame:
    """(session, seq, payload, prev_hash, hash): each session's log, in which a record's hash covers the one before.

    A chain is sequential by nature. Rows are sorted by session and time within hashed partitions (an external sort) and streamed: a task holds one
    hash, however long a session is.
    """
    kind = dict(rows.dtypes)[session]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seq, prev, started = None, 0, "", False
        for b in batches:
            out = []
            for s, p in zip(b[session], b[payload], strict=True):
                if not started or s != now:
                    now, seq, prev, started = s, 0, "", True
                seq += 1
                h = hashlib.sha256(f"{prev}|{seq}|{p}".encode()).hexdigest()
                out.append((s, seq, p, prev, h))
                prev = h
            yield pd.DataFrame(out, columns=["session", "seq", "payload", "prev_hash", "hash"])

    placed = rows.repartition(session).sortWithinPartitions(session, *order).select(session, payload)
    return placed.mapInPandas(link, f"session {kind}, seq bigint, payload string, prev_hash string, hash string")


def chain_faults(log: DataFrame) -> DataFrame:
    """(session, seq, fault) of records whose number, link or hash is wrong; a window and a hash, nothing sequential."""
    from pyspark.sql import Window as W

    w = W.partitionBy("session").orderBy("seq")
    prev, before = F.coalesce(F.lag("hash").over(w), F.lit("")), F.coalesce(F.lag("seq").over(w), F.lit(0))
    want = F.sha2(F.concat_ws("|", F.col("prev_hash"), F.col("seq").cast("string"), F.col("payload")).cast("binary"), 256)
    fault = F.when(F.col("seq") != before + 1, "gap").when(F.col("prev_hash") != prev, "link").when(F.col("hash") != want, "hash")
    return log.withColumn("fault", fault).where("fault is not null").select("session", "seq", "fault")

