"""Streams of memories: deduplicated, windowed, buffered per session.

A session's buffer is drained when it holds enough messages, when a message of an urgent kind arrives, or when enough time has gone by
in the messages' own clock; duplicates of a session are dropped by content hash, of which a bounded number of the newest is kept. What is
still buffered when the input ends is drained with the reason "close" (`drained_to_end`).
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessaline.functions.text import normalised_hash


@dataclass(frozen=True)
class Buffering:
    """When a buffer is drained, and how many hashes a session remembers; values are kept in sane limits."""

    messages: int = 50
    seconds: int = 5
    urgent: tuple[str, ...] = ("Error", "Decision", "Discovery", "Learning")
    remembered: int = 10_000

    def clamped(self) -> Buffering:
        return Buffering(min(max(self.messages, 1), 10_000), min(max(self.seconds, 0), 3_600), self.urgent[:100], min(max(self.remembered, 1), 10_000))


def deduplicated(stream: DataFrame, key: str = "memory_id", time: str = "received_at", late: str = "3 days") -> DataFrame:
    """Each key once, within the time that late rows are waited for."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windows(stream: DataFrame, time: str = "received_at", late: str = "3 days", size: str = "1 day", by: str = "memory_type") -> DataFrame:
    counted = stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by)
    return counted.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def gaps(stream: DataFrame, time: str = "received_at", late: str = "3 days", gap: str = "30 minutes", by: str = "user_id") -> DataFrame:
    counted = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by)
    return counted.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


DRAINED = "user_id string, reason string, messages int, first_at timestamp, last_at timestamp, text string"
_STATE = "hashes array<string>, texts array<string>, first_at timestamp, last_at timestamp"


#: Drained buffers handed on at once, rows of a sorted run read at once.
_AT_ONCE = 1_000


def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(memory_type, content, received_at, hash) by time, then hash: each batch is sorted and laid on disk, then all are merged."""
    columns = ["memory_type", "content", "received_at", "hash"]

    def run(file) -> Iterator[tuple]:
        file.seek(0)
        while rows := pickle.load(file):
            yield from rows

    def place(row: tuple) -> tuple:
        return (True, 0, row[3]) if pd.isna(row[2]) else (False, row[2].value, row[3])

    with ExitStack() as files:
        runs = []
        for b in batches:
            rows = sorted(b[columns].itertuples(index=False, name=None), key=place)
            file = files.enter_context(tempfile.TemporaryFile())
            for i in range(0, len(rows), _AT_ONCE):
                pickle.dump(rows[i : i + _AT_ONCE], file)
            pickle.dump([], file)
            runs.append(file)
        yield from heapq.merge(*(run(f) for f in runs), key=place)


def buffered(stream: DataFrame, rules: Buffering | None = None) -> DataFrame:
    """Drained buffers of each user's stream of (user_id, memory_type, content, received_at)."""
    rules = (rules or Buffering()).clamped()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hashes, texts, first, last = state.get if state.exists else ([], [], None, None)
        texts, out = list(texts), []
        seen = dict.fromkeys(hashes)  # oldest first

        columns = ["user_id", "reason", "messages", "first_at", "last_at", "text"]

        def drain(reason: str) -> None:
            nonlocal texts, first, last
            if texts:
                out.append((key[0], reason, len(texts), first, last, "\n".join(texts)))
            texts, first, last = [], None, None

        for kind, content, at, h in in_order(batches):
            if h in seen:
                continue
            seen[h] = None
            if len(seen) > rules.remembered:
                del seen[next(iter(seen))]
            if rules.seconds and first is not None and (at - first).total_seconds() >= rules.seconds:
                drain("time")
            texts.append(content)
            first, last = first if first is not None else at, at
            if kind in rules.urgent:
                drain("urgent")
            elif len(texts) >= rules.messages:
                drain("count")
            if len(out) >= _AT_ONCE:
                yield pd.DataFrame(out, columns=columns)
                out = []
        state.update((list(seen), texts, first, last))
        yield pd.DataFrame(out, columns=columns)

    hashed = stream.where("content is not null and user_id is not null").select("user_id", "memory_type", "content", "received_at", normalised_hash(F.col("content")).alias("hash"))
    return hashed.groupBy("user_id").applyInPandasWithState(step, DRAINED, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Everything that is there goes through the stream once; the result as a table in `folder`."""
    out = f"{folder}/{name}"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/{name}.state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def updated_to_end(stream: DataFrame, folder: str, name: str, keys: list[str]) -> DataFrame:
    """The last value of each key of an aggregation that is written as it changes: every batch's changes go to files, no result to the driver."""
    out = f"{folder}/{name}"

    def write(changed: DataFrame, batch: int) -> None:
        # A batch that is tried again replaces what it wrote.
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/{name}.state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def drained_to_end(drained: DataFrame, folder: str, name: str) -> DataFrame:
    """All drained buffers of a stream that has come to its end, those that were open then, read from its state, with the reason "close"."""
    done = run_to_end(drained, folder, name)
    state = drained.sparkSession.read.format("statestore").load(f"{folder}/{name}.state")
    left = state.select("key.*", "value.groupState.*").where(F.size("texts") > 0)
    closed = left.select("user_id", F.lit("close").alias("reason"), F.size("texts").alias("messages"), "first_at", "last_at", F.array_join("texts", "\n").alias("text"))
    return done.unionByName(closed)
