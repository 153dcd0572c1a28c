"""A feedback average whose weights depend on its own state: a fold in the order of time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000
SCHEMA = "key string, average double, stability double, signals bigint"


def step(state: tuple[float, float, int, int, int], at: int, signal: float, base: float = 0.5, confidence: float = 0.9) -> tuple[float, float, int, int, int]:
    """(average, stability, signals, first, last) after one more signal."""
    average, stability, n, first, last = state
    first = at if n == 0 else first
    days, gap = (at - first) / (24 * HOUR), (at - last) / HOUR if n else 0.0
    age = 0.8 if days < 1 else 0.9 if days < 7 else 1.0 if days < 30 else 1.1
    history = 0.7 if n <= 2 else 0.9 if n <= 9 else 1.0 if n <= 49 else 1.1
    inertia = min(0.99, max(0.5, base * age * history * (0.8 + stability * 0.4)))
    recency = 1.0 if gap < 1 else 0.9 if gap < 24 else 0.7 if gap < 168 else 0.5
    alpha = (1.0 - inertia) * recency * confidence
    same = (signal > 0) == (average > 0) or abs(average) < 1.2e-7
    stability = min(1.0, stability + 0.05) if same else max(0.0, stability - 0.1 * abs(signal - average))
    return average * (1.0 - alpha) + signal * alpha, stability, n + 1, first, at


def fold(signals: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, average, stability, signals) of every key after all its signals.

    Rows are hashed by key and sorted by key and time within their partitions (an external sort), then streamed: a task holds one state, however many
    signals a key has. A hot key is one sorted run; its fold is sequential by its nature.
    """
    rows = signals.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("key"), *order, F.col(value).cast("double").alias("signal"))
    placed = rows.repartition("key").sortWithinPartitions("key", *order).select("key", F.col(order[0]).alias("at"), "signal")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, done = None, None, []
        for b in batches:
            for k, at, signal in b.itertuples(index=False, name=None):
                if k != now:
                    if now is not None:
                        done.append((now, round(state[0], 6), round(state[1], 6), state[2]))
                    now, state = k, (0.0, 0.5, 0, 0, 0)
                state = step(state, at, signal)
            yield pd.DataFrame(done, columns=["key", "average", "stability", "signals"])
            done = []
        if now is not None:
            yield pd.DataFrame([(now, round(state[0], 6), round(state[1], 6), state[2])], columns=["key", "average", "stability", "signals"])

    return placed.mapInPandas(run, SCHEMA)
