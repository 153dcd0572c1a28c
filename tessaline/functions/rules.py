"""Rules of scoring by kinds, texts and use, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of kinds of records.
EDGE_WEIGHTS = {
    "Decision": 1.0, "Learning": 1.0, "Discovery": 1.0, "Error": 0.9, "Pattern": 1.0, "Observation": 0.8, "Context": 0.7, "Task": 0.8, "Conversation": 0.5, "CodeEdit": 0.3, "FileAccess": 0.25, "Search": 0.25, "Command": 0.3,
    "Intention": 0.9,
}
ACTIVATION_WEIGHTS = {
    "Decision": 1.0, "Learning": 1.0, "Discovery": 1.0, "Error": 0.95, "Pattern": 1.0, "Observation": 0.85, "Context": 0.75, "Task": 0.85, "Conversation": 0.6, "CodeEdit": 0.4, "FileAccess": 0.35, "Search": 0.35, "Command": 0.4,
    "Intention": 0.95,
}
INERTIA = {
    "Learning": 0.95, "Decision": 0.90, "Pattern": 0.85, "Discovery": 0.75, "Context": 0.60, "Task": 0.50, "Observation": 0.40, "Conversation": 0.30, "Error": 0.20, "CodeEdit": 0.50, "FileAccess": 0.40, "Search": 0.35, "Command": 0.35,
    "Intention": 0.60,
}
IMPORTANCE_KINDS = {"Decision": 0.3, "Error": 0.25, "Learning": 0.25, "Discovery": 0.2, "Pattern": 0.2, "Task": 0.15, "Conversation": 0.1, "Context": 0.1}
#: Words of technical texts.
TECHNICAL = ("algorithm", "architecture", "implementation", "optimization", "performance", "security", "database", "api", "framework")


def steps(value: Column, levels: list[tuple[float, float]], other: float, above: bool = True) -> Column:
    """The result of the first level that `value` is above (or below)."""
    out = F.lit(other)
    for bound, result in reversed(levels):
        out = F.when(value > bound if above else value < bound, result).otherwise(out)
    return out


def by_kind(kind: Column, values: dict[str, float], other: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.coalesce(kind, F.lit(""))), F.lit(other))


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != ""))


def _any(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def importance(kind: Column, content: Column, entities: Column, reward: Column) -> Column:
    n = F.coalesce(F.size(entities), F.lit(0))
    low = F.lower(content)
    technical = sum((F.when(low.contains(t), 1).otherwise(0) for t in TECHNICAL), F.lit(0))
    quality = F.least(F.lit(0.1), 0.015 * technical + F.when(content.contains("?"), 0.02).otherwise(0.0) + F.when(_any(content, "```", "fn ", "function ", "class "), 0.03).otherwise(0.0))
    gain = F.when(reward.isNull() | F.isnan(reward), 0.0).otherwise(F.abs(reward) * 0.15)
    total = (
        by_kind(kind, IMPORTANCE_KINDS, 0.05) + steps(words(content), [(50, 0.25), (20, 0.15), (5, 0.08)], 0.02) + steps(n, [(10, 0.2), (5, 0.15), (2, 0.1), (0, 0.05)], 0.0) + quality + gain
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def flow_signal(derived: Column) -> Column:
    """What a response that takes a share of its words from a memory says about that memory."""
    return F.when(derived >= 0.5, 0.6 + (derived - 0.5) * 0.4).when(derived >= 0.2, derived * 1.5).when(1 - derived >= 0.8, -0.1).otherwise(0.0)


def age_factor(days: Column) -> Column:
    return steps(days, [(1, 0.8), (7, 0.9), (30, 1.0)], 1.1, above=False)


def recency_weight(seconds: Column) -> Column:
    return steps(seconds, [(3_600, 1.0), (86_400, 0.9), (604_800, 0.7)], 0.5, above=False)


def inertia(kind: Column, days: Column, signals: Column, stability: Column) -> Column:
    history = steps(signals, [(3, 0.7), (10, 0.9), (50, 1.0)], 1.1, above=False)
    value = by_kind(kind, INERTIA, 0.4) * age_factor(days) * history * (0.8 + stability * 0.4)
    return F.least(F.lit(0.99), F.greatest(F.lit(0.5), value))


def interference(similarity: Column, new: Column, old: Column, threshold: float = 0.85) -> tuple[Column, Column]:
    """(retroactive, proactive) loss: what is less important than the new row loses, and what is very important weakens the new row."""
    strength = (similarity - threshold) / (1 - threshold)
    return F.when(old < new, 0.1 * strength).otherwise(0.0), F.when(old > 0.8, 0.05 * strength * (old - 0.8)).otherwise(0.0)


def would_decay(confidence: Column, days: Column, support: Column) -> Column:
    return F.when(days <= 90, False).otherwise(confidence * F.pow(F.lit(0.5), (days - 90) / (180.0 + support * 30.0)) < 0.1)


def stream_importance(content: Column, mode: Column) -> Column:
    low, n = F.lower(content), words(content)
    length = F.when(n > 50, 0.1).when(n < 10, -0.1).otherwise(0.0)
    talk = F.when(content.contains("?"), 0.15).otherwise(0.0) + F.when(_any(content, "```", "fn ", "def "), 0.2).otherwise(0.0) + F.when(_any(low, "error", "failed"), 0.2).otherwise(0.0)
    event = F.when(low.contains("error"), 0.3).when(low.contains("warning"), 0.15).otherwise(0.0)
    value = 0.5 + length + F.when(mode == "conversation", talk).otherwise(event)
    return F.when(mode == "sensor", 0.4).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def kind_of_tags(tags: Column) -> Column:
    """The kind that the first telling tag names."""
    def kind(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for name in ("Discovery", "Learning", "Decision", "Error"):
            out = F.when(F.lower(t).contains(name.lower()), name).otherwise(out)
        return out

    return F.get(F.filter(F.transform(tags, kind), lambda k: k.isNotNull()), F.lit(0))


def amplified_momentum(average: Column) -> Column:
    """From -1..1 to 0..1; what has proved helpful counts half as much again, what hasn't less than a third."""
    m = (average + 1) / 2
    return F.when(m > 0.65, F.least(m * 1.5, F.lit(1.0))).when(m < 0.40, m * 0.3).otherwise(m)


def access_score(count: Column) -> Column:
    return F.when(count == 0, 0.0).otherwise(F.least(F.log2(count.cast("double") + 1) / 4, F.lit(1.0)))
