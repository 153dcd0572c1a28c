"""Scores that age, strengthen and combine. Every function takes and gives Columns; `as_of` is always explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_days(then: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(then)) / F.lit(86_400e6)


def age_hours(then: Column, as_of: Column) -> Column:
    return age_days(then, as_of) * 24.0


def forgetting_curve(days: Column, potentiated: Column | None = None) -> Column:
    """Exponential in the first three days, a power law after them; potentiated rows forget at half the rate."""
    strong = F.lit(False) if potentiated is None else potentiated
    rate = F.when(strong, 0.693 / 2).otherwise(0.693)
    power = F.when(strong, 0.3).otherwise(0.5)
    late = F.exp(-rate * 3.0) * F.pow(F.greatest(days, F.lit(3.0)) / 3.0, -power)
    return F.when(days <= 0, 1.0).when(days < 3, F.exp(-rate * days)).otherwise(late)


#: Of each tier of an edge: decay rate, length of its time unit in hours, longest life in units.
TIERS = {"L1": (0.029, 1.0, 48.0), "L2": (0.031, 24.0, 30.0), "L3": (0.02, 720.0, 1e9)}


def tier_decay(strength: Column, hours: Column, tier: str, floor: float = 0.001) -> Column:
    rate, unit, longest = TIERS[tier]
    units = hours / unit
    return F.when(units > longest, F.lit(floor)).otherwise(F.greatest(strength * F.exp(-rate * units), F.lit(floor)))


def strengthen(strength: Column, rate: float = 0.1) -> Column:
    """One Hebbian step towards 1."""
    return F.least(strength + rate * (1 - strength), F.lit(1.0))


def recency_step(days: Column) -> Column:
    return F.when(days <= 7, 1.0).when(days <= 30, 0.7).when(days <= 90, 0.4).otherwise(0.1)


def salience(days: Column, importance: Column, access_count: Column | None = None) -> Column:
    base = 0.6 * recency_step(days) + 0.4 * importance
    if access_count is None:
        return base
    return base + F.least(0.05 * F.log2(F.greatest(access_count, F.lit(1)).cast("double")), F.lit(0.3))


def temporal_match(days_apart: Column) -> Column:
    d = F.abs(days_apart)
    return F.when(d == 0, 0.5).when(d <= 7, 0.3 * (1 - d / 7)).when(d <= 30, 0.1 * (1 - d / 30)).otherwise(0.0)


def unified(base: Column, importance: Column, hours: Column, arousal: Column, credibility: Column, temporal: Column, feedback: Column) -> Column:
    boost = 1 + 0.5 * F.exp(-0.01 * hours) + 0.15 * arousal + 0.2 * F.greatest(credibility - 0.5, F.lit(0.0)) + temporal
    return base * (0.7 + 0.3 * importance) * F.least(F.lit(2.5), boost) * feedback


def interference(intensity: Column, advantage: Column) -> Column:
    """Between half and one and a half, by how strong a competitor is and who has the advantage."""
    return F.least(F.greatest(1 + 0.5 * intensity * (2 * advantage - 1), F.lit(0.5)), F.lit(1.5))


def overlap_signal(ratio: Column) -> Column:
    return F.when(ratio >= 0.4, 0.8 * ratio).when(ratio >= 0.1, 0.3 * ratio).otherwise(-0.2)


def half_life_decay(value: Column, days: Column, half_life: float = 14.0, grace: float = 0.1) -> Column:
    return F.when(days <= grace, value).otherwise(value * F.pow(F.lit(0.5), days / half_life))


def fact_confidence(confidence: Column, days: Column, support: Column, contradicted: Column) -> Column:
    """No decay for 90 days, then a half-life of 180 days and 30 more for each support that isn't contradicted."""
    half = 180 + 30 * F.when(contradicted, 0).otherwise(support)
    return F.when(days <= 90, confidence).otherwise(confidence * F.pow(F.lit(0.5), (days - 90) / half))


def reinforced(confidence: Column) -> Column:
    return confidence + 0.1 * (1 - confidence)


def aroused_decay(rate: Column, arousal: Column) -> Column:
    return rate * (1 - 0.3 * arousal)


def velocity(hours: Column, weight: Column, window_hours: float = 24.0) -> Column:
    """What one event adds to the learning velocity; sum it over events inside the window."""
    return F.exp(-hours / window_hours) * weight * (24.0 / window_hours)


def recency_boost(speed: Column, potentiated: Column) -> Column:
    boost = 1 + 0.05 + F.least(0.05 * speed, F.lit(0.15)) + F.when(potentiated, 0.1).otherwise(0.0)
    return F.when(speed > 0, F.least(boost, F.lit(1.3))).otherwise(F.lit(1.0))


def leg_weights(density: Column) -> tuple[Column, Column, Column]:
    """(semantic, graph, linguistic) weights: a sparse graph is trusted, a dense one is not."""
    graph = F.when(density <= 0.5, 0.5).when(density >= 2.0, 0.1).otherwise(0.5 - 0.4 * (density - 0.5) / 1.5)
    return 0.85 - graph, graph, F.lit(0.15)


def hops(density: Column) -> Column:
    return F.when(density > 2.0, 2).when(density < 0.5, 4).otherwise(3)


def replay_priority(days: Column, importance: Column, arousal: Column, connections: Column) -> Column:
    return importance * (1 - days / 14) * (1 + arousal) * (1 + F.least(connections / 10, F.lit(0.5)))


def sigmoid(x: Column, steep: float = 10.0, centre: float = 0.5) -> Column:
    return 1 / (1 + F.exp(-steep * (x - centre)))


def amplified(momentum: Column) -> Column:
    return F.when(momentum > 0.65, momentum * 1.5).when(momentum < 0.40, momentum * 0.3).otherwise(momentum)


def window_boost(hours: Column, window: float) -> Column:
    return F.when((hours >= 0) & (hours <= window), 1 - hours / window).otherwise(0.0)


def spread_decay(importance: Column) -> Column:
    """How much a spread loses at a node: 0.15 for what doesn't matter, 0.05 for what matters most."""
    return 0.15 - 0.1 * importance
