"""Scans of memories by predicate. Everything becomes one conjunction, so Catalyst can push it to the files."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.functions.places import haversine

#: A reserved kind that a filter without kinds leaves out.
HIDDEN_KIND = "Intention"


@dataclass(frozen=True)
class MemoryFilter:
    """All clauses hold together; a clause that isn't given doesn't count. A null in the row fails a given clause."""

    kinds: tuple[str, ...] | None = None
    min_importance: float | None = None
    since: datetime | None = None
    until: datetime | None = None
    robot_id: str | None = None
    mission_id: str | None = None
    action_type: str | None = None
    outcome_type: str | None = None
    terrain_type: str | None = None
    reward: tuple[float, float] | None = None
    tags: tuple[str, ...] | None = None
    failures_only: bool = False
    near: tuple[float, float, float] | None = None
    episode_id: str | None = None
    user_id: str | None = None
    severity: str | None = None
    pattern_id: str | None = None
    confidence: tuple[float, float] | None = None
    anomalies_only: bool = False
    #: Columns that bear a clause's field under another name.
    names: dict[str, str] = field(default_factory=dict)

    def column(self) -> Column:
        named = lambda c: F.col(self.names.get(c, c))
        c: list[Column] = []
        kind = F.col("memory_type")
        c.append(kind.isin(*self.kinds) if self.kinds else F.coalesce(kind != HIDDEN_KIND, F.lit(True)))
        if self.min_importance is not None:
            c.append(F.col("importance").cast("double") >= self.min_importance)
        if self.since is not None:
            c.append(F.col("created_at") >= F.lit(self.since))
        if self.until is not None:
            c.append(F.col("created_at") <= F.lit(self.until))
        for name in ("robot_id", "mission_id", "action_type", "outcome_type", "terrain_type", "episode_id", "user_id", "severity", "pattern_id"):
            value = getattr(self, name)
            if value is not None:
                c.append(named(name) == value)
        for name in ("reward", "confidence"):
            bounds = getattr(self, name)
            if bounds is not None:
                c.append(~F.isnan(named(name)) & named(name).cast("double").between(*bounds))
        if self.anomalies_only:
            c.append(named("is_anomaly"))
        if self.tags is not None:
            c.append(any_tag(F.col("tags"), self.tags))
        if self.failures_only:
            c.append(F.coalesce(F.lower("outcome_type").isin("failure", "failed", "error"), F.lit(False)) | F.coalesce("is_failure", F.lit(False)))
        if self.near is not None:
            lat, lon, radius = self.near
            at = lambda i: F.get("geo_location", F.lit(i))
            c.append(haversine(F.lit(lat), F.lit(lon), at(0), at(1)) <= radius)
        out = c[0]
        for x in c[1:]:
            out = out & x
        return out


def any_tag(tags: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.transform(tags, lambda t: F.lower(t)), F.array(*(F.lit(t.lower()) for t in wanted)))


def day_index(rows: DataFrame, first: date, last: date) -> DataFrame:
    """Rows of whole days, both inclusive."""
    return rows.where(F.to_date("created_at").between(F.lit(first), F.lit(last)))


def importance_buckets(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Buckets of a tenth; both end buckets are whole."""
    bucket = lambda c: F.floor(c * 10)
    return rows.where(bucket(F.col("importance").cast("double")).between(bucket(F.lit(low)), bucket(F.lit(high))))


def reward_buckets(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Rewards are clamped to [-1, 1] and cut into buckets of a tenth; both end buckets are whole."""
    bucket = lambda c: ((F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)) + 1) * 10).cast("int")
    return rows.where(~F.isnan("reward") & bucket(F.col("reward").cast("double")).between(bucket(F.lit(low)), bucket(F.lit(high))))


def by_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """The row whose id begins with `prefix`; none when several do. Only two rows are looked at."""
    hits = rows.where(F.col(column).startswith(prefix)).limit(2)
    return hits.withColumn("_n", F.count("*").over(_everything())).where("_n = 1").drop("_n")


def _everything():
    from pyspark.sql import Window as W

    return W.partitionBy(F.lit(1))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of the ordered rows with the total and whether more follow."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def latest(rows: DataFrame, key: str = "memory_id") -> DataFrame:
    """One row of each memory: redelivered rows repeat every field but the time of receipt, so any of them will do."""
    return rows.dropDuplicates([key])
