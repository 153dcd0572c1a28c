"""Work for all cores where a table comes in fewer splits than there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.runtime import cut, parallelism


def spread(rows: DataFrame) -> DataFrame:
    """`rows`, dealt out evenly if their scan has fewer splits than the session has cores; large tables stay where they are."""
    cores = parallelism(rows.sparkSession)
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


#: Repeated keys up to which they are broadcast.
BROADCAST_KEYS = 1_000_000


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row of each `key` (null dropped). Only keys and the rows whose key is repeated are shuffled."""
    rows = rows.where(F.col(key).isNotNull())
    repeated = cut(rows.groupBy(key).agg(F.count("*").alias("_times")).where("_times > 1").select(key))
    if repeated.count() <= BROADCAST_KEYS:
        repeated = F.broadcast(repeated)
    return rows.join(repeated, key, "left_anti").unionByName(rows.join(repeated, key, "left_semi").dropDuplicates([key]))
