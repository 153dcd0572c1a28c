"""Session defaults, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import gc
import os
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: What a session of ours sets when it starts one itself. A cluster's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "tessaline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reach(spark: SparkSession) -> None:
    """Lets Python workers import this package from where it lies; on machines without that folder, ship it with --py-files."""
    home, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, known) if x)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table `name` under `base`; columns and filters reach the scan."""
    reach(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a temporary one where a test leaves that unset."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessaline-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder: later stages reread it, also after an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Frees the disk of shuffles and cuts that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.sparkContext.defaultParallelism))


def nothing(*columns: str) -> pd.DataFrame:
    """No rows, in columns that take any type: pandas takes an empty list for numbers, which don't go back as text."""
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
