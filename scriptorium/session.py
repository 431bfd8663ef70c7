"""Sessions with the settings the engine relies on."""

from __future__ import annotations

import itertools
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.chunkBase64String.enabled": "false",
}


def session(master: str = "local[*]", name: str = "scriptorium", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).master(master)
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def lean(spark: SparkSession) -> None:
    """Let the session send Python batches of bounded size: texts of any length mustn't add up in a worker or in the JVM's buffers."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


_serial = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a temporary one where it is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and (master == "local" or master.startswith("local[")):
        found = os.path.join(tempfile.gettempdir(), "scriptorium-shared")
    if not found:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and read it again.

    Unlike cached blocks the files outlive a lost executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/scriptorium/{label}-{next(_serial)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
