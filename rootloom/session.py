"""Session settings that the operators' results rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_conventions(spark: SparkSession) -> SparkSession:
    """UTC, and adaptive execution, which also splits skewed joins."""
    for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.adaptive.enabled", "true"), ("spark.sql.adaptive.skewJoin.enabled", "true")):
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that the driver and all executors share. Where it is unset, a session in one process gets a temporary one; a cluster raises."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rootloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: read often, made once, and there after an executor is lost."""
    at = f"{shared_base(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    return use_conventions(
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
