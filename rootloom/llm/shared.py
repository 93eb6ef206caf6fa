"""Helpers of the training-data operators: table access, shared folders, checkpoints, and choosing columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session in one process gets a temporary one; a cluster raises."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rootloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a Parquet table in the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns; whatever else the table has can't clash later."""
    return df.select(*[F.col(n) for n in names])


def rest_of_row(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text as a struct ``row``, which an Arrow function hands through beside ``text``."""
    return F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row")


def whole_row(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """The columns of ``docs`` from ``row`` and ``text``: a decision made on a row needs no look-up by an id."""
    return [(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
