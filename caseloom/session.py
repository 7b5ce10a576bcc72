"""The shared folder, written tables and small helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a fresh one, and a cluster an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/caseloom/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which ends its lineage. ``options`` are the writer's."""
    path = fresh_path(df.sparkSession, label)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, label: str, *keys: str, within: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Write ``df`` as a table bucketed by ``keys``: joins on them read it where it lies, without a shuffle.

    There are as many buckets as shuffle partitions, so the other side's shuffle fits them. ``within`` is done
    to the rows when they lie in their buckets; what it groups or joins by ``keys`` needs no further shuffle of them.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"caseloom_{label}_{uuid.uuid4().hex}".replace("-", "_")
    placed = df.repartition(buckets, *keys)
    (placed if within is None else within(placed)).write.bucketBy(buckets, *keys).option("path", fresh_path(spark, label)).saveAsTable(name)
    return spark.table(name)
