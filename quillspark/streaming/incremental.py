"""Incremental forms of batch operators, on Structured Streaming.

``merge_counts`` and ``place_new`` have the semantics of their batch operators. Windows over
event time with a watermark are an extension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import canon
from quillspark.operators import tasks


def merge_counts(path: str, keys: list[str], value: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that adds a batch's partial sums as one folder a batch; a batch that
    is repeated replaces its own folder, so sums stay exact. Read with ``merged``."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.sum(value).alias(value)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def merged(spark, path: str, keys: list[str], value: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum(value).alias(value))


def place_new(path: str, salt: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that places groups not placed before; earlier placements stay."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("group_id").distinct()
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p) and len(fs.listStatus(p)):
            seen = spark.read.parquet(path).filter(F.col("batch") != number)
            new = new.join(seen.select("group_id"), "group_id", "left_anti")
        tasks.assign(new, salt).select("group_id", "partition").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def windowed_rates(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and tumbling window; works on batch and streaming frames alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def shard(key: str, n: int):
    """A stable shard of a key, for partial state."""
    return F.pmod(F.conv(F.substring(canon.sha256_hex(F.col(key)), 1, 8), 16, 10).cast("long"), F.lit(n))
