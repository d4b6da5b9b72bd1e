"""Shared scratch space, table access and batch limits.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which all
executors share, so a lost executor costs a re-read and nothing more. A machine-local
folder is used only where that setting is absent and the master is local (tests); on a
cluster its absence is an error. ``clean`` removes what was staged, once the results that
read it are written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch at most, and bytes of input that one part of an exchange stands for.
BATCH_ROWS = 500
PART_BYTES = 32 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What each application has staged: folders, and tables of its catalog.
_folders: dict[str, list[str]] = {}
_tables: dict[str, list[str]] = {}


def base_dir(spark: SparkSession) -> str:
    """The shared scratch folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{base_dir(spark)}/quill-{name}-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


class _Cleaned:
    """While it is held, Spark deletes a query's shuffle files when the query ends."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.was = self.conf.get(_CLEANUP, None)
        self.conf.set(_CLEANUP, "true")

    def __exit__(self, *_) -> None:
        self.conf.unset(_CLEANUP) if self.was is None else self.conf.set(_CLEANUP, self.was)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage. Joins on a staged
    table can be split by Spark where a key is frequent."""
    return _written(df, new_dir(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with _Cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_through(df: DataFrame, between: str, then: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``stage(then(df))`` with ``df`` written before: the shuffle files of the two never lie on
    disk together. What was written between is removed at once."""
    path = new_dir(df.sparkSession, between)
    out = stage(then(_written(df, path)), name)
    remove(df.sparkSession, path)
    return out


def stage_bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """``stage`` with the rows in ``n`` buckets by ``key``: later joins on it move the other
    side alone. ``df`` must already lie in ``n`` hash partitions by ``key``."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    known = f"quill_{uuid.uuid4().hex}"
    with _Cleaned(spark):
        df.write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(known)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(known)
    return spark.table(known)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> int:
    """Remove all that this application has staged; frames that read it can no longer be used."""
    app = spark.sparkContext.applicationId
    for name in _tables.pop(app, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    gone = _folders.pop(app, [])
    for path in gone:
        remove(spark, path)
    return len(gone)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, for texts are long. All operators here set this one
    bound, which changes no result; it stays set, because frames run after they are made."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def parts(spark: SparkSession, *inputs: DataFrame) -> int:
    """Parts for an exchange: the session's shuffle partitions, or more where Spark's estimate of
    the inputs' size asks for more."""
    size = sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in inputs)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // PART_BYTES)) if size < 1 << 60 else least


def one_row_per_id(df: DataFrame, key: str) -> DataFrame:
    """Rows without a key are left out; of rows that repeat a key the smallest stays.

    ``df`` has the key and one other, sortable, column. The check reads the key column
    only; nothing is moved unless a key does repeat.
    """
    df = df.filter(F.col(key).isNotNull())
    again = df.groupBy(key).count().filter("count > 1").select(key)
    if again.isEmpty():
        return df
    other = next(c for c in df.columns if c != key)
    rest = df.join(again, key, "left_anti")
    return rest.unionByName(df.join(again, key, "left_semi").groupBy(key).agg(F.min(other).alias(other)))
