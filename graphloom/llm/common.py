"""What several training-data operators share: storage for cut plans and keys for rows."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (local tests) may name none and gets a
    temporary folder; on a cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local_root or not Path(_local_root[0]).exists():
        _local_root[:] = [tempfile.mkdtemp(prefix="graphloom-")]
    return _local_root[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/graphloom/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes the shuffle files of a write once the write is done."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, so that no later loss repeats its lineage."""
    path = new_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._graphloom_path = path
    return back


def bucket(df: DataFrame, key: str, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder in buckets of ``key``, so that joins on it do not shuffle this side."""
    spark, n = df.sparkSession, shuffle_width(df.sparkSession)
    path, name = new_path(spark, label), f"graphloom_{uuid.uuid4().hex}"
    try:
        with shuffles_removed(spark):
            df.repartition(n, key).dropDuplicates([key]).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        raise
    back = spark.table(name)
    back._graphloom_path, back._graphloom_table = path, name
    return back


def drop_cut(df: DataFrame) -> None:
    """Removes what ``cut`` or ``bucket`` wrote, once nothing lazy refers to it."""
    if getattr(df, "_graphloom_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._graphloom_table}")
    path = getattr(df, "_graphloom_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def remove_local_root() -> None:
    if _local_root:
        shutil.rmtree(_local_root.pop(), ignore_errors=True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def limit_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds what one Arrow batch holds, so that a Python worker's memory follows neither row counts nor table size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def ascii_lower(column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns of the input that an operator's own columns would clash with, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def map_arrow(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any names, dots and duplicates too: batches hold them as c0, c1, ..."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, plain).toDF(*schema.names)
