"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: dict[str, int] = {}
_before: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares.

    Where none is set, a local master, as in tests, gets a temporary one; on a cluster each executor would write to its own disk, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go once a query ends. Threads that write at the same time share the setting: the last one puts back what the first one found."""
    at = spark.sparkContext.applicationId
    with _lock:
        if not _writers.get(at):
            _before[at] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writers[at] = _writers.get(at, 0) + 1
    try:
        yield
    finally:
        with _lock:
            _writers[at] -= 1
            if not _writers[at]:
                if _before[at] is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, _before[at])


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet (with the writer's options) into the shared folder and read them again.

    A lost executor then costs the tasks that it ran, not what lies before the table, and shuffle files go once the table stands.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    with _cleanup(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._staged = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Remove staged tables that nothing will read again; other frames are left alone."""
    for df in tables:
        at = getattr(df, "_staged", None)
        if at is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
            df._staged = None


#: Bytes, and rows, that a side of a join may have to be sent to every executor.
SMALL_BYTES, SMALL = 16 << 20, 20_000


def is_small(df: DataFrame, rows: int = SMALL) -> bool:
    """Whether df has at most `rows` rows; no task reads further than that."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = SMALL, wide: str | None = None) -> DataFrame:
    """df, marked for a broadcast join if it has few rows, and few bytes in the array or binary column `wide`; beyond that the planner chooses."""
    if not is_small(df, rows):
        return df
    if wide is not None:
        size = F.size(wide) * 8 if df.schema[wide].dataType.typeName() == "array" else F.octet_length(wide)
        if (df.agg(F.sum(size.cast("bigint"))).first()[0] or 0) > SMALL_BYTES:
            return df
    return F.broadcast(df)
