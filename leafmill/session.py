"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole documents go through Arrow, so bound batches by rows and by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, app: str = "leafmill", **extra: str) -> SparkSession:
    """A session with the defaults above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows and bytes of an Arrow batch at most: whole texts go through, and a task holds some copies of a batch.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def slim_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches; lower ones stay. Results do not depend on them."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, the folder all nodes share.

    Only a local master, whose executors share the driver's disk, may go
    without one; on a cluster a missing setting is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        shared = os.path.join(tempfile.gettempdir(), "leafmill-scratch")
    return f"{shared.rstrip('/')}/leafmill/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``scratch`` named, on whatever store it lies."""
    if "/leafmill/" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: What jobs around the present one have written, innermost last; threads have their own.
_held: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("held", default=())


@contextlib.contextmanager
def intermediates(spark: SparkSession):
    """Removes, at the end, all that ``written`` wrote inside; for jobs whose results lie elsewhere."""
    own: list[str] = []
    token = _held.set((*_held.get(), own))
    try:
        yield
    finally:
        _held.reset(token)
        for path in own:
            discard(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: cuts lineage, survives lost executors, has a size."""
    path = scratch(df.sparkSession, label)
    if _held.get():
        _held.get()[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
