"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    # A full feature table generates some 200 small classes; the default cache holds 100 and
    # would compile them again in every task.
    "spark.sql.codegen.cache.maxEntries": "2000",
    # Call-site capture on every column expression costs more than planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults this library expects; cluster settings win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    known = dict(SparkConf().getAll()) | conf
    for key, value in DEFAULTS.items():
        if key not in known:
            builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``, the context's, or where neither is set
    one beside the warehouse, which executors share by definition."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    named = named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    return named.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; everything of one application lies together."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tickloom/{app}/{label}-{uuid.uuid4().hex}"


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediates written inside are deleted at the end: for work whose result is stored by then,
    like a micro-batch. Scopes of a thread may be nested; each deletes its own."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for written in scopes.pop():
            path = jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Used where several branches of a plan read the same intermediate. Parquet rather than
    ``checkpoint()``: each branch then reads only its columns, the real file size lets the
    planner decide on broadcasting, and a lost executor costs a re-read, not a recompute.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    for scope in getattr(_open, "scopes", [])[-1:]:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
