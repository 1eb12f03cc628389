"""Session settings and the shared folder that survives executor loss."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Settings that every plan here relies on; a value the cluster already set wins.
_WANTED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even when the next step then needs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Hash instead of sort for joins whose build side is at most this large in every partition,
    # as measured after the shuffle; the hash map cannot spill, so this stays small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Only read when a session starts; recording the call site of every column slows down plan building.
_AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build(app: str = "custoria", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the wanted settings; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_WANTED, **_AT_START, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Prepare a session someone else built: once, and only settings that nobody has set.

    Task code of this package travels by value, so executors need not have it installed.
    """
    if not getattr(spark, "_custoria_tuned", False):
        chosen = {row["key"] for row in spark.sql("SET").collect()}
        for key, value in _WANTED.items():
            if key not in chosen:
                spark.conf.set(key, value)
        cloudpickle.register_pickle_by_value(sys.modules["custoria"])
        spark._custoria_tuned = True
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder; on a cluster such a folder
    would be lost with its machine, so a missing setting is an error there.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(context, "_custoria_dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="custoria-")
        context._custoria_dir = folder
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def run_dir(spark: SparkSession) -> str:
    """One sub-folder per application, so no run reads what another one left."""
    context = spark.sparkContext
    scope = getattr(context, "_custoria_scope", "")
    return f"{shared_dir(spark)}/custoria/{context.applicationId}-{os.getpid()}{scope}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is saved inside the block is deleted at its end: for runs that leave only their written results."""
    context = spark.sparkContext
    before = getattr(context, "_custoria_scope", "")
    context._custoria_scope = f"{before}/run-{uuid.uuid4().hex[:12]}"
    folder = run_dir(spark)
    try:
        yield
    finally:
        context._custoria_scope = before
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
