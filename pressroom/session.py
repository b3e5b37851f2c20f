"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every pressroom job relies on.  UTC everywhere (the article table stores
# naive UTC timestamps), AQE on so that shuffle partition counts and skewed joins are
# re-planned at runtime, Arrow on for the two Python stages.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of a long-running stream are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "pressroom", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session.  On a cluster the master and resources come from
    spark-submit; locally we default to ``local[*]`` with a partition count sized to
    the cores."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in conf.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static confs of an already running session
            pass
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can reach, and
    the context keeps a sub-folder of its own in it.  Only when it is unset in a
    single-process session (local tests) do we make one; on a cluster a missing
    setting is an error, as a folder of one machine would be lost to the others.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:  # setting it again would nest a new folder every time
        return have
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="pressroom-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, so that a job may start from any folder.  The driver serves the archive
    to the executors; a session is given it once."""
    sc = spark.sparkContext
    if getattr(sc, "_pressroom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pressroom-"), "pressroom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(path)
    sc._pressroom_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder, for written intermediate
    tables that cut lineage."""
    base = checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), f"{name}-{uuid.uuid4().hex[:12]}")


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What runs in here has its shuffle files removed as soon as it ends, not when the
    driver happens to collect its garbage; the session keeps its setting."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def written(df: DataFrame, name: str, lots: int = 1, by: str = "id") -> DataFrame:
    """``df`` written once, compressed, to the shared folder and read from there: like a
    checkpoint, but readers take only the columns they need.  ``lots``: one after the
    other, by a hash of ``by``; only the rows of one lot are in shuffle files at a time."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        for lot in range(lots):
            part = df if lots == 1 else df.filter(F.pmod(F.xxhash64(by), F.lit(lots)) == lot)
            part.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df, min_partitions: int | None = None):
    """Round-robin a DataFrame over the cluster when its input has fewer partitions
    than there are cores (one unsplittable file, one row group).  On large inputs
    the scan already has more splits than cores and this is a no-op, so no shuffle
    is added where the data is big."""
    try:
        sc = df.sparkSession.sparkContext
        target = min_partitions or sc.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # sessions without RDD access: leave the plan as it is
        return df
    return df.repartition(target) if n < target else df
