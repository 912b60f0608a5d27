"""Session set-up and the shared scratch folder."""

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def build_session(master="local[*]", shuffle_partitions=None, app="recollect"):
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def use_utc(spark):
    """All stored times are UTC without a zone; the session must read them so."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


BATCH_BYTES = 1 << 20


def use_small_batches(spark):
    """Arrow batches of ten thousand rows would hold that many whole pages in every task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).lower().rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def scratch_dir(spark):
    """The folder every executor can reach, as the cluster names it.

    A local folder is used only where nothing is configured, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("recollect.scratch.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="recollect-")
        spark.conf.set("recollect.scratch.dir", root)
    return root


def scratch_path(spark, name):
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df, name):
    """Write a frame to the scratch folder and read it back: cuts the lineage
    and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark):
    """Let go of the shuffle files of finished jobs. Spark drops them once the driver's
    JVM has collected the plans, and Python's references to these go a moment after they
    are collected here."""
    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


def in_parts(batches, rows=1000):
    """Arrow batches cut to a size whose texts fit a task's memory more than once."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)
