"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE merges small shuffle partitions to the advisory size and splits one that a
# join's hot key fills, but it never makes more of them otherwise: ``build_session``
# sets their number from the size of the input.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


# Input bytes behind one shuffle partition; rows grow when they are decoded.
BYTES_PER_PARTITION = 64 << 20


def partitions_for(input_bytes: int) -> int:
    """Shuffle partitions for an input of that many bytes, 16 at least."""
    return max(16, -(-input_bytes // BYTES_PER_PARTITION))


def build_session(
    app: str = "tillscope",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    input_bytes: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the recommended settings; keyword settings win.

    ``input_bytes`` is the size of the tables to be read: shuffles then start with
    as many partitions as ``partitions_for`` says.
    """
    if input_bytes is not None and shuffle_partitions is None:
        shuffle_partitions = partitions_for(input_bytes)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(RECOMMENDED)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context.

    Functions that run in a worker are pickled by reference, so a worker must be
    able to import them whatever folder the driver was started in.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_tillscope_shipped", False) or not os.path.isdir(package):
        return
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="tillscope-ship-"), "tillscope"),
        "zip",
        os.path.dirname(package),
        os.path.basename(package),
    )
    context.addPyFile(archive)
    context._tillscope_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver (master ``local`` or
    ``local[n]``) may go without the setting; it gets a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tillscope-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Run the plan once and cut its lineage with a reliable checkpoint.

    Used before iterative work, so that a lost executor costs a re-read of the
    checkpoint and not a second scan of the order lines.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)

