"""Session builder and the settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "emberscope",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create a session with adaptive execution and a fixed UTC session zone.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    command supplies them and adaptive execution coalesces small partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.scheduler.mode": "FAIR",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """Return a fresh folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names a folder every executor can reach.  Only a
    local master may fall back to a temporary folder on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        unique = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
        return _noted(f"{base.rstrip('/')}/{name}-{unique}")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _noted(os.path.join(tempfile.mkdtemp(prefix="emberscope-"), name))


def _noted(folder: str) -> str:
    for block in Scratch.open_blocks:
        block.folders.append(folder)
    return folder


class Scratch:
    """The folders that ``shared_dir`` has given out inside a ``with`` block; those not kept are removed at its end."""

    open_blocks: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def __enter__(self) -> Scratch:
        Scratch.open_blocks.append(self)
        return self

    def keep(self, prefix: str) -> list[str]:
        """Spare the folders whose name starts with ``prefix``; returns them."""
        kept = [f for f in self.folders if f.rsplit("/", 1)[-1].startswith(prefix)]
        self.folders = [f for f in self.folders if f not in kept]
        return kept

    def __exit__(self, *error: object) -> None:
        Scratch.open_blocks.remove(self)
        for folder in self.folders:
            remove_folder(self.spark, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate data, wherever it is stored; one that does not exist is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable without overriding the cluster's setting."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark, "checkpoints")
        )
