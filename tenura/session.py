"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "tenura") -> SparkSession:
    """A single-machine session for tests and the local benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TENURA_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> None:
    """Give the session a checkpoint folder.

    The folder the cluster names in ``spark.checkpoint.dir`` is used as it is. Only a session
    that names none (tests on one machine) gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tenura-checkpoint-")
        sc.setCheckpointDir(folder)


def checkpointed(df):
    """Cut the lineage of an iterative input through the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; a temporary one in local tests."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="tenura-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
