"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_SCRATCH: dict[str, str] = {}


def local_session(cpus: str = "8", app: str = "riskgrove") -> SparkSession:
    """A local session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RISKGROVE_DRIVER_MEMORY", "12g"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A machine-local folder is used only when the setting is missing *and* the
    session runs in one process; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        _SCRATCH[app] = tempfile.mkdtemp(prefix="riskgrove-")
        atexit.register(shutil.rmtree, _SCRATCH[app], ignore_errors=True)
    return _SCRATCH[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def compile_wide(spark: SparkSession) -> None:
    """Have wide projections compiled.

    The JVM interprets methods of more than 8,000 bytes. Spark makes longer ones of projections of
    some thirty columns and keeps them up to 65,535 bytes unless told otherwise; beyond the limit
    it uses shorter methods. The session keeps this setting; one of the user's own is left alone.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name, "65535") == "65535":
        spark.conf.set(name, "8000")


def free_shuffles(spark: SparkSession) -> None:
    """Let go of shuffle files that no live DataFrame needs, after a table was written.

    Spark removes them when the driver's garbage is collected, which may not come before the disk
    is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
