"""Session helpers: a tuned local session for tests/bench and the shared
checkpoint folder lookup used by operators that cut lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ohmflow") -> SparkSession:
    """Local session with AQE on and the UI off.

    On a cluster the job is submitted with its own master and confs; only
    ``getOrCreate`` is used there, so these settings are defaults for tests.
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("OHMFLOW_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Read from the session. Where it is unset, a local master (tests) gets a
    fresh scratch folder; any other master is an error, as executors there do
    not share the driver's disk.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="ohmflow-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors (once per Spark context), so
    Python functions run there whatever folder the driver was started in. Not
    needed where the package is installed or passed with ``--py-files``."""
    sc = spark.sparkContext
    if getattr(sc, "_ohmflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ohmflow-package-")) / "ohmflow_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for module in sorted(root.rglob("*.py")):
            z.write(module, module.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._ohmflow_shipped = True
