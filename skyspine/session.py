"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # A hot join key is split by the adaptive planner, even where the split costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_own_folders: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator here relies on; all are changeable at run time."""
    for name, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "skyspine") -> SparkSession:
    """A single-JVM session for tests and benches."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        context.setCheckpointDir(_own_folders[app])
    return _own_folders[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever reused or removed."""
    return f"{shared_dir(spark).rstrip('/')}/skyspine/{name}-{uuid.uuid4().hex}"
