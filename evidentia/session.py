"""The session used by tests and benchmarks, and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str | int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that results rely on (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evidentia")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores if str(cores).isdigit() else 8))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_made: list[str] = []


def _delete_made() -> None:
    """Delete the folders of ``scratch`` at the end of the program, if its Spark is still there."""
    spark = SparkSession.getActiveSession() if _made else None
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in _made:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(_delete_made)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, in the place that spark.checkpoint.dir names; a local session without it gets one.

    Results may read it as long as the program runs; it is deleted at its end.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors, once for each Spark context.

    Nothing is needed where the package is installed or on PYTHONPATH; elsewhere
    (a notebook, a plain script) functions that run in tasks couldn't be loaded.
    """
    context = spark.sparkContext
    if not getattr(context, "_evidentia_shipped", False):
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="evidentia-"), "evidentia.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for p in sorted(root.rglob("*.py")):
                archive.write(p, p.relative_to(root.parent))
        context.addPyFile(path)
        context._evidentia_shipped = True
    return spark
