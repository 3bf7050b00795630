"""Session helpers: defaults for a local run, and shipping this package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, unless their path has it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(sc.applicationId)
    base = Path(tempfile.mkdtemp(prefix="runnel-package-")) / "runnel"
    sc.addPyFile(shutil.make_archive(str(base), "zip", root_dir=ROOT, base_dir="runnel"))
