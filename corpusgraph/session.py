"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Makes the package importable in Python workers that were not started with it on their path.

    Nothing is sent if the driver runs in the repository or has it in PYTHONPATH, which workers
    inherit; else one small zip goes to every executor, once per application.
    """
    sc = spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in on_path or os.path.realpath(os.getcwd()) == str(ROOT) or getattr(sc, "_corpusgraph_shipped", False):
        return
    zipped = Path(tempfile.mkdtemp(prefix="corpusgraph-")) / "corpusgraph_package.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for p in sorted((ROOT / "corpusgraph").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(zipped))
    sc._corpusgraph_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; in local mode, where that
    may be unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusgraph-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bounds what goes to Python at once, for sessions that run the named queries: whole texts are
    held several times while they are worked on. A bound that the session already sets stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in dict(spark.sparkContext.getConf().getAll()) and spark.conf.get(name) in ("67108864b", "64m", "64mb"):
        spark.conf.set(name, most)
