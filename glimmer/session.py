"""Session factory and package shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(app: str = "glimmer", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; every setting can be overridden by keyword."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers when no path setting does so already.

    On a cluster the package normally arrives by ``--py-files`` or PYTHONPATH; this covers a driver
    that was started from another folder.
    """
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) in paths or os.getcwd() == str(ROOT):
        return
    sc = spark.sparkContext
    if getattr(sc, "_glimmer_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="glimmer-")) / "glimmer_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "glimmer").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._glimmer_shipped = True


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``; where it is unset, a temporary one under a local master only."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return f"{conf.rstrip('/')}/glimmer/{tag}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=f"glimmer-{tag}-")
