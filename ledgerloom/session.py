"""Getting this package to the executors."""

from __future__ import annotations

import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add this package, zipped, to the files that Spark sends to its Python workers; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom-src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(path))
    sc._ledgerloom_shipped = True


def ship_code(*modules: str) -> None:
    """Have what these modules define go to Python workers as code: a stream also starts one on the driver, which doesn't get the files that are shipped."""
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where that setting is missing and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir() + "/ledgerloom-checkpoints"
    return f"{base.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"
