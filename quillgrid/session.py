"""What a Spark session needs before this package's Python runs on executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """The session with this package on its executors, and with a limit that wide projections need.

    Methods over 8,000 bytes of byte code are never compiled by the JVM; with the limit at that size
    Spark takes the path that splits them instead (a projection of 20 functions: 13 s to 2 s).
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > 8000:
        spark.conf.set(name, "8000")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, unless their path has it already."""
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    if (mark := spark.sparkContext.applicationId) not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="quillgrid-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/quillgrid", "zip", _ROOT, "quillgrid"))
        _SHIPPED.add(mark)
    return spark


def durable(frame):
    """The frame written to the checkpoint folder of the session: short lineage, safe from lost executors.

    Sessions on one machine without such a folder (tests) get a local one; others have to name one.
    """
    spark = frame.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_base(spark, "spark-checkpoint-"))
    return frame.checkpoint()


def shared_base(spark: SparkSession, prefix: str) -> str:
    """The folder in spark.checkpoint.dir; a local one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return folder or "file://" + tempfile.mkdtemp(prefix=prefix)
