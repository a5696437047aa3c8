"""Cutting a plan's lineage by a reliable checkpoint, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, in local mode only, a folder of this process. Checkpoints go there too."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or _own.get(sc.applicationId)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they and the driver share")
        found = _own[sc.applicationId] = tempfile.mkdtemp(prefix="rankloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/") if "://" in found else f"file://{found.rstrip('/')}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/rankloom/{tag}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once: what reads them again doesn't repeat the work, whichever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
