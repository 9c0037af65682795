"""Session settings that the operators count on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "sparkloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a checkpoint in the shared folder that spark.checkpoint.dir names; a local session gets a folder of its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="sparkloom-"))
    return df.checkpoint()


def shipped(spark: SparkSession) -> None:
    """Sends this package to the Python workers, so that they need no install of it. Once for each application."""
    context = spark.sparkContext
    if getattr(context, "_sparkloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="sparkloom-code-")) / "sparkloom_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((root / "sparkloom").rglob("*.py")):
            z.write(path, os.path.relpath(path, root))
    context.addPyFile(str(archive))
    context._sparkloom_shipped = True
