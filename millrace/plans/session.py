"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **config: str) -> SparkSession:
    """A session with adaptive plans and UTC times; other settings as given."""
    builder = SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in config.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the session's shared checkpoint folder.  Only a session on one machine may
    do without one, and gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)
