"""Writers: a result appears whole or not at all."""

from __future__ import annotations

import logging
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _paths(df: DataFrame, *names: str):
    jvm = df.sparkSession._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return paths[0].getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()), paths


def write_whole(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Writes beside the target and moves the finished folder into its place.

    If the job fails, what it wrote is removed, an earlier result stays, and the error goes on.
    """
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    fs, (temp, target) = _paths(df, beside, path)
    try:
        df.write.format(kind).options(**options).save(beside)
    except Exception:
        fs.delete(temp, True)
        raise
    _, (old,) = _paths(df, f"{beside}.old")
    had = fs.exists(target) and fs.rename(target, old)  # a crash from here on leaves it beside the target
    if not fs.rename(temp, target):
        if had:
            fs.rename(old, target)
        fs.delete(temp, True)
        raise OSError(f"cannot move the result to {path}")
    fs.delete(old, True)


def write_lines(df: DataFrame, path: str, order: str, value: str = "value") -> None:
    """One ordered text file, for small reports."""
    write_whole(df.orderBy(order).select(F.col(value).cast("string").alias("value")).coalesce(1), path, "text")


def exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def write_difference(diff: DataFrame, path: str) -> bool:
    """Writes a difference report if there is any difference; says whether there was."""
    if diff.isEmpty():
        fs, (target,) = _paths(diff, path)
        fs.delete(target, True)
        return False
    write_whole(diff, path, "json")
    return True


def run_log(folder: str, name: str = "millrace") -> logging.Logger:
    """A logger with a file named after the time of the run."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = logging.getLogger(f"{name}.{uuid.uuid4().hex}")
    handler = logging.FileHandler(Path(folder) / time.strftime("%Y-%m-%d-%H-%M-%S.log.txt"))
    handler.setFormatter(logging.Formatter(f"[{name}] %(message)s"))
    out.addHandler(handler)
    out.setLevel(logging.INFO)
    return out
