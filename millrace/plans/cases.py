"""Test cases in folders: a pipeline text, what it should write, and what goes before it.

A case is a folder with ``config.txt`` and files ``NAME.expected``; ``pretest.txt`` holds commands that
run first, ``interactive`` marks a case that cannot run alone.
"""

from __future__ import annotations

import shlex
import subprocess
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import golden
from millrace.plans import pipeline
from millrace.sources import files, sinks


def pretest(spark: SparkSession, folder: str) -> int:
    """Runs the commands of pretest.txt, if there is one, without a shell; a failure is an error."""
    path = f"{folder}/pretest.txt"
    if not sinks.exists(spark, path):
        return 0
    commands = [r.value for r in files.lines(spark, path).orderBy("pos").collect() if r.value.strip()]
    for line in commands:
        subprocess.run(shlex.split(line), check=True)
    return len(commands)


def run_case(spark: SparkSession, folder: str, custom: Callable[[DataFrame, DataFrame], bool] | None = None, log: Callable[[str], None] = print) -> str:
    """PASS, FAIL, WARN (no case or nothing to compare) or INCOMPAT of one folder."""
    config = f"{folder}/config.txt"
    if not sinks.exists(spark, folder) or not sinks.exists(spark, config):
        return "WARN"
    if sinks.exists(spark, f"{folder}/interactive"):
        return "INCOMPAT"
    pretest(spark, folder)
    found = files.listing(spark, folder, "*.expected").select(F.col("path")).collect()
    if not found:
        return "WARN"
    outcomes = pipeline.run(spark, config, prefix=f"{folder}/")
    log(f"{folder}: {len(outcomes)} outputs")
    for row in found:
        made = row.path.removesuffix(".expected")
        if not sinks.exists(spark, made):
            return "FAIL"
        got, expected = (files.lines(spark, p).select("pos", "value") for p in (made, row.path))
        if golden.verdict(got, expected, PurePosixPath(made).suffix.lstrip("."), custom) != "PASS":
            return "FAIL"
    return "PASS"
