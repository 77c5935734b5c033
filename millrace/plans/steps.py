"""Steps: named functions from a context to a lazy DataFrame."""

from __future__ import annotations

import contextlib
import importlib.util
import io
import itertools
import os
import shlex
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Context:
    """What a step sees: its parameters, the tables behind paths, and who else is registered."""

    spark: SparkSession
    prefix: str = ""
    params: Mapping[str, str] = field(default_factory=dict)
    tables: Callable[[str], DataFrame] | None = None
    log: Callable[[str], None] = print

    def table(self, path: str) -> DataFrame:
        return self.tables(path if path[:1] in "/\\" or "://" in path else self.prefix + path)

    def dependency(self, name: str, required: bool = True) -> bool:
        """Whether a step is registered; one that is required and missing is an error, another is logged."""
        if name not in STEPS and required:
            raise LookupError(f"step {name} is needed and not registered")
        if name not in STEPS:
            self.log(f"step {name} would be of use and is not registered")
        return name in STEPS


Step = Callable[[Context, DataFrame], DataFrame]
STEPS: dict[str, Step] = {}


def step(name: str) -> Callable[[Step], Step]:
    """Registers a step; a later registration of a name wins."""

    def put(f: Step) -> Step:
        STEPS[name] = f
        return f

    return put


def load(search_path: str | None = None) -> list[str]:
    """Runs the step modules (``*/*Plugin.py``) of each folder of a ``:``-separated search path, in order;
    it ends at an empty entry.  Returns the names that were registered.  Default: ``$MILLRACE_PATH``."""
    before = dict(STEPS)
    for folder in (search_path if search_path is not None else os.environ.get("MILLRACE_PATH", "")).split(":"):
        if not folder:
            break
        for file in sorted(Path(folder).glob("*/*Plugin.py")):
            spec = importlib.util.spec_from_file_location(file.stem, file)
            spec.loader.exec_module(importlib.util.module_from_spec(spec))
    return sorted(n for n in STEPS if STEPS[n] is not before.get(n))


@step("ScanTable")
def scan_table(ctx: Context, df: DataFrame) -> DataFrame:
    """The input as it is, or its columns named by ``columns``."""
    return df.select(*ctx.params["columns"].split(",")) if ctx.params.get("columns") else df


@step("Filter")
def filter_rows(ctx: Context, df: DataFrame) -> DataFrame:
    return df.where(ctx.params["where"])


@step("GroupCount")
def group_count(ctx: Context, df: DataFrame) -> DataFrame:
    """Rows for each value of ``by``; without it, of the first column."""
    return df.groupBy(*(ctx.params.get("by") or df.columns[0]).split(",")).agg(F.count(F.lit(1)).alias("n"))


@step("Join")
def join_tables(ctx: Context, df: DataFrame) -> DataFrame:
    return df.join(ctx.table(ctx.params["with"]), ctx.params["on"].split(","), ctx.params.get("how", "inner"))


@step("Shannon")
def shannon(ctx: Context, df: DataFrame) -> DataFrame:
    """Extension: the diversity index of counts ``n`` within each value of ``by``."""
    by = ctx.params["by"].split(",")
    total = df.groupBy(*by).agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return df.join(total, by).groupBy(*by).agg(F.sum(-share * F.log(share)).alias("shannon"))


@step("Command")
def command(ctx: Context, df: DataFrame) -> DataFrame:
    """Lines of the first column through an external program, a partition at a time, without a shell."""
    return pipe(df.select(F.col(df.columns[0]).cast("string").alias("value")), command_line(ctx.params))


def command_line(params: Mapping[str, str]) -> list[str]:
    """The program and its arguments: ``command``, then a flag and value for each parameter ``-flag``."""
    out = shlex.split(params["command"])
    for key, value in params.items():
        if key.startswith("-"):
            out += [key, value] if value else [key]
    return out


def pipe(lines: DataFrame, program: list[str], rows: int = 10_000) -> DataFrame:
    """One process for each partition that has lines; its output goes to a file until it ends well.

    A null is an empty line.  Only line feeds end lines of the output; bytes that are no UTF-8 are replaced.
    """
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        process = None
        with tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as err:
            try:
                for frame in frames:
                    if process is None and len(frame):
                        process = subprocess.Popen(program, stdin=subprocess.PIPE, stdout=out, stderr=err)
                    with contextlib.suppress(BrokenPipeError):  # a program may stop reading early
                        if process is not None:
                            process.stdin.write("".join(f"{v}\n" for v in frame["value"].fillna("")).encode())
                if process is None:
                    return
                with contextlib.suppress(BrokenPipeError):
                    process.stdin.close()
                if process.wait():
                    err.seek(0)
                    raise subprocess.CalledProcessError(process.returncode, program, stderr=err.read().decode(errors="replace"))
            finally:
                if process is not None and process.poll() is None:
                    process.kill()
                    process.wait()
            out.seek(0)
            text = (line.removesuffix("\n") for line in io.TextIOWrapper(out, encoding="utf-8", errors="replace", newline="\n"))
            while part := list(itertools.islice(text, rows)):
                yield pd.DataFrame({"value": part})

    return lines.mapInPandas(run, "value string")
