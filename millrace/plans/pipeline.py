"""A pipeline text becomes one lazy DataFrame for each output path.

The text is parsed by the same DataFrame operators that check many configs at once
(``operators.scope``); its few rows are then walked on the driver to put steps together.  A step
that reads what an earlier one writes gets that step's DataFrame, so Catalyst sees across steps;
only outputs that no step reads are written.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import scope
from millrace.plans.steps import STEPS, Context
from millrace.sources import files, sinks


LOG = logging.getLogger("millrace").info


class PipelineError(ValueError):
    """A text that cannot be run; the message names the line."""


@dataclass
class Group:
    """Outputs that are written side by side: a Parallel block's, or those of launched includes."""

    name: str
    workers: int = 4
    fail_mode: str = "fast"
    memory: int = 0
    gpu: int = 0
    needs: list[tuple[str, int, int]] = field(default_factory=list)  # (step, memory, gpu) as its lines say

    def too_large(self) -> list[str]:
        """Steps that want more than the group has."""
        return [n for n, m, g in self.needs if 0 < self.memory < m or 0 < self.gpu < g]

    def at_once(self) -> int:
        """How many may run side by side, so that any of them fit the memory and GPUs together."""
        out = self.workers if self.workers > 0 else 4
        share = self.memory // out  # of those that name none
        for total, most in ((self.memory, max((m or share for _, m, _ in self.needs), default=0)), (self.gpu, max((g for *_, g in self.needs), default=0))):
            if total > 0 and most > 0:
                out = min(out, max(1, total // most))
        return out


@dataclass
class Plan:
    outputs: dict[str, DataFrame] = field(default_factory=dict)
    read: set[str] = field(default_factory=set)
    shown: list[DataFrame] = field(default_factory=list)
    groups: dict[str, Group] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def sinks(self) -> dict[str, DataFrame]:
        return {p: d for p, d in self.outputs.items() if p not in self.read}

    def written(self) -> list[tuple[Group, dict[str, DataFrame]]]:
        """The sinks by group, in order of their first lines."""
        out: dict[int, tuple[Group, dict[str, DataFrame]]] = {}
        for path, df in self.sinks().items():
            group = self.groups[path]
            out.setdefault(id(group), (group, {}))[1][path] = df
        return list(out.values())


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def table(spark: SparkSession, path: str) -> DataFrame:
    """A file at the pipeline's edge, read by its extension; a folder that a step wrote is Parquet."""
    kind = PurePosixPath(path).suffix.lstrip(".")
    if sinks.exists(spark, f"{path.rstrip('/')}/_SUCCESS") and kind not in ("json", "orc", "csv"):
        kind = "parquet"
    if kind in ("json", "orc", "parquet"):
        return files.table(spark, path, kind)
    if kind == "csv":
        return files.table(spark, path, "csv", header="true")
    return files.sequence(files.lines(spark, path)).select("pos", "value")


def absolute(path: str) -> bool:
    return path[:1] in ("/", "\\") or "://" in path


def compose(spark: SparkSession, text: str, prefix: str = "", restart: str | None = None, include: Callable[[str], str] | None = None, tables: Callable[[str], DataFrame] | None = None, log: Callable[[str], None] = LOG) -> Plan:
    """The plan of a text.

    ``restart`` drops steps before the first of that name, also inside includes.  Their outputs are
    read where they were written; one that was never stored, as a later step read it, is put together
    again from the latest stored outputs.

    Outputs of a Parallel block form a group with the block's options.  Includes that stand behind a
    Kitty line between LitterLaunch and LitterGather form one group, so they run side by side, and
    LitterGather (or the end) waits for all of them.  Steps that collide are warned of.
    """
    plan, main = Plan(), Group("steps")
    state = {"waiting": restart, "litter": None, "kitty": False}
    skipped: dict[str, Callable[[], DataFrame]] = {}
    include = include or (lambda p: read_text(spark, p))
    stored = tables or (lambda p: table(spark, p))

    def look_up(path: str) -> DataFrame:
        if path in plan.outputs:
            plan.read.add(path)
            return plan.outputs[path]
        if path in skipped and not sinks.exists(spark, path):
            return skipped[path]()
        return stored(path)

    def walk(body: str, above: str, stack: tuple[str, ...], within: Group) -> None:
        rows = files.split_lines(spark.createDataFrame([("pipeline", body)], "file string, value string"))
        where = scope.directives(rows)
        errors = scope.structure_errors(where).orderBy("line").collect()
        if errors:
            raise PipelineError("; ".join(f"line {e.line}: {e.message}" for e in errors))
        parsed = scope.parsed(rows).orderBy("pos").collect()
        blocks: dict[int, Group] = {}
        if any(row.keyword == "Parallel" for row in parsed):
            collisions, hazards = checks(rows)
            plan.warnings += [f"lines {r.first} and {r.second} both write {r.outputfile}" for r in collisions.collect()]
            plan.warnings += [f"line {r.reader} reads {r.path}, which line {r.writer} of the same block writes" for r in hazards.collect()]
        for row in parsed:
            own = row.prefix if absolute(row.prefix) else above + row.prefix
            if row.keyword == "Parallel":
                o = row.options
                blocks[row.block] = Group(f"block {row.block}", o.workers, o.fail_mode, o.memory, o.gpu)
            elif row.keyword == "Kitty":
                state["kitty"] = True
            elif row.keyword == "LitterLaunch":
                state["litter"] = Group("litter", 0)
            elif row.keyword == "LitterGather":
                state["litter"], state["kitty"] = None, False
            elif row.keyword == "Pipeline":
                name = row.tokens[1]
                if name in stack:
                    raise PipelineError(f"line {row.pos}: {name} includes itself")
                litter = state["litter"] if state["kitty"] else None
                if litter is not None:
                    litter.workers += 1
                walk(include(name), own, (*stack, name), litter or within)
            elif row.keyword == "Plugin":
                group = blocks[row.block] if row.inside else within
                group.needs.append((row.task.name, row.task.memory_hint, row.task.gpu_hint))
                add(row.pos, row.task, above, own, group)
        for group in blocks.values():
            if group.too_large():
                raise PipelineError(f"{group.name} can never run {', '.join(group.too_large())}")

    def add(line: int, task, above: str, own: str, group: Group) -> None:
        if not task.name or not task.inputfile or not task.outputfile:
            raise PipelineError(f"line {line}: Plugin NAME inputfile IN outputfile OUT")
        if task.name not in STEPS:
            raise PipelineError(f"line {line}: no step named {task.name}")
        source, target = (p if absolute(p) else above + p for p in (task.inputfile, task.outputfile))

        def out() -> DataFrame:
            at, params = source, {}
            if at.endswith(".params"):
                params = {r.key: r.value for r in files.parameters(files.lines(spark, at)).collect()}
                at = params.get("input", "")
                at = at if absolute(at) else own + at
            return STEPS[task.name](Context(spark, own, params, look_up, log), look_up(at))

        if state["waiting"] not in (None, task.name):
            skipped[target] = out
            return
        state["waiting"] = None
        log(f"line {line}: {task.name} reads {source}, writes {target}")
        if PurePosixPath(target).name == "none":
            plan.shown.append(out())
            return
        df = out()
        if target in plan.outputs and target not in plan.read:
            plan.warnings.append(f"line {line}: {task.name} writes {target} again; the earlier result is replaced")
        plan.outputs[target] = df
        plan.read.discard(target)
        plan.groups[target] = group

    walk(text, prefix, (), main)
    if state["waiting"] is not None:
        raise PipelineError(f"no step named {restart} to restart at")
    return plan


@dataclass(frozen=True)
class Outcome:
    name: str
    status: str  # completed, failed, cancelled or skipped
    seconds: float


def write_all(spark: SparkSession, results: dict[str, DataFrame], workers: int = 4, fail_mode: str = "fast", write: Callable[[DataFrame, str], None] = sinks.write_whole) -> list[Outcome]:
    """Writes results side by side, each as a tagged Spark job.

    ``fast``: the first failure cancels the running ones by their tags and skips the rest;
    ``continue``: all are tried.
    """
    import time
    import uuid

    run, out = uuid.uuid4().hex, {}

    def one(number: int, path: str, df: DataFrame) -> float:
        began = time.monotonic()
        spark.addTag(f"{run}-{number}")
        write(df, path)
        return time.monotonic() - began

    with ThreadPoolExecutor(max(1, workers)) as pool:
        jobs = {pool.submit(one, i, p, d): (i, p) for i, (p, d) in enumerate(results.items())}
        left, failed = set(jobs), False
        while left:
            done, left = wait(left, return_when=FIRST_COMPLETED)
            for job in done:
                i, path = jobs[job]
                if job.cancelled():
                    out[i] = Outcome(path, "skipped", 0.0)
                elif job.exception() is not None:
                    out[i] = Outcome(path, "cancelled" if failed and fail_mode == "fast" else "failed", 0.0)
                    if fail_mode == "fast" and not failed:
                        for other in left:
                            if not other.cancel():
                                spark.interruptTag(f"{run}-{jobs[other][0]}")
                    failed = True
                else:
                    out[i] = Outcome(path, "completed", job.result())
    return [out[i] for i in sorted(out)]


def run(spark: SparkSession, path: str, restart: str | None = None, prefix: str = "", log_folder: str | None = None) -> list[Outcome]:
    """Composes the pipeline in a file and writes its outputs, group after group, each group's side by
    side.  What is done goes to a log named after the time of the run in ``log_folder``, if given."""
    log = sinks.run_log(log_folder).info if log_folder else LOG
    plan = compose(spark, read_text(spark, path), prefix, restart, log=log)
    for warning in plan.warnings:
        log(f"warning: {warning}")
    for df in plan.shown:
        df.show()
    out: list[Outcome] = []
    for group, results in plan.written():
        if group.fail_mode == "fast" and any(r.status != "completed" for r in out):
            out += [Outcome(p, "skipped", 0.0) for p in results]
        else:
            out += write_all(spark, results, group.at_once(), group.fail_mode)
    for r in out:
        log(f"{r.status} in {r.seconds:.2f} s: {r.name}")
    return out


def checks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(collisions, hazards) of the parallel blocks of many configs at once."""
    from millrace.operators import hazards

    tasks = scope.parsed(rows).where("inside AND keyword = 'Plugin'").select("file", "block", "pos", F.col("task.inputfile").alias("inputfile"), F.col("task.outputfile").alias("outputfile"))
    return hazards.output_collisions(tasks, ["file", "block"], "pos", "outputfile"), hazards.read_after_write(tasks, ["file", "block"], "pos", "inputfile", "outputfile")
