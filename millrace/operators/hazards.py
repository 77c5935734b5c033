"""Conflicts between the tasks of a block, and the resources they take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def output_collisions(tasks: DataFrame, by: list[str], order: str, output: str) -> DataFrame:
    """(by, first, second, output): tasks of a block with the same output, each with the one before it.

    A path that n tasks write gives n - 1 rows, not all pairs.
    """
    w = Window.partitionBy(*by, output).orderBy(order)
    return tasks.where(F.col(output).isNotNull()).withColumn("first", F.lag(order).over(w)).where("first IS NOT NULL").select(*by, "first", F.col(order).alias("second"), output)


def read_after_write(tasks: DataFrame, by: list[str], order: str, inp: str, out: str) -> DataFrame:
    """(by, path, reader, writer, n_writers): a task of a block reads what other tasks write.

    One row a reader, with one of the writers (the first, or the last if the reader is the first) and
    their number: a path with many writers and readers gives no pairs of them.
    """
    writes = tasks.where(F.col(out).isNotNull()).groupBy(*by, F.col(out).alias("path")).agg(F.min(order).alias("_first"), F.max(order).alias("_last"), F.count(F.lit(1)).alias("_n"))
    reads = tasks.select(*by, F.col(order).alias("reader"), F.col(inp).alias("path"), F.coalesce(F.col(inp) == F.col(out), F.lit(False)).alias("_own"))
    writer = F.when(F.col("_first") != F.col("reader"), F.col("_first")).otherwise(F.col("_last"))
    n = F.col("_n") - F.col("_own").cast("long")
    return reads.join(writes, [*by, "path"]).where(n > 0).select(*by, "path", "reader", writer.alias("writer"), n.alias("n_writers"))


def never_fits(tasks: DataFrame, needs: dict[str, Column]) -> DataFrame:
    """Tasks that want more of a resource (column) than its total, which is unlimited if 0."""
    over = F.lit(False)
    for name, total in needs.items():
        over = over | ((total > 0) & (F.col(name) > total))
    return tasks.where(over)


def default_share(memory: Column, workers: Column) -> Column:
    """A task's memory if it names none."""
    return F.when(workers <= 0, memory).otherwise(F.try_divide(memory - F.pmod(memory, F.greatest(workers, F.lit(1))), F.greatest(workers, F.lit(1))).cast("long"))


def running_usage(events: DataFrame, by: list[str], order: str, delta: Column, name: str = "used") -> DataFrame:
    """Usage after each acquisition (+) and release (-)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(name, F.sum(delta).over(w))


def outcomes(results: DataFrame, by: list[str], code: str) -> DataFrame:
    """Completed and failed tasks."""
    return results.groupBy(*by).agg(F.count_if(F.col(code) == 0).alias("completed"), F.count_if(F.col(code) != 0).alias("failed"))


def wall_time(results: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Seconds from the first start to the last end."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return results.groupBy(*by).agg((seconds(F.max(end)) - seconds(F.min(start))).alias("seconds"))
