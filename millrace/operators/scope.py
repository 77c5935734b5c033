"""Scopes over ordered lines: values that hold until the next, blocks, restart points.

All are windows within one config (``by``), ordered by line, so many configs are worked on side by
side; a single config is a small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import leading_int, resolve_path, size_in_bytes, tokens, trim_blanks

#: The words that begin a line.
KEYWORDS = ("Prefix", "Pipeline", "Kitty", "LitterLaunch", "LitterGather", "Plugin", "Parallel", "EndParallel")
FORBIDDEN_INSIDE = ("Prefix", "Pipeline", "Kitty", "LitterLaunch", "LitterGather")


def _until(by, order) -> Window:
    by = [by] if isinstance(by, str) else list(by)
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def directives(rows: DataFrame) -> DataFrame:
    """Lines without comments and blanks, with ``tokens`` and ``keyword``."""
    clean = rows.withColumn("value", trim_blanks(F.col("value"))).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return clean.withColumn("tokens", tokens(F.col("value"))).withColumn("keyword", F.col("tokens")[0])


def carried(df: DataFrame, value: Column, by, order: str, name: str) -> DataFrame:
    """The latest non-null value so far."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_until(by, order)))


def prefix_scope(df: DataFrame, by: str = "file", order: str = "pos") -> DataFrame:
    """``prefix`` in force at each line: that of the last Prefix line, and below it the Kitty lines'.

    After a Prefix a Kitty line names a child of it and replaces an earlier child; before any
    Prefix, Kitty lines nest.
    """
    second = F.get("tokens", F.lit(1))
    is_prefix, is_kitty = F.col("keyword") == "Prefix", F.col("keyword") == "Kitty"
    out = carried(df, F.when(is_prefix, F.concat(second, F.lit("/"))), by, order, "_own")
    out = out.withColumn("_scope", F.count(F.when(is_prefix, 1)).over(_until(by, order)))
    inside = _until([by, "_scope"], order)
    child = F.when(is_kitty, F.concat(second, F.lit("/")))
    latest = F.last(child, ignorenulls=True).over(inside)
    nested = F.array_join(F.collect_list(F.when(F.col("_scope") == 0, child)).over(inside), "")
    out = out.withColumn("prefix", F.when(F.col("_scope") > 0, F.concat("_own", F.coalesce(latest, F.lit("")))).otherwise(nested))
    return out.drop("_own", "_scope")


def block_membership(df: DataFrame, is_open: Column, is_close: Column, by, order: str) -> DataFrame:
    """``block`` (number of the opening so far) and ``inside`` for each row, for blocks that do not nest:
    a row is inside if the latest of openings and closings is an opening."""
    mark = F.when(is_open, 1).when(is_close, 0)
    out = df.withColumn("block", F.count(F.when(is_open, 1)).over(_until(by, order)))
    return out.withColumn("inside", F.coalesce(F.last(mark, ignorenulls=True).over(_until(by, order)), F.lit(0)) == 1)


def structure_errors(df: DataFrame, by: str = "file", order: str = "pos") -> DataFrame:
    """(file, line, message): nested blocks, ends without a beginning, lines that may not stand in a
    block, blocks without an end, unknown words."""
    word = F.col("keyword")
    opens, closes = word == "Parallel", word == "EndParallel"
    out = block_membership(df, opens, closes, by, order)
    before = Window.partitionBy(by).orderBy(order)
    was = F.coalesce(F.lag("inside").over(before), F.lit(False))
    last = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))) == 1
    out = out.withColumn("_was", was).withColumn("_last", last)
    found = F.array_compact(
        F.array(
            F.when(opens & F.col("_was"), F.lit("Parallel blocks cannot nest")),
            F.when(closes & ~F.col("_was"), F.lit("EndParallel without Parallel")),
            F.when(F.col("_was") & word.isin(*FORBIDDEN_INSIDE), F.concat(word, F.lit(" is not allowed inside a Parallel block"))),
            F.when(~word.isin(*KEYWORDS), F.concat(F.lit("unknown word "), word)),
            F.when(F.col("_last") & F.col("inside"), F.lit("Parallel without EndParallel")),
        )
    )
    return out.select(by, F.col(order).alias("line"), F.explode(found).alias("message"))


def after_restart(df: DataFrame, is_point: Column, by, order: str) -> DataFrame:
    """Rows from the first restart point on."""
    reached = F.max(F.when(is_point, 1).otherwise(0)).over(_until(by, order))
    return df.withColumn("_reached", reached).where("_reached = 1").drop("_reached")


def option(items: Column, name: str) -> Column:
    """Value of the last item name=value of an array; null if there is none."""
    found = F.filter(items, lambda t: t.startswith(f"{name}="))
    return F.when(F.size(found) > 0, F.substring_index(F.element_at(found, -1), "=", -1))


def block_options(items: Column) -> Column:
    """workers, memory, gpu and fail mode; malformed and absent ones keep their defaults."""
    none = F.lit(0)
    return F.struct(
        leading_int(option(items, "workers"), none).alias("workers"),
        F.coalesce(size_in_bytes(option(items, "memory")), F.lit(0).cast("long")).alias("memory"),
        leading_int(option(items, "gpu"), none).alias("gpu"),
        F.when(option(items, "fail") == "continue", "continue").otherwise("fast").alias("fail_mode"),
    )


def after_word(items: Column, word: str) -> Column:
    """The item after the last occurrence of a word."""
    at = F.array_position(F.reverse(items), word)
    return F.when(at > 1, F.element_at(items, (F.size(items) - at + 2).cast("int")))


def task(items: Column, prefix: Column) -> Column:
    """A Plugin line as (name, inputfile, outputfile, memory_hint, gpu_hint)."""
    return F.struct(
        F.get(items, F.lit(1)).alias("name"),
        resolve_path(after_word(items, "inputfile"), prefix).alias("inputfile"),
        resolve_path(after_word(items, "outputfile"), prefix).alias("outputfile"),
        F.coalesce(size_in_bytes(option(items, "memory")), F.lit(0).cast("long")).alias("memory_hint"),
        leading_int(option(items, "gpu"), F.lit(0)).alias("gpu_hint"),
    )


def parsed(rows: DataFrame, by: str = "file", order: str = "pos") -> DataFrame:
    """Config lines with prefix, block, inside, options (of Parallel lines) and task (of Plugin lines)."""
    out = prefix_scope(directives(rows), by, order)
    out = block_membership(out, F.col("keyword") == "Parallel", F.col("keyword") == "EndParallel", by, order)
    out = out.withColumn("options", F.when(F.col("keyword") == "Parallel", block_options(F.col("tokens"))))
    return out.withColumn("task", F.when(F.col("keyword") == "Plugin", task(F.col("tokens"), F.col("prefix"))))
