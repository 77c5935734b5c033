"""Results against expected results: whole, without order, and within a tolerance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import TOLERANCE, differs, tokens


def balance(got: DataFrame, expected: DataFrame) -> DataFrame:
    """Each distinct row of either side, with ``_more``: how much more often the first side has it."""
    both = got.withColumn("_side", F.lit(1)).unionByName(expected.withColumn("_side", F.lit(-1)))
    return both.groupBy(*got.columns).agg(F.sum("_side").alias("_more"))


def equal_files(got: DataFrame, expected: DataFrame, by: str, value: str = "value", order: str = "pos") -> DataFrame:
    """(by, equal): whether each of many ordered files is equal line for line."""
    lines = balance(*(x.select(by, order, value) for x in (got, expected)))
    return lines.groupBy(by).agg((F.max(F.abs("_more")) == 0).alias("equal"))


def same_bytes(a: DataFrame, b: DataFrame, value: str = "value", order: str = "pos") -> bool:
    """Whether two ordered files are equal line for line."""
    return difference(a.select(order, value), b.select(order, value)).isEmpty()


def difference(got: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, as often as they are lacking; ``side`` says which."""
    lacking = balance(got, expected).where("_more <> 0")
    each = lacking.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_more"))))
    return each.select(*got.columns, F.when(F.col("_more") > 0, "got").otherwise("expected").alias("side"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """The rows with ``n``, their number in order over the whole table: sorted by ranges, and counted
    by range, so no task sees all rows."""
    from millrace.plans.session import checkpointed

    rows = checkpointed(df.orderBy(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))  # a row for each range
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn("n", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_at")


def field_differences(got: DataFrame, expected: DataFrame, by: str, fields: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(by, n, field, got, expected): fields that differ after both sides' rows were sorted.

    Rows are arrays of strings.  All rows are compared; a row or field that one side lacks differs.
    """
    w = Window.partitionBy(by).orderBy(fields)
    return _field_pairs(*(x.select(by, fields, F.row_number().over(w).cast("long").alias("n")) for x in (got, expected)), [by], fields, tolerance)


def _field_pairs(got: DataFrame, expected: DataFrame, by: list[str], fields: str, tolerance: float) -> DataFrame:
    left, right = (x.select(*by, "n", F.posexplode(fields).alias("field", side)) for x, side in ((got, "got"), (expected, "expected")))
    both = left.join(right, [*by, "n", "field"], "full")
    return both.where(F.coalesce(differs(F.col("got"), F.col("expected"), tolerance), F.lit(True)))


def fields_of(kind: str, value: str = "value"):
    """How a file's lines are cut: commas in csv, white space in noa; other kinds are not compared so."""
    if kind == "csv":
        return F.split(value, ",")
    if kind == "noa":
        return tokens(F.col(value))
    raise ValueError(f"no fields in files of kind {kind!r}")


def verdict(got: DataFrame, expected: DataFrame, kind: str = "", custom: Callable[[DataFrame, DataFrame], bool] | None = None) -> str:
    """PASS or FAIL of (pos, value) files, by the first comparison that succeeds: equal lines, the
    caller's own comparison, equal lines in any order, fields within the tolerance."""
    if same_bytes(got, expected) or custom is not None and custom(got, expected):
        return "PASS"
    if difference(got.select("value"), expected.select("value")).isEmpty():
        return "PASS"
    if kind in ("csv", "noa"):
        sides = [numbered(x.select(fields_of(kind).alias("fields")), "fields") for x in (got, expected)]
        return "PASS" if _field_pairs(*sides, [], "fields", TOLERANCE).isEmpty() else "FAIL"
    return "FAIL"


def paired(files: DataFrame, path: str = "path") -> DataFrame:
    """(expected, produced): each file x.expected with x; produced is null if it was not made."""
    wanted = files.where(F.col(path).endswith(".expected")).select(F.col(path).alias("expected"), F.regexp_replace(path, r"\.expected$", "").alias("_made"))
    made = files.select(F.col(path).alias("produced"))
    return wanted.join(made, F.col("_made") == F.col("produced"), "left").drop("_made")


def status(has_example, has_config, has_expected, interactive, produced, equal):
    """PASS, FAIL, WARN or INCOMPAT of one case, as an expression over booleans."""
    return F.when(~has_example | ~has_config | ~has_expected, "WARN").when(interactive, "INCOMPAT").when(~produced | ~equal, "FAIL").otherwise("PASS")


def skipped(cases: DataFrame, skips: DataFrame, name: str = "name") -> DataFrame:
    """Cases with the status of the strongest skip (OFF, LOCAL, INCOMPAT) that names them, else null."""
    rank = F.array_position(F.array(F.lit("OFF"), F.lit("LOCAL"), F.lit("INCOMPAT")), F.col("status"))
    best = skips.groupBy(name).agg(F.min_by("status", rank).alias("status"), F.min_by("reason", rank).alias("reason"))
    return cases.join(best, name, "left")


def counts(results: DataFrame, status_: str = "status") -> DataFrame:
    return results.groupBy(status_).agg(F.count(F.lit(1)).alias("n"))


def pass_rate(results: DataFrame, by: list[str], passed, failed) -> DataFrame:
    """Percent of passes among passes and failures; 0 if there were none."""
    p, f = F.count_if(passed), F.count_if(failed)
    return results.groupBy(*by).agg(F.when(p + f != 0, p / (p + f) * 100).otherwise(F.lit(0.0)).alias("pass_rate"))
