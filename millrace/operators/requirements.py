"""Requirements of plugins: parsing, conflicts between pins and bounds, one merged list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import package_name, trim_blanks, version_key, without_comment
from millrace.sources import files, sinks

#: The operators of version specifiers, and which of them bound from below and above.
OPERATORS = ("===", "~=", "==", "!=", "<=", ">=", "<", ">")
LOWER, UPPER = (">=", ">", "~=", "=="), ("<=", "<")
SPEC = rf"({'|'.join(OPERATORS)})\s*([A-Za-z0-9.*+!_-]+)"
#: name, extras, specifiers (with or without parentheses) or an address
LINE = rf"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(\[[^\]]*\])?\s*(\(?\s*{SPEC}(?:\s*,\s*{SPEC})*\s*,?\s*\)?|@\s*\S+)?$"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(plugin, pos, value): the lines of each folder's requirements.txt below a root."""
    rows = files.lines(spark, f"{root.rstrip('/')}/*/requirements.txt")
    return rows.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("plugin"), "pos", "value")


def _bodies(lines: DataFrame, value: str) -> DataFrame:
    """Lines that ask for something, as ``_text``, and without the environment marker, as ``_body``."""
    rows = lines.withColumn("_text", trim_blanks(without_comment(F.col(value)))).where((F.col("_text") != "") & ~F.col("_text").startswith("-"))
    return rows.withColumn("_body", trim_blanks(F.split_part("_text", F.lit(";"), F.lit(1))))


def parsed(lines: DataFrame, plugin: str = "plugin", value: str = "value") -> DataFrame:
    """(plugin, pos, name, pkg, specs): comments, blank lines, options and unreadable lines are left out.

    Environment markers (behind ``;``) and extras (in brackets) are no part of the specifiers.
    """
    rest = F.regexp_extract("_body", LINE, 3)
    rest = F.when(rest.startswith("@"), "").otherwise(rest)
    specs = F.arrays_zip(F.regexp_extract_all(rest, F.lit(SPEC), F.lit(1)).alias("op"), F.regexp_extract_all(rest, F.lit(SPEC), F.lit(2)).alias("version"))
    name = F.regexp_extract("_body", LINE, 1)
    return _bodies(lines, value).where(F.col("_body").rlike(LINE)).select(plugin, "pos", name.alias("name"), package_name(name).alias("pkg"), specs.alias("specs"))


def warnings(lines: DataFrame, plugin: str = "plugin", value: str = "value") -> DataFrame:
    """(plugin, pos, message) of lines that are no requirement."""
    bad = _bodies(lines, value).where(~F.col("_body").rlike(LINE))
    return bad.select(plugin, "pos", F.concat(F.lit("skipping unreadable requirement '"), "_text", F.lit("'")).alias("message"))


def specifiers(requirements: DataFrame, plugin: str = "plugin") -> DataFrame:
    """(plugin, pos, name, pkg, op, version), one row for each specifier (nulls where there is none)."""
    one = requirements.select(plugin, "pos", "name", "pkg", F.explode_outer("specs").alias("s"))
    return one.select(plugin, "pos", "name", "pkg", F.col("s.op").alias("op"), F.col("s.version").alias("version"))


def pinned_conflicts(specs: DataFrame, pkg: str = "pkg", op: str = "op", version: str = "version") -> DataFrame:
    """(pkg, versions): packages pinned to more than one version."""
    out = specs.where(F.col(op) == "==").groupBy(pkg).agg(F.array_sort(F.collect_set(version)).alias("versions"))
    return out.where(F.size("versions") > 1)


def unsatisfiable(specs: DataFrame, pkg: str = "pkg", op: str = "op", version: str = "version") -> DataFrame:
    """(pkg, lower, upper): packages whose greatest lower bound is above their least upper bound.

    Versions compare by their numbers, pre-, post- and development releases; strings that are no
    version (such as 1.*) say nothing.
    """
    rows = specs.withColumn("_key", version_key(F.col(version)))
    lower = F.when(F.col(op).isin(*LOWER), F.struct("_key", F.col(version).alias("v")))
    upper = F.when(F.col(op).isin(*UPPER), F.struct("_key", F.col(version).alias("v")))
    out = rows.where("_key IS NOT NULL").groupBy(pkg).agg(F.max(lower).alias("lo"), F.min(upper).alias("hi"))
    return out.where(F.col("lo._key") > F.col("hi._key")).select(pkg, F.col("lo.v").alias("lower"), F.col("hi.v").alias("upper"))


def merged(specs: DataFrame, order: str = "pos", pkg: str = "pkg", name: str = "name") -> DataFrame:
    """(pkg, line): one requirement for each package, with all its specifiers and its first name."""
    spec = F.concat("op", "version")
    out = specs.groupBy(pkg).agg(F.min_by(name, order).alias("name"), F.array_join(F.array_sort(F.collect_set(spec)), ",").alias("specs"))
    return out.select(pkg, F.concat("name", "specs").alias("line"))


def resolve(spark: SparkSession, root: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reads a tree, and writes one merged list if nothing conflicts: (warnings, pins, bounds)."""
    lines = read_tree(spark, root)
    specs = specifiers(parsed(lines))
    pins, bounds = pinned_conflicts(specs), unsatisfiable(specs)
    if pins.isEmpty() and bounds.isEmpty():
        sinks.write_lines(merged(specs.withColumn("pos", F.struct("plugin", "pos"))), target, "pkg", "line")
    return warnings(lines), pins, bounds
