"""Step registries as relations: who provides a step, which are missing, where a file is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: list[str], value: str, order: Column) -> DataFrame:
    """The value that the last registration of each key left."""
    return df.groupBy(*key).agg(F.max_by(value, order).alias(value))


def first_wins(df: DataFrame, key: list[str], value: str, order: Column) -> DataFrame:
    """The value found first along a search path."""
    return df.groupBy(*key).agg(F.min_by(value, order).alias(value))


def dispatched(steps: DataFrame, registry: DataFrame, on: str, value: str, missing: str = "no suitable language") -> DataFrame:
    """Steps with their provider; unknown ones are marked, not dropped."""
    return steps.join(registry, on, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def missing(required: DataFrame, installed: DataFrame, on: list[str]) -> DataFrame:
    return required.join(installed, on, "left_anti")


def met(required: DataFrame, installed: DataFrame, on: list[str]) -> DataFrame:
    return required.join(installed, on, "left_semi")


def plugin_files(files: DataFrame, path: str = "path", suffix: str = "Plugin") -> DataFrame:
    """(name, extension, path) of files that define steps; package markers are left out."""
    found = F.regexp_extract(path, rf"([^/\\]+){suffix}\.([^.]+)$", 0)
    rows = files.where((found != "") & ~F.col(path).contains("__init__"))
    return rows.select(F.regexp_replace(F.regexp_extract(path, rf"([^/\\]+){suffix}\.[^.]+$", 1), "^lib", "").alias("name"), F.regexp_extract(path, r"\.([^.]+)$", 1).alias("extension"), path)


def built_crates(files: DataFrame, path: str = "path", suffix: str = "Plugin") -> DataFrame:
    """(folder, name, built): folders with a Cargo.toml, and whether the compiled library lies there."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]+$", 1)
    own = files.select(folder.alias("folder"), F.regexp_extract(path, r"([^/]+)$", 1).alias("file"))
    crates = own.where("file = 'Cargo.toml'").select("folder", F.regexp_extract("folder", r"([^/]+)$", 1).alias("name")).distinct()
    libs = own.where(F.col("file").rlike(rf"^lib.+{suffix}\.so$")).select("folder", F.regexp_extract("file", rf"^lib(.+){suffix}\.so$", 1).alias("name"), F.lit(True).alias("built"))
    return crates.join(libs, ["folder", "name"], "left").withColumn("built", F.coalesce("built", F.lit(False)))
