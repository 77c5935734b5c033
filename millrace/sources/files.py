"""Text files as relations, and the tabular formats that Spark reads.

Line order is a column (``pos``): it comes from the file, not from the rows' arrangement.  A file
of ordered lines is read whole (``wholetext``), so these readers are for configuration-sized
files, of which there may be many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import tokens, trim_blanks

FORMATS = ("parquet", "json", "orc", "csv", "text", "jdbc", "avro", "binaryFile")


def table(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    """A tabular source of one of FORMATS."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value) of each line; pos counts from 1 within the file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return split_lines(whole)


def split_lines(whole: DataFrame) -> DataFrame:
    """(file, pos, value) from (file, value) with whole texts; a last line end begins no line."""
    text = F.regexp_replace("value", r"\r?\n\z", "")
    return whole.select("file", F.posexplode(F.split(text, r"\r?\n")).alias("pos", "value")).withColumn("pos", (F.col("pos") + 1).cast("long"))


def sequence(rows: DataFrame) -> DataFrame:
    """Lines with blanks on either side removed, in their order."""
    return rows.withColumn("value", trim_blanks(F.col("value")))


def parameters(rows: DataFrame, by: str = "file") -> DataFrame:
    """(file, key, value): TAB-separated pairs; lines with fewer than two fields are left out, and of
    a repeated key the last line counts."""
    fields = F.split("value", "\t")
    pairs = rows.where(F.size(fields) >= 2).select(by, "pos", trim_blanks(fields[0]).alias("key"), trim_blanks(fields[1]).alias("value"))
    return pairs.groupBy(by, "key").agg(F.max_by("value", "pos").alias("value"))


def table_parameters(rows: DataFrame, by: str = "file") -> DataFrame:
    """The same from white-space separated columns, of which the first is the key; a key that
    occurs twice is an error (column ``duplicate``)."""
    fields = tokens(F.col("value"))
    pairs = rows.where(F.size(fields) >= 2).select(by, "pos", fields[0].alias("key"), fields[1].alias("value"))
    return pairs.groupBy(by, "key").agg(F.max_by("value", "pos").alias("value"), (F.count(F.lit(1)) > 1).alias("duplicate"))


def token_pairs(whole: DataFrame, by: str = "file") -> DataFrame:
    """(by, pair, key, value): a text's tokens as key, value, key, value, whatever the line; a last key
    without a value is left out."""
    words = tokens(F.col("value"))
    each = F.transform(F.sequence(F.lit(0), F.floor(F.size("words") / 2).cast("int") - 1), lambda i: F.struct(F.get("words", 2 * i).alias("key"), F.get("words", 2 * i + 1).alias("value")))
    pairs = whole.select(by, words.alias("words")).where(F.size("words") >= 2).select(by, F.posexplode(each).alias("pair", "p"))
    return pairs.select(by, F.col("pair").cast("long").alias("pair"), "p.key", "p.value")


def token_parameters(whole: DataFrame, by: str = "file") -> DataFrame:
    """The same from a stream of tokens: of a repeated key the last value counts.  Pairs are made within
    a row, so rows with one file stay streams of their own; of one key at one place in several of them
    the greatest value counts.  Each row keeps its last pair of a key, and only rows that share their
    file are grouped: the pairs of all others are neither sorted nor moved."""
    rows = whole.select(by, "value")
    shared = rows.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    same = F.col(by).eqNullSafe(F.col("__by"))

    def last(some: DataFrame) -> DataFrame:
        words = some.select(by, tokens(F.col("value")).alias("words")).where(F.size("words") >= 2)
        each = F.transform(F.sequence(F.lit(0), F.floor(F.size("words") / 2).cast("int") - 1), lambda i: F.struct(F.get("words", 2 * i).alias("key"), i.cast("long").alias("pair"), F.get("words", 2 * i + 1).alias("value")))
        ordered = words.select(by, each.alias("each")).select(by, F.sort_array("each").alias("each"))
        following = F.slice("each", F.lit(2), F.size("each"))
        kept = F.zip_with("each", following, lambda p, after: F.when(~p["key"].eqNullSafe(after["key"]), p))
        return ordered.select(by, F.explode(F.array_compact(kept)).alias("p")).select(by, "p.pair", "p.key", "p.value")

    alone = last(rows.join(shared, same, "left_anti")).select(by, "key", "value")
    # dealt before they are sorted for grouping, by place too, so that no key or file of many rows lands in one task
    dealt = last(rows.join(shared, same, "left_semi")).repartition(by, "key", "pair")
    return alone.unionByName(dealt.groupBy(by, "key").agg(F.max_by("value", F.struct("pair", "value")).alias("value")))


def as_map(pairs: DataFrame, by: str = "file") -> DataFrame:
    """(file, params): one map for each file."""
    return pairs.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("params"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder, through Spark's own readers."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length")
